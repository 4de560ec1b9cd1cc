"""Quality scores from random-indexing word vectors and a two-layer network.

Every term (word, shape of a word, run of symbols) has a sparse random index vector. Over a
bounded sample of labelled texts, a term's context vector adds up the index vectors of its
neighbours; a term's vector is the sum of both, so terms that were never seen still have their
index vector. A document is the mean of its terms' vectors with the mean's length, its share of
distinct terms and its size. A network with one hidden layer is trained on the sample, its
outputs are divided by a temperature fitted on texts kept back from training, and corrected for
the classes' shares among all labelled rows.

Edge cases: a null or empty text has no terms and is scored by the network on zeros; repeated
rows are scored each; a null id counts as held out; without labels of both classes every score
is the share of class 1 (0.5 without any label); an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.llm.common import documents, per_text
from loomtide.llm.training import MAX_ROWS_PER_CLASS, PIECES, Adam, Coder, bucket, held_out, sample, sigmoid

BUCKETS, DIM, NONZERO, SPAN, SEED = 1 << 16, 64, 6, 2, 7
#: Terms of a text whose neighbours are added at once, and chunks remembered while fitting.
SEQUENCE, FIT_CACHE = 16_384, 50_000
HIDDEN, STEPS, THRESHOLD = 24, 400, 0.3
FOLDS, FOLD = 5, 0


def terms_of(chunk: str) -> list[int]:
    codes = []
    for piece in PIECES.findall(chunk):
        if piece[0] == "_" or not piece[0].isalnum():
            codes.append(bucket("p" + piece, BUCKETS))
            continue
        shape = "A" if piece.isupper() and len(piece) > 1 else "T" if piece[0].isupper() else "d" if piece.isdigit() else "l"
        codes += [bucket("w" + piece.lower(), BUCKETS), bucket("s" + shape, BUCKETS)]
    return codes


def index_vectors(buckets: int = BUCKETS, dim: int = DIM, nonzero: int = NONZERO, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs), each (buckets, nonzero): the sparse ternary index vectors."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, dim, (buckets, nonzero)), rng.choice([-1.0, 1.0], (buckets, nonzero)).astype(np.float32)


def term_vectors(sequences: list[np.ndarray]) -> np.ndarray:
    """Unit index vectors plus unit context vectors, (BUCKETS, DIM) float32."""
    places, signs = index_vectors()
    context = np.zeros(BUCKETS * DIM, dtype=np.float32)
    for seq in sequences:
        s = seq.astype(np.int64)
        for gap in range(1, SPAN + 1):
            for here, there in ((s[:-gap], s[gap:]), (s[gap:], s[:-gap])):
                for at in range(0, len(here), SEQUENCE):
                    one, other = here[at : at + SEQUENCE], there[at : at + SEQUENCE]
                    cells = (one[:, None] * DIM + places[other]).reshape(-1)
                    own, inverse = np.unique(cells, return_inverse=True)
                    context[own] += np.bincount(inverse, weights=signs[other].reshape(-1))
    vectors = np.zeros((BUCKETS, DIM), dtype=np.float32)
    np.add.at(vectors, (np.arange(BUCKETS)[:, None], places), signs)
    context = context.reshape(BUCKETS, DIM)
    for m in (vectors, context):
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    vectors += context
    return vectors


def pooled(codes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    if not len(codes):
        return np.zeros(DIM + 3)
    own, counts = np.unique(codes, return_counts=True)
    mean = (counts.astype(np.float32) @ vectors[own]) / len(codes)
    return np.concatenate([mean, [np.linalg.norm(mean), len(own) / len(codes), np.log1p(len(codes))]])


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float
    offset: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.center) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature + self.offset)


def fit(texts: list[str], y: np.ndarray, share: float, seed: int = SEED) -> Model:
    coder = Coder(terms_of, FIT_CACHE)
    sequences = [coder(t) for t in texts]
    vectors = term_vectors(sequences)
    x = np.array([pooled(s, vectors) for s in sequences])
    rng = np.random.default_rng(seed)
    kept_back = rng.random(len(y)) < 0.2
    if len(set(y[~kept_back])) < 2 or len(set(y[kept_back])) < 2:
        kept_back[:] = False
    train = ~kept_back
    center, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
    z, t = (x[train] - center) / scale, y[train]
    layers = [rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
    adam = Adam(layers, 0.01)
    for _ in range(STEPS):
        w1, b1, w2, b2 = layers
        h = np.tanh(z @ w1 + b1)
        d = (sigmoid(h @ w2 + b2) - t) / len(t)
        back = np.outer(d, w2) * (1 - h * h)
        adam.step([z.T @ back + 1e-3 * w1, back.sum(axis=0), h.T @ d + 1e-3 * w2, np.array([d.sum()])])
    drawn = np.clip(t.mean(), 1e-3, 1 - 1e-3)
    share = np.clip(share, 1e-3, 1 - 1e-3)
    raw = Model(vectors, center, scale, tuple(layers), 1.0, 0.0)
    check = kept_back if kept_back.any() else train
    logits = raw.logits(x[check])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, np.where(y[check] > 0, -1, 1) * logits / g)) for g in grid]
    return Model(vectors, center, scale, tuple(layers), float(grid[int(np.argmin(loss))]), float(np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))))


def learn(docs: DataFrame, labels: DataFrame, target: str = "quality", per_class: int = MAX_ROWS_PER_CLASS) -> Model | float:
    """A model, or the constant score where labels of both classes are missing."""
    texts, y, share = sample(docs, labels, target, FOLDS, FOLD, per_class)
    return fit(texts, y, share) if len(set(y)) == 2 else share


def scorer(df: DataFrame, labels: DataFrame) -> Callable[[], Callable[[list[str]], list]]:
    """Learns from the labelled rows of df; the result makes a worker's scoring function."""
    docs = documents(df)
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def make() -> Callable[[list[str]], list]:
        coder, m = Coder(terms_of), model.value
        if isinstance(m, float):
            return lambda texts: [[m] * len(texts)]
        return lambda texts: [m.scores(np.array([pooled(coder(t), m.vectors) for t in texts]).reshape(-1, DIM + 3))]

    return make


def score(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of df (doc_id, text)."""
    scored = per_text(documents(df), scorer(df, labels), [("score", pa.float64())], "score double")
    return scored.select("doc_id", held_out(FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
