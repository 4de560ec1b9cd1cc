"""Toxicity scores from a factorisation machine over hashed terms.

A document is the set of its terms: words in lower case and their beginnings of four and five
letters, which carry over to inflected and compounded forms. Each hashed term that at least
MIN_DOCS texts of a bounded labelled sample hold has a weight and a short factor vector; a
document's logit is the sum of its terms' weights plus the inner products of all pairs of factors,
so that a pair of terms can count for more than both alone, or where neither counts alone. How far
weights and factors can move under the same penalty follows from the term's chi-squared with the
label, without a bar: a term that says little alone keeps a small weight, and factors of a tenth
of the full size. The logit is corrected for the classes' shares among all labelled rows.

Edge cases: a null or empty text has no terms and gets the base rate; repeated rows are scored
each; a null id counts as held out; without labels of both classes every score is the share of
class 1 (0.5 without any label); an empty table gives no rows; other columns are ignored.
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

BUCKETS, RANK, SEED = 1 << 18, 8, 11
MIN_DOCS = 3
#: Chi-squared of a term with half the full size, and the least sizes of a weight and of factors.
HALF, LEAST_WEIGHT, LEAST_FACTOR = 50.0, 0.01, 0.1
#: Penalties of weights and factors, and entries of the sample that are summed at once.
PENALTY_WEIGHT, PENALTY_FACTOR = 1e-4, 1e-3
ENTRIES = 1 << 18
#: Chunks remembered while fitting.
FIT_CACHE = 50_000
STEPS, RATE, THRESHOLD = 80, 0.05, 0.3
FOLDS, FOLD = 4, 2


def terms_of(chunk: str) -> list[int]:
    codes = []
    for piece in PIECES.findall(chunk):
        if piece[0].isalpha():
            word = piece.lower()
            codes.append(bucket("w" + word, BUCKETS))
            codes += [bucket(f"b{word[:n]}", BUCKETS) for n in (4, 5) if len(word) >= n]
    return codes


@dataclass(frozen=True)
class Model:
    place: np.ndarray  # of each bucket among the terms, or -1
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, codes: np.ndarray) -> float:
        own = np.unique(self.place[codes])
        own = own[1:] if len(own) and own[0] < 0 else own
        v = self.factors[own]
        return float(self.bias + self.weights[own].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v * v).sum()))


def related(sets: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets that MIN_DOCS sets hold, their size from 0 to 1 by chi-squared with the label)."""
    on, off = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for s, t in zip(sets, y, strict=True):
        (on if t else off)[s] += 1
    kept = np.nonzero(on + off >= MIN_DOCS)[0]
    on, off, p, q = on[kept], off[kept], y.sum(), len(y) - y.sum()
    n, df = len(y), on + off
    cross = on * (q - off) - off * (p - on)
    chi2 = n * cross**2 / (df * np.maximum(n - df, 1) * p * q)  # a term of all texts has cross = 0
    return kept, chi2 / (chi2 + HALF)


class Sums:
    """Sums of rows of a table over runs of an index, ENTRIES at a time."""

    def __init__(self, index: np.ndarray, sizes: np.ndarray):
        ends = np.concatenate([[0], np.cumsum(sizes)])
        self.index, self.n, self.parts, at = index, len(sizes), [], 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + ENTRIES, side="right")) - 1)
            own = np.nonzero(sizes[at:to])[0]
            if len(own):
                self.parts.append((slice(ends[at], ends[to]), at + own, ends[at + own] - ends[at]))
            at = to

    def __call__(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, table.shape[1]), dtype=table.dtype)
        for entries, rows, begins in self.parts:
            out[rows] = np.add.reduceat(table[self.index[entries]], begins, axis=0)
        return out


def fit(texts: list[str], y: np.ndarray, share: float, seed: int = SEED) -> Model:
    coder = Coder(terms_of, FIT_CACHE)
    sets = [np.unique(coder(t)) for t in texts]
    kept, size = related(sets, y)
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept))
    held = [own[own >= 0] for own in (place[s] for s in sets)]
    lengths = np.array([len(h) for h in held])
    terms = np.concatenate(held)
    by_text = Sums(terms, lengths)
    by_term = Sums(np.repeat(np.arange(len(y), dtype=np.int32), lengths)[np.argsort(terms, kind="stable")], np.bincount(terms, minlength=len(kept)))
    of_weight, of_factor = (np.maximum(size, least).astype(np.float32)[:, None] for least in (LEAST_WEIGHT, LEAST_FACTOR))
    rng = np.random.default_rng(seed)
    bias, w, v = np.zeros(1, dtype=np.float32), np.zeros((len(kept), 1), dtype=np.float32), (rng.standard_normal((len(kept), RANK)) * 0.01).astype(np.float32)
    adam = Adam([bias, w, v], RATE)
    for _ in range(STEPS):
        factors = v * of_factor
        sums = by_text(np.concatenate([w * of_weight - 0.5 * (factors * factors).sum(axis=1, keepdims=True), factors], axis=1))
        xv = sums[:, 1:]
        d = ((sigmoid(bias + sums[:, 0] + 0.5 * (xv**2).sum(axis=1)) - y) / len(y)).astype(np.float32)[:, None]
        back = by_term(np.concatenate([d, d * xv], axis=1))
        adam.step([d.sum(keepdims=True)[0], back[:, :1] * of_weight + PENALTY_WEIGHT * w, (back[:, 1:] - back[:, :1] * factors) * of_factor + PENALTY_FACTOR * v])
    drawn, share = (np.clip(s, 1e-3, 1 - 1e-3) for s in (y.mean(), share))
    offset = np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    return Model(place, float(bias[0] + offset), (w * of_weight)[:, 0], v * of_factor)


def learn(docs: DataFrame, labels: DataFrame, target: str = "toxic", per_class: int = MAX_ROWS_PER_CLASS) -> Model | float:
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
        return lambda texts: [sigmoid(np.array([m.logit(coder(t)) for t in texts]))]

    return make


def score(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of df (doc_id, text)."""
    scored = per_text(documents(df), scorer(df, labels), [("score", pa.float64())], "score double")
    return scored.select("doc_id", held_out(FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
