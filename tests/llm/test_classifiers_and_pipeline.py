"""Classifiers against scores computed plainly from their models, and the pipeline against plain code."""

import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_near_dedup import brute_classes
from test_text_operators import ALL_SECRETS, found_by
from tokenizers import Tokenizer

import corpus_pipeline
from loomtide.llm import quality, toxicity
from loomtide.llm.common import documents, table
from loomtide.llm.training import sample

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def rates(rows, truth, predicted):
    held = [(r[predicted], truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    right, hits = sum(p == t for p, t in held), sum(p == t == 1 for p, t in held)
    return right / len(held), hits / max(1, sum(t for _, t in held)), hits / max(1, sum(p for p, _ in held))


@pytest.mark.parametrize(("module", "target", "least"), [(quality, "quality", 0.97), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, module, target, least):
    labels = table(spark, SF, "labels")
    rows = module.score(table(spark, SF, "documents"), labels).collect()
    truth = {r.doc_id: r[target] for r in labels.collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    accuracy, _, _ = rates(rows, truth, "predicted")
    assert accuracy >= least
    again = {r.doc_id: r.score for r in module.score(table(spark, SF, "documents"), labels).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in rows)


def test_held_out_toxic_texts_are_found(spark):
    labels = table(spark, LARGER, "labels")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    accuracy, recall, precision = rates(toxicity.score(table(spark, LARGER, "documents"), labels).collect(), truth, "predicted")
    assert accuracy >= 0.98 and recall >= 0.9 and precision >= 0.95


def code(term, buckets):
    return zlib.crc32(term.encode()) % buckets



def plain_quality_terms(text):
    out = []
    for chunk in text.split():
        for piece in re.findall(r"[^\W_]+|[\W_]+", chunk):
            if piece[0] == "_" or not piece[0].isalnum():
                out.append(code("p" + piece, quality.BUCKETS))
            else:
                shape = "A" if piece.isupper() and len(piece) > 1 else "T" if piece[0].isupper() else "d" if piece.isdigit() else "l"
                out += [code("w" + piece.lower(), quality.BUCKETS), code("s" + shape, quality.BUCKETS)]
    return out


def plain_quality_score(m, text):
    """The mean of the terms' vectors, its length, the share of distinct terms and the size, through the layers, in loops."""
    terms = plain_quality_terms(text)
    mean = [math.fsum(float(m.vectors[t][d]) for t in terms) / len(terms) if terms else 0.0 for d in range(quality.DIM)]
    x = [*mean, math.sqrt(sum(c * c for c in mean)), len(set(terms)) / len(terms) if terms else 0.0, math.log1p(len(terms))]
    z = [(a - float(c)) / float(s) for a, c, s in zip(x, m.center, m.scale, strict=True)]
    w1, b1, w2, b2 = m.layers
    hidden = [math.tanh(sum(a * float(w1[i][h]) for i, a in enumerate(z)) + float(b1[h])) for h in range(len(b1))]
    logit = sum(a * float(w) for a, w in zip(hidden, w2, strict=True)) + float(b2[0])
    return 1 / (1 + math.exp(-(logit / m.temperature + m.offset)))


def plain_toxicity_score(m, text):
    """Weights of the terms and inner products of all their pairs, one by one."""
    terms = set()
    for piece in re.findall(r"[^\W_]+", text):
        if piece[0].isalpha():
            word = piece.lower()
            terms |= {code("w" + word, toxicity.BUCKETS), *(code(f"b{word[:n]}", toxicity.BUCKETS) for n in (4, 5) if len(word) >= n)}
    own = sorted({int(m.place[t]) for t in terms} - {-1})
    logit = float(m.bias) + sum(float(m.weights[i]) for i in own)
    for a, i in enumerate(own):
        for j in own[:a]:
            logit += sum(float(x) * float(y) for x, y in zip(m.factors[i], m.factors[j], strict=True))
    return 1 / (1 + math.exp(-logit))


SCORES = {quality: plain_quality_score, toxicity: plain_toxicity_score}


@pytest.mark.parametrize(("module", "target", "fold", "left_out"), [(quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_scores_against_plain_code(spark, module, target, fold, left_out):
    docs = table(spark, SF, "documents").where("n_chars < 700").limit(90).selectExpr("*", "1 as score", "2 as held_out", "'x' as size", "3 as y").checkpoint()
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).selectExpr("null as doc_id", "null as text", "lang", "source", "n_chars", "score", "held_out", "size", "y"))
    labels = table(spark, SF, "labels")
    model = module.learn(documents(docs), labels)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).add(r.text or "")
    rows = module.score(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = [SCORES[module](model, t) for t in texts[r.doc_id]]
        assert min(abs(r.score - w) for w in want) < 1e-5
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % fold == left_out) and r.predicted == (r.score >= 0.3)


def test_term_vectors_against_loops():
    rng = random.Random(5)
    sequences = [np.array([rng.randrange(12) for _ in range(n)], dtype="<u4") for n in (0, 1, 2, 9, 40)]
    places, signs = quality.index_vectors()
    index = np.zeros((12, quality.DIM))
    for t in range(12):
        for p, s in zip(places[t], signs[t], strict=True):
            index[t, p] += s
    context = np.zeros((12, quality.DIM))
    for seq in sequences:
        for i, t in enumerate(seq):
            for j, other in enumerate(seq):
                if 0 < abs(i - j) <= quality.SPAN:
                    context[t] += index[other]
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality.term_vectors(sequences)[:12], unit(index) + unit(context), atol=1e-5)


def test_sums_against_loops(monkeypatch):
    monkeypatch.setattr(toxicity, "ENTRIES", 7)
    rng = np.random.default_rng(1)
    sizes = np.array([0, 3, 0, 20, 1, 2, 0, 5, 0])
    index, rows = rng.integers(0, 6, sizes.sum()), rng.random((6, 2))
    ends = np.cumsum(sizes)
    want = [rows[index[e - n : e]].sum(axis=0) for e, n in zip(ends, sizes, strict=True)]
    assert np.allclose(toxicity.Sums(index, sizes)(rows), want)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edges(spark, module):
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "x y"), (3, "word " * 9000)], "doc_id long, text string").selectExpr("*", "1 as score")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(2, 1, 1), (None, 0, 0), (3, None, None), (11, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in module.score(docs, none).collect()} == {0.5}
    assert {r.score for r in module.score(docs, one).collect()} <= {1.0}
    two = spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    made = spark.createDataFrame([(k, "good words here" if k % 2 else "%%% bad") for k in range(40)], "doc_id long, text string")
    got = module.score(made.unionByName(docs.select("doc_id", "text")), two).collect()
    assert len(got) == 45 and all(0 <= r.score <= 1 for r in got) and all(r.held_out for r in got if r.doc_id is None)
    assert module.score(docs.limit(0), two).count() == 0


def test_sample_is_bounded_and_leaves_the_fold_out(spark):
    labels = spark.createDataFrame([(k, k % 3 % 2) for k in range(300)], "doc_id long, quality int")
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(300)], "doc_id long, text string")
    texts, y, share = sample(docs, labels, "quality", 5, 0, 20)
    assert len(texts) == 40 and y.sum() == 20 and 0.2 < share < 0.5
    assert all(zlib.crc32(t[1:].encode()) % 5 for t in texts)


@pytest.mark.parametrize("neither", [0, 1])
def test_interactions_are_learnt(neither):
    """A pair of terms that are toxic together alone; and one whose terms say nothing alone (neither is toxic, too)."""
    rng = random.Random(1)
    fill = [f"word{k}" for k in range(30)]

    def text(*marks):
        return " ".join([*rng.sample(fill, 8), *marks])

    made = [(text(*marks), y) for _ in range(200) for marks, y in ((("insult", "group"), 1), (("insult",), 0), (("group",), 0), ((), neither))]
    m = toxicity.fit([t for t, _ in made], np.array([float(y) for _, y in made]), (1 + neither) / 4)
    coder = toxicity.Coder(toxicity.terms_of)
    score = lambda *marks: toxicity.sigmoid(m.logit(coder(text(*marks))))
    assert score("insult", "group") > 0.6 and score("insult") < 0.3 and score("group") < 0.3 and (score() > 0.6) == neither


def redacted(text):
    """Each maximal overlap of secrets as one mark."""
    marked = bytearray(len(text))
    spans = [(s, e) for _, s, e in found_by(ALL_SECRETS, text)]
    for s, e in spans:
        marked[s:e] = b"\1" * (e - s)
    out, k = [], 0
    while k < len(text):
        if not marked[k]:
            out.append(text[k])
            k += 1
            continue
        end = max(e for s, e in spans if s == k)
        while any(s < end < e for s, e in spans):
            end = max(e for s, e in spans if s < end)
        out.append("[SECRET]")
        k = end
    return "".join(out)


def check_packing(rows, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d in docs:
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 1]
        want += [(str(d.doc_id), at, len(ids[at : at + 2048]), zlib.crc32(b"".join(struct.pack("<I", i) for i in ids[at : at + 2048])), len(ids)) for at in range(0, len(ids), 2048)]
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == sorted(want)
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert at.get(r.sequence_id, 0) == r.offset
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values(), default=0) <= 2048


def test_stages_against_plain_code(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    key = lambda r: (str(r.doc_id), r.text)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "SimHash near-dedup", "secret scans", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = now.orderBy("doc_id").collect()
        out = stage(spark, now, SF)
        got = out.collect()
        if name in ("quality classifier", "toxicity"):
            module, keeps = (quality, 1) if name[0] == "q" else (toxicity, 0)
            model = module.learn(documents(now), labels)
            short = [r for r in before if len(r.text or "") < 600][:60]
            kept = {r.doc_id for r in got}
            assert all((r.doc_id in kept) == ((SCORES[module](model, r.text or "") >= 0.3) == keeps) for r in short)
        elif name == "SimHash near-dedup":
            assert sorted(r.doc_id for r in got) == sorted(before[k].doc_id for k in set(brute_classes([r.text for r in before])))
        elif name == "secret scans":
            assert sorted(map(key, got)) == sorted((str(r.doc_id), redacted(r.text)) for r in before) and all(r.n_chars == len(r.text) for r in got)
        else:
            check_packing(got, before)
            break
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
        now = out.checkpoint()
    whole = corpus_pipeline.run(spark, SF).collect()
    pieces = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert pieces(whole) == pieces(got)


def test_pipeline_edges(spark, tmp_path):
    """Null ids and texts, empty, long and repeated rows, a column too many; then no rows at all."""
    good = [r.text for r in table(spark, SF, "documents").join(table(spark, SF, "labels").where("quality = 1 and toxic = 0").select("doc_id"), "doc_id").orderBy("doc_id").limit(12).collect()]
    rows = [*((k, t) for k, t in enumerate(good)), (3, good[3]), (None, good[4] + " " + good[5]), (None, None), (50, ""), (51, None), (52, " ".join(good) * 40), (53, good[6] + " token=abcdefgh12 end")]
    docs = spark.createDataFrame([(k, t, None, None, None, 9) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row_hash int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, SF, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    now = table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[2:4]:
        now = stage(spark, now, str(tmp_path)).checkpoint()
    left = now.collect()
    assert sum(r.doc_id == 3 for r in left) == 1 and sum(not r.text for r in left) == 1 and not any("token=" in (r.text or "") for r in left)
    check_packing(corpus_pipeline.pack_sequences(spark, now, str(tmp_path)).collect(), left)
    assert corpus_pipeline.run(spark, str(tmp_path)).where("length <= 0").count() == 0
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    table(spark, SF, "labels").limit(0).write.parquet(str(tmp_path / "none/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


