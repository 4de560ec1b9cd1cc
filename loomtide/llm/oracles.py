"""The queries of this subpackage that DuckDB SQL can express, over the same tables."""

from __future__ import annotations

import re

from loomtide.llm import embedding_dedup, secret_scan, topk_bitsliced

_FINITE = "len(list_filter({x}, lambda c: c IS NULL OR NOT isfinite(c))) = 0"

OP1 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS x FROM embeddings),
g AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND {_FINITE.format(x="x")} AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= {embedding_dedup.THRESHOLD}),
r(a, b) AS (SELECT vec_id, vec_id FROM g UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""

OP3 = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor({topk_bitsliced.SCALE} * CAST(c AS DOUBLE))) AS q FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND {_FINITE.format(x="embedding")}),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {topk_bitsliced.TOP}"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pattern(part: str, ignore_case: bool) -> str:
    """A rule's part with groups that capture nothing, and letters of either case outside escapes."""
    plain = part.replace("(", "(?:")
    return re.sub(r"\\x20|[A-Za-z]", lambda m: m[0] if len(m[0]) > 1 else f"[{m[0].lower()}{m[0].upper()}]", plain) if ignore_case else plain


def _kind(k: int, rule: secret_scan.Rule) -> str:
    """Spans of one rule: matches by place, after the lengths of all gaps and matches before."""
    head = _pattern(rule.head, rule.ignore_case)
    whole = head + rule.body
    body = f"length(regexp_extract(m, {_quoted(f'^(?:{head})({rule.body})$')}, 1))"
    return f"""SELECT rid, {k} AS k, '{rule.kind}' AS kind, first AS s, first + length(m) AS e FROM (
SELECT rid, ms[i] AS m, coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS first FROM (
SELECT rid, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (
SELECT rid, regexp_extract_all(t, {_quoted(whole)}) AS ms, string_split_regex(t, {_quoted(whole)}) AS gaps FROM d WHERE regexp_matches(t, {_quoted(whole)}))))
WHERE length(m) >= {rule.least} AND {body} >= {rule.least_body}"""


_SPAN = "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k)"
_COUNTS = ", ".join(f"count(k) FILTER (kind = '{kind}') AS n_{kind}" for kind in secret_scan.BASE)
OP5 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_kind(k, rule) for k, rule in enumerate(secret_scan.RULES))})
SELECT doc_id, {_COUNTS}, sha256(coalesce({_SPAN} FILTER (k < {len(secret_scan.BASE)}), '')) AS base_sha256, coalesce({_SPAN}, '') AS spans
FROM d LEFT JOIN f USING (rid) GROUP BY rid, doc_id"""

ORACLES = {"op1_embedding_dedup": OP1, "op3_topk_bitsliced": OP3, "op5_secret_scan": OP5}
