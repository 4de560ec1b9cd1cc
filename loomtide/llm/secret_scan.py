"""Secret scans with one automaton for all rules.

All rules, reversed, are compiled into one minimal automaton that passes once over all bytes of a
batch of texts, from the last to the first (see automaton.scan): where it accepts, a match of a
rule begins. Each rule takes its leftmost such place, walks from there to the end of its longest
match (over the rules' forward automaton), and goes on behind it. So every byte is passed once,
and only bytes of matches are seen again, once for each rule that they match.

Matches do not overlap within a kind, and those that fail their rule's least length are dropped
but still take their place. Offsets are code points, ends exclusive.

Edge cases: a null or empty text has no spans; repeated rows are scanned each; an empty table
gives no rows; scan ignores other columns and redacted keeps them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.llm.automaton import Automaton, compile_rules, parse, reverse, scan
from loomtide.llm.common import documents, per_text, slices


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the least length of a match, or of what follows the pattern's head."""

    kind: str
    head: str
    body: str
    least_body: int = 0
    least: int = 0
    ignore_case: bool = False
    base: bool = False


# hex needs no least length beside its pattern: a shorter run holds no match, so dropping it changes nothing else.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]+", least_body=6, ignore_case=True, base=True),
    Rule("access", "AKIA", "[A-Z0-9]+", least=20, base=True),
    Rule("hex", "", "[0-9a-f]{24,}", base=True),
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]+", least_body=36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]+", least_body=10),
    Rule("google", "AIza", "[A-Za-z0-9_-]+", least_body=35),
    Rule("jwt", "eyJ", r"[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("pem", "-----BEGIN ", "[A-Z ]*PRIVATE KEY-----"),
    Rule("url", "[a-z]://[A-Za-z0-9._-]+:", "[A-Za-z0-9._%+!$-]+@[A-Za-z0-9.-]+", least_body=6),
)
BASE = tuple(r.kind for r in RULES if r.base)


@dataclass(frozen=True)
class Compiled:
    starts: Automaton  # of the reversed rules, beginning anywhere
    matches: Automaton  # of the rules, from where they begin
    heads: Automaton  # of their heads alone


@functools.lru_cache(maxsize=2)
def compiled(rules: tuple[Rule, ...] = RULES) -> Compiled:
    heads = [parse(r.head, r.ignore_case) for r in rules]
    whole = [("cat", [head, parse(r.body)]) for head, r in zip(heads, rules, strict=True)]
    return Compiled(compile_rules([reverse(t) for t in whole]), compile_rules(whole, anchored=True), compile_rules(heads, anchored=True))


Span = tuple[str, int, int]


def spans(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[Span]]:
    """(kind, start, end) of each text, by start, then in the order of the rules."""
    a = compiled(rules)
    raw = [t.encode() for t in texts]
    data = b"\xff".join(raw)  # a byte that no text holds ends every match
    starts = np.cumsum([0, *(len(b) + 1 for b in raw)])
    back, states = scan(a.starts, np.frombuffer(data, dtype=np.uint8)[::-1])
    at = len(data) - 1 - back[::-1]
    found: list[list[Span]] = [[] for _ in texts]
    if not len(at):
        return found
    masks = np.array(a.starts.accepts, dtype=np.int64)[states[::-1]]
    hits: list[tuple[int, int, int]] = []
    for k, rule in enumerate(rules):
        own = at[masks >> k & 1 > 0]
        i, done = 0, 0
        while (i := int(np.searchsorted(own, done))) < len(own):
            start = int(own[i])
            done = a.matches.longest(data, start, k)
            body = a.heads.longest(data, start, k) if rule.least_body else start
            if done - body >= rule.least_body and done - start >= rule.least:
                hits.append((start, k, done))
    hits.sort()
    docs = np.searchsorted(starts, [s for s, _, _ in hits], side="right") - 1
    points: dict[int, np.ndarray] = {}
    for doc, (start, k, end) in zip(docs.tolist(), hits, strict=True):
        if doc not in points:
            points = {doc: np.concatenate([[0], np.cumsum((np.frombuffer(raw[doc], dtype=np.uint8) & 0xC0) != 0x80)])}
        base = int(starts[doc])
        found[doc].append((rules[k].kind, int(points[doc][start - base]), int(points[doc][end - base])))
    return found


def redact(text: str, found: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each maximal overlap of spans replaced by the mark."""
    out, at = [], 0
    for _, start, end in sorted(found, key=lambda s: s[1:]):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_texts(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (array of kind, start, end) for each row of df (doc_id, text)."""

    def make() -> Callable[[list[str]], list]:
        compiled(rules)
        return lambda texts: [[[{"kind": k, "start": s, "end": e} for k, s, e in found] for found in spans(texts, rules)]]

    return per_text(documents(df), make, [("spans", SPAN)], "spans array<struct<kind:string,start:long,end:long>>")


def redacted(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with the spans of its text column replaced by mark; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                k = part.schema.get_field_index(text_col)
                texts = part.column(k).to_pylist()
                new = [t if t is None or not s else redact(t, s, mark) for t, s in zip(texts, spans([t or "" for t in texts], rules), strict=True)]
                yield part.set_column(k, part.schema.field(k), pa.array(new, part.schema.field(k).type))

    return df.mapInArrow(run, df.schema)


def joined(spans_col, kinds: tuple[str, ...] | None = None):
    """kind:start:end of the spans (of those kinds), comma-joined, as a column."""
    chosen = F.filter(spans_col, lambda s: s["kind"].isin(*kinds)) if kinds else spans_col
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
