"""Personal data by aggregated weak supervision, in DataFrame functions only.

Regular expressions propose candidate spans. Four labelers vote on each candidate (yes, no or
abstain): a strict check of its form, a gazetteer, the words before it, and its edges. Votes are
counted per kind and vote pattern over all documents, a table of bounded size; on it,
expectation-maximisation estimates how reliable each labeler is without any truth. The resulting
soft labels train a logistic span classifier over votes, kind and length, which decides on the
candidates of the further kinds. Spans of the four base kinds that pass their check always stay.

Offsets come from splitting a text at the same matches: a match begins after the lengths of all
gaps and matches before it, added up by runs of RUN matches and then within each run. What the
labelers see around a match comes from the gaps beside it, so the text is never searched from its
start again. Patterns use possessive quantifiers and start only where a run starts (or where the
match before ended), so long runs take linear time and no stack.

Edge cases: a null or empty text has no spans; repeated rows are scanned each; an empty table
gives no rows (and an untrained classifier that accepts nothing); other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtide.llm.common import checkpointed, documents


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a cheap pattern without which the text has no match
    cues: str  # words before it that speak for this kind
    base: bool = False


_MAIL = "A-Za-z0-9._%+-"
KINDS = (
    Kind("email", rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", r"mail|contact|write|reach|send", True),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", r"[0-9]\.[0-9]", r"\bip\b|host|server|address|login|from", True),
    Kind("card", r"[0-9](?:[ -]?+[0-9])++", r"[0-9](?:[ -]?[0-9]){13}", r"card|visa|master|credit|pay", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", r"phone|tel|call|mobile|cell|fax|whatsapp", True),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]", r"ssn|social|security|tax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", r"iban|account|konto|bank|transfer|cuenta|compte"),
    Kind("tel", r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", r"[0-9]{3}[ .-][0-9]{4}", r"phone|tel|call|mobile|cell|fax|whatsapp"),
    Kind("name", r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Madame|Monsieur)\.? \p{Lu}\p{L}++(?: \p{Lu}\p{L}++)?+", r"Mr|Ms|Dr|Prof|Herr|Frau|Señor|Madame|Monsieur", r"dear|regards|name|signed|from|by|contact"),
)
BASE = tuple(k.name for k in KINDS if k.base)
#: Characters before a span, back to the span of its kind before it, that the context labeler sees.
CONTEXT = 32
#: Matches whose lengths are added up at once.
RUN = 64
# Public prefixes and names that the gazetteer labeler knows.
TOP_DOMAINS = "com org net edu gov io de fr es it uk eu info biz co us ca au jp cn in br mx nl ch at be se no pl ru example"
FIRST_NAMES = "Anna Maria John James Mary Robert Michael David Linda Thomas Peter Paul Laura Julia Marie Pierre Jean Claire Hans Klaus Petra Sabine Carlos José Luis Carmen Ana Juan Elena Sofia Daniel Martin Sarah Emma Lucas Hugo Louis Max Felix Lena"
CARD_ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
DIAL_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
PRIVATE_IPS = r"^(?:0\.|10\.|127\.|192\.168\.|169\.254\.|22[4-9]\.|23[0-9]\.|24[0-9]\.|25[0-5]\.)"
IBAN_COUNTRIES = "^(?:AT|BE|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM)"
#: What EM starts from, and holds on to as if PRIOR_WEIGHT candidates had shown it: how often each labeler
#: (form, gazetteer, words before, edges) says yes to personal data, and to what is none.
PRIORS, PRIOR_WEIGHT = ((0.95, 0.1), (0.8, 0.2), (0.7, 0.1), (0.9, 0.6)), 10.0
LABELERS = len(PRIORS)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    at = lambda i: F.substr(digits, i, F.lit(1)).cast("int")
    value = lambda i: F.when((n - i) % 2 == 1, F.when(at(i) > 4, at(i) * 2 - 9).otherwise(at(i) * 2)).otherwise(at(i))
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + value(i))
    return F.when(n > 0, total % 10 == 0).otherwise(False)


def passes(kind: Column, match: Column) -> Column:
    """The check of a match of a base kind; other kinds have none."""
    digits = _digits(match)
    part = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.concat(F.lit("0"), F.right(F.regexp_replace(p, "^0+", ""), F.lit(3))).cast("int") <= 255)
    card = F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    return F.when(kind == 1, F.forall(F.split(match, r"\."), part)).when(kind == 2, card).when(kind == 3, F.length(digits).between(10, 15)).otherwise(True)


def _found(text: Column, k: int) -> Column:
    kind = KINDS[k]
    return F.when(text.rlike(kind.needs), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _parts(text: Column, found: Column, k: int) -> Column:
    """Array of the matches of kind k: m, the gaps g before and h behind it, and the matches beside it."""
    gaps, none, n = F.split(text, KINDS[k].pattern, -1), F.array(F.lit("")), F.size(found)
    before, behind = F.concat(none, F.slice(found, 1, n - 1)), F.concat(F.slice(found, 2, n), none)
    parts = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))  # and the gap after the last match
    more = F.arrays_zip(F.slice(parts, 1, n).alias("p"), F.slice(parts, 2, n).alias("q"), before.alias("last"), behind.alias("next"))
    return F.when(n > 0, F.transform(more, lambda p: F.struct(p["p"]["m"].alias("m"), p["p"]["g"].alias("g"), p["q"]["g"].alias("h"), p["last"].alias("last"), p["next"].alias("next"))))


def _placed(parts: Column, k: int) -> Column:
    """Array of (start, k, end, m, before, left, right) from _parts': offsets are 0-based code points, before is
    up to CONTEXT characters of the gap, left and right are the characters beside the match, empty at the text's ends."""
    length = lambda p: F.length(p["g"]) + F.length(p["m"])
    runs = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(parts) - 1, F.lit(RUN)).cast("int")), lambda r: F.slice(parts, r * RUN + 1, RUN))
    sizes = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda n, p: n + length(p)))
    nothing = F.array().cast("array<int>")
    begins = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), nothing.alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
    empty = F.array().cast("array<struct<start:int,k:int,end:int,m:string,before:string,left:string,right:string>>")
    either = lambda near, far, end: F.when(near == "", end(far, 1)).otherwise(end(near, 1))
    tail = lambda c, n: F.right(c, F.lit(n))
    head = lambda c, n: F.left(c, F.lit(n))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["g"])
        end = start + F.length(p["m"])
        placed = F.struct(start.alias("start"), F.lit(k).alias("k"), end.alias("end"), p["m"].alias("m"), tail(p["g"], CONTEXT).alias("before"), either(p["g"], p["last"], tail).alias("left"), either(p["h"], p["next"], head).alias("right"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(placed)).alias("out"))

    listed = F.transform(F.arrays_zip(runs.alias("run"), begins.alias("at")), lambda r: F.aggregate(r["run"], F.struct(r["at"].alias("at"), empty.alias("out")), step)["out"])
    return F.when(parts.isNull(), empty).otherwise(F.flatten(listed))


def _votes(c: Column) -> list[Column]:
    """Each labeler's vote on candidate c: 1 yes, 0 no, -1 abstains."""
    k, m = c["k"], c["m"]
    digits = _digits(m)
    yes = lambda test, otherwise=0: F.when(test, 1).otherwise(otherwise)
    strict = (
        F.when(k == 0, yes(m.rlike(r"@.*\.[A-Za-z]{2,24}$") & ~m.rlike(r"\.\.|^\.")))
        .when(k <= 3, yes(passes(k, m)))
        .when(k == 4, yes(~m.rlike(r"^(?:000|666|9)|-00-|-0000$")))
        .when(k == 5, yes(F.length(F.regexp_replace(m, " ", "")).between(15, 34)))
        .when(k == 6, yes(m.rlike(r"^\(?[2-9][0-9]{2}\)?[ .-][2-9]")))
        .otherwise(yes(m.rlike(r" \p{Lu}\p{L}+ \p{Lu}\p{L}+$"), -1))
    )
    listed = "^(?:" + "|".join(TOP_DOMAINS.split()) + ")$"
    names = r" (?:" + "|".join(FIRST_NAMES.split()) + r")\b"
    gazetteer = (
        F.when(k == 0, yes(F.lower(F.regexp_extract(m, r"\.([A-Za-z]+)$", 1)).rlike(listed), -1))
        .when(k == 1, F.when(m.rlike(PRIVATE_IPS), 0).otherwise(-1))
        .when(k == 2, yes(digits.rlike(CARD_ISSUERS)))
        .when(k == 3, yes(m.rlike(DIAL_CODES)))
        .when(k == 5, yes(m.rlike(IBAN_COUNTRIES)))
        .when(k == 7, yes(m.rlike(names), -1))
        .otherwise(-1)
    )
    before = F.lower(c["before"])
    cue = F.lit(False)
    for i, kind in enumerate(KINDS):
        cue = F.when(k == i, before.rlike(kind.cues)).otherwise(cue)
    context = yes(cue, -1)
    edges = yes(~c["left"].rlike(r"[\p{L}0-9_]") & ~c["right"].rlike(r"[\p{L}0-9_]"))
    return [v.cast("int") for v in (strict, gazetteer, context, edges)]


def candidates(df: DataFrame) -> DataFrame:
    """doc_id and found: array of (start, k, end, m, ok, v0..v3, size) for each row of df (doc_id, text)."""

    def judged(c: Column) -> Column:
        votes = [v.alias(f"v{i}") for i, v in enumerate(_votes(c))]
        size = F.least(F.floor(F.length(c["m"]) / 8), F.lit(4)).cast("int").alias("size")
        return F.struct(c["start"].alias("start"), c["k"].alias("k"), c["end"].alias("end"), c["m"].alias("m"), passes(c["k"], c["m"]).alias("ok"), *votes, size)

    kinds = range(len(KINDS))
    # Each step is a projection of its own, so that no pattern is matched twice.
    found = documents(df).select("doc_id", "text", *(_found(F.col("text"), k).alias(f"f{k}") for k in kinds))
    parts = found.select("doc_id", *(_parts(F.col("text"), F.col(f"f{k}"), k).alias(f"p{k}") for k in kinds))
    placed = parts.select("doc_id", *(_placed(F.col(f"p{k}"), k).alias(f"m{k}") for k in kinds))
    merged = placed.select("doc_id", F.concat(*(f"m{k}" for k in kinds)).alias("all"))
    short = F.filter("all", lambda c: (c["k"] != 2) | F.length(_digits(c["m"])).between(12, 22))  # plain numbers are no card candidates
    return merged.select("doc_id", F.transform(short, judged).alias("found"))


@dataclass(frozen=True)
class SpanModel:
    """weights by feature (see _features); reliabilities[labeler] = (hit rate, false alarm rate)."""

    weights: dict[str, float]
    reliabilities: list[tuple[float, float]]


def _features(k: int, votes: tuple[int, ...], size: int) -> list[str]:
    return ["bias", f"k{k}", f"size{size}", *(f"v{i}_{v}" for i, v in enumerate(votes) if v >= 0)]


def estimate(rows: list[tuple[int, tuple[int, ...], int, int]], rounds: int = 50) -> tuple[list[float], list[tuple[float, float]]]:
    """EM over (kind, votes, size, count): each row's probability of yes, and the labelers' rates."""
    rates = list(PRIORS)
    prior = {k: 0.5 for k, *_ in rows}
    post = [0.5] * len(rows)
    for _ in range(rounds):
        for r, (k, votes, _, _) in enumerate(rows):
            odds = math.log(prior[k] / (1 - prior[k]))
            for (hit, false), v in zip(rates, votes, strict=True):
                if v >= 0:
                    odds += math.log((hit if v else 1 - hit) / (false if v else 1 - false))
            post[r] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for k in prior:
            own = [(p, n) for p, (kk, _, _, n) in zip(post, rows, strict=True) if kk == k]
            prior[k] = (sum(p * n for p, n in own) + 1) / (sum(n for _, n in own) + 2)
        rates = []
        for i in range(LABELERS):
            yes = no = PRIOR_WEIGHT
            hit, false = PRIORS[i][0] * yes, PRIORS[i][1] * no
            for p, (_, votes, _, n) in zip(post, rows, strict=True):
                if votes[i] >= 0:
                    yes, no = yes + p * n, no + (1 - p) * n
                    hit, false = hit + p * n * votes[i], false + (1 - p) * n * votes[i]
            rates.append((min(hit / yes, 0.999), max(false / no, 0.001)))
    return post, rates


def train(found: DataFrame, rounds: int = 300) -> SpanModel:
    """Fits the span classifier to EM's soft labels. Vote patterns, at most 3**4 for each kind and size, come to the driver."""
    one = F.explode("found").alias("c")
    names = ["k", *(f"v{i}" for i in range(LABELERS)), "size"]
    table = found.select(one).select(*(F.col(f"c.{n}").alias(n) for n in names)).groupBy(*names).count()
    rows = sorted((r["k"], tuple(r[f"v{i}"] for i in range(LABELERS)), r["size"], r["count"]) for r in table.collect())
    if not rows:
        return SpanModel({"bias": -20.0}, list(PRIORS))
    post, rates = estimate(rows)
    names = sorted({f for k, v, s, _ in rows for f in _features(k, v, s)})
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for r, (k, v, s, _) in enumerate(rows):
        x[r, [place[f] for f in _features(k, v, s)]] = 1
    y, n = np.array(post), np.log1p(np.array([r[3] for r in rows], dtype=float))
    w = np.zeros(len(names))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 2.0 * (x.T @ (n * (p - y)) / n.sum() + 1e-4 * w)
    return SpanModel(dict(zip(names, w.tolist(), strict=True)), rates)


def probability(model: SpanModel, c: Column) -> Column:
    score = F.lit(model.weights.get("bias", 0.0))
    for name, w in model.weights.items():
        if name != "bias":
            field, _, value = name.partition("_") if name[0] == "v" else (name.rstrip("0123456789"), "", name.lstrip("kvsize"))
            score = score + F.when(c[field] == int(value), w).otherwise(0.0)
    return 1 / (1 + F.exp(-score))


def find(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id and spans: array of (start, k, end, kind, p, base) by start, then kind, for each row of df."""
    found = checkpointed(candidates(df))
    model = train(found)
    kinds = F.array(*(F.lit(k.name) for k in KINDS))
    last = len(BASE)
    keep = lambda c: F.when(c["k"] < last, c["ok"]).otherwise(probability(model, c) >= threshold)
    shape = lambda c: F.struct(c["start"].alias("start"), c["k"].alias("k"), c["end"].alias("end"), F.get(kinds, c["k"]).alias("kind"), probability(model, c).alias("p"), (c["k"] < last).alias("base"))
    return found.select("doc_id", F.sort_array(F.transform(F.filter("found", keep), shape)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
