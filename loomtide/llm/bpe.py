"""BPE encoding with a priority queue of merge ranks, and decoding by concatenation.

A word's symbols form a doubly linked list. Every adjacent pair that the merge list knows goes
into a heap by rank and position; the least entry is popped, skipped if one of its symbols has
changed since (a stale entry), and otherwise merged, which pushes the two new pairs. Decoding
looks up each id's vocabulary string and joins the strings, as the library does for a vocabulary
file without a decoder. Results of words and chunks are remembered per worker in bounded caches.

Edge cases: a null or empty text has 0 tokens and decodes to the empty text; special strings in
a text become their one id; repeated rows are encoded each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from loomtide.llm.common import documents, per_text
from loomtide.llm.tokenization import BoundedCache, byte_letters, is_plain, load, special_tokens, split_specials

CACHE = 400_000
#: The vocabulary's splitting pattern on plain characters, where [^\W\d_] are the letters.
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+")


class WordBPE:
    """Encodes one pre-token, given as byte letters, to ids; the last symbol carries the word-end suffix."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): k for k, (a, b) in enumerate(pairs)}

    def symbols(self, word: str) -> list[str]:
        if not word:
            return []
        sym: list[str | None] = list(word)
        sym[-1] += self.suffix
        n = len(sym)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.ranks
        heap = [(ranks[p], i, *p) for i in range(n - 1) if (p := (sym[i], sym[i + 1])) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if sym[i] != left or j < 0 or sym[j] != right:
                continue  # stale: one of the two has been merged since
            sym[i], sym[j] = left + right, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (p := (sym[i], sym[k])) in ranks:
                    heapq.heappush(heap, (ranks[p], i, *p))
            h = before[i]
            if h >= 0 and (p := (sym[h], sym[i])) in ranks:
                heapq.heappush(heap, (ranks[p], h, *p))
        return [s for s in sym if s is not None]

    def encode(self, word: str) -> list[int]:
        return [self.ids[s] for s in self.symbols(word)]


class TextBPE:
    """Whole texts to ids and back, for a vocabulary that lower-cases and drops white space."""

    def __init__(self, path: str, cache: int = CACHE):
        spec = load(path)
        self.path, self.specials, self._library = path, special_tokens(spec), None
        self.model = WordBPE(spec)
        self.strings = {i: s for s, i in self.model.ids.items()} | {i: s for s, i in self.specials.items()}
        self._letters = byte_letters()
        self._words = BoundedCache(lambda w: b" ".join(b"%d" % i for i in self.model.encode("".join(self._letters[b] for b in w.encode()))), cache)
        self._chunks = BoundedCache(lambda c: b" ".join(map(self._words.__getitem__, _PLAIN_WORDS.findall(c))), cache)
        self._decoded = BoundedCache(self._decode_run, cache)

    def ids(self, text: str) -> list[bytes]:
        """Runs of decimal ids joined by spaces; the runs in order make up the text's ids."""
        out: list[bytes] = []
        for part in split_specials(text, self.specials):
            if isinstance(part, int):
                out.append(b"%d" % part)
            elif is_plain(part):
                out += map(self._chunks.__getitem__, part.lower().split())
            else:
                out += self._any(part)
        return out

    def _any(self, text: str) -> list[bytes]:
        """Texts with unusual characters are normalised and split by the library."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        pieces = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [b" ".join(b"%d" % i for i in self.model.encode(w)) for w, _ in pieces]

    def _decode_run(self, run: bytes) -> str:
        return " ".join(self.strings[int(i)] for i in run.split())

    def decode(self, runs: list[bytes]) -> str:
        """The vocabulary strings of the ids, joined as the library joins them without a decoder."""
        return " ".join(map(self._decoded.__getitem__, runs))


@functools.lru_cache(maxsize=1)
def of_worker(path: str) -> TextBPE:
    """The worker's own coder, whose caches serve all of its tasks."""
    return TextBPE(path)


def encode_decode(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of df (doc_id, text)."""

    def make() -> Callable[[list[str]], list]:
        bpe = of_worker(path)

        def work(texts: list[str]) -> list:
            counts, ids, decoded = [], [], []
            for text in texts:
                runs = bpe.ids(text)
                joined = b" ".join(runs)
                counts.append(joined.count(b" ") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(runs).encode()).hexdigest())
            return [counts, ids, decoded]

        return work

    return per_text(documents(df), make, [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())], "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(df: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of each row of df: the operator's own output."""

    def make() -> Callable[[list[str]], list]:
        bpe = of_worker(path)
        return lambda texts: [[[int(i) for run in bpe.ids(t) for i in run.split()] for t in texts]]

    return per_text(documents(df), make, [("ids", pa.list_(pa.int32()))], "ids array<int>")


def decoded(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded (string) of each row of (doc_id, ids); null ids decode to the empty text."""
    from pyspark.sql import functions as F

    strings = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.array_join(F.col(ids_col).cast("array<string>"), " "), F.lit("")).alias("text"))

    def make() -> Callable[[list[str]], list]:
        bpe = of_worker(path)
        return lambda runs: [[bpe.decode([r.encode()]) if r else "" for r in runs]]

    return per_text(strings, make, [("decoded", pa.string())], "decoded string")
