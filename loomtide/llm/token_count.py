"""Token counts of whole texts, with a whole-token shortcut.

Most pre-tokens of a text are themselves vocabulary strings. Not every vocabulary string is
reached by merging, though, so the strings that do encode alone as one token are proved once, on
the driver, by merging each of them byte by byte. While counting, a pre-token in that set counts
as one; only the rest is merged. Counts of space-delimited chunks are remembered per worker, in
a cache of bounded size.

Edge cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; an
empty table gives no rows; other columns are ignored. Special strings inside a text count as
one token each, as the tokenizers library takes them by default.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.llm.common import documents, per_text
from loomtide.llm.tokenization import ENDS, BoundedCache, byte_letters, has_space_run, is_plain, load, special_tokens, split_specials, vocabulary_bytes

LIMIT = 1024
CACHE = 1_000_000
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def merged(piece: bytes, ranks: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """The piece after all merges, always the pair of least rank first, leftmost among equals."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get((parts[i], parts[i + 1]), 1 << 60))
        if (parts[best], parts[best + 1]) not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


def merge_ranks(spec: dict) -> dict[tuple[bytes, bytes], int]:
    back = {c: b for b, c in byte_letters().items()}
    as_bytes = lambda s: bytes(back[c] for c in s)
    pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
    return {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(pairs)}


@functools.lru_cache(maxsize=4)
def proven_tokens(path: str) -> frozenset[bytes]:
    """The vocabulary strings that, as a pre-token of their own, become exactly one token."""
    spec = load(path)
    ranks = merge_ranks(spec)
    return frozenset(t for t in vocabulary_bytes(spec) if len(merged(t, ranks)) == 1)


class Counter:
    """Counts the tokens of a text."""

    def __init__(self, path: str, proven: frozenset[bytes], cache: int = CACHE):
        import regex
        import tiktoken

        spec = load(path)
        self.path, self.specials, self._library = path, special_tokens(spec), None
        self._proven, self._words = proven, frozenset(t.decode() for t in proven if t.isascii() or _decodes(t))
        vocabulary = vocabulary_bytes(spec)
        self._merge = tiktoken.Encoding("rest", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={})._core_bpe.encode_single_piece
        unproven = [t for t in vocabulary if t not in proven]
        ranks = merge_ranks(spec) if unproven else {}
        self._counted = {t: len(merged(t, ranks)) for t in unproven}
        self._split = regex.compile(PATTERN).findall
        self._bytes = {c: b for b, c in byte_letters().items()}
        self._chunks = BoundedCache(self._chunk, cache)

    def __call__(self, text: str) -> int:
        parts = split_specials(text, self.specials)
        return sum(1 if isinstance(p, int) else self._plain(p) if is_plain(p) else self._any(p) for p in parts)

    def _rest(self, piece: bytes) -> int:
        return self._counted.get(piece) or len(self._merge(piece))

    def _pre_token(self, s: str) -> int:
        return 1 if s in self._words else self._rest(s.encode())

    def _chunk(self, part: str) -> int:
        """Tokens of a space and part, which holds no space."""
        if part.isalpha():
            return self._pre_token(" " + part)
        if part[-1:] in ENDS and part[:-1].isalpha():
            return self._chunks[part[:-1]] + 1
        return sum(map(self._pre_token, self._split(" " + part)))

    def _plain(self, text: str) -> int:
        if has_space_run(text):
            return sum(map(self._pre_token, self._split(text)))
        first, *rest = text.split(" ")
        return sum(map(self._pre_token, self._split(first))) + sum(map(self._chunks.__getitem__, rest))

    def _any(self, text: str) -> int:
        """Texts with unusual characters: the library's own pre-tokens, counted the same way."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        pieces = (bytes(self._bytes[c] for c in s) for s, _ in self._library.pre_tokenize_str(text))
        return sum(1 if p in self._proven else self._rest(p) for p in pieces)


def _decodes(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


@functools.lru_cache(maxsize=1)
def of_worker(path: str, proven: frozenset[bytes]) -> Counter:
    """The worker's own counter, whose caches serve all of its tasks."""
    return Counter(path, proven)


def token_counts(df: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of df (doc_id, text)."""
    proven = proven_tokens(path)

    def make() -> Callable[[list[str]], list]:
        count = of_worker(path, proven)
        return lambda texts: [[len(t.encode()) for t in texts], [count(t) for t in texts]]

    counts = per_text(documents(df), make, [("n_bytes", pa.int64()), ("n_tokens", pa.int64())], "n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
