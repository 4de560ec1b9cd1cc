"""Splitting texts for byte-level BPE vocabularies, with caches of whole space-delimited chunks.

The GPT-2 style pattern never joins characters across a single space other than by taking that
space as a prefix, so a text without runs of white space falls apart at its spaces into chunks
that encode alone. Each chunk's result is remembered by its string (bounded caches). Texts with
characters outside PLAIN, whose letter and space classes might differ between libraries, and
texts with white-space runs go through the general routines.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

#: Characters on whose classes (letter, digit, space, other) all libraries used here agree.
PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_RUN = re.compile(r"\s\s")


def is_plain(text: str) -> bool:
    return PLAIN.fullmatch(text) is not None


def has_space_run(text: str) -> bool:
    return _RUN.search(text) is not None


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others take the code points from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in set(printable) else chr(next(spare)) for b in range(256)}


class BoundedCache(dict):
    """A memo of make(key) for the first limit keys: frequent keys come early, so they are kept."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.limit:
            self[key] = value
        return value


#: One-character suffixes that the pattern splits from a word before them.
ENDS = frozenset(".,!?;:)\"|")


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def vocabulary_bytes(spec: dict) -> dict[bytes, int]:
    """Byte strings and ids of a byte-level BPE file without word-end suffixes."""
    back = {c: b for b, c in byte_letters().items()}
    return {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items()}


def special_tokens(spec: dict) -> dict[str, int]:
    return {t["content"]: t["id"] for t in spec["added_tokens"]}


def split_specials(text: str, specials: dict[str, int]) -> list[str | int]:
    """The text as ordinary pieces (str) and ids of special strings (int), leftmost first."""
    found = [s for s in specials if s in text]
    if not found:
        return [text]
    parts = re.split("(" + "|".join(map(re.escape, sorted(found, key=len, reverse=True))) + ")", text)
    return [specials[p] if k % 2 else p for k, p in enumerate(parts) if k % 2 or p]
