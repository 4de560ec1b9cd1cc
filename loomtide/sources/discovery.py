"""Finding inputs: recordings, bundles and training data sets on a file system."""

from __future__ import annotations

import os
from collections.abc import Iterable
from pathlib import Path

# Suffixes of recordings, and the tables that make a directory a bundle.
SUFFIXES = (".bag", ".mcap")
SYSTEM_TABLES = ("_metadata.parquet", "_topic_type_map.parquet")


def _files(paths: Iterable[str | Path]) -> Iterable[Path]:
    for p in map(Path, paths):
        if p.is_dir():
            for root, _, names in os.walk(p):
                yield from (Path(root, n) for n in names)
        elif p.exists():
            yield p
        else:
            raise FileNotFoundError(p)


def recordings(paths: Iterable[str | Path], kinds: Iterable[str] = SUFFIXES) -> list[str]:
    """Recording files under the paths, sorted, each once; backups (.orig.) are skipped."""
    kinds = tuple(kinds)
    return sorted({str(p) for p in _files(paths) if p.suffix in kinds and ".orig." not in p.name})


def is_bundle(path: str | Path) -> bool:
    return all(Path(path, "parquet", t).exists() for t in SYSTEM_TABLES) or all(Path(path, t).exists() for t in SYSTEM_TABLES)


def bundles(paths: Iterable[str | Path]) -> list[str]:
    """Bundle roots under the paths, sorted, each once."""
    found = set()
    for p in map(Path, paths):
        for root, dirs, _ in os.walk(p):
            if is_bundle(root):
                at = Path(root)
                found.add(str(at.parent if at.name == "parquet" else at))
                dirs.clear()
    return sorted(found)


def datasets(path: str | Path) -> list[str]:
    """Immediate children that hold meta/info.json, sorted: their order numbers the merged data set."""
    return sorted(str(p) for p in Path(path).iterdir() if (p / "meta" / "info.json").exists())
