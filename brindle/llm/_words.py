"""Words of a text and 64-bit hashes of them, as numpy arrays, a document at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Odd multipliers for hashes of word sequences.
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHash(dict):
    """xxh3 of a word, remembered for the first `limit` distinct words of a task."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def blank_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then the runs of bytes other than the six ASCII blanks."""
    return text.encode().lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which near values come far apart."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words; with fewer words one of the whole sequence, with none none."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
        for i in range(width):
            out = mix(out * STEP + hashes[i : n - width + 1 + i])
    return out


def rows(batches: Iterator[pa.RecordBatch], *columns: str, size: int = 256) -> Iterator[list[tuple]]:
    """Lists of up to `size` rows, so that few texts are Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield list(zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns), strict=True))
