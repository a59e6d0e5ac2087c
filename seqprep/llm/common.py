"""Helpers shared by the operators of this package: row keys, written tables, vectorised text spans in Arrow batches."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqprep.scratch import written

SLICE_BYTES = 2 << 20

__all__ = ["written", "free_names", "remainder", "slices", "Texts", "mix64", "table"]


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not have (whatever their case), made from the wanted ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices of about ``limit`` bytes of text; one longer text is a slice of its own."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        start, total = 0, 0
        for i, n in enumerate(size):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if batch.num_rows > start:
            yield batch.slice(start)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


_rng = random.Random(20240607)
BASE = _rng.getrandbits(64) | 1
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Powers:
    """Powers of the hash base and of its inverse, grown when a longer text comes."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            self.up, self.down = _powers(BASE, n), _powers(INVERSE, n)
        return self.up, self.down


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit polynomial hashes of values[start:end]; equal spans hash alike wherever they lie."""
    up, down = powers.get(len(values))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values + np.uint64(1)) * up[: len(values)], out=sums[1:])
        return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Texts:
    """The texts of an Arrow column as one byte buffer, with the spans of their words and lines.

    ``strip`` removes up to that many ASCII punctuation characters from either end of a word. Words are runs of bytes other than space and 0x09-0x0D; lines end at a line feed. A null is an empty text.
    """

    def __init__(self, column: pa.Array, powers: Powers, lower: bool = False, strip: int = 0):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
        self.off = (offsets - offsets[0]) if len(column) else np.zeros(1, np.int64)
        self.data = LOWER[data] if lower else data
        self.n, self.powers = len(column), powers
        size = len(self.data)
        first = np.zeros(size + 1, bool)
        first[self.off] = True
        self.first = first
        if strip and size:
            self.data = self.data.copy()
            for _ in range(strip):
                gap = SPACE[self.data]
                edge = first[1:] | np.append(gap[1:], True) | first[:-1] | np.insert(gap[:-1], 0, True)
                self.data[edge & PUNCTUATION[self.data]] = 0x20
        self.space = SPACE[self.data]
        solid = ~self.space
        before = np.ones(size, bool)
        before[1:] = self.space[:-1]
        after = np.ones(size, bool)
        after[:-1] = self.space[1:]
        self.word_start = np.flatnonzero(solid & (before | first[:size]))
        self.word_end = np.flatnonzero(solid & (after | first[1:])) + 1
        self.word_off = np.searchsorted(self.word_start, self.off)

    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.word_off))

    def word_hash(self, data: np.ndarray | None = None) -> np.ndarray:
        return span_hash((self.data if data is None else data).astype(np.uint64), self.word_start, self.word_end, self.powers)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every line; an empty text has one empty line."""
        feed = np.flatnonzero(self.data == 10)
        owner = np.searchsorted(self.off, feed, "right") - 1
        doc = np.concatenate([np.arange(self.n), owner])
        start, end = np.concatenate([self.off[:-1], feed + 1]), np.concatenate([self.off[1:], feed])
        start, end, doc = start[np.lexsort((start, doc))], end[np.lexsort((end, doc))], np.sort(doc)
        return start, end, doc

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte quantity over each text."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.off[1:]] - sums[self.off[:-1]]


def ngram_hash(hashes: np.ndarray, word_off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words within a text, and the place of each one's first word."""
    count = len(hashes)
    if count < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = np.zeros(count - n + 1, np.uint64)
        for k in range(n):
            out = mix64(out * np.uint64(BASE) + hashes[k : count - n + 1 + k])
    end = np.repeat(word_off[1:], np.diff(word_off))
    place = np.flatnonzero(np.arange(count - n + 1) + n <= end[: count - n + 1])
    return out[place], place
