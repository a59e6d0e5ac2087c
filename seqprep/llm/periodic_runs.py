"""Periodic runs of words by Kruskal's scheme over suffix classes in descending order of common prefixes.

Two suffixes of a text belong to one class at level l if they share their first l words. Neighbours of the suffix order
are united by decreasing common prefix with a union-find whose classes keep their positions in order. When positions i
and j become neighbours in a class at level l, their common prefix is exactly l and no position between them shares as
much: if j - i is at most l, words i … j + l - 1 have the smallest period j - i and end where it does, and they start a
run where the words before i and j differ.

Two exact tests keep most texts out of that scheme. A seed needs a repeated stretch of as many words as the shortest run
allows (its gram); a text without a repeated gram has no run. The positions of one gram can seed a run only if they are
near enough for the repetition that follows them and if the words before them are not all the same.

Texts are spread by the scan and no text meets another one, so copies and hot sources do not matter; memory is about 15
times the text. Results of odd input: a null text has no words and no runs, a null id is kept, repeated rows and ids give
a row each, an empty table no rows; extra columns of any name are left out.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqprep.llm.common import slices

CHUNK = 1024
SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Positions:
    """An ordered set of positions in sorted chunks, so an insertion moves a bounded number of them."""

    def __init__(self, first: int):
        self.chunks, self.heads, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for chunk in self.chunks:
            yield from chunk

    def insert(self, x: int) -> tuple[int | None, int | None]:
        """Add x; the positions before and after it."""
        at = max(bisect_right(self.heads, x) - 1, 0)
        chunk = self.chunks[at]
        i = bisect_right(chunk, x)
        before = chunk[i - 1] if i else None
        after = chunk[i] if i < len(chunk) else self.heads[at + 1] if at + 1 < len(self.heads) else None
        chunk.insert(i, x)
        if i == 0:
            self.heads[at] = x
        if len(chunk) > CHUNK:
            self.chunks[at : at + 1] = [chunk[: CHUNK // 2], chunk[CHUNK // 2 :]]
            self.heads[at : at + 1] = [chunk[0], chunk[CHUNK // 2]]
        self.size += 1
        return before, after


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and the place of each, by prefix doubling over those still tied."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    first = np.ones(n, bool)
    first[1:] = sorted_ids[1:] != sorted_ids[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    slots, k = np.arange(n), 1
    while True:
        # a suffix is alone if it starts a group and the next one starts another
        alone = first & np.append(first[1:], True)
        slots, first = slots[~alone], first[~alone]
        if not len(slots):
            return order, rank
        at = order[slots]
        follow = np.full(len(at), -1, np.int64)
        inside = at + k < n
        follow[inside] = rank[at[inside] + k]
        key = rank[at] * (n + 1) + follow + 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        first = np.ones(len(at), bool)
        first[1:] = key[1:] != key[:-1]
        rank[at] = slots[np.flatnonzero(first)][np.cumsum(first) - 1]
        k *= 2


def common_prefixes(ids: np.ndarray, order: np.ndarray, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes ``at`` (ascending) with those before them in the order, each scan going on from the last one."""
    words, n = ids.tolist(), len(ids)
    place = rank[at]
    other = np.where(place > 0, order[place - 1], -1).tolist()
    out, h, last = [], 0, -2
    for i, j in zip(at.tolist(), other):
        h = h - 1 if i == last + 1 and h else 0
        last = i
        if j < 0:
            h = 0
        else:
            top = n - max(i, j)
            while h < top and words[i + h] == words[j + h]:
                h += 1
        out.append(h)
    return np.array(out, np.int64)


def shortest_prefix(least: int, power: int) -> int:
    """The smallest common prefix of a run's first two periods, over all periods."""
    return min(max(least - q, (power - 1) * q) for q in range(1, least + 1))


def find_runs(ids: np.ndarray, least: int = 6, power: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of at least ``least`` words and ``power`` (2 or more) periods, by start and period."""
    n, gram = len(ids), shortest_prefix(least, power)
    if n < least:
        return []
    ids = ids.astype(np.int64)
    # equal grams have equal keys; unequal ones that share a key only cost time
    with np.errstate(over="ignore"):
        key = np.zeros(n - gram + 1, np.uint64)
        for k in range(gram):
            key = (key ^ ids[k : n - gram + 1 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    by = np.argsort(key, kind="stable")
    sorted_key = key[by]
    same = sorted_key[1:] == sorted_key[:-1]
    if not same.any():
        return []
    in_group = np.append(False, same) | np.append(same, False)
    at = by[in_group]
    fresh = ~np.append(False, same)[in_group]
    start = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    repeated = np.zeros(len(key) + 1, bool)
    repeated[at] = True
    # words from a position to the end of the repeated grams that follow it: no common prefix is longer
    ends = np.flatnonzero(~repeated)
    reach = ends[np.searchsorted(ends, at)] - at + gram - 1
    gap = np.full(len(at), n)
    gap[1:] = np.where(fresh[1:], n, at[1:] - at[:-1])
    near = np.maximum.reduceat(reach, start) >= (power - 1) * np.minimum.reduceat(gap, start)
    previous = np.where(at > 0, ids[at - 1], -1)
    varied = np.maximum.reduceat(previous, start) != np.minimum.reduceat(previous, start)
    open_ = (near & varied)[group]
    if not open_.any():
        return []
    order, rank = suffix_order(ids)
    at_sorted = np.sort(at)
    prefix = common_prefixes(ids, order, rank, at_sorted)
    wanted = np.zeros(n, bool)
    wanted[at[open_]] = True
    edge = (prefix >= gram) & wanted[at_sorted]
    b, level = at_sorted[edge], prefix[edge]
    down = np.argsort(-level, kind="stable")
    b, level = b[down], level[down]
    return sorted(_unite(ids.tolist(), order[rank[b] - 1].tolist(), b.tolist(), level.tolist(), least, power))


def _unite(words: list, lefts: list, rights: list, levels: list, least: int, power: int) -> list[tuple[int, int, int]]:
    """Union-find over the edges by descending level; runs from positions that become neighbours."""
    parent: dict[int, int] = {}
    members: dict[int, Positions] = {}
    runs = []

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def seed(i: int, j: int, level: int) -> None:
        q = j - i
        if (power - 1) * q <= level and q + level >= least and (i == 0 or words[i - 1] != words[j - 1]):
            runs.append((i, q + level, q))

    for x, y, level in zip(lefts, rights, levels):
        a, b = root(x), root(y)
        large, small = members.pop(a, None) or Positions(a), members.pop(b, None) or Positions(b)
        if large.size < small.size:
            a, b, large, small = b, a, small, large
        last, coming = None, list(small)
        for i, p in enumerate(coming):
            before, after = large.insert(p)
            # neighbours that come from the same class are old ones
            if before is not None and before != last:
                seed(before, p, level)
            if after is not None and (i + 1 == len(coming) or coming[i + 1] > after):
                seed(p, after, level)
            last = p
        parent[b] = a
        members[a] = large
    return runs


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds behind its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


def word_ids(words: list) -> np.ndarray:
    known: dict = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 6, power: int = 4) -> DataFrame:
    """(doc_id, runs, collapsed) per row: its runs of words by start and period, and its words joined by spaces with each run cut to one period.

    Words are runs of bytes other than space and 0x09-0x0D.
    """
    x = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    schema = f"id {x.schema['id'].dataType.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found, kept = [], []
            for value in batch.column("text"):
                # bytes.split without an argument splits at exactly these six bytes
                words = value.as_buffer().to_pybytes().split() if value.is_valid else []
                runs = find_runs(word_ids(words), least, power) if len(words) >= least else []
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                kept.append(b" ".join(collapse(words, runs)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(found, pa.list_(SPAN)), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "runs", "collapsed"]
            )

    return x.mapInArrow(work, schema).withColumnRenamed("id", doc_id)
