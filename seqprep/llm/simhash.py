"""Near-duplicates by SimHash fingerprints and BK-trees.

A text's 64-bit fingerprint has a bit set where over half of its word shingles' hashes have it. Distinct fingerprints
are posted under each of ``radius + 1`` blocks of their bits: two that differ in at most ``radius`` bits are equal in
one block at least, so no link is lost. The fingerprints of a block value are cut into shards of at most about
``SHARD``; each shard's BK-tree (children keyed by their integer Hamming distance to the parent) is sent to the tasks of
its cells, and searched there, along the edges within the radius only, by the fingerprints of one shard. A cell gives
the links of a spanning forest, never all pairs, and components follow from all cells' links. A block value that holds
a third of all fingerprints becomes many cells, so no task holds an unbounded group.

Texts that are equal, or have equal fingerprints, meet as one fingerprint. Null text: no words, fingerprint zero.
Null key: the row takes part and is given its component's smallest key that is not null. Repeated rows: a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqprep.llm.bpe import _field
from seqprep.llm.common import free_names, written
from seqprep.llm.graph import components

SHARD = 2048
BITS = 64
LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of one text; bytes.split() cuts at space and 0x09-0x0D."""
    from xxhash import xxh64_intdigest as digest

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    if len(words) < size:
        return digest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = [digest(line[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, key: str, text: str, size: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp): the fingerprint of every whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), size, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=[key, "fp"])

    return df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, f"{_field(df, key)}, fp bigint")


class Tree:
    """A BK-tree of distinct integers."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        at, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while new:
            d = (self.values[at] ^ value).bit_count()
            if (child := self.children[at].get(d)) is None:
                self.children[at][d] = new
                break
            at = child
        return new

    def near(self, value: int, radius: int) -> Iterator[int]:
        """Places of the values within the radius."""
        stack, values, children = ([0] if self.values else []), self.values, self.children
        while stack:
            at = stack.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            if branch := children[at]:
                if len(branch) > 2 * radius:
                    for k in range(d - radius, d + radius + 1):
                        if k in branch:
                            stack.append(branch[k])
                else:
                    stack.extend(c for k, c in branch.items() if -radius <= k - d <= radius)


def forest(tree_values: list[int], queries: list[int], within: bool, radius: int) -> list[tuple[int, int]]:
    """Links that join what is near: among the tree's own values (``within``), or between them and the queries."""
    tree, parent, links = Tree(), list(range(len(tree_values) + len(queries))), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(me: int, value: int) -> int:
        """Link ``value`` to each group near it; the number of groups that it merged."""
        merged = 0
        for hit in tree.near(value, radius):
            a, b = find(me), find(hit)
            if a != b:
                parent[a] = b
                merged += 1
                links.append((value, tree.values[hit]))
                if within and merged == groups:
                    break
        return merged

    groups = 0
    for k, value in enumerate(tree_values):
        if within:
            groups += 1 - join(k, value)
        tree.add(value)
    for k, value in enumerate(queries):
        join(len(tree_values) + k, value)
    return links


def links(prints: DataFrame, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """(a, b): links of a spanning forest of the distinct fingerprints ``fp`` within ``radius`` bits of each other."""
    width = BITS // (radius + 1)
    block = [
        F.lit(k << 48).bitwiseOR(F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit((1 << width) - 1))) for k in range(radius + 1)
    ]
    posted = prints.select("fp", F.explode(F.array(*block)).alias("_block"))
    shards = posted.groupBy("_block").agg(F.ceil(F.count("*") / shard).cast("int").alias("_shards"), F.count("*").alias("_n")).where("_n > 1")
    mine = F.pmod(F.xxhash64("fp"), F.col("_shards")).cast("int")
    cells = (
        posted.join(shards.drop("_n"), "_block")
        .withColumn("_mine", mine)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)))
        .select("_block", F.least("_mine", "_other").alias("_s"), F.greatest("_mine", "_other").alias("_t"), (F.col("_mine") > F.col("_other")).alias("_asks"), "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(cell: tuple, tree: list[int], asks: list[int]) -> pa.RecordBatch:
            mask = (1 << BITS) - 1
            found = forest([v & mask for v in tree], [v & mask for v in asks], cell[1] == cell[2], radius)
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        cell, tree, asks = None, [], []
        for batch in batches:
            for *name, query, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if name != cell:
                    if len(tree) + len(asks) > 1:
                        yield solve(cell, tree, asks)
                    cell, tree, asks = name, [], []
                (asks if query else tree).append(fp)
        if len(tree) + len(asks) > 1:
            yield solve(cell, tree, asks)

    dealt = cells.repartition("_block", "_s", "_t").sortWithinPartitions("_block", "_s", "_t")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """One row per input row: (key, fp, component), the component being the smallest key reachable."""
    rows = written(fingerprints(df, key, text, size), "prints")
    prints = written(rows.groupBy("fp").agg(F.min(key).alias("_key")), "distinct")
    roots = components(links(prints.select("fp"), radius, shard))
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "_key", F.coalesce("root", "fp").alias("_root"))
    smallest = rooted.groupBy("_root").agg(F.min("_key").alias("component"))
    named = rooted.join(smallest, "_root").select("fp", "component")
    return rows.join(named, "fp").select(key, "fp", "component")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stand for their component: the smallest (key, text hash), and of equal rows one."""
    one, i, h = free_names(df, "_one", "_i", "_h")
    marked = df.withColumn(one, F.struct(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("i"), F.xxhash64(F.col(text)).alias("h")))
    groups = near_duplicates(marked.select(F.col(one).alias("_one"), F.col(text).alias("_body")), "_one", "_body", **options)
    first = groups.where(F.col("_one") == F.col("component")).select(F.col("_one.i").alias(i), F.col("_one.h").alias(h)).distinct()
    rows = marked.withColumns({i: F.col(f"{one}.i"), h: F.col(f"{one}.h")}).drop(one)
    return rows.join(first, [i, h]).dropDuplicates([i, h]).select(*[F.col(f"`{c}`") for c in df.columns])
