"""Spelling variants: exact neighbours at one edit, by pairs of trie nodes.

The words in code-point order are the leaves of a trie, and so are the reversed words. A node is numbered by the first
word below it and its depth. A word then stands under integer pairs (prefix node, suffix node): one per character that
the pair skips, one per gap between its characters. Words that share a skipping pair differ in that one character; the
word of a gap is the word of the skip with one character less. Of equal characters in a row only the first skip meets a
gap, so every pair of neighbours is found once.

Words that share a pair differ in one character, so a group has at most as many rows as the alphabet has letters; a group
yields each member's number of neighbours and its best one, never pairs. Nodes are numbered in blocks of the order; the
driver sees the first and last word of each block, which is all that neighbouring blocks must agree on. Long words cost
what their length is, as no prefix is ever copied.

Results of odd input: null texts and null words give nothing, empty words are neighbours of words of one letter, equal
words of a count table are added up, ties go to the smaller word, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqprep.llm.common import slices, written
from seqprep.operators.blocks import position

BLOCK = 1 << 16
GAP, SKIP, FIRST_SKIP = 0, 1, 2


def count_words(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: str = "A-Za-zÀ-ÿ", least: int = 1, change: Callable[[object, str], str] | None = None
) -> DataFrame:
    """(word, n) of the runs of ``letters``, A-Z in lower case, of at least ``least`` code points.

    ``change(doc_id, run)`` may rewrite a run first, but not make it longer. Counts are added up per slice of texts before the shuffle.
    """
    x = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    pattern = re.compile(f"[{letters}]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            total: Counter = Counter()
            for key, value in zip(batch.column("id").to_pylist(), batch.column("text")):
                if not value.is_valid:
                    continue
                # bytes.lower changes A-Z alone
                runs = pattern.findall(value.as_buffer().to_pybytes().lower().decode())
                if change is None:
                    total.update(runs)
                    continue
                for run, n in Counter(runs).items():
                    word = change(key, run)
                    if len(word) >= least:
                        total[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    return x.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def number_nodes(words: DataFrame, word: str, key: str, place: str, width: int, block: int = BLOCK) -> DataFrame:
    """(key, nodes) per word: its trie node at every depth from the root, as ``place of the node's first word * width + depth``.

    ``place`` numbers the words in code-point order from 0. A node that lies across blocks takes the first word after
    the first block edge it crosses instead, which both sides know.
    """
    x = words.select(F.col(key).alias("key"), F.col(place).alias("place"), F.col(word).alias("word"), F.expr(f"{place} div {block}").alias("blk"))
    ends = x.groupBy("blk").agg(F.min_by("word", "place").alias("first"), F.max_by("word", "place").alias("last")).orderBy("blk").collect()
    # per block: the anchors along the prefix that it shares with the block before it, and the prefix shared with the next one
    across, anchors, before = {}, [], None
    for at, row in enumerate(ends):
        shared = row["first"][: _shared(row["first"], ends[at - 1]["last"])] if at else ""
        if at:
            common = _shared(shared, before)
            anchors = anchors[:common] + [row["blk"] * block] * (len(shared) - common)
            across[ends[at - 1]["blk"]][1] = shared
        across[row["blk"]] = [list(anchors), ""]
        before = shared

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blk, last, path = None, "", []
        for batch in batches:
            flat, offsets, places = [], [0], batch.column("place").to_pylist()
            for home, here, w in zip(batch.column("blk").to_pylist(), places, batch.column("word").to_pylist()):
                if home != blk:
                    blk, (path, edge) = home, across[home]
                    common = len(path)
                else:
                    common = _shared(last, w)
                fresh = [here] * (len(w) - common)
                crossing = _shared(w, edge)
                if crossing > common:
                    fresh[: crossing - common] = [(home + 1) * block] * (crossing - common)
                path = path[:common] + fresh
                flat.append(0)
                flat.extend(path)
                offsets.append(len(flat))
                last = w
            offsets = np.array(offsets)
            depth = np.arange(len(flat)) - np.repeat(offsets[:-1], np.diff(offsets))
            nodes = np.array(flat, np.int64) * width + depth
            nodes[offsets[:-1]] = 0
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(nodes))], names=["key", "nodes"])

    parts = x.repartition("blk").sortWithinPartitions("blk", "place")
    return parts.mapInArrow(scan, "key long, nodes array<long>")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(prefix, suffix, id, n, kind) for every skip and every gap of a word."""
    for batch in batches:
        forward, backward = batch.column("forward"), batch.column("backward")
        flat_f, flat_b = forward.flatten().to_numpy(), backward.flatten().to_numpy()
        size = forward.value_lengths().to_numpy().astype(np.int64)
        off = np.append(0, np.cumsum(size))
        row = np.repeat(np.arange(len(size)), size)
        depth = np.arange(off[-1]) - off[row]
        codes = np.frombuffer("\n".join(["", *batch.column("word").to_pylist()]).encode("utf-32-le"), np.uint32)
        # codes has one separator before each word, so place off[row] + depth is the character before the gap
        ids, counts = batch.column("id").to_numpy(), batch.column("n").to_numpy()
        gap = (flat_f, flat_b[off[row] + size[row] - 1 - depth], row, np.full(len(row), GAP, np.int8))
        at = np.flatnonzero(depth < size[row] - 1)
        first = (depth[at] == 0) | (codes[at + 1] != codes[at])
        skip = (flat_f[at], flat_b[off[row[at]] + size[row[at]] - 2 - depth[at]], row[at], np.where(first, FIRST_SKIP, SKIP).astype(np.int8))
        prefix, suffix, owner, kind = (np.concatenate(c) for c in zip(gap, skip))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (prefix, suffix, ids[owner], counts[owner], kind)], names=["prefix", "suffix", "id", "n", "kind"])


def _meet(batches: Iterator[pa.RecordBatch], ratio: int) -> Iterator[pa.RecordBatch]:
    """(id, near, best_n, best) from rows sorted by pair; the last group of a batch waits for the next one."""
    held = None
    for batch in batches:
        rows = [c.to_numpy() for c in batch.columns]
        if held is not None:
            rows = [np.concatenate(c) for c in zip(held, rows)]
        if not len(rows[0]):
            continue
        last = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1])).max(initial=-1)) + 1
        held = [c[last:] for c in rows]
        yield _neighbours([c[:last] for c in rows], ratio)
    if held is not None:
        yield _neighbours(held, ratio)


def _neighbours(rows: list[np.ndarray], ratio: int) -> pa.RecordBatch:
    prefix, suffix, ids, n, kind = rows
    new = np.ones(len(ids), bool)
    new[1:] = (prefix[1:] != prefix[:-1]) | (suffix[1:] != suffix[:-1])
    group = np.cumsum(new) - 1
    several = np.bincount(group, minlength=1)[group] > 1 if len(ids) else np.zeros(0, bool)
    ids, n, kind, group = ids[several], n[several], kind[several], group[several]
    # within a group: the gap last, others by falling count and rising word
    by = np.lexsort((ids, -n, kind == GAP, group))
    ids, n, kind, group = ids[by], n[by], kind[by], group[by]
    out = []

    def best(where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Groups, first row and size of the rows picked."""
        at = np.flatnonzero(where)
        head = np.ones(len(at), bool)
        head[1:] = group[at[1:]] != group[at[:-1]]
        return at, head, np.flatnonzero(head)

    # replaced characters: the best other one is the first of the group, or the second for the first itself
    at, head, heads = best(kind != GAP)
    size = np.diff(np.append(heads, len(at)))
    span = np.repeat(np.arange(len(heads)), size)
    pair = size[span] > 1
    top = heads[span] + head
    at_pair = at[pair]
    out.append((ids[at_pair], size[span][pair] - 1, n[at[top[pair]]], ids[at[top[pair]]], n[at_pair]))
    # inserted and deleted characters
    gaps = np.flatnonzero(kind == GAP)
    at, head, heads = best(kind == FIRST_SKIP)
    if len(gaps) and len(at):
        found = np.searchsorted(group[gaps], group[at])
        has = (found < len(gaps)) & (group[gaps[np.minimum(found, len(gaps) - 1)]] == group[at])
        gap = gaps[np.minimum(found, len(gaps) - 1)][has]
        out.append((ids[at[has]], np.ones(len(gap), np.int64), n[gap], ids[gap], n[at[has]]))
        size = np.diff(np.append(heads, len(at)))
        lead = has[heads]
        top, gap = at[heads[lead]], gaps[np.minimum(found, len(gaps) - 1)][heads[lead]]
        out.append((ids[gap], size[lead], n[top], ids[top], n[gap]))
    who, near, best_n, best_id, own = (np.concatenate(c) for c in zip(*out))
    weak = best_n < ratio * own
    return pa.RecordBatch.from_arrays(
        [pa.array(who), pa.array(near.astype(np.int64)), pa.array(best_n, mask=weak), pa.array(-best_id, mask=weak)], names=["id", "near", "best_n", "best"]
    )


def variants(counts: DataFrame, ratio: int = 10, word: str = "word", n: str = "n") -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of a table of counts.

    Near words differ by one inserted, deleted or replaced code point. A word's form is its near word of largest n, if
    that is at least ``ratio`` (2 or more) times its own; its root is the last word on the way from form to form. Counts grow by the
    ratio on that way, so the largest and the smallest count bound its steps.
    """
    if ratio < 2:
        raise ValueError("the ratio must be at least 2")
    given = counts.where(F.col(word).isNotNull() & F.col(n).isNotNull()).groupBy(F.col(word).alias("word")).agg(F.sum(n).cast("long").alias("n"))
    words = written(position(given, [], ["word"], "id"), "words")
    longest, most, least = words.agg(F.max(F.char_length("word")), F.max("n"), F.min(F.greatest("n", F.lit(1)))).first()
    if longest is None:
        return words.select("word", *[F.lit(None).cast("string").alias(c) for c in ("form", "root")], "n", *[F.lit(None).cast("long").alias(c) for c in ("n_near", "form_n")])
    turned = position(words.select("id", F.reverse("word").alias("back")), [], ["back"], "place")
    forward = number_nodes(words, "word", "id", "id", longest + 1).withColumnsRenamed({"key": "id", "nodes": "forward"})
    backward = number_nodes(turned, "back", "id", "place", longest + 1).withColumnsRenamed({"key": "id", "nodes": "backward"})
    pairs = words.join(forward, "id").join(backward, "id").select("id", "n", "word", "forward", "backward").mapInArrow(
        _pairs, "prefix long, suffix long, id long, n long, kind byte"
    )
    met = pairs.repartition("prefix", "suffix").sortWithinPartitions("prefix", "suffix").mapInArrow(
        lambda batches: _meet(batches, ratio), "id long, near long, best_n long, best long"
    )
    top = F.max(F.when(F.col("best").isNotNull(), F.struct("best_n", "best")))
    near = written(met.groupBy("id").agg(F.sum("near").alias("n_near"), top.alias("_top")).select("id", "n_near", F.col("_top.best_n").alias("form_n"), (-F.col("_top.best")).alias("form_id")), "near")
    forms = near.where("form_id is not null").select("id", "form_id")
    chain, reached = forms.withColumnRenamed("form_id", "root_id"), least * ratio * ratio
    while reached <= most:
        step = forms.select(F.col("id").alias("root_id"), F.col("form_id").alias("_next"))
        chain = chain.join(step, "root_id", "left").select("id", F.coalesce("_next", "root_id").alias("root_id"))
        reached *= ratio
    name = lambda key, out: words.select(F.col("id").alias(key), F.col("word").alias(out))
    ends = forms.join(chain, "id").join(name("form_id", "form"), "form_id").join(name("root_id", "root"), "root_id").select("id", "form", "root")
    x = words.join(near.drop("form_id"), "id", "left").join(ends, "id", "left")
    return x.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
