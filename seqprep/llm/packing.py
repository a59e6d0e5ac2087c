"""Best-fit packing of token pieces into sequences under several capacities.

Documents longer than a sequence are cut into full pieces; the first piece takes what is over. A piece has a size in
every dimension: tokens, one document, and its attention cost (length squared). In each shard the pieces are placed by
falling length: among the open bins with room in every dimension, the one whose weighted, capacity-scaled residual
after placing has the smallest norm (``rule="norm"``), or whose weighted dot product of residual and size is smallest
(``rule="dot"``). Shards are hashes of pieces of bounded expected size, so a heavy document or source does not matter,
and each wastes at most a few unfilled bins. Null text: empty (its end token only). Repeated rows: packed each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqprep.llm.bpe import PATTERN, _field, read_vocabulary, written_strings
from seqprep.llm.common import slices, written

SHARD_PIECES = 32_768
WEIGHTS = (1.0, 0.001, 0.001)


def cut_pieces(df: DataFrame, key: str, text: str, path: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every document's ids followed by ``end_id``."""
    vocabulary = df.sparkSession.sparkContext.broadcast(written_strings(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks, added = vocabulary.value
        coder = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        for batch in slices(batches, "_text"):
            rows, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                ids = np.append(coder.encode_to_numpy(t.as_py() or "", allowed_special="all"), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                cuts = [0, *range(n % capacity or min(capacity, n), n, capacity), n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    if keep_ids:
                        kept.append(ids[a:b].astype(np.int64))
            columns = [
                batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *kept]))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"{_field(df, key)}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<bigint>" if keep_ids else "")
    return df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, schema)


def best_fit(length: np.ndarray, capacities: tuple[float, float, float], weights=WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, placed in the given order."""
    scale, weight = np.array(capacities, float), np.array(weights, float)
    bins, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    smallest = np.minimum.accumulate(length[::-1])[::-1]
    room = np.zeros((1024, 3))
    name, used = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
    n_open = made = 0
    for i, size in enumerate(length):
        item = np.array([size, 1.0, float(size) ** 2])
        best = -1
        if n_open:
            left = room[:n_open] - item
            fits = (left >= 0).all(axis=1)
            if fits.any():
                value = (weight * (left / scale) ** 2).sum(axis=1) if rule == "norm" else (room[:n_open] / scale * (weight * item / scale)).sum(axis=1)
                best = int(np.where(fits, value, np.inf).argmin())
        if best < 0:
            if n_open == len(room):
                room, name, used = np.vstack([room, np.zeros_like(room)]), np.append(name, np.zeros_like(name)), np.append(used, np.zeros_like(used))
            best, n_open = n_open, n_open + 1
            room[best], name[best], used[best] = scale, made, 0
            made += 1
        bins[i], offsets[i] = name[best], used[best]
        room[best] -= item
        used[best] += size
        # a bin that the smallest piece to come no longer fits is closed: the last open bin takes its place
        least = smallest[min(i + 1, len(length) - 1)]
        if room[best, 0] < least or room[best, 1] < 1 or room[best, 2] < float(least) ** 2:
            n_open -= 1
            room[best], name[best], used[best] = room[n_open], name[n_open], used[n_open]
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 1024, max_documents: int | None = None, max_cost: float | None = None,
         weights=WEIGHTS, rule: str = "norm", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add sequence_id and offset to a table of pieces with a ``length``; the table is read twice."""
    capacities = (capacity, max_documents or capacity, max_cost or float(capacity) ** 2)
    shards = max(1, -(-pieces.count() // shard_pieces))
    columns = pieces.columns

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", *[c for c in columns[:3] if c != "length"]], ascending=False, kind="stable").reset_index(drop=True)
        bins, offsets = best_fit(frame["length"].to_numpy(), capacities, weights, rule)
        frame["sequence_id"], frame["offset"] = (frame["_shard"].to_numpy().astype(np.int64) << 32) + bins, offsets
        return frame.drop(columns="_shard")

    spread = pieces.withColumn("_shard", F.pmod(F.xxhash64(*map(F.col, columns)), F.lit(shards)).cast("int"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return spread.groupBy("_shard").applyInPandas(place, schema)


def pack_documents(df: DataFrame, key: str, text: str, path: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False, **options) -> DataFrame:
    """Cut, then pack: (key, piece, start, length, ids_crc32, [ids,] sequence_id, offset)."""
    # the ids, if asked for, wait in the written table while lengths alone are packed
    pieces = written(cut_pieces(df, key, text, path, capacity, end_id, keep_ids).withColumn("_at", F.monotonically_increasing_id()), "pieces")
    placed = pack(pieces.drop("ids"), capacity, **options)
    if keep_ids:
        placed = placed.join(pieces.select("_at", "ids"), "_at")
    return placed.drop("_at")
