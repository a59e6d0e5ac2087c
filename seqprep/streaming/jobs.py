"""Structured Streaming forms of the cleaners, chunks, statistics and the feature cache."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from seqprep.functions import text as T


def stream_clean(lines: DataFrame, text: str = "value", names: tuple = ("english_cleaners",)) -> DataFrame:
    """The cleaners on arriving lines: stateless."""
    return lines.withColumn("clean", T.clean(F.col(text), list(names)))


class _Chunker(StatefulProcessor):
    """State of a sequence: the number of chunks sent and the unfinished tail of at most ``length`` values.

    Rows of a key come in frames of any order. A key with more than one frame in a micro-batch has its frames sorted one
    by one into runs in the state store and merged from there piece by piece, so the worker holds one frame and one piece
    per run. Frames in order make one run.
    """

    def __init__(self, length: int, piece: int = 512, out_rows: int = 8192):
        self.length, self.piece, self.out_rows = length, piece, out_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", "chunk long, xs array<double>")
        self.runs = handle.getMapState("runs", "run int, piece int", "pos array<long>, xs array<double>")

    def _sorted(self, frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        pos, x = frame["pos"].to_numpy(), frame["x"].to_numpy(float)
        order = np.lexsort((x, pos))
        return pos[order], x[order]

    def _spilled(self, first: pd.DataFrame, rest: Iterator[pd.DataFrame]) -> Iterator[float]:
        """The values of many frames in order of their places."""
        pieces, last = [], None
        for frame in itertools.chain([first], rest):
            pos, x = self._sorted(frame)
            if last is None or (pos[0], x[0]) < last:
                pieces.append(0)
            for a in range(0, len(pos), self.piece):
                self.runs.updateValue((len(pieces) - 1, pieces[-1]), (pos[a : a + self.piece].tolist(), x[a : a + self.piece].tolist()))
                pieces[-1] += 1
            last = (pos[-1], x[-1])

        def run(number: int) -> Iterator[tuple[int, float]]:
            for piece in range(pieces[number]):
                yield from zip(*self.runs.getValue((number, piece)))
                self.runs.removeKey((number, piece))

        for _, x in heapq.merge(*[run(i) for i in range(len(pieces))]):
            yield x

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        chunk, xs = self.tail.get() if self.tail.exists() else (0, [])
        xs, out = list(xs), []
        frames = (f for f in rows if len(f))
        first, second = next(frames, None), next(frames, None)
        if first is None:
            return
        if second is None:
            values = iter(self._sorted(first)[1].tolist())
        else:
            values = self._spilled(first, itertools.chain([second], frames))
        for x in values:
            xs.append(x)
            if len(xs) > self.length:
                out.extend((key[0], chunk, step, float(v), 0 if chunk == 0 else 1) for step, v in enumerate(xs))
                # the last value of a chunk is the first one of the next
                chunk, xs = chunk + 1, xs[self.length :]
                if len(out) >= self.out_rows:
                    yield self._frame(out)
                    out = []
        self.tail.update((chunk, xs))
        yield self._frame(out)

    def _frame(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["utt", "chunk", "step", "x", "reset"])

    def close(self) -> None:
        pass


def stream_chunks(samples: DataFrame, length: int) -> DataFrame:
    """(utt, chunk, step, x, reset) as chunks fill up: samples(utt, pos, x) of later files have later places.

    Inside a micro-batch the rows of a sequence may come in any order. reset is 0 on a sequence's first chunk. Between
    micro-batches the state is the tail only, so it stays bounded; needs the RocksDB state store.
    """
    return samples.groupBy("utt").transformWithStateInPandas(
        statefulProcessor=_Chunker(length), outputStructType="utt long, chunk long, step int, x double, reset int",
        outputMode="append", timeMode="None",
    )


def stream_mean_var(frames: DataFrame, feat: str = "feat") -> DataFrame:
    """dim, mean, std, n across micro-batches (complete or update mode)."""
    v = F.col("v").cast("double")
    return frames.select(F.posexplode(feat).alias("dim", "v")).groupBy("dim").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count("*").alias("n")
    )


def stream_feature_cache(source: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Process each arriving file once and add its features to a parquet table.

    Every micro-batch owns one partition of the table and replaces it when it is rerun, so a failure between the write
    and the checkpoint leaves no duplicates.
    """

    def add(batch: DataFrame, epoch: int) -> None:
        compute(batch).withColumn("epoch", F.lit(epoch)).write.partitionBy("epoch").mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).parquet(path)

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
