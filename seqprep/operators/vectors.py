"""Vector quantization.

A blocked matrix product finds the nearest codeword of each Arrow batch. A codebook that is measured to fit is broadcast;
a larger one is cut into shards that blocks of rows meet in a cogroup, and the best of each shard is merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqprep.operators.blocks import lookup_join, with_row
from seqprep.scratch import written

SHARD_BYTES = 64 << 20
ROW_BLOCK = 1 << 16


def _book(codes: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in rising order and their codewords."""
    codes = sorted(codes)
    return np.array([c[0] for c in codes], np.int64), np.array([c[1] for c in codes], float).reshape(len(codes), width)


def _nearest(x: np.ndarray, ids: np.ndarray, codes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest codeword, the first one on ties, and its squared distance, in blocks of one matrix product."""
    half = (codes**2).sum(axis=1)
    # blocks of rows whose products with all codewords take some megabytes
    block = max(1, min(block, (4 << 20) // max(len(ids), 1)))
    best = [(half - 2.0 * (x[a : a + block] @ codes.T)).argmin(axis=1) for a in range(0, len(x), block)]
    at = np.concatenate(best) if best else np.zeros(0, np.int64)
    return at, ((x - codes[at]) ** 2).sum(axis=1) if len(x) else np.zeros(0)


def nearest_codeword(rows: DataFrame, codebook: DataFrame, vec: str = "vec", block: int = 1024, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Adds code_id, distance (squared) and codeword: the nearest, lowest id on ties. codebook(code_id, vec).

    A codebook of up to ``shard_bytes`` is broadcast. A larger one is cut into shards of that size: every block of rows meets
    every shard, a shard gives each row its nearest codeword, and the least of (distance, id) is the result. A null
    vector gets nulls.
    """
    book = codebook.select(F.col("code_id").cast("long").alias("code_id"), F.col("vec").cast("array<double>").alias("vec"))
    count, width = book.agg(F.count("*"), F.max(F.size("vec"))).first()
    if count * (8 * (width or 0) + 16) <= shard_bytes:
        return _nearest_broadcast(rows, book, vec, block)
    return _nearest_sharded(rows, book, vec, block, -(-count * (8 * width + 16) // shard_bytes), width)


def _nearest_broadcast(rows: DataFrame, book: DataFrame, vec: str, block: int) -> DataFrame:
    codes = book.collect()
    shared = rows.sparkSession.sparkContext.broadcast(_book([(r[0], r[1]) for r in codes], len(codes[0][1]) if codes else 0))
    schema = T.StructType([
        *rows.schema.fields, T.StructField("code_id", T.LongType()), T.StructField("distance", T.DoubleType()),
        T.StructField("codeword", T.ArrayType(T.DoubleType())),
    ])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, codes = shared.value
        for pdf in batches:
            have = np.flatnonzero(pdf[vec].notna()) if len(ids) else np.zeros(0, int)
            x = np.stack(pdf[vec].to_numpy()[have]).astype(float) if len(have) else np.zeros((0, codes.shape[1]))
            at, dist = _nearest(x, ids, codes, block)
            found = pd.DataFrame({"code_id": pd.array(ids[at], dtype="Int64"), "distance": dist, "codeword": list(codes[at])}, index=have).reindex(np.arange(len(pdf)))
            found["codeword"] = found["codeword"].astype(object).where(found["codeword"].notna(), None)
            yield pdf.assign(**{c: found[c].to_numpy(dtype=object) if c == "codeword" else found[c].array for c in found})

    return rows.mapInPandas(assign, schema)


def _nearest_sharded(rows: DataFrame, book: DataFrame, vec: str, block: int, shards: int, width: int) -> DataFrame:
    # written, as the numbers of the rows must not change between their two uses
    numbered = written(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    vectors = numbered.where(F.col(vec).isNotNull()).select("_row", F.col(vec).cast("array<double>").alias("_x"))
    blocks = max(1, -(-vectors.count() // ROW_BLOCK))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("_blk", deal("_row", blocks)).withColumn("_shard", every(shards)).groupBy("_blk", "_shard")
    right = book.withColumn("_shard", deal("code_id", shards)).withColumn("_blk", every(blocks)).groupBy("_blk", "_shard")

    def meet(x: pa.Table, codes: pa.Table) -> pa.Table:
        ids = codes.column("code_id").to_numpy()
        if not x.num_rows or not len(ids):
            return pa.table({"_row": pa.array([], pa.int64()), "distance": pa.array([], pa.float64()), "code_id": pa.array([], pa.int64())})
        order = np.argsort(ids)
        matrix = lambda c: c.combine_chunks().flatten().to_numpy().reshape(-1, width)
        ids, words = ids[order], matrix(codes.column("vec"))[order]
        at, dist = _nearest(matrix(x.column("_x")), ids, words, block)
        return pa.table({"_row": x.column("_row"), "distance": dist, "code_id": ids[at]})

    best = left.cogroup(right).applyInArrow(meet, "_row long, distance double, code_id long")
    best = best.groupBy("_row").agg(F.min(F.struct("distance", "code_id")).alias("_b")).select("_row", F.col("_b.code_id").alias("code_id"), F.col("_b.distance").alias("distance"))
    found = lookup_join(numbered.join(best, "_row", "left"), book.withColumnRenamed("vec", "codeword"), ["code_id"], max_bytes=SHARD_BYTES)
    return found.select(*rows.columns, "code_id", "distance", "codeword")


def nearest_codeword_columns(rows: DataFrame, codebook: DataFrame, vec: str = "vec", max_codes: int = 64) -> DataFrame:
    """As ``nearest_codeword`` for small books, as one expression over the array of codewords: exact ties. A larger book goes to ``nearest_codeword``."""
    if codebook.limit(max_codes + 1).count() > max_codes:
        return nearest_codeword(rows, codebook, vec)
    entry = F.sort_array(F.collect_list(F.struct("code_id", F.col("vec").alias("v"))))
    book = codebook.agg(entry.alias("_book"))
    x = with_row(rows, book)
    square = lambda c: F.aggregate(
        F.zip_with(F.col(vec).cast("array<double>"), c["v"].cast("array<double>"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v
    )
    best = F.array_min(F.transform("_book", lambda c: F.struct(square(c).alias("d"), c["code_id"].alias("i"), c["v"].alias("v"))))
    return x.withColumn("_n", F.when(F.col(vec).isNotNull(), best)).select(
        *rows.columns, F.col("_n.i").cast("long").alias("code_id"), F.col("_n.d").alias("distance"),
        F.col("_n.v").cast("array<double>").alias("codeword"),
    )


def quantization_error(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("distance").alias("error"), F.count("*").alias("n"))


def lloyd(rows: DataFrame, start: DataFrame, epochs: int, vec: str = "vec") -> DataFrame:
    """codebook(code_id, vec) after so many Lloyd steps from the codebook ``start``; a center without rows stays.

    A step is one pass: rows are assigned inside the tasks and sums shuffle per (center, dimension). Null vectors are left out.
    """
    book = written(start.select("code_id", F.col("vec").cast("array<double>").alias("vec")), "centers")
    rows = rows.where(F.col(vec).isNotNull()).select(F.col(vec).alias("_x"))
    for _ in range(epochs):
        parts = nearest_codeword(rows, book, "_x").select("code_id", F.posexplode("_x").alias("dim", "v"))
        means = parts.groupBy("code_id", "dim").agg(F.avg("v").alias("v")).groupBy("code_id").agg(
            F.sort_array(F.collect_list(F.struct("dim", "v")))["v"].alias("_mean")
        )
        book = written(book.join(means, "code_id", "left").select("code_id", F.coalesce("_mean", "vec").alias("vec")), "centers")
    return book


def kmeans(rows: DataFrame, k: int, epochs: int = 10, seed: int = 0, vec: str = "vec") -> DataFrame:
    """codebook(code_id, vec) by Lloyd iterations of the ML library, which picks the start; the centers are k rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, maxIter=epochs, seed=seed, featuresCol="_f").fit(rows.select(array_to_vector(vec).alias("_f")))
    centers = [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    return rows.sparkSession.createDataFrame(centers, "code_id long, vec array<double>")


def stack_frames(frames: DataFrame, keys: list[str], k: int, feat: str = "feat") -> DataFrame:
    """(keys, frame, feat): k neighbouring frames in one vector; an incomplete last stack is dropped."""
    x = frames.groupBy(*keys, F.expr(f"frame div {k}").alias("_s")).agg(
        F.sort_array(F.collect_list(F.struct("frame", feat))).alias("_f")
    )
    return x.where(F.size("_f") == k).select(*keys, F.col("_s").alias("frame"), F.flatten(F.col(f"_f.{feat}")).alias(feat))


def unstack_frames(stacked: DataFrame, keys: list[str], k: int, feat: str = "feat") -> DataFrame:
    width = F.expr(f"size({feat}) div {k}")
    return stacked.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select(
        *keys, (F.col("frame") * k + F.col("_i")).alias("frame"), F.slice(feat, F.col("_i") * width + 1, width).alias(feat)
    )


def vq_roundtrip(frames: DataFrame, codebook: DataFrame, keys: list[str], k: int, feat: str = "feat") -> DataFrame:
    """Frames stacked, replaced by their nearest codewords and unstacked."""
    near = nearest_codeword(stack_frames(frames, keys, k, feat), codebook, feat)
    return unstack_frames(near.select(*keys, "frame", F.col("codeword").alias(feat)), keys, k, feat)
