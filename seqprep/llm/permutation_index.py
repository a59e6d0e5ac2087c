"""Approximate nearest neighbours by a permutation index.

A vector is known by its nearest pivots in order: the position of each of its ``prefix`` nearest of ``PIVOTS`` pivots.
The rows of a block are posted in one inverted file per pivot, with that position. A query reads the files of its own
nearest pivots and adds up the footrule distance of the positions, a pivot that is not among a row's nearest counting
as position ``prefix``; the ``share`` of the block with the smallest footrule (never under ``least`` rows, ties to the
smaller id) is reranked by the exact inner product. Every row is indexed. Blocks of rows meet blocks of queries, both of
bounded expected size by a hash of the id, so equal vectors, however many, spread over all blocks; the best of all
blocks are merged by a grouped top list. Largest inner product becomes nearness by angle by one more coordinate,
sqrt(largest norm squared - norm squared), used for the positions only.

The pivots are chosen from the ``SAMPLE`` rows with the smallest md5 of their id, each next one far from those taken.
Rows with a null id, or a vector that is null, zero, of another length than most, or holds null or non-finite numbers,
take no part. Rows with the query's id count as its own. A query id given twice is searched once, by its smallest vector; other repeated ids are rows of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqprep.llm.common import written

PIVOTS, PREFIX, SAMPLE, BLOCK, QUERY_BLOCK, SHARE, LEAST = 256, 64, 1024, 8192, 4096, 0.2, 512


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec array<double>, dim, norm2) of the rows that take part."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & ~bad
    )
    rows = rows.select("id", "vec", F.size("vec").alias("dim"), F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x).alias("norm2"))
    return rows.where("norm2 > 0")


def choose_pivots(sample: np.ndarray, number: int) -> np.ndarray:
    """Rows of the sample, each the one whose nearest taken row is farthest by angle."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    taken, near = [0], unit @ unit[0]
    while len(taken) < min(number, len(unit)):
        taken.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[taken[-1]])
    return unit[taken]


def positions(vectors: np.ndarray, extra: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Position of each pivot in each vector's order of nearest pivots, ``prefix`` where it is beyond."""
    order = np.argsort(-(np.hstack([vectors, extra[:, None]]) @ pivots.T), axis=1, kind="stable")
    out = np.full(order.shape, prefix, np.int16)
    np.put_along_axis(out, order[:, :prefix], np.arange(min(prefix, order.shape[1]), dtype=np.int16)[None], axis=1)
    return out


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten()).reshape(-1, dim) if len(column) else np.zeros((0, dim))


def search_block(ids, vectors, query_ids, queries, top2, pivots, k, prefix, share, least):
    """Row numbers of (query, candidate) and scores of the k best of one block for each query, rows ordered by id."""
    by = np.argsort(ids, kind="stable")
    ids, vectors = ids[by], vectors[by]
    place = positions(vectors, np.sqrt(np.maximum(top2 - (vectors**2).sum(1), 0)), pivots, prefix)
    asked = positions(queries, np.zeros(len(queries)), pivots, prefix)
    posted = []
    for p in range(len(pivots)):
        rows = np.flatnonzero(place[:, p] < prefix)
        posted.append((rows, place[rows, p].astype(np.int32)))
    n = len(ids)
    # footrule of a row without any shared pivot, less what each shared pivot saves
    own = (prefix - place.astype(np.int32)).sum(axis=1)
    keep = min(n, max(int(np.ceil(share * n)), least, k + 1))
    out = []
    for q in range(len(queries)):
        mine = np.flatnonzero(asked[q] < prefix)
        footrule = own.copy()
        for p in mine:
            rows, at = posted[p]
            here = int(asked[q, p])
            footrule[rows] += np.abs(at - here) - (prefix - at) - (prefix - here)
        best = np.argpartition(footrule.astype(np.int64) * n + np.arange(n), keep - 1)[:keep] if keep < n else np.arange(n)
        best = np.sort(best[ids[best] != query_ids[q]])
        score = vectors[best] @ queries[q]
        pick = np.lexsort((ids[best], -score))[:k]
        out.append((np.full(len(pick), query_ids[q]), ids[best[pick]], score[pick]))
    return out


def nearest(df: DataFrame, key: str, vector: str, is_query: Column, k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX,
            share: float = SHARE, least: int = LEAST, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which ``is_query`` (a condition on ``id``) holds."""
    rows = usable(df, key, vector)
    shape = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm2").alias("top2")).orderBy(F.desc("n"), "dim").first()
    if shape is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total, top2 = shape["dim"], shape["n"], shape["top2"]
    rows = written(rows.where(F.col("dim") == dim).select("id", "vec", "norm2"), "vectors")
    sample = rows.orderBy(F.md5(F.col("id").cast("string")), "id").limit(SAMPLE).select("vec", "norm2").collect()
    points = np.array([[*r["vec"], np.sqrt(max(top2 - r["norm2"], 0))] for r in sample])
    shared = df.sparkSession.sparkContext.broadcast(choose_pivots(points, pivots))
    blocks = max(1, -(-total // block))
    queries = rows.where(is_query).groupBy("id").agg(F.min("vec").alias("vec"))
    query_blocks = max(1, -(-queries.count() // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    index = rows.select("id", "vec", mine(blocks).alias("_b"), every(query_blocks).alias("_q"))
    asks = queries.select("id", "vec", mine(query_blocks).alias("_q"), every(blocks).alias("_b"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, asked = np.asarray(left.column("id")), np.asarray(right.column("id"))
        found = []
        if len(ids) and len(asked):
            found = search_block(ids, _matrix(left.column("vec"), dim), asked, _matrix(right.column("vec"), dim), top2, shared.value, k, prefix, share, least)
        query, other, score = (np.concatenate(x) if found else np.zeros(0, t) for x, t in zip(zip(*found) if found else ((),) * 3, (np.int64, np.int64, float)))
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(other, pa.int64()), "score": pa.array(score, pa.float64())})

    found = index.groupBy("_b", "_q").cogroup(asks.groupBy("_b", "_q")).applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
