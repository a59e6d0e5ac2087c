"""Block operators with tiny blocks against plain windows, on keys of very unequal size."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seqprep.operators import blocks as B
from seqprep.operators import frames as W


@pytest.fixture(scope="module")
def seq(spark):
    rng = random.Random(3)
    rows = [(k, i, float(rng.randint(0, 9)), rng.choice([None, i])) for k, n in (("hot", 230), ("a", 1), ("b", 8), ("c", 31)) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, pos long, x double, y int").cache()


def same(a, b):
    assert sorted(map(tuple, a.select(*b.columns).collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.mark.parametrize("block", [4, 7, 1000])
def test_local_window(seq, block):
    got = B.local_window(
        seq, ["k"], 2, 1,
        {"p": lambda w: F.lag("x", 2).over(w), "n": lambda w: F.lead("x").over(w), "m": lambda w: F.max("x").over(w.rowsBetween(-2, 1))},
        block=block,
    )
    w = Window.partitionBy("k").orderBy("pos")
    same(got, seq.select("*", F.lag("x", 2).over(w).alias("p"), F.lead("x").over(w).alias("n"), F.max("x").over(w.rowsBetween(-2, 1)).alias("m")))


@pytest.mark.parametrize("block", [1, 5, 1000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running(seq, block, inclusive):
    got = B.running(
        seq, ["k"], {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "l": ("last", F.col("y"))}, inclusive=inclusive, block=block
    )
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    same(got, seq.select("*", F.sum("x").over(w).alias("s"), F.max("x").over(w).alias("m"), F.last("y", True).over(w).alias("l")))


def test_with_totals(seq):
    got = B.with_totals(seq, ["k"], {"t": F.sum("x")}, block=6)
    same(got, seq.select("*", F.sum("x").over(Window.partitionBy("k")).alias("t")))


def test_position(seq):
    got = B.position(seq.select("k", "pos", "x"), ["k"], [F.desc("pos")], "r")
    w = Window.partitionBy("k").orderBy(F.desc("pos"))
    same(got, seq.select("k", "pos", "x", (F.row_number().over(w) - 1).cast("long").alias("r")))
    ranks = B.position(seq.select("k", "pos"), [], ["pos", "k"], "r").orderBy("pos", "k").select("r").collect()
    assert [r[0] for r in ranks] == list(range(len(ranks)))


def test_position_spreads_a_heavy_key(spark):
    """One key holds all rows: several range partitions still number it, so no task holds the whole key."""
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    sorted_rows = df.repartitionByRange(8, "k", "t").select(F.spark_partition_id().alias("p")).groupBy("p").count()
    assert sorted_rows.count() == 8
    assert B.position(df, ["k"], ["t"]).where("pos <> t").count() == 0


@pytest.mark.parametrize("keys", [["k"], ["k", "z"], ["s"], ["f"]])
def test_position_of_odd_keys(spark, keys, monkeypatch):
    """Keys that cross many partitions, null and nan keys, nested keys, against a plain window."""
    rng = random.Random(len(keys))
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, "a"]), (rng.choice([None, 1]),), rng.choice([None, float("nan"), 0.5]), i, "wide") for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, z string, s struct<v:long>, f double, t long, _in string")
    df = df.withColumnRenamed("_in", "text").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = B.position(df, keys, ["t"], "r")
        same(got.withColumn("f", F.col("f").cast("string")), df.withColumn("r", (F.row_number().over(Window.partitionBy(*keys).orderBy("t")) - 1).cast("long")).select(*got.columns).withColumn("f", F.col("f").cast("string")))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.select("r").limit(0).count() == 0 and B.position(df.limit(0), keys, ["t"]).count() == 0


def test_position_has_one_exchange(spark):
    df = spark.range(50_000).select((F.col("id") % 40_000).alias("k"), "id", F.lit("wide").alias("text"))
    got = B.position(df, ["k"], ["id"])
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    # behind the written rows only the table of one row per partition moves
    assert plan.count("SortMergeJoin") == 0 and "BroadcastHashJoin [_part" in plan and "hashpartitioning" not in plan


def test_lookup_join_both_ways(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 5).alias("k"), "id")
    right = spark.createDataFrame([(1, "one"), (2, "two")], "k long, name string")
    small = B.lookup_join(left, right, ["k"], "left")
    salted = B.lookup_join(left, right, ["k"], "left", max_rows=1)
    same(small, salted)


def test_steps_with_small_blocks(seq):
    x = seq.select("k", "pos", "x")
    for f in (
        lambda b: W.rolling_mean(x, ["k"], 4, block=b), lambda b: W.rolling_window(x, ["k"], 4, 3, block=b),
        lambda b: W.fixed_chunks(x, ["k"], 6, block=b), lambda b: W.linear_upsample(x, ["k"], 3, block=b),
        lambda b: W.trim_edges(x.withColumn("code", (F.col("x") + 120).cast("int")), ["k"], 1, block=b),
    ):
        same(f(5), f(10_000))


def test_decaying_max(seq):
    got = {(r.k, r.pos): r.state for r in W.decaying_max(seq, ["k"], 0.8, block=9).collect()}
    state = {}
    for r in sorted(seq.collect(), key=lambda r: (r.k, r.pos)):
        state[r.k] = max(0.8 * state.get(r.k, 0.0), r.x)
        assert got[(r.k, r.pos)] == pytest.approx(state[r.k], abs=1e-9)
