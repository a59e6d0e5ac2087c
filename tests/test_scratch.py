"""Intermediate tables go when their work is done."""

import os
import time

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from seqprep.plans import all_queries
from seqprep.scratch import DROP_SHUFFLES, release, scratch_folder, scratch_scope, written

FOLDER = "/root/testdata/sf0.001"


def tables(spark):
    place = scratch_folder(spark).removeprefix("file:")
    return set(os.listdir(place)) if os.path.isdir(place) else set()


def test_scope_leaves_an_empty_folder(spark):
    queries, before = all_queries()[0], tables(spark)
    with scratch_scope(spark):
        for name in ("phones_pronounce", "score_quantized_corpus", "window_voice_activity", "sample_skip_batches", "stream_clean", "sink_cached_features"):
            assert queries[name](spark, FOLDER).count() > 0
            assert tables(spark) > before, name
    assert tables(spark) == before


def test_release_of_one_table(spark):
    before = tables(spark)
    first = written(spark.range(9), "first")
    second = written(first.where("id > 3"), "second")
    release(first)
    assert second.count() == 5 and len(tables(spark) - before) == 1
    release(second)
    release(second)
    assert tables(spark) == before


def test_nested_scopes_and_failures(spark):
    before = tables(spark)
    with scratch_scope(spark):
        outer = written(spark.range(3), "outer")
        try:
            with scratch_scope(spark):
                written(spark.range(2), "inner")
                raise RuntimeError
        except RuntimeError:
            pass
        assert outer.count() == 3
    assert tables(spark) == before


def test_row_groups_bound_what_a_reader_decodes(spark):
    # few distinct numbers pack well: 4,096 such rows are 400 MB once decoded
    rows = spark.range(0, 2400, 1, 1).selectExpr("id", "transform(sequence(1, 25000), i -> cast(hash(i, id) % 64 as int)) as ids")
    table = written(rows, "long")
    files = [f.removeprefix("file:") for f in table.inputFiles()]
    groups = [pq.ParquetFile(f).metadata for f in files]
    most = max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups))
    assert most < 1200 and table.count() == 2400
    release(table)


def shuffles(spark):
    """Shuffle files on this machine: the driver's and, in a local session, the tasks'."""
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    return {str(f) for f in env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, named = shuffles(spark), spark.conf.get(DROP_SHUFFLES, None)
    table = written(spark.range(20000).repartition(4, "id").groupBy((F.col("id") % 999).alias("k")).count(), "counts")
    for _ in range(50):
        if not shuffles(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffles(spark) - before
    assert table.count() == 999 and spark.conf.get(DROP_SHUFFLES, None) == named
    release(table)
