"""Array states of mean and spread against plain formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqprep.operators import aggregates as AG


def test_ragged_frames_with_nulls_in_many_tasks(spark):
    r = np.random.default_rng(1)
    rows = [(i, i % 3, i % 2, [None if r.random() < 0.1 else float(v) for v in r.normal(1e6, 1.0, r.integers(0, 6))]) for i in range(400)] + [(400, 0, 1, None)]
    df = spark.createDataFrame(rows, "id long, batch long, mask int, feat array<double>").repartition(7)
    got = {x.dim: x for x in AG.masked_mean_std(df, mask="mask").collect()}
    for d in range(5):
        kept = [f[d] for _, _, m, f in rows if m and f and len(f) > d]
        v = np.array([x for x in kept if x is not None])
        assert got[d].n == len(kept) and got[d].mean == pytest.approx(v.mean(), rel=1e-12) and got[d].std == pytest.approx(v.std(), rel=1e-6)
    states = AG.mean_var_state(df, by=["batch"])
    assert {(s.batch, s.dim): s.n for s in states.collect()} == {
        (b, d): n for b in range(3) for d in range(5) if (n := sum(1 for _, k, _, f in rows if k == b and f and len(f) > d and f[d] is not None))
    }
    whole = {x.dim: x for x in AG.mean_var_state(df).collect()}
    for x in AG.merge_mean_var(states).collect():
        assert x.n == whole[x.dim].n and x.mean == pytest.approx(whole[x.dim].mean, rel=1e-12)


def test_dimension_of_nulls_and_no_rows(spark):
    df = spark.createDataFrame([([None, 1.0],), ([None, 3.0],)], "feat array<double>")
    assert [tuple(r) for r in AG.masked_mean_std(df).orderBy("dim").collect()] == [(0, None, None, 2), (1, 2.0, 1.0, 2)]
    assert AG.masked_mean_std(df.limit(0)).count() == 0


def test_one_state_per_task(spark):
    df = spark.range(50_000).select(F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("feat")).repartition(4)
    out = AG.masked_mean_std(df)
    rows = {r.dim: (r.mean, r.n) for r in out.collect()}
    assert rows == {0: (pytest.approx(24_999.5), 50_000), 1: (1.0, 50_000)}
