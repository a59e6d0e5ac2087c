"""Run registered queries and their SQL side by side and compare: python tests/oracle.py [name-part …]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows_of(frame) -> tuple[list[str], list[tuple]]:
    columns = sorted(frame.columns)

    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "NULL"
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return repr(v + 0.0)
        return repr(v)

    data = [tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False, name=None)]
    return columns, sorted(data)


def compare(spark, con, folder: str, name: str, fn, sql: str) -> tuple[bool, str]:
    df = fn(spark, folder)
    got_cols, got = rows_of(df.toPandas())
    want_cols, want = rows_of(con.execute(sql).fetchdf())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        return False, f"{len(bad)} of {len(got)} rows differ: " + " | ".join(f"{c}: {a[:300]} != {b[:300]}" for c, a, b in zip(got_cols, g, w) if a != b)
    return True, f"{len(got)} rows"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from seqprep.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con, wanted = local_session(8), connect(folder), sys.argv[1:]
    failed, sqls = [], oracle_sql()
    for name, fn in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            if name in sqls:
                ok, note = compare(spark, con, folder, name, fn, sqls[name])
            else:
                ok, note = True, f"{fn(spark, folder).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print("ok  " if ok else "FAIL", name, f"{time.time() - t:.1f}s", note, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
