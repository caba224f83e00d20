"""Every registered query against its DuckDB SQL on the smallest tables."""

import glob
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pandas as pd

import __spark_entry__ as entry


def canonical(df, columns):
    show = lambda v: "" if pd.isna(v) else f"{v:.8g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in df[columns].itertuples(index=False, name=None))


def test_queries_equal_their_sql(spark, sf):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)

    def compare(name):
        con = duckdb.connect()
        con.execute("set threads = 1")
        for f in glob.glob(f"{sf}/*.parquet"):
            con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        try:
            got, want = queries[name](spark, sf).toPandas(), con.execute(oracles[name]).df()
            columns = sorted(got.columns)
            if columns != sorted(want.columns):
                return f"{name}: columns {columns} {sorted(want.columns)}"
            return None if canonical(got, columns) == canonical(want, columns) else f"{name}: rows differ"
        except Exception as e:  # reported with its name
            return f"{name}: {str(e)[:300]}"

    with ThreadPoolExecutor(8) as pool:
        bad = [x for x in pool.map(compare, oracles) if x]
    assert not bad, "\n".join(bad)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_queries_without_sql_are_few(spark):
    """Each of these is compared with a plain model in test_streams.py or test_traces.py."""
    names = {n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith(("op", "pipeline"))}
    assert names == {"d_throughput_drop", "st_throughput", "a_noise_support", "st_late_spans"}
