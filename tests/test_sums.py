"""Sums of doubles do not hang on how Spark deals out the rows, and what is made of them equals the SQL."""

import random
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from __spark_entry__ import oracle_sql, queries
from tidemark.operators import baseline

ORACLES, QUERIES = oracle_sql(), queries()


def oracle(folder, table, name):
    con = duckdb.connect()
    con.execute("SET threads = 1")  # with more, its own sums of doubles differ from run to run
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    found = con.sql(ORACLES[name])
    names = sorted(found.columns)
    return names, sorted(str(tuple(r[found.columns.index(n)] for n in names)) for r in found.fetchall())


def test_means_are_added_up_in_the_given_order(spark):
    draw = random.Random(5)
    rows = [(g, i, draw.choice([0.1, 49.27, -38.97, 1e15, -1e15, None]) and draw.random() * 10 ** draw.randint(0, 15)) for g in range(20) for i in range(200)]
    want = {}
    for g, _, v in rows:
        if v is not None:
            total, n = want.get(g, (0.0, 0))
            want[g] = (total + v, n + 1)
    draw.shuffle(rows)
    got = baseline.ordered_means(spark.createDataFrame(rows, "g int, i int, v double").repartition(7), ["g"], ["i"], "v")
    assert {r.g: (r["mean"], r.n) for r in got.collect()} == {g: (t / n, n) for g, (t, n) in want.items()}


@pytest.mark.parametrize("name", ["p12_notable_changes", "q4_period_brief", "q9_packet_digests"])
def test_changes_against_zero_and_at_ties_equal_the_sql(spark, tmp_path, name):
    series = [  # values by day of one user: before and from the 16th on
        ([42.41, 38.97, 29.35, 49.27], [133.68, 11.95, 49.76, 47.92]),  # 0.5206875 is a hair less when it is scaled as a double
        ([0.0], [5.0]), ([0.0], [-2.0]), ([0.0], [0.0]), ([3.0], [0.0]), ([1.0], [1.1]), ([10.0], [11.0]), ([], [1.0]), ([1.0], []),
    ]
    rows = [(u, datetime(2024, 1, d), v) for u, (a, b) in enumerate(series) for d, v in [*zip(range(1, 16), a), *zip(range(16, 31), b)]]
    table = pa.table({"event_id": pa.array(range(len(rows)), pa.int64()), "ts": pa.array([t + timedelta(hours=1) for _, t, _ in rows], pa.timestamp("us")), "user_id": pa.array([u for u, _, _ in rows], pa.int64()), "event_type": ["view"] * len(rows), "value": [v for *_, v in rows], "props": ['{"k": 1}'] * len(rows)})
    pq.write_table(table, tmp_path / "events.parquet")
    names, want = oracle(tmp_path, "events", name)
    assert sorted(str(tuple(r[n] for n in names)) for r in QUERIES[name](spark, str(tmp_path)).collect()) == want


@pytest.mark.parametrize("name", ["k12_frozen_runs", "j20_run_report"])
def test_runs_do_not_hang_on_the_splits_of_the_table(spark, tmp_path, name):
    pq.write_table(pq.read_table("/root/testdata/sf0.01/lineitem.parquet"), tmp_path / "lineitem.parquet", row_group_size=7000)
    sizes = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        names, want = oracle(tmp_path, "lineitem", name)
        assert sorted(str(tuple(r[n] for n in names)) for r in QUERIES[name](spark, str(tmp_path)).collect()) == want
    finally:
        for k in sizes:
            spark.conf.unset(k)
