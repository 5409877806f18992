"""Every registered query of the library against its DuckDB oracle, plans of the hot ones, streaming and sources."""

import hashlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

import tidemark.sources as sources
from tidemark.functions.canonical import canonical_json
from tidemark.plans import evidence_proofs, further, more, nights, packets, payloads, provider, reading, revisions, rules, streams  # noqa: F401  they add their queries
from tidemark.plans.registry import ORACLES, QUERIES
from tidemark.session import TABLES
from tidemark.streaming import pipelines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def shown(x):
    if x is None or x != x:
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{round(float(x), 6) + 0.0:.6f}"
    return str(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, db, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = db.sql(ORACLES[name])
    assert sorted(found.columns) == names
    at = [found.columns.index(n) for n in names]
    want = sorted(tuple(shown(r[i]) for i in at) for r in found.fetchall())
    got = sorted(tuple(shown(r[n]) for n in names) for r in df.collect())
    assert got == want


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["u1_union_ids"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in plan
    assert "props" not in plan.split("ReadSchema")[1][:80]
    asof = QUERIES["j12_forward_asof"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in asof and "Cartesian" not in asof


def test_canonical_json(spark):
    texts = ['{"b": 1, "a": "é"}', '{"a":1,"a":2}', '{"x": NaN}', "nope", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(canonical_json("t")).collect()]
    assert got == ['{"a":"\\u00e9","b":1}', None, None, None, None]


def test_replayed_rows_count_once(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").limit(50)
    for part in "ab":
        rows.write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = pipelines.landed(spark, str(tmp_path))
    query = pipelines.deduplicated(stream).writeStream.format("memory").queryName("replayed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("replayed").count() == 50


def test_originals_and_payloads(spark, tmp_path):
    good = b"\x89PNG\r\n\x1a\nrest"
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / hashlib.sha256(good).hexdigest()).write_bytes(good)
    (tmp_path / "o" / ("0" * 64)).write_bytes(b"%PDF-1.7")
    (tmp_path / "o" / "note.txt").write_bytes(b"hi")
    got = {r["media_type"]: r["state"] for r in sources.originals(spark, str(tmp_path / "o")).collect()}
    assert got == {"image/png": "verified", "application/pdf": "hash_mismatch", "application/octet-stream": "named"}
    (tmp_path / "p").mkdir()
    for name, text in {"a": json.dumps({"x": {"hr": 0}, "y": None, "s": "5", "t": True}), "b": '{"x":1,"x":2}', "c": " "}.items():
        (tmp_path / "p" / name).write_text(text)
    p = sources.payloads(spark, str(tmp_path / "p"))
    assert sorted(r["state"] for r in p.collect()) == ["empty", "invalid", "parsed"]
    one = p.where("state = 'parsed'").select(*[sources.field(F.col("payload"), f).alias(f.replace(".", "_")) for f in ("x.hr", "y", "s", "t", "gone")], sources.first_present(F.col("payload"), ["gone", "y", "x.hr"]).alias("first")).first()
    assert [one[c]["state"] for c in ("x_hr", "y", "s", "t", "gone", "first")] == ["value", "null", "invalid", "invalid", "missing", "null"]
    assert (one["x_hr"]["value"], one["s"]["reason"]) == (0.0, "numeric_string_not_coerced")


def test_page_chains_and_export(spark, tmp_path):
    pages = [("ok", 0, False), ("ok", 1, True), ("hole", 0, False), ("hole", 2, True), ("open", 0, False), ("twice", 0, False), ("twice", 0, False), ("twice", 1, True), ("late", 0, True), ("late", 1, False)]
    got = {r["c"]: r["reason"] for r in sources.page_chains(spark.createDataFrame(pages, "c string, page int, terminal boolean"), ["c"]).collect()}
    assert got == {"ok": None, "hole": "missing_page", "open": "no_single_terminal", "twice": "repeated_page", "late": "page_after_terminal"}
    df = spark.range(47).select(F.col("id").alias("item"))
    assert sources.export_evidence(df.select("item"), str(tmp_path / "out")) > 0
    with pytest.raises(ValueError):
        sources.export_evidence(df, str(tmp_path / "big"), max_bytes=10)
    kept = spark.range(1).select(sources.redacted(F.lit('{"a":"1","secret":"2"}'), ["a"]).alias("m")).first()["m"]
    assert kept == {"a": "1"}


@pytest.mark.parametrize("name, id, tables", [("y10_run_status_of_all", "user_id", "SELECT user_id FROM events"), ("j8_pairing_of_all", "user_id", "SELECT user_id FROM events WHERE event_type IN ('error', 'purchase')"), ("u2_union_of_days_of_all", "id", "SELECT user_id FROM events UNION SELECT o_custkey FROM orders")])
def test_queries_of_all_leave_no_user_out(spark, db, name, id, tables):
    out = QUERIES[name](spark, SF)
    assert {r[id] for r in out.select(id).distinct().collect()} == {x for (x,) in db.execute(tables).fetchall()}
    if name.startswith("y10"):
        assert out.agg(F.sum("attempts")).first()[0] == db.execute("SELECT count(*) FROM events").fetchone()[0]


def test_latest_by_key_goes_on_where_it_ended(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    target = str(tmp_path / "in" / "events.parquet")
    rows.where("event_id % 2 = 0").write.mode("append").parquet(target)
    first = pipelines.latest_by_key(spark, str(tmp_path / "in"), path=str(tmp_path / "state"))
    before = {r["user_id"]: r["event_id"] for r in first.collect()}
    rows.where("event_id % 2 = 1").write.mode("append").parquet(target)
    after = {r["user_id"]: r["event_id"] for r in pipelines.latest_by_key(spark, str(tmp_path / "in"), path=str(tmp_path / "state")).collect()}
    want = {r["user_id"]: r["m"]["event_id"] for r in rows.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).collect()}
    assert after == want and all(after[u] >= e for u, e in before.items()) and before != after
