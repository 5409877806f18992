"""Queries of proofs over joined evidence, device attribution and frozen inputs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import idempotency_key
from tidemark.functions.canonical import manifest_hash
from tidemark.operators import baseline, devices, proof
from tidemark.plans import adapters
from tidemark.plans.adapters import M
from tidemark.plans.registry import KEYS, query, rounded
from tidemark.session import load, shared_dir
from tidemark.sources import frozen



def evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """events as candidates with their evidence, in which check number event_id % 61 (from the tenth on) does not hold; some users' sources and some batches are odd or absent."""
    i, u = F.col("event_id"), F.col("user_id")
    e = load(spark, sf_dir, "events")
    hit = lambda j: i % 61 == j
    fault = lambda j, wrong, right: F.when(hit(j), wrong if hasattr(wrong, "cast") else F.lit(wrong)).otherwise(right if hasattr(right, "cast") else F.lit(right))
    name = lambda p, c=i: F.concat(F.lit(p), c.cast("string"))
    source = e.select(u).distinct().select(
        name("s", u).alias("id"), F.when(u % 29 == 7, "manual").otherwise("provider").alias("kind"), F.when(u % 29 == 8, "other").otherwise("provider").alias("provider_code"),
        name("a", u).alias("acquisition_id"), (u % 2 == 0).alias("attributed"), name("i", u).alias("instance"),
    )
    surface = fault(9, "stress", "heart_rate")
    contract = fault(25, "unknown-contract", proof.CONTRACTS[2])
    recon = fault(27, "unknown", proof.RECONCILIATION)
    day = F.when(~hit(12), F.to_date("ts"))
    base = e.select(i, u, surface.alias("surface"), contract.alias("contract"), recon.alias("recon"), day.alias("local_date"), fault(13, "", "days.0").alias("path"))
    o = base.select(
        name("o").alias("id"), fault(31, "s-", name("s", u)).alias("source_id"), fault(32, "p-", name("p")).alias("payload_id"), fault(33, "f-", name("f")).alias("artifact_id"), fault(35, "daily", "intraday").alias("stream"),
        fault(37, "csv", "json").alias("format"), fault(38, "stress.json", F.concat("surface", F.lit(".json"))).alias("filename"), name("e").alias("event_id"), fault(26, proof.CONTRACTS[0], F.col("contract")).alias("contract"),
        fault(28, "other", F.col("recon")).alias("reconciliation"), i.alias("_i"), u,
    )
    payload = base.select(
        name("p").alias("id"), fault(30, "s-", name("s", u)).alias("source_id"), name("f").alias("artifact_id"), fault(34, "daily", "intraday").alias("stream"), fault(36, "csv", "json").alias("format"), F.sha2(i.cast("string"), 256).alias("content_hash"),
    )
    self_ = F.struct(*o.columns)
    keyed = o.withColumn("key", F.when(F.col("_i") % 61 == 50, "wrong").otherwise(proof.observation_key(self_, F.sha2(F.col("_i").cast("string"), 256))))
    record = base.select(
        name("r").alias("id"), name("s", u).alias("source_id"), "surface", fault(10, "superseded", "current").alias("projection_status"), fault(11, "daily", "intraday").alias("stream"), "local_date", F.col("path").alias("source_path"), "contract",
        F.col("recon").alias("reconciliation"), fault(29, "p-", name("p")).alias("payload_id"), fault(39, "e-", name("e")).alias("event_id"),
        fault(51, "wrong", proof.collection_key(F.struct(name("i", u).alias("instance")), F.struct("surface", "local_date"))).alias("collection_key"),
    )
    metric = base.select(
        name("m").alias("id"), fault(23, "r-", name("r")).alias("record_id"), fault(14, "steps", "stress_daily_average").alias("code"), fault(15, "steps", "stress").alias("capability"), fault(16, "value", "missing").alias("state"),
        F.when(hit(17), 1.0).alias("number"), F.when(hit(18), "1").alias("text"), F.when(hit(19), "[]").alias("collection"), F.when(hit(20), "why").alias("reason"), fault(21, "ms", "points").alias("unit"),
        fault(22, "elsewhere", F.concat("path", F.lit(".avgStressLevel"))).alias("field_path"), F.when(hit(24), u % 2 != 0).otherwise(u % 2 == 0).alias("attributed"),
    )
    event = keyed.select(
        F.col("id").alias("_o"), F.concat(F.lit("e"), F.col("_i").cast("string")).alias("id"), F.concat(F.lit("b"), F.col("_i").cast("string")).alias("batch_id"), F.when(F.col("_i") % 61 == 40, "a-").otherwise(F.concat(F.lit("a"), u.cast("string"))).alias("acquisition_id"),
        F.when(F.col("_i") % 61 == 41, "f-").otherwise(F.concat(F.lit("f"), F.col("_i").cast("string"))).alias("artifact_id"), F.when(F.col("_i") % 61 == 42, "daily").otherwise("intraday").alias("stream"),
        F.when(F.col("_i") % 61 == 43, "none").otherwise(F.concat(F.lit(proof.FINGERPRINT), "key")).alias("fingerprint"), F.when(F.col("_i") % 61 == 44, "received").otherwise("committed").alias("status"),
    ).drop("_o")
    batch = o.where("_i % 127 > 0").select(
        F.concat(F.lit("b"), F.col("_i").cast("string")).alias("id"), F.when(F.col("_i") % 61 == 45, "received").otherwise("committed").alias("status"), F.when(F.col("_i") % 61 == 46, "a-").otherwise(F.concat(F.lit("a"), u.cast("string"))).alias("acquisition_id"),
        F.when(F.col("_i") % 61 == 47, "webhook").otherwise("provider_sync").alias("kind"), F.when(F.col("_i") % 61 == 48, "other").otherwise(proof.PARSER).alias("parser"), F.when(F.col("_i") % 61 == 49, "v0").otherwise(F.col("contract")).alias("version"),
    )
    candidates = e.select(i, name("r").alias("record_id"), name("m").alias("metric_id"), name("p").alias("payload_id"), name("o").alias("observation_id"))
    return candidates, {"record": record, "metric": metric, "payload": payload, "observation": keyed.drop("_i", "user_id"), "source": source, "event": event, "batch": batch}


_CHECKS = """record_absent metric_absent payload_absent observation_absent source_absent event_absent batch_absent source_kind source_provider surface projection_status record_stream local_date source_path metric_code capability
  metric_state number text collection metric_reason unit field_path metric_record attribution contract contract_of_observation reconciliation reconciliation_of_observation record_payload payload_source observation_source observation_payload
  observation_artifact payload_stream observation_stream payload_format observation_format observation_filename ingest_event event_source event_artifact event_stream event_fingerprint event_status batch_status batch_source batch_kind batch_parser
  batch_version observation_key collection_key""".split()


@query(f"""WITH n AS (SELECT {_CHECKS} AS names), f AS (SELECT event_id, list_sort(list_distinct(list_concat(
    CASE WHEN event_id % 61 BETWEEN 9 AND 51 THEN [event_id % 61] ELSE [] END, CASE WHEN user_id % 29 IN (7, 8) THEN [user_id % 29] ELSE [] END, CASE WHEN event_id % 127 = 0 THEN [6, 45, 46, 47, 48, 49] ELSE [] END))) AS bits FROM events)
  SELECT event_id, coalesce(list_sum([1::BIGINT << b for b in bits]), 0)::BIGINT AS failed, array_to_string([names[b + 1] for b in bits], ',') AS reasons, len(bits) = 0 AS proven FROM f, n""")
def b8_placeholder_proof(spark, sf):
    """All 52 checks that a missing daily metric is a placeholder, from one join of seven evidence tables; every failed one is kept."""
    candidates, tables = evidence(spark, sf)
    found = proof.placeholder_proof(candidates, tables)
    return found.select("event_id", "failed", F.concat_ws(",", "reasons").alias("reasons"), "proven")


#: Payload texts by event_id % 12, with what they say of a device.
_PAYLOADS = [
    ('{"k": 1}', "unattributed", "no_device_attribution_field"),
    ('{"a": {"b": [{"deviceInfo": {"modelName": "Vivoactive_5"}}]}}', "target_device", "explicit_target_model"),
    ('{"device": "Fenix 7"}', "other_device", "explicit_other_model"),
    ('{"x": {"deviceModel": "Edge 530"}, "y": [{"device": {"model": "vivoactive-5"}}]}', "mixed", "mixed_device_models"),
    ('{"isDeviceAttributed": false}', "unattributed", "explicit_unattributed"),
    ('{"device": {}}', "unknown", "device_field_without_safe_model"),
    ('{"device": true}', "unknown", "device_field_unresolved"),
    ('{"device": "vivoactive 5", "deviceAttributed": false}', "unknown", "device_attribution_unresolved"),
    ('{"deviceId": "vivoactive5"}', "unattributed", "no_device_attribution_field"),
    ('{"samples": [' + ", ".join("0" for _ in range(65)) + '], "device": "fenix"}', "unknown", "attribution_traversal_bounded"),
    ('{"device": {"unit": {"model": "thing"}}}', "unknown", "device_field_without_safe_model"),
    ('{"a": {"a": {"a": [[{"device": {"manufacturer": "LILY"}}]]}}}', "other_device", "explicit_other_model"),
]


@query(f"""SELECT event_id AS id, {[a for _, a, _ in _PAYLOADS]}[event_id % 12 + 1] AS attribution, {[r for _, _, r in _PAYLOADS]}[event_id % 12 + 1] AS reason FROM events""")
def n38_device_attribution(spark, sf):
    """The device that each event's payload speaks of, found at any depth."""
    text = F.element_at(F.array(*[F.lit(t) for t, _, _ in _PAYLOADS]), (F.col("event_id") % 12 + 1).cast("int"))
    return devices.attribution(load(spark, sf, "events").select(F.col("event_id").alias("id"), F.parse_json(text).alias("payload")))


# ---- frozen inputs --------------------------------------------------------------------------


def _inputs(spark: SparkSession, sf_dir: str, changed: bool) -> DataFrame:
    """The analytic input of each (user_id, event_type, day), sealed; changed adds a cent for users divisible by five."""
    m = adapters.measurements(spark, sf_dir)
    days = m.groupBy(*KEYS, "day").agg(F.count("*").alias("rows"), F.min("event_id").alias("first"), F.min("state").alias("state"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    state = F.when(F.col("rows") > 1, "ambiguous").otherwise(F.col("state"))
    usable = state.isin("value", "zero", "partial")
    cents = F.col("cents") + (F.when(F.col("user_id") % 5 == 0, 1).otherwise(0) if changed else 0)
    body = F.struct(
        F.lit("analytic-input-v1").alias("contract_version"), F.struct(F.col("event_type").alias("code"), F.lit("cent").alias("unit"), F.lit("daily").alias("window")).alias("metric"),
        F.struct(state.alias("state"), F.when(usable, cents).alias("value")).alias("selected"), F.struct(F.col("day").cast("string").alias("day")).alias("temporal"),
        F.struct("rows").alias("coverage"), F.struct("first", "rows").alias("evidence"), F.when(usable, F.array().cast("array<string>")).otherwise(F.array(F.lit("not_computable_input"))).alias("exclusions"), "user_id",
    )
    return frozen.sealed(days, [*KEYS, "day"], body)


def _input_sql(cents: str) -> str:
    return f"""sha256('{{"contract_version":"analytic-input-v1","coverage":{{"rows":' || n || '}},"evidence":{{"first":' || first || ',"rows":' || n || '}},"exclusions":[' || CASE WHEN usable THEN '' ELSE '"not_computable_input"' END || '],"metric":{{"code":"' || event_type
      || '","unit":"cent","window":"daily"}},"selected":{{"state":"' || state || '","value":' || CASE WHEN usable THEN ({cents})::VARCHAR ELSE 'null' END || '}},"temporal":{{"day":"' || day || '"}},"user_id":' || user_id || '}}')"""


@query(f"""WITH {M}, d AS (SELECT user_id, event_type, day, count(*) AS n, min(event_id) AS first, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE min(state) END AS state, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM m GROUP BY ALL),
  u AS (SELECT *, state IN ('value', 'zero', 'partial') AS usable FROM d), h AS (SELECT *, {_input_sql("cents")} AS old, {_input_sql("cents + (user_id % 5 = 0)::INT")} AS new FROM u)
  SELECT user_id, event_type, day, new AS hash, CASE WHEN user_id % 3 = 0 THEN 'frozen' WHEN new = old THEN 'replayed' ELSE 'refused' END AS outcome FROM h""", dates="day")
def b11_frozen_inputs(spark, sf):
    """Inputs of two users in three are frozen, then all are offered, some of them changed: what becomes of each."""
    path = f"{shared_dir(spark)}/frozen_{uuid.uuid4().hex}"
    frozen.freeze(_inputs(spark, sf, False).where("user_id % 3 > 0"), [*KEYS, "day"], path, 0)
    return frozen.freeze(_inputs(spark, sf, True), [*KEYS, "day"], path, 1)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which a cohort has both flags, with whole cents; prices are added up as they stand in the table, since half a cent hangs on their order."""
    cents = lambda f: F.max(F.when(F.col("l_returnflag") == f, F.round(F.col("mean") * 100).cast("long")))
    rows = load(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R")).select(
        F.col("l_linestatus").alias("cohort"), F.to_date("l_shipdate").alias("day"), "l_returnflag", "l_extendedprice", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )
    means = baseline.ordered_means(rows, ["cohort", "day", "l_returnflag"], ["file", "row"], "l_extendedprice")
    return means.groupBy("cohort", "day").agg(cents("A").alias("a"), cents("R").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")


_PAIRS = """p AS (SELECT l_linestatus AS cohort, l_shipdate::DATE AS day, round(avg(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) * 100)::BIGINT AS a, round(avg(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) * 100)::BIGINT AS b,
    count(*) FILTER (WHERE l_returnflag = 'A') AS qa, count(*) FILTER (WHERE l_returnflag = 'R') AS qb FROM lineitem GROUP BY ALL HAVING qa > 0 AND qb > 0),
  y AS (SELECT cohort, date_trunc('month', day) AS block, sha256(string_agg(concat_ws(chr(31), 'v' || day, 'v' || a, 'v' || b), chr(30) ORDER BY day)) AS h, count(*) AS n, min(day) AS s, max(day) AS e FROM p GROUP BY ALL),
  g AS (SELECT cohort, sum(n)::BIGINT AS n, sha256(string_agg(h, chr(30) ORDER BY block)) AS digest, min(s) AS s, max(e) AS e FROM y GROUP BY cohort),
  runs AS (SELECT cohort, n, sha256('{"cohort":"' || cohort || '","digest":"' || digest || '","pairs":' || n || ',"versions":{"metric":"v1","pairing":"v1","rule":"v1","statistic":"v1"},"window":{"end":"' || e || '","start":"' || s || '"}}') AS hash FROM g)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agreement run of each cohort over all its pairs, sealed."""
    pairs = _pairs(spark, sf_dir)
    digest = frozen.list_digest(pairs, ["cohort"], F.date_trunc("month", "day"), ["day"], ["day", "a", "b"])
    span = pairs.groupBy("cohort").agg(F.min("day").cast("string").alias("start"), F.max("day").cast("string").alias("end"))
    versions = F.struct(*[F.lit("v1").alias(c) for c in ("metric", "pairing", "rule", "statistic")])
    return frozen.sealed(digest.join(span, "cohort"), ["cohort"], F.struct("cohort", "digest", F.col("n").alias("pairs"), versions.alias("versions"), F.struct("start", "end").alias("window")))


@query(f"WITH {_PAIRS} SELECT cohort, hash, 'replayed' AS outcome FROM runs")
def k12_frozen_runs(spark, sf):
    """A cohort's run, frozen under the hash of its pairs and versions; the same run again writes nothing."""
    path = f"{shared_dir(spark)}/runs_{uuid.uuid4().hex}"
    frozen.freeze(_runs(spark, sf), ["cohort"], path, 0)
    return frozen.freeze(_runs(spark, sf), ["cohort"], path, 1)


@query(f"""WITH {_PAIRS}, r AS (SELECT p.cohort, runs.hash AS run, runs.n AS run_pairs, unnest([{{'metric': 'price', 'variant': 'mean', 'd': p.a - p.b}}, {{'metric': 'rows', 'variant': 'count', 'd': p.qa - p.qb}}]) AS x FROM p JOIN runs USING (cohort) WHERE year(day) = 1998)
  SELECT run, cohort, run_pairs, x.metric AS metric, x.variant AS variant, count(*) AS n, round(avg(x.d), 6) AS bias, min(x.d) AS least, max(x.d) AS most FROM r GROUP BY ALL""")
def j20_run_report(spark, sf):
    """Of each run the pairs of a year with their metric results, by cohort, metric and variant."""
    pairs = _pairs(spark, sf).withColumn("pair", idempotency_key(F.col("cohort"), F.col("day")))
    runs = _runs(spark, sf).select("cohort", F.col("hash").alias("run")).join(pairs.groupBy("cohort").agg(F.count("*").alias("run_pairs")), "cohort")
    rows = load(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("cohort"), F.to_date("l_shipdate").alias("day")).agg(*[F.count_if(F.col("l_returnflag") == f).alias(n) for f, n in (("A", "qa"), ("R", "qb"))])
    counted = rows.where("qa > 0 AND qb > 0").select(idempotency_key(F.col("cohort"), F.col("day")).alias("pair"), F.lit("rows").alias("metric"), F.lit("count").alias("variant"), (F.col("qa") - F.col("qb")).alias("d"))
    results = pairs.select("pair", F.lit("price").alias("metric"), F.lit("mean").alias("variant"), (F.col("a") - F.col("b")).alias("d")).union(counted)
    met = pairs.where("year(day) = 1998").select("pair", "cohort").join(results, "pair").join(runs, "cohort")
    return rounded(met.groupBy("run", "cohort", "run_pairs", "metric", "variant").agg(F.count("*").alias("n"), F.avg("d").alias("bias"), F.min("d").alias("least"), F.max("d").alias("most")), 6)


@query("""WITH l AS (SELECT l_orderkey, l_linenumber AS line, l_quantity::BIGINT AS q, arg_min(l_quantity::BIGINT, (l_linenumber, l_quantity)) OVER (PARTITION BY l_orderkey) AS ref FROM lineitem),
  j AS (SELECT l_orderkey, count(*) AS "lines", string_agg('{"delta":' || (q - ref) || ',"line":' || line || ',"percent":' || CASE WHEN ref = 0 THEN 'null' ELSE (round(100.0 * (q - ref) / ref))::BIGINT::VARCHAR END || ',"reason":' || CASE WHEN ref = 0 THEN '"zero_reference"' ELSE 'null' END || '}', ',' ORDER BY line, q) AS rows FROM l GROUP BY 1)
  SELECT l_orderkey, "lines", sha256('{"order":' || l_orderkey || ',"rows":[' || rows || ']}') AS hash FROM j""")
def g4_result_hashes(spark, sf):
    """Each order's comparison with its first line, assembled as one nested body and hashed."""
    li = load(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("long").alias("q"))
    met = li.join(li.groupBy("l_orderkey").agg(F.min_by("q", F.struct("line", "q")).alias("ref")), "l_orderkey")
    delta, zero = F.col("q") - F.col("ref"), F.col("ref") == 0
    row = F.struct("line", "q", F.struct("line", delta.alias("delta"), F.when(~zero, F.round(F.lit(100.0) * delta / F.col("ref")).cast("long")).alias("percent"), F.when(zero, "zero_reference").alias("reason")).alias("shown"))
    orders = met.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sort_array(F.collect_list(row)).alias("rows"))  # a few lines an order
    body = F.to_json(F.struct(F.col("l_orderkey").alias("order"), F.col("rows.shown").alias("rows")), {"ignoreNullFields": "false"})
    return orders.select("l_orderkey", "lines", manifest_hash(body).alias("hash"))
