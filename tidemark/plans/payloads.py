"""Queries of the payload normalisers. Payload texts are written from events; the oracles say what must come out from the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions import idempotency_key
from tidemark.operators import clock, payload
from tidemark.operators.payload import Spec
from tidemark.plans import adapters
from tidemark.plans.adapters import M
from tidemark.plans.registry import query, rounded
from tidemark.session import load



def E() -> Column:  # noqa: N802  columns can only be made while a session is up
    return F.col("event_id")


def K() -> Column:  # noqa: N802
    return F.col("k")


def measured(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.measurements(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))


def token(n: int, *tokens: Column | str | None) -> Column:
    """The JSON token of an event by event_id modulo n; None leaves the field out."""
    out = F.lit(None).cast("string")
    for i, t in enumerate(tokens):
        if t is not None:
            out = F.when(E() % n == i, F.lit(t) if isinstance(t, str) else t.cast("string")).otherwise(out)
    return out


def json_object(**fields: Column) -> Column:
    parts = [F.concat(F.lit(f'"{name}":'), t) for name, t in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def provider_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """events with a provider payload each: fields that are missing, null, of the wrong shape or good, by event_id."""
    m = measured(spark, sf)
    quoted = F.concat(F.lit('"'), K(), F.lit('"'))
    text = json_object(
        heartRate=token(8, None, "null", quoted, "true", '{"v":1}', K(), F.col("value"), F.concat(F.lit("-"), K())),
        hr=F.when(E() % 24 == 0, F.concat(F.lit('{"value":'), K(), F.lit("}"))),
        device=token(5, None, "null", '{"id":"  d7 "}', '{"id":7}', '{"id":""}'),
        note=token(4, None, '""', '" n "', "5"),
        score=token(6, '"GOOD"', K(), "false", None, '""', "[1]"),
        extra=F.when(E() % 6 == 0, F.lit("1")),
        other=F.when(E() % 10 == 0, F.lit("[1]")),
    )
    return m.withColumn("payload", F.when(E() % 97 == 0, F.lit("{not json")).otherwise(text))


SPECS = [
    Spec("heart_rate_bpm", ("heartRate", "hr.value"), "number", "bpm", least=0.0, low_reason="negative_value"),
    Spec("device", ("device.id",), "identifier"),
    Spec("note", ("note",), "text"),
    Spec("score", ("score",), "number_or_text"),
]

#: What scalar typing must find for each metric of an event, from its id alone.
_N1 = f"""{M}, x AS (SELECT event_id, value, k, event_id % 97 = 0 AS broken FROM m), metrics AS (
  SELECT event_id, 'heart_rate_bpm' AS metric, 'bpm' AS unit,
    CASE WHEN broken THEN 'missing' WHEN event_id % 8 = 0 THEN CASE WHEN event_id % 24 = 0 THEN 'value' ELSE 'missing' END WHEN event_id % 8 = 1 THEN 'null' WHEN event_id % 8 IN (5, 6) THEN 'value' WHEN event_id % 8 = 7 AND k = 0 THEN 'value' ELSE 'invalid' END AS state,
    CASE WHEN broken THEN NULL WHEN event_id % 24 = 0 OR event_id % 8 = 5 THEN k WHEN event_id % 8 = 6 THEN value WHEN event_id % 8 = 7 AND k = 0 THEN 0 END::DOUBLE AS number, NULL::VARCHAR AS text,
    CASE WHEN broken THEN NULL WHEN event_id % 8 = 2 THEN 'numeric_string_not_coerced' WHEN event_id % 8 = 3 THEN 'boolean_not_numeric' WHEN event_id % 8 = 4 THEN 'shape_drift' WHEN event_id % 8 = 7 AND k > 0 THEN 'negative_value' END AS reason,
    CASE WHEN broken THEN NULL WHEN event_id % 8 > 0 THEN 'heartRate' WHEN event_id % 24 = 0 THEN 'hr.value' END AS path FROM x
  UNION ALL SELECT event_id, 'device', NULL, CASE WHEN broken OR event_id % 5 < 2 THEN 'missing' WHEN event_id % 5 = 4 THEN 'invalid' ELSE 'value' END, NULL,
    CASE WHEN broken THEN NULL WHEN event_id % 5 = 2 THEN 'd7' WHEN event_id % 5 = 3 THEN '7' END, CASE WHEN NOT broken AND event_id % 5 = 4 THEN 'shape_drift' END, CASE WHEN NOT broken AND event_id % 5 > 1 THEN 'device.id' END FROM x
  UNION ALL SELECT event_id, 'note', NULL, CASE WHEN broken OR event_id % 4 = 0 THEN 'missing' WHEN event_id % 4 = 2 THEN 'value' ELSE 'invalid' END, NULL,
    CASE WHEN NOT broken AND event_id % 4 = 2 THEN 'n' END, CASE WHEN broken THEN NULL WHEN event_id % 4 = 1 THEN 'empty_text' WHEN event_id % 4 = 3 THEN 'shape_drift' END, CASE WHEN NOT broken AND event_id % 4 > 0 THEN 'note' END FROM x
  UNION ALL SELECT event_id, 'score', NULL, CASE WHEN broken OR event_id % 6 = 3 THEN 'missing' WHEN event_id % 6 IN (0, 1) THEN 'value' ELSE 'invalid' END, CASE WHEN NOT broken AND event_id % 6 = 1 THEN k END,
    CASE WHEN NOT broken AND event_id % 6 = 0 THEN 'GOOD' END,
    CASE WHEN broken THEN NULL WHEN event_id % 6 = 2 THEN 'boolean_not_numeric' WHEN event_id % 6 = 4 THEN 'numeric_string_not_coerced' WHEN event_id % 6 = 5 THEN 'shape_drift' END, CASE WHEN NOT broken AND event_id % 6 <> 3 THEN 'score' END FROM x)"""


def _normalized(spark, sf):
    return payload.normalize(provider_payloads(spark, sf), ["event_id"], "payload", SPECS)


@query(f"WITH {_N1} SELECT event_id, metric, unit, state, round(number, 7) AS number, text, reason, path FROM metrics")
def n1_normalized_metrics(spark, sf):
    return rounded(_normalized(spark, sf))


@query(f"WITH {_N1} SELECT metric, path, count(*) AS n, count(*) FILTER (WHERE state = 'null') AS nulls FROM metrics GROUP BY metric, path")
def n2_first_present_paths(spark, sf):
    return _normalized(spark, sf).groupBy("metric", "path").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "null").alias("nulls"))


@query(f"WITH {_N1} SELECT metric, state, reason, count(*) AS n FROM metrics GROUP BY metric, state, reason")
def n4_scalar_states(spark, sf):
    return _normalized(spark, sf).groupBy("metric", "state", "reason").count().withColumnRenamed("count", "n")


@query(f"""WITH {M} SELECT event_id, CASE WHEN event_type = 'click' THEN 'heart_rate_bpm' ELSE 'pulse' END AS metric FROM m WHERE event_id % 97 <> 0 AND event_type IN ('click', 'view') AND event_id % 8 > 0
  UNION ALL SELECT event_id, 'score' FROM m WHERE event_id % 97 <> 0 AND event_type = 'click' AND event_id % 6 <> 3""")
def n5_selected_specs(spark, sf):
    rules = [("click", "heart_rate_bpm", "heartRate"), ("view", "pulse", "heartRate"), ("click", "score", "score"), ("error", "never", "absent")]
    registry = spark.createDataFrame(rules, "stream string, metric string, field string")
    return payload.selected_specs(provider_payloads(spark, sf).withColumnRenamed("event_type", "stream"), registry, ["event_id"], "payload")


@query(f"""WITH {M} SELECT event_id, array_to_string(list_filter(['extra', 'other'], lambda x: (x = 'extra' AND event_id % 6 = 0) OR (x = 'other' AND event_id % 10 = 0)), ',') AS unknown
  FROM m WHERE event_id % 97 <> 0 AND (event_id % 6 = 0 OR event_id % 10 = 0)""")
def n15_unknown_fields(spark, sf):
    found = payload.unknown_fields(F.col("payload"), ["heartRate", "hr", "device", "note", "score"])
    return provider_payloads(spark, sf).select("event_id", found.alias("u")).where("size(u) > 0").select("event_id", F.array_join("u", ",").alias("unknown"))


@query(f"""WITH {_N1}, r AS (SELECT event_id, count(*) FILTER (WHERE state = 'value') AS v, count(*) FILTER (WHERE state = 'invalid') AS i FROM metrics GROUP BY event_id)
  SELECT event_id, v AS "values", i AS invalid, CASE WHEN v = 0 AND i > 0 THEN 'invalid' WHEN i > 0 THEN 'partial' WHEN v = 0 THEN 'empty' ELSE 'ok' END AS status FROM r""")
def n14_record_status(spark, sf):
    return payload.record_status(_normalized(spark, sf), ["event_id"])


@query(f"""WITH {M}, r AS (SELECT user_id, day, CASE WHEN k % 3 > 0 THEN CASE WHEN k % 10 < 7 THEN 'ok' WHEN k % 10 < 9 THEN 'partial' ELSE 'invalid' END END AS s,
    CASE WHEN k % 13 = 0 THEN 'error' WHEN k % 13 = 1 THEN 'warning' END AS d, k % 29 = 5 AS blank FROM m),
  g AS (SELECT user_id, day, count(s) AS n, count(*) FILTER (WHERE s = 'invalid') AS bad, coalesce(bool_or(s = 'partial'), false) AS part, coalesce(bool_or(d = 'error'), false) AS err, coalesce(bool_or(d IS NOT NULL), false) AS diag, bool_or(blank) AS blank FROM r GROUP BY ALL)
  SELECT user_id, day, n AS records, CASE WHEN n = 0 THEN CASE WHEN err THEN 'invalid' ELSE 'empty' END WHEN bad = n THEN 'invalid' WHEN bad > 0 OR part OR diag THEN 'partial' WHEN blank THEN 'empty' ELSE 'ok' END AS status FROM g""", dates="day")
def n14_payload_status(spark, sf):
    rows = measured(spark, sf).select(
        "user_id", "day", F.when(K() % 3 > 0, F.when(K() % 10 < 7, "ok").when(K() % 10 < 9, "partial").otherwise("invalid")).alias("status"),
        F.when(K() % 13 == 0, "error").when(K() % 13 == 1, "warning").alias("severity"), (K() % 29 == 5).alias("blank"),
    )
    return payload.payload_status(rows, ["user_id", "day"])


def _lists(spark, sf) -> DataFrame:
    """A payload for each user and day: its events as activities, as samples, and as described samples."""
    m = measured(spark, sf)
    first = F.col("user_id") % 2 == 0  # which of the two columns comes first
    rows = m.select(
        "user_id", "day", E(), F.struct(E(), json_object(id=E().cast("string"), type=F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))).alias("a"),
        F.struct(E(), F.when(E() % 11 == 3, F.lit('["x"]')).otherwise(F.concat(F.lit("["), F.unix_millis("ts"), F.lit(","), K(), F.lit("]")))).alias("s"),
        F.struct(E(), F.concat(F.lit("["), F.unix_millis("ts"), F.lit(","), F.when(first, K()).otherwise(E() % 50), F.lit(","), F.when(first, E() % 50).otherwise(K()), F.lit("]"))).alias("d"),
    )
    of = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["col2"]), ","), F.lit("]"))
    names = F.when(first, F.lit('[{"key":"stress","index":1},{"key":"battery","index":2}]')).otherwise(F.lit('[{"key":"battery","index":1},{"key":"stress","index":2}]'))
    made = rows.groupBy("user_id", "day").agg(of("a").alias("a"), of("s").alias("s"), of("d").alias("d"))
    none = F.col("user_id") % 10 == 4
    return made.select("user_id", "day", F.when(none, F.lit("{}")).otherwise(json_object(activities=F.col("a"), values=F.col("s"), descriptors=names, described=F.col("d"))).alias("payload"))


_NUMBERED = f"{M}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id)::INT - 1 AS ordinal FROM m)"


@query(f"""WITH {_NUMBERED} SELECT user_id, day, ordinal, event_id AS id, event_type AS type FROM o WHERE user_id % 10 <> 4
  UNION ALL SELECT DISTINCT user_id, day, NULL, NULL, NULL FROM o WHERE user_id % 10 = 4""", dates="day")
def n6_activity_lists(spark, sf):
    found = payload.listed(_lists(spark, sf), ["user_id", "day"], "payload", "activities", "struct<id:bigint,type:string>")
    return found.select("user_id", "day", "ordinal", "item.id", "item.type")


@query(f"""WITH {_NUMBERED} SELECT user_id, day, ordinal, CASE WHEN event_id % 11 <> 3 THEN epoch_ms(date_trunc('millisecond', ts)) END AS ms, CASE WHEN event_id % 11 <> 3 THEN k END::DOUBLE AS value,
  CASE WHEN event_id % 11 = 3 THEN 'malformed_sample' END AS reason FROM o WHERE user_id % 10 <> 4""", dates="day")
def n7_sample_lists(spark, sf):
    found = payload.samples(_lists(spark, sf), ["user_id", "day"], "payload", "values")
    return found.select("user_id", "day", "ordinal", F.unix_millis("ts").alias("ms"), "value", "reason")


@query(f"WITH {_NUMBERED} SELECT user_id, day, ordinal, k::DOUBLE AS stress, (event_id % 50)::DOUBLE AS battery FROM o WHERE user_id % 10 <> 4", dates="day")
def n8_described_samples(spark, sf):
    return payload.described_samples(_lists(spark, sf), ["user_id", "day"], "payload", "descriptors", "described", ["stress", "battery"])


#: Stage names of activity levels (fixed values); others are unmapped.
LEVELS = {0: "DEEP", 1: "LIGHT", 2: "REM", 3: "AWAKE"}
_PARTS = f"""{M}, parts AS (SELECT user_id, day, row_number() OVER w - 1 AS ordinal, ts AS s, coalesce(lead(ts) OVER w, ts + INTERVAL 10 MINUTES) AS e,
  CASE WHEN k % 9 < 4 THEN ['DEEP', 'LIGHT', 'REM', 'AWAKE'][k % 9 + 1] WHEN k % 9 < 8 THEN 'LIGHT' END AS stage FROM m WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id))"""


def stage_parts(spark, sf) -> DataFrame:
    """A night of stages for each user and day, one from each event to the next; level 4 is unmapped."""
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    level = F.when(K() % 9 < 4, K() % 9).when(K() % 9 < 8, F.lit(1)).otherwise(F.lit(4))
    ends = F.coalesce(F.lead("ts").over(w), F.col("ts") + F.expr("interval 10 minutes"))
    rows = measured(spark, sf).select("user_id", "day", (F.row_number().over(w) - 1).alias("ordinal"), F.col("ts").alias("start_ts"), ends.alias("end_ts"), level.alias("level"))
    return rows.withColumn("stage", F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.col("level")))


@query(f"""WITH {_PARTS}, g AS (SELECT user_id, day, bool_or(stage IS NULL) AS unmapped, bool_or(e <= s) AS bad, {', '.join(f"sum(CASE WHEN stage = '{x}' THEN epoch_us(e) - epoch_us(s) ELSE 0 END) / 1000000.0 AS {x.lower()}" for x in LEVELS.values())} FROM parts GROUP BY ALL)
  SELECT user_id, day, {', '.join(f"CASE WHEN NOT unmapped AND NOT bad THEN round({x.lower()}, 3) END AS {x.lower()}" for x in LEVELS.values())}, CASE WHEN unmapped THEN 'unmapped_stage' WHEN bad THEN 'end_not_after_start' END AS reason FROM g""", dates="day")
def z2_stage_seconds(spark, sf):
    return rounded(clock.stage_seconds(stage_parts(spark, sf), ["user_id", "day"], list(LEVELS.values())), 3)


_TEXTS = f"""{M}, t AS (SELECT event_id, ts, day, event_id % 7 AS kind, date_trunc('second', ts) AS sec FROM m)"""


def _time_texts(spark, sf) -> DataFrame:
    at = lambda f: F.date_format("ts", f)
    day = F.date_format("ts", "yyyy-MM-dd")
    text = token(7, day, F.concat(at("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")), F.concat(at("yyyy-MM-dd HH:mm:ss"), F.lit("+02:00")), at("yyyy-MM-dd'T'HH:mm:ss"), "2024-02-31", "yesterday", None)
    return measured(spark, sf).withColumn("text", text)


@query(f"""WITH {_TEXTS} SELECT event_id, CASE kind WHEN 0 THEN 'date' WHEN 1 THEN 'instant' WHEN 2 THEN 'instant' WHEN 3 THEN 'local' ELSE 'unknown' END AS precision, CASE WHEN kind < 4 THEN day END AS date,
  CASE kind WHEN 1 THEN epoch_ms(sec) WHEN 2 THEN epoch_ms(sec - INTERVAL 2 HOURS) END AS instant_ms, CASE kind WHEN 1 THEN 0 WHEN 2 THEN 120 END::INT AS offset_minutes, CASE WHEN kind IN (4, 5) THEN 'invalid_time' END AS reason FROM t""", dates="date")
def n11_times(spark, sf):
    t = payload.temporal(F.col("text"))
    return _time_texts(spark, sf).select("event_id", t.alias("t")).select("event_id", "t.precision", "t.date", F.unix_millis("t.instant").alias("instant_ms"), "t.offset_minutes", "t.reason")


@query(f"""WITH {M}, x AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN ts END AS u, CASE WHEN event_id % 3 <> 0 THEN ts + to_minutes((event_id % 2)::INT) END AS l, CASE WHEN event_id % 5 = 0 THEN DATE '2024-03-01' END AS c FROM m)
  SELECT event_id, epoch_us(coalesce(u, l)) AS instant_us, coalesce(c, l::DATE, u::DATE) AS date, CASE WHEN u <> l THEN 'paired_time_mismatch' END AS reason FROM x""", dates="date")
def n12_paired_times(spark, sf):
    m = measured(spark, sf)
    u = F.when(E() % 4 != 0, F.col("ts"))
    local = F.when(E() % 3 != 0, F.when(E() % 2 == 0, F.col("ts")).otherwise(F.timestamp_micros(F.unix_micros("ts") + 60_000_000)))
    t = payload.paired_times(u, local, F.when(E() % 5 == 0, F.lit("2024-03-01").cast("date")))
    return m.select("event_id", t.alias("t")).select("event_id", F.unix_micros("t.instant").alias("instant_us"), "t.date", "t.reason")


@query(f"""WITH {M}, x AS (SELECT event_id, epoch_ms(ts) AS g, epoch_ms(ts) + CASE event_id % 5 WHEN 0 THEN 7200000 WHEN 1 THEN -19800000 WHEN 2 THEN 1234 WHEN 3 THEN 90000000 END AS l FROM m)
  SELECT event_id, CASE WHEN event_id % 5 < 2 THEN (l - g) // 60000 END::INT AS offset_minutes, CASE event_id % 5 WHEN 4 THEN 'missing_time' WHEN 2 THEN 'implausible_offset' WHEN 3 THEN 'implausible_offset' END AS reason FROM x""")
def n12b_epoch_offsets(spark, sf):
    g = F.unix_millis("ts")
    t = payload.epoch_pair_offset(g, g + token(5, "7200000", "-19800000", "1234", "90000000", None).cast("long"))
    return measured(spark, sf).select("event_id", t.alias("t")).select("event_id", "t.*")


@query(f"""WITH {M} SELECT event_id, CASE WHEN event_id % 6 IN (0, 1) THEN day END AS date, CASE event_id % 6 WHEN 2 THEN 'conflicting_dates' WHEN 3 THEN 'invalid_date' WHEN 4 THEN 'missing_date' WHEN 5 THEN 'invalid_date' END AS reason FROM m""", dates="date")
def n13_agreed_dates(spark, sf):
    day = F.date_format("ts", "yyyy-MM-dd")
    t = payload.agreed_date([token(6, day, day, day, "2024-13-01", None, day), token(6, None, day, "1999-01-01", None, None, "20240101")])
    return measured(spark, sf).select("event_id", t.alias("t")).select("event_id", "t.*")


_QUALITY = ["heart_rate_bpm", "duration_seconds", "aerobic_training_effect", "training_readiness", "training_load", "other_metric"]
_QUALITY_SQL = f"""{M}, q AS (SELECT event_id, {_QUALITY}[event_id % 6 + 1] AS metric, (k - 20)::DOUBLE AS v, event_id % 41 = 0 AS nan FROM m)"""


@query(f"""WITH {_QUALITY_SQL} SELECT event_id, metric, CASE WHEN nan THEN 'non_finite_value' WHEN event_id % 6 = 0 AND v <= 0 THEN 'nonpositive_heart_rate' WHEN event_id % 6 = 1 AND v < 0 THEN 'negative_activity_summary'
  WHEN event_id % 6 = 2 AND (v < 0 OR v > 5) THEN 'training_effect_out_of_range' WHEN event_id % 6 = 3 AND (v < 1 OR v > 100) THEN 'readiness_out_of_range' WHEN event_id % 6 = 4 AND v < 0 THEN 'negative_training_quantity' END AS reason FROM q""")
def n16_metric_quality(spark, sf):
    metric = F.element_at(F.array(*[F.lit(x) for x in _QUALITY]), (E() % 6 + 1).cast("int"))
    value = F.when(E() % 41 == 0, F.lit(float("nan"))).otherwise((K() - 20).cast("double"))
    return measured(spark, sf).select("event_id", metric.alias("metric"), payload.activity_quality(metric, value).alias("reason"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS a, max(l_discount) * 400 AS b, max(l_tax) * 1000 - 10 AS c, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE max(l_quantity) END AS d FROM lineitem GROUP BY l_orderkey, l_linenumber),
  r AS (SELECT *, l_linenumber % 4 <> 1 AND b > 0 AND a > b AS over, c < 0 AS neg, l_linenumber % 5 <> 2 AND c > 0 AND d = 0 AS still FROM v)
  SELECT l_orderkey, l_linenumber, metric, CASE WHEN reason IS NULL THEN 'value' ELSE 'invalid' END AS state, CASE WHEN reason IS NULL THEN round(x, 7) END AS value, reason FROM (
    SELECT l_orderkey, l_linenumber, 'heart_rate_bpm' AS metric, a AS x, CASE WHEN over THEN 'average_exceeds_peak_heart_rate' END AS reason FROM r
    UNION ALL SELECT l_orderkey, l_linenumber, 'max_heart_rate_bpm', b, CASE WHEN b <= 0 THEN 'nonpositive_heart_rate' WHEN over THEN 'average_exceeds_peak_heart_rate' END FROM r
    UNION ALL SELECT l_orderkey, l_linenumber, 'distance_meters', c, CASE WHEN neg THEN 'negative_activity_summary' WHEN still THEN 'positive_distance_with_zero_duration' END FROM r
    UNION ALL SELECT l_orderkey, l_linenumber, 'duration_seconds', d, CASE WHEN still THEN 'positive_distance_with_zero_duration' END FROM r)""")
def n17_cross_checked_metrics(spark, sf):
    """Averages and peaks of one parent path check each other, as do distances and durations; other paths or units do not."""
    n = F.col("l_linenumber")
    one = lambda metric, value, unit, path: F.struct(F.lit(metric).alias("metric"), F.lit("value").alias("state"), value.cast("double").alias("value"), unit.alias("unit"), path.alias("path"))
    most = [F.max(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax")]
    rows = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*most).select(
        "l_orderkey", "l_linenumber",
        F.explode(
            F.array(
                one("heart_rate_bpm", F.col("l_quantity"), F.lit("bpm"), F.when(n % 4 == 1, "summary.nested.averageHR").otherwise("summary.averageHR")),
                one("max_heart_rate_bpm", F.col("l_discount") * 400, F.lit("bpm"), F.lit("summary.maxHR")),
                one("distance_meters", F.col("l_tax") * 1000 - 10, F.when(n % 5 == 2, "miles").otherwise("meters"), F.lit("summary.distance")),
                one("duration_seconds", F.when(n % 3 == 0, F.lit(0.0)).otherwise(F.col("l_quantity")), F.lit("seconds"), F.lit("summary.duration")),
            )
        ).alias("m"),
    )
    return rounded(payload.cross_checked(rows.select("l_orderkey", "l_linenumber", "m.*"), ["l_orderkey", "l_linenumber"]))


@query(f"""WITH {M}, x AS (SELECT event_id, day, k, event_id % 6 AS c FROM m) SELECT event_id, CASE WHEN c = 0 THEN day END AS day, CASE WHEN c = 0 THEN k END::BIGINT AS steps,
  CASE c WHEN 1 THEN 'invalid_civil_date' WHEN 2 THEN 'not_midnight' WHEN 3 THEN 'not_one_day' WHEN 4 THEN 'invalid_count' WHEN 5 THEN 'invalid_count' END AS reason FROM x""", dates="day")
def n22_rolled_up_days(spark, sf):
    number = lambda c: F.concat(F.lit('{"date":{"year":'), F.year(c), F.lit(',"month":'), F.month(c), F.lit(',"day":'), F.day(c), F.lit("}"))
    start = F.when(E() % 6 == 1, F.lit('{"date":{"year":2023,"month":2,"day":29}}')).otherwise(F.concat(number("day"), F.when(E() % 6 == 2, F.lit(',"time":{"hours":3}}')).otherwise(F.lit("}"))))
    end = F.concat(number(F.date_add("day", F.when(E() % 6 == 3, 2).otherwise(1))), F.lit("}"))
    count = F.when(E() % 6 == 4, F.concat(F.lit('"0'), K(), F.lit('"'))).when(E() % 6 == 5, F.lit('"1.5"')).otherwise(F.concat(F.lit('"'), K(), F.lit('"')))
    text = F.concat(F.lit('{"rollupDataPoints":['), json_object(civilStartTime=start, civilEndTime=end, steps=json_object(countSum=count)), F.lit("]}"))
    return payload.rolled_up_days(measured(spark, sf).select("event_id", text.alias("payload")), ["event_id"], "payload").select("event_id", "day", "steps", "reason")


@query(f"""WITH {M}, g AS (SELECT user_id, day, bool_or(k % 10 = 3) AS bad FROM m GROUP BY ALL) SELECT user_id, day, event_id FROM m JOIN g USING (user_id, day) WHERE NOT bad""", dates="day")
def n23_whole_pages(spark, sf):
    return payload.whole_pages(measured(spark, sf), ["user_id", "day"], K() % 10 == 3).select("user_id", "day", "event_id")


@query(f"""WITH {_TEXTS}, p AS (SELECT event_id, ['imprecise', 'value', 'value', 'imprecise', 'invalid', 'invalid', 'missing'][kind + 1] AS start_state, event_id % 3 AS late, kind, sec FROM t)
  SELECT event_id, start_state, CASE WHEN late = 2 THEN 'missing' ELSE 'value' END AS end_state,
  CASE WHEN start_state <> 'value' OR late = 2 THEN 'endpoint_unavailable' WHEN late = 1 AND kind = 1 THEN 'end_not_after_start' WHEN late = 1 AND kind = 2 THEN NULL END AS reason FROM p""")
def n26_interval_states(spark, sf):
    rows = _time_texts(spark, sf)
    at = lambda hours: F.concat(F.date_format(F.timestamp_micros(F.unix_micros("ts") + hours * 3_600_000_000), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    end = F.when(E() % 3 == 0, at(8)).when(E() % 3 == 1, at(-1))
    return rows.select("event_id", payload.interval_states(payload.temporal(F.col("text")), payload.temporal(end)).alias("i")).select("event_id", "i.*")


@query(f"""WITH {M} SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'main' WHEN 1 THEN 'nap' WHEN 4 THEN 'main' ELSE 'uncertain' END AS role FROM m""")
def n27_session_roles(spark, sf):
    text = json_object(metadata=json_object(main=token(6, "true", "false", "true", None, "true", "null"), nap=token(6, None, "true", "true", None, "false", None)))
    flag = lambda name: F.try_variant_get(F.try_parse_json(text), f"$.metadata.{name}", "boolean")
    return measured(spark, sf).select("event_id", payload.session_role(flag("main"), flag("nap")).alias("role"))


@query(f"""WITH {M}, d AS (SELECT DISTINCT user_id, day, k // 20 AS slot, k % 4 AS sig FROM m) SELECT user_id, day, slot::INT AS slot, sig, CASE WHEN count(*) OVER (PARTITION BY user_id, day, slot) > 1 THEN 'identity_conflict' END AS reason FROM d""", dates="day")
def n28_identity_conflicts(spark, sf):
    rows = measured(spark, sf).select("user_id", "day", F.floor(K() / 20).cast("int").alias("slot"), (K() % 4).alias("sig"))
    return payload.identity_conflicts(rows, ["user_id", "day", "slot"], ["sig"])


def _webhooks(spark, sf) -> DataFrame:
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    day = quote(F.date_format("ts", "yyyy-MM-dd"))
    event = token(7, '"insert"', '"update"', '"delete"', '"clear"', '"test"', '"merge"', None)
    weight = token(6, K(), "0", "null", None, quote(K()), F.concat(F.lit("-"), K()))
    values = F.when(E() % 4 == 0, F.lit("[]"))
    item = json_object(id=F.when(E() % 3 > 0, quote(E().cast("string"))), date=F.when(E() % 5 > 0, day), weight=weight, values=values)
    single = json_object(event=event, id=F.when(E() % 3 > 0, quote(E().cast("string"))), date=F.when(E() % 5 > 0, day), weight=weight, values=values)
    batch = json_object(event=event, measurements=F.concat(F.lit("["), item, F.lit(","), item, F.lit("]")))
    return measured(spark, sf).withColumn("payload", F.when(E() % 2 == 0, batch).otherwise(single))


_WEBHOOKS = f"""{M}, w AS (SELECT *, ['insert', 'update', 'delete', 'clear', 'test', 'merge'][event_id % 7 + 1] AS event, ['upsert', 'upsert', 'delete', 'clear', 'ledger_only'][event_id % 7 + 1] AS action,
    CASE WHEN event_id % 3 > 0 THEN event_id::VARCHAR END AS record_id, CASE WHEN event_id % 5 > 0 THEN strftime(ts, '%Y-%m-%d') END AS date FROM m),
  i AS (SELECT w.*, ordinal FROM w, (SELECT unnest([0, 1]) AS ordinal) WHERE event_id % 2 = 0 OR ordinal = 0)"""


@query(f"""WITH {_WEBHOOKS} SELECT event_id, ordinal, event, action, record_id, date,
  CASE WHEN event IS NULL THEN 'missing_event' WHEN action IS NULL THEN 'unknown_event' WHEN action = 'delete' AND record_id IS NULL AND date IS NULL THEN 'delete_without_identity' WHEN action = 'upsert' AND date IS NULL THEN 'missing_date' END AS reason FROM i""")
def n29_webhook_items(spark, sf):
    return payload.envelopes(_webhooks(spark, sf), ["event_id"], "payload").select("event_id", "ordinal", "event", "action", "record_id", "date", "reason")


@query(f"""WITH {_WEBHOOKS}, c AS (SELECT *, event_id % 6 AS t FROM i) SELECT event_id, ordinal,
  CASE WHEN event_id % 4 = 0 THEN 'superseded' WHEN t IN (1, 2, 3) OR (t IN (0, 5) AND k = 0) THEN 'missing' WHEN t = 0 THEN 'value' ELSE 'invalid' END AS state, CASE WHEN event_id % 4 <> 0 AND t = 0 AND k > 0 THEN k END::DOUBLE AS value,
  CASE WHEN event_id % 4 = 0 THEN NULL WHEN t = 4 THEN 'numeric_string_not_coerced' WHEN t = 5 AND k > 0 THEN 'negative_weight' END AS reason FROM c""")
def n31_convenience_weights(spark, sf):
    items = payload.envelopes(_webhooks(spark, sf), ["event_id"], "payload")
    return items.select("event_id", "ordinal", payload.convenience_weight(F.col("values"), F.col("weight")).alias("w")).select("event_id", "ordinal", "w.*")


#: (key, unit) of measured values and their canonical metric (fixed values).
UNITS = [("WEIGHT", "KG", "weight"), ("FAT", "PERCENT", "body_fat"), ("MUSCLE", "KG", "muscle_mass"), ("MUSCLE", "PERCENT", "muscle_share")]


@query(f"""WITH {M}, v AS (SELECT event_id, ['WEIGHT', 'FAT', 'MUSCLE', 'BONE'][event_id % 4 + 1] AS key, ['KG', 'PERCENT', 'LB'][event_id % 3 + 1] AS unit, value FROM m),
  u(key, unit, metric) AS (VALUES {', '.join(str(x) for x in UNITS)}) SELECT event_id, v.key, v.unit, value, metric, CASE WHEN metric IS NULL THEN 'unknown' ELSE 'mapped' END AS state FROM v LEFT JOIN u ON u.key = v.key AND u.unit = v.unit""")
def n30_mapped_units(spark, sf):
    of = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (E() % n + 1).cast("int"))
    values = measured(spark, sf).select("event_id", of(["WEIGHT", "FAT", "MUSCLE", "BONE"], 4).alias("key"), of(["KG", "PERCENT", "LB"], 3).alias("unit"), "value")
    return payload.mapped_units(values, spark.createDataFrame(UNITS, "key string, unit string, metric string")).select("event_id", "key", "unit", "value", "metric", "state")


@query(f"""WITH {_TEXTS} SELECT event_id, CASE kind WHEN 0 THEN 'date_only' WHEN 1 THEN 'instant' WHEN 2 THEN 'instant' WHEN 3 THEN 'naive_minute' ELSE 'invalid' END AS kind, CASE kind WHEN 3 THEN strftime(sec, '%Y-%m-%d %H:%M') END AS local_minute FROM t WHERE kind < 6""")
def n32_sender_times(spark, sf):
    t = payload.temporal(F.col("text"))
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("date", "date_only", "instant", "instant", "local", "naive_minute", "unknown", "invalid")]), t["precision"])
    minute = F.when(t["precision"] == "local", F.date_format(F.try_to_timestamp("text"), "yyyy-MM-dd HH:mm"))
    return _time_texts(spark, sf).where("text IS NOT NULL").select("event_id", kind.alias("kind"), minute.alias("local_minute"))


@query(f"""WITH {M} SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'missing_zone' WHEN event_id % 5 = 1 AND day <> (ts + INTERVAL 9 HOURS)::DATE THEN 'date_contradicts_instant' END AS reason FROM m""")
def n35_date_and_instant(spark, sf):
    zone = token(5, None, "Asia/Tokyo", "UTC", "UTC", "UTC")
    return measured(spark, sf).select("event_id", payload.date_matches_instant(F.col("day"), F.col("ts"), zone).alias("reason"))


@query(f"""WITH {M}, l AS (SELECT event_id, ['numeric', 'qualitative', 'unparsed', 'odd'][event_id % 4 + 1] AS kind, k % 2 = 0 AS d, k % 3 = 0 AS q FROM m)
  SELECT event_id, CASE kind WHEN 'numeric' THEN CASE WHEN NOT d OR q THEN 'numeric_needs_a_decimal_alone' END WHEN 'qualitative' THEN CASE WHEN NOT q OR d THEN 'qualitative_needs_words_alone' END
  WHEN 'unparsed' THEN CASE WHEN d OR q THEN 'unparsed_has_a_value' END ELSE 'unknown_kind' END AS reason FROM l""")
def n36_lab_rows(spark, sf):
    reason = payload.lab_row_reason(token(4, "numeric", "qualitative", "unparsed", "odd"), F.when(K() % 2 == 0, K()), F.when(K() % 3 == 0, F.lit("negative")))
    return measured(spark, sf).select("event_id", reason.alias("reason"))


@query(f"""WITH {M} SELECT CASE event_id % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'empty' WHEN 2 THEN 'present' WHEN 3 THEN 'null' WHEN 4 THEN 'unknown' WHEN 5 THEN 'missing' ELSE 'empty' END AS state, count(*) AS n FROM m GROUP BY 1""")
def n37_fanned_states(spark, sf):
    text = json_object(levels=token(7, None, "[]", '[{"v":null},{"v":3}]', '[{"v":null},{"v":null}]', '[{"v":null},{}]', "[{}]", '[{"v":""}]'))
    return measured(spark, sf).select(payload.fanned_state(F.try_parse_json(text), "levels[].v").alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query(f"""WITH {M} SELECT event_id, epoch_ms(date_trunc('second', ts)) AS instant_ms, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN (event_id % 1000) * 1000000 ELSE 123456789 END::INT AS nanos FROM m""")
def y29_nanosecond_keys(spark, sf):
    second = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    milli = F.lpad((E() % 1000).cast("string"), 3, "0")
    text = F.when(E() % 3 == 0, F.concat(second, F.lit("Z"))).when(E() % 3 == 1, F.concat(second, F.lit("."), milli, F.lit("Z"))).otherwise(F.concat(second, F.lit(".123456789Z")))
    return measured(spark, sf).select("event_id", payload.nanos(text).alias("n")).select("event_id", F.unix_millis("n.instant").alias("instant_ms"), "n.nanos")


@query(f"""WITH {M} SELECT user_id, event_type, count(DISTINCT day) AS keys, count(*) AS rows_seen FROM m GROUP BY ALL""")
def d6_collection_keys(spark, sf):
    """Records of one source, stream and window share a collection key."""
    m = measured(spark, sf)
    key = idempotency_key(F.col("user_id"), F.col("event_type"), F.lit("daily"), F.col("day"), F.date_add("day", 1))
    return m.withColumn("key", key).groupBy("user_id", "event_type").agg(F.count_distinct("key").alias("keys"), F.count("*").alias("rows_seen"))
