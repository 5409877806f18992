"""Queries of photo fields, stage lists, the combined persist and strict drafts. Fields and payloads are written from events; the oracles say what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.operators import drafts, intake
from tidemark.plans.adapters import M
from tidemark.plans.payloads import E, K, measured, stage_parts, token
from tidemark.plans.registry import query
from tidemark.session import load

_PHOTO = f"""{M}, f AS (SELECT event_id, ['weight', 'body_fat_pct', 'bone_mass', 'heart_rate'][event_id % 4 + 1] AS metric, ['kg', ' LBS ', 'percent', 'stone', '', NULL][event_id % 6 + 1] AS unit,
    CASE WHEN k % 3 > 0 THEN k / 80.0 END AS confidence, CASE WHEN event_id % 11 = 0 THEN day + 2 END AS fd, CASE WHEN event_id % 5 > 0 THEN CASE WHEN event_id % 8 = 0 THEN date_trunc('minute', ts) ELSE date_trunc('millisecond', ts) END END AS ft,
    [NULL, 'date', 'instant', ''][event_id % 3 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END + 1] AS fp, CASE WHEN event_id % 4 < 2 THEN day END AS gd, CASE WHEN event_id % 7 = 0 THEN date_trunc('millisecond', ts) END AS gt, CASE WHEN event_id % 9 = 0 THEN 'minute' END AS gp,
    CASE event_id % 13 WHEN 1 THEN 'Asia/Tokyo' WHEN 2 THEN 'Nowhere/None' END AS zone, CASE WHEN event_id % 13 = 0 THEN 540 END AS minutes FROM m),
  u AS (SELECT *, CASE WHEN unit = 'kg' THEN 'kg' WHEN unit = ' LBS ' THEN 'lb' WHEN unit = 'percent' THEN '%' WHEN unit = 'stone' THEN 'stone' END AS cu, coalesce(ft, gt) AS t FROM f),
  d AS (SELECT *, coalesce(fd, gd, t::DATE) AS sd FROM u),
  p AS (SELECT *, coalesce(nullif(fp, ''), gp, CASE WHEN t IS NULL THEN CASE WHEN sd IS NOT NULL THEN 'date' END WHEN t = date_trunc('minute', t) THEN 'minute' ELSE 'instant' END) AS pr FROM d)"""


@query(f"""WITH {_PHOTO} SELECT event_id, metric, cu AS unit, sd AS date, CASE WHEN pr IS DISTINCT FROM 'date' THEN epoch_ms(t) END AS ts_ms, pr AS precision,
  concat_ws(',', CASE WHEN unit = 'stone' THEN 'unrecognized_unit' END, CASE WHEN (metric IN ('weight', 'bone_mass') AND cu NOT IN ('kg', 'lb')) OR (metric = 'body_fat_pct' AND cu <> '%') THEN 'impossible_unit' END, CASE WHEN confidence > 1 THEN 'confidence_out_of_range' END,
    CASE WHEN pr = 'date' AND t IS NOT NULL THEN 'date_precision_drops_timestamp' END, CASE WHEN pr IN ('instant', 'minute') AND t IS NULL THEN 'missing_timestamp' END, CASE WHEN sd IS NULL THEN 'missing_source_date' END) AS warnings,
  CASE WHEN pr NOT IN ('instant', 'minute') OR t IS NULL OR sd IS NULL THEN NULL WHEN zone = 'Nowhere/None' THEN 'zone_not_usable' WHEN zone = 'Asia/Tokyo' THEN CASE WHEN (t + INTERVAL 9 HOURS)::DATE <> sd THEN 'date_contradicts_zone' END
    WHEN minutes IS NOT NULL THEN CASE WHEN (t + INTERVAL 9 HOURS)::DATE <> sd THEN 'date_contradicts_offset' END WHEN abs(sd - t::DATE) > 1 THEN 'date_contradicts_instant' END AS error FROM p""", dates="date")
def n33_photo_fields(spark, sf):
    e = E()
    ms, minute = F.date_trunc("millisecond", "ts"), F.date_trunc("minute", "ts")
    precision = F.element_at(F.array(F.lit(None).cast("string"), F.lit("date"), F.lit("instant"), F.lit("")), (e % 3 + F.when(e % 10 == 0, 1).otherwise(0) + 1).cast("int"))
    rows = measured(spark, sf).select(
        "event_id", token(4, "weight", "body_fat_pct", "bone_mass", "heart_rate").alias("metric"), token(6, "kg", " LBS ", "percent", "stone", "", None).alias("unit"), F.when(K() % 3 > 0, K() / 80.0).alias("confidence"),
        F.when(e % 11 == 0, F.date_add("day", 2)).alias("field_date"), F.when(e % 5 > 0, F.when(e % 8 == 0, minute).otherwise(ms)).alias("field_ts"), precision.alias("field_precision"),
        F.when(e % 4 < 2, F.col("day")).alias("group_date"), F.when(e % 7 == 0, ms).alias("group_ts"), F.when(e % 9 == 0, "minute").alias("group_precision"),
        token(13, None, "Asia/Tokyo", "Nowhere/None").alias("zone"), F.when(e % 13 == 0, F.lit(540)).alias("offset_minutes"),
    )
    found = intake.photo_fields(rows, ["event_id"])
    return found.select("event_id", "metric", "unit", "date", F.unix_millis("ts").alias("ts_ms"), "precision", F.array_join("warnings", ",").alias("warnings"), "error")


_STAGES = f"""{M}, parts AS (SELECT user_id, day, row_number() OVER w - 1 AS ordinal, date_trunc('millisecond', ts) AS s, date_trunc('millisecond', coalesce(lead(ts) OVER w, ts + INTERVAL 10 MINUTES)) AS e, k % 9 AS level FROM m WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id)),
  kinds AS (SELECT *, ordinal = 2 AND user_id % 5 = 1 AS odd, NOT (ordinal = 2 AND user_id % 5 = 1) AND NOT (ordinal = 1 AND user_id % 5 = 2) AND level < 8 AND e > s AS good FROM parts),
  told AS (SELECT *, last_value(CASE WHEN good THEN e END IGNORE NULLS) OVER (PARTITION BY user_id, day ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM kinds)"""


def _stage_payloads(spark, sf) -> DataFrame:
    """A payload for each night with its stages; lists that are null, no list or missing and elements that are none, by user."""
    at = lambda c: F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit('"'))
    u, n = F.col("user_id"), F.col("ordinal")
    level = F.when((n == 1) & (u % 5 == 2), "true").otherwise(F.col("level").cast("string"))
    item = F.when((n == 2) & (u % 5 == 1), "5").otherwise(F.concat(F.lit('{"startGMT":'), at("start_ts"), F.lit(',"endGMT":'), at("end_ts"), F.lit(',"activityLevel":'), level, F.lit("}")))
    parts = stage_parts(spark, sf).select("user_id", "day", "ordinal", item.alias("item"), F.unix_millis("start_ts").alias("s"), F.unix_millis("end_ts").alias("e"))
    nights = parts.groupBy("user_id", "day").agg(F.sort_array(F.collect_list(F.struct("ordinal", "item"))).alias("items"), F.min_by("s", "ordinal").alias("s"), F.max_by("e", "ordinal").alias("e"))
    whole = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit("]"))
    listed = F.when(u % 7 == 3, "null").when(u % 7 == 4, "{}").when(u % 7 != 5, whole)
    start = F.when(u % 3 == 0, F.col("s") + 1).otherwise(F.col("s")).cast("string")
    fields = [(F.lit('"sleepLevels":'), listed), (F.lit('"levels":'), F.when(u % 11 == 0, "[]")), (F.lit('"sleepStartTimestampGMT":'), start), (F.lit('"sleepEndTimestampGMT":'), F.col("e").cast("string"))]
    text = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(a, b) for a, b in fields]), F.lit("}"))
    return nights.select("user_id", "day", F.try_parse_json(text).alias("payload"))


@query(f"""WITH {_STAGES}, g AS (SELECT user_id, day, count(*) FILTER (WHERE good) AS stages, count(*) FILTER (WHERE NOT good) AS refused, count(*) FILTER (WHERE good AND s <> past) AS breaks,
    min_by(s, ordinal) AS "from", max_by(e, ordinal) AS "to", min_by(s, ordinal) FILTER (WHERE good) AS "first", max_by(e, ordinal) FILTER (WHERE good) AS "last" FROM told GROUP BY ALL),
  h AS (SELECT user_id, day, user_id % 7 AS kind, CASE WHEN user_id % 7 IN (3, 4, 5) THEN 0 ELSE stages END AS stages, CASE WHEN user_id % 7 IN (3, 4, 5) THEN 0 ELSE refused END AS refused, CASE WHEN user_id % 7 IN (3, 4, 5) THEN 0 ELSE breaks END AS breaks,
    user_id % 7 NOT IN (3, 4, 5) AND stages > 0 AND NOT ("first" = "from" AND "last" = "to" AND user_id % 3 <> 0) AS outside, user_id % 11 = 0 AND user_id % 7 <> 5 AS twice FROM g),
  n AS (SELECT *, refused > 0 OR breaks > 0 OR outside OR twice AS noted FROM h)
  SELECT user_id, day, CASE WHEN kind = 5 THEN 'missing' WHEN kind = 3 THEN 'null' WHEN kind = 4 OR (noted AND stages = 0) THEN 'invalid' ELSE 'value' END AS state,
    CASE WHEN kind IN (3, 5) THEN NULL WHEN kind = 4 OR (noted AND stages = 0) THEN 'shape_drift' WHEN noted THEN 'partial_collection' END AS reason, stages, refused, breaks,
    concat_ws(',', CASE WHEN refused > 0 THEN 'sleep_stage_refused' END, CASE WHEN breaks > 0 THEN 'sleep_stage_discontinuity' END, CASE WHEN outside THEN 'sleep_stage_boundary_mismatch' END, CASE WHEN twice THEN 'sleep_stage_alias_conflict' END) AS diagnostics FROM n""", dates="day")
def n10_stage_lists(spark, sf):
    found = intake.stage_lists(_stage_payloads(spark, sf), ["user_id", "day"], "payload")
    return found.withColumn("diagnostics", F.array_join("diagnostics", ","))


@query(f"""WITH {_STAGES} SELECT user_id, day, ordinal, CASE WHEN NOT odd THEN epoch_ms(s) END AS start_ms, CASE WHEN NOT odd THEN epoch_ms(e) END AS end_ms, CASE WHEN odd OR (ordinal = 1 AND user_id % 5 = 2) THEN NULL WHEN level < 4 THEN ['DEEP', 'LIGHT', 'REM', 'AWAKE'][level + 1] WHEN level < 8 THEN 'LIGHT' END AS stage,
  CASE WHEN odd THEN 'sleep_stage_shape_drift' WHEN NOT good THEN 'sleep_stage_invalid' END AS reason, CASE WHEN good AND s <> past THEN 'sleep_stage_discontinuity' END AS diagnostic FROM told WHERE user_id % 7 NOT IN (3, 4, 5)""", dates="day")
def n10_stage_rows(spark, sf):
    found = intake.stage_rows(_stage_payloads(spark, sf), ["user_id", "day"], "payload")
    return found.select("user_id", "day", "ordinal", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "stage", "reason", "diagnostic")


def _batch(days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results and members of user days: a day is complete by its number, its types are the records."""
    members = days.select(F.col("user_id").alias("scope"), F.col("day").alias("received"), F.col("event_type").alias("record"), F.col("n").alias("content"))
    text = F.to_json(F.sort_array(F.collect_list(F.struct("record", "content"))))
    results = members.groupBy("scope", "received").agg(text.alias("text")).withColumn("complete", F.dayofmonth("received") % 2 == 0)
    return results, members


def stored_of_events(spark, sf) -> intake.Stored:
    """Two batches: days 1 to 15 of each month, then all days after the 12th, of which those up to the 15th come again, for every fifth user with other contents."""
    days = measured(spark, sf).groupBy("user_id", "event_type", "day").agg(F.count("*").alias("n"))
    number = F.dayofmonth("day")
    again = days.where(number > 12).withColumn("n", F.col("n") + F.when((F.col("user_id") % 5 == 0) & (number <= 15), 1).otherwise(0))
    none = intake.Stored(
        spark.createDataFrame([], "scope long, content_hash string, text string"),
        spark.createDataFrame([], "scope long, observation_key string, received date, complete boolean, outcome string"),
        spark.createDataFrame([], "scope long, record string, content long, observed date, retired boolean, outcome string"),
    )
    return intake.persisted(intake.persisted(none, *_batch(days.where(number <= 15))), *_batch(again))


_PERSIST = f"""{M}, days AS (SELECT user_id AS scope, event_type AS record, day, count(*) AS n FROM m GROUP BY ALL), a AS (SELECT * FROM days WHERE day(day) <= 15),
  newest AS (SELECT scope, max(day) AS newest FROM a GROUP BY 1), b AS (SELECT scope, record, day, n + CASE WHEN scope % 5 = 0 AND day(day) <= 15 THEN 1 ELSE 0 END AS n FROM days WHERE day(day) > 12),
  results AS (SELECT DISTINCT b.scope, b.day, CASE WHEN day(b.day) <= 15 AND b.scope % 5 <> 0 THEN 'replay' WHEN b.day < newest THEN 'stale' ELSE 'new' END AS outcome FROM b LEFT JOIN newest USING (scope))"""


@query(f"""WITH {_PERSIST}, r1 AS (SELECT scope, record, max_by(n, day) AS content, max(day) AS observed FROM a GROUP BY ALL), c1 AS (SELECT scope, max(day) AS closed FROM a WHERE day(day) % 2 = 0 GROUP BY 1), s AS (SELECT r1.*, coalesce(closed > observed, false) AS retired FROM r1 LEFT JOIN c1 USING (scope)),
  r2 AS (SELECT scope, record, max_by(n, day) AS content, max(day) AS observed FROM b JOIN results USING (scope, day) WHERE outcome = 'new' GROUP BY ALL), c2 AS (SELECT scope, max(day) AS closed FROM results WHERE outcome = 'new' AND day(day) % 2 = 0 GROUP BY 1),
  j AS (SELECT scope, record, s.content AS oc, r2.content AS nc, s.retired AS was, coalesce(r2.observed, s.observed) AS observed, coalesce(c2.closed > coalesce(r2.observed, s.observed), false) AS ends FROM s FULL JOIN r2 USING (scope, record) LEFT JOIN c2 USING (scope))
  SELECT scope, record, coalesce(nc, oc) AS content, observed, ends OR (nc IS NULL AND coalesce(was, false)) AS retired,
    CASE WHEN nc IS NULL THEN CASE WHEN ends AND NOT was THEN 'retired' ELSE 'kept' END WHEN ends THEN 'retired' WHEN oc IS NULL THEN 'inserted' WHEN was THEN 'restored' WHEN nc = oc THEN 'same' ELSE 'revised' END AS outcome FROM j""", dates="observed")
def k1_persisted_records(spark, sf):
    return stored_of_events(spark, sf).records


@query(f"""WITH {_PERSIST} SELECT scope, received, complete, outcome FROM (SELECT DISTINCT scope, day AS received, day(day) % 2 = 0 AS complete, 'new' AS outcome FROM a UNION ALL SELECT scope, day, day(day) % 2 = 0, outcome FROM results WHERE outcome <> 'replay')""", dates="received")
def k1_persisted_observations(spark, sf):
    return stored_of_events(spark, sf).observations.select("scope", "received", "complete", "outcome")


#: Why the draft of an order is refused, by its key modulo 23; other drafts are accepted.
_DRAFT_FAULTS = """CASE WHEN o % 23 = 0 THEN 'invalid_json' WHEN o % 23 = 1 THEN 'extra_field:.' WHEN o % 23 = 2 THEN 'bad_text:pdf_sha256' WHEN o % 23 = 3 THEN 'wrong_type:incomplete' WHEN o % 23 = 4 THEN 'rule:result_date' WHEN o % 23 = 5 THEN 'missing:provenance'
  WHEN o % 23 = 6 THEN 'not_allowed:provenance.transcription' WHEN o % 23 = 7 THEN 'not_object' WHEN o % 23 = 8 THEN 'rows.too_small:label_raw' WHEN o % 23 = 9 THEN 'rows.numeric_value' WHEN o % 23 = 10 AND n > 1 THEN 'duplicate_row_ids' WHEN o % 23 = 11 THEN 'rows' END"""
_DRAFTS = f"""l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey, l_suppkey) - 1 AS ordinal FROM lineitem),
  d AS (SELECT o, n, {_DRAFT_FAULTS} AS reason FROM (SELECT o, count(*) AS n FROM l GROUP BY 1))"""


def _draft_texts(spark, sf) -> DataFrame:
    """A laboratory draft for each order, a row for each of its lines; every twelfth or so has a fault."""
    o = F.col("l_orderkey")
    case = lambda n: o % 23 == n
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    lines = load(spark, sf, "lineitem").withColumn("ordinal", F.row_number().over(w) - 1)
    texts = lambda **fields: F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v if not isinstance(v, str) else F.lit(v)) for k, v in fields.items()])
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    number = F.col("l_quantity").cast("decimal(12,2)").cast("string")
    even = F.col("ordinal") % 2 == 0
    source = '{"transcription":"manual","page":1,"support":null}'
    row = texts(
        row_id=quoted(F.concat(F.lit("r"), F.when(case(10), F.lit("0")).otherwise(F.col("ordinal").cast("string")))), label_raw=F.when(case(8), '""').otherwise('"Ferritin"'), result_raw=quoted(number), unit_raw="null", reference_raw="null", flag_raw="null",
        value_kind=F.when(even, '"numeric"').otherwise('"qualitative"'), decimal=F.when(even & ~case(9), quoted(number)).otherwise("null"), comparator=F.when(even, '"≤"').otherwise("null"), qualitative=F.when(even, "null").otherwise('"negative"'),
        method_raw="null", equipment_kit_notes="null", specimen_raw="null", specimen_date='{"value":"2024-02-29T07:30+02:00","precision":"minute"}', provenance=source, uncertainty="null",
    )
    rows = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("ordinal", F.concat(F.lit("{"), row, F.lit("}")).alias("row")))).alias("rows"))
    listed = F.when(case(11), "[]").otherwise(F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["row"]), ","), F.lit("]")))
    digest = F.sha2(o.cast("string"), 256)
    whole = texts(
        schema_version='"lab-draft-v1"', pdf_sha256=quoted(F.when(case(2), F.upper(F.concat(F.lit("a"), F.substring(digest, 2, 63)))).otherwise(digest)), scope='"single_report_single_patient"', patient_link='"unresolved"', report_link='"resolved"', source_match='"unverified"',
        clinic_source="null", performing_lab='"L"', report_label="null", result_date=F.when(case(4), '{"value":"2024-02-30","precision":"date"}').otherwise('{"value":"2024-02-29","precision":"date"}'), printed_date="null", specimen_date="null",
        provenance=F.when(case(6), '{"transcription":"guess","page":1,"support":null}').when(~case(5), source), field_provenance=F.lit('{"result_date":' + source + "}"), incomplete=F.when(case(3), "0").otherwise("false"), uncertainty="null",
        note=F.when(case(1), "1"),
    )
    # concat_ws leaves out the fields that are null
    text = F.concat(F.lit("{"), whole, F.lit(',"rows":'), listed, F.when(case(0), ',"rows":[]').otherwise(""), F.lit("}"))
    return rows.select("l_orderkey", F.when(case(7), "[1]").otherwise(text).alias("text"))


@query(f"WITH {_DRAFTS} SELECT o AS l_orderkey, reason, CASE WHEN reason IS NULL THEN sha256(o::VARCHAR) END AS pdf_sha256 FROM d")
def s19_lab_drafts(spark, sf):
    """Key 0 modulo 23 has a key twice."""
    return drafts.lab_drafts(_draft_texts(spark, sf), ["l_orderkey"], "text").drop("rows")


@query(f"""WITH {_DRAFTS} SELECT o AS l_orderkey, ordinal::INT AS ordinal, 'r' || ordinal AS row_id, q::DECIMAL(12,2)::VARCHAR AS result_raw, CASE WHEN ordinal % 2 = 0 THEN 'numeric' ELSE 'qualitative' END AS value_kind, CASE WHEN ordinal % 2 = 0 THEN q::DECIMAL(12,2)::VARCHAR END AS decimal,
  CASE WHEN ordinal % 2 = 0 THEN '≤' END AS comparator, CASE WHEN ordinal % 2 = 1 THEN 'negative' END AS qualitative FROM l JOIN (SELECT o FROM d WHERE reason IS NULL) USING (o) WHERE o % 23 <> 10 OR ordinal = 0""")
def s19_lab_rows(spark, sf):
    found = drafts.lab_rows(drafts.lab_drafts(_draft_texts(spark, sf), ["l_orderkey"], "text"), ["l_orderkey"])
    return found.select("l_orderkey", "ordinal", "row_id", "result_raw", "value_kind", "decimal", "comparator", "qualitative")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'absent' WHEN 1 THEN 'size' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'not_object' WHEN 4 THEN 'size' END AS reason, CASE WHEN event_id % 6 = 5 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k FROM events""")
def s18_extraction_objects(spark, sf):
    """A landed extraction is one JSON object of bounded size: here 64 bytes."""
    text = token(6, None, F.rpad("props", 65, " "), F.concat("props", F.lit("x")), F.concat(F.lit("["), "props", F.lit("]")), "", F.col("props"))
    read = drafts.json_object(text, 64)
    return load(spark, sf, "events").select("event_id", read["reason"].alias("reason"), F.try_variant_get(read["object"], "$.k", "int").alias("k"))
