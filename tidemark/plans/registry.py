"""All queries over the driver tables with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.functions import exact_count, idempotency_key, signed_circular
from tidemark.functions.canonical import manifest_hash
from tidemark.operators import association, baseline, clock, coverage, daily, identity, joins, period, weight
from tidemark.plans import adapters
from tidemark.plans.adapters import A, C, D, M, P, W
from tidemark.session import load
from tidemark.streaming import pipelines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEYS = ["user_id", "event_type"]


def query(sql: str | None = None, dates: str = ""):
    """Registers a query under its function's name; its date columns (named in dates) become ISO text on both sides."""
    named = dates.split()

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in named})

        QUERIES[f.__name__] = run if named else f
        if sql is not None:
            shown = ", ".join(f'strftime("{c}", \'%Y-%m-%d\') AS "{c}"' for c in named)
            ORACLES[f.__name__] = f"SELECT * REPLACE ({shown}) FROM ({sql})" if named else sql
        return f

    return register


def rounded(df: DataFrame, places: int = 7) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.series(adapters.measurements(spark, sf_dir), KEYS)


def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weight.daily_median(adapters.weights(spark, sf_dir), ["grp"]).select("grp", "day", "value")


# ---- scalar baselines -------------------------------------------------------------------


@query(f"WITH {P} SELECT user_id, event_type, day, \"rows\", status, round(value, 7) AS value FROM p", dates="day")
def b0_series(spark, sf):
    return rounded(points(spark, sf))


@query(f"""WITH {P} SELECT user_id, event_type,
  count(*) FILTER (WHERE status = 'value') AS n_value, count(*) FILTER (WHERE status = 'zero') AS n_zero, count(*) FILTER (WHERE status = 'partial') AS n_partial,
  count(*) FILTER (WHERE status = 'null') AS n_null, count(*) FILTER (WHERE status = 'invalid') AS n_invalid, count(*) FILTER (WHERE status = 'ambiguous') AS n_ambiguous,
  count(value) AS n_usable FROM p GROUP BY ALL""")
def b1_availability(spark, sf):
    return baseline.availability(points(spark, sf), KEYS)


@query(f"""WITH {P} SELECT user_id, event_type, count(value) AS n, round(avg(value), 7) AS mean, round(min(value), 7) AS least, round(max(value), 7) AS most,
  round(quantile_cont(value, 0.1), 7) AS p10, round(quantile_cont(value, 0.25), 7) AS p25, round(quantile_cont(value, 0.5), 7) AS p50,
  round(quantile_cont(value, 0.75), 7) AS p75, round(quantile_cont(value, 0.9), 7) AS p90,
  CASE WHEN count(value) = 0 THEN 'no_usable_values' END AS reason FROM p GROUP BY user_id, event_type""")
def b3_scalar_baseline(spark, sf):
    return rounded(baseline.summary(points(spark, sf), KEYS))


@query(f"""WITH {P}, u AS (SELECT *, max_by(value, day) OVER (PARTITION BY user_id, event_type) AS latest FROM p WHERE value IS NOT NULL)
  SELECT user_id, event_type, round(latest, 7) AS latest, count(*) AS n,
  CASE WHEN count(*) >= 5 THEN round(100.0 * (count(*) FILTER (WHERE value < latest) + 0.5 * count(*) FILTER (WHERE value = latest)) / count(*), 7) END AS percentile
  FROM u GROUP BY user_id, event_type, latest""")
def b4_midrank_percentile(spark, sf):
    return rounded(baseline.latest_position(points(spark, sf), KEYS))


@query(f"""WITH {P}, u AS (SELECT * FROM p WHERE value IS NOT NULL), z AS (SELECT user_id, event_type, count(DISTINCT day) AS days FROM u GROUP BY ALL),
  s AS (SELECT a.user_id, a.event_type, median((b.value - a.value) / date_diff('day', a.day, b.day)) AS slope, count(*) AS pairs
        FROM u a JOIN u b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.day > a.day GROUP BY ALL)
  SELECT user_id, event_type, days, CASE WHEN days >= 3 THEN round(slope, 7) END AS slope, CASE WHEN days >= 3 THEN pairs ELSE 0 END AS pairs,
  CASE WHEN days < 3 THEN 'too_few_dates' END AS reason FROM z LEFT JOIN s USING (user_id, event_type)""")
def b5_theil_sen(spark, sf):
    return rounded(baseline.theil_sen(points(spark, sf), KEYS))


@query(f"""WITH {P}, c AS (SELECT user_id, event_type, count(*) AS n, max_by(value, day) AS latest, median(value) AS med FROM p WHERE value IS NOT NULL GROUP BY ALL),
  d AS (SELECT c.*, (SELECT median(abs(p.value - c.med)) FROM p WHERE p.user_id = c.user_id AND p.event_type = c.event_type AND p.value IS NOT NULL) AS mad FROM c)
  SELECT user_id, event_type, n, round(latest, 7) AS latest, round(med, 7) AS median, round(mad, 7) AS mad,
  CASE WHEN n >= 5 AND mad > 0 THEN round(0.67448975 * (latest - med) / mad, 7) END AS z,
  coalesce(n >= 5 AND mad > 0 AND abs(0.67448975 * (latest - med) / nullif(mad, 0)) >= 3.5, false) AS flagged,
  CASE WHEN n < 5 THEN 'too_few_values' WHEN mad = 0 THEN 'zero_deviation' END AS reason FROM d""")
def b6_robust_z(spark, sf):
    return rounded(baseline.robust_z(points(spark, sf), KEYS))


@query(f"""WITH {D}, s AS (SELECT grp, day, value, count(value) OVER w28 AS observed, median(value) OVER w28 AS med FROM d
    WINDOW w28 AS (PARTITION BY grp ORDER BY day RANGE BETWEEN INTERVAL 28 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)),
  t AS (SELECT *, CASE WHEN observed >= 21 THEN med END AS base FROM s)
  SELECT grp, day, round(value, 7) AS value, observed, round(base, 7) AS base, round(value - base, 7) AS delta,
  CASE WHEN value > base THEN 'above' WHEN value < base THEN 'below' WHEN value = base THEN 'equal' ELSE 'unavailable' END AS direction FROM t""", dates="day")
def b9_trailing_baseline(spark, sf):
    return rounded(baseline.trailing_baseline(medians(spark, sf), ["grp"]))


# ---- weight -----------------------------------------------------------------------------


@query(f"""WITH {W} SELECT id, CASE WHEN NOT confirmed THEN 'not_confirmed' WHEN superseded THEN 'superseded' WHEN day IS NULL THEN 'missing_observed_date'
  WHEN value IS NULL THEN 'missing_value' WHEN value <= 0 THEN 'non_positive_weight' WHEN unit <> 'kg' THEN 'invalid_unit' END AS reason FROM w""")
def w0_candidates(spark, sf):
    return weight.candidates(adapters.weights(spark, sf)).select("id", "reason")


@query(f"WITH {W} SELECT grp, day, round(median(value), 7) AS value, count(*) AS n, array_to_string(list_sort(list(id)), ',') AS ids FROM w GROUP BY grp, day", dates="day")
def w1_daily_median(spark, sf):
    out = weight.daily_median(adapters.weights(spark, sf), ["grp"])
    return rounded(out.withColumn("ids", F.concat_ws(",", F.transform("ids", lambda x: x.cast("string")))))


@query(f"""WITH {D}, l AS (SELECT *, max(day) OVER (PARTITION BY grp) AS latest FROM d), i AS (SELECT * FROM l WHERE date_diff('day', day, latest) < 90),
  n AS (SELECT grp, latest, count(*) AS n, date_diff('day', min(day), max(day)) AS span_days FROM i GROUP BY grp, latest),
  s AS (SELECT a.grp, median((b.value - a.value) / date_diff('day', a.day, b.day)) AS slope FROM i a JOIN i b ON a.grp = b.grp AND b.day > a.day GROUP BY a.grp)
  SELECT grp, latest, n, span_days::INT AS span_days, CASE WHEN n >= 6 AND span_days >= 42 THEN round(slope * 7, 7) END AS per_week,
  CASE WHEN n < 6 THEN 'too_few_points' WHEN span_days < 42 THEN 'too_short_span' END AS reason FROM n LEFT JOIN s USING (grp)""", dates="latest")
def w4_weekly_rate(spark, sf):
    return rounded(weight.weekly_rate(medians(spark, sf), ["grp"]))


# ---- association and agreement ------------------------------------------------------------


@query(f"""WITH {A} SELECT cohort, count(*) AS n, round(avg(diff), 3) AS bias, round(avg(abs(diff)), 3) AS mae, round(sqrt(avg(diff * diff)), 3) AS rmse, round(stddev_samp(diff), 3) AS sd,
  round(avg(diff) - 1.96 * stddev_samp(diff), 3) AS loa_low, round(avg(diff) + 1.96 * stddev_samp(diff), 3) AS loa_high, round(median(diff), 3) AS median,
  round(quantile_cont(diff, 0.025), 3) AS q025, round(quantile_cont(diff, 0.975), 3) AS q975, round(corr(a, b), 3) AS pearson FROM x GROUP BY cohort""")
def a2_agreement(spark, sf):
    return rounded(association.agreement_summary(association.agreement_dedup(adapters.paired(spark, sf), ["cohort"]), ["cohort"]), 3)


@query(f"""WITH {A}, f AS (SELECT cohort, quantile_cont(diff, 0.25) AS q1, quantile_cont(diff, 0.75) AS q3 FROM x GROUP BY cohort),
  g AS (SELECT cohort, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM f)
  SELECT cohort, round(low, 3) AS low, round(high, 3) AS high, count(*) FILTER (WHERE diff < low OR diff > high) AS outliers,
  round(avg(diff) FILTER (WHERE diff BETWEEN low AND high), 3) AS bias_inside, round(avg(diff), 3) AS bias FROM x JOIN g USING (cohort) GROUP BY cohort, low, high""")
def a4_outlier_sensitivity(spark, sf):
    return rounded(association.outlier_sensitivity(adapters.paired(spark, sf), ["cohort"]), 3)


_STABILITY = f"""WITH {A}, h AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY day) <= count(*) OVER (PARTITION BY cohort) // 2 AS first FROM x),
  s AS (SELECT cohort, avg(diff) FILTER (WHERE first) AS b1, avg(diff) FILTER (WHERE NOT first) AS b2, quantile_cont(diff, 0.025) FILTER (WHERE first) AS l1, quantile_cont(diff, 0.975) FILTER (WHERE first) AS h1,
    quantile_cont(diff, 0.025) FILTER (WHERE NOT first) AS l2, quantile_cont(diff, 0.975) FILTER (WHERE NOT first) AS h2, quantile_cont(diff, 0.025) AS l, quantile_cont(diff, 0.975) AS h,
    count(*) AS n, date_diff('day', min(day), max(day)) AS span_days FROM h GROUP BY cohort),
  t AS (SELECT cohort, n, span_days, b1, b2, l1 <= h2 AND l2 <= h1 AS overlap, l1 <= h2 AND l2 <= h1 AND b1 BETWEEN l AND h AND b2 BETWEEN l AND h AS stable FROM s)"""


@query(_STABILITY + " SELECT cohort, round(b1, 3) AS first_bias, round(b2, 3) AS second_bias, overlap, stable FROM t")
def a6_stability(spark, sf):
    return rounded(association.stability(adapters.paired(spark, sf), ["cohort"]), 3)


# ---- calendar and coverage ------------------------------------------------------------------


@query(f"""WITH {C}, b AS (SELECT cust, s, e, unnest(range(0, date_diff('day', s, e) // 7 + 1)) AS k FROM spans)
  SELECT b.cust, (s + (7 * k)::INT)::DATE AS bin_start, least((s + (7 * k + 6)::INT)::DATE, e) AS bin_end, count(o.day) AS observed
  FROM b LEFT JOIN o ON o.cust = b.cust AND date_diff('day', s, o.day) // 7 = k GROUP BY ALL""", dates="bin_start bin_end")
def c1_cadence_bins(spark, sf):
    spans, days = adapters.customer_spans(spark, sf), adapters.customer_days(spark, sf)
    once = days.groupBy("cust", "day").agg(F.count("*").alias("n"))
    numbered = once.join(spans, "cust").groupBy("cust", coverage.bin_number(F.col("day"), F.col("start"), 7).alias("k")).agg(F.sum("n").alias("n"))
    made = coverage.bins(spans, 7).withColumn("k", coverage.bin_number(F.col("bin_start"), F.col("start"), 7))
    return made.join(numbered, ["cust", "k"], "left").select("cust", "bin_start", "bin_end", F.coalesce("n", F.lit(0).cast("long")).alias("observed"))


def _facts(spark, sf):
    status = F.element_at(F.array(*[F.lit(x) for x in ("confirmed_empty", "failed", "unknown", "unavailable", "present")]), (F.col("event_id") % 40 % 5 + 1).cast("int"))
    return load(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), F.when(F.col("event_id") % 3 == 0, status).otherwise(F.when(F.col("event_id") % 2 == 0, "failed").otherwise("confirmed_empty")).alias("status"), F.col("ts").alias("computed_at"), F.col("ts").alias("interval_end"))


_FACTS = """f AS (SELECT user_id, ts::DATE AS day, ts, CASE WHEN event_id % 3 = 0 THEN ['confirmed_empty', 'failed', 'unknown', 'unavailable', 'present'][event_id % 40 % 5 + 1]
    WHEN event_id % 2 = 0 THEN 'failed' ELSE 'confirmed_empty' END AS status FROM events),
  s AS (SELECT user_id, day, count(*) AS facts, CASE WHEN bool_or(status = 'present') THEN 'present' WHEN bool_or(status = 'unavailable') THEN 'unavailable'
    ELSE coalesce(arg_max(status, (ts, status = 'confirmed_empty')) FILTER (WHERE status IN ('confirmed_empty', 'failed')), 'unknown') END AS status FROM f GROUP BY user_id, day)"""


@query(f"WITH {_FACTS} SELECT user_id, day, status, facts FROM s", dates="day")
def c2_bin_status(spark, sf):
    return coverage.bin_status(_facts(spark, sf), ["user_id", "day"])


@query(f"""WITH {_FACTS} SELECT user_id, count(*) AS bins, count(*) FILTER (WHERE status IN ('present', 'confirmed_empty')) AS good,
  CASE WHEN bool_and(status IN ('present', 'confirmed_empty')) THEN 'complete' WHEN bool_or(status IN ('present', 'confirmed_empty')) THEN 'partial' ELSE 'missing' END AS window_status FROM s GROUP BY user_id""")
def c5_window_status(spark, sf):
    return coverage.window_status(coverage.bin_status(_facts(spark, sf), ["user_id", "day"]), ["user_id"])


@query(f"""WITH {C}, s AS (SELECT cust, day, date_diff('day', lag(day) OVER (PARTITION BY cust ORDER BY day), day) AS step FROM (SELECT DISTINCT * FROM o))
  SELECT cust, min(day) AS oldest, max(day) AS latest, date_diff('day', max(day), DATE '2001-12-31')::INT AS age_days, max(step)::INT AS longest_step FROM s GROUP BY cust""", dates="oldest latest")
def c4_freshness(spark, sf):
    return coverage.freshness(adapters.customer_days(spark, sf), ["cust"], "2001-12-31")


@query("""WITH i AS (SELECT user_id, ts AS s0, ts + INTERVAL 36 HOURS AS e0, TIMESTAMP '2024-01-10' AS a, TIMESTAMP '2024-01-17' AS b FROM events),
  c AS (SELECT user_id, greatest(s0, a) AS s, least(e0, b) AS e, a, b FROM i WHERE greatest(s0, a) < least(e0, b)),
  w AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c)
  SELECT user_id, count(*) AS parts, NOT coalesce(bool_or(s > reach), false) AND min(s) <= max(a) AND max(e) >= max(b) AS complete FROM w GROUP BY user_id""")
def y1_interval_union(spark, sf):
    rows = load(spark, sf, "events").select("user_id", F.col("ts").alias("interval_start"), (F.col("ts") + F.expr("interval 36 hours")).alias("interval_end"), F.lit("2024-01-10").cast("timestamp").alias("start"), F.lit("2024-01-17").cast("timestamp").alias("end"))
    return coverage.union_complete(rows, ["user_id"])


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), d AS (SELECT user_id, unnest(generate_series((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY))::DATE AS day FROM u)
  SELECT d.user_id, d.day FROM d WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = d.user_id AND e.ts::DATE = d.day)""", dates="day")
def p9_missing_days(spark, sf):
    m = adapters.measurements(spark, sf)
    spans = adapters.user_spans(spark, sf)
    return coverage.missing_days(m, spans, ["user_id"])


# ---- daily readers ----------------------------------------------------------------------------


@query(f"""WITH {M}, d AS (SELECT user_id, event_type, day, count(*) AS n, any_value(value::DECIMAL(18, 2)) AS v FROM m GROUP BY ALL)
  SELECT user_id, event_type, count(*) FILTER (WHERE n = 1) AS days, count(*) FILTER (WHERE n > 1) AS ambiguous, round((sum(v) FILTER (WHERE n = 1))::DOUBLE, 7) AS total,
  round((sum(v) FILTER (WHERE n = 1))::DOUBLE / nullif(count(*) FILTER (WHERE n = 1), 0), 7) AS mean FROM d GROUP BY user_id, event_type""")
def r1_single_record_means(spark, sf):
    return rounded(daily.single_record_days(adapters.measurements(spark, sf).withColumn("value", F.round("value", 2)), KEYS, "value"))


@query(f"""WITH {M}, d AS (SELECT user_id, day, sum(CASE WHEN event_type = 'click' THEN k END) AS mo, sum(CASE WHEN event_type = 'view' THEN k END) AS vi, max(CASE WHEN event_type = 'purchase' THEN k END) AS goal FROM m GROUP BY ALL)
  SELECT user_id, date_trunc('week', day)::DATE AS week, count(mo + 2 * vi) AS paired_days, sum(mo + 2 * vi)::BIGINT AS minutes, arg_max(goal, day) FILTER (WHERE goal IS NOT NULL) AS goal, count(mo + 2 * vi) = 7 AS complete
  FROM d GROUP BY 1, 2""", dates="week")
def r3_intensity_weeks(spark, sf):
    m = adapters.measurements(spark, sf)
    of = lambda f, t: f(F.when(F.col("event_type") == t, F.col("k")))
    days = m.groupBy("user_id", "day").agg(of(F.sum, "click").alias("moderate"), of(F.sum, "view").alias("vigorous"), of(F.max, "purchase").alias("goal"))
    return daily.intensity_weeks(days, ["user_id"])


@query(f"""WITH {M}, v AS (SELECT *, CASE WHEN state IN ('value', 'zero', 'partial') THEN k END AS x FROM m)
  SELECT user_id, day, CASE WHEN count(DISTINCT x) > 1 THEN 'ambiguous' WHEN count(DISTINCT x) = 1 THEN 'value' WHEN bool_or(state = 'null') THEN 'null' WHEN bool_or(state = 'invalid') THEN 'invalid' ELSE 'unavailable' END AS state,
  CASE WHEN count(DISTINCT x) = 1 THEN max(x) END AS value, count(*) AS "rows" FROM v GROUP BY user_id, day""", dates="day")
def r5_observed_days(spark, sf):
    m = adapters.measurements(spark, sf).withColumn("value", F.when(F.col("state").isin("value", "zero", "partial"), F.col("k")))
    return daily.day_state(m, ["user_id"])


@query(f"""WITH {M}, v AS (SELECT *, date_trunc('hour', ts) AS received, CASE WHEN state = 'value' THEN k END AS x FROM m), r AS (SELECT *, rank() OVER (PARTITION BY user_id, day ORDER BY received DESC) AS r FROM v)
  SELECT user_id, day, count(*) AS receipts, CASE WHEN count(DISTINCT state || coalesce(x::VARCHAR, '-')) > 1 THEN 'ambiguous' ELSE max(state) END AS state,
  CASE WHEN count(DISTINCT state || coalesce(x::VARCHAR, '-')) = 1 THEN max(x) END AS value FROM r WHERE r = 1 GROUP BY user_id, day""", dates="day")
def r6_latest_receipt(spark, sf):
    m = adapters.measurements(spark, sf)
    rows = m.select("user_id", "day", "state", F.when(F.col("state") == "value", F.col("k")).alias("value"), F.date_trunc("hour", "ts").alias("received"))
    return daily.latest_receipt(rows, ["user_id", "day"])


@query("""WITH d AS (SELECT user_id, ts::DATE AS day, sum((value * 100)::BIGINT)::BIGINT AS v FROM events GROUP BY 1, 2), f AS (SELECT user_id, sum(v)::BIGINT AS total, avg(v) AS mean, count(*) FILTER (WHERE v > 10000) AS above_low, count(*) FILTER (WHERE v > 20000) AS above_high, max(v) AS record FROM d GROUP BY user_id)
  SELECT f.user_id, total, round(mean, 7) AS mean, above_low, above_high, record, count(*) AS record_days, min(day) AS first_record_day FROM f JOIN d ON d.user_id = f.user_id AND d.v = f.record GROUP BY ALL""", dates="first_record_day")
def r7_steps_statistics(spark, sf):
    days = adapters.measurements(spark, sf).groupBy("user_id", "day").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("value"))
    return rounded(daily.steps_statistics(days, ["user_id"]))


@query(f"""WITH {P}, q AS (SELECT *, status = 'value' AND value < 200 AS ok FROM p), c AS (SELECT user_id, event_type, max(day) FILTER (WHERE ok) AS chosen, arg_max(value, day) FILTER (WHERE ok) AS v FROM q GROUP BY ALL)
  SELECT c.user_id, c.event_type, chosen, round(v, 7) AS value, count(*) FILTER (WHERE chosen IS NULL OR day > chosen) AS passed_over FROM c JOIN q ON q.user_id = c.user_id AND q.event_type = c.event_type GROUP BY ALL""", dates="chosen")
def r12_latest_eligible(spark, sf):
    return rounded(daily.latest_eligible(points(spark, sf), KEYS, (F.col("status") == "value") & (F.col("value") < 200)))


# ---- clocks, sleep-like intervals ----------------------------------------------------------------


@query("""WITH m AS (SELECT event_type, hour(ts) * 60 + minute(ts) + second(ts) / 60.0::DOUBLE AS mi FROM events), a AS (SELECT event_type, count(*) AS n, avg(cos(mi * 2 * pi() / 1440)) AS c, avg(sin(mi * 2 * pi() / 1440)) AS s,
    median(((mi - 720) % 1440 + 1440) % 1440) AS md FROM m GROUP BY event_type)
  SELECT event_type, n, round((atan2(s, c) * 1440 / (2 * pi()) + 1440) % 1440, 3) AS mean, round(sqrt(-2 * ln(sqrt(c * c + s * s))) * 1440 / (2 * pi()), 3) AS sd, round(sqrt(c * c + s * s), 3) AS resultant,
  round((md + 720) % 1440, 3) AS median, NULL::VARCHAR AS reason FROM a""")
def z15_circular_statistics(spark, sf):
    minute = F.hour("ts") * 60 + F.minute("ts") + F.second("ts") / F.lit(60.0)
    return rounded(clock.circular(load(spark, sf, "events").select("event_type", minute.alias("minute")), ["event_type"]), 3)


@query("""WITH m AS (SELECT event_type, CASE WHEN isodow(ts) >= 6 THEN 'free' ELSE 'work' END AS kind, hour(ts) * 60 + minute(ts) AS mi FROM events), a AS (SELECT event_type, kind, count(*) AS n,
    (atan2(avg(sin(mi * 2 * pi() / 1440)), avg(cos(mi * 2 * pi() / 1440))) * 1440 / (2 * pi()) + 1440) % 1440 AS mean FROM m GROUP BY ALL)
  SELECT f.event_type, round(f.mean, 3) AS free, round(w.mean, 3) AS work, f.n AS free_n, w.n AS work_n, round(((f.mean - w.mean + 720) % 1440 + 1440) % 1440 - 720, 3) AS jetlag
  FROM a f JOIN a w ON f.event_type = w.event_type AND f.kind = 'free' AND w.kind = 'work'""")
def z16_social_jetlag(spark, sf):
    minute = (F.hour("ts") * 60 + F.minute("ts")).cast("double")
    return rounded(clock.social_jetlag(load(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), minute.alias("minute")), ["event_type"]), 3)


@query("""WITH e AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, strlen(coalesce(text, '')) AS n FROM conversations),
  t AS (SELECT *, (sum(n) OVER w - n)::BIGINT AS s, (sum(n) OVER w - CASE WHEN n % 10 = 0 THEN n WHEN n % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS e FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY ordinal)),
  f AS (SELECT *, CASE WHEN e <= s THEN 'end_not_after_start' WHEN lag(e) OVER w > s THEN 'overlap' WHEN lag(e) OVER w < s THEN 'hole' END AS fault FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY ordinal))
  SELECT conv_id, count(*) AS parts, arg_min(fault, ordinal) FILTER (WHERE fault IS NOT NULL) AS fault, CASE WHEN count(fault) = 0 THEN sum(e - s)::BIGINT END AS seconds FROM f GROUP BY conv_id""")
def z1_interval_check(spark, sf):
    order = Window.partitionBy("conv_id").orderBy("turn")
    e = load(spark, sf, "conversations").select("conv_id", (F.row_number().over(order) - 1).alias("ordinal"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    total = F.sum("n").over(Window.partitionBy("conv_id").orderBy("ordinal"))
    cut = F.when(F.col("n") % 10 == 0, F.col("n")).when(F.col("n") % 7 == 0, 1).otherwise(0)
    return clock.interval_check(e.select("conv_id", "ordinal", F.timestamp_seconds(total - F.col("n")).alias("start_ts"), F.timestamp_seconds(total - cut).alias("end_ts")), ["conv_id"])


# ---- joins --------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT user_id, ts::DATE AS day, count(*) FILTER (WHERE event_type = 'error') AS na, count(*) FILTER (WHERE event_type = 'purchase') AS nb, max(value) FILTER (WHERE event_type = 'error') AS a, max(value) FILTER (WHERE event_type = 'purchase') AS b FROM events GROUP BY 1, 2)
  SELECT user_id, day, CASE WHEN na = 0 THEN 'left_missing' WHEN nb = 0 THEN 'right_missing' WHEN na > 1 AND nb > 1 THEN 'both_ambiguous' WHEN na > 1 THEN 'left_ambiguous' WHEN nb > 1 THEN 'right_ambiguous' ELSE 'paired' END AS outcome,
  CASE WHEN na = 1 AND nb = 1 THEN round(a, 7) END AS a, CASE WHEN na = 1 AND nb = 1 THEN round(b, 7) END AS b FROM r WHERE na > 0 OR nb > 0""", dates="day")
def j8_pairing_of_all(spark, sf):
    m = adapters.measurements(spark, sf).select("user_id", "day", "value", "event_type")
    return rounded(joins.pair_by_day(m.where("event_type = 'error'"), m.where("event_type = 'purchase'"), ["user_id"]))


@query("""WITH a AS (SELECT event_id AS anchor_id, user_id, ts AS anchor_ts FROM events WHERE event_type = 'error'), e AS (SELECT event_id, user_id, ts AS event_ts FROM events WHERE event_type = 'purchase'),
  r AS (SELECT *, rank() OVER (PARTITION BY anchor_id ORDER BY event_ts) AS r FROM a JOIN e USING (user_id) WHERE event_ts BETWEEN anchor_ts AND anchor_ts + INTERVAL 24 HOURS)
  SELECT user_id, anchor_id, any_value(anchor_ts) AS anchor_ts, min(event_id) AS event_id, min(event_ts) AS event_ts FROM r WHERE r = 1 GROUP BY user_id, anchor_id HAVING count(*) = 1""")
def j12_forward_asof(spark, sf):
    m = adapters.measurements(spark, sf)
    anchors = m.where("event_type = 'error'").select("user_id", F.col("event_id").alias("anchor_id"), "ts")
    return joins.forward_asof(anchors, m.where("event_type = 'purchase'").select("user_id", "event_id", "ts"), ["user_id"], 24 * 3600)


@query(f"""WITH {D} SELECT grp, day, round(value, 7) AS value, count(value) OVER w28 AS n, CASE WHEN count(value) OVER w28 >= 3 THEN round(avg(value) OVER w28, 7) END AS reference FROM d
  WINDOW w28 AS (PARTITION BY grp ORDER BY day RANGE BETWEEN INTERVAL 28 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)""", dates="day")
def j13_preceding_window(spark, sf):
    return rounded(joins.preceding_mean(medians(spark, sf), ["grp"]))


@query("""WITH i AS (SELECT event_id, date_trunc('hour', ts) AS s, date_trunc('hour', ts) + (event_id % 60) * INTERVAL 1 HOUR AS e FROM events WHERE event_id % 60 > 0)
  SELECT event_id, unnest(generate_series(s::DATE, (e - INTERVAL 1 MICROSECOND)::DATE, INTERVAL 1 DAY))::DATE AS day FROM i""", dates="day")
def j17_interval_days(spark, sf):
    start = F.date_trunc("hour", "ts")
    rows = load(spark, sf, "events").select("event_id", start.alias("start_ts"), F.timestamp_seconds(F.unix_seconds(start) + F.col("event_id") % 60 * 3600).alias("end_ts"))
    return joins.interval_days(rows).select("event_id", "day")


@query("""WITH v AS (SELECT l_orderkey, l_returnflag, avg(l_quantity) AS v FROM lineitem GROUP BY ALL), r AS (SELECT l_returnflag, avg(l_quantity) - 25.5 AS ref FROM lineitem WHERE l_orderkey % 10 = 0 GROUP BY ALL)
  SELECT l_orderkey, l_returnflag, round(v, 7) AS value, round(ref, 7) AS reference, round(v - ref, 7) AS delta, CASE WHEN ref <> 0 THEN round(100 * (v - ref) / ref, 2) END AS percent, CASE WHEN ref = 0 THEN 'zero_reference' END AS reason FROM v LEFT JOIN r USING (l_returnflag)""")
def g2_against_reference(spark, sf):
    li = load(spark, sf, "lineitem")
    values = li.groupBy("l_orderkey", "l_returnflag").agg(F.avg("l_quantity").alias("value"))
    reference = li.where("l_orderkey % 10 = 0").groupBy("l_returnflag").agg((F.avg("l_quantity") - 25.5).alias("reference"))
    out = joins.against_reference(values, ["l_returnflag"], reference)
    return rounded(out.withColumn("percent", F.round("percent", 2)))


# ---- identity -------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS supersedes FROM orders) SELECT id FROM c WHERE id NOT IN (SELECT supersedes FROM c WHERE supersedes IS NOT NULL)""")
def d19_current_heads(spark, sf):
    order = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    chain = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(order).alias("supersedes"))
    return identity.heads(chain.select("id"), chain)


@query("""SELECT user_id, ts::DATE AS day, count(*) AS "rows", count(DISTINCT event_type) AS contents, CASE WHEN count(DISTINCT event_type) > 1 THEN 'conflict' ELSE 'one' END AS outcome FROM events GROUP BY 1, 2""", dates="day")
def d12_batch_conflicts(spark, sf):
    return identity.in_batch_conflicts(adapters.measurements(spark, sf), ["user_id", "day"], ["event_type"])


@query("""SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def d25_newest_observation(spark, sf):
    return identity.newest_wins(load(spark, sf, "events"), KEYS, "ts", "event_id").select("user_id", "event_type", "event_id", "ts")


@query(f"""WITH {M}, l AS (SELECT *, CASE WHEN k % 5 > 0 THEN date_trunc('hour', ts) END AS t, max(day) OVER (PARTITION BY user_id) AS newest FROM m), n AS (SELECT *, bool_and(t IS NOT NULL) OVER (PARTITION BY user_id) AS timed, max(t) OVER (PARTITION BY user_id) AS top FROM l WHERE day = newest)
  SELECT user_id, event_id, day FROM n WHERE NOT timed OR t = top""", dates="day")
def d29_latest_snapshot(spark, sf):
    m = adapters.measurements(spark, sf).withColumn("ts", F.when(F.col("k") % 5 > 0, F.date_trunc("hour", "ts")))
    return identity.latest_snapshot(m, ["user_id"]).select("user_id", "event_id", "day")


@query("""WITH b AS (SELECT c_custkey AS id, c_mktsegment AS s, round(c_acctbal, 0) AS v FROM customer WHERE c_custkey % 5 <> 0), a AS (SELECT c_custkey AS id, c_mktsegment AS s, CASE WHEN c_custkey % 3 = 0 THEN round(c_acctbal, 0) + 1 ELSE round(c_acctbal, 0) END AS v FROM customer WHERE c_custkey % 7 <> 0)
  SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' WHEN a.s IS NOT DISTINCT FROM b.s AND a.v IS NOT DISTINCT FROM b.v THEN 'retained' ELSE 'changed' END AS change FROM b FULL JOIN a ON a.id = b.id""")
def y24_snapshot_diff(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment", F.round("c_acctbal").alias("v"))
    after = c.where("id % 7 <> 0").withColumn("v", F.when(F.col("id") % 3 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return identity.snapshot_diff(c.where("id % 5 <> 0"), after, "id", ["c_mktsegment", "v"])


@query("""SELECT sha256(concat_ws(chr(31), 'v' || user_id, 'v' || event_type, 'v' || ts::DATE)) AS key, count(*) AS n FROM events GROUP BY ALL""")
def d4_idempotency_key(spark, sf):
    return adapters.measurements(spark, sf).groupBy(idempotency_key(F.col("user_id"), F.col("event_type"), F.col("day")).alias("key")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, sha256('{"k":' || CAST(json_extract_string(props, '$.k') AS INT) || '}') AS hash FROM events""")
def d2_canonical_json_hash(spark, sf):
    return load(spark, sf, "events").select("event_id", manifest_hash(F.col("props")).alias("hash"))


# ---- periods, freshness, trips ---------------------------------------------------------------------


@query(f"""WITH {M}, r AS (SELECT *, CASE WHEN state IN ('null', 'invalid') THEN state END AS reason FROM m),
  y AS (SELECT event_type, string_agg(reason || ':' || n, ',' ORDER BY reason) AS reasons FROM (SELECT event_type, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY event_type)
  SELECT r.event_type, count(*) FILTER (WHERE reason IS NULL) AS eligible, count(*) FILTER (WHERE reason IS NOT NULL) AS excluded, round(sum(value) FILTER (WHERE reason IS NULL), 3) AS numerator, round(avg(value) FILTER (WHERE reason IS NULL), 3) AS mean,
  count(DISTINCT day) FILTER (WHERE reason IS NULL) AS observed_days, min(day) FILTER (WHERE reason IS NULL) AS first_day, max(day) FILTER (WHERE reason IS NULL) AS last_day, any_value(reasons) AS reasons FROM r LEFT JOIN y ON y.event_type = r.event_type GROUP BY r.event_type""", dates="first_day last_day")
def p2_metric_cell(spark, sf):
    m = adapters.measurements(spark, sf)
    return rounded(period.cell(m.withColumn("reason", F.when(F.col("state").isin("null", "invalid"), F.col("state"))), ["event_type"]), 3)


@query("""WITH w AS (SELECT user_id, value, ts::DATE AS day, CASE WHEN ts::DATE BETWEEN DATE '2024-01-16' AND DATE '2024-01-22' THEN 'now' WHEN ts::DATE BETWEEN DATE '2024-01-09' AND DATE '2024-01-15' THEN 'before' END AS w FROM events),
  a AS (SELECT user_id, avg(value) FILTER (WHERE w = 'now') AS nm, avg(value) FILTER (WHERE w = 'before') AS bm, count(DISTINCT day) FILTER (WHERE w = 'now') AS nd, count(DISTINCT day) FILTER (WHERE w = 'before') AS bd FROM w WHERE w IS NOT NULL GROUP BY user_id)
  SELECT user_id, round(nm, 3) AS now_mean, nd AS now_days, round(bm, 3) AS before_mean, bd AS before_days, CASE WHEN nd >= 14.0 / 3 AND bd >= 14.0 / 3 THEN round(nm - bm, 3) END AS delta, CASE WHEN NOT (nd >= 14.0 / 3 AND bd >= 14.0 / 3) THEN 'low_coverage' END AS reason FROM a""")
def p15_previous_window(spark, sf):
    return rounded(period.previous_window(adapters.measurements(spark, sf), ["user_id"], "2024-01-16", 7), 3)


@query("""SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE r = 1""")
def p14_most_frequent_type(spark, sf):
    return period.most_frequent(load(spark, sf, "events"), ["user_id"], "event_type")


@query("""SELECT role, sum(greatest(0, n - 1))::BIGINT AS duplicates, count(*) AS identities, count(*) FILTER (WHERE n > 1) AS repeated FROM (SELECT role, text, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY role""")
def p7_duplicates(spark, sf):
    return period.duplicates(load(spark, sf, "conversations"), ["role"], ["text"])


@query(f"""WITH {M}, d AS (SELECT user_id, day, sum(k) FILTER (WHERE event_type = 'click') AS c, sum(k) FILTER (WHERE event_type = 'view') AS o FROM m GROUP BY ALL),
  s AS (SELECT *, CASE WHEN day > DATE '2024-01-25' THEN 'future' WHEN c < o THEN 'conflict' WHEN c = 0 THEN 'zero' WHEN c IS NOT NULL THEN 'completed' WHEN o IS NOT NULL THEN 'incomplete' ELSE 'missing' END AS state FROM d)
  SELECT user_id, day, c::BIGINT AS completed, o::BIGINT AS observed, state, CASE WHEN state IN ('completed', 'zero') THEN c::BIGINT END AS counted FROM s""", dates="day")
def t1_trip_day(spark, sf):
    m = adapters.measurements(spark, sf)
    of = lambda t: F.sum(F.when(F.col("event_type") == t, F.col("k")))
    return period.trip_day(m.groupBy("user_id", "day").agg(of("click").alias("completed"), of("view").alias("observed")), "2024-01-25")


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
  SELECT user_id, event_id FROM n WHERE n <= 10 OR i IN (SELECT round_even(j * (n - 1) / 9.0, 0) FROM (SELECT unnest(range(0, 10)) AS j))""")
def v15_display_thinning(spark, sf):
    return period.thinned(load(spark, sf, "events").select("user_id", "event_id"), ["user_id"], 10, "event_id")


@query("""SELECT user_id, CASE WHEN count(*) <= 70 THEN count(*) END AS "rows", CASE WHEN count(*) <= 70 THEN round(sum(value), 3) END AS total, CASE WHEN count(*) > 70 THEN 'search_incomplete' ELSE 'complete' END AS status FROM events GROUP BY user_id""")
def o2_bounded_read(spark, sf):
    return rounded(period.bounded(load(spark, sf, "events"), 70, ["user_id"]), 3)


# ---- set operations and scalars ----------------------------------------------------------------------


@query("""SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE value > 400""")
def u1_union_ids(spark, sf):
    e = load(spark, sf, "events")
    return e.where("event_type = 'click'").select("user_id").union(e.where("value > 400").select("user_id")).distinct()


@query("""SELECT event_id, CASE WHEN regexp_full_match(json_extract_string(props, '$.k'), '(0|[1-9][0-9]{0,18})') THEN json_extract_string(props, '$.k')::BIGINT END AS k FROM events""")
def n4_exact_count(spark, sf):
    return load(spark, sf, "events").select("event_id", exact_count(F.get_json_object("props", "$.k")).alias("k"))


@query("""WITH m AS (SELECT event_id, hour(ts) * 60.0 + minute(ts) AS a, lag(hour(ts) * 60.0 + minute(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
  SELECT event_id, CAST(((a - b + 720) % 1440 + 1440) % 1440 - 720 AS DOUBLE) AS shift FROM m""")
def z9_clock_shift(spark, sf):
    minute = (F.hour("ts") * 60 + F.minute("ts")).cast("double")
    m = load(spark, sf, "events").select("event_id", "user_id", "ts", minute.alias("a"))
    b = F.lag("a").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return m.select("event_id", signed_circular(F.col("a"), b).alias("shift"))


# ---- streaming -------------------------------------------------------------------------------------------


@query("""SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL""")
def x7_tumbling_stream(spark, sf):
    return rounded(pipelines.tumbling(spark, sf), 3)


@query("""SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def x3_latest_upsert_stream(spark, sf):
    return pipelines.latest_by_key(spark, sf)


@query("""WITH g AS (SELECT user_id, ts, (ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS)::INT AS new FROM events), s AS (SELECT *, sum(coalesce(new, 1)) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM s GROUP BY user_id, sid""")
def x13_session_windows(spark, sf):
    w = F.session_window("ts", "6 hours")
    return load(spark, sf, "events").groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


@query("""WITH b AS (SELECT value, date_trunc('day', ts) AS d FROM events), s AS (SELECT value, d - (k * INTERVAL 1 DAY) AS start FROM b, (SELECT unnest(range(0, 7)) AS k))
  SELECT start, count(*) AS n, round(avg(value), 3) AS mean FROM s GROUP BY start""")
def x12_sliding_windows(spark, sf):
    w = F.window("ts", "7 days", "1 day")
    return rounded(load(spark, sf, "events").groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "n", "mean"), 3)


@query("""SELECT user_id, ts::DATE AS day, count(*) AS pages FROM events GROUP BY 1, 2 HAVING max(hour(ts)) = 23""", dates="day")
def x6_closed_days_stream(spark, sf):
    return pipelines.closed_days(spark, sf)
