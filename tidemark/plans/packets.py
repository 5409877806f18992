"""Composite packets: the results of several operators as one table of (section, subject, name, value, text).

A packet computes nothing of its own. Each section is the whole result of a registered query, a row for each of its columns
and subjects, so that a reader gets every number with the reason that stands beside it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.plans import more, nights, reading, rules  # noqa: F401  they register the sections
from tidemark.plans.registry import ORACLES, QUERIES, query
from tidemark.sources import frozen


class Section(NamedTuple):
    query: str
    subject: str  # columns that name what a row is about
    numbers: str
    texts: str = ""


PERIOD = [
    Section("p2_metric_cell", "event_type", "eligible excluded numerator mean observed_days", "first_day last_day reasons"),
    Section("p4_sleep_reducer", "user_id", "nights mean ambiguous_days excluded"),
    Section("p7_duplicates", "role", "duplicates identities repeated"),
    Section("p11_source_discovery", "user_id", "competing able", "state"),
    Section("p14_most_frequent_type", "user_id", "n", "event_type"),
    Section("p15_previous_window", "user_id", "now_mean now_days before_mean before_days delta", "reason"),
    Section("p16_exact_mean", "event_type", "n total mean"),
    Section("q7_activity_evidence", "event_type", "counted", "reasons"),
]
STATISTICS = [
    Section("r1_single_record_means", "user_id event_type", "days ambiguous total mean"),
    Section("r2_intensity_minutes", "user_id day", "moderate vigorous total"),
    Section("r3_intensity_weeks", "user_id week", "paired_days minutes goal", "complete"),
    Section("r4_daily_maximum", "user_id day", "samples most", "reason"),
    Section("r7_steps_statistics", "user_id", "total mean above_low above_high record record_days", "first_record_day"),
    Section("r8_longest_streaks", "user_id start", "days", "end"),
    Section("r10_steps_summary", "user_id", "n total mean"),
    Section("r13_half_up_mean", "user_id", "n total mean"),
    Section("p2_metric_cell", "event_type", "eligible excluded numerator mean observed_days", "reasons"),
]
SERIES = [
    Section("b1_availability", "user_id event_type", "n_value n_zero n_partial n_null n_invalid n_ambiguous n_usable"),
    Section("b3_scalar_baseline", "user_id event_type", "n mean least most p10 p25 p50 p75 p90", "reason"),
    Section("b4_midrank_percentile", "user_id event_type", "latest n percentile"),
    Section("b5_theil_sen", "user_id event_type", "days slope pairs", "reason"),
    Section("b6_robust_z", "user_id event_type", "n latest median mad z", "flagged reason"),
]
SLEEP = [
    Section("p4_sleep_reducer", "user_id", "nights mean ambiguous_days excluded"),
    Section("q13_sleep_timeline", "user_id", "nights longest_step mean", "first_night last_night"),
    Section("r16_latest_night", "user_id day", "duration"),
    Section("z16_regularity", "user_id event_type", "n resultant"),
    Section("y33_source_inventory", "user_id role", "sessions days"),
]
DOMAINS = [Section("r17_domains", "domain metric", "n days mean", "first_day last_day")]


def packet(spark: SparkSession, sf_dir: str, sections: Sequence[Section]) -> DataFrame:
    def tall(s: Section) -> DataFrame:
        rows = QUERIES[s.query](spark, sf_dir)
        cells = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"), F.lit(None).cast("string").alias("text")) for c in s.numbers.split()]
        cells += [F.struct(F.lit(c).alias("name"), F.lit(None).cast("double").alias("value"), F.col(c).cast("string").alias("text")) for c in s.texts.split()]
        return rows.select(F.lit(s.query).alias("section"), F.concat_ws("|", *[F.col(c).cast("string") for c in s.subject.split()]).alias("subject"), F.inline(F.array(*cells)))

    return reduce(DataFrame.union, map(tall, sections))


def packet_sql(sections: Sequence[Section]) -> str:
    def tall(s: Section) -> str:
        cells = [f"{{'name': '{c}', 'value': \"{c}\"::DOUBLE, 'text': NULL::VARCHAR}}" for c in s.numbers.split()]
        cells += [f"{{'name': '{c}', 'value': NULL::DOUBLE, 'text': \"{c}\"::VARCHAR}}" for c in s.texts.split()]
        subject = ", ".join(f'"{c}"::VARCHAR' for c in s.subject.split())
        return f"SELECT '{s.query}' AS section, concat_ws('|', {subject}) AS subject, unnest([{', '.join(cells)}]) AS x FROM ({ORACLES[s.query]})"

    return f"SELECT section, subject, x.name AS name, x.value AS value, x.text AS text FROM ({' UNION ALL '.join(map(tall, sections))})"


@query(packet_sql(PERIOD))
def q3_period_packet(spark, sf):
    """The period summary with all its sections."""
    return packet(spark, sf, PERIOD)


@query(packet_sql(STATISTICS))
def q16_statistics_packet(spark, sf):
    """The statistics page: every reader of days, weeks, streaks and totals."""
    return packet(spark, sf, STATISTICS)


@query(packet_sql(SERIES))
def q2_series_packets(spark, sf):
    """Each series with availability, baseline, position, trend and deviation."""
    return packet(spark, sf, SERIES)


@query(packet_sql(SLEEP))
def q6_sleep_packet(spark, sf):
    return packet(spark, sf, SLEEP)


@query(packet_sql(SLEEP + DOMAINS + PERIOD[-1:]))
def q8_combined_packet(spark, sf):
    """Sleep, the domains and the activities in one (also Q5)."""
    return packet(spark, sf, SLEEP + DOMAINS + PERIOD[-1:])


@query(f"""WITH c AS (SELECT subject, section, name, value::BIGINT AS value FROM ({packet_sql([Section('b1_availability', 'user_id', 'n_value n_zero n_partial n_null n_invalid n_ambiguous n_usable'), Section('q4_period_brief', 'user_id', 'higher lower similar unsaid')])})),
  t AS (SELECT subject, section, name, sum(value)::BIGINT AS value FROM c GROUP BY ALL), b AS (SELECT subject, section, count(*) AS n, sha256(string_agg(concat_ws(chr(31), 'v' || name, 'v' || value), chr(30) ORDER BY name)) AS h FROM t GROUP BY ALL)
  SELECT subject, sum(n)::BIGINT AS n, sha256(string_agg(h, chr(30) ORDER BY section)) AS digest FROM b GROUP BY subject""")
def q9_packet_digests(spark, sf):
    """The digest that freezes each user's packet of counts."""
    sections = [Section("b1_availability", "user_id", "n_value n_zero n_partial n_null n_invalid n_ambiguous n_usable"), Section("q4_period_brief", "user_id", "higher lower similar unsaid")]
    counts = packet(spark, sf, sections).groupBy("subject", "section", "name").agg(F.sum("value").cast("long").alias("value"))
    return frozen.list_digest(counts, ["subject"], F.col("section"), ["name"], ["name", "value"])
