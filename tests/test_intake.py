"""Photo fields, stage lists and the combined persist in their odd cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intake

PHOTO = "id long, metric string, unit string, confidence double, field_date date, field_ts timestamp, field_precision string, group_date date, group_ts timestamp, group_precision string, zone string, offset_minutes int"
DAY, LATE = dt.date(2024, 3, 1), dt.datetime(2024, 3, 1, 20, 30, 15)


@pytest.fixture(scope="module")
def photos(spark):
    given = [
        ("weight", " Pounds", 0.5, DAY, None, None, None, None, None, None, None),
        ("weight", "pct", -0.1, None, None, None, None, None, None, None, None),
        ("water_pct", "kg", float("nan"), None, LATE, "date", None, None, None, None, None),
        ("pulse", "", None, None, None, "", DAY, LATE, "", None, None),
        ("pulse", "bpm", 1.0, DAY, LATE, "instant", None, None, None, "Asia/Tokyo", None),
        ("pulse", None, 0.0, dt.date(2024, 3, 2), LATE, None, None, None, None, "Asia/Tokyo", None),
        ("pulse", None, None, DAY, LATE, None, None, None, None, "No/Where", None),
        ("pulse", None, None, DAY, LATE, None, None, None, None, None, 540),
        ("pulse", None, None, dt.date(2024, 3, 2), LATE, None, None, None, None, None, None),
        ("pulse", None, None, dt.date(2024, 3, 3), LATE, None, None, None, None, None, None),
        ("pulse", None, None, DAY, None, "minute", None, None, None, None, None),
        (None,) * 11,
    ]
    rows = spark.createDataFrame([(i, *g) for i, g in enumerate(given)], PHOTO)
    return {r.id: r for r in intake.photo_fields(rows, ["id"]).collect()}


def test_photo_units_and_warnings(photos):
    assert (photos[0].unit, photos[0].precision, photos[0].warnings) == ("lb", "date", [])
    assert photos[1].unit == "%" and photos[1].warnings == ["impossible_unit", "confidence_out_of_range", "missing_source_date"]
    assert photos[2].ts is None and photos[2].date == DAY
    assert photos[2].warnings == ["impossible_unit", "confidence_out_of_range", "date_precision_drops_timestamp"]
    assert photos[3].unit is None and photos[3].precision == "instant" and photos[3].warnings == []
    assert photos[10].warnings == ["missing_timestamp"] and photos[10].error is None
    assert photos[11].precision is None and photos[11].warnings == ["missing_source_date"]


def test_photo_dates_that_instants_contradict(photos):
    assert [photos[i].error for i in range(4, 10)] == ["date_contradicts_zone", None, "zone_not_usable", "date_contradicts_offset", None, "date_contradicts_instant"]
    assert photos[4].warnings == ["unrecognized_unit"] and photos[4].unit == "bpm"


def stage(a, b, level=1):
    return {"startGMT": f"2024-03-01T{a}:00", "endGMT": f"2024-03-01T{b}:00", "activityLevel": level}


@pytest.fixture(scope="module")
def nights(spark):
    at = lambda h: int(dt.datetime(2024, 3, 1, h, tzinfo=dt.UTC).timestamp() * 1000)
    bounds = {"sleepStartTimestampGMT": at(1), "sleepEndTimestampGMT": at(3)}
    whole = [stage("01:00", "02:00", 0), stage("02:00", "03:00", 3.0)]
    given = {
        "whole": {**bounds, "sleepLevels": whole},
        "twice": {**bounds, "sleepLevels": whole, "levels": None},
        "unbound": {"sleepLevels": whole},
        "gap": {**bounds, "sleepLevels": [stage("01:00", "01:30"), stage("02:00", "03:00")]},
        "odd": {**bounds, "sleepLevels": [None, 5, "x", [], {}, stage("02:00", "01:00"), stage("01:00", "02:00", True), stage("01:00", "02:00", "1"), stage("01:00", "02:00", 4), stage("01:00", "02:00", 1.5), stage("25:00", "26:00")]},
        "offset": {**bounds, "sleepLevels": [{"startGMT": "2024-03-01T02:00:00+01:00", "endGMT": "2024-03-01T03:00:00Z", "activityLevel": 2}]},
        "empty": {"sleepLevels": []},
        "null": {"sleepLevels": None},
        "text": {"sleepLevels": "[]"},
        "missing": {},
    }
    rows = [(n, json.dumps(p)) for n, p in given.items()] + [("none", None)]
    df = spark.createDataFrame(rows, "night string, text string").select("night", F.parse_json("text").alias("payload"))
    return {r.night: r for r in intake.stage_lists(df, ["night"], "payload").collect()}, intake.stage_rows(df, ["night"], "payload").collect()


def test_stage_lists(nights):
    says = {n: (r.state, r.reason, r.stages) for n, r in nights[0].items()}
    assert says == {
        "whole": ("value", None, 2), "twice": ("value", "partial_collection", 2), "unbound": ("value", "partial_collection", 2), "gap": ("value", "partial_collection", 2),
        "odd": ("invalid", "shape_drift", 0), "offset": ("value", None, 1), "empty": ("value", None, 0), "null": ("null", None, 0), "text": ("invalid", "shape_drift", 0),
        "missing": ("missing", None, 0), "none": ("missing", None, 0),
    }
    assert nights[0]["twice"].diagnostics == ["sleep_stage_alias_conflict"] and nights[0]["unbound"].diagnostics == ["sleep_stage_boundary_mismatch"]
    assert nights[0]["gap"].diagnostics == ["sleep_stage_discontinuity"]


def test_stage_rows(nights):
    odd = sorted((r for r in nights[1] if r.night == "odd"), key=lambda r: r.ordinal)
    assert [r.reason for r in odd] == ["sleep_stage_shape_drift"] * 4 + ["sleep_stage_invalid"] * 7
    assert [r.stage for r in nights[1] if r.night == "whole"] == ["DEEP", "AWAKE"]


RESULT, MEMBER = "scope long, received date, complete boolean, text string", "scope long, received date, record string, content long"


def empty(spark):
    return intake.Stored(
        spark.createDataFrame([], "scope long, content_hash string, text string"),
        spark.createDataFrame([], "scope long, observation_key string, received date, complete boolean, outcome string"),
        spark.createDataFrame([], "scope long, record string, content long, observed date, retired boolean, outcome string"),
    )


def day(n):
    return dt.date(2024, 3, n)


def batch(spark, results, members):
    return spark.createDataFrame(results, RESULT), spark.createDataFrame(members, MEMBER)


def state(stored):
    return {(r.scope, r.record): (r.content, r.observed, r.retired) for r in stored.records.collect()}


def outcomes(stored):
    return {(r.scope, r.record): r.outcome for r in stored.records.collect()}


def test_persist_retires_restores_and_repeats(spark):
    first = batch(spark, [(1, day(1), False, "a"), (1, day(2), True, "b"), (2, day(1), True, "a"), (None, day(1), True, "x"), (1, None, True, None)], [(1, day(1), "p", 1), (1, day(1), "q", 1), (1, day(2), "p", 2), (2, day(1), "p", None), (3, day(1), "p", 9)])
    one = intake.persisted(empty(spark), *first)
    assert state(one) == {(1, "p"): (2, day(2), False), (1, "q"): (1, day(1), True), (2, "p"): (None, day(1), False)}
    again = intake.persisted(one, *first)
    assert state(again) == state(one) and set(outcomes(again).values()) == {"kept"}
    assert again.raw.count() == one.raw.count() and again.observations.count() == one.observations.count()
    late = intake.persisted(one, *batch(spark, [(1, day(1), True, "other")], [(1, day(1), "p", 7)]))
    assert state(late) == state(one)
    assert [r.outcome for r in late.observations.where("scope = 1 AND received = DATE '2024-03-01'").orderBy("outcome").collect()] == ["new", "stale"]
    last = intake.persisted(one, *batch(spark, [(1, day(3), True, "c"), (2, day(2), True, "d")], [(1, day(3), "q", 1), (1, day(3), "p", 2)]))
    assert outcomes(last) == {(1, "p"): "same", (1, "q"): "restored", (2, "p"): "retired"}


def test_persist_in_any_split_of_ordered_results(spark):
    """Results in order of their receipt give the same records however they are cut into batches."""
    results = [(s, day(d), d % 3 == 0, f"{s}-{d}") for s in (1, 2) for d in range(1, 10)]
    members = [(s, day(d), r, s * d) for s in (1, 2) for d in range(1, 10) for i, r in enumerate("pqr") if (s + d * (i + 2)) % 4]
    whole = state(intake.persisted(empty(spark), *batch(spark, results, members)))
    assert any(x[2] for x in whole.values()) and not all(x[2] for x in whole.values())
    for cuts in [(4,), (3, 7)]:
        stored, low = empty(spark), 0
        for high in (*cuts, 9):
            inside = lambda r, low=low, high=high: low < r[1].day <= high
            stored = intake.persisted(stored, *batch(spark, [r for r in results if inside(r)], [m for m in members if inside(m)]))
            low = high
        assert state(stored) == whole


def test_persist_of_nothing(spark):
    out = intake.persisted(empty(spark), *batch(spark, [], []))
    assert [x.count() for x in out] == [0, 0, 0]
