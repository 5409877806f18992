"""Data points in their odd cases: unknown streams, absent components, parents of the wrong shape, text numbers, bounds."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import provider_streams


@pytest.fixture(scope="module")
def found(spark):
    given = [
        ("heart_rate", {"heartRate": {"beatsPerMinute": " 61 ", "metadata": {"motionContext": " ACTIVE "}}}),
        ("heart_rate", {"heartRate": {"beatsPerMinute": 61.5, "metadata": None}}),
        ("heart_rate", {"heartRate": {"beatsPerMinute": "+07"}}),
        ("spo2", {"oxygenSaturation": {"percentage": 100.5}}),
        ("spo2", {"oxygenSaturation": {"percentage": "99.5"}}),
        ("daily_hrv", {"dailyHeartRateVariability": {}}),
        ("sleep", {"sleep": {"type": "NAP", "metadata": {"main": "true", "nap": False}, "createTime": "2024-13-01T00:00:00Z", "updateTime": "2024-01-01T00:00:00+02:00", "summary": []}}),
        ("sleep", {"heartRate": {}}),
        ("hrv", {"heartRateVariability": [1]}),
        ("unknown", {"heartRate": {}}),
        (None, {"heartRate": {}}),
        ("hrv", None),
    ]
    rows = spark.createDataFrame([(i, s, None if p is None else json.dumps(p)) for i, (s, p) in enumerate(given)], "id long, stream string, text string")
    metrics = provider_streams.normalized_points(rows.select("id", "stream", F.parse_json("text").alias("point")), ["id"]).persist()
    return metrics, {(r.id, r.metric): r for r in metrics.collect()}


def test_values_and_reasons(found):
    rows = found[1]
    says = lambda i, m: (rows[i, m].state, rows[i, m].reason, rows[i, m].number)
    assert says(0, "heart_rate_bpm") == ("value", None, 61.0) and rows[0, "heart_rate_motion_context"].text == "ACTIVE"
    assert says(0, "heart_rate_sensor_location") == ("missing", "field_missing", None)
    assert says(1, "heart_rate_bpm") == ("invalid", "numeric_invalid_or_non_finite", None)
    assert says(1, "heart_rate_motion_context") == ("null", "parent_field_null", None)
    assert says(2, "heart_rate_bpm")[1] == "numeric_invalid_or_non_finite" and says(2, "heart_rate_sensor_location")[1] == "parent_field_missing"
    assert says(3, "oxygen_saturation_percentage") == ("invalid", "numeric_out_of_range", None) and says(4, "oxygen_saturation_percentage")[2] == 99.5
    assert says(6, "sleep_type")[1] == "enum_unknown" and says(6, "sleep_metadata_main")[1] == "boolean_shape_invalid" and rows[6, "sleep_metadata_nap"].flag is False
    assert says(6, "sleep_create_time")[1] == "timestamp_invalid" and says(6, "sleep_update_time")[0] == "value" and says(6, "sleep_summary_minutes_awake")[1] == "parent_shape_invalid"
    assert [says(i, None)[:2] for i in (7, 8, 9, 10, 11)] == [("invalid", r) for r in ("data_type_union_missing", "data_type_component_shape", "unsupported_stream", "unsupported_stream", "data_type_union_missing")]


def test_status_of_points(found):
    status = {r.id: (r.status, r.n_values) for r in provider_streams.point_status(found[0], ["id"]).collect()}
    assert status == {0: ("ok", 2), 1: ("invalid", 0), 2: ("invalid", 0), 3: ("invalid", 0), 4: ("ok", 1), 5: ("invalid", 0), 6: ("partial", 2), **{i: ("invalid", 0) for i in range(7, 12)}}
