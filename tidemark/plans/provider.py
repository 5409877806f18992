"""Queries of the provider's ten streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import provider_streams
from tidemark.operators.provider_streams import COMPONENTS, FIELDS
from tidemark.plans.registry import query
from tidemark.session import load

_STREAMS = list(FIELDS)
#: What stands at every field of a point, by event_id // 10 % 12; the last three are of the parent, if there is one.
_TOKENS = [None, "null", "50", '" 51 "', '"x"', "true", "-5", "50.5", '"STAGES"', '"2024-01-02T03:04:05Z"', "parent_missing", "parent_null", "parent_list"]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as points of a stream each, all fields of which hold the same token."""

    def shaped(stream: str, token: str | None) -> str:
        """The JSON of a point; the parent tokens put 50 at fields without a parent."""
        odd = token if token in {"parent_missing", "parent_null", "parent_list"} else None
        held = "50" if odd else token
        parts: dict[str | None, list[str]] = {}
        for f in FIELDS[stream]:
            parts.setdefault(f.parent, []).append("" if held is None else f'"{f.name}": {held}')
        body = [x for x in parts.pop(None, []) if x]
        for parent, fields in parts.items():
            if odd != "parent_missing":
                body.append(f'"{parent}": ' + ("null" if odd == "parent_null" else "[1]" if odd == "parent_list" else "{" + ", ".join(x for x in fields if x) + "}"))
        return '{"name": "p", "' + COMPONENTS[stream] + '": {' + ", ".join(body) + "}}"

    e = load(spark, sf_dir, "events")
    i = F.col("event_id")
    texts = F.array(*[F.array(*[F.lit(shaped(s, t)) for t in _TOKENS]) for s in _STREAMS])
    text = F.element_at(F.element_at(texts, (i % 10 + 1).cast("int")), (F.floor(i / 10) % len(_TOKENS) + 1).cast("int"))
    text = F.when(i % 89 == 0, F.lit('{"name": "p"}')).when(i % 89 == 1, F.lit('{"heartRate": 1, "sleep": [], "oxygenSaturation": null}')).otherwise(text)
    return e.select("event_id", F.element_at(F.array(*[F.lit(s) for s in _STREAMS]), (i % 10 + 1).cast("int")).alias("stream"), F.parse_json(text).alias("point"))


_SPECS = ", ".join(
    "(" + ", ".join([f"'{s}'", f"'{f.metric}'", f"'{f.kind}'", "NULL" if f.parent is None else f"'{f.parent}'", str(f.required), "-1e9" if f.least is None else str(f.least), "1e9" if f.most is None else str(f.most), str(bool(f.allowed))]) + ")" for s, fs in FIELDS.items() for f in fs
)
_POINTS = f"""e AS (SELECT event_id, {_STREAMS}[event_id % 10 + 1] AS stream, event_id // 10 % {len(_TOKENS)} AS t, event_id % 89 AS odd FROM events), f(stream, metric, kind, parent, required, low, high, closed) AS (VALUES {_SPECS}),
  c AS (SELECT event_id, stream, CASE WHEN odd = 0 OR (odd = 1 AND stream NOT IN ('heart_rate', 'heart_rate_rollup', 'sleep', 'spo2')) THEN 'data_type_union_missing' WHEN odd = 1 THEN 'data_type_component_shape' END AS fault, t FROM e),
  j AS (SELECT event_id, c.stream, fault, f.*, CASE WHEN t >= 10 THEN 2 ELSE t END AS u, t FROM c LEFT JOIN f ON f.stream = c.stream AND fault IS NULL),
  x AS (SELECT event_id, stream, coalesce(required, true) AS required, metric, CASE u WHEN 2 THEN 50.0 WHEN 3 THEN 51.0 WHEN 6 THEN -5.0 WHEN 7 THEN 50.5 END AS v, kind, low, high,
    CASE WHEN fault IS NOT NULL THEN fault WHEN parent IS NOT NULL AND t = 10 THEN 'parent_field_missing' WHEN parent IS NOT NULL AND t = 11 THEN 'parent_field_null' WHEN parent IS NOT NULL AND t = 12 THEN 'parent_shape_invalid'
      WHEN u = 0 THEN CASE WHEN required THEN 'required_' ELSE '' END || 'field_missing' WHEN u = 1 THEN CASE WHEN required THEN 'required_' ELSE '' END || 'field_null'
      WHEN kind = 'text' THEN CASE WHEN u NOT IN (3, 4, 8, 9) THEN 'string_shape_invalid' WHEN closed AND u <> 8 THEN 'enum_unknown' END WHEN kind = 'flag' THEN CASE WHEN u <> 5 THEN 'boolean_shape_invalid' END
      WHEN kind = 'timestamp' THEN CASE WHEN u <> 9 THEN 'timestamp_invalid' END WHEN v IS NULL OR (kind = 'integer' AND u = 7) THEN 'numeric_invalid_or_non_finite' WHEN v < low OR v > high THEN 'numeric_out_of_range' END AS reason FROM j),
  s AS (SELECT *, CASE WHEN reason IS NULL THEN 'value' WHEN reason LIKE '%\\_missing' ESCAPE '\\' THEN 'missing' WHEN reason LIKE '%\\_null' ESCAPE '\\' THEN 'null' ELSE 'invalid' END AS state FROM x),
  y AS (SELECT event_id, stream, required, metric, CASE WHEN reason LIKE 'data_type%' THEN 'invalid' ELSE state END AS state, reason, CASE WHEN reason IS NULL AND kind IN ('number', 'integer') THEN v END AS number FROM s)"""


@query(f"WITH {_POINTS} SELECT event_id, stream, metric, state, reason, number::DOUBLE AS number FROM y")
def n21_provider_streams(spark, sf):
    """All ten streams, each field with its state and reason (N20 chooses the fields by stream inside one pass)."""
    return provider_streams.normalized_points(points(spark, sf), ["event_id"]).select("event_id", "stream", "metric", "state", "reason", "number")


@query(f"WITH {_POINTS} SELECT event_id, stream, CASE WHEN bool_or(required AND state <> 'value') OR (stream = 'daily_hrv' AND count(*) FILTER (WHERE state = 'value') = 0) THEN 'invalid' WHEN bool_or(state = 'invalid') THEN 'partial' ELSE 'ok' END AS status, count(*) FILTER (WHERE state = 'value') AS n_values FROM y GROUP BY event_id, stream")
def n20_point_status(spark, sf):
    """What became of each point as a whole."""
    return provider_streams.point_status(provider_streams.normalized_points(points(spark, sf), ["event_id"]), ["event_id"])
