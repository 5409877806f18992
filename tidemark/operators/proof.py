"""Proofs from evidence: every check of a candidate in one pass, all that fail kept as bits and as names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import idempotency_key

#: Normalisation contracts whose placeholders are known.
CONTRACTS = [f"normalization-contract-v{n}" for n in range(1, 6)]
RECONCILIATION = "collection-reconciliation-v1"
PARSER = "provider-normalization"
FINGERPRINT = "provider-observation:"
#: Daily surfaces besides the one that carries the metric.
OTHER_SURFACES = ("heart_rate", "body_battery", "respiration", "spo2", "steps")


def with_failures(rows: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """rows with failed (a bit for each check that does not hold, the first check being bit 0) and reasons (their names in order).

    A check over absent evidence is null and counts as failed. 63 checks at most.
    """
    if len(checks) > 63:
        raise ValueError("a long holds 63 checks at most")
    bits = [F.when(F.coalesce(held, F.lit(False)), F.lit(0)).otherwise(F.lit(1 << i)).cast("long") for i, held in enumerate(checks.values())]
    return named_failures(rows.withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long"))), list(checks))


def named_failures(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """rows with the names of the bits of failed as reasons."""
    named = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(1 << i).cast("long").alias("bit")) for i, name in enumerate(names)])
    reasons = F.transform(F.filter(named, lambda x: F.col("failed").bitwiseAND(x["bit"]) != 0), lambda x: x["name"])
    return rows.withColumn("reasons", reasons)


def observation_key(observation: Column, content_hash: Column) -> Column:
    return idempotency_key(content_hash, *[observation[c] for c in ("source_id", "stream", "format", "contract", "filename")])


def collection_key(source: Column, record: Column) -> Column:
    return idempotency_key(source["instance"], F.lit("intraday"), record["surface"], record["local_date"], record["local_date"])


def placeholder_checks(metric_code: str = "stress_daily_average", capability: str = "stress", unit: str = "points", field: str = "avgStressLevel", provider: str = "provider", surfaces: Sequence[str] = OTHER_SURFACES) -> dict[str, Column]:
    """The checks that prove a missing metric to be a normaliser's placeholder on a surface that never carries it.

    They read the structs record, metric, payload, observation, source, event and batch of placeholder_proof.
    """
    r, m, p, o, s, e, b = (F.col(c) for c in ("record", "metric", "payload", "observation", "source", "event", "batch"))
    present = {f"{name}_absent": F.col(name).isNotNull() for name in ("record", "metric", "payload", "observation", "source", "event", "batch")}
    return present | {
        "source_kind": s["kind"] == "provider",
        "source_provider": s["provider_code"] == provider,
        "surface": r["surface"].isin(*surfaces),
        "projection_status": r["projection_status"] == "current",
        "record_stream": r["stream"] == "intraday",
        "local_date": r["local_date"].isNotNull(),
        "source_path": F.length(r["source_path"]) > 0,
        "metric_code": m["code"] == metric_code,
        "capability": m["capability"] == capability,
        "metric_state": m["state"] == "missing",
        "number": m["number"].isNull(),
        "text": m["text"].isNull(),
        "collection": m["collection"].isNull(),
        "metric_reason": m["reason"].isNull(),
        "unit": m["unit"] == unit,
        "field_path": m["field_path"] == F.concat(r["source_path"], F.lit(f".{field}")),
        "metric_record": m["record_id"] == r["id"],
        "attribution": m["attributed"].eqNullSafe(s["attributed"]),
        "contract": r["contract"].isin(*CONTRACTS),
        "contract_of_observation": r["contract"] == o["contract"],
        "reconciliation": r["reconciliation"] == RECONCILIATION,
        "reconciliation_of_observation": r["reconciliation"] == o["reconciliation"],
        "record_payload": r["payload_id"] == p["id"],
        "payload_source": p["source_id"] == s["id"],
        "observation_source": o["source_id"] == s["id"],
        "observation_payload": o["payload_id"] == p["id"],
        "observation_artifact": o["artifact_id"] == p["artifact_id"],
        "payload_stream": p["stream"] == "intraday",
        "observation_stream": o["stream"] == "intraday",
        "payload_format": p["format"] == "json",
        "observation_format": o["format"] == "json",
        "observation_filename": o["filename"] == F.concat(r["surface"], F.lit(".json")),
        "ingest_event": r["event_id"] == o["event_id"],
        "event_source": e["acquisition_id"] == s["acquisition_id"],
        "event_artifact": e["artifact_id"] == p["artifact_id"],
        "event_stream": e["stream"] == "intraday",
        "event_fingerprint": e["fingerprint"] == F.concat(F.lit(FINGERPRINT), o["key"]),
        "event_status": e["status"] == "committed",
        "batch_status": b["status"] == "committed",
        "batch_source": b["acquisition_id"] == s["acquisition_id"],
        "batch_kind": b["kind"] == "provider_sync",
        "batch_parser": b["parser"] == PARSER,
        "batch_version": b["version"] == o["contract"],
        "observation_key": o["key"] == observation_key(o, p["content_hash"]),
        "collection_key": r["collection_key"] == collection_key(s, r),
    }


#: The tables in the order in which they are joined, and what names their row.
_JOINS = {
    "record": "record_id", "source": "_record_source_id", "metric": "metric_id", "payload": "payload_id", "observation": "observation_id", "event": "_observation_event_id", "batch": "_event_batch_id",
}
#: The checks that read one table alone, and those that read it and tables joined before it.
_ALONE = {
    "record": "record_absent surface projection_status record_stream local_date source_path contract reconciliation", "source": "source_absent source_kind source_provider",
    "metric": "metric_absent metric_code capability metric_state number text collection metric_reason unit", "payload": "payload_absent payload_stream payload_format",
    "observation": "observation_absent observation_stream observation_format", "event": "event_absent event_stream event_status", "batch": "batch_absent batch_status batch_kind batch_parser",
}
_AGAINST = {
    "record": "", "source": "collection_key", "metric": "field_path metric_record attribution", "payload": "record_payload payload_source",
    "observation": "contract_of_observation reconciliation_of_observation observation_source observation_payload observation_artifact observation_filename ingest_event observation_key",
    "event": "event_source event_artifact event_fingerprint", "batch": "batch_source batch_version",
}
#: Checks that a value is null; they hold over an absent row.
_NULL = "number text collection metric_reason".split()


def placeholder_proof(candidates: DataFrame, tables: Mapping[str, DataFrame], **fixed) -> DataFrame:
    """candidates (record_id, metric_id, payload_id, observation_id) with failed, reasons and proven.

    tables: record, metric, payload, observation, source, event and batch, each with an id that is unique in it. The evidence
    of a candidate is joined once, with absent rows as nulls. Each check is made as soon as what it reads is there, on one table
    before it is joined, and is a bit from then on, so that a join ships only what later checks read.
    """
    checks = placeholder_checks(**fixed)
    bits = {name: 1 << i for i, name in enumerate(checks)}
    failing = lambda names: reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.coalesce(checks[n], F.lit(False)), F.lit(0)).otherwise(F.lit(bits[n])).cast("long") for n in names], F.lit(0).cast("long"))
    met, joined = candidates.withColumn("_failed", F.lit(0).cast("long")), []
    for name, at in _JOINS.items():
        columns = tables[name].columns
        alone, against = _ALONE[name].split(), _AGAINST[name].split()
        rows = tables[name].select(F.struct(*columns).alias(name))
        found = rows.select(failing(alone).alias(f"_{name}"), *[F.col(name)[c].alias(f"_{name}_{c}") for c in columns])
        absent = sum(bits[n] for n in alone if n not in _NULL)
        joined.append((name, columns))
        met = met.join(found, F.col(at) == F.col(f"_{name}_id"), "left")
        plain = met.columns
        here = met.withColumns({t: F.struct(*[F.col(f"_{t}_{c}").alias(c) for c in cs]) for t, cs in joined})  # of nulls where absent; unlike a null struct, only its fields that are read are shipped
        failed = F.col("_failed").bitwiseOR(F.coalesce(f"_{name}", F.lit(absent).cast("long"))).bitwiseOR(failing(against))
        met = here.select(*[c for c in plain if c not in ("_failed", f"_{name}")], failed.alias("_failed"))
    return named_failures(met.select(*candidates.columns, F.col("_failed").alias("failed")), list(checks)).withColumn("proven", F.col("failed") == 0)
