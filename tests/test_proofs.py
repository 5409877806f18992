"""Proofs, device attribution and frozen inputs against plain Python and in their odd cases."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import devices, proof
from tidemark.plans import evidence_proofs
from tidemark.sources import frozen


def test_every_check_fails_once_and_is_named(spark):
    candidates, tables = evidence_proofs.evidence(spark, "/root/testdata/sf0.001")
    found = {r.event_id: r for r in proof.placeholder_proof(candidates, tables).collect()}
    names = list(proof.placeholder_checks())
    assert names == evidence_proofs._CHECKS and len(names) == 52
    alone = {tuple(r.reasons) for r in found.values() if len(r.reasons) == 1}
    assert {n for (n,) in alone} >= set(names[9:52]) and any(r.proven for r in found.values())
    assert all(r.failed == sum(1 << names.index(n) for n in r.reasons) and r.proven == (not r.reasons) for r in found.values())


@pytest.mark.parametrize("gone", ["record", "metric", "payload", "observation", "source", "event", "batch"])
def test_absent_evidence_fails_all_that_reads_it(spark, gone):
    candidates, tables = evidence_proofs.evidence(spark, "/root/testdata/sf0.001")
    one = candidates.where("event_id = 1")
    row = proof.placeholder_proof(one, {**tables, gone: tables[gone].where("false")}).first()
    assert f"{gone}_absent" in row.reasons and not row.proven and len(row.reasons) > 1
    assert row.event_id == 1


def test_bits_and_their_bound(spark):
    rows = proof.with_failures(spark.createDataFrame([(1, None), (-1, 2)], "a int, b int"), {"a": F.col("a") > 0, "b": F.col("b") > 0}).collect()
    assert [(r.failed, r.reasons) for r in rows] == [(2, ["b"]), (1, ["a"])]
    with pytest.raises(ValueError, match="63"):
        proof.with_failures(spark.range(1), {str(i): F.lit(True) for i in range(64)})


def walked(payload):
    """The attribution by plain recursion."""
    says, nodes, wide = set(), 0, False
    low = lambda x, chars: "".join(c for c in x.lower() if c not in chars)

    def marker(x):
        if isinstance(x, bool) or not isinstance(x, (str, int, float)):
            return says.add("opaque")
        text = low(str(x), "-_ \t")
        hits = {n for n, marks in (("target", devices.TARGET_MARKERS), ("other", devices.OTHER_MARKERS)) if any(m in text for m in marks)}
        says.update(hits or {"opaque"})

    def walk(x, context):
        nonlocal nodes, wide
        nodes += 1
        if isinstance(x, (dict, list)):
            wide |= len(x) > 64
        if isinstance(x, list):
            for y in x:
                walk(y, context)
        if isinstance(x, dict):
            for k, y in x.items():
                name = "".join(c for c in k.lower() if c.isascii() and c.isalnum())
                if name not in devices.IDENTIFIER_KEYS and "device" in name:
                    says.add("device")
                    if name in ("deviceattributed", "isdeviceattributed"):
                        says.update({"plain"} if y is False else {"opaque"} if y is True else ())
                        continue
                    if isinstance(y, (str, int, float)) and not isinstance(y, bool):
                        marker(y)
                    elif y is None or y in ({}, []):
                        says.add("opaque")
                    walk(y, True)
                elif context and (name in devices.MODEL_KEYS or "model" in name):
                    marker(y)
                elif isinstance(y, (dict, list)):
                    walk(y, context)

    walk(payload, False)
    if wide or nodes > 512:
        return "attribution_traversal_bounded"
    if {"target", "other"} <= says:
        return "mixed_device_models"
    if says & {"target", "other"} and says & {"plain", "opaque"}:
        return "device_attribution_unresolved"
    for say, reason in (("target", "explicit_target_model"), ("other", "explicit_other_model"), ("plain", "explicit_unattributed"), ("opaque", "device_field_without_safe_model"), ("device", "device_field_unresolved")):
        if say in says:
            return reason
    return "no_device_attribution_field"


def test_device_attribution_equals_a_recursion(spark):
    rng = random.Random(2)
    keys = ["device", "Device_Info", "deviceId", "isDeviceAttributed", "model", "modelName", "a", "b", "source-device", "x.model.y"]

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["Vivoactive 5", "fenix", "Edge-1", "thing", None, True, False, 3, 2.5, {}, []])
        if rng.random() < 0.3:
            return [made(depth - 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice(keys): made(depth - 1) for _ in range(rng.randint(0, 4))}

    payloads = [made(rng.randint(0, 6)) for _ in range(250)] + [{"a": list(range(64))}, {"a": list(range(65))}, {str(i): i for i in range(65)}, [[list(range(60)) for _ in range(9)]], {"a": {"device": [{"a": {"model": "lily"}}]}}]
    rows = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "id long, text string").select("id", F.parse_json("text").alias("payload"))
    found = {r.id: r.reason for r in devices.attribution(rows).collect()}
    assert found == {i: walked(p) for i, p in enumerate(payloads)}
    assert devices.attribution(spark.createDataFrame([(1, None)], "id long, text string").select("id", F.parse_json("text").alias("payload"))).first().reason == "no_device_attribution_field"


def test_frozen_bodies_are_written_once(spark, tmp_path):
    path = str(tmp_path)

    def offer(batch, *rows):
        made = spark.createDataFrame(rows, "scope string, v long, old string")
        sealed = frozen.sealed(made, ["scope"], F.struct(F.col("v"), F.struct(F.lit(None).cast("string").alias("z"), F.lit("é").alias("a")).alias("nested")), F.col("old"))
        return {r.scope: (r.outcome, r.hash) for r in frozen.freeze(sealed, ["scope"], path, batch).collect()}

    schema = "scope string, body string, hash string, supersedes string"
    digest = lambda v: hashlib.sha256(json.dumps({"v": v, "nested": {"z": None, "a": "é"}}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    first = offer(0, ("a", 1, None), ("a", 1, None), ("b", 2, None), ("c", 3, None), ("c", 4, None), (None, 5, None))
    assert first == {"a": ("frozen", digest(1)), "b": ("frozen", digest(2)), "c": ("conflicting_input", None), None: ("frozen", digest(5))}
    files = sorted(p.name for p in (tmp_path / "frozen").rglob("*.parquet"))
    assert offer(1, ("a", 1, None), ("b", 2, None), (None, 5, None)) == {k: ("replayed", first[k][1]) for k in ("a", "b", None)}
    assert offer(2, ("a", 9, None), ("b", 7, digest(2)), ("c", 3, None)) == {"a": ("refused", digest(9)), "b": ("frozen", digest(7)), "c": ("frozen", digest(3))}
    assert set(files) <= {p.name for p in (tmp_path / "frozen").rglob("*.parquet")}
    assert offer(3, ("b", 2, None), ("b", 2, None), ("a", 1, None))["b"][0] == "refused"  # what was superseded is no head any more
    again = offer(2, ("a", 9, None), ("b", 7, digest(2)), ("c", 3, None))
    assert again["b"] == ("frozen", digest(7)) and again["a"][0] == "refused"
    store = frozen.frozen(spark, path, schema).collect()
    assert sorted((r.scope or "", r.hash) for r in store) == sorted([("a", digest(1)), ("b", digest(2)), ("", digest(5)), ("b", digest(7)), ("c", digest(3))])
    assert all(r.intact for r in store)


def test_list_digest_depends_on_rows_and_order_alone(spark):
    rows = [("x", i, i * i % 7) for i in range(50)]
    make = lambda rs: frozen.list_digest(spark.createDataFrame(rs, "k string, i int, v int").repartition(3), ["k"], F.floor(F.col("i") / 10), ["i"], ["i", "v"]).first()
    shuffled = random.Random(1).sample(rows, len(rows))
    assert make(rows) == make(shuffled) and make(rows).n == 50
    assert make(rows).digest != make([*rows[:-1], ("x", 49, 99)]).digest


def test_a_proof_ships_only_what_later_checks_read(spark):
    plan = evidence_proofs.b8_placeholder_proof(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [i for i, line in enumerate(plan) if "Join " in line]
    assert len(joins) == 7 and all("Join LeftOuter" in plan[i] for i in joins)
    last = plan[joins[0] + 1]  # what the last join reads of all that was joined before
    assert "Project [" in last and not any(c in last for c in ("content_hash", "source_path", "collection_key", "metric_unit", "fingerprint AS"))
