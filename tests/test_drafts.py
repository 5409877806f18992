"""Strict JSON and laboratory drafts: every kind of fault is named, and nothing is repaired."""

import copy
import json

from pyspark.sql import functions as F

from tidemark.functions import strict_json
from tidemark.operators import drafts

SOURCE = {"transcription": "manual", "page": None, "support": None}
ROW = dict.fromkeys(["unit_raw", "reference_raw", "flag_raw", "decimal", "comparator", "qualitative", "method_raw", "equipment_kit_notes", "specimen_raw", "specimen_date", "uncertainty"])
ROW |= {"row_id": "a", "label_raw": "L", "result_raw": "1", "value_kind": "numeric", "decimal": "+1.50", "provenance": SOURCE}
DRAFT = dict.fromkeys(["clinic_source", "performing_lab", "report_label", "result_date", "printed_date", "specimen_date", "uncertainty"])
DRAFT |= {"schema_version": "lab-draft-v1", "pdf_sha256": "0" * 64, "scope": "single_report_single_patient", "patient_link": "resolved", "report_link": "resolved", "source_match": "unverified", "provenance": SOURCE, "incomplete": True, "rows": [ROW]}


def test_strict_json_takes_one_whole_value(spark):
    texts = ['{"a":1}', " [1] ", "null", '{"a":1}x', '{"a":1} {"b":2}', '{"a":1},"end":"x"', '{"a":1}}', '{"a":1,"a":2}', "", None, "{"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.to_json(strict_json(F.col("t"))).alias("v")).orderBy("i").collect()
    assert [r.v is not None for r in got] == [True, True, True] + [False] * 8


def test_lab_drafts_name_the_first_fault(spark):
    cases = {}

    def case(name, reason, change):
        d = copy.deepcopy(DRAFT)
        change(d, d["rows"][0])
        cases[name] = (json.dumps(d), reason)

    case("good", None, lambda d, r: r.update(specimen_date={"value": "2024-02-29T07:30:00Z", "precision": "second"}, field_provenance={"decimal": SOURCE}))
    case("day", "rows.rule:specimen_date", lambda d, r: r.update(specimen_date={"value": "2023-02-29", "precision": "date"}))
    case("zone", "rule:printed_date", lambda d, r: d.update(printed_date={"value": "2024-02-29T07:30", "precision": "second"}))
    case("number", "rows.wrong_type:decimal", lambda d, r: r.update(decimal=1.5))
    case("decimal", "rows.bad_text:decimal", lambda d, r: r.update(decimal="1."))
    case("extra", "rows.extra_field:.", lambda d, r: r.update(x=1))
    case("page", "too_large:provenance.page", lambda d, r: d.update(provenance={**SOURCE, "page": 1001}))
    case("map", "not_allowed:field_provenance", lambda d, r: d.update(field_provenance={"rows": SOURCE}))
    case("entry", "bad_entry:field_provenance", lambda d, r: d.update(field_provenance={"result_date": {}}))
    case("numeric", "rows.numeric_value", lambda d, r: r.update(qualitative="x"))
    case("stray", "rows.stray_decimal", lambda d, r: r.update(value_kind="unparsed"))
    case("qualitative", "rows.qualitative_value", lambda d, r: r.update(value_kind="qualitative", decimal=None))
    case("ids", "duplicate_row_ids", lambda d, r: d.update(rows=[r, r]))
    case("many", "rows", lambda d, r: d.update(rows=[r] * 201))
    case("none", "rows", lambda d, r: d.update(rows=[]))
    case("null", "null:incomplete", lambda d, r: d.update(incomplete=None))
    cases |= {"empty": ("", "size"), "absent": (None, "absent"), "long": ('{"a":"' + "x" * drafts.MAX_DRAFT + '"}', "size"), "list": ("[]", "not_object")}
    df = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "name string, text string")
    made = drafts.lab_drafts(df, ["name"], "text").persist()
    assert {r.name: r.reason for r in made.select("name", "reason").collect()} == {k: reason for k, (_, reason) in cases.items()}
    rows = drafts.lab_rows(made, ["name"]).collect()
    assert [(r.name, r.ordinal, r.decimal) for r in rows] == [("good", 0, "+1.50")]


def _parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("parseJson")


def test_a_draft_is_parsed_where_it_is_read_and_nowhere_else(spark):
    texts = spark.createDataFrame([("a", "{}")], "name string, text string").localCheckpoint()
    once = _parses(texts.select(strict_json(F.col("text")).alias("v")))
    made = drafts.lab_drafts(texts, ["name"], "text")
    assert _parses(made.drop("rows")) == _parses(drafts.lab_rows(made, ["name"])) == once > 0
