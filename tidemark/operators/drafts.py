"""JSON documents under a strict contract: bounded, no key twice, no field too many or too few, exact types; taken whole or refused with the first fault."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import ladder, strict_json

#: What schema_of_variant says of a kind, and the types that nested kinds alone have.
KINDS = {"text": "STRING", "bool": "BOOLEAN", "whole": "BIGINT"}
_NESTED = {"object": "map<string,variant>", "map": "map<string,variant>", "list": "array<variant>"}


@dataclass(frozen=True)
class Field:
    """A field of an object. least and most bound a text's length, a whole number or a map's size; fields are those of a nested object or of a map's values."""

    name: str
    kind: str = "text"
    nullable: bool = False
    required: bool = True
    least: int | None = None
    most: int | None = None
    pattern: str | None = None
    choices: tuple[str, ...] = ()  # texts, or keys of a map
    fields: tuple[Field, ...] = ()
    rule: Callable[[Column], Column] | None = None  # of the variant; true where it holds


def json_object(text: Column, max_bytes: int) -> Column:
    """struct(object, reason) of a text: absent, size, invalid_json (a key twice, too) or not_object."""
    v = _parsed(text, max_bytes)
    reason = _text_fault(text, v, max_bytes)
    return F.struct(F.when(reason.isNull(), v).alias("object"), reason.alias("reason"))


def _parsed(text: Column, max_bytes: int) -> Column:
    return strict_json(F.when(F.octet_length(text) <= max_bytes, text))


def _text_fault(text: Column, v: Column, max_bytes: int) -> Column:
    return ladder((text.isNull(), "absent"), (~F.octet_length(text).between(1, max_bytes), "size"), (v.isNull(), "invalid_json"), (~_is(v, "object"), "not_object"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is evaluated once however often body names it; a column's expression would be repeated at each place."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _is(v: Column, kind: str) -> Column:
    if kind in _NESTED:  # a cast looks at one level, schema_of_variant at all that is below
        return F.try_variant_get(v, "$", _NESTED[kind]).isNotNull()
    return F.coalesce(F.schema_of_variant(v) == KINDS[kind], F.lit(False))


def fault(v: Column, fields: tuple[Field, ...], at: str = "") -> Column:
    """The first fault of an object, as fault:path, or null: fields too many, then each field in order."""

    def of(entries: Column) -> Column:
        extra = F.size(F.array_except(F.map_keys(entries), F.array(*[F.lit(f.name) for f in fields]))) > 0
        return F.coalesce(F.when(extra, f"extra_field:{at or '.'}"), *[of_field(entries, f) for f in fields])

    def of_field(entries: Column, f: Field) -> Column:
        return _let(entries[f.name], lambda x: _field_fault(x, f, at))

    return _let(F.try_variant_get(v, "$", "map<string,variant>"), of)


def _field_fault(x: Column, f: Field, at: str) -> Column:
    path = f"{at}{f.name}"
    present = x.isNotNull() & ~F.is_variant_null(x)
    rules = [] if not f.required else [(x.isNull(), "missing")]
    if not f.nullable:
        rules.append((F.is_variant_null(x), "null"))
    rules.append((present, "wrong_type"))
    told = lambda rules: ladder(*[(holds, f"{code}:{path}") for holds, code in rules])
    own = F.when(~_is(x, f.kind), told(rules))
    nested = F.lit(None).cast("string")
    if f.kind == "text":
        text = F.try_variant_get(x, "$", "string")
        nested = F.when(~_fits(text, f), told(_text_rules(text, f)))
    elif f.kind == "whole":
        n = F.try_variant_get(x, "$", "bigint")
        nested = told(_bounds(n, f)) if _bounds(n, f) else nested
    elif f.kind == "object":
        nested = F.when(present, fault(x, f.fields, f"{path}."))
    elif f.kind == "map":
        entries = F.try_variant_get(x, "$", "map<string,variant>")
        strange = F.size(F.array_except(F.map_keys(entries), F.array(*[F.lit(c) for c in f.choices]))) > 0
        bad = F.exists(F.map_values(entries), lambda e: ~_is(e, "object") | fault(e, f.fields).isNotNull())
        nested = told([*_bounds(F.size(entries), f), (strange, "not_allowed"), (bad, "bad_entry")])
    broken = F.when(present & ~f.rule(x), f"rule:{path}") if f.rule else F.lit(None).cast("string")
    return F.coalesce(own, nested, broken)


def _text_rules(text: Column, f: Field) -> list[tuple[Column, str]]:
    rules = [(F.contains(text, F.lit("\0")), "bad_text"), *_bounds(F.char_length(text), f)]
    if f.pattern:
        rules.append((~text.rlike(f"^(?:{f.pattern})\\z"), "bad_text"))
    if f.choices:
        rules.append((~text.isin(*f.choices), "not_allowed"))
    return rules


def _fits(text: Column, f: Field) -> Column:
    """Whether a text keeps all of _text_rules, by one look at it where that can be."""
    if f.choices:
        return reduce(lambda a, b: a & ~b, [holds for holds, _ in _text_rules(text, f)], F.lit(True)) if f.pattern or _bounds(text, f) else text.isin(*f.choices)
    size = f"{{{f.least or 0},{'' if f.most is None else f.most}}}"
    return text.rlike(f"^(?=[^\\x00]{size}\\z)" + (f"(?:{f.pattern})\\z" if f.pattern else ""))


def _bounds(n: Column, f: Field) -> list[tuple[Column, str]]:
    return [(n < f.least, "too_small")] * (f.least is not None) + [(n > f.most, "too_large")] * (f.most is not None)


def _printed_date(v: Column) -> Column:
    """Whether a date is written at the precision it claims, with or without an offset, and exists."""
    at = lambda n: F.try_variant_get(v, f"$.{n}", "string")
    return _let(at("value"), lambda text: _let(at("precision"), lambda precision: _written(text, precision)))


def _written(text: Column, precision: Column) -> Column:
    day, zone = r"\d{4}-\d{2}-\d{2}", r"(Z|[+-]\d{2}:\d{2})?"
    is_day = text.rlike(rf"^{day}\z") & F.try_to_date(text, "yyyy-MM-dd").isNotNull()
    clock = F.when(precision == "second", text.rlike(rf"^{day}T\d{{2}}:\d{{2}}:\d{{2}}{zone}\z")).otherwise(text.rlike(rf"^{day}T\d{{2}}:\d{{2}}{zone}\z"))
    # the cast wants seconds before an offset
    exists = F.try_to_timestamp(F.when(precision == "minute", F.concat(F.substring(text, 1, 16), F.lit(":00"), F.substr(text, F.lit(17)))).otherwise(text)).isNotNull()
    return F.coalesce(F.when(precision == "date", is_day).otherwise(clock & exists), F.lit(False))


# Fields of a laboratory draft and of its rows: names, lengths, patterns and allowed texts (fixed values).
_PROVENANCE = (Field("transcription", choices=("manual", "assistant")), Field("page", "whole", nullable=True, least=1, most=1000), Field("support", nullable=True, most=2000))
_DATE_FIELDS = (Field("value", most=40), Field("precision", choices=("date", "minute", "second")))


def _short(name: str) -> Field:
    return Field(name, nullable=True, most=255)


def _long(name: str) -> Field:
    return Field(name, nullable=True, most=2000)


def _date(name: str) -> Field:
    return Field(name, "object", nullable=True, fields=_DATE_FIELDS, rule=_printed_date)


def _provenances(*names: str) -> Field:
    return Field("field_provenance", "map", required=False, most=len(names), choices=names, fields=_PROVENANCE)


ROW = (
    Field("row_id", least=1, most=80, pattern=r"[A-Za-z0-9._:-]+"), Field("label_raw", least=1, most=255), Field("result_raw", least=1, most=2000),
    _short("unit_raw"), _long("reference_raw"), _short("flag_raw"), Field("value_kind", choices=("numeric", "qualitative", "unparsed")),
    Field("decimal", nullable=True, most=100, pattern=r"[+-]?[0-9]+(?:\.[0-9]+)?"), Field("comparator", nullable=True, choices=("=", "<", ">", "<=", ">=", "≤", "≥")),
    _long("qualitative"), _short("method_raw"), _long("equipment_kit_notes"), _short("specimen_raw"), _date("specimen_date"),
    Field("provenance", "object", fields=_PROVENANCE),
    _provenances("label_raw", "result_raw", "unit_raw", "reference_raw", "flag_raw", "value_kind", "decimal", "comparator", "qualitative", "method_raw", "equipment_kit_notes", "specimen_raw", "specimen_date", "uncertainty"),
    _long("uncertainty"),
)
DRAFT = (
    Field("schema_version", choices=("lab-draft-v1",)), Field("pdf_sha256", pattern="[a-f0-9]{64}"), Field("scope", choices=("single_report_single_patient",)),
    Field("patient_link", choices=("unresolved", "resolved")), Field("report_link", choices=("unresolved", "resolved")), Field("source_match", choices=("unverified", "owner_verified")),
    _short("clinic_source"), _short("performing_lab"), _short("report_label"), _date("result_date"), _date("printed_date"), _date("specimen_date"),
    Field("provenance", "object", fields=_PROVENANCE),
    _provenances("patient_link", "report_link", "source_match", "clinic_source", "performing_lab", "report_label", "result_date", "printed_date", "specimen_date", "incomplete", "uncertainty"),
    Field("incomplete", "bool"), _long("uncertainty"),
)
MAX_DRAFT, MAX_ROWS = 256 * 1024, 200


def lab_drafts(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """texts as drafts: the rows of each (ordinal, r) or the reason why it is refused as a whole.

    Faults come in order: size, JSON, fields of the draft, number of rows, fields of the first
    bad row (rows.fault:path), the typed value of the first bad row, repeated row ids. A draft is
    MAX_DRAFT bytes at most and is judged where it is read, in one row. keys name a draft; a null key is one, too.
    """
    v = F.col("_v")
    at = lambda r, n: F.try_variant_get(r, f"$.{n}", "string")
    items = lambda whole: F.try_variant_get(whole, "$.rows", "array<variant>")

    def of_rows(rows: Column) -> Column:
        first = lambda of: F.concat(F.lit("rows."), F.get(F.array_compact(F.transform(rows, of)), F.lit(0)))
        of_row = lambda r: F.when(~_is(r, "object"), F.lit("wrong_type:.")).otherwise(fault(r, ROW))
        typed = lambda r: typed_value_fault(at(r, "value_kind"), at(r, "decimal"), at(r, "comparator"), at(r, "qualitative"))
        ids = F.transform(rows, lambda r: at(r, "row_id"))
        twice = F.when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate_row_ids")
        return F.coalesce(F.when(~F.size(rows).between(1, MAX_ROWS), "rows"), first(of_row), first(typed), twice)

    read = texts.select(*keys, text, _parsed(F.col(text), MAX_DRAFT).alias("_v"))
    reason = F.coalesce(_text_fault(F.col(text), v, MAX_DRAFT), fault(v, (*DRAFT, Field("rows", "list"))), _let(items(v), of_rows))
    told = read.select(*keys, reason.alias("reason"), "_v")
    rows = F.transform(items(v), lambda r, i: F.struct(i.alias("ordinal"), r.alias("r")))
    accepted = F.col("reason").isNull()
    return told.select(*keys, "reason", F.when(accepted, rows).alias("rows"), F.when(accepted, at(v, "pdf_sha256")).alias("pdf_sha256"))


def typed_value_fault(kind: Column, decimal: Column, comparator: Column, qualitative: Column) -> Column:
    """Numeric needs a decimal and no text; qualitative needs a text; no other kind than numeric has a decimal or comparator, unparsed has neither."""
    return ladder(
        ((kind == "numeric") & (decimal.isNull() | qualitative.isNotNull()), "numeric_value"),
        ((kind != "numeric") & (decimal.isNotNull() | comparator.isNotNull()), "stray_decimal"),
        ((kind == "qualitative") & (F.coalesce(qualitative, F.lit("")) == ""), "qualitative_value"),
        ((kind == "unparsed") & qualitative.isNotNull(), "unparsed_value"),
    )


def lab_rows(drafts: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of accepted drafts: texts as they were printed, the decimal as text, nothing converted."""
    # refused drafts have no rows; a condition on their reason, as on rows of an inner inline, would be pushed down and judge each draft twice
    each = drafts.select(*keys, F.inline_outer("rows")).where("ordinal IS NOT NULL")
    texts = ("row_id", "label_raw", "result_raw", "unit_raw", "flag_raw", "value_kind", "decimal", "comparator", "qualitative")
    return each.select(*keys, "ordinal", *[F.try_variant_get("r", f"$.{t}", "string").alias(t) for t in texts])
