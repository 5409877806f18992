"""Sources and sinks: content-addressed originals, landed JSON, page chains, evidence export, keyed merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import strict_json

#: Leading bytes of media types (fixed values).
MAGIC = {"image/png": "89504e470d0a1a0a", "image/jpeg": "ffd8ff", "application/pdf": "255044462d", "application/gzip": "1f8b"}


def originals(spark: SparkSession, path: str, max_bytes: int = 64 << 20) -> DataFrame:
    """Stored originals with their SHA-256, media type and whether they are what their name says.

    A content-addressed file is named by its hash; too_large files are listed without being hashed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    small = F.col("length") <= max_bytes
    digest = F.when(small, F.sha2("content", 256))
    state = F.when(~small, "too_large").when(F.startswith(name, digest), "verified").when(name.rlike(r"^[0-9a-f]{64}"), "hash_mismatch").otherwise("named")
    return files.select("path", "length", digest.alias("sha256"), media_type(F.col("content")).alias("media_type"), state.alias("state"))


def media_type(content: Column) -> Column:
    """The media type of leading bytes; application/octet-stream where none is known."""
    head = F.lower(F.hex(F.substring(content, 1, 8)))
    out = F.lit("application/octet-stream")
    for kind, magic in MAGIC.items():
        out = F.when(F.startswith(head, F.lit(magic)), F.lit(kind)).otherwise(out)
    return out


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON texts, a file each, as variants; invalid JSON, duplicate keys and text after the value give null and are told apart from empty files."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parsed = strict_json(F.col("value"))
    state = F.when(F.trim("value") == "", "empty").when(parsed.isNull(), "invalid").otherwise("parsed")
    return texts.select("path", parsed.alias("payload"), state.alias("state"))


def field(payload: Column, path: str, kind: str = "double") -> Column:
    """struct(state, value, reason) of a variant path: missing, null, value or invalid; booleans are never numbers, numeric text is not coerced."""
    at = F.try_variant_get(payload, f"$.{path}", "variant")
    schema = F.schema_of_variant(at)
    number = schema.rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    fits = number if kind in {"double", "bigint"} else (schema == "STRING") if kind == "string" else (schema == "BOOLEAN")
    state = F.when(at.isNull(), "missing").when(F.is_variant_null(at), "null").when(fits, "value").otherwise("invalid")
    reason = F.when(state == "invalid", F.when(schema == "STRING", "numeric_string_not_coerced").when(schema == "BOOLEAN", "boolean_is_not_a_number").otherwise("wrong_type"))
    return F.struct(state.alias("state"), F.when(state == "value", F.try_variant_get(payload, f"$.{path}", kind)).alias("value"), reason.alias("reason"))


def first_present(payload: Column, paths: list[str], kind: str = "double") -> Column:
    """The field of the first path that exists: an explicit null counts as present."""
    out = field(payload, paths[-1], kind)
    for path in reversed(paths[:-1]):
        out = F.when(field(payload, path, kind)["state"] != "missing", field(payload, path, kind)).otherwise(out)
    return out


def page_chains(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Of landed pages (page, terminal) those chains that are whole: numbered from 0 without a hole and ended by the one terminal page; else why not."""
    n, last = F.count("*"), F.max("page")
    reason = F.when((F.min("page") != 0) | (F.count_distinct("page") != last + 1), "missing_page").when(n != last + 1, "repeated_page").when(F.count_if(F.col("terminal")) != 1, "no_single_terminal").when(~F.max_by("terminal", "page"), "page_after_terminal")
    return pages.groupBy(*keys).agg(n.alias("pages"), reason.alias("reason"))


def export_evidence(df: DataFrame, path: str, max_bytes: int = 4 << 20) -> int:
    """Writes rows as JSON lines; refuses (ValueError) before writing when they exceed max_bytes. Returns the bytes."""
    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    size = lines.agg(F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("n")).first()["n"]
    if size > max_bytes:
        raise ValueError(f"evidence_too_large: {size} bytes")
    lines.write.mode("overwrite").text(path)
    return size


def redacted(payload: Column, allowed: list[str]) -> Column:
    """A map of the allowed top-level fields of a JSON text; everything else is dropped."""
    entries = F.from_json(payload, "map<string,string>")
    return F.map_filter(entries, lambda k, _: k.isin(allowed))
