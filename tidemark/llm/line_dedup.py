"""Line dedup: salted streaming of first occurrences over range-partitioned line hashes.

Every line becomes (128-bit hash of its key, doc_id, position). A first pass streams, within
(hash, salt), the lines in order of document and position: whatever is not of the first
document there is dropped at once, so that a line which a third of all documents hold is
spread over SALTS tasks and leaves at most SALTS documents to the second pass. The second
pass range-partitions by hash, sorts by document and position and streams first occurrences.
What comes back to the documents is a sparse bitmap of dropped positions, never text.
No Python runs on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm._common import WHITESPACE, ascii_lower, partitions, text_or_empty

SALTS = 32  # at least; as many as there are shuffle partitions where these are more
WORD = 32  # positions in one word of a bitmap


def line_keys(text: Column) -> Column:
    """The comparison keys of all lines of a text: ASCII-lowered, stripped of [\\x20\\x09-\\x0D]."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: F.trim(x, F.lit(WHITESPACE)))


def dropped_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, tag, pos) of every line that an earlier document holds. tag tells rows of one doc_id apart."""
    text = text_or_empty()
    lines = (
        docs.where("doc_id IS NOT NULL")
        .select("doc_id", F.hash(text).alias("tag"), F.posexplode(line_keys(text)).alias("pos", "key"))
        .where(F.char_length("key") >= min_chars)
        .select(
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit(20011), "key").alias("h2"),
            "doc_id",
            # one column for both keeps the shuffled row at four longs
            (F.shiftleft(F.col("tag").cast("long"), 32) + F.col("pos")).alias("at"),
        )
    )
    salted = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "at").rowsBetween(Window.unboundedPreceding, 0)
    later = F.col("doc_id") > F.first("doc_id").over(salted)
    first_pass = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(max(SALTS, partitions(docs.sparkSession)))).cast("int")).withColumn("later", later).drop("salt")
    # Lines already settled travel under a key of their own, so that no hash gathers them again.
    own = F.xxhash64("doc_id", "at")
    keyed = first_pass.withColumns({"h1": F.when(F.col("later"), own).otherwise(F.col("h1")), "h2": F.when(F.col("later"), F.lit(0)).otherwise(F.col("h2"))})
    ranged = keyed.repartitionByRange(partitions(docs.sparkSession), "h1", "h2")
    stream = Window.partitionBy("h1", "h2").orderBy("doc_id", "at").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn("first_doc", F.first("doc_id").over(stream))
        .where(F.col("later") | (F.col("doc_id") > F.col("first_doc")))
        .select("doc_id", F.shiftright("at", 32).cast("int").alias("tag"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos"))
    )


def drop_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, tag, drops): drops maps the index of a 32-line word to its bits; words without a dropped line are left out."""
    return (
        dropped_lines(docs, min_chars)
        .repartition("doc_id", "tag")
        .groupBy("doc_id", "tag", F.expr(f"pos div {WORD}").cast("int").alias("w"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {WORD})")).alias("bits"))
        .groupBy("doc_id", "tag")
        .agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("drops"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """docs with kept_text, n_lines, n_dropped and the bitmap of dropped lines.

    A key of min_chars code points or more that at least two documents hold loses all its lines
    except in the document of smallest doc_id. Null text counts as one empty line. Rows with a
    null doc_id are returned whole and make no line repeated. Repeated rows of one doc_id are
    one document to the rule: each keeps or loses a line like the others. Extra columns stay;
    those named kept_text, n_lines, n_dropped or drops give way to the results, and one named tag
    is dropped.
    """
    taken = [c for c in docs.columns if c in {"kept_text", "n_lines", "n_dropped", "drops", "tag"}]
    base = docs.drop(*taken).withColumn("tag", F.hash(text_or_empty()))
    joined = base.join(drop_bitmaps(docs.select("doc_id", "text"), min_chars), ["doc_id", "tag"], "left")
    lines = F.split(text_or_empty(), "\n", -1)
    word = lambda i: F.coalesce(F.try_element_at("drops", F.floor(i / WORD).cast("int")), F.lit(0).cast("long"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), (i % WORD).cast("int"))
    kept = F.filter(lines, lambda _, i: word(i).bitwiseAND(bit(i)) == 0)
    return joined.select(
        *base.drop("tag").columns,
        F.when(F.col("drops").isNull(), text_or_empty()).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate(F.map_values("drops"), F.lit(0).cast("long"), lambda a, b: a + F.bit_count(b).cast("long")), F.lit(0).cast("long")).alias("n_dropped"),
        "drops",
    )
