"""Shared folder, written intermediate tables and small column helpers."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import shared_dir

#: [\x20\x09-\x0D]: the whitespace of the word and line rules (fixed values).
WHITESPACE = " \t\n\x0b\x0c\r"
#: Copies of a row that one array numbers at a time.
COPIES = 1 << 16
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: No join picks a broadcast by the size of its tables; those that a plan asks for stay.
MERGED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_folders: set[str] = set()


def run_dir(spark: SparkSession) -> str:
    """This application's folder in the cluster's shared folder; it is removed when the driver ends."""
    folder = f"{shared_dir(spark)}/tidemark-{spark.conf.get('spark.app.id')}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_delete_at_exit, spark._jvm, spark._jsparkSession.sessionState().newHadoopConf(), folder)
    return folder


def _delete(jvm, conf, folder: str) -> None:
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(conf).delete(path, True)


def _delete_at_exit(jvm, conf, folder: str) -> None:
    try:
        _delete(jvm, conf, folder)
    except (Py4JError, OSError):  # the JVM may have gone first; then the cluster's own cleaning of the folder is left
        pass


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def written(df: DataFrame, name: str, merged: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives executors.

    Spark removes the shuffle files of the write as soon as it has ended, since the table
    replaces them. merged: joins of its plan are sort-merge joins at every size, so no table passes through the driver.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _settings(spark, {CLEANUP: "true"} | (MERGED if merged else {})):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tidemark_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written() tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        _delete(spark._jvm, spark._jsparkSession.sessionState().newHadoopConf(), df.tidemark_path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z only, unlike lower()."""
    return F.translate(column, UPPER, LOWER)


def fold(column: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo folds."""
    return (F.crc32(F.col(column).cast("string").cast("binary")) % folds).cast("int")


def each_copy(rows: DataFrame) -> DataFrame:
    """A row for each of copies, numbered from 1; no array holds more than COPIES numbers or blocks, up to COPIES ** 2 copies."""
    blocks = F.expr(f"sequence(0, (copies - 1) div {COPIES})")
    inside = F.expr(f"sequence(block * {COPIES} + 1, least(copies, (block + 1) * {COPIES}))")
    return rows.withColumn("block", F.explode(blocks)).withColumn("copy", F.explode(inside))
