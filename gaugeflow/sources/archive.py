"""Monthly archives: move the live table away, list archives, bring one back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.sources import versions
from gaugeflow.sources.tables import empty, path_exists


def _journal(archive_path: str) -> str:
    return f"{archive_path.rstrip('/')}/_journal"


def _step(spark: SparkSession, archive_path: str, month: str) -> dict:
    return versions.latest(spark, _journal(archive_path)).notes.get(month, {})


def _record(spark: SparkSession, archive_path: str, month: str, **step) -> None:
    versions.commit(spark, _journal(archive_path), {}, note=lambda notes: {**notes, month: step})
    versions.expire(spark, _journal(archive_path))


def _copy(rows: DataFrame, target: str) -> int:
    """Write the archive anew and count both sides."""
    expected = rows.count()
    rows.write.mode("overwrite").parquet(target)
    written = rows.sparkSession.read.schema(rows.schema).parquet(target).count()
    if written != expected:
        raise RuntimeError(f"archived {written} of {expected} rows; the live table is kept")
    return written


def archive_month(spark: SparkSession, live_path: str, archive_path: str, month: str) -> int:
    """Copy the whole live table to ``archive_month=<month>`` and leave an empty live table.

    The month is that of the run. The copy is counted before the live folder is renamed aside;
    nothing else is deleted. Each step is noted in a journal beside the archives, so a run that died is taken up
    by the next one where it stopped; a finished month raises. Returns the number of rows archived.

    The rename is one step on file systems with real folders only. On object stores keep the live
    table as a folder table and use :func:`archive_version`.
    """
    target = f"{archive_path}/archive_month={month}"
    aside_path = f"{live_path.rstrip('/')}.archived-{month}"
    done = _step(spark, archive_path, month)
    if done.get("state") == "done" or (not done and path_exists(spark, target)):
        raise FileExistsError(f"archive exists: {target}")
    if not path_exists(spark, aside_path):
        live = spark.read.parquet(live_path)
        if done.get("state") != "copied" or live.count() != done["rows"]:
            schema = live.schema.json()
            _record(spark, archive_path, month, state="copying")
            done = {"state": "copied", "rows": _copy(live, target), "schema": schema}
            _record(spark, archive_path, month, **done)
        paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        source, aside = paths(live_path), paths(aside_path)
        files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.rename(source, aside):
            raise RuntimeError(f"could not move {live_path} aside")
    elif done.get("state") != "copied":
        raise FileExistsError(f"not of this archive: {aside_path}")
    # Appending no rows makes the table where it is missing and leaves alone what a writer has put there.
    empty(spark, T.StructType.fromJson(json.loads(done["schema"]))).write.mode("append").parquet(live_path)
    _record(spark, archive_path, month, state="done", rows=done["rows"])
    return done["rows"]


def archive_version(spark: SparkSession, live_path: str, schema: T.StructType, archive_path: str, month: str) -> int:
    """As :func:`archive_month` for a folder table: one commit takes the archived folders out of it.

    Rows that arrive while the copy is made stay in the table. If a merge replaces one of the folders meanwhile,
    the copy is made again. A run that died before its commit is simply repeated.
    """
    target = f"{archive_path}/archive_month={month}"

    def once(notes: dict) -> dict | None:
        archived = notes.get("archived", {})
        return None if month in archived else {**notes, "archived": {**archived, month: written}}

    for _ in range(versions.ATTEMPTS):
        before = versions.latest(spark, live_path)
        if month in before.notes.get("archived", {}):
            raise FileExistsError(f"archive exists: {target}")
        written = _copy(versions.read(spark, live_path, schema, version=before), target)
        if versions.commit(spark, live_path, {}, before.folders(), once) is not None:
            return written
    raise RuntimeError(f"{live_path} changed too often while it was archived")


def list_archives(spark: SparkSession, archive_path: str) -> DataFrame:
    """(archive_month, size, last_modified) of every archive; file contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet").load(archive_path).drop("content"))
    month = F.regexp_extract("path", r"archive_month=([^/]+)/", 1)
    return files.groupBy(month.alias("archive_month")).agg(
        F.sum("length").alias("size"), F.max("modificationTime").alias("last_modified"),
    ).orderBy("archive_month")


def restore_archive(spark: SparkSession, archive_path: str, month: str, live_path: str) -> DataFrame:
    """Write one archive back as a table at ``live_path``, which must not exist, and return it."""
    archived = spark.read.parquet(f"{archive_path}/archive_month={month}")
    archived.write.parquet(live_path)
    return spark.read.schema(archived.schema).parquet(live_path)
