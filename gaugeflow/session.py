"""Session settings, shared scratch tables and size-checked lookups."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A lookup is broadcast only when it has been measured and is at most this long and this large.
BROADCAST_MAX_ROWS = 500_000
BROADCAST_MAX_BYTES = 64 << 20

_local_roots: dict[str, str] = {}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; cluster settings win over these."""
    builder = SparkSession.builder.appName("gaugeflow")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent and the master is local (tests) a temporary folder is made.
    On a cluster a missing setting is an error, since a machine-local folder would not survive
    the loss of an executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="gaugeflow-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return os.path.join(shared_root(spark), "gaugeflow", app, f"{label}-{uuid.uuid4().hex}")


def clear_scratch(spark: SparkSession) -> None:
    """Remove this application's intermediate tables; results that still read them must be stored before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(
        os.path.join(shared_root(spark), "gaugeflow", spark.sparkContext.applicationId))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def measured(df: DataFrame, label: str = "table", **metrics: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` as Parquet to the shared folder and read it back, with metrics of its rows.

    Cuts the lineage, so a lost executor costs a re-read and not a re-computation, and gives the
    following stages a columnar input that can be pruned and filtered. ``rows`` and the given
    aggregates are observed while the table is written, without a job of their own.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    watch = Observation()
    aggregates = [column.alias(name) for name, column in metrics.items()]
    df.observe(watch, F.count(F.lit(1)).alias("rows"), *aggregates).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), watch.get


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    return measured(df, label)[0]


def row_bytes(df: DataFrame) -> Column:
    """About the size of a row in memory; texts and nested values by their length."""
    size = F.lit(16)
    for field in df.schema.fields:
        kind, column = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(column), F.lit(0)) + 8
        elif kind in ("struct", "array", "map"):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 8
        else:
            size = size + 8
    return size.cast("bigint")


def lookup_table(df: DataFrame, label: str = "lookup", max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Materialise an aggregated side table, and broadcast it only if it was measured to be small.

    Beyond ``max_rows`` rows, or many bytes, the table is returned without a hint: the join shuffles,
    and adaptive execution splits skewed keys.
    """
    stored, seen = measured(df, label, bytes=F.sum(row_bytes(df)))
    return broadcast_if(stored, seen["rows"], seen["bytes"], max_rows)


def broadcast_if(stored: DataFrame, rows: int, size: int | None, max_rows: int = BROADCAST_MAX_ROWS,
                 max_bytes: int | None = None) -> DataFrame:
    limit = BROADCAST_MAX_BYTES if max_bytes is None else max_bytes
    return F.broadcast(stored) if rows <= max_rows and (size or 0) <= limit else stored


def sized(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Hint a broadcast for a side table that is cheap to read and proves to be small."""
    seen = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(df)).alias("bytes")).first()
    return broadcast_if(df, seen["rows"], seen["bytes"], max_rows)
