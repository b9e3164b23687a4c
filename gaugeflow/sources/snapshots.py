"""Published snapshot documents: gzip JSON text, one document per line and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow import schemas
from gaugeflow.sources.tables import empty, path_exists


def document_text(snapshots: DataFrame) -> DataFrame:
    """(series, value): the document as JSON text. NULL fields are left out, which drops optional
    keys that have nothing in them; explicit nulls are dropped too."""
    return snapshots.select("series", F.to_json(F.struct(*snapshots.columns)).alias("value"))


def write_snapshots(snapshots: DataFrame, path: str, per_series: bool = False) -> None:
    """Write documents; ``per_series`` gives every series its own folder, and the site's document another."""
    text = document_text(snapshots)
    writer = text.write if per_series else text.select("value").write
    if per_series:
        writer = writer.partitionBy("series")
    writer.mode("overwrite").option("compression", "gzip").text(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Documents as rows; a path that does not exist gives none."""
    if not path_exists(spark, path):
        return empty(spark, schemas.SNAPSHOT)
    return spark.read.schema(schemas.SNAPSHOT).option("recursiveFileLookup", "true").json(path)
