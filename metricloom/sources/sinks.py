"""Writers: versioned JSON or Parquet output, append-only logs, safe CSV export."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.frames import literal_frame
from metricloom.functions.values import quoted, spreadsheet_safe
from metricloom.sources.tables import SourceError


def write_versioned(df: DataFrame, folder: str, format: str = "json") -> str:
    """Write a new version below ``folder``, then record it as the newest one.

    Readers follow the record, so they never see a half-written version.
    """
    version = uuid.uuid4().hex
    target = f"{folder}/versions/{version}"
    df.write.format(format).mode("errorifexists").save(target)
    pointer = literal_frame(df.sparkSession, [(version, format)], "version string, format string")
    pointer.withColumn("written_at", F.current_timestamp()).write.mode("append").json(
        f"{folder}/pointer"
    )
    return target


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    newest = (
        spark.read.schema("version string, format string, written_at timestamp")
        .json(f"{folder}/pointer")
        .orderBy(F.desc("written_at"), F.desc("version"))
        .first()
    )
    if newest is None:
        raise SourceError("Nothing has been written.")
    return spark.read.format(newest["format"]).load(f"{folder}/versions/{newest['version']}")


def append_log(df: DataFrame, path: str, schema: str) -> None:
    """Append rows to a CSV log whose columns must match the schema exactly."""
    names = [field.split()[0] for field in schema.split(", ")]
    if df.columns != names:
        raise SourceError("The rows do not have the columns of the log.")
    safe_text(df).write.mode("append").option("header", True).csv(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .schema(schema)
        .csv(path)
    )


def safe_text(df: DataFrame) -> DataFrame:
    """Text columns with an apostrophe before anything a spreadsheet would run."""
    return df.select(
        *[
            spreadsheet_safe(quoted(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else quoted(f.name)
            for f in df.schema.fields
        ]
    )
