"""Helpers shared by the corpus operators.

Conventions of all of them: a NULL text counts as the empty text, a NULL id as the smallest
possible id, columns other than the named ones are ignored, and an empty input gives an
empty result with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.session import new_path

SMALLEST_ID = -(2**63)

#: Row that a frame keeps whole while helper columns stand beside it.
ROW = "row_"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_of(column: str = "doc_id") -> Column:
    """The id as a non-null long."""
    return F.coalesce(F.col(column).cast("long"), F.lit(SMALLEST_ID))


def real_id(column: str, name: str = "doc_id") -> Column:
    """Back from :func:`id_of` to a nullable id."""
    return F.when(F.col(column) != SMALLEST_ID, F.col(column)).alias(name)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from the files."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def wrapped(docs: DataFrame, **helpers: Column) -> DataFrame:
    """``docs`` as one struct column plus helper columns, safe from clashing names."""
    return docs.select(F.struct("*").alias(ROW), *[c.alias(n) for n, c in helpers.items()])


def unwrapped(df: DataFrame) -> DataFrame:
    return df.select(f"{ROW}.*")


def crc_remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; 0 for a NULL id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def bounded_sample(rows: DataFrame, group: str, mark: Column, limit: int, groups: int = 1000) -> DataFrame:
    """At most ``limit`` rows of each of the ``groups`` most frequent groups, in the order of a hash.

    ``place`` numbers them from 1.  The leading zeros of the hash thin every group out to
    about twice the limit before any group meets in a task.
    """
    hashed = rows.withColumn("hash_", F.pmod(F.xxhash64(mark, F.lit("sample")), F.lit(1 << 32)))
    hashed = hashed.withColumn("level_", 32 - F.length(F.bin("hash_")))
    counts = hashed.groupBy(group, "level_").agg(F.count(F.lit(1)).alias("n_"))
    above = F.sum("n_").over(W.partitionBy(group).orderBy(F.col("level_").desc()))
    cuts = (
        counts.withColumn("above_", above)
        .groupBy(group)
        .agg(F.coalesce(F.max(F.when(F.col("above_") >= limit, F.col("level_"))), F.lit(0)).alias("cut_"), F.sum("n_").alias("n_"))
        .orderBy(F.desc("n_"), group)
        .limit(groups)
        .select(group, "cut_")
    )
    thin = hashed.join(F.broadcast(cuts), group).where("level_ >= cut_")
    order = W.partitionBy(group).orderBy("hash_", mark)
    return thin.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("hash_", "level_", "cut_")


def in_batches(function: Callable, *arguments) -> Callable:
    """Adapt ``function(batch, *arguments) -> batch`` to ``mapInArrow``; empty batches are skipped."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield function(batch, *arguments)

    return run
