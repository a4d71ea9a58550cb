"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 digest of a text.  A batch
is reduced to one row per digest, a sort-merge anti-join against the index finds digests it
does not hold, and these are appended.  The texts never travel: only digests and ids do.

Results for unusual input: NULL texts equal the empty text; rows with NULL ids take part,
with an id below all others; rows that repeat both id and text count separately in
``group_size`` and carry the same answer; an empty batch leaves the index as it is.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.llm.common import ROW, id_of, real_id, text_of, unwrapped, wrapped
from metricloom.session import new_path

#: A digest shared by more than 1 of so many rows is looked up in a broadcast: fewer than
#: this many digests can be that frequent, whatever the number of rows.
HOT_SHARE = 1000
#: Rows of a bucket at most, when an index is sized for a table: about 1 GB of digests.
BUCKET_ROWS = 20_000_000
#: Buckets of an index at least.
BUCKETS = 64


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class DigestIndex:
    """Digests seen so far, with the id that stands for each and the number of its rows.

    ``path`` names a folder all executors share; a later session opens the same files
    again.  ``buckets`` is fixed when the folder is first used: about one per GB of digests.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark = spark
        self.path = path
        self.buckets = buckets
        self.name = "digests_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS "
            f"LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append_new(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """Append the digests of ``docs`` that the index lacks; returns those rows of the index.

        Of equal texts within the batch the row with the largest id stays.  A text that the
        index already holds keeps the id of its earlier batch.
        """
        groups = (
            docs.select(digest_of(text_of(text_column)).alias("digest"), id_of(id_column).alias("keep_id"))
            .groupBy("digest")
            .agg(F.max("keep_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        )
        fresh = groups.repartition(self.buckets, "digest").join(
            self.rows().select("digest").hint("merge"), "digest", "left_anti"
        )
        fresh.select("digest", "keep_id", "group_size").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        return self.rows()

    def matched(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """One row per document: id, kept id, group size and digest.

        Frequent digests are looked up in a broadcast of fewer than ``HOT_SHARE`` rows; their
        documents take part in the sort-merge join under keys of their own that match nothing,
        so that no task gets a whole group.
        """
        total = self.rows().agg(F.sum("group_size")).first()[0] or 0
        hot = self.rows().where(F.col("group_size") * HOT_SHARE > total).select(
            F.col("digest").alias("hot_digest"),
            F.col("keep_id").alias("hot_id"),
            F.col("group_size").alias("hot_size"),
        )
        keyed = (
            docs.select(id_of(id_column).alias("id"), digest_of(text_of(text_column)).alias("own"))
            .join(F.broadcast(hot), F.col("own") == F.col("hot_digest"), "left")
            .withColumn(
                "digest",
                # 8 bytes or fewer: never equal to a digest of 32
                F.when(F.col("hot_digest").isNotNull(), F.unhex(F.hex(F.xxhash64("id", "own")))).otherwise(F.col("own")),
            )
        )
        found = keyed.join(self.rows().hint("merge"), "digest", "left")
        return found.select(
            "id",
            F.coalesce("hot_id", "keep_id").alias("keep_id"),
            F.coalesce("hot_size", "group_size").alias("group_size"),
            F.col("own").alias("digest"),
        )


def index_for(docs: DataFrame) -> DigestIndex:
    """A new index with as many buckets as the rows of ``docs`` ask for."""
    spark = docs.sparkSession
    return DigestIndex(spark, new_path(spark, "digests"), max(BUCKETS, -(-docs.count() // BUCKET_ROWS)))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document."""
    index = index or index_for(docs)
    index.append_new(docs)
    return index.matched(docs).select(
        real_id("id"),
        real_id("keep_id", "keep_id"),
        "group_size",
        (F.col("id") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay: one per text, with all their columns.

    Of rows that repeat id and text, one stays.
    """
    index = index or index_for(docs)
    index.append_new(docs)
    keys = ["digest", "id"]
    kept = index.rows().select("digest", F.col("keep_id").alias("id"))
    rows = wrapped(docs, digest=digest_of(text_of()), id=id_of()).join(kept.hint("merge"), keys)
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*keys))
    return unwrapped(rows.select(ROW, first.alias("place")).where("place = 1"))
