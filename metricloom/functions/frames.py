"""Small literal frames and frame helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.session import checkpointed


def literal_frame(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A few driver-side rows as a plan literal (no Python data source, no job)."""
    fields = T._parse_datatype_string(schema).fields

    def cell(value, kind: T.DataType) -> Column:
        if isinstance(value, (list, tuple)):
            return F.array(*[F.lit(v) for v in value]).cast(kind)
        return F.lit(value).cast(kind)

    structs = [
        F.struct(*[cell(v, f.dataType).alias(f.name) for v, f in zip(row, fields, strict=True)])
        for row in rows
    ]
    if not structs:
        return spark.range(0).select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        )
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def ordered_structs(columns: Sequence[Column | str]) -> Column:
    """Sorted list of structs; the first field orders.  For groups of proven size."""
    return F.sort_array(F.collect_list(F.struct(*columns)))


def placed(df: DataFrame, order: Sequence[Column], position: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with each row's place from 1 in ``order``, and running sums up to and with the row.

    No task sees all rows: they are dealt to partitions by ranges of the order, numbered and summed
    inside each, and what the partitions before hold (one row a partition) is added.
    """
    sums = sums or {}
    # kept on disk: places must follow the ranges of one and the same sample
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_before_{name}") for name, c in sums.items()]
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_n", *[f"_before_{name}" for name in sums])]
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    up_to = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.join(F.broadcast(offsets), "_part").withColumn(
        position, (F.row_number().over(inside) + F.col("_n")).cast("int")
    )
    for name, c in sums.items():
        out = out.withColumn(name, F.sum(c).over(up_to) + F.col(f"_before_{name}"))
    return out.drop("_part", "_n", *[f"_before_{name}" for name in sums])
