"""Exact quantiles without ever bringing one group's values into one task.

``percentile`` keeps a map of all distinct values of a group in one buffer, which
does not hold when one group is a third of a very large table.  Here the wanted
ranks are narrowed by counting instead:

1. count rows per (group, magnitude bucket), 1024 buckets per power of two;
2. split only the buckets that hold a wanted rank into 65536 equal parts;
3. count the distinct values of the parts that hold a wanted rank.

Every step is a partial + final hash aggregate over narrow columns, so a hot group
costs no more than any other.  The value order is respected exactly because each
bucket function is monotone in the value, and the ranks come from exact counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.values import finite
from metricloom.session import checkpointed

_PARTS = 65536
BROADCAST_BUCKETS = 200_000


def _magnitude_bucket(v: Column) -> Column:
    scaled = F.floor(F.log2(F.abs(v)) * 1024).cast("int") + F.lit(1_200_000)
    return F.when(v == 0, F.lit(0)).when(v > 0, scaled).otherwise(-scaled)


def _renamed(frame: DataFrame, names: Sequence[str]) -> tuple[DataFrame, Column]:
    """Rename the join columns of a target frame; return it with the join condition."""
    condition = F.lit(True)
    fixed = {f.name for f in frame.schema.fields if not f.nullable} | {"_b1"}
    for i, name in enumerate(names):
        frame = frame.withColumnRenamed(name, f"_t{i}")
        left, right = F.col(name), F.col(f"_t{i}")
        # Plain equality where no NULL can occur: a cheaper hash key.
        condition = condition & (left == right if name in fixed else left.eqNullSafe(right))
    return frame, condition


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probabilities: Sequence[float],
    *,
    few_groups: bool | None = None,
    weight: Column | None = None,
    output: str = "quantiles",
) -> DataFrame:
    """Inclusive (linear interpolation) quantiles per group, as an array column.

    With ``weight`` a row stands for that many equal values (a whole number, at least 1).

    The wanted buckets, at most ``2 * len(probabilities)`` per group, are joined back to
    the values.  ``few_groups=True`` says that the number of groups has a proven bound
    (a global quantile, a category that passed the distinct-value rule), so they are
    broadcast.  By default they are materialised and counted: up to
    ``BROADCAST_BUCKETS`` they are broadcast, beyond that the join shuffles, which
    spreads a hot group over its buckets.
    """
    keys = list(keys)
    weights = [] if weight is None else [weight.cast("long").alias("_w")]
    size = F.count("*") if weight is None else F.sum("_w")
    carried = ["_v"] if weight is None else ["_v", "_w"]
    base = df.select(*keys, finite(value.cast("double")).alias("_v"), *weights).where(
        F.col("_v").isNotNull()
    )
    base = base.withColumn("_b1", _magnitude_bucket(F.col("_v")))

    def small(frame: DataFrame) -> DataFrame:
        return F.broadcast(frame) if few_groups else frame

    def wanted(n: Column) -> Column:
        ranks = []
        for p in probabilities:
            position = (n - 1) * F.lit(float(p))
            ranks += [F.floor(position), F.ceil(position)]
        return F.array_distinct(F.array(*ranks))

    def holding(counted: DataFrame, group: Sequence[str], order: str) -> DataFrame:
        """Keep counted buckets that contain a wanted rank.

        ``_start`` is the number of values before the whole group on input and
        before the kept bucket on output.
        """
        running = Window.partitionBy(*group).orderBy(order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        counted = counted.withColumn("_end", F.col("_start") + F.sum("_c").over(running))
        counted = counted.withColumn("_start", F.col("_end") - F.col("_c"))
        counted = counted.withColumn(
            "_ranks",
            F.filter(
                wanted(F.col("_n")), lambda r: (r >= F.col("_start")) & (r < F.col("_end"))
            ),
        )
        return counted.where(F.size("_ranks") > 0).drop("_end", "_c")

    group_window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    counted = base.groupBy(*keys, "_b1").agg(
        size.alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    counted = (
        counted.withColumn("_n", F.sum("_c").over(group_window))
        .withColumn("_start", F.lit(0).cast("long"))
    )
    first = holding(counted, keys or ["_n"], "_b1").drop("_ranks")
    if few_groups is None:
        first = checkpointed(first)
        few_groups = first.count() <= BROADCAST_BUCKETS

    first, same = _renamed(first, [*keys, "_b1"])
    inside = base.join(small(first), same).select(
        *keys,
        "_b1",
        *carried,
        F.when(
            F.col("_hi") > F.col("_lo"),
            F.least(
                F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * _PARTS),
                F.lit(_PARTS - 1),
            ),
        )
        .otherwise(0)
        .cast("int")
        .alias("_b2"),
        "_n",
        "_start",
    )
    # max() of per-bucket constants keeps this a hash aggregate.
    parts = inside.groupBy(*keys, "_b1", "_b2").agg(
        size.alias("_c"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
        F.max("_n").alias("_n"),
        F.max("_start").alias("_start"),
    )
    second = holding(parts, [*keys, "_b1"], "_b2").drop("_ranks")

    second, same = _renamed(second, [*keys, "_b1"])
    close = base.join(
        small(second), same & F.col("_v").between(F.col("_lo"), F.col("_hi"))
    ).select(
        *keys,
        "_b1",
        "_b2",
        *carried,
        "_n",
        "_start",
    )
    values = close.groupBy(*keys, "_b1", "_b2", "_v").agg(
        size.alias("_c"), F.max("_n").alias("_n"), F.max("_start").alias("_start")
    )
    picked = holding(values, [*keys, "_b1", "_b2"], "_v")
    # At most two ranks per probability and group remain here.
    at_rank = picked.select(*keys, "_n", "_v", F.explode("_ranks").alias("_r"))
    tables = at_rank.groupBy(*keys, "_n").agg(
        F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_m")
    )

    def interpolated(p: float) -> Column:
        position = (F.col("_n") - 1) * F.lit(float(p))
        low = F.element_at("_m", F.floor(position))
        high = F.element_at("_m", F.ceil(position))
        weight = position - F.floor(position)
        return F.when(weight == 0, low).otherwise(low * (1 - weight) + high * weight)

    return tables.select(
        *keys,
        F.col("_n").alias("value_count"),
        F.array(*[interpolated(p) for p in probabilities]).alias(output),
    )
