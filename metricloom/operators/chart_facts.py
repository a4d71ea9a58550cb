"""Second-level facts about chart rows: extremes, changes, shares and findings.

Inputs are chart frames, a row per displayed point, except for scatter and distribution
observations, which aggregate row-level frames.  ``x_order`` is a column
that orders the displayed points (position, or the period label of a time chart).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.frames import union_all
from metricloom.functions.values import clean, human_number, signed_number
from metricloom.operators.quantiles import exact_quantiles
from metricloom.session import checkpointed

# What a display shows; callers pass them as limits.
MAX_OBSERVATIONS = 24
MAX_FINDINGS = 5


def point_label(x: Column, series: Column) -> Column:
    has_series = F.coalesce(series != "", F.lit(False))
    return (
        F.when(x.isNotNull() & has_series, F.concat(x, F.lit(" / "), series))
        .when(x.isNotNull(), x)
        .when(has_series, series)
        .otherwise("the displayed total")
    )


def extremes(rows: DataFrame, x_order: str) -> DataFrame:
    """Highest and lowest displayed point per measure; the first point wins ties."""
    high = F.struct(F.col("value"), -F.col("_o"))
    low = F.struct(F.col("value"), F.col("_o"))
    point = F.struct("x", "series", "value")
    return _ordered(rows, x_order).groupBy("measure").agg(
        F.max_by(point, high).alias("highest"),
        F.min_by(point, low).alias("lowest"),
        F.count("*").alias("record_count"),
    )


def _ordered(rows: DataFrame, x_order: str) -> DataFrame:
    """Add the display position ``_o`` inside each measure; chart frames are small."""
    if "series" not in rows.columns:
        rows = rows.withColumn("series", F.lit(None).cast("string"))
    order = Window.partitionBy("measure").orderBy(x_order, "series")
    return rows.where(F.col("value").isNotNull()).withColumn("_o", F.row_number().over(order))


def time_changes(rows: DataFrame) -> DataFrame:
    """First against last displayed value per measure and series."""
    old, new = F.col("first_value"), F.col("last_value")
    return (
        rows.where(F.col("value").isNotNull())
        .groupBy("measure", "series")
        .agg(
            F.min("x").alias("first_period"),
            F.min_by("value", "x").alias("first_value"),
            F.max("x").alias("last_period"),
            F.max_by("value", "x").alias("last_value"),
            F.count("*").alias("record_count"),
        )
        .where(F.col("record_count") >= 2)
        .withColumn("absolute_change", new - old)
        .withColumn("percentage_change", F.try_divide(new - old, F.abs(old)) * 100)
        .withColumn("division_by_zero", old == 0)
    )


def movements(rows: DataFrame) -> DataFrame:
    """Largest increase and decrease between neighbouring periods of one series."""
    w = Window.partitionBy("measure", "series").orderBy("x")
    steps = rows.where(F.col("value").isNotNull()).select(
        "measure",
        "series",
        F.lag("x").over(w).alias("from_x"),
        F.col("x").alias("to_x"),
        (F.col("value") - F.lag("value").over(w)).alias("movement"),
    ).where(F.col("movement").isNotNull())
    order = Window.partitionBy("measure").orderBy(F.coalesce("series", F.lit("")), "to_x")
    step = F.struct("series", "from_x", "to_x", "movement")
    # The first step wins ties, as displayed series by series.
    return (
        steps.withColumn("_o", F.row_number().over(order))
        .groupBy("measure")
        .agg(
            F.max_by(step, F.struct("movement", -F.col("_o"))).alias("gain"),
            F.min_by(step, F.struct("movement", "_o")).alias("drop"),
        )
    )


def association(pairs: DataFrame) -> DataFrame:
    """Pearson coefficient of displayed pairs, or why there is none; one row."""
    x, y = F.col("x"), F.col("y")
    stats = pairs.where(x.isNotNull() & y.isNotNull()).agg(
        F.count("*").alias("record_count"),
        F.covar_pop(x, y).alias("xy"),
        F.var_pop(x).alias("xx"),
        F.var_pop(y).alias("yy"),
    )
    constant = ~((F.col("xx") > 0) & (F.col("yy") > 0))
    few = F.col("record_count") < 3
    r = F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))
    return stats.select(
        F.when(few, "association_skipped").otherwise("numeric_association").alias("type"),
        F.when(few, "fewer_than_three_pairs").alias("reason"),
        F.when(~few & ~constant, r).alias("coefficient"),
        F.when(~few, constant).alias("constant_input"),
        "record_count",
        F.when(few | constant, "low").otherwise("high").alias("confidence"),
    )


def distribution(values: DataFrame) -> DataFrame:
    """Tukey-hinge summary of a ``value`` column; the middle value is in both halves.

    A hinge is a quantile of one half of the ranks, so the exact rank selection gives it
    without sorting the column in one task.
    """
    rows = values.where(F.col("value").isNotNull()).select("value")
    # Half h = ceil(n/2) values; its median sits at 0-based rank (h-1)/2 from either end.
    n = rows.agg(F.count("*").alias("n")).first()["n"]
    if n == 0:
        return rows.agg(F.count("*").alias("record_count")).where(F.lit(False))
    half = (n + 1) // 2
    position = (half - 1) / 2
    share = position / (n - 1) if n > 1 else 0.0
    q = exact_quantiles(
        rows, [], F.col("value"), [0.0, share, 0.5, 1.0 - share, 1.0], few_groups=True
    )
    at = F.col("quantiles")
    iqr = at[3] - at[1]
    summary = q.select(
        F.col("value_count").alias("record_count"),
        at[0].alias("minimum"),
        at[1].alias("q1"),
        at[2].alias("median"),
        at[3].alias("q3"),
        at[4].alias("maximum"),
        iqr.alias("iqr"),
        (at[1] - 1.5 * iqr).alias("lower_fence"),
        (at[3] + 1.5 * iqr).alias("upper_fence"),
    )
    summary = checkpointed(summary)
    fences = summary.select(F.struct("lower_fence", "upper_fence")).scalar()
    marked = rows.withColumn("_f", fences).select("value", "_f.*")
    beyond = (F.col("value") < F.col("lower_fence")) | (F.col("value") > F.col("upper_fence"))
    rest = marked.agg(
        F.avg("value").alias("mean"),
        F.count_if(beyond).alias("outlier_count"),
        F.count("*").alias("record_count"),
    )
    # Both sides are one row with the same count.
    return summary.join(F.broadcast(rest), "record_count")


def target_comparison(card: DataFrame) -> DataFrame:
    return card.select(
        F.col("x").alias("measure"),
        F.col("y").alias("current_value"),
        "target",
        (F.col("y") - F.col("target")).alias("gap_to_target"),
        F.when(F.col("target") != 0, F.col("y") / F.col("target") * 100).alias(
            "percentage_of_target"
        ),
        "record_count",
    )


def top_contribution(rows: DataFrame, x_order: str) -> DataFrame:
    """Share of the largest displayed point in the displayed total."""
    high = F.struct(F.col("value"), -F.col("_o"))
    return (
        _ordered(rows, x_order)
        .groupBy("measure")
        .agg(
            F.max_by("x", high).alias("top_category"),
            F.max("value").alias("top_value"),
            F.sum("value").alias("_total"),
            F.count("*").alias("record_count"),
        )
        .where(F.col("_total") != 0)
        .withColumn("share_percentage", F.col("top_value") / F.col("_total") * 100)
        .drop("_total")
    )


def association_sentences(facts: DataFrame) -> DataFrame:
    """A sentence about the frame of :func:`association`."""
    text = (
        F.when(F.col("type") == "association_skipped", "Too few pairs are displayed for a correlation.")
        .when(F.col("constant_input"), "One side of the displayed pairs never varies, so they have no correlation.")
        .otherwise(
            F.format_string("The %d displayed pairs correlate at %s.", "record_count", human_number(F.col("coefficient")))
        )
    )
    return facts.select(text.alias("finding"))


def distribution_sentences(facts: DataFrame) -> DataFrame:
    """Sentences about the frame of :func:`distribution`: the middle half, and the outliers."""
    n = human_number
    middle = F.format_string(
        "The middle half of %d values runs from %s to %s around a median of %s.",
        "record_count", n(F.col("q1")), n(F.col("q3")), n(F.col("median")),
    )
    beyond = F.when(
        F.col("outlier_count") > 0, F.format_string("%d values lie beyond the whiskers.", "outlier_count")
    )
    return facts.select(F.explode(F.array_compact(F.array(middle, beyond))).alias("finding"))


def target_sentences(facts: DataFrame) -> DataFrame:
    """A sentence about the frame of :func:`target_comparison`."""
    text = F.format_string(
        "%s stands at %s, %s against a target of %s.",
        "measure", human_number(F.col("current_value")), signed_number(F.col("gap_to_target")),
        human_number(F.col("target")),
    )
    return facts.select(text.alias("finding"))


def summary_numbers(rows: DataFrame, x_order: str) -> DataFrame:
    """Totals, gap, top shares, range, funnel retention and waterfall nets per measure."""
    ordered = _ordered(rows, x_order)
    by_value = Window.partitionBy("measure").orderBy(F.desc("value"), "_o")
    ranked = ordered.withColumn("_r", F.row_number().over(by_value))
    first, last = F.min_by("value", "_o"), F.max_by("value", "_o")
    total = F.sum("value")
    top3 = F.sum(F.when(F.col("_r") <= 3, F.col("value")))
    positive = F.when(F.col("value") > 0, F.col("value"))
    negative = F.when(F.col("value") < 0, F.col("value"))
    return ranked.groupBy("measure").agg(
        F.count("*").alias("point_count"),
        total.alias("total"),
        (F.max("value") - F.min("value")).alias("gap"),
        (F.try_divide(F.max("value"), total) * 100).alias("top_share"),
        (F.try_divide(top3, total) * 100).alias("top_three_share"),
        (F.try_divide(last, first) * 100).alias("retention"),
        F.max(positive).alias("largest_positive"),
        F.min(negative).alias("largest_negative"),
    )


def observations(
    rows: DataFrame, chart: str, x_order: str, limit: int | None = None
) -> DataFrame:
    """All observations of a grouped chart in one shape, or the first ``limit``."""
    parts = [
        extremes(rows, x_order).select(
            F.lit(0).alias("_k"),
            "measure",
            F.lit(None).cast("string").alias("_s"),
            F.lit("displayed_extremes").alias("type"),
            F.to_json(F.struct("highest", "lowest")).alias("observation"),
            "record_count",
        )
    ]
    if chart in ("time_line", "time_area", "time_area_stacked", "line", "area", "multi_line"):
        parts.append(
            time_changes(rows).select(
                F.lit(1).alias("_k"),
                "measure",
                F.col("series").alias("_s"),
                F.lit("displayed_time_change").alias("type"),
                F.to_json(
                    F.struct(
                        "series", "first_period", "first_value", "last_period", "last_value",
                        "absolute_change", "percentage_change", "division_by_zero",
                    )
                ).alias("observation"),
                "record_count",
            )
        )
    if chart == "pareto":
        parts.append(
            top_contribution(rows, x_order).select(
                F.lit(2).alias("_k"),
                "measure",
                F.lit(None).cast("string").alias("_s"),
                F.lit("top_contribution").alias("type"),
                F.to_json(F.struct("top_category", "top_value", "share_percentage")).alias(
                    "observation"
                ),
                "record_count",
            )
        )
    order = Window.partitionBy(F.lit(0)).orderBy("measure", "_k", "_s")
    out = union_all(parts).withColumn("position", F.row_number().over(order)).drop("_k", "_s")
    return out if limit is None else out.where(F.col("position") <= limit)


def findings(
    rows: DataFrame, chart: str, x_order: str, aggregation: str, limit: int | None = None
) -> DataFrame:
    """Distinct sentences about a grouped chart, all or the first ``limit``."""

    def label(point: str) -> Column:
        return point_label(F.col(f"{point}.x"), F.col(f"{point}.series"))

    n = human_number
    ends = extremes(rows, x_order)
    numbers = summary_numbers(rows, x_order)
    gap = F.col("highest.value") - F.col("lowest.value")
    sentences = [
        ends.select(
            F.lit(1).alias("_p"),
            "measure",
            F.format_string(
                "%s peaks at %s with %s; its smallest displayed value is at %s with %s.",
                "measure", label("highest"), n(F.col("highest.value")),
                label("lowest"), n(F.col("lowest.value")),
            ).alias("finding"),
        ),
        ends.where(gap != 0).select(
            F.lit(3).alias("_p"),
            "measure",
            F.format_string(
                "From %s down to %s the displayed values span %s for %s.",
                label("highest"), label("lowest"), n(gap), "measure",
            ).alias("finding"),
        ),
    ]
    if chart in ("time_line", "time_area", "time_area_stacked"):
        named = F.when(
            F.coalesce(F.col("series") != "", F.lit(False)),
            F.concat(F.lit(" for "), F.col("series")),
        ).otherwise("")
        percent = F.when(
            F.col("percentage_change").isNotNull(),
            F.concat(F.lit(", or "), n(F.col("percentage_change")), F.lit("%")),
        ).otherwise("")
        sentences.append(
            time_changes(rows).select(
                F.lit(2).alias("_p"),
                "measure",
                F.format_string(
                    "%s%s went from %s (%s) to %s (%s): %s%s.",
                    "measure", named, n(F.col("first_value")), "first_period",
                    n(F.col("last_value")), "last_period",
                    signed_number(F.col("absolute_change")), percent,
                ).alias("finding"),
            )
        )
        for place, side, word, keep in (
            (7, "gain", "increase", F.lit(True)),
            (8, "drop", "decline", F.col("drop.movement") < 0),
        ):
            series = F.col(f"{side}.series")
            sentences.append(
                movements(rows).where(keep).select(
                    F.lit(place).alias("_p"),
                    "measure",
                    F.format_string(
                        "The steepest displayed " + word + " of %s is %s, between %s and %s.",
                        "measure", signed_number(F.col(f"{side}.movement")),
                        point_label(F.col(f"{side}.from_x"), series),
                        point_label(F.col(f"{side}.to_x"), series),
                    ).alias("finding"),
                )
            )
    if aggregation in ("sum", "count"):
        top = ends.join(numbers, "measure").where(F.col("total") != 0)
        for place, text in (
            (4, F.format_string(
                "Together the displayed values of %s make %s over %d points.",
                "measure", n(F.col("total")), "point_count")),
            (5, F.format_string(
                "%s alone holds %s%% of what is displayed of %s.",
                label("highest"), n(F.col("top_share")), "measure")),
            (6, F.format_string(
                "The top three points hold %s%% of what is displayed of %s.",
                n(F.col("top_three_share")), "measure")),
        ):
            sentences.append(top.select(F.lit(place).alias("_p"), "measure", text.alias("finding")))
    if chart == "waterfall":
        for place, test, text in (
            (7, F.lit(True), F.format_string(
                "All displayed steps add up to %s for %s.",
                signed_number(F.col("total")), "measure")),
            (8, F.col("largest_positive").isNotNull(), F.format_string(
                "%s raises it most, by %s.",
                label("highest"), signed_number(F.col("largest_positive")))),
            (9, F.col("largest_negative").isNotNull(), F.format_string(
                "%s lowers it most, by %s.",
                label("lowest"), signed_number(F.col("largest_negative")))),
        ):
            both = ends.join(numbers, "measure").where(test)
            sentences.append(both.select(F.lit(place).alias("_p"), "measure", text.alias("finding")))
    if chart == "funnel":
        sentences.append(
            numbers.where((F.col("point_count") >= 2) & F.col("retention").isNotNull()).select(
                F.lit(7).alias("_p"),
                "measure",
                F.format_string(
                    "The last displayed stage keeps %s%% of the first.", n(F.col("retention"))
                ).alias("finding"),
            )
        )
    # A few sentences per measure and series.
    first = Window.partitionBy("finding").orderBy("_p", "measure")
    order = Window.partitionBy(F.lit(0)).orderBy("_p", "measure", "finding")
    out = (
        union_all(sentences)
        .withColumn("_d", F.row_number().over(first))
        .where(F.col("_d") == 1)
        .withColumn("position", F.row_number().over(order))
        .select("position", "measure", "finding")
    )
    return out if limit is None else out.where(F.col("position") <= limit)


def rounded_summary(frame: DataFrame, *names: str) -> DataFrame:
    for name in names:
        frame = frame.withColumn(name, clean(F.col(name)))
    return frame
