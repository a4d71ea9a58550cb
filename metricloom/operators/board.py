"""Board charts: quick aggregates by raw label with fixed caps and fill rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.frames import placed
from metricloom.functions.values import Table, clean
from metricloom.operators.charts import ChartError, box_summary, histogram

# Display limits of the board.  Every chart takes its limit as a parameter and
# shows everything by default; callers pass these.
MAX_GROUPS = 16
MAX_PIE_GROUPS = 8
MAX_STACK_GROUPS = 12
MAX_STACK_SERIES = 8
MAX_POINTS = 250
HISTOGRAM_BINS = 10
GROUPED = (
    "column", "bar", "line", "area", "pie", "donut", "table", "pareto", "waterfall", "funnel",
    "treemap", "radar",
)
SHORT = ("pie", "donut", "funnel", "treemap", "radar")
POSITIVE = SHORT + ("pareto",)
STACKED = (
    "stacked_column", "stacked_bar", "stacked_100_column", "stacked_100_bar", "grouped_column",
    "multi_line", "heatmap",
)


def _need_key(table: Table) -> str:
    if not table.row_key:
        raise ChartError("This chart follows row order and needs a row key.")
    return table.row_key


def _labels(table: Table, name: str) -> Column:
    if table.is_temporal(name):
        return F.date_format(table.moment(name), "yyyy-MM-dd")
    return table.text(name)


def display_limit(chart: str) -> int:
    """The number of groups the board shows in a grouped chart."""
    return MAX_PIE_GROUPS if chart in SHORT else MAX_GROUPS


def grouped(
    table: Table, chart: str, x: str, y: str | None = None, limit: int | None = None
) -> DataFrame:
    """Sum of ``y`` (or record count) per label, ordered for the chart.

    ``limit`` keeps the first groups in that order; ``group_count`` counts all of them.
    """
    if chart not in GROUPED:
        raise ChartError(f"The chart is one of {GROUPED}.")
    if chart in ("line", "area") and not (table.is_temporal(x) or table.is_text(x)):
        raise ChartError("Line and area charts need a date column.")
    value = table.num(y) if y else F.lit(1.0)
    rows = table.df.select(
        _labels(table, x).alias("x"),
        value.alias("v"),
        (F.col(table.row_key) if table.row_key else F.lit(None)).alias("key"),
    ).where(F.col("x").isNotNull() & F.col("v").isNotNull())
    points = rows.groupBy("x").agg(
        F.sum("v").alias("y"), F.count("*").alias("record_count"), F.min("key").alias("first_row")
    )
    if chart in ("line", "area"):
        order = [F.col("x")]
    elif chart == "waterfall":
        _need_key(table)
        order = [F.col("first_row")]
    else:
        order = [F.desc(F.abs("y")), F.col("first_row"), F.col("x")]
    shown = F.greatest("y", F.lit(0.0)) if chart in POSITIVE else F.col("y")
    if limit is None:
        kept = placed(points, order, "position", {"_running": shown})
    else:  # the displayed groups are one task's work
        place = Window.partitionBy(F.lit(0)).orderBy(*order)
        kept = points.orderBy(*order).limit(limit).withColumn("position", F.row_number().over(place)).withColumn(
            "_running", F.sum(shown).over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        )
    totals = points.agg(
        F.struct(
            F.sum("record_count").alias("total_records"), F.count("*").alias("group_count")
        )
    )
    total = kept.agg(F.sum(shown)).scalar() if chart == "pareto" else None
    if chart in POSITIVE:
        kept = kept.where(F.col("y") > 0)
    out = kept.withColumn("_totals", totals.scalar()).select("*", "_totals.*").drop("_totals")
    out = out.withColumn("truncated", F.lit(False) if limit is None else F.col("group_count") > limit)
    if chart == "pareto":
        out = out.withColumn("cumulative_percentage", clean(F.try_divide(F.col("_running"), total) * 100))
    if chart == "waterfall":
        out = out.withColumn("end_value", F.col("_running")).withColumn("start_value", F.col("end_value") - F.col("y"))
    out = out.drop("_running")
    return out.drop("first_row")


def stacked(
    table: Table,
    chart: str,
    x: str,
    y: str,
    series: str,
    limit: int | None = None,
    series_limit: int | None = None,
) -> DataFrame:
    """Sums per x and series with their places.

    With both limits, the top x times the top series with absent combinations as zero;
    ``x_count`` and ``series_count`` tell how many there are.  Without one, only the
    combinations that exist, since the full grid grows with the product of both.
    """
    if chart not in STACKED:
        raise ChartError(f"The chart is one of {STACKED}.")
    if len({x, y, series}) != 3:
        raise ChartError("Use three different columns.")
    cells = (
        table.df.select(
            _labels(table, x).alias("x"),
            table.text(series).alias("series"),
            table.num(y).alias("v"),
            (F.col(table.row_key) if table.row_key else F.lit(None)).alias("key"),
        )
        .where(F.col("x").isNotNull() & F.col("series").isNotNull() & F.col("v").isNotNull())
        .groupBy("x", "series")
        .agg(F.sum("v").alias("y"), F.min("key").alias("first_row"))
    )
    def top(name: str, n: int | None, by_label: bool) -> DataFrame:
        totals = cells.groupBy(name).agg(F.sum("y").alias("_t"), F.min("first_row").alias("_f"))
        order = [F.col(name)] if by_label else [F.desc("_t"), F.col("_f"), F.col(name)]
        if n is None:
            return placed(totals, order, f"{name}_position").select(name, f"{name}_position")
        place = Window.partitionBy(F.lit(0)).orderBy(*order)
        return totals.orderBy(*order).limit(n).select(name, F.row_number().over(place).alias(f"{name}_position"))

    dated = table.is_temporal(x)
    counts = cells.agg(
        F.struct(F.count_distinct("x").alias("x_count"), F.count_distinct("series").alias("series_count"))
    ).scalar()
    if limit is None or series_limit is None:
        filled = (
            cells.join(top("x", limit, dated), "x")
            .join(top("series", series_limit, False), "series")
            .select("x", "series", "x_position", "series_position", "y")
        )
    else:
        # The series as one array value of at most ``series_limit``, spread over the labels.
        kept = top("series", series_limit, False)
        every = kept.agg(F.collect_list(F.struct("series", "series_position"))).scalar()
        labels = top("x", limit, dated).withColumn("_all", every)
        grid = labels.select("x", "x_position", F.inline("_all"))
        filled = grid.join(cells.select("x", "series", "y"), ["x", "series"], "left").select(
            "x", "series", "x_position", "series_position", F.coalesce("y", F.lit(0.0)).alias("y")
        )
    filled = filled.withColumn("_counts", counts).select("*", "_counts.*").drop("_counts")
    if chart.startswith("stacked_100"):
        inside = Window.partitionBy("x")
        filled = filled.withColumn(
            "percentage",
            clean(F.coalesce(F.try_divide(F.col("y"), F.sum("y").over(inside)) * 100, F.lit(0.0))),
        )
    return filled


def stacked_problems(table: Table, x: str, y: str, series: str) -> DataFrame:
    """Negative cells, or no positive one, which a stack cannot show (must be empty)."""
    cells = (
        table.df.select(
            _labels(table, x).alias("x"), table.text(series).alias("s"), table.num(y).alias("v")
        )
        .where(F.col("x").isNotNull() & F.col("s").isNotNull() & F.col("v").isNotNull())
        .groupBy("x", "s")
        .agg(F.sum("v").alias("y"))
    )
    checked = cells.agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    problems = F.array_compact(
        F.array(
            F.when(F.col("lo") < 0, "negative_values"),
            F.when(F.coalesce("hi", F.lit(0.0)) <= 0, "no_positive_value"),
        )
    )
    return checked.select(F.explode(problems).alias("problem"))


def combo(table: Table, x: str, y: str, secondary: str, limit: int | None = None) -> DataFrame:
    """Two sums per label over rows where both values are valid.

    ``limit`` keeps the first labels; ``group_count`` counts all of them.
    """
    if y == secondary:
        raise ChartError("Use two different measures.")
    a, b = table.num(y), table.num(secondary)
    rows = table.df.select(_labels(table, x).alias("x"), a.alias("a"), b.alias("b")).where(
        F.col("x").isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull()
    )
    points = rows.groupBy("x").agg(
        F.sum("a").alias("y"), F.sum("b").alias("secondary_y"), F.count("*").alias("record_count")
    )
    order = [F.col("x")] if table.is_temporal(x) else [F.desc(F.abs("y")), F.col("x")]
    count = points.agg(F.count("*")).scalar()
    return (points if limit is None else points.orderBy(*order).limit(limit)).withColumn("group_count", count)


def points(
    table: Table, x: str, y: str, size: str | None = None, limit: int | None = None
) -> DataFrame:
    """Valid points, or the first ``limit`` in row order, with the number of all valid points."""
    key = _need_key(table)
    columns = {"x": table.num(x), "y": table.num(y)}
    if size:
        columns["size"] = table.num(size)
    rows = table.df.select(F.col(key).alias("row_key"), *[c.alias(n) for n, c in columns.items()])
    valid = F.col("x").isNotNull() & F.col("y").isNotNull()
    if size:
        valid = valid & (F.col("size") > 0)
    rows = rows.where(valid)
    count = rows.agg(F.count("*")).scalar()
    kept = rows if limit is None else rows.orderBy("row_key").limit(limit)
    kept = kept.withColumn("valid_count", count)
    return kept.withColumn("truncated", F.lit(False) if limit is None else F.col("valid_count") > limit)


def card(table: Table, y: str, target: float | None = None) -> DataFrame:
    """Sum of a measure; with a positive target also the attainment."""
    if target is not None and target <= 0:
        raise ChartError("The target must be positive.")
    total = table.df.select(table.num(y).alias("v")).agg(
        F.sum("v").alias("y"), F.count("v").alias("record_count")
    )
    out = total.where(F.col("record_count") > 0).withColumn("x", F.lit(y))
    if target is not None:
        out = out.select(
            "*",
            F.lit(float(target)).alias("target"),
            (F.col("y") - target).alias("gap_to_target"),
            (F.col("y") / target * 100).alias("percentage_of_target"),
        )
    return out


def bins(table: Table, y: str) -> DataFrame:
    """Ten equal-width bins with a short range label."""
    rows = histogram(table.df.select(table.num(y).alias("v")), F.col("v"), HISTOGRAM_BINS)
    label = F.concat(range_text(F.col("bin_start")), F.lit("–"), range_text(F.col("bin_end")))
    return rows.withColumn("label", label)


def range_text(c: Column) -> Column:
    """Four significant digits in the manner of C's ``%.4g``."""
    scientific = F.format_string("%.3e", c)
    exponent = F.regexp_extract(scientific, "e(.*)$", 1).cast("int")
    scale = F.pow(F.lit(10.0), F.lit(3) - exponent)
    plain = F.format_string("%.7f", F.rint(c * scale) / scale)
    plain = F.regexp_replace(F.regexp_replace(plain, r"0+$", ""), r"\.$", "")
    short = F.regexp_replace(scientific, r"\.?0+e", "e")
    return F.when(c == 0, "0").when(exponent.between(-4, 3), plain).otherwise(short)


def box(table: Table, y: str, x: str | None = None, limit: int | None = None) -> DataFrame:
    """Summaries of all groups, or of the ``limit`` groups with most records."""
    label = table.text(x) if x else F.lit("All records")
    rows = table.df.select(label.alias("x"), table.num(y).alias("value"))
    if x is None:
        return box_summary(rows, few_groups=True)
    valid = rows.where(F.col("x").isNotNull() & F.col("value").isNotNull())
    if limit is None:
        return box_summary(valid)
    largest = valid.groupBy("x").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "x")
    largest = F.broadcast(largest.limit(limit).select("x"))
    return box_summary(valid.join(largest, "x"), few_groups=True)


def automatic_chart(
    kinds: dict[str, str],
    x: str | None = None,
    y: str | None = None,
    series: str | None = None,
    size: str | None = None,
    secondary: str | None = None,
) -> str:
    """Chart that fits the chosen columns; ``kinds`` maps columns to inferred types."""
    pair = x is not None and y is not None
    numeric = lambda c: c is not None and kinds.get(c) == "numeric"
    for extra, chart in ((size, "bubble"), (secondary, "combo"), (series, "stacked_column")):
        if extra is not None:
            if not pair:
                raise ChartError(f"A {chart} needs x and y columns.")
            return chart
    if not pair:
        return "histogram" if numeric(y or x) else "column"
    if not numeric(y):
        raise ChartError("The y column must be numeric.")
    if numeric(x):
        return "scatter"
    return "line" if kinds.get(x) == "date/time" else "column"
