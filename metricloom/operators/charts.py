"""Chart-data queries: a spec becomes filter, group, aggregate, top-N and post-step.

Only the data behind a chart is built.  Top-N keeps ``orderBy().limit()`` on the grouped
frame, which Spark runs as a distributed top-k, and joins the few kept labels back.
Windows run after the top-N, over at most ``top_n`` labels times 12 series.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.frames import literal_frame
from metricloom.functions.values import Table, clean, period_label
from metricloom.operators.kpi import AGGREGATIONS, Kpi, Measure, Registry, aggregate_measures, source_kpi
from metricloom.operators.profile import profile
from metricloom.operators.quantiles import exact_quantiles
from metricloom.session import checkpointed

# Chart vocabulary and bounds.
TIME_CHARTS = ("time_line", "time_area", "time_area_stacked")
CATEGORY_CHARTS = (
    "category_bar",
    "category_bar_horizontal",
    "category_bar_stacked",
    "pareto",
    "donut",
    "heatmap",
    "waterfall",
    "funnel",
    "combo",
)
ROW_CHARTS = ("scatter", "histogram", "box")
CHARTS = TIME_CHARTS + CATEGORY_CHARTS + ROW_CHARTS + ("scorecard",)
SERIES_CHARTS = TIME_CHARTS + CATEGORY_CHARTS[:3] + ("scatter", "heatmap")
MAX_MEASURES = 5
MAX_TOP_N = 50
MAX_SERIES = 12
MAX_FILTER_VALUES = 50
MAX_TITLE = 120
DONUT_VALUES = 7


class ChartError(ValueError):
    """A chart spec or its data breaks a rule."""


@dataclass(frozen=True)
class ChartSpec:
    chart: str
    measures: tuple[str, ...]
    x: str | None = None
    series: str | None = None
    title: str = "Chart"
    aggregation: str = "configured"
    granularity: str = "month"
    filter_column: str | None = None
    filter_mode: str = "include"
    filter_values: tuple[str, ...] = ()
    date_start: str | None = None
    date_end: str | None = None
    date_column: str | None = None
    sort_by: str = "value"
    descending: bool = True
    top_n: int = 10
    bins: int = 10
    scale: str = "linear"

    def __post_init__(self) -> None:
        def check(ok: bool, message: str) -> None:
            if not ok:
                raise ChartError(message)

        check(self.chart in CHARTS, f"The chart is one of {CHARTS}.")
        check(1 <= len(self.title.strip()) <= MAX_TITLE, "The title is too short or long.")
        check(1 <= len(self.measures) <= MAX_MEASURES, "A chart has 1 to 5 measures.")
        check(len(set(self.measures)) == len(self.measures), "Measures must differ.")
        check(
            self.aggregation in ("configured",) + AGGREGATIONS, "Unknown aggregation."
        )
        check(
            self.granularity in ("day", "month", "quarter", "year"), "Unknown granularity."
        )
        check(self.filter_mode in ("include", "exclude"), "Unknown filter mode.")
        check(len(self.filter_values) <= MAX_FILTER_VALUES, "Too many filter values.")
        check(
            self.filter_column is not None or not self.filter_values,
            "Filter values need a filter column.",
        )
        check(self.sort_by in ("value", "label", "source"), "Unknown sort.")
        check(1 <= self.top_n <= MAX_TOP_N, "top_n lies between 1 and 50.")
        check(5 <= self.bins <= 50, "bins lies between 5 and 50.")
        check(self.scale in ("linear", "log"), "Unknown scale.")
        check(
            self.date_start is None
            or self.date_end is None
            or self.date_start <= self.date_end,
            "The start date lies after the end date.",
        )
        grouped = self.chart in TIME_CHARTS + CATEGORY_CHARTS
        check(not grouped or self.x is not None, "The chart needs an x column.")
        check(self.chart != "scatter" or self.x is not None, "A scatter needs an x column.")
        check(self.chart != "scorecard" or self.x is None, "A scorecard has no x column.")
        check(
            self.series is None or self.chart in SERIES_CHARTS, "The chart takes no series."
        )
        check(
            self.chart != "heatmap" or (self.series is not None and self.series != self.x),
            "A heatmap needs two different categories.",
        )
        single = ROW_CHARTS + ("scorecard", "pareto", "donut", "heatmap", "waterfall", "funnel")
        check(
            self.chart not in single or len(self.measures) == 1,
            "The chart takes exactly one measure.",
        )
        check(self.chart != "combo" or len(self.measures) == 2, "A combo takes two measures.")
        check(
            not (self.chart in TIME_CHARTS and self.series) or len(self.measures) == 1,
            "A time chart with series takes one measure.",
        )
        check(
            self.scale != "log"
            or self.chart in TIME_CHARTS + CATEGORY_CHARTS[:3] + ("scatter", "combo"),
            "A log scale is not available for this chart.",
        )


@dataclass(frozen=True)
class ChartMeasure:
    """A measure selector resolved to a KPI, or to the record count."""

    selector: str
    label: str
    aggregation: str
    kpi: Kpi | None
    configured: bool

    @property
    def row_level(self) -> bool:
        return self.kpi is not None and self.kpi.row_level


def resolve_measure(selector: str, spec: ChartSpec, registry: Registry | None) -> ChartMeasure:
    row_value = spec.chart in ROW_CHARTS
    if selector == "count:records":
        if row_value:
            raise ChartError("Record counts need a grouped chart or a scorecard.")
        return ChartMeasure(selector, "Record count", "count", None, False)
    if selector.startswith("column:"):
        name = selector.removeprefix("column:")
        aggregation = "mean" if spec.aggregation == "configured" else spec.aggregation
        shown = "row_value" if row_value else aggregation
        return ChartMeasure(selector, name, shown, source_kpi(name, aggregation), False)
    if selector.startswith("metric:"):
        if registry is None:
            raise ChartError("Configure KPIs first.")
        kpi = registry.kpi(selector.removeprefix("metric:"))
        if kpi.kind == "conditional" and spec.aggregation != "configured":
            raise ChartError("A conditional rate keeps its own calculation.")
        if kpi.row_level and spec.aggregation != "configured":
            kpi = replace(kpi, aggregation=spec.aggregation)
        shown = "row_value" if row_value and kpi.row_level else kpi.aggregation
        return ChartMeasure(selector, kpi.name, shown, kpi, True)
    raise ChartError(f"Unknown measure {selector}.")


def resolve_measures(spec: ChartSpec, registry: Registry | None = None) -> list[ChartMeasure]:
    measures = [resolve_measure(s, spec, registry) for s in spec.measures]
    if spec.chart in ROW_CHARTS and not measures[0].row_level:
        raise ChartError("The chart needs a row-level measure.")
    summable = ("time_area_stacked", "category_bar_stacked", "pareto", "donut")
    if spec.chart in summable and any(m.aggregation not in ("sum", "count") for m in measures):
        raise ChartError("The chart needs summable measures.")
    formats = {m.kpi.display_format if m.kpi else "number" for m in measures}
    if len(formats) > 1:
        raise ChartError("The measures need the same display format.")
    return measures


def classification(measures: Sequence[ChartMeasure]) -> str:
    return "kpi" if all(m.configured for m in measures) else "supplementary"


def check_columns(spec: ChartSpec, facts: dict[str, dict]) -> None:
    """Check a spec against profile facts, as returned by :func:`profile_facts`."""

    def need(name: str | None, test: str, message: str) -> None:
        if name is not None and not facts.get(name, {}).get(test):
            raise ChartError(message)

    if spec.chart in TIME_CHARTS:
        need(spec.x, "is_date_candidate", "A time chart needs a date column.")
    if spec.chart in CATEGORY_CHARTS or spec.chart == "box":
        need(spec.x, "is_category_candidate", "The x column must be a category.")
    if spec.chart == "donut" and facts[spec.x]["unique_count"] > DONUT_VALUES:
        raise ChartError("A donut takes at most seven values.")
    if spec.chart == "scatter":
        need(spec.x, "is_kpi_candidate", "A scatter needs a varying numeric x column.")
    need(spec.series, "is_category_candidate", "The series must be a category.")
    need(spec.filter_column, "is_category_candidate", "The filter must be a category.")
    for selector in spec.measures:
        if selector.startswith("column:"):
            name = selector.removeprefix("column:")
            need(name, "is_kpi_candidate", "The measure must be a varying numeric column.")
    if (spec.date_start or spec.date_end) and filter_date_column(spec, facts) is None:
        raise ChartError("The date filter needs a date column.")


def filter_date_column(
    spec: ChartSpec, facts: dict[str, dict] | None = None, registry: Registry | None = None
) -> str | None:
    """Time axis, else the named or configured date, else the only detected one."""
    if spec.chart in TIME_CHARTS:
        return spec.x
    if spec.date_column:
        return spec.date_column
    if registry is not None and registry.date_column:
        return registry.date_column
    dates = [c for c, f in (facts or {}).items() if f.get("is_date_candidate")]
    return dates[0] if len(dates) == 1 else None


def profile_facts(profiled: DataFrame) -> dict[str, dict]:
    """Schema-level profile facts for driver-side checks; one entry per column."""
    names = ("inferred_type", "unique_count", "is_kpi_candidate", "is_date_candidate",
             "is_category_candidate")
    return {r["column"]: {n: r[n] for n in names} for r in profiled.select("column", *names).collect()}


def filter_rows(table: Table, spec: ChartSpec, registry: Registry | None = None) -> DataFrame:
    """Category and date filters; excluding keeps rows whose category is missing."""
    df = table.df
    if spec.filter_column is not None and spec.filter_values:
        hit = F.coalesce(table.raw_text(spec.filter_column).isin(*spec.filter_values), F.lit(False))
        df = df.where(hit if spec.filter_mode == "include" else ~hit)
    if spec.date_start or spec.date_end:
        column = filter_date_column(spec, None, registry)
        if column is None:
            raise ChartError("The date filter needs a date column.")
        day = table.day(column)
        if spec.date_start:
            df = df.where(day >= F.lit(spec.date_start).cast("date"))
        if spec.date_end:
            df = df.where(day <= F.lit(spec.date_end).cast("date"))
    return df


def unknown_filter_values(table: Table, spec: ChartSpec) -> DataFrame:
    """Filter values that do not occur in the table (must be empty)."""
    rows = [(v,) for v in spec.filter_values]
    wanted = literal_frame(table.df.sparkSession, rows, "value string")
    present = table.df.select(table.text(spec.filter_column).alias("value"))
    present = present.where(F.col("value").isin(*spec.filter_values)).distinct()
    return wanted.join(F.broadcast(present), "value", "left_anti")


def grouped(
    table: Table, spec: ChartSpec, registry: Registry | None = None
) -> tuple[DataFrame, list[ChartMeasure]]:
    """Long rows ``x, series, measure, value, record_count`` before any ordering."""
    measures = resolve_measures(spec, registry)
    df = filter_rows(table, spec, registry)
    if spec.chart in TIME_CHARTS:
        x = period_label(table.day(spec.x), spec.granularity)
    else:
        x = table.text(spec.x)
    series = table.text(spec.series) if spec.series else F.lit(None).cast("string")
    keyed = df.withColumn("_x", x).withColumn("_series", series).where(F.col("_x").isNotNull())
    if spec.series:
        keyed = keyed.where(F.col("_series").isNotNull())
    compiled = [
        Measure(table, m.kpi, f"m{i}", eligible_only=False) if m.kpi else None
        for i, m in enumerate(measures)
    ]
    extra = [F.count("*").alias("record_count")]
    if table.row_key:
        extra.append(F.min(table.row_key).alias("_first"))
    wide = aggregate_measures(
        keyed, ["_x", "_series"], [c for c in compiled if c is not None], extra=extra
    )
    parts = [
        F.struct(
            F.lit(i).alias("measure_position"),
            F.lit(m.selector).alias("measure_selector"),
            F.lit(m.label).alias("measure"),
            F.lit(m.aggregation).alias("aggregation"),
            (c.value if c is not None else F.col("record_count").cast("double")).alias("value"),
        )
        for i, (m, c) in enumerate(zip(measures, compiled, strict=True))
    ]
    first = F.col("_first") if table.row_key else F.lit(None)
    long = wide.select(
        F.col("_x").alias("x"),
        F.col("_series").alias("series"),
        "record_count",
        first.alias("first_row"),
        F.inline(F.array(*parts)),
    ).where(F.col("value").isNotNull())
    return long, measures


def _ordered_labels(long: DataFrame, spec: ChartSpec) -> DataFrame:
    """The kept x labels with their position (at most ``top_n`` rows)."""
    primary = F.max(F.when(F.col("measure_position") == 0, F.col("value")))
    labels = long.groupBy("x").agg(
        F.coalesce(primary, F.lit(float("-inf"))).alias("_v"), F.min("first_row").alias("_f")
    )
    ties = [F.col("_f"), F.lower("x"), F.col("x")]
    if spec.sort_by == "value":
        order = [F.desc("_v") if spec.descending else F.asc("_v"), *ties]
    elif spec.sort_by == "label":
        folded, exact = F.lower("x"), F.col("x")
        order = [folded.desc(), exact] if spec.descending else [folded, exact]
    else:
        order = [F.asc("_f"), F.lower("x"), F.col("x")]
    kept = labels.orderBy(*order).limit(spec.top_n)
    ranked = Window.partitionBy(F.lit(0)).orderBy(*order)
    return kept.select("x", F.row_number().over(ranked).alias("x_position"))


def _densify(rows: DataFrame, xs: DataFrame, fill: Column) -> DataFrame:
    """Every kept x with every series; absent combinations get ``fill``.

    The x labels travel as one array value: at most ``top_n`` of them, or the periods of the
    calendar.  The series stay distributed, however many there are.
    """
    names = ("series", "measure", "measure_selector", "aggregation", "measure_position")
    every = xs.agg(F.collect_list(F.struct(*xs.columns))).scalar()
    grid = rows.select(*names).distinct().withColumn("_all", every).select(F.inline("_all"), *names)
    have = rows.select(
        F.col("x").alias("_x"),
        F.col("series").alias("_s"),
        F.col("measure_position").alias("_m"),
        "value",
        "record_count",
    )
    condition = (
        (F.col("x") == F.col("_x"))
        & F.col("series").eqNullSafe(F.col("_s"))
        & (F.col("measure_position") == F.col("_m"))
    )
    return (
        grid.join(have, condition, "left")
        .withColumn("value", F.coalesce("value", fill))
        .withColumn("record_count", F.coalesce("record_count", F.lit(0)))
        .drop("_x", "_s", "_m")
    )


def chart_data(table: Table, spec: ChartSpec, registry: Registry | None = None) -> DataFrame:
    """The rows a chart draws, with its derived columns."""
    if spec.chart == "scorecard":
        return _scorecard(table, spec, registry)
    if spec.chart in ROW_CHARTS:
        return _row_chart(table, spec, registry)
    long, measures = grouped(table, spec, registry)
    if spec.chart in TIME_CHARTS:
        rows = long.drop("first_row")
        if spec.chart != "time_line" and spec.series:
            xs = rows.select("x").distinct()
            rows = _densify(rows, xs, F.lit(0.0))
        return rows.orderBy("x", "series", "measure")
    labels = F.broadcast(_ordered_labels(long, spec))
    rows = long.join(labels, "x").drop("first_row")
    whole = Window.partitionBy("measure_position")
    match spec.chart:
        case "category_bar_stacked":
            rows = _densify(rows, labels, F.lit(0.0))
        case "heatmap":
            rows = _densify(rows, labels, F.lit(None).cast("double"))
        case "donut":
            rows = rows.withColumn(
                "share_percentage",
                clean(F.try_divide(F.col("value"), F.sum("value").over(whole)) * 100),
            )
        case "pareto":
            order = whole.orderBy(F.desc("value"), "x_position")
            running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            total = F.sum("value").over(whole)
            rows = rows.withColumn("cumulative_value", F.sum("value").over(running))
            rows = rows.withColumn(
                "individual_percentage", clean(F.try_divide(F.col("value"), total) * 100)
            ).withColumn(
                "cumulative_percentage",
                clean(F.coalesce(F.try_divide(F.col("cumulative_value"), total) * 100, F.lit(0.0))),
            )
        case "waterfall":
            running = whole.orderBy("x_position").rowsBetween(
                Window.unboundedPreceding, Window.currentRow
            )
            rows = rows.withColumn("end_value", F.sum("value").over(running)).withColumn(
                "start_value", F.col("end_value") - F.col("value")
            )
        case "funnel":
            rows = rows.withColumn(
                "percentage_of_maximum",
                clean(
                    F.coalesce(
                        F.try_divide(F.col("value"), F.max("value").over(whole)) * 100, F.lit(0.0)
                    )
                ),
            )
        case "combo":
            first, second = (
                F.max(F.when(F.col("measure_position") == i, F.col("value"))).alias(n)
                for i, n in ((0, "primary_value"), (1, "secondary_value"))
            )
            return rows.groupBy("x", "x_position", "record_count").agg(first, second).orderBy(
                "x_position"
            )
    return rows.orderBy("x_position", "series", "measure_position")


def drawable(table: Table, spec: ChartSpec, registry: Registry | None = None) -> DataFrame:
    """:func:`chart_data` after the column rules, refused when the rows break a guard."""
    check_columns(spec, profile_facts(profile(table)))
    rows = chart_data(table, spec, registry)
    if "value" in rows.columns:
        problems = [r["problem"] for r in guards(rows, spec).collect()]
        if problems:
            raise ChartError(f"The chart cannot be drawn: {problems}")
    return rows


def guards(rows: DataFrame, spec: ChartSpec) -> DataFrame:
    """Rule violations of chart rows, one row each; an empty frame means drawable."""
    checked = rows.agg(
        F.count("*").alias("n"),
        F.coalesce(F.min("value"), F.lit(0.0)).alias("lo"),
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"),
        (F.count_distinct("series") if "series" in rows.columns else F.lit(0)).alias("series"),
    )
    parts_of_whole = spec.chart in ("pareto", "donut", "funnel")
    problems = F.array_compact(
        F.array(
            F.when(F.col("n") == 0, "no_rows"),
            F.when(F.col("series") > MAX_SERIES, "too_many_series"),
            F.when(
                F.lit(parts_of_whole) & ((F.col("lo") < 0) | (F.col("total") <= 0)),
                "needs_nonnegative_values",
            ),
            F.when(F.lit(spec.scale == "log") & (F.col("lo") <= 0), "log_needs_positive_values"),
        )
    )
    return checked.select(F.explode(problems).alias("problem"))


def _scorecard(table: Table, spec: ChartSpec, registry: Registry | None) -> DataFrame:
    measure = resolve_measures(spec, registry)[0]
    df = filter_rows(table, spec, registry)
    extra = [F.count("*").alias("record_count")]
    if measure.kpi is None:
        wide, value = df.agg(*extra), F.col("record_count").cast("double")
    else:
        compiled = Measure(table, measure.kpi, "m0", eligible_only=False)
        wide = aggregate_measures(df, [], [compiled], extra=extra)
        value = compiled.value
    return wide.select(
        F.lit(measure.selector).alias("measure_selector"),
        F.lit(measure.label).alias("measure"),
        F.lit(measure.aggregation).alias("aggregation"),
        value.alias("value"),
        "record_count",
    ).where(F.col("value").isNotNull())


def _row_chart(table: Table, spec: ChartSpec, registry: Registry | None) -> DataFrame:
    measure = resolve_measures(spec, registry)[0]
    value = Measure(table, measure.kpi, "m0", eligible_only=False).row_value
    df = filter_rows(table, spec, registry)
    key = [F.col(table.row_key).alias("row_key")] if table.row_key else []
    if spec.chart == "scatter":
        series = table.text(spec.series) if spec.series else F.lit(None).cast("string")
        return df.select(
            *key, table.num(spec.x).alias("x"), value.alias("y"), series.alias("series")
        ).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    if spec.chart == "histogram":
        return histogram(df.select(value.alias("value")), F.col("value"), spec.bins)
    category = table.text(spec.x) if spec.x else F.lit("All records")
    return box_summary(df.select(category.alias("x"), value.alias("value")), few_groups=True if spec.x is None else None)


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last bin is closed.

    Equal minimum and maximum give a single bin.  Empty bins are kept.
    """
    values = df.select(value.alias("v")).where(F.col("v").isNotNull())
    span = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"))
    one = span.where(F.col("n") > 0)
    flat = F.col("lo") == F.col("hi")
    width = (F.col("hi") - F.col("lo")) / bins
    index = F.when(flat, 0).otherwise(
        F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))
    )
    counted = (
        values.withColumn("_s", span.select(F.struct("lo", "hi")).scalar())
        .select("v", "_s.*")
        .groupBy(index.cast("int").alias("_b"))
        .agg(F.count("*").alias("count"))
    )
    edges = one.select(
        F.explode(F.sequence(F.lit(0), F.when(flat, 0).otherwise(bins - 1))).alias("bin"),
        "lo",
        "hi",
        flat.alias("flat"),
        width.alias("w"),
    )
    bin_ = F.col("bin")
    return edges.join(F.broadcast(counted), F.col("bin") == F.col("_b"), "left").select(
        "bin",
        F.when(F.col("flat"), F.col("lo")).otherwise(F.col("lo") + bin_ * F.col("w")).alias("bin_start"),
        F.when(F.col("flat"), F.col("hi")).otherwise(F.col("lo") + (bin_ + 1) * F.col("w")).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def box_summary(df: DataFrame, *, few_groups: bool | None = None) -> DataFrame:
    """Five-number summary, whiskers within 1.5 IQR, and outlier counts per ``x``.

    Whiskers need the quartiles first, so the values are read once more with the few
    summary rows joined in.
    """
    values = df.where(F.col("x").isNotNull() & F.col("value").isNotNull())
    q = exact_quantiles(
        values, ["x"], F.col("value"), [0.0, 0.25, 0.5, 0.75, 1.0], few_groups=few_groups
    )
    at = F.col("quantiles")
    summary = q.select(
        "x",
        at[0].alias("minimum"),
        at[1].alias("q1"),
        at[2].alias("median"),
        at[3].alias("q3"),
        at[4].alias("maximum"),
        (at[1] - 1.5 * (at[3] - at[1])).alias("lower_fence"),
        (at[3] + 1.5 * (at[3] - at[1])).alias("upper_fence"),
        F.col("value_count").alias("count"),
    )
    summary = checkpointed(summary)
    fences = summary.select(F.col("x").alias("_x"), "lower_fence", "upper_fence")
    joined = values.join(
        F.broadcast(fences) if few_groups else fences, F.col("x") == F.col("_x")
    )
    inside = F.col("value").between(F.col("lower_fence"), F.col("upper_fence"))
    whiskers = joined.groupBy(F.col("_x")).agg(
        F.min(F.when(inside, F.col("value"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("value"))).alias("upper_whisker"),
        F.count_if(~inside).alias("outlier_count"),
    )
    return summary.join(whiskers, F.col("x") == F.col("_x")).drop("_x")
