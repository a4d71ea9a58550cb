"""The analysis battery: every finding about every KPI from one pass of cells.

The table is read once into *cells*: one row per day and category combination with
the mergeable states of all KPIs.  Cells are checkpointed; periods, segments, cohorts
and the whole-table value are merged from them.  Only row-level analyses (quartile
outliers, correlations, exact medians) read the table again, each as narrow
aggregates.

Segments come from category columns with at most ``MAX_SEGMENTS`` distinct values, the
rule that makes a column a category in the profile; ``Battery`` checks it on the cells.
Periods are bounded too: days of one month, or at most 23 months, or quarters, or
years.  The merged groups therefore number a few thousand rows whatever the table size;
they are kept in one partition, so the analyses over them need no shuffle, and they
carry the KPI settings, so they need no joins.  Outlier rows are the only unbounded
output and stay distributed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.frames import literal_frame
from metricloom.functions.values import (
    Table,
    clean,
    correlation_strength,
    count_confidence,
    direction,
    favorable,
    granularity_for,
    near_zero,
    percent_change,
    period_label_by,
)
from metricloom.operators.kpi import KpiError, Measure, Registry, State
from metricloom.operators.quantiles import exact_quantiles
from metricloom.session import checkpointed

# Eligibility thresholds.
MIN_GENERAL_RECORDS = 5
MIN_PERIOD_RECORDS = 2
MIN_TREND_PERIODS = 3
MIN_SEGMENT_RECORDS = 2
BASELINE_PERIODS = 4
MIN_ANOMALY_RECORDS = 4
MIN_CORRELATION_PAIRS = 3
MIN_BENCHMARK_RECORDS = 3
MAX_SEGMENTS = 50

_KEY = ["metric_pos", "category_pos"]
_SETTINGS = [
    "metric_id",
    "metric",
    "aggregation",
    "display_format",
    "kpi_direction",
    "target",
    "target_scope",
    "row_level",
    "additive",
]
_META = (
    "metric_pos int, metric_id string, metric string, aggregation string, "
    "display_format string, kpi_direction string, target double, target_scope string, "
    "row_level boolean, additive boolean"
)


def _meets(value: Column, target: Column, kpi_direction: Column) -> Column:
    return F.when(kpi_direction == "higher", value >= target).otherwise(value <= target)


def _breach(value: Column, target: float, kpi_direction: str) -> Column:
    return value < F.lit(target) if kpi_direction == "higher" else value > F.lit(target)


class Battery:
    def __init__(
        self,
        table: Table,
        registry: Registry,
        *,
        numeric_columns: Sequence[str] | None = None,
    ) -> None:
        self.table = table
        self.registry = registry
        self.spark = table.df.sparkSession
        self.categories = list(registry.category_columns)
        table.require(*self.categories)
        if registry.date_column is not None:
            table.require(registry.date_column)
        if numeric_columns is None:
            numeric_columns = [c for c in table.columns if table.is_number(c)]
        self.numeric_columns = list(numeric_columns)
        self.measures = [
            Measure(table, kpi, f"k{i}", eligible_only=True)
            for i, kpi in enumerate(registry.kpis)
        ]

    # ---------------------------------------------------------------- base frames

    @cached_property
    def meta(self) -> DataFrame:
        """One row per KPI (at most five)."""
        rows = [
            (
                i,
                k.metric_id,
                k.name,
                k.aggregation,
                k.display_format,
                k.direction,
                None if k.target is None else float(k.target),
                k.target_scope,
                k.row_level,
                k.aggregation == "sum",
            )
            for i, k in enumerate(self.registry.kpis)
        ]
        return F.broadcast(literal_frame(self.spark, rows, _META))

    @cached_property
    def metric_categories(self) -> DataFrame:
        rows = [
            (i, j, name)
            for i in range(len(self.measures))
            for j, name in enumerate(self.categories)
        ]
        schema = "metric_pos int, category_pos int, category_column string"
        return F.broadcast(literal_frame(self.spark, rows, schema))

    def _states(self) -> list[State]:
        states = []
        for measure in self.measures:
            states += measure.states
            kpi = measure.kpi
            if kpi.target is not None and kpi.target_scope == "row" and kpi.row_level:
                hit = _breach(measure.row_value, kpi.target, kpi.direction)
                states.append(
                    State(f"{measure.prefix}_breach", "count", F.when(hit, F.lit(1)))
                )
                states.append(State(f"{measure.prefix}_rows", "sum", measure.row_value))
        return states

    @cached_property
    def _segment_names(self) -> list[str]:
        return [f"_c{j}" for j in range(len(self.categories))]

    @cached_property
    def cells(self) -> DataFrame:
        """One row per day and category combination; the only grouped table scan."""
        table, date = self.table, self.registry.date_column
        if date is None:
            day = F.lit(None).cast("date")
            missing = unreadable = F.lit(None).cast("int")
        else:
            day = table.day(date)
            missing = F.when(table.missing(date), F.lit(1))
            unreadable = F.when(~table.missing(date) & day.isNull(), F.lit(1))
        keyed = table.df.withColumn("_day", day)
        for name, column in zip(self._segment_names, self.categories, strict=True):
            keyed = keyed.withColumn(name, table.text(column))
        extra = [
            F.count("*").alias("n_rows"),
            F.count(missing).alias("missing_dates"),
            F.count(unreadable).alias("unreadable_dates"),
            *[s.first() for s in self._states()],
        ]
        names = self._segment_names
        if not names:
            cells = keyed.groupBy("_day").agg(*extra).withColumn("_set", F.lit(0))
        else:
            # One grouping set per category: the cells grow with the sum of the categories'
            # values, never with their product.
            sets = [[F.col("_day"), F.col(n)] for n in names]
            grouped = keyed.groupingSets(sets, "_day", *names)
            cells = grouped.agg(*extra, F.grouping_id().alias("_gid"))
            # grouping_id has a zero bit exactly for the grouped columns.
            width = len(names)
            which = F.lit(None).cast("int")
            for j in range(width):
                gid = ((1 << width) - 1) ^ (1 << (width - 1 - j))
                which = F.when(F.col("_gid") == gid, F.lit(j)).otherwise(which)
            cells = cells.withColumn("_set", which).drop("_gid")
        cells = checkpointed(cells)
        self._check_segments(cells)
        return cells

    def _check_segments(self, cells: DataFrame) -> None:
        if not self.categories:
            return
        counts = cells.agg(
            *[F.count_distinct(n).alias(n) for n in self._segment_names]
        ).first()
        for name, column in zip(self._segment_names, self.categories, strict=True):
            if counts[name] > MAX_SEGMENTS:
                raise KpiError(
                    f"{column} has {counts[name]} values; a category has at most {MAX_SEGMENTS}."
                )

    @cached_property
    def temporal(self) -> DataFrame:
        """Per KPI: whether its rows can be put on a time line, and how finely."""
        month = F.trunc("_day", "month")
        once = self.cells.where(F.col("_set") == 0)
        wide = once.agg(
            F.sum("n_rows").alias("n_rows"),
            F.sum("missing_dates").alias("missing_dates"),
            F.sum("unreadable_dates").alias("unreadable_dates"),
            *[
                F.count_distinct(F.when(F.col(f"{m.prefix}_n") > 0, month)).alias(
                    f"{m.prefix}_m"
                )
                for m in self.measures
            ],
        )
        per_metric = F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("metric_pos"), F.col(f"{m.prefix}_m").alias("months")
                    )
                    for i, m in enumerate(self.measures)
                ]
            )
        )
        rows = wide.select("n_rows", "missing_dates", "unreadable_dates", per_metric)
        if self.registry.date_column is None:
            status = F.lit("no_date_column")
        else:
            status = (
                F.when(F.col("missing_dates") > 0, "missing_dates")
                .when(F.col("unreadable_dates") > 0, "unparseable_date")
                .when(F.col("months") == 0, "no_dated_kpi_values")
                .otherwise("ok")
            )
        return rows.withColumn("status", status).withColumn(
            "granularity", F.when(F.col("status") == "ok", granularity_for(F.col("months")))
        )

    @cached_property
    def temporal_fixed(self) -> DataFrame:
        return F.broadcast(self.temporal)

    def _levels(self) -> Column:
        """Groupings a cell or row takes part in, as an array of structs."""

        def level(name: str, pos: int, segment: Column, dated: bool) -> Column:
            return F.struct(
                F.lit(name).alias("level"),
                F.lit(pos).alias("category_pos"),
                segment.cast("string").alias("segment"),
                F.lit(dated).alias("dated"),
            )

        none = F.lit(None)
        out = [level("total", -1, none, False), level("period", -1, none, True)]
        for j, name in enumerate(self._segment_names):
            out.append(level("segment", j, F.col(name), False))
            out.append(level("segment_period", j, F.col(name), True))
        return F.array(*out)

    @staticmethod
    def _period() -> Column:
        return F.when(
            F.col("dated") & (F.col("status") == "ok"),
            period_label_by(F.col("_day"), F.col("granularity")),
        )

    @cached_property
    def groups(self) -> DataFrame:
        """Merged KPI values per metric and grouping; small, checkpointed."""
        keys = ["metric_pos", "level", "category_pos", "segment", "period"]
        settings = ["status", "granularity"]
        # KPIs that share a time line share one merge of all states; they part afterwards.
        shared = self.temporal_fixed.groupBy(*settings).agg(
            F.sort_array(F.collect_list("metric_pos")).alias("metrics")
        )
        every = shared.agg(F.collect_list(F.struct(*settings, "metrics"))).scalar()
        spread = (
            self.cells.withColumn("_all", every)
            .select("*", F.inline("_all"))
            .withColumn("_l", F.explode(self._levels()))
            .select("*", "_l.*")
        )
        if self.categories:
            # Cells of one grouping set serve one category; set 0 also the totals.
            own = F.greatest(F.col("category_pos"), F.lit(0))
            spread = spread.where(F.col("_set") == own)
        merged = (
            spread.withColumn("period", self._period())
            .where(~F.col("dated") | F.col("period").isNotNull())
            .groupBy(*keys[1:], *settings, "metrics")
            .agg(F.sum("n_rows").alias("n_rows"), *[s.merge() for s in self._states()])
            .withColumn("metric_pos", F.explode("metrics"))
            .drop("metrics")
        )
        for i, measure in enumerate(self.measures):
            for slot, expression in measure.medians:
                merged = self._with_median(merged, i, measure, slot, expression)

        def pick(per_measure) -> Column:
            chosen = None
            for i, measure in enumerate(self.measures):
                part = per_measure(measure)
                chosen = (
                    F.when(F.col("metric_pos") == i, part)
                    if chosen is None
                    else chosen.when(F.col("metric_pos") == i, part)
                )
            return chosen

        def slot_or_null(suffix: str, kind: str):
            return lambda m: (
                F.col(f"{m.prefix}_{suffix}")
                if f"{m.prefix}_{suffix}" in merged.columns
                else F.lit(None)
            ).cast(kind)

        details = {
            name: pick(lambda m, name=name: m.detail[name])
            for name in self.measures[0].detail
        }
        named = F.lit(None).cast("string")
        for j, column in enumerate(self.categories):
            named = F.when(F.col("category_pos") == j, F.lit(column)).otherwise(named)
        out = merged.select(
            *keys,
            *settings,
            named.alias("category_column"),
            pick(lambda m: F.col(f"{m.prefix}_n")).alias("n"),
            "n_rows",
            pick(lambda m: m.value).alias("value"),
            pick(slot_or_null("breach", "long")).alias("breaches"),
            pick(slot_or_null("rows", "double")).alias("row_sum"),
            *[c.alias(name) for name, c in details.items()],
        ).join(self.meta, "metric_pos")
        # A few thousand rows at most: one partition spares every later shuffle.
        return checkpointed(out).coalesce(1)

    def _with_median(
        self, merged: DataFrame, i: int, measure: Measure, slot: str, expression: Column
    ) -> DataFrame:
        date = self.registry.date_column
        rows = self.table.df.select(
            F.when(measure.eligible, expression).alias("_x"),
            (self.table.day(date) if date else F.lit(None).cast("date")).alias("_day"),
            *[
                self.table.text(c).alias(n)
                for n, c in zip(self._segment_names, self.categories, strict=True)
            ],
        ).where(F.col("_x").isNotNull())
        # One row of the temporal frame, so the labels use a constant granularity.
        known = self.temporal.where(F.col("metric_pos") == i).first()
        keys = ["level", "category_pos", "segment", "period"]
        spread = (
            rows.withColumn("status", F.lit(known["status"]))
            .withColumn("granularity", F.lit(known["granularity"]).cast("string"))
            .withColumn("_l", F.explode(self._levels()))
            .select("_x", "_day", "status", "granularity", "_l.*")
            .withColumn("period", self._period())
            .where(~F.col("dated") | F.col("period").isNotNull())
        )
        middle = exact_quantiles(spread, keys, F.col("_x"), [0.5], few_groups=True).select(
            *[F.col(k).alias(f"_m_{k}") for k in keys],
            F.col("quantiles")[0].alias(f"{slot}_med"),
        )
        condition = F.col("metric_pos") == i
        for k in keys:
            condition = condition & F.col(k).eqNullSafe(F.col(f"_m_{k}"))
        return merged.join(F.broadcast(middle), condition, "left").drop(
            *[f"_m_{k}" for k in keys]
        )

    @cached_property
    def totals(self) -> DataFrame:
        return self.groups.where(F.col("level") == "total").drop("category_column")

    @cached_property
    def periods(self) -> DataFrame:
        return self.groups.where((F.col("level") == "period") & (F.col("n") > 0)).drop(
            "category_pos", "category_column", "segment"
        )

    @cached_property
    def segments(self) -> DataFrame:
        return self.groups.where(
            (F.col("level") == "segment") & F.col("segment").isNotNull() & (F.col("n") > 0)
        )

    @cached_property
    def _timed(self) -> DataFrame:
        """KPIs that have a time line."""
        rows = self.totals.where(F.col("status") == "ok")
        return rows.select("metric_pos", "granularity", *_SETTINGS)

    @cached_property
    def latest(self) -> DataFrame:
        """The last two periods of every KPI with a time line."""
        w = Window.partitionBy("metric_pos").orderBy("period")
        back = Window.partitionBy("metric_pos").orderBy(F.desc("period"))
        ranked = self.periods.select(
            "metric_pos",
            "granularity",
            *_SETTINGS,
            F.col("period").alias("current_period"),
            F.col("value").alias("current_value"),
            F.col("n").alias("current_n"),
            F.lag("period").over(w).alias("previous_period"),
            F.lag("value").over(w).alias("previous_value"),
            F.lag("n").over(w).alias("previous_n"),
            F.count("*").over(Window.partitionBy("metric_pos")).alias("period_count"),
            F.row_number().over(back).alias("_back"),
        )
        return ranked.where(F.col("_back") == 1).drop("_back")

    @cached_property
    def _eligible_periods(self) -> DataFrame:
        w = Window.partitionBy("metric_pos").orderBy("period")
        return (
            self.periods.where(F.col("n") >= MIN_PERIOD_RECORDS)
            .withColumn("_x", F.row_number().over(w) - 1)
            .withColumn("_count", F.count("*").over(Window.partitionBy("metric_pos")))
        )

    # ---------------------------------------------------------------- whole table

    def snapshot(self) -> DataFrame:
        rows = self.totals.where(F.col("value").isNotNull())
        target, value = F.col("target"), F.col("value")
        scoped = target.isNotNull() & (F.col("target_scope") == "dataset")
        gap = F.when(scoped, clean(value - target))
        meets = F.when(scoped, _meets(value, target, F.col("kpi_direction")))
        excluded = F.col("n_rows") - F.col("n")
        complete = 1 - F.least(F.lit(1.0), F.try_divide(excluded, F.col("n_rows")))
        impact = F.when(
            gap.isNotNull(),
            F.abs(gap) / F.greatest(F.abs(target), F.abs(value), F.lit(1.0)),
        ).otherwise(0.2 + 0.2 * complete)
        return rows.select(
            "metric_pos",
            "metric_id",
            "metric",
            value.alias("current_value"),
            "aggregation",
            "display_format",
            F.col("n").alias("valid_record_count"),
            excluded.alias("excluded_record_count"),
            F.col("n_rows").alias("total_record_count"),
            "target_scope",
            "numerator",
            "denominator",
            "numerator_record_count",
            "denominator_record_count",
            "target",
            "kpi_direction",
            gap.alias("gap_to_target"),
            meets.alias("meets_target"),
            F.col("n").alias("record_count"),
            count_confidence(F.col("n")).alias("confidence"),
            impact.alias("impact"),
        )

    def capabilities(self) -> DataFrame:
        """Which analyses apply to each KPI and why others do not."""
        date = self.registry.date_column is not None
        categories = bool(self.categories)
        rows = []
        for i, kpi in enumerate(self.registry.kpis):
            additive = kpi.aggregation == "sum"
            yes, no = ["metric_snapshot"], []
            if date:
                yes += ["period_change", "period_baseline_comparison", "trend"]
            else:
                no.append(("temporal_analyses", "requires_confirmed_date_column"))
            if categories:
                yes += ["segment_ranking"] + (["cohort_period_comparison"] if date else [])
            else:
                no.append(("segment_analyses", "requires_confirmed_category_column"))
            if kpi.row_level:
                yes += ["iqr_anomaly_detection", "numeric_correlation"]
            else:
                no += [
                    (a, "requires_row_level_kpi_values")
                    for a in ("iqr_anomaly_detection", "numeric_correlation", "benchmark_breach")
                ]
            if additive:
                if categories:
                    yes += ["segment_share"] + (["segment_contribution"] if date else [])
            else:
                no.append(("segment_share", "requires_nonnegative_additive_sum_values"))
                no.append(("segment_contribution", "requires_additive_sum_metric"))
            if kpi.target is not None:
                scope = kpi.target_scope
                if scope != "row":
                    yes.append(f"{scope}_target_comparison")
                elif kpi.row_level:
                    yes.append("row_benchmark_breach")
            rows += [(i, kpi.metric_id, kpi.name, a, True, None) for a in yes]
            rows += [(i, kpi.metric_id, kpi.name, a, False, r) for a, r in no]
        return literal_frame(
            self.spark,
            rows,
            "metric_pos int, metric_id string, metric string, analysis string, "
            "applicable boolean, reason string",
        )

    def benchmark_breach(self) -> DataFrame:
        rows = self.totals.where(
            F.col("target").isNotNull()
            & (F.col("target_scope") == "row")
            & F.col("row_level")
            & (F.col("n") >= MIN_BENCHMARK_RECORDS)
        )
        share = clean(F.try_divide(F.col("breaches"), F.col("n")) * 100)
        return rows.select(
            "metric_pos",
            "metric_id",
            "metric",
            "target",
            "kpi_direction",
            F.when(F.col("kpi_direction") == "higher", "value < target")
            .otherwise("value > target")
            .alias("breach_condition"),
            F.col("breaches").alias("breach_count"),
            (F.col("n") - F.col("breaches")).alias("non_breach_count"),
            share.alias("breach_percentage"),
            F.col("n").alias("record_count"),
            count_confidence(F.col("n")).alias("confidence"),
            (share / 100).alias("impact"),
        )

    # ---------------------------------------------------------------- time line

    def period_values(self) -> DataFrame:
        """KPI per period, whatever the record count."""
        return (
            self.periods
            .select("metric_id", "metric", "granularity", "period", "value", F.col("n").alias("record_count"))
        )

    def period_change(self) -> DataFrame:
        rows = self.latest.where(
            (F.col("period_count") >= 2)
            & (F.least("previous_n", "current_n") >= MIN_PERIOD_RECORDS)
            & F.col("previous_value").isNotNull()
            & F.col("current_value").isNotNull()
        )
        old, new = F.col("previous_value"), F.col("current_value")
        change = new - old
        percent = clean(percent_change(new, old))
        label = direction(change)
        low = F.least("previous_n", "current_n")
        return rows.select(
            "metric_pos",
            "metric_id",
            "metric",
            "aggregation",
            F.col("granularity").alias("period_granularity"),
            "previous_period",
            "previous_value",
            "current_period",
            "current_value",
            clean(change).alias("absolute_change"),
            percent.alias("percentage_change"),
            label.alias("direction"),
            favorable(label, F.col("kpi_direction")).alias("favorable"),
            (F.col("previous_n") + F.col("current_n")).alias("record_count"),
            count_confidence(low).alias("confidence"),
            self._change_impact(percent, change, new, old).alias("impact"),
        )

    @staticmethod
    def _change_impact(percent: Column, change: Column, new: Column, old: Column) -> Column:
        scale = F.greatest(F.abs(new), F.abs(old), F.lit(1.0))
        return F.coalesce(F.abs(percent) / 100, F.abs(change) / scale)

    @cached_property
    def _baseline(self) -> DataFrame:
        w = Window.partitionBy("metric_pos").orderBy("period")
        before = w.rowsBetween(-BASELINE_PERIODS, -1)
        around = w.rowsBetween(-BASELINE_PERIODS, 0)
        rows = self._eligible_periods.select(
            "metric_pos",
            "granularity",
            *_SETTINGS,
            F.col("period").alias("current_period"),
            F.col("value").alias("current_value"),
            F.col("_count").alias("eligible_periods"),
            "_x",
            F.avg("value").over(before).alias("baseline_value"),
            F.min("value").over(before).alias("baseline_minimum"),
            F.max("value").over(before).alias("baseline_maximum"),
            F.count("value").over(before).alias("_valued"),
            F.count("*").over(before).alias("baseline_period_count"),
            F.collect_list("period").over(before).alias("baseline_periods"),
            F.sum("n").over(around).alias("record_count"),
            F.min("n").over(around).alias("_low"),
        )
        return rows.where(F.col("_x") == F.col("eligible_periods") - 1)

    def period_baseline(self) -> DataFrame:
        rows = self._baseline.where(
            (F.col("eligible_periods") >= 3)
            & (F.col("_valued") == F.col("baseline_period_count"))
            & F.col("current_value").isNotNull()
        )
        new, old = F.col("current_value"), F.col("baseline_value")
        change = new - old
        percent = clean(F.when(~near_zero(old), percent_change(new, old)))
        label = direction(change)
        return rows.select(
            "metric_pos",
            "metric_id",
            "metric",
            "aggregation",
            F.col("granularity").alias("period_granularity"),
            F.lit("mean_of_prior_period_aggregates").alias("baseline_method"),
            "baseline_periods",
            "baseline_period_count",
            clean(old).alias("baseline_value"),
            "baseline_minimum",
            "baseline_maximum",
            "current_period",
            "current_value",
            clean(change).alias("absolute_change"),
            percent.alias("percentage_change"),
            label.alias("direction"),
            favorable(label, F.col("kpi_direction")).alias("favorable"),
            "record_count",
            count_confidence(F.col("_low")).alias("confidence"),
            self._change_impact(percent, change, new, old).alias("impact"),
        )

    @cached_property
    def _trend(self) -> DataFrame:
        x, y = F.col("_x").cast("double"), F.col("value")
        return self._eligible_periods.groupBy("metric_pos", "granularity", *_SETTINGS).agg(
            F.count("*").alias("eligible_periods"),
            F.count("value").alias("_valued"),
            F.sum("n").alias("record_count"),
            F.covar_pop(x, y).alias("_xy"),
            F.var_pop(x).alias("_xx"),
            F.var_pop(y).alias("_yy"),
            F.sort_array(F.collect_list("period")).alias("periods"),
        )

    def trend(self) -> DataFrame:
        rows = self._trend.where(
            (F.col("eligible_periods") >= MIN_TREND_PERIODS)
            & (F.col("_valued") == F.col("eligible_periods"))
        )
        slope = F.try_divide(F.col("_xy"), F.col("_xx"))
        fit = F.coalesce(
            F.try_divide(F.col("_xy") * F.col("_xy"), F.col("_xx") * F.col("_yy")), F.lit(0.0)
        )
        label = direction(slope)
        return rows.select(
            "metric_pos",
            "metric_id",
            "metric",
            "aggregation",
            F.col("granularity").alias("period_granularity"),
            label.alias("direction"),
            clean(slope).alias("slope_per_period"),
            clean(fit).alias("r_squared"),
            favorable(label, F.col("kpi_direction")).alias("favorable"),
            F.col("eligible_periods").alias("period_count"),
            "periods",
            "record_count",
            count_confidence(F.col("record_count")).alias("confidence"),
            F.least(F.lit(1.0), F.abs(fit)).alias("impact"),
        )

    def period_target_rows(self) -> DataFrame:
        """Every eligible period against a per-period target."""
        rows = self._eligible_periods.where(
            F.col("target").isNotNull()
            & (F.col("target_scope") == "period")
            & F.col("value").isNotNull()
        )
        meets = _meets(F.col("value"), F.col("target"), F.col("kpi_direction"))
        return rows.select(
            "metric_pos",
            "metric_id",
            "metric",
            "granularity",
            "kpi_direction",
            "period",
            "value",
            "target",
            clean(F.col("value") - F.col("target")).alias("gap_to_target"),
            meets.alias("meets_target"),
            F.col("n").alias("record_count"),
        )

    def period_target(self) -> DataFrame:
        grouped = self.period_target_rows().groupBy(
            "metric_pos", "metric_id", "metric", "granularity", "kpi_direction", "target"
        ).agg(
            F.max("period").alias("current_period"),
            F.max_by("value", "period").alias("current_value"),
            F.max_by("gap_to_target", "period").alias("current_gap_to_target"),
            F.max_by("meets_target", "period").alias("current_meets_target"),
            F.count_if(~F.col("meets_target")).alias("missed_period_count"),
            F.count("*").alias("eligible_period_count"),
            F.sum("record_count").alias("record_count"),
            F.min("record_count").alias("_low"),
        )
        scale = F.greatest(F.abs("target"), F.abs("current_value"), F.lit(1.0))
        return grouped.select(
            "*",
            count_confidence(F.col("_low")).alias("confidence"),
            (F.abs("current_gap_to_target") / scale).alias("impact"),
        ).drop("_low")

    # ---------------------------------------------------------------- segments

    @staticmethod
    def _label_order() -> list[Column]:
        return [F.lower("segment"), F.col("segment")]

    def segment_ranking_rows(self) -> DataFrame:
        """Segments with enough records, best value first."""
        order = Window.partitionBy(*_KEY).orderBy(F.desc("value"), *self._label_order())
        whole = Window.partitionBy(*_KEY)
        return (
            self.segments.where(
                (F.col("n") >= MIN_SEGMENT_RECORDS) & F.col("value").isNotNull()
            )
            .withColumn("position", F.row_number().over(order))
            .withColumn("segment_count", F.count("*").over(whole))
            .where(F.col("segment_count") >= 2)
            .select(
                *_KEY,
                "metric_id",
                "metric",
                "aggregation",
                "category_column",
                "position",
                "segment_count",
                "segment",
                "value",
                F.col("n").alias("record_count"),
            )
        )

    def segment_ranking(self) -> DataFrame:
        last = F.col("position") == F.col("segment_count")
        size = F.abs("value")
        spread = (F.max(size) - F.min(size)) / F.greatest(F.max(size), F.lit(1.0))
        return self.segment_ranking_rows().groupBy(
            *_KEY, "metric_id", "metric", "aggregation", "category_column", "segment_count"
        ).agg(
            F.max(F.when(F.col("position") == 1, F.col("segment"))).alias("top_segment"),
            F.max(F.when(F.col("position") == 1, F.col("value"))).alias("top_value"),
            F.max(F.when(last, F.col("segment"))).alias("bottom_segment"),
            F.max(F.when(last, F.col("value"))).alias("bottom_value"),
            F.sum("record_count").alias("record_count"),
            count_confidence(F.sum("record_count")).alias("confidence"),
            spread.alias("impact"),
        )

    @cached_property
    def _shares(self) -> DataFrame:
        whole = Window.partitionBy(*_KEY)
        unnamed = F.when(F.col("segment").isNull(), F.col("n_rows"))
        rows = self.groups.where((F.col("level") == "segment") & F.col("additive"))
        return (
            rows.withColumn(
                "missing_category_count", F.coalesce(F.sum(unnamed).over(whole), F.lit(0))
            )
            .where(
                F.col("segment").isNotNull() & (F.col("n") > 0) & F.col("value").isNotNull()
            )
            .withColumn("total_value", F.sum("value").over(whole))
            .withColumn("lowest", F.min("value").over(whole))
            .withColumn("segment_count", F.count("*").over(whole))
            .where(F.col("segment_count") >= 2)
        )

    def segment_share_rows(self) -> DataFrame:
        """Share of each named segment; the last one absorbs the rounding residue."""
        order = Window.partitionBy(*_KEY).orderBy(F.desc("value"), *self._label_order())
        whole = Window.partitionBy(*_KEY)
        raw = clean(F.try_divide(F.col("value"), F.col("total_value")) * 100)
        shares = (
            self._shares.where((F.col("total_value") > 0) & (F.col("lowest") >= 0))
            .withColumn("position", F.row_number().over(order))
            .withColumn("_raw", raw)
            .withColumn("_rest", 100 - F.sum("_raw").over(whole))
        )
        last = F.col("position") == F.col("segment_count")
        return shares.select(
            *_KEY,
            "metric_id",
            "metric",
            "category_column",
            "position",
            "segment_count",
            "segment",
            "value",
            F.when(last, clean(F.col("_raw") + F.col("_rest")))
            .otherwise(F.col("_raw"))
            .alias("share_percentage"),
            clean(F.col("total_value")).alias("total_value"),
            "missing_category_count",
            F.col("n").alias("record_count"),
        )

    def segment_share(self) -> DataFrame:
        last = F.col("position") == F.col("segment_count")
        return self.segment_share_rows().groupBy(
            *_KEY,
            "metric_id",
            "metric",
            "category_column",
            "segment_count",
            "total_value",
            "missing_category_count",
        ).agg(
            F.max(F.when(F.col("position") == 1, F.col("segment"))).alias("top_segment"),
            F.max(F.when(F.col("position") == 1, F.col("share_percentage"))).alias("top_share"),
            F.max(F.when(last, F.col("segment"))).alias("bottom_segment"),
            F.max(F.when(last, F.col("share_percentage"))).alias("bottom_share"),
            F.sum("record_count").alias("record_count"),
            count_confidence(F.sum("record_count")).alias("confidence"),
            (F.max("share_percentage") / 100).alias("impact"),
        )

    def segment_benchmark_rows(self) -> DataFrame:
        """Row-target attainment inside each segment, worst first."""
        order = Window.partitionBy(*_KEY).orderBy(
            F.desc("breach_percentage"), *self._label_order()
        )
        mean = F.try_divide(F.col("row_sum"), F.col("n"))
        return (
            self.segments
            .where(
                F.col("target").isNotNull()
                & (F.col("target_scope") == "row")
                & F.col("row_level")
                & (F.col("n") >= MIN_SEGMENT_RECORDS)
            )
            .withColumn("segment_count", F.count("*").over(Window.partitionBy(*_KEY)))
            .where(F.col("segment_count") >= 2)
            .withColumn(
                "breach_percentage", clean(F.try_divide(F.col("breaches"), F.col("n")) * 100)
            )
            .select(
                *_KEY,
                "metric_id",
                "metric",
                "category_column",
                F.row_number().over(order).alias("position"),
                "segment_count",
                "segment",
                "target",
                "kpi_direction",
                clean(mean).alias("average_value"),
                clean(mean - F.col("target")).alias("average_gap_to_target"),
                F.col("breaches").alias("breach_count"),
                F.col("n").alias("record_count"),
                "breach_percentage",
            )
        )

    def segment_benchmark(self) -> DataFrame:
        first = F.col("position") == 1
        last = F.col("position") == F.col("segment_count")
        return self.segment_benchmark_rows().groupBy(
            *_KEY,
            "metric_id",
            "metric",
            "category_column",
            "segment_count",
            "target",
            "kpi_direction",
        ).agg(
            F.max(F.when(first, F.col("segment"))).alias("worst_segment"),
            F.max(F.when(first, F.col("breach_percentage"))).alias("worst_breach_percentage"),
            F.max(F.when(last, F.col("segment"))).alias("best_segment"),
            F.max(F.when(last, F.col("breach_percentage"))).alias("best_breach_percentage"),
            F.sum("record_count").alias("record_count"),
            count_confidence(F.min("record_count")).alias("confidence"),
            (F.max("breach_percentage") / 100).alias("impact"),
        )

    @cached_property
    def _segment_targets(self) -> DataFrame:
        return (
            self.segments
            .where(
                F.col("target").isNotNull()
                & (F.col("target_scope") == "segment")
                & (F.col("n") >= MIN_SEGMENT_RECORDS)
                & F.col("value").isNotNull()
            )
            .withColumn("segment_count", F.count("*").over(Window.partitionBy(*_KEY)))
        )

    def segment_target_rows(self) -> DataFrame:
        """Segment aggregates against a per-segment target, largest miss first."""
        higher = F.col("kpi_direction") == "higher"
        value, target = F.col("value"), F.col("target")
        miss = F.greatest(F.when(higher, target - value).otherwise(value - target), F.lit(0.0))
        signed = F.when(higher, value).otherwise(-value)
        order = Window.partitionBy(*_KEY).orderBy(miss.desc(), signed, *self._label_order())
        return self._segment_targets.where(F.col("segment_count") >= 2).select(
            *_KEY,
            "metric_id",
            "metric",
            "category_column",
            F.row_number().over(order).alias("position"),
            "segment_count",
            "segment",
            "value",
            "target",
            "kpi_direction",
            clean(value - target).alias("gap_to_target"),
            _meets(value, target, F.col("kpi_direction")).alias("meets_target"),
            F.col("n").alias("record_count"),
        )

    def segment_target(self) -> DataFrame:
        first = F.col("position") == 1
        by = F.struct("value", F.lower("segment"), "segment")
        best = F.when(F.first("kpi_direction") == "higher", F.max_by("segment", by)).otherwise(
            F.min_by("segment", by)
        )
        scale = F.greatest(
            F.abs("target"), F.abs(F.col("worst_value")), F.lit(1.0)
        )
        return (
            self.segment_target_rows()
            .groupBy(
                *_KEY,
                "metric_id",
                "metric",
                "category_column",
                "target",
                "kpi_direction",
                F.col("segment_count").alias("eligible_segment_count"),
            )
            .agg(
                F.max(F.when(first, F.col("segment"))).alias("worst_segment"),
                F.max(F.when(first, F.col("value"))).alias("worst_value"),
                F.max(F.when(first, F.col("gap_to_target"))).alias("worst_gap_to_target"),
                best.alias("best_segment"),
                F.count_if(~F.col("meets_target")).alias("missed_segment_count"),
                F.sum("record_count").alias("record_count"),
                count_confidence(F.min("record_count")).alias("confidence"),
            )
            .withColumn("impact", F.abs("worst_gap_to_target") / scale)
        )

    # ---------------------------------------------------------------- cohorts

    @cached_property
    def _pairs(self) -> DataFrame:
        """Each segment in the last two periods; an absent side stays NULL."""
        last_two = F.broadcast(
            self.latest.where(F.col("period_count") >= 2).select(
                "metric_pos", "previous_period", "current_period", "previous_n", "current_n"
            )
        )
        rows = self.groups.where(
            (F.col("level") == "segment_period")
            & F.col("segment").isNotNull()
            & (F.col("n") > 0)
        ).join(last_two, "metric_pos")
        old = F.col("period") == F.col("previous_period")
        new = F.col("period") == F.col("current_period")
        return (
            rows.where(old | new)
            .groupBy(
                *_KEY,
                *_SETTINGS,
                "category_column",
                "granularity",
                "previous_period",
                "current_period",
                "previous_n",
                "current_n",
                "segment",
            )
            .agg(
                F.max(F.when(old, F.col("value"))).alias("previous_value"),
                F.max(F.when(new, F.col("value"))).alias("current_value"),
                F.coalesce(F.max(F.when(old, F.col("n"))), F.lit(0)).alias("previous_record_count"),
                F.coalesce(F.max(F.when(new, F.col("n"))), F.lit(0)).alias("current_record_count"),
            )
        )

    @cached_property
    def _cohorts(self) -> DataFrame:
        whole = Window.partitionBy(*_KEY)
        low = F.least("previous_record_count", "current_record_count")
        eligible = low >= MIN_SEGMENT_RECORDS
        usable = (
            eligible & F.col("previous_value").isNotNull() & F.col("current_value").isNotNull()
        )
        return (
            self._pairs.withColumn("_usable", usable)
            .withColumn("eligible_cohorts", F.count_if(eligible).over(whole))
            .withColumn("cohort_count", F.count_if("_usable").over(whole))
            .withColumn("_seen", F.count("*").over(whole))
        )

    def cohort_rows(self) -> DataFrame:
        """Like-for-like cohorts in the last two periods, largest movement first."""
        new, old = F.col("current_value"), F.col("previous_value")
        change = new - old
        percent = clean(F.when(~near_zero(old), percent_change(new, old)))
        magnitude = F.coalesce(
            F.abs(percent), F.abs(change) / F.greatest(F.abs(new), F.lit(1.0)) * 100
        )
        sign = F.when(change >= 0, 1.0).otherwise(-1.0)
        sign = F.when(F.col("kpi_direction") == "lower", -sign).otherwise(sign)
        label = direction(change)
        order = Window.partitionBy(*_KEY).orderBy(F.desc(F.abs("score")), *self._label_order())
        return (
            self._cohorts.where(F.col("_usable") & (F.col("cohort_count") >= 2))
            .withColumn("score", magnitude * sign)
            .select(
                *_KEY,
                "metric_id",
                "metric",
                "aggregation",
                "category_column",
                "granularity",
                "previous_period",
                "current_period",
                F.row_number().over(order).alias("position"),
                "segment",
                "previous_value",
                "current_value",
                clean(change).alias("absolute_change"),
                percent.alias("percentage_change"),
                label.alias("direction"),
                favorable(label, F.col("kpi_direction")).alias("favorable"),
                "previous_record_count",
                "current_record_count",
                "score",
                "cohort_count",
                (F.col("_seen") - F.col("cohort_count")).alias("excluded_cohort_count"),
            )
        )

    def cohort_comparison(self) -> DataFrame:
        by = F.struct("score", F.lower("segment"), "segment")
        scale = F.greatest(F.abs("previous_value"), F.abs("current_value"), F.lit(1.0))
        impact = F.coalesce(
            F.max(F.abs("percentage_change")) / 100, F.max(F.abs("absolute_change") / scale)
        )
        low = F.min(F.least("previous_record_count", "current_record_count"))
        return self.cohort_rows().groupBy(
            *_KEY,
            "metric_id",
            "metric",
            "aggregation",
            "category_column",
            F.col("granularity").alias("period_granularity"),
            "previous_period",
            "current_period",
            "cohort_count",
            "excluded_cohort_count",
        ).agg(
            F.max_by("segment", by).alias("best_cohort"),
            F.max_by("percentage_change", by).alias("best_percentage_change"),
            F.min_by("segment", by).alias("worst_cohort"),
            F.min_by("percentage_change", by).alias("worst_percentage_change"),
            F.sum(F.col("previous_record_count") + F.col("current_record_count")).alias(
                "record_count"
            ),
            count_confidence(low).alias("confidence"),
            impact.alias("impact"),
        )

    def contribution_rows(self) -> DataFrame:
        """Each segment's part of the total change; absent segments count as zero."""
        whole = Window.partitionBy(*_KEY)
        alphabetical = Window.partitionBy(*_KEY).orderBy(
            F.lower("segment").desc(), F.desc("segment")
        )
        old = F.coalesce("previous_value", F.lit(0.0))
        new = F.coalesce("current_value", F.lit(0.0))
        rows = (
            self._pairs.where(
                F.col("additive")
                & (F.least("previous_n", "current_n") >= MIN_PERIOD_RECORDS)
                & (F.col("previous_value").isNotNull() | F.col("current_value").isNotNull())
            )
            .withColumn("previous_value", old)
            .withColumn("current_value", new)
            .withColumn("_change", F.col("current_value") - F.col("previous_value"))
            .withColumn("overall_change", F.sum("_change").over(whole))
            .withColumn("segment_count", F.count("*").over(whole))
            .where(F.col("segment_count") >= 2)
            .withColumn("absolute_change", clean(F.col("_change")))
            .withColumn(
                "_raw",
                F.when(
                    ~near_zero(F.col("overall_change")),
                    clean(F.col("absolute_change") / F.col("overall_change") * 100),
                ),
            )
            .withColumn("_rest", 100 - F.sum("_raw").over(whole))
            .withColumn("_back", F.row_number().over(alphabetical))
        )
        order = Window.partitionBy(*_KEY).orderBy(
            F.desc("absolute_change"), *self._label_order()
        )
        share = F.when(F.col("_back") == 1, clean(F.col("_raw") + F.col("_rest"))).otherwise(
            F.col("_raw")
        )
        return rows.select(
            *_KEY,
            "metric_id",
            "metric",
            "aggregation",
            "category_column",
            "previous_period",
            "current_period",
            F.row_number().over(order).alias("position"),
            "segment_count",
            "segment",
            "previous_value",
            "current_value",
            "absolute_change",
            share.alias("contribution_percentage"),
            clean(F.col("overall_change")).alias("overall_change"),
            "previous_record_count",
            "current_record_count",
            "previous_n",
            "current_n",
        )

    def segment_contribution(self) -> DataFrame:
        calculated = F.max("contribution_percentage").isNotNull()
        first = F.col("position") == 1
        return (
            self.contribution_rows()
            .groupBy(
                *_KEY,
                "metric_id",
                "metric",
                "aggregation",
                "category_column",
                "previous_period",
                "current_period",
                "segment_count",
                "overall_change",
                "previous_n",
                "current_n",
            )
            .agg(
                F.when(calculated, "calculated")
                .otherwise("not_calculated_zero_overall_change")
                .alias("percentage_status"),
                F.when(calculated, F.lit(100.0)).alias("reconciled_percentage_total"),
                F.max(F.when(first, F.col("segment"))).alias("top_segment"),
                F.max(F.when(first, F.col("absolute_change"))).alias("top_change"),
                F.coalesce(F.max(F.abs("contribution_percentage")) / 100, F.lit(0.0)).alias(
                    "impact"
                ),
            )
            .withColumn("record_count", F.col("previous_n") + F.col("current_n"))
            .withColumn("confidence", count_confidence(F.least("previous_n", "current_n")))
            .drop("previous_n", "current_n")
        )

    # ---------------------------------------------------------------- rows

    def row_values(self) -> DataFrame:
        """(row key, metric, value) for every valid row-level KPI value."""
        parts = [
            F.struct(F.lit(i).alias("metric_pos"), m.row_value.alias("value"))
            for i, m in enumerate(self.measures)
            if m.kpi.row_level
        ]
        if not parts:
            return literal_frame(self.spark, [], "metric_pos int, value double, row_key string")
        key = self.table.row_key
        keyed = F.col(key).alias("row_key") if key else F.lit(None).cast("string").alias("row_key")
        return self.table.df.select(keyed, F.inline(F.array(*parts))).where(
            F.col("value").isNotNull()
        )

    @cached_property
    def bounds(self) -> DataFrame:
        """Tukey fences per row-level KPI: at most five rows."""
        q = exact_quantiles(
            self.row_values(), ["metric_pos"], F.col("value"), [0.25, 0.75], few_groups=True
        )
        low, high = F.col("quantiles")[0], F.col("quantiles")[1]
        fences = q.where(F.col("value_count") >= MIN_ANOMALY_RECORDS).select(
            "metric_pos",
            low.alias("q1"),
            high.alias("q3"),
            (high - low).alias("iqr"),
            (low - 1.5 * (high - low)).alias("lower_bound"),
            (high + 1.5 * (high - low)).alias("upper_bound"),
            F.col("value_count").alias("record_count"),
        )
        return F.broadcast(checkpointed(fences))

    def outliers(self) -> DataFrame:
        """Rows beyond the fences; stays distributed, whatever their number."""
        value = F.col("value")
        return (
            self.row_values()
            .join(self.bounds, "metric_pos")
            .where((value < F.col("lower_bound")) | (value > F.col("upper_bound")))
            .join(self.meta.select("metric_pos", "metric_id", "metric"), "metric_pos")
            .select("metric_pos", "metric_id", "metric", "row_key", clean(value).alias("value"))
        )

    def anomalies(self) -> DataFrame:
        counts = self.outliers().groupBy("metric_pos").agg(F.count("*").alias("_c"))
        rows = self.bounds.join(F.broadcast(counts), "metric_pos", "left").join(
            self.meta, "metric_pos"
        )
        count = F.coalesce("_c", F.lit(0))
        return rows.select(
            "metric_pos",
            "metric_id",
            "metric",
            F.lit("Tukey 1.5 IQR").alias("method"),
            *[clean(F.col(c)).alias(c) for c in ("q1", "q3", "iqr", "lower_bound", "upper_bound")],
            count.alias("anomaly_count"),
            "record_count",
            count_confidence(F.col("record_count")).alias("confidence"),
            F.least(F.lit(1.0), count / F.greatest("record_count", F.lit(1))).alias("impact"),
        )

    @cached_property
    def _correlation_stats(self) -> DataFrame:
        """Pairwise-complete statistics of every KPI and numeric column.

        Each row is spread over its numeric columns and grouped by column, so the
        number of aggregates depends on the KPIs (at most five) and not on the columns.
        ``regr_r2`` gives the size of the coefficient without the division by zero that
        ``corr`` raises on constant input, ``covar_pop`` its sign.
        """
        metrics = [(i, m) for i, m in enumerate(self.measures) if m.kpi.row_level]
        if not metrics or not self.numeric_columns:
            return literal_frame(
                self.spark,
                [],
                "metric_pos int, column_pos int, associated_metric string, pairs long, "
                "r2 double, covariance double",
            )
        long = self._values_by_column(metrics)
        aggregates = [F.min("y").alias("lo"), F.max("y").alias("hi")]
        for i, _ in metrics:
            x, y = F.col(f"x{i}"), F.col("y")
            aggregates += [
                F.regr_count(y, x).alias(f"n{i}"),
                F.regr_r2(y, x).alias(f"r{i}"),
                F.covar_pop(x, y).alias(f"c{i}"),
            ]
        wide = checkpointed(long.groupBy("column_pos", "associated_metric").agg(*aggregates))
        per_metric = F.array(
            *[
                F.struct(
                    F.lit(i).alias("metric_pos"),
                    F.lit(m.kpi.name).alias("_name"),
                    F.col(f"n{i}").alias("pairs"),
                    F.col(f"r{i}").alias("r2"),
                    F.col(f"c{i}").alias("covariance"),
                )
                for i, m in metrics
            ]
        )
        varying = wide.where(F.col("lo") < F.col("hi"))
        out = varying.select("column_pos", "associated_metric", F.inline(per_metric))
        return out.where(F.col("associated_metric") != F.col("_name")).drop("_name")

    def correlations(self) -> DataFrame:
        size = F.sqrt(F.least(F.lit(1.0), F.col("r2")))
        # A constant side shows as no fit, or as a perfect fit without covariance.
        constant = (F.col("covariance") == 0) & (F.col("r2") == 1)
        r = F.when(~constant, F.signum("covariance") * size)
        rows = self._correlation_stats.withColumn("coefficient", clean(r)).where(
            (F.col("pairs") >= MIN_CORRELATION_PAIRS) & r.isNotNull()
        )
        return rows.join(self.meta, "metric_pos").select(
            "metric_pos",
            "column_pos",
            "metric_id",
            "metric",
            "associated_metric",
            "coefficient",
            direction(F.col("coefficient")).alias("direction"),
            correlation_strength(F.col("coefficient")).alias("strength"),
            F.lit("association").alias("relationship_label"),
            F.col("pairs").alias("record_count"),
            count_confidence(F.col("pairs")).alias("confidence"),
            F.abs("coefficient").alias("impact"),
        )

    def correlation_sums(self) -> DataFrame:
        """Sufficient statistics behind each coefficient, for re-checking it."""
        metrics = [(i, m) for i, m in enumerate(self.measures) if m.kpi.row_level]
        if not metrics or not self.numeric_columns:
            names = ("sum_x", "sum_y", "sum_x_squared", "sum_y_squared", "sum_xy")
            doubles = ", ".join(f"{n} double" for n in names)
            return literal_frame(
                self.spark, [], f"metric string, associated_metric string, pair_count long, {doubles}"
            )
        aggregates, per_metric = [], []
        for i, m in metrics:
            both = F.col(f"x{i}").isNotNull() & F.col("y").isNotNull()
            x, y = F.when(both, F.col(f"x{i}")), F.when(both, F.col("y"))
            sums = {
                "pair_count": F.count(x),
                "sum_x": F.sum(x),
                "sum_y": F.sum(y),
                "sum_x_squared": F.sum(x * x),
                "sum_y_squared": F.sum(y * y),
                "sum_xy": F.sum(x * y),
            }
            aggregates += [c.alias(f"{name}{i}") for name, c in sums.items()]
            per_metric.append(
                F.struct(
                    F.lit(m.kpi.name).alias("metric"),
                    "associated_metric",
                    *[F.col(f"{name}{i}").alias(name) for name in sums],
                )
            )
        wide = self._values_by_column(metrics).groupBy("column_pos", "associated_metric").agg(*aggregates)
        return wide.select(F.inline(F.array(*per_metric))).where(
            (F.col("pair_count") > 0) & (F.col("associated_metric") != F.col("metric"))
        )

    def _values_by_column(self, metrics: Sequence[tuple[int, Measure]]) -> DataFrame:
        """Every row once for each numeric column: its number ``y`` and the KPI values ``x0``, ``x1``, ...

        A KPI value is computed once a row, not once a pair.
        """
        columns = [
            F.struct(
                F.lit(j).alias("column_pos"),
                F.lit(name).alias("associated_metric"),
                self.table.num(name).alias("y"),
            )
            for j, name in enumerate(self.numeric_columns)
        ]
        return self.table.df.select(
            *[m.row_value.alias(f"x{i}") for i, m in metrics], F.inline(F.array(*columns))
        )
