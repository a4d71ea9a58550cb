"""One ``insights`` frame from all analyses, with diagnostics in the same shape.

Each typed analysis frame is packed into the common columns ``type``, ``observation``
(JSON of the typed columns), ``source_columns``, ``filters``, ``record_count``,
``confidence`` and ``impact``.  Long lists (rankings, shares, outliers) are not folded
into the JSON; they stay rows of :func:`support_rows`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.frames import literal_frame, union_all
from metricloom.operators.battery import (
    MIN_ANOMALY_RECORDS,
    MIN_BENCHMARK_RECORDS,
    MIN_CORRELATION_PAIRS,
    MIN_GENERAL_RECORDS,
    MIN_PERIOD_RECORDS,
    MIN_SEGMENT_RECORDS,
    MIN_TREND_PERIODS,
    Battery,
)
from metricloom.session import checkpointed

# Emission order inside one KPI: block, then category, then analysis.
_GENERAL, _CATEGORY, _ROWS, _LAST = 0, 1, 2, 3
_TEMPORAL_ANALYSES = (
    "period_change",
    "period_baseline_comparison",
    "trend",
    "cohort_period_comparison",
    "segment_contribution",
)
_HIDDEN = {
    "metric_pos",
    "category_pos",
    "column_pos",
    "metric_id",
    "metric",
    "record_count",
    "confidence",
    "impact",
}


def issues(battery: Battery) -> DataFrame:
    """Unmet data requirements: one row per KPI and analysis that could not run."""
    b = battery
    meta = b.meta

    def issue(frame: DataFrame, order: int, analysis: Column, available: Column, required, unit):
        category = F.col("category_pos") if "category_pos" in frame.columns else F.lit(-1)
        column = F.col("column_pos") if "column_pos" in frame.columns else F.lit(-1)
        return frame.select(
            "metric_pos",
            F.lit(order).alias("issue_order"),
            category.cast("int").alias("category_pos"),
            column.cast("int").alias("column_pos"),
            analysis.alias("analysis"),
            available.cast("long").alias("available"),
            F.lit(required).cast("long").alias("required"),
            F.lit(unit).alias("unit"),
        )

    totals = b.totals.drop("category_pos")
    parts = [
        issue(
            totals.where(F.col("value").isNull()),
            0, F.lit("metric_snapshot"), F.col("n"), 1, "valid_records",
        ),
        issue(
            totals.where(F.col("n_rows") < MIN_GENERAL_RECORDS),
            1, F.lit("dataset_size"), F.col("n_rows"), MIN_GENERAL_RECORDS, "valid_records",
        ),
    ]
    if b.registry.date_column is not None:
        low = F.least("previous_n", "current_n")
        eligible = b._eligible_periods.groupBy("metric_pos").agg(
            F.count("*").alias("_e"), F.count("value").alias("_valued")
        )
        counted = b._timed.join(eligible, "metric_pos", "left").fillna(0, ["_e", "_valued"])
        per_period = counted.where(
            F.col("target").isNotNull()
            & (F.col("target_scope") == "period")
            & (F.col("_valued") == 0)
        )
        parts += [
            issue(
                b.latest.where(F.col("period_count") < 2),
                2, F.lit("period_change"), F.col("period_count"), 2, "eligible_periods",
            ),
            issue(
                b.latest.where((F.col("period_count") >= 2) & (low < MIN_PERIOD_RECORDS)),
                2, F.lit("period_change"), low, MIN_PERIOD_RECORDS, "valid_records_per_period",
            ),
            issue(
                counted.where(F.col("_e") < 3),
                3, F.lit("period_baseline_comparison"),
                F.greatest(F.col("_e") - 1, F.lit(0)), 2, "prior_eligible_periods",
            ),
            issue(
                counted.where(F.col("_e") < MIN_TREND_PERIODS),
                4, F.lit("trend"), F.col("_e"), MIN_TREND_PERIODS, "eligible_periods",
            ),
            issue(
                per_period,
                5, F.lit("period_target_comparison"), F.lit(0), 1, "eligible_periods",
            ),
        ]
    if b.categories:
        enough = F.col("n") >= MIN_SEGMENT_RECORDS
        counted = b.segments.groupBy("metric_pos", "category_pos").agg(
            F.count_if(enough).alias("_e"),
            F.count_if(enough & F.col("value").isNotNull()).alias("_valued"),
        )
        base = b.metric_categories.join(
            counted, ["metric_pos", "category_pos"], "left"
        ).fillna(0, ["_e", "_valued"])
        named = lambda prefix: F.concat(F.lit(prefix + ":"), "category_column")
        available = F.when(F.col("_e") < 2, F.col("_e")).otherwise(F.col("_valued"))
        parts.append(
            issue(
                base.where(available < 2),
                6, named("segment_ranking"), available, 2, "eligible_segments",
            )
        )
        scoped = base.join(meta, "metric_pos").where(
            F.col("target").isNotNull()
            & (F.col("target_scope") == "segment")
            & (F.col("_valued") < 2)
        )
        parts.append(
            issue(
                scoped, 7, named("segment_target_comparison"), F.col("_valued"), 2,
                "eligible_segments",
            )
        )
        if b.registry.date_column is not None:
            cohorts = b._cohorts.groupBy("metric_pos", "category_pos").agg(
                F.max("eligible_cohorts").alias("_e"), F.max("cohort_count").alias("_valued")
            )
            two = b.latest.where(F.col("period_count") >= 2).select("metric_pos")
            base = (
                b.metric_categories.join(two, "metric_pos")
                .join(cohorts, ["metric_pos", "category_pos"], "left")
                .fillna(0, ["_e", "_valued"])
            )
            parts.append(
                issue(
                    base.where(available < 2),
                    8, named("cohort_period_comparison"), available, 2, "eligible_cohorts",
                )
            )
    if any(m.kpi.row_level for m in b.measures):
        rows = totals.where(F.col("row_level"))
        parts += [
            issue(
                rows.where(F.col("n") < MIN_ANOMALY_RECORDS),
                9, F.lit("iqr_anomaly_detection"), F.col("n"), MIN_ANOMALY_RECORDS,
                "valid_row_values",
            ),
            issue(
                b._correlation_stats.where(F.col("pairs") < MIN_CORRELATION_PAIRS),
                10, F.concat(F.lit("correlation:"), "associated_metric"), F.col("pairs"),
                MIN_CORRELATION_PAIRS, "valid_numeric_pairs",
            ),
            issue(
                rows.where(
                    F.col("target").isNotNull()
                    & (F.col("target_scope") == "row")
                    & (F.col("n") < MIN_BENCHMARK_RECORDS)
                ),
                11, F.lit("benchmark_breach"), F.col("n"), MIN_BENCHMARK_RECORDS,
                "valid_row_values",
            ),
        ]
    names = F.array(
        *[
            F.struct(F.lit(k.metric_id).alias("metric_id"), F.lit(k.name).alias("metric"))
            for k in b.registry.kpis
        ]
    )
    found = union_all(parts).withColumn("_k", F.element_at(names, F.col("metric_pos") + 1))
    return found.select("*", "_k.*").drop("_k")


def insufficient_warnings(battery: Battery) -> DataFrame:
    """One consolidated diagnostic per KPI; its issues are bounded by the analyses."""
    entry = F.struct(
        "issue_order", "category_pos", "column_pos", "analysis", "available", "required", "unit"
    )
    listed = F.transform(
        F.sort_array(F.collect_list(entry)),
        lambda e: F.struct(
            e["analysis"].alias("analysis"),
            e["available"].alias("available"),
            e["required"].alias("required"),
            e["unit"].alias("unit"),
        ),
    )
    return issues(battery).groupBy("metric_pos", "metric_id", "metric").agg(
        F.lit("analysis_requirements_not_met").alias("reason"),
        F.count("*").alias("issue_count"),
        listed.alias("issues"),
        F.max("available").alias("record_count"),
        F.lit("high").alias("confidence"),
        F.lit(0.1).alias("impact"),
    )


def skipped(battery: Battery) -> DataFrame:
    """Analyses whose preconditions failed, with the reason."""
    b = battery
    meta = b.meta
    out = []

    def skip(frame, block, order, reason: Column, analyses: Column, count: Column):
        category = F.col("category_pos") if "category_pos" in frame.columns else F.lit(-1)
        named = "category_column" if "category_column" in frame.columns else None
        return frame.select(
            "metric_pos",
            "metric_id",
            "metric",
            F.lit(block).alias("block"),
            F.lit(order).alias("analysis_pos"),
            category.cast("int").alias("category_pos"),
            (F.col(named) if named else F.lit(None).cast("string")).alias("category_column"),
            reason.alias("reason"),
            analyses.alias("analyses"),
            count.cast("long").alias("record_count"),
        )

    if b.registry.date_column is not None:
        status = F.col("status")
        period_target = F.when(
            F.col("target").isNotNull() & (F.col("target_scope") == "period"),
            F.array(F.lit("period_target_comparison")),
        ).otherwise(F.array().cast("array<string>"))
        lines = b.totals.drop("category_pos").where(
            status.isin("missing_dates", "unparseable_date", "no_dated_kpi_values")
        )
        out.append(
            skip(
                lines, _GENERAL, 2, status,
                F.concat(F.array(*[F.lit(a) for a in _TEMPORAL_ANALYSES]), period_target),
                F.when(status == "no_dated_kpi_values", 0).otherwise(F.col("n_rows")),
            )
        )
        undefined = F.lit("undefined_derived_aggregate")
        one = lambda name: F.array(F.lit(name))
        latest = b.latest.where(
            (F.col("period_count") >= 2)
            & (F.least("previous_n", "current_n") >= MIN_PERIOD_RECORDS)
            & (F.col("previous_value").isNull() | F.col("current_value").isNull())
        )
        out.append(
            skip(latest, _GENERAL, 3, undefined, one("period_change"),
                 F.col("previous_n") + F.col("current_n"))
        )
        base = b._baseline.where(
            (F.col("eligible_periods") >= 3)
            & (
                (F.col("_valued") < F.col("baseline_period_count"))
                | F.col("current_value").isNull()
            )
        )
        out.append(
            skip(base, _GENERAL, 4, undefined, one("period_baseline_comparison"),
                 F.col("record_count"))
        )
        trend = b._trend.where(
            (F.col("eligible_periods") >= MIN_TREND_PERIODS)
            & (F.col("_valued") < F.col("eligible_periods"))
        )
        out.append(skip(trend, _GENERAL, 5, undefined, one("trend"), F.col("record_count")))
    if b.categories:
        shares = (
            b._shares.where((F.col("total_value") <= 0) | (F.col("lowest") < 0))
            .groupBy("metric_pos", "category_pos", "metric_id", "metric", "category_column")
            .agg(F.sum("n").alias("_records"))
        )
        out.append(
            skip(
                shares, _CATEGORY, 2,
                F.lit("category_share_requires_nonnegative_additive_values"),
                F.array(F.concat(F.lit("segment_share:"), "category_column")),
                F.col("_records"),
            )
        )
    if not out:
        return literal_frame(
            b.spark,
            [],
            "metric_pos int, metric_id string, metric string, block int, analysis_pos int, "
            "category_pos int, category_column string, reason string, "
            "analyses array<string>, record_count long",
        )
    return union_all(out).withColumn("confidence", F.lit("high")).withColumn("impact", F.lit(0.0))


def _pack(
    battery: Battery,
    frame: DataFrame,
    kind: str,
    block: int,
    order: int | None,
    *,
    dated: bool = False,
    periods: Column | None = None,
) -> DataFrame:
    names = frame.columns
    category = F.col("category_column") if "category_column" in names else F.lit(None)
    first = [F.lit(battery.registry.date_column)] if dated else []
    first.append(category.cast("string"))
    last = [F.col("associated_metric")] if "associated_metric" in names else []
    own = F.array(*[F.array(*[F.lit(c) for c in m.kpi.source_columns]) for m in battery.measures])
    own = F.element_at(own, F.col("metric_pos") + 1)
    observed = [c for c in names if c not in _HIDDEN and c not in ("block", "analysis_pos")]
    columns = F.array_distinct(
        F.filter(
            F.concat(F.array(*first), own, F.array(*last).cast("array<string>")),
            lambda c: c.isNotNull(),
        )
    )
    periods = periods if periods is not None else F.array().cast("array<string>")
    return frame.select(
        "metric_pos",
        (F.col("block") if "block" in names else F.lit(block)).alias("block"),
        (F.col("category_pos") if "category_pos" in names else F.lit(-1))
        .cast("int")
        .alias("category_pos"),
        (F.col("analysis_pos") if order is None else F.lit(order)).alias("analysis_pos"),
        (F.col("column_pos") if "column_pos" in names else F.lit(-1))
        .cast("int")
        .alias("column_pos"),
        "metric_id",
        "metric",
        F.lit(kind).alias("type"),
        F.to_json(F.struct(*observed)).alias("observation"),
        columns.alias("source_columns"),
        periods.alias("periods"),
        F.col("record_count").cast("long").alias("record_count"),
        "confidence",
        F.col("impact").cast("double").alias("impact"),
    )


def missing_data(profile: DataFrame) -> DataFrame:
    """The data-set completeness diagnostic from a profile frame, at most one row."""
    affected = profile.where(F.col("missing_count") > 0)
    return affected.agg(
        F.count("*").alias("affected_column_count"),
        F.max("missing_percentage").alias("maximum_missing_percentage"),
        F.max("row_count").alias("record_count"),
        F.transform(
            F.sort_array(F.collect_list(F.struct("ordinal", "column"))), lambda c: c["column"]
        ).alias("columns"),
    ).where(F.col("affected_column_count") > 0)


def build_insights(battery: Battery, profile: DataFrame | None = None) -> DataFrame:
    """All findings and diagnostics with sequential ids in emission order."""
    b = battery
    dated = b.registry.date_column is not None
    pair = F.array("previous_period", "current_period")
    parts = [_pack(b, b.snapshot(), "metric_snapshot", _GENERAL, 1)]
    if dated:
        parts += [
            _pack(b, b.period_change(), "period_change", _GENERAL, 3, dated=True, periods=pair),
            _pack(
                b, b.period_baseline(), "period_baseline_comparison", _GENERAL, 4, dated=True,
                periods=F.concat(F.col("baseline_periods"), F.array("current_period")),
            ),
            _pack(b, b.trend(), "trend", _GENERAL, 5, dated=True, periods=F.col("periods")),
            _pack(
                b, b.period_target(), "period_target_comparison", _GENERAL, 6, dated=True,
                periods=F.array("current_period"),
            ),
        ]
    if b.categories:
        parts += [
            _pack(b, b.segment_ranking(), "segment_ranking", _CATEGORY, 1),
            _pack(b, b.segment_share(), "segment_share", _CATEGORY, 2),
            _pack(b, b.segment_benchmark(), "segment_benchmark_performance", _CATEGORY, 3),
            _pack(b, b.segment_target(), "segment_target_comparison", _CATEGORY, 4),
        ]
        if dated:
            parts += [
                _pack(
                    b, b.cohort_comparison(), "cohort_period_comparison", _CATEGORY, 5,
                    dated=True, periods=pair,
                ),
                _pack(
                    b, b.segment_contribution(), "segment_contribution", _CATEGORY, 6,
                    dated=True, periods=pair,
                ),
            ]
    if any(m.kpi.row_level for m in b.measures):
        parts += [
            _pack(b, b.anomalies(), "iqr_anomaly_detection", _ROWS, 1),
            _pack(b, b.correlations(), "numeric_correlation", _ROWS, 2),
            _pack(b, b.benchmark_breach(), "benchmark_breach", _ROWS, 3),
        ]
    parts += [
        _pack(b, skipped(b), "analysis_skipped", _GENERAL, None, dated=True),
        _pack(b, insufficient_warnings(b), "insufficient_data_warning", _LAST, 1),
    ]
    merged = union_all(parts)
    if profile is not None:
        first = missing_data(profile).select(
            F.lit(-1).alias("metric_pos"),
            F.lit(_GENERAL).alias("block"),
            F.lit(-1).alias("category_pos"),
            F.lit(0).alias("analysis_pos"),
            F.lit(-1).alias("column_pos"),
            F.lit("DATASET").alias("metric_id"),
            F.lit("Dataset completeness").alias("metric"),
            F.lit("missing_data_warning").alias("type"),
            F.to_json(
                F.struct("affected_column_count", "maximum_missing_percentage", "columns")
            ).alias("observation"),
            F.col("columns").alias("source_columns"),
            F.array().cast("array<string>").alias("periods"),
            F.col("record_count").cast("long").alias("record_count"),
            F.lit("high").alias("confidence"),
            (F.col("maximum_missing_percentage") / 100).alias("impact"),
        )
        merged = first.unionByName(merged)
    # A handful of rows per KPI and column, so one ordered window is enough.
    order = Window.partitionBy(F.lit(0)).orderBy(
        "metric_pos", "block", "category_pos", "analysis_pos", "column_pos"
    )
    numbered = merged.withColumn("_i", F.row_number().over(order)).select(
        F.format_string("INS-%03d", F.col("_i")).alias("id"), *merged.columns
    )
    return checkpointed(numbered)


def support_rows(battery: Battery, profile: DataFrame | None = None) -> DataFrame:
    """The rows behind each finding, as JSON with their position inside it.

    Outlier rows stay distributed, whatever their number; their position follows their key.
    ``profile`` adds the columns with missing cells.
    """
    b = battery

    def rows(frame: DataFrame, kind: str, position: Column | None = None) -> DataFrame:
        names = frame.columns
        hidden = {"metric_pos", "category_pos", "column_pos", "metric_id", "position"}
        payload = [c for c in names if c not in hidden]
        place = position if position is not None else F.col("position")
        return frame.select(
            "metric_id",
            F.lit(kind).alias("type"),
            (F.col("category_pos") if "category_pos" in names else F.lit(-1))
            .cast("int")
            .alias("category_pos"),
            (F.col("column_pos") if "column_pos" in names else F.lit(-1))
            .cast("int")
            .alias("column_pos"),
            place.cast("long").alias("position"),
            F.to_json(F.struct(*payload)).alias("row"),
        )

    parts = [rows(b.snapshot().drop("impact", "confidence"), "metric_snapshot", F.lit(1))]
    if b.registry.date_column is not None:
        change = b.period_change()
        two = change.select(
            "metric_id",
            F.inline(
                F.array(
                    F.struct(
                        F.lit(1).alias("position"),
                        F.col("previous_period").alias("period"),
                        F.col("previous_value").alias("value"),
                        F.lit("previous").alias("role"),
                    ),
                    F.struct(
                        F.lit(2).alias("position"),
                        F.col("current_period").alias("period"),
                        F.col("current_value").alias("value"),
                        F.lit("current").alias("role"),
                    ),
                )
            ),
        )
        eligible = b._eligible_periods
        line = eligible.where(F.col("_count") >= MIN_TREND_PERIODS).select(
            "metric_id", (F.col("_x") + 1).alias("position"), "period", "value"
        )
        last = eligible.where(
            (F.col("_count") >= 3) & (F.col("_x") >= F.col("_count") - 5)
        ).select(
            "metric_id",
            (F.col("_x") + 1).alias("position"),
            "period",
            "value",
            F.when(F.col("_x") == F.col("_count") - 1, "current")
            .otherwise("baseline")
            .alias("role"),
            F.col("n").alias("record_count"),
        )
        by_period = Window.partitionBy("metric_id").orderBy("period")
        targets = b.period_target_rows().withColumn(
            "position", F.row_number().over(by_period)
        )
        parts += [
            rows(two, "period_change"),
            rows(line, "trend"),
            rows(last, "period_baseline_comparison"),
            rows(targets, "period_target_comparison"),
        ]
    if b.categories:
        parts += [
            rows(b.segment_ranking_rows(), "segment_ranking"),
            rows(b.segment_share_rows(), "segment_share"),
            rows(b.segment_benchmark_rows(), "segment_benchmark_performance"),
            rows(b.segment_target_rows(), "segment_target_comparison"),
        ]
        if b.registry.date_column is not None:
            parts += [
                rows(b.cohort_rows().drop("score"), "cohort_period_comparison"),
                rows(b.contribution_rows(), "segment_contribution"),
            ]
    if any(m.kpi.row_level for m in b.measures):
        pair = ["metric", "associated_metric"]
        sums = b.correlations().drop("impact", "confidence").join(b.correlation_sums(), pair)
        outliers = b.outliers().withColumn("is_outlier", F.lit(True))
        key = F.coalesce(F.col("row_key").try_cast("long"), F.xxhash64("row_key", "value"))
        parts += [
            rows(sums, "numeric_correlation", F.lit(1)),
            rows(outliers.withColumn("position", key), "iqr_anomaly_detection"),
            rows(b.benchmark_breach().drop("impact", "confidence"), "benchmark_breach", F.lit(1)),
        ]
    by_issue = Window.partitionBy("metric_id").orderBy(
        "issue_order", "category_pos", "column_pos"
    )
    found = issues(b).withColumn("position", F.row_number().over(by_issue))
    found = found.select("metric_id", "position", "analysis", "available", "required", "unit")
    parts.append(rows(found, "insufficient_data_warning"))
    by_reason = Window.partitionBy("metric_id").orderBy("block", "analysis_pos", "category_pos")
    left_out = skipped(b).withColumn("position", F.row_number().over(by_reason))
    parts.append(rows(left_out.drop("block", "analysis_pos"), "analysis_skipped"))
    if profile is not None:
        lacking = profile.where(F.col("missing_count") > 0).select(
            F.lit("DATASET").alias("metric_id"),
            F.col("ordinal").alias("position"),
            "column",
            "missing_count",
            "missing_percentage",
        )
        parts.append(rows(lacking, "missing_data_warning"))
    return union_all(parts)
