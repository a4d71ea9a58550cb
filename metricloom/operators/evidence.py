"""Scoring, ranking, selection and packaging of findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.frames import literal_frame
from metricloom.functions.values import bounded_score

# Relevance per finding type and numeric confidence per label.
RELEVANCE = (
    ("metric_snapshot", 0.98),
    ("period_change", 1.0),
    ("cohort_period_comparison", 1.0),
    ("segment_benchmark_performance", 1.0),
    ("segment_target_comparison", 1.0),
    ("period_baseline_comparison", 0.98),
    ("period_target_comparison", 1.0),
    ("benchmark_breach", 0.98),
    ("metric_benchmark_comparison", 1.0),
    ("segment_contribution", 0.95),
    ("segment_share", 0.96),
    ("segment_ranking", 0.9),
    ("trend", 0.85),
    ("iqr_anomaly_detection", 0.7),
    ("numeric_correlation", 0.6),
    ("missing_data_warning", 0.55),
    ("insufficient_data_warning", 0.3),
    ("analysis_skipped", 0.15),
)
CONFIDENCE = (("high", 1.0), ("medium", 0.65), ("low", 0.35))
# Report sections in reading order and the finding types in each.
SECTIONS = (
    ("key_findings", "Key findings", ("metric_snapshot",)),
    (
        "trends_and_changes",
        "Trends and changes",
        ("period_change", "period_baseline_comparison", "trend"),
    ),
    (
        "segment_analysis",
        "Segment analysis",
        ("segment_ranking", "segment_share", "cohort_period_comparison", "segment_contribution"),
    ),
    ("anomalies", "Anomalies", ("iqr_anomaly_detection",)),
    ("associations", "Associations", ("numeric_correlation",)),
    (
        "benchmarks",
        "Benchmarks and thresholds",
        (
            "benchmark_breach",
            "metric_benchmark_comparison",
            "segment_benchmark_performance",
            "period_target_comparison",
            "segment_target_comparison",
        ),
    ),
    ("manual_visualizations", "Manual visualizations", ()),
    (
        "data_quality_and_limitations",
        "Data quality and analysis limitations",
        ("missing_data_warning", "insufficient_data_warning", "analysis_skipped"),
    ),
)
DIAGNOSTICS = ("missing_data_warning", "insufficient_data_warning", "analysis_skipped")
# What a report shows; callers pass them as limits.
MAX_DEFAULT_EVIDENCE = 10
MAX_DEFAULT_ASSOCIATIONS = 2
MAX_PACKAGE_EVIDENCE = 50
MAX_PACKAGE_ROWS = 12
MAX_STORY_EVIDENCE = 3
MAX_STORIES = 5

_METHODS = {
    "missing_data_warning": "Counts missing cells per column over all records.",
    "metric_snapshot": "One aggregate of %s over every eligible record.",
    "period_change": "%s of the latest period minus the one before, over the one before.",
    "period_baseline_comparison": "%s of the latest period against the mean of up to four earlier periods.",
    "period_target_comparison": "%s of each eligible period against the period target.",
    "trend": "Least-squares line through %s of the ordered eligible periods.",
    "segment_ranking": "%s per category value, highest first.",
    "segment_share": "Sum of %s per category value over the categorized total.",
    "cohort_period_comparison": "%s of the same category values in the last two periods.",
    "segment_benchmark_performance": "Share of rows of %s that miss the row target, per category value.",
    "segment_target_comparison": "%s per category value against the segment target.",
    "segment_contribution": "Change of %s per category value over the overall change.",
    "iqr_anomaly_detection": "Values of %s beyond 1.5 interquartile ranges from the quartiles.",
    "numeric_correlation": "Pearson coefficient of %s over complete pairs; association only.",
    "benchmark_breach": "Share of rows of %s that miss the row target.",
    "insufficient_data_warning": "Requirements that the records of %s do not meet.",
    "analysis_skipped": "Preconditions of an analysis of %s that do not hold.",
}


def _lookup(pairs: Sequence[tuple[str, float]], key: Column, default: float) -> Column:
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.coalesce(F.element_at(table, key), F.lit(default))


def evidence_kind(kind: Column) -> Column:
    return (
        F.when(kind.isin(*DIAGNOSTICS), "diagnostic")
        .when(kind == "numeric_correlation", "association")
        .otherwise("finding")
    )


def section_of(kind: Column) -> Column:
    pairs = [x for name, _, kinds in SECTIONS for k in kinds for x in (F.lit(k), F.lit(name))]
    return F.coalesce(F.element_at(F.create_map(*pairs), kind), F.lit("key_findings"))


def strength(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.5, "medium").otherwise("low")


def stable_id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(text, 256), 1, 16)))


def score(insights: DataFrame) -> DataFrame:
    """Impact, confidence, relevance and their combination, each with six decimals."""
    impact = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("impact", F.lit(0.0))))
    confidence = _lookup(CONFIDENCE, F.col("confidence"), 0.35)
    relevance = _lookup(RELEVANCE, F.col("type"), 0.5)
    return insights.select(
        *[c for c in insights.columns if c != "impact"],
        bounded_score(impact).alias("impact"),
        bounded_score(confidence).alias("confidence_score"),
        bounded_score(relevance).alias("relevance"),
        bounded_score(0.5 * impact + 0.2 * confidence + 0.3 * relevance).alias("combined"),
    )


def build_evidence(insights: DataFrame, dataset_id: str) -> DataFrame:
    """Ranked evidence, one row per insight.

    The number of insights depends on KPIs, categories and columns, never on rows, so
    the single ordered window holds a few hundred rows at most.
    """
    scored = score(insights)
    identity = F.to_json(
        F.struct(
            F.lit(dataset_id).alias("dataset_id"),
            F.col("periods").alias("filters"),
            F.col("id").alias("insight_id"),
            "metric_id",
            "source_columns",
            "type",
        )
    )
    template = F.create_map(*[F.lit(x) for pair in _METHODS.items() for x in pair])
    method = F.replace(
        F.coalesce(F.element_at(template, F.col("type")), F.lit("Computed from the records.")),
        F.lit("%s"),
        F.col("metric"),
    )
    rows = scored.withColumn("evidence_id", stable_id("EVD-", identity))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("combined"), "evidence_id")
    return rows.select(
        "evidence_id",
        F.col("id").alias("insight_id"),
        "metric_pos",
        "category_pos",
        "column_pos",
        "metric_id",
        "metric",
        "type",
        evidence_kind(F.col("type")).alias("kind"),
        section_of(F.col("type")).alias("section"),
        "source_columns",
        "periods",
        method.alias("calculation"),
        "observation",
        "record_count",
        "confidence",
        "impact",
        "confidence_score",
        "relevance",
        "combined",
        F.row_number().over(order).alias("rank"),
    )


def recommended(
    evidence: DataFrame, limit: int | None = None, associations: int | None = None
) -> DataFrame:
    """Pick in order: one finding per KPI first, then by rank.

    ``limit`` keeps the first findings and ``associations`` the first associations;
    ``available`` counts what there was to pick from.
    """
    by_metric = Window.partitionBy("metric_id").orderBy("rank")
    usable = evidence.where(F.col("kind") != "diagnostic")
    anchors = (
        usable.where((F.col("kind") == "finding") & (F.col("metric_id") != "DATASET"))
        .withColumn("_n", F.row_number().over(by_metric))
        .where(F.col("_n") == 1)
        .select(F.col("evidence_id").alias("_anchor"))
    )
    marked = usable.join(
        F.broadcast(anchors), usable["evidence_id"] == F.col("_anchor"), "left"
    ).withColumn("priority", F.when(F.col("_anchor").isNotNull(), 0).otherwise(1))
    of_kind = Window.partitionBy("kind").orderBy("rank")
    allowed = F.lit(True)
    if associations is not None:
        allowed = (F.col("kind") != "association") | (F.col("_k") <= associations)
    first = F.when(F.col("priority") == 0, F.col("metric_pos")).otherwise(F.col("rank"))
    order = Window.partitionBy(F.lit(0)).orderBy("priority", first)
    whole = Window.partitionBy(F.lit(0))
    picked = (
        marked.withColumn("_k", F.row_number().over(of_kind))
        .withColumn("available", F.count("*").over(whole))
        .where(allowed)
        .withColumn("position", F.row_number().over(order))
        .drop("_k", "_anchor", "priority")
    )
    return picked if limit is None else picked.where(F.col("position") <= limit)


def sectioned(evidence: DataFrame) -> DataFrame:
    """Evidence in report order: section by section, best rank first."""
    spark = evidence.sparkSession
    places = literal_frame(
        spark,
        [(name, label, i) for i, (name, label, _) in enumerate(SECTIONS, 1)],
        "section string, section_label string, section_position int",
    )
    inside = Window.partitionBy("section").orderBy("rank")
    return evidence.join(F.broadcast(places), "section").withColumn(
        "position_in_section", F.row_number().over(inside)
    )


def package(
    evidence: DataFrame,
    support: DataFrame,
    selected: DataFrame | None = None,
    max_evidence: int = MAX_PACKAGE_EVIDENCE,
    max_rows: int = MAX_PACKAGE_ROWS,
) -> DataFrame:
    """The first ``max_evidence`` selected findings with at most ``max_rows`` support rows each.

    What is left out is counted: ``support_omitted`` per finding, and the findings
    beyond the bound stay in the frame with ``included`` false and no rows.
    """
    chosen = evidence
    if selected is not None:
        chosen = evidence.join(selected.select("evidence_id").distinct(), "evidence_id")
    order = Window.partitionBy(F.lit(0)).orderBy("rank")
    chosen = chosen.withColumn("position", F.row_number().over(order)).withColumn(
        "included", F.col("position") <= max_evidence
    )
    keys = ["metric_id", "type", "category_pos", "column_pos"]
    inside = Window.partitionBy(*keys).orderBy("position")
    limited = (
        support.withColumn("_n", F.row_number().over(inside))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("_rows"),
            F.transform(
                F.sort_array(
                    F.collect_list(
                        F.when(F.col("_n") <= max_rows, F.struct("_n", "row"))
                    )
                ),
                lambda e: e["row"],
            ).alias("support_rows"),
        )
    )
    joined = chosen.join(limited, keys, "left")
    none = F.array().cast("array<string>")
    kept = F.when(F.col("included"), F.coalesce("support_rows", none)).otherwise(none)
    return joined.select(
        "position",
        "included",
        "evidence_id",
        "insight_id",
        "metric_id",
        "metric",
        "type",
        "observation",
        "rank",
        "record_count",
        kept.alias("support_rows"),
        (F.coalesce("_rows", F.lit(0)) - F.size(kept)).alias("support_omitted"),
    )


def row_identity_removed(frame: DataFrame) -> DataFrame:
    """Drop columns that could identify a source row."""
    return frame.drop("row", "row_id", "row_number", "record_id", "row_key")


def unknown_selections(selected: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Selected ids that no longer exist (must be empty)."""
    return selected.select(key).distinct().join(known.select(key), key, "left_anti")


def foreign_evidence(evidence: DataFrame, selected_metrics: DataFrame) -> DataFrame:
    """Selected evidence of a KPI that is not selected; data-set evidence is always fine."""
    bound = evidence.where(F.col("metric_id") != "DATASET")
    return bound.join(selected_metrics.select("metric_id"), "metric_id", "left_anti")


def current_chart_insights(chart_insights: DataFrame, charts: DataFrame) -> DataFrame:
    """Chart insights whose chart still has the fingerprint they were made from."""
    return chart_insights.join(
        charts.select("visualization_id", "sha256"), ["visualization_id", "sha256"], "left_semi"
    )


def missing_chart_kpis(charts: DataFrame, selected_metrics: DataFrame) -> DataFrame:
    """KPIs a chart refers to that are not selected.

    ``charts`` has ``visualization_id`` and ``measures`` (at most five selectors), so
    the collected list per chart is bounded.
    """
    needed = charts.select("visualization_id", F.explode("measures").alias("selector")).where(
        F.col("selector").startswith("metric:")
    )
    needed = needed.select("visualization_id", F.substring("selector", 8, 64).alias("metric_id"))
    absent = needed.distinct().join(
        selected_metrics.select("metric_id"), "metric_id", "left_anti"
    )
    return absent.groupBy("visualization_id").agg(
        F.sort_array(F.collect_list("metric_id")).alias("missing_metrics")
    )


def latest_charts(charts: DataFrame, source_sha256: str) -> DataFrame:
    """Saved charts of one source, newest first."""
    return charts.where(F.col("source_sha256") == source_sha256).orderBy(
        F.desc("updated_at"), "visualization_id"
    )


def stories(evidence: DataFrame, max_stories: int | None = None) -> DataFrame:
    """Groups of up to three findings of one KPI, dealt round-robin over the KPIs."""
    by_metric = Window.partitionBy("metric").orderBy("rank")
    whole = Window.partitionBy("metric")
    chunked = evidence.withColumn(
        "chunk", F.floor((F.row_number().over(by_metric) - 1) / MAX_STORY_EVIDENCE)
    ).withColumn("_first", F.min("rank").over(whole))
    grouped = chunked.groupBy("metric", "chunk", "_first").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "evidence_id"))),
            lambda e: e["evidence_id"],
        ).alias("evidence_ids"),
        F.min("confidence_score").alias("_score"),
    )
    order = Window.partitionBy(F.lit(0)).orderBy("chunk", "_first")
    numbered = grouped.select(
        stable_id("STY-", F.concat_ws("|", "evidence_ids")).alias("story_id"),
        F.row_number().over(order).alias("position"),
        "metric",
        "chunk",
        "evidence_ids",
        strength(F.col("_score")).alias("confidence"),
    )
    return numbered if max_stories is None else numbered.where(F.col("position") <= max_stories)


def finding_charts(support: DataFrame, limit: int | None = None) -> DataFrame:
    """Chart type and rows for each finding that has a chart.

    ``limit`` keeps the first rows of charts other than lines.
    """
    forms = (
        ("period_change", "bar"),
        ("trend", "line"),
        ("period_baseline_comparison", "line"),
        ("period_target_comparison", "line"),
        ("segment_ranking", "bar"),
        ("segment_share", "bar"),
        ("segment_contribution", "bar"),
        ("cohort_period_comparison", "bar"),
        ("segment_benchmark_performance", "bar"),
        ("segment_target_comparison", "bar"),
        ("missing_data_warning", "bar"),
        ("iqr_anomaly_detection", "box"),
    )
    names = literal_frame(support.sparkSession, list(forms), "type string, chart string")
    inside = Window.partitionBy("metric_id", "type", "category_pos", "column_pos").orderBy(
        "position"
    )
    ranked = support.join(F.broadcast(names), "type").withColumn(
        "_n", F.row_number().over(inside)
    )
    if limit is not None:
        ranked = ranked.where((F.col("chart") == "line") | (F.col("_n") <= limit))
    return ranked.drop("_n")
