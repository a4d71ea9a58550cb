"""The analysis battery over whole tables, one query per analysis.

The oracle SQL computes each analysis on its own from the raw tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.operators import evidence as E
from metricloom.operators import kpi as K
from metricloom.operators.battery import Battery
from metricloom.operators.insights import (
    build_insights,
    insufficient_warnings,
    issues,
    missing_data,
    skipped,
    support_rows,
)
from metricloom.operators.profile import missing_counts, profile
from metricloom.plans.registry import ORACLE, load, query, shown
from metricloom.functions.values import Table


def lineitem_registry() -> K.Registry:
    return K.Registry(
        (
            K.source_kpi("l_extendedprice", "sum", target=50000.0, target_scope="row"),
            K.formula_kpi(
                "net", "[l_extendedprice] * (1 - [l_discount])", "row", "sum",
                target=60000000.0, target_scope="period",
            ),
            K.formula_kpi(
                "unit_price", "SUM([l_extendedprice]) / SUM([l_quantity])", "aggregate",
                direction="lower", target=2075.0, target_scope="segment",
            ),
            K.rate_kpi("return_rate", "l_returnflag", ["R"], target=30.0),
            K.rate_kpi("open_share", "l_linestatus", ["O"], "l_extendedprice"),
        ),
        "l_shipdate",
        ("l_returnflag", "l_linestatus"),
    )


def lineitem_battery(spark, folder) -> Battery:
    return Battery(load(spark, folder, "lineitem"), lineitem_registry())


def events_battery(spark, folder) -> Battery:
    registry = K.Registry(
        (
            K.source_kpi("value", "mean", target=10.0, target_scope="row", direction="lower"),
            K.formula_kpi("typical", "MEDIAN([value])", "aggregate"),
        ),
        "ts",
        ("event_type",),
    )
    return Battery(load(spark, folder, "events", "event_id"), registry)


def margin_battery(spark, folder) -> Battery:
    """A KPI whose sum is negative, so shares of it make no sense."""
    kpi = K.formula_kpi("tax_gap", "[l_tax] - [l_discount]", "row", "sum")
    registry = K.Registry((kpi,), None, ("l_returnflag", "l_linestatus"))
    return Battery(load(spark, folder, "lineitem"), registry, numeric_columns=["l_tax"])


# ---- oracle parts ------------------------------------------------------------

_LINE_KPIS = {
    "l_extendedprice": "sum(l_extendedprice)",
    "net": "sum(round(l_extendedprice * (1 - l_discount), 10))",
    "unit_price": "sum(l_extendedprice) / sum(l_quantity)",
    "return_rate": "100.0 * count(*) FILTER (WHERE l_returnflag = 'R') / count(*)",
    "open_share": "100.0 * sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice)",
}
_ADDITIVE = ("l_extendedprice", "net")
_CATS = ("l_returnflag", "l_linestatus")


def _by(keys: str, group: str, metrics=tuple(_LINE_KPIS)) -> str:
    """Long KPI values: metric, the keys, n and value."""
    return " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {keys} count(*) AS n, {_LINE_KPIS[m]} AS value "
        f"FROM lineitem {group}"
        for m in metrics
    )


_P = _by("strftime(l_shipdate, '%Y') AS period,", "GROUP BY 2")
_S = " UNION ALL ".join(
    _by(f"'{c}' AS category_column, {c} AS segment,", f"GROUP BY {c}") for c in _CATS
)
_SP = " UNION ALL ".join(
    _by(
        f"'{c}' AS category_column, {c} AS segment, strftime(l_shipdate, '%Y') AS period,",
        f"GROUP BY {c}, strftime(l_shipdate, '%Y')",
    )
    for c in _CATS
)
_LAST_TWO = """r AS (SELECT metric, period, n, value,
    row_number() OVER (PARTITION BY metric ORDER BY period DESC) AS back FROM p),
    cur AS (SELECT * FROM r WHERE back = 1), prev AS (SELECT * FROM r WHERE back = 2)"""
_CONF = "CASE WHEN {0} >= 30 THEN 'high' WHEN {0} >= 10 THEN 'medium' ELSE 'low' END"
_DIR = "CASE WHEN abs({0}) <= 1e-12 THEN 'stable' WHEN {0} > 0 THEN 'increasing' ELSE 'decreasing' END"


def _public(df):
    return df.drop("metric_pos", "category_pos", "column_pos", "metric_id")


@query(
    "metric_snapshot",
    "B2 B20 A1 A15 E4",
    f"""WITH t AS ({_by('', '')})
    SELECT metric, round(value, 2) AS current_value, n AS valid_record_count,
    0::BIGINT AS excluded_record_count, n AS total_record_count,
    CASE WHEN metric = 'return_rate' THEN round(value - 30, 6) END AS gap_to_target,
    CASE WHEN metric = 'return_rate' THEN value >= 30 END AS meets_target,
    CASE WHEN metric = 'return_rate' THEN (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R')
         WHEN metric = 'open_share' THEN (SELECT count(*) FROM lineitem WHERE l_linestatus = 'O')
    END AS numerator_record_count, {_CONF.format('n')} AS confidence,
    round(CASE WHEN metric = 'return_rate' THEN abs(value - 30) / greatest(30, value) ELSE 0.4 END, 6) AS impact
    FROM t""",
)
def metric_snapshot(spark, folder):
    out = lineitem_battery(spark, folder).snapshot().select(
        "metric", "current_value", "valid_record_count", "excluded_record_count",
        "total_record_count", "gap_to_target", "meets_target", "numerator_record_count",
        "confidence", "impact",
    )
    return shown(out, 6, current_value=2)


@query("capability_plan", "B3")
def capability_plan(spark, folder):
    """Applicable analyses with the number of records each KPI has for them."""
    battery = lineitem_battery(spark, folder)
    counts = battery.totals.select("metric_pos", F.col("n").alias("eligible_records"))
    return battery.capabilities().join(F.broadcast(counts), "metric_pos").drop("metric_pos")


@query(
    "temporal_context",
    "B4 M11",
    f"""WITH m AS (SELECT metric, period FROM ({_P}))
    SELECT metric, 'year' AS granularity, period, round(value, 4) AS value, n AS record_count FROM ({_P})""",
)
def temporal_context(spark, folder):
    out = lineitem_battery(spark, folder).period_values().drop("metric_id")
    return shown(out, 4)


@query(
    "period_change",
    "B5 W1 B21",
    f"""WITH p AS ({_P}), {_LAST_TWO}
    SELECT metric, prev.period AS previous_period, round(prev.value, 4) AS previous_value,
    cur.period AS current_period, round(cur.value, 4) AS current_value,
    round(cur.value - prev.value, 4) AS absolute_change,
    round((cur.value - prev.value) / prev.value * 100, 6) AS percentage_change,
    {_DIR.format('(cur.value - prev.value)')} AS direction,
    (cur.value > prev.value) = (metric <> 'unit_price') AS favorable,
    cur.n + prev.n AS record_count, {_CONF.format('least(cur.n, prev.n)')} AS confidence
    FROM cur JOIN prev USING (metric)""",
)
def period_change(spark, folder):
    out = _public(lineitem_battery(spark, folder).period_change())
    out = out.drop("aggregation", "period_granularity", "impact")
    return shown(out, 4, percentage_change=6)


@query(
    "period_baseline",
    "B6 W2",
    f"""WITH p AS ({_P}), e AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY period DESC) AS back
         FROM p WHERE n >= 2),
    b AS (SELECT metric, avg(value) AS base, min(value) AS lo, max(value) AS hi, count(*) AS k, sum(n) AS bn,
          min(n) AS low FROM e WHERE back BETWEEN 2 AND 5 GROUP BY metric)
    SELECT metric, k AS baseline_period_count, round(base, 1) AS baseline_value,
    round(lo, 1) AS baseline_minimum, round(hi, 1) AS baseline_maximum, e.period AS current_period,
    round(e.value, 1) AS current_value, round(e.value - base, 1) AS absolute_change,
    round((e.value - base) / base * 100, 6) AS percentage_change,
    {_DIR.format('(e.value - base)')} AS direction, (bn + e.n)::BIGINT AS record_count,
    {_CONF.format('least(low, e.n)')} AS confidence
    FROM b JOIN e USING (metric) WHERE e.back = 1""",
)
def period_baseline(spark, folder):
    out = _public(lineitem_battery(spark, folder).period_baseline())
    out = out.drop(
        "aggregation", "period_granularity", "baseline_method", "baseline_periods", "favorable",
        "impact",
    )
    return shown(out, 1, percentage_change=6)


@query(
    "trend",
    "B7 A7 W3",
    f"""WITH p AS ({_P}), e AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY period) - 1 AS x
         FROM p WHERE n >= 2)
    SELECT metric, round(regr_slope(value, x), 2) AS slope_per_period,
    round(pow(corr(value, x), 2), 6) AS r_squared, {_DIR.format('regr_slope(value, x)')} AS direction,
    count(*) AS period_count, sum(n)::BIGINT AS record_count FROM e GROUP BY metric""",
)
def trend(spark, folder):
    out = lineitem_battery(spark, folder).trend().select(
        "metric", "slope_per_period", "r_squared", "direction", "period_count", "record_count"
    )
    return shown(out, 6, slope_per_period=2)


@query(
    "period_target",
    "B13 F11",
    f"""WITH p AS ({_P}) SELECT metric, max(period) AS current_period,
    round(max_by(value, period), 4) AS current_value,
    round(max_by(value, period) - 60000000, 4) AS current_gap_to_target,
    count(*) FILTER (WHERE value < 60000000) AS missed_period_count,
    count(*) AS eligible_period_count, sum(n)::BIGINT AS record_count
    FROM p WHERE metric = 'net' AND n >= 2 GROUP BY metric""",
)
def period_target(spark, folder):
    out = lineitem_battery(spark, folder).period_target().select(
        "metric", "current_period", "current_value", "current_gap_to_target",
        "missed_period_count", "eligible_period_count", "record_count",
    )
    return shown(out, 4)


@query(
    "segment_ranking",
    "B8 T4 F9",
    f"""WITH s AS ({_S}) SELECT metric, category_column, segment, round(value, 4) AS value, n AS record_count,
    row_number() OVER (PARTITION BY metric, category_column
        ORDER BY round(value, 6) DESC, lower(segment), segment) AS position
    FROM s WHERE n >= 2""",
)
def segment_ranking(spark, folder):
    out = _public(lineitem_battery(spark, folder).segment_ranking_rows())
    return shown(out.drop("aggregation", "segment_count"), 4)


@query(
    "segment_share",
    "B9 W7",
    f"""WITH s AS (SELECT * FROM ({_S}) WHERE metric IN ('l_extendedprice', 'net'))
    SELECT metric, category_column, segment, round(value, 4) AS value,
    round(value / sum(value) OVER (PARTITION BY metric, category_column) * 100, 6) AS share_percentage,
    row_number() OVER (PARTITION BY metric, category_column ORDER BY value DESC) AS position FROM s""",
)
def segment_share(spark, folder):
    out = lineitem_battery(spark, folder).segment_share_rows().select(
        "metric", "category_column", "segment", "value", "share_percentage", "position"
    )
    return shown(out, 6, value=4)


_COHORT_SUMS = "sum(n) AS n, sum(a) AS a, sum(b) AS b, sum(q) AS q, sum(r) AS r, sum(o) AS o"


@query(
    "cohort_comparison",
    "B10 J1 X1",
    f"""WITH g AS MATERIALIZED (SELECT l_returnflag, l_linestatus, strftime(l_shipdate, '%Y') AS period, count(*) AS n,
      sum(l_extendedprice) AS a, sum(round(l_extendedprice * (1 - l_discount), 10)) AS b, sum(l_quantity) AS q,
      count(*) FILTER (WHERE l_returnflag = 'R') AS r, sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END) AS o
      FROM lineitem GROUP BY ALL),
    c AS MATERIALIZED (SELECT 'l_returnflag' AS category_column, l_returnflag AS segment, period, {_COHORT_SUMS} FROM g GROUP BY ALL
      UNION ALL SELECT 'l_linestatus', l_linestatus, period, {_COHORT_SUMS} FROM g GROUP BY ALL),
    t AS MATERIALIZED (SELECT period, row_number() OVER (ORDER BY period DESC) AS back FROM (SELECT DISTINCT period FROM g)),
    v AS MATERIALIZED (SELECT category_column, segment, period, back, n, unnest([
      {{'metric': 'l_extendedprice', 'value': a}}, {{'metric': 'net', 'value': b}}, {{'metric': 'unit_price', 'value': a / q}},
      {{'metric': 'return_rate', 'value': 100.0 * r / n}}, {{'metric': 'open_share', 'value': 100.0 * o / a}}]) AS k
      FROM c JOIN t USING (period) WHERE back <= 2)
    SELECT o.k.metric AS metric, o.category_column, o.segment, o.period AS previous_period, w.period AS current_period,
    round(o.k.value, 4) AS previous_value, round(w.k.value, 4) AS current_value,
    round(w.k.value - o.k.value, 4) AS absolute_change,
    CASE WHEN abs(o.k.value) > 1e-12 THEN round((w.k.value - o.k.value) / o.k.value * 100, 6) END AS percentage_change,
    o.n::BIGINT AS previous_record_count, w.n::BIGINT AS current_record_count
    FROM v o JOIN v w ON o.back = 2 AND w.back = 1 AND w.category_column = o.category_column AND w.segment = o.segment
      AND w.k.metric = o.k.metric
    WHERE least(o.n, w.n) >= 2""",
)
def cohort_comparison(spark, folder):
    out = lineitem_battery(spark, folder).cohort_rows().select(
        "metric", "category_column", "segment", "previous_period", "current_period",
        "previous_value", "current_value", "absolute_change", "percentage_change",
        "previous_record_count", "current_record_count",
    )
    return shown(out, 4, percentage_change=6)


@query(
    "cohort_best_worst",
    "B10 X3",
    f"""WITH p AS ({_P}), {_LAST_TWO}, sp AS ({_SP}),
    c AS (SELECT o.metric, o.category_column, o.segment, o.n AS on_, w.n AS wn,
      CASE WHEN abs(o.value) > 1e-12 THEN (w.value - o.value) / o.value * 100
           ELSE (w.value - o.value) / greatest(abs(w.value), 1) * 100 END
      * CASE WHEN o.metric = 'unit_price' THEN -1 ELSE 1 END AS score
    FROM sp o JOIN prev ON o.metric = prev.metric AND o.period = prev.period
    JOIN cur ON cur.metric = o.metric
    JOIN sp w ON w.metric = o.metric AND w.category_column = o.category_column
        AND w.segment = o.segment AND w.period = cur.period
    WHERE least(o.n, w.n) >= 2)
    SELECT metric, category_column, count(*) AS cohort_count, 0::BIGINT AS excluded_cohort_count,
    arg_max(segment, (score, lower(segment))) AS best_cohort,
    arg_min(segment, (score, lower(segment))) AS worst_cohort,
    sum(on_ + wn)::BIGINT AS record_count FROM c GROUP BY metric, category_column""",
)
def cohort_best_worst(spark, folder):
    return lineitem_battery(spark, folder).cohort_comparison().select(
        "metric", "category_column", "cohort_count", "excluded_cohort_count", "best_cohort",
        "worst_cohort", "record_count",
    )


@query(
    "segment_contribution",
    "B11 J2 X2",
    f"""WITH p AS ({_P}), {_LAST_TWO}, sp AS (SELECT * FROM ({_SP}) WHERE metric IN ('l_extendedprice', 'net')),
    c AS (SELECT sp.metric, category_column, segment,
      sum(CASE WHEN sp.period = prev.period THEN sp.value ELSE 0 END) AS o,
      sum(CASE WHEN sp.period = cur.period THEN sp.value ELSE 0 END) AS w
      FROM sp JOIN prev ON prev.metric = sp.metric JOIN cur ON cur.metric = sp.metric
      WHERE sp.period IN (prev.period, cur.period) GROUP BY ALL)
    SELECT metric, category_column, segment, round(o, 4) AS previous_value, round(w, 4) AS current_value,
    round(w - o, 4) AS absolute_change,
    round((w - o) / sum(w - o) OVER (PARTITION BY metric, category_column) * 100, 5) AS contribution_percentage,
    round(sum(w - o) OVER (PARTITION BY metric, category_column), 4) AS overall_change FROM c""",
)
def segment_contribution(spark, folder):
    out = lineitem_battery(spark, folder).contribution_rows().select(
        "metric", "category_column", "segment", "previous_value", "current_value",
        "absolute_change", "contribution_percentage", "overall_change",
    )
    return shown(out, 4, contribution_percentage=5)


@query(
    "segment_benchmark",
    "B12",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS category_column, {c} AS segment, round(avg(l_extendedprice), 6) AS average_value,
        round(avg(l_extendedprice) - 50000, 6) AS average_gap_to_target,
        count(*) FILTER (WHERE l_extendedprice < 50000) AS breach_count, count(*) AS record_count,
        round(100.0 * count(*) FILTER (WHERE l_extendedprice < 50000) / count(*), 6) AS breach_percentage
        FROM lineitem GROUP BY {c}"""
        for c in _CATS
    ),
)
def segment_benchmark(spark, folder):
    out = lineitem_battery(spark, folder).segment_benchmark_rows().select(
        "category_column", "segment", "average_value", "average_gap_to_target", "breach_count",
        "record_count", "breach_percentage",
    )
    return shown(out, 6)


@query(
    "segment_target",
    "B14",
    f"""SELECT metric, category_column, segment, round(value, 6) AS value,
    round(value - 2075, 6) AS gap_to_target, value <= 2075 AS meets_target, n AS record_count,
    row_number() OVER (PARTITION BY category_column
        ORDER BY greatest(value - 2075, 0) DESC, -value, lower(segment)) AS position
    FROM ({_S}) WHERE metric = 'unit_price' AND n >= 2""",
)
def segment_target(spark, folder):
    out = lineitem_battery(spark, folder).segment_target_rows().select(
        "metric", "category_column", "segment", "value", "gap_to_target", "meets_target",
        "record_count", "position",
    )
    return shown(out, 6)


@query(
    "benchmark_breach",
    "B17",
    """SELECT count(*) FILTER (WHERE l_extendedprice < 50000) AS breach_count,
    count(*) FILTER (WHERE l_extendedprice >= 50000) AS non_breach_count,
    round(100.0 * count(*) FILTER (WHERE l_extendedprice < 50000) / count(*), 6) AS breach_percentage,
    count(*) AS record_count FROM lineitem""",
)
def benchmark_breach(spark, folder):
    out = lineitem_battery(spark, folder).benchmark_breach().select(
        "breach_count", "non_breach_count", "breach_percentage", "record_count"
    )
    return shown(out, 6)


_EVENT_BOUNDS = """q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS n FROM events),
    b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"""


@query(
    "iqr_anomalies",
    "B15 A4 F10 J9",
    f"""WITH {_EVENT_BOUNDS}
    SELECT 'value' AS metric, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
    round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound,
    (SELECT count(*) FROM events, b WHERE value < lo OR value > hi) AS anomaly_count, n AS record_count FROM b""",
)
def iqr_anomalies(spark, folder):
    out = events_battery(spark, folder).anomalies().select(
        "metric", "q1", "q3", "iqr", "lower_bound", "upper_bound", "anomaly_count", "record_count"
    )
    return shown(out, 6)


@query(
    "iqr_outlier_rows",
    "B15 J9 F10",
    f"""WITH {_EVENT_BOUNDS} SELECT event_id AS row_key, round(value, 6) AS value
    FROM events, b WHERE value < lo OR value > hi""",
)
def iqr_outlier_rows(spark, folder):
    return shown(events_battery(spark, folder).outliers().select("row_key", "value"), 6)


@query(
    "median_by_day",
    "A2 B4 W3",
    """SELECT strftime(ts, '%Y-%m-%d') AS period, round(median(value), 6) AS value, count(*) AS record_count
    FROM events GROUP BY 1""",
)
def median_by_day(spark, folder):
    out = events_battery(spark, folder).period_values().where("metric = 'typical'")
    return shown(out.select("period", "value", "record_count"), 6)


@query(
    "median_by_segment",
    "A2 B8",
    """SELECT event_type AS segment, round(median(value), 6) AS value, count(*) AS record_count
    FROM events GROUP BY 1""",
)
def median_by_segment(spark, folder):
    out = events_battery(spark, folder).segment_ranking_rows().where("metric = 'typical'")
    return shown(out.select("segment", "value", "record_count"), 6)


_NUM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
_ROW = {"l_extendedprice": "l_extendedprice", "net": "round(l_extendedprice * (1 - l_discount), 10)"}


@query(
    "numeric_correlation",
    "B16 A6 J3 E4",
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, '{c}' AS associated_metric, round(corr({x}, {c}), 6) AS coefficient, "
        f"CASE WHEN abs(corr({x}, {c})) >= 0.7 THEN 'strong' WHEN abs(corr({x}, {c})) >= 0.4 THEN 'moderate' "
        f"ELSE 'weak' END AS strength, count(*) AS record_count FROM lineitem"
        for m, x in _ROW.items()
        for c in _NUM
        if c != m
    ),
)
def numeric_correlation(spark, folder):
    out = lineitem_battery(spark, folder).correlations().select(
        "metric", "associated_metric", "coefficient", "strength", "record_count"
    )
    return shown(out, 6)


@query(
    "correlation_sums",
    "A8",
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, '{c}' AS associated_metric, count(*) AS pair_count, "
        f"round(sum({x}), 2) AS sum_x, round(sum({c}), 2) AS sum_y, "
        f"round(sum({x} * {c}) / sum({x}), 5) AS weighted_y FROM lineitem"
        for m, x in _ROW.items()
        for c in _NUM
        if c != m
    ),
)
def correlation_sums(spark, folder):
    out = lineitem_battery(spark, folder).correlation_sums().select(
        "metric", "associated_metric", "pair_count", "sum_x", "sum_y",
        (F.col("sum_xy") / F.col("sum_x")).alias("weighted_y"),
    )
    return shown(out, 2, weighted_y=5)


@query(
    "missing_data",
    "B1 P2",
    """SELECT 2::BIGINT AS affected_column_count, 'line,tax' AS columns, count(*) AS record_count,
    round(greatest(100.0 * count(*) FILTER (WHERE l_linenumber = 3) / count(*),
                   100.0 * count(*) FILTER (WHERE l_tax = 0) / count(*)), 6) AS maximum_missing_percentage
    FROM lineitem""",
)
def missing_data_query(spark, folder):
    df = load(spark, folder, "lineitem").df.select(
        F.nullif("l_linenumber", F.lit(3)).alias("line"),
        F.nullif("l_tax", F.lit(0.0)).alias("tax"),
        "l_returnflag",
    )
    out = missing_data(profile(Table(df))).withColumn("columns", F.array_join("columns", ","))
    return shown(out, 6)


@query(
    "skipped_analyses",
    "B19",
    " UNION ALL ".join(
        f"""SELECT 'category_share_requires_nonnegative_additive_values' AS reason,
        'segment_share:{c}' AS analyses, sum(n)::BIGINT AS record_count
        FROM (SELECT {c}, sum(l_tax - l_discount) AS v, count(*) AS n FROM lineitem GROUP BY 1)
        HAVING min(v) < 0 OR sum(v) <= 0"""
        for c in _CATS
    ),
)
def skipped_analyses(spark, folder):
    out = skipped(margin_battery(spark, folder))
    return out.select("reason", F.array_join("analyses", ",").alias("analyses"), "record_count")


@query(
    "skipped_missing_dates",
    "B19 B4",
    """SELECT 'missing_dates' AS reason, count(*) AS record_count FROM orders
    HAVING count(*) FILTER (WHERE o_orderstatus = 'P') > 0""",
)
def skipped_missing_dates(spark, folder):
    table = load(spark, folder, "orders", "o_orderkey")
    hole = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    table = Table(table.df.withColumn("o_orderdate", hole), "o_orderkey")
    registry = K.Registry((K.source_kpi("o_totalprice"),), "o_orderdate")
    return skipped(Battery(table, registry)).select("reason", "record_count")


@query(
    "insufficient_data",
    "B18 F9 X6",
    """SELECT 'insufficient' AS kind, 'segment_ranking:n_name' AS analysis,
    (SELECT count(*) FROM (SELECT n_name FROM nation GROUP BY 1 HAVING count(*) >= 2)) AS available,
    2::BIGINT AS required, 'eligible_segments' AS unit""",
)
def insufficient_data(spark, folder):
    table = load(spark, folder, "nation", "n_nationkey")
    registry = K.Registry((K.source_kpi("n_regionkey", "mean"),), None, ("n_name",))
    found = issues(Battery(table, registry, numeric_columns=["n_regionkey", "n_nationkey"]))
    return found.select(F.lit("insufficient").alias("kind"), "analysis", "available", "required", "unit")


@query("insufficient_warnings", "B18")
def insufficient_warnings_query(spark, folder):
    table = load(spark, folder, "region", "r_regionkey")
    registry = K.Registry((K.source_kpi("r_regionkey", "mean"),), None, ("r_name",))
    out = insufficient_warnings(Battery(table, registry))
    return out.select("metric", "reason", "issue_count", F.to_json("issues").alias("issues"))


@query("insights", "B22 B23 M18 X6")
def insights(spark, folder):
    """The whole battery in emission order."""
    battery = lineitem_battery(spark, folder)
    out = build_insights(battery, missing_counts(battery.table))
    return out.select(
        "id", "metric", "type", "observation",
        F.array_join("source_columns", ",").alias("source_columns"),
        F.array_join("periods", ",").alias("periods"), "record_count", "confidence",
        F.round("impact", 6).alias("impact"),
    )


#: Number of each finding type that the oracle compares, what tells findings of it apart, and the
#: digits of the oracle it is taken from.
_NUMBERS = {
    "metric_snapshot": ("metric_snapshot", "current_value", None, 2),
    "period_change": ("period_change", "absolute_change", None, 4),
    "period_baseline_comparison": ("period_baseline", "baseline_value", None, 1),
    "trend": ("trend", "slope_per_period", None, 2),
    "period_target_comparison": ("period_target", "missed_period_count", None, 0),
    "numeric_correlation": ("numeric_correlation", "coefficient", "associated_metric", 6),
}


@query(
    "insight_numbers",
    "B22 B23 M18 X6",
    " UNION ALL ".join(
        f"SELECT metric, '{kind}' AS type, {label or 'NULL'} AS label, {number}::DOUBLE AS number FROM ({ORACLE[source]})"
        for kind, (source, number, label, _) in _NUMBERS.items()
    ),
)
def insight_numbers(spark, folder):
    """One number of every finding of the battery, whichever frame it came through."""
    battery = lineitem_battery(spark, folder)
    out = build_insights(battery, missing_counts(battery.table)).where(F.col("type").isin(*_NUMBERS))
    number, label = F.lit(None).cast("double"), F.lit(None).cast("string")
    for kind, (_, name, told, digits) in _NUMBERS.items():
        here = F.col("type") == kind
        number = F.when(here, F.round(F.get_json_object("observation", f"$.{name}").cast("double"), digits)).otherwise(number)
        if told:
            label = F.when(here, F.get_json_object("observation", f"$.{told}")).otherwise(label)
    return shown(out.select("metric", "type", label.alias("label"), number.alias("number")), 6)


@query(
    "insight_missing_data",
    "B1 E1",
    """WITH r AS (SELECT CASE WHEN l_tax > 0.05 THEN NULL ELSE l_tax END AS tax,
      CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END AS line FROM lineitem)
    SELECT 'missing_data_warning' AS type, 'tax' AS "column", count(*) - count(tax) AS missing_count,
      round((count(*) - count(tax)) * 100.0 / count(*), 4)::DOUBLE AS missing_percentage FROM r
    UNION ALL SELECT 'missing_data_warning', 'line', count(*) - count(line), round((count(*) - count(line)) * 100.0 / count(*), 4)::DOUBLE FROM r""",
)
def insight_missing_data(spark, folder):
    """The support rows of the completeness finding."""
    table = load(spark, folder, "lineitem")
    df = table.df.select(
        "l_orderkey", "l_quantity",
        F.when(F.col("l_tax") <= 0.05, F.col("l_tax")).alias("tax"),
        F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")).alias("line"),
    )
    battery = Battery(Table(df), K.Registry((K.source_kpi("l_quantity", "sum"),), None, ()))
    rows = _support(battery).where("type = 'missing_data_warning'")
    field = lambda name: F.get_json_object("row", f"$.{name}")
    out = rows.select(
        "type", field("column").alias("column"), field("missing_count").cast("long").alias("missing_count"),
        field("missing_percentage").cast("double").alias("missing_percentage"),
    )
    return shown(out, 4)


@query(
    "support_outliers",
    "E1 E8 B15",
    f"""WITH {_EVENT_BOUNDS} SELECT 'iqr_anomaly_detection' AS type, event_id AS row_key, round(value, 4) AS value, true AS is_outlier
    FROM events, b WHERE value < lo OR value > hi""",
)
def support_outliers(spark, folder):
    rows = _support(events_battery(spark, folder)).where("type = 'iqr_anomaly_detection'")
    field = lambda name: F.get_json_object("row", f"$.{name}")
    out = rows.select(
        "type", field("row_key").cast("long").alias("row_key"), field("value").cast("double").alias("value"),
        field("is_outlier").cast("boolean").alias("is_outlier"),
    )
    return shown(out, 4)


_ROWS = {
    "segment_ranking": ("segment_ranking", "value", "segment", 4),
    "segment_share": ("segment_share", "share_percentage", "segment", 6),
    "cohort_period_comparison": ("cohort_comparison", "current_record_count", "segment", 0),
    "segment_contribution": ("segment_contribution", "absolute_change", "segment", 4),
    "numeric_correlation": ("correlation_sums", "pair_count", "associated_metric", 0),
}


@query(
    "support_numbers",
    "E1 E8 E14 J1 X1",
    " UNION ALL ".join(
        f"SELECT metric, '{kind}' AS type, {label} AS label, {number}::DOUBLE AS number FROM ({ORACLE[source]})"
        for kind, (source, number, label, _) in _ROWS.items()
    ),
)
def support_numbers(spark, folder):
    """One number of every support row of the segment, cohort and correlation findings."""
    out = _support(lineitem_battery(spark, folder)).where(F.col("type").isin(*_ROWS))
    field = lambda name: F.get_json_object("row", f"$.{name}")
    number, label = F.lit(None).cast("double"), F.lit(None).cast("string")
    for kind, (_, name, told, digits) in _ROWS.items():
        here = F.col("type") == kind
        number = F.when(here, F.round(field(name).cast("double"), digits)).otherwise(number)
        label = F.when(here, field(told)).otherwise(label)
    return shown(out.select(field("metric").alias("metric"), "type", label.alias("label"), number.alias("number")), 6)


def _support(battery):
    return support_rows(battery, missing_counts(battery.table))


def _evidence(spark, folder):
    battery = lineitem_battery(spark, folder)
    return battery, E.build_evidence(build_insights(battery, missing_counts(battery.table)), "lineitem")


@query("evidence_ranking", "E1 E2 E3 E4 E5 E6 E7 E16 W4")
def evidence_ranking(spark, folder):
    _, evidence = _evidence(spark, folder)
    return evidence.select(
        "evidence_id", "insight_id", "metric", "type", "kind", "section", "calculation",
        "record_count", "impact", "confidence_score", "relevance", "combined", "rank",
    )


_SCORED = f"""p AS ({_P}), {_LAST_TWO},
    s AS (SELECT 'period_change' AS type, cur.metric, least(1, abs((cur.value - prev.value) / prev.value)) AS impact,
      1.0 AS relevance FROM cur JOIN prev USING (metric)
    UNION ALL SELECT 'segment_ranking:' || category_column, metric,
      (max(abs(value)) - min(abs(value))) / greatest(max(abs(value)), 1), 0.9 FROM ({_S}) GROUP BY metric, category_column)"""


@query(
    "evidence_scores",
    "E3 E4 E5",
    f"""WITH {_SCORED} SELECT type, metric, round(impact, 6) AS impact, round(relevance, 6)::DOUBLE AS relevance,
    1.0::DOUBLE AS confidence_score, round(0.5 * impact + 0.2 + 0.3 * relevance, 6) AS combined FROM s""",
)
def evidence_scores(spark, folder):
    _, evidence = _evidence(spark, folder)
    rows = evidence.where(F.col("type").isin("period_change", "segment_ranking"))
    label = F.when(
        F.col("type") == "segment_ranking",
        F.concat("type", F.lit(":"), F.get_json_object("observation", "$.category_column")),
    ).otherwise(F.col("type"))
    out = rows.select(
        label.alias("type"), "metric", "impact", "relevance", "confidence_score", "combined"
    )
    return shown(out, 6)


@query("evidence_sections", "E7 E15")
def evidence_sections(spark, folder):
    _, evidence = _evidence(spark, folder)
    return E.sectioned(evidence).select(
        "section_position", "section_label", "position_in_section", "metric", "type", "rank"
    )


@query("recommended_evidence", "T10 E6")
def recommended_evidence(spark, folder):
    _, evidence = _evidence(spark, folder)
    return E.recommended(evidence, E.MAX_DEFAULT_EVIDENCE, E.MAX_DEFAULT_ASSOCIATIONS).select("position", "metric", "type", "kind", "rank")


@query("support_rows", "E1 E14")
def support_rows_query(spark, folder):
    return _support(lineitem_battery(spark, folder))


@query("report_package", "T11 J4 M19 E14")
def report_package(spark, folder):
    battery, evidence = _evidence(spark, folder)
    out = E.package(evidence, _support(battery))
    return out.withColumn("support_rows", F.to_json("support_rows"))


@query("story_groups", "W11 E13 E17")
def story_groups(spark, folder):
    _, evidence = _evidence(spark, folder)
    chosen = E.recommended(evidence, E.MAX_DEFAULT_EVIDENCE, E.MAX_DEFAULT_ASSOCIATIONS)
    return E.stories(chosen, E.MAX_STORIES).withColumn("evidence_ids", F.array_join("evidence_ids", "|"))


@query("finding_chart_rows", "E8")
def finding_chart_rows(spark, folder):
    return E.finding_charts(_support(lineitem_battery(spark, folder)), 20)


@query(
    "unknown_selection_ids",
    "J4",
    """SELECT DISTINCT l.doc_id FROM labels l WHERE l.toxic = 1
       AND l.doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')""",
)
def unknown_selection_ids(spark, folder):
    selected = load(spark, folder, "labels").df.where("toxic = 1")
    known = load(spark, folder, "documents").df.where("lang = 'en'")
    return E.unknown_selections(selected, known, "doc_id")


@query(
    "stale_chart_insights",
    "J5 M17",
    """SELECT l.doc_id AS visualization_id, sha256(d.text) AS sha256 FROM labels l
       JOIN documents d USING (doc_id) WHERE l.quality = 1""",
)
def stale_chart_insights(spark, folder):
    docs = load(spark, folder, "documents").df
    labels = load(spark, folder, "labels").df
    charts = docs.select(F.col("doc_id").alias("visualization_id"), F.sha2("text", 256).alias("sha256"))
    # A low-quality label stands for an insight made from an older chart.
    made = labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("visualization_id"),
        F.sha2(F.when(F.col("quality") == 1, F.col("text")).otherwise("old"), 256).alias("sha256"),
    )
    return E.current_chart_insights(made, charts)


@query(
    "foreign_evidence",
    "J6 X3",
    """SELECT source, count(*) AS evidence_count FROM documents
       WHERE source NOT IN (SELECT source FROM documents GROUP BY source
                            HAVING avg(n_chars) > (SELECT avg(n_chars) FROM documents))
       GROUP BY source""",
)
def foreign_evidence(spark, folder):
    docs = load(spark, folder, "documents").df
    overall = docs.agg(F.avg("n_chars")).scalar()
    means = docs.groupBy("source").agg(F.avg("n_chars").alias("_m"))
    chosen = means.where(F.col("_m") > overall)
    evidence = docs.select(F.col("source").alias("metric_id"))
    out = E.foreign_evidence(evidence, chosen.select(F.col("source").alias("metric_id")))
    return out.groupBy(F.col("metric_id").alias("source")).agg(F.count("*").alias("evidence_count"))


@query(
    "missing_chart_kpis",
    "J7",
    """SELECT visualization_id, string_agg(metric_id, ',' ORDER BY metric_id) AS missing_metrics
       FROM (SELECT DISTINCT o_custkey AS visualization_id, o_orderpriority AS metric_id FROM orders
             WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) GROUP BY visualization_id""",
)
def missing_chart_kpis(spark, folder):
    orders = load(spark, folder, "orders").df
    selector = F.concat(F.lit("metric:"), "o_orderpriority")
    charts = orders.groupBy(F.col("o_custkey").alias("visualization_id")).agg(
        F.collect_set(selector).alias("measures")  # at most five priorities
    )
    chosen = orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    chosen = chosen.select(F.col("o_orderpriority").alias("metric_id")).distinct()
    out = E.missing_chart_kpis(charts, chosen)
    return out.withColumn("missing_metrics", F.array_join("missing_metrics", ","))


@query(
    "latest_saved_charts",
    "T14",
    """SELECT o_orderkey AS visualization_id, strftime(o_orderdate, '%Y-%m-%d') AS updated
       FROM orders WHERE o_orderpriority = '1-URGENT'""",
)
def latest_saved_charts(spark, folder):
    charts = load(spark, folder, "orders").df.select(
        F.col("o_orderkey").alias("visualization_id"),
        F.col("o_orderpriority").alias("source_sha256"),
        F.col("o_orderdate").alias("updated_at"),
    )
    out = E.latest_charts(charts, "1-URGENT")
    return out.select("visualization_id", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))
