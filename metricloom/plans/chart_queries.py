"""Chart-data, board and chart-fact queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions.values import Table
from metricloom.operators import board as B
from metricloom.operators import chart_facts as X
from metricloom.operators import kpi as K
from metricloom.operators.charts import (
    ChartSpec,
    chart_data,
    classification,
    guards,
    resolve_measures,
    unknown_filter_values,
)
from metricloom.plans.registry import load, query, shown

_DROP = ("measure_position", "measure_selector")


def _registry() -> K.Registry:
    return K.Registry(
        (
            K.source_kpi("l_extendedprice", "sum"),
            K.formula_kpi("unit_price", "SUM([l_extendedprice]) / SUM([l_quantity])", "aggregate"),
            K.rate_kpi("returns", "l_returnflag", ["R"]),
        ),
        "l_shipdate",
        ("l_returnflag", "l_linestatus"),
    )


@query(
    "chart_time_line",
    "C4 C2 T3 M10",
    """SELECT strftime(l_shipdate, '%Y-%m') AS x, l_returnflag AS series, 'l_extendedprice' AS measure,
       'sum' AS aggregation, round(sum(l_extendedprice), 2) AS value, count(*) AS record_count
       FROM lineitem GROUP BY ALL""",
)
def chart_time_line(spark, folder):
    spec = ChartSpec(
        "time_line", ("column:l_extendedprice",), "l_shipdate", "l_returnflag", aggregation="sum"
    )
    out = chart_data(load(spark, folder, "lineitem"), spec)
    return shown(out.drop(*_DROP), 2)


@query(
    "chart_time_measures",
    "C4 C2 A11",
    """SELECT year(l_shipdate) || '-Q' || quarter(l_shipdate) AS x, m AS measure,
       round(CASE m WHEN 'l_extendedprice' THEN sum(l_extendedprice) WHEN 'unit_price' THEN sum(l_extendedprice) / sum(l_quantity)
       ELSE count(*) END, 2) AS value, count(*) AS record_count
       FROM lineitem, (VALUES ('l_extendedprice'), ('unit_price'), ('Record count')) t(m) GROUP BY x, m""",
)
def chart_time_measures(spark, folder):
    registry = _registry()
    picks = tuple(f"metric:{k.metric_id}" for k in registry.kpis[:2]) + ("count:records",)
    spec = ChartSpec("time_line", picks, "l_shipdate", granularity="quarter")
    out = chart_data(load(spark, folder, "lineitem"), spec, registry)
    return shown(out.select("x", "measure", "value", "record_count"), 2)


@query(
    "chart_area_stacked",
    "C4 J8",
    """WITH g AS (SELECT strftime(ts, '%Y-%m-%d') AS x, event_type AS series, sum(value) AS v, count(*) AS n FROM events GROUP BY ALL)
    SELECT x, series, round(coalesce(v, 0), 4) AS value, coalesce(n, 0) AS record_count
    FROM (SELECT DISTINCT x FROM g) CROSS JOIN (SELECT DISTINCT series FROM g) LEFT JOIN g USING (x, series)""",
)
def chart_area_stacked(spark, folder):
    spec = ChartSpec(
        "time_area_stacked", ("column:value",), "ts", "event_type", aggregation="sum",
        granularity="day",
    )
    out = chart_data(load(spark, folder, "events"), spec)
    return shown(out.select("x", "series", "value", "record_count"), 4)


@query(
    "chart_category_top",
    "C5 T1 T2 C2 A11",
    """WITH g AS (SELECT p_brand AS x, avg(p_retailprice) AS value, count(*) AS record_count,
       min(p_partkey) AS f FROM part GROUP BY 1)
    SELECT x, round(value, 4) AS value, record_count,
    row_number() OVER (ORDER BY value DESC, f) AS x_position FROM g QUALIFY x_position <= 10""",
)
def chart_category_top(spark, folder):
    spec = ChartSpec("category_bar", ("column:p_retailprice",), "p_brand")
    out = chart_data(load(spark, folder, "part", "p_partkey"), spec)
    return shown(out.select("x", "value", "record_count", "x_position"), 4)


@query(
    "chart_category_label_sort",
    "C5 T2",
    """SELECT c_mktsegment AS x, round(sum(c_acctbal), 2) AS value,
       row_number() OVER (ORDER BY lower(c_mktsegment)) AS x_position FROM customer GROUP BY 1 QUALIFY x_position <= 3""",
)
def chart_category_label_sort(spark, folder):
    spec = ChartSpec(
        "category_bar_horizontal", ("column:c_acctbal",), "c_mktsegment", aggregation="sum",
        sort_by="label", descending=False, top_n=3,
    )
    out = chart_data(load(spark, folder, "customer"), spec)
    return shown(out.select("x", "value", "x_position"), 2)


@query(
    "chart_category_source_sort",
    "C5 T2 T9",
    """WITH g AS (SELECT o_orderpriority AS x, count(*) AS value, min(o_orderkey) AS f FROM orders GROUP BY 1)
       SELECT x, value::DOUBLE AS value, row_number() OVER (ORDER BY f) AS x_position FROM g""",
)
def chart_category_source_sort(spark, folder):
    spec = ChartSpec("category_bar", ("count:records",), "o_orderpriority", sort_by="source")
    out = chart_data(load(spark, folder, "orders", "o_orderkey"), spec)
    return shown(out.select("x", "value", "x_position"), 2)


@query(
    "chart_category_stacked",
    "C5 J8",
    """WITH g AS (SELECT p_type AS x, p_brand AS series, count(*) AS v FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY ALL),
    t AS (SELECT x, max(v) AS m, row_number() OVER (ORDER BY max(v) DESC, lower(x), x) AS x_position FROM g GROUP BY x QUALIFY x_position <= 4)
    SELECT x, series, coalesce(v, 0)::DOUBLE AS value, x_position
    FROM t CROSS JOIN (SELECT DISTINCT series FROM g JOIN t USING (x)) LEFT JOIN g USING (x, series)""",
)
def chart_category_stacked(spark, folder):
    spec = ChartSpec(
        "category_bar_stacked", ("count:records",), "p_type", "p_brand", top_n=4,
        filter_column="p_brand", filter_values=("Brand#1", "Brand#2", "Brand#3"),
    )
    out = chart_data(load(spark, folder, "part"), spec)
    return shown(out.select("x", "series", "value", "x_position"), 2)


@query(
    "chart_filters",
    "F3 F4 F5 F6 C2",
    """SELECT l_linestatus AS x, round(avg(l_quantity), 4) AS value, count(*) AS record_count FROM lineitem
       WHERE (l_returnflag IS NULL OR l_returnflag <> 'A')
       AND l_shipdate::DATE BETWEEN DATE '1996-03-05' AND DATE '1998-11-20' GROUP BY 1""",
)
def chart_filters(spark, folder):
    spec = ChartSpec(
        "category_bar", ("column:l_quantity",), "l_linestatus", filter_column="l_returnflag",
        filter_mode="exclude", filter_values=("A",), date_start="1996-03-05",
        date_end="1998-11-20", date_column="l_shipdate",
    )
    out = chart_data(load(spark, folder, "lineitem"), spec)
    return shown(out.select("x", "value", "record_count"), 4)


@query(
    "chart_exclude_keeps_missing",
    "F4",
    """SELECT count(*) AS kept FROM orders WHERE NOT coalesce(nullif(o_orderpriority, '5-LOW') IN ('1-URGENT'), false)""",
)
def chart_exclude_keeps_missing(spark, folder):
    df = load(spark, folder, "orders").df
    table = Table(df.withColumn("p", F.nullif("o_orderpriority", F.lit("5-LOW"))))
    from metricloom.operators.charts import filter_rows

    spec = ChartSpec(
        "scorecard", ("count:records",), filter_column="p", filter_mode="exclude",
        filter_values=("1-URGENT",),
    )
    return filter_rows(table, spec).agg(F.count("*").alias("kept"))


@query(
    "chart_unknown_filter_values",
    "F7",
    "SELECT v AS value FROM (VALUES ('R'), ('Z')) t(v) WHERE v NOT IN (SELECT l_returnflag FROM lineitem)",
)
def chart_unknown_filter_values(spark, folder):
    spec = ChartSpec(
        "category_bar", ("count:records",), "l_linestatus", filter_column="l_returnflag",
        filter_values=("R", "Z"),
    )
    return unknown_filter_values(load(spark, folder, "lineitem"), spec)


@query(
    "chart_guards",
    "F8",
    """SELECT 'too_many_series' AS problem FROM part HAVING count(DISTINCT p_brand) > 12""",
)
def chart_guards(spark, folder):
    spec = ChartSpec("category_bar", ("count:records",), "p_type", "p_brand", top_n=50)
    return guards(chart_data(load(spark, folder, "part"), spec), spec)


@query(
    "chart_pareto",
    "C6 W5",
    """WITH g AS (SELECT p_brand AS x, sum(p_retailprice) AS value FROM part GROUP BY 1 ORDER BY value DESC LIMIT 10)
    SELECT x, round(value, 2) AS value, round(value / sum(value) OVER () * 100, 5) AS individual_percentage,
    round(sum(value) OVER (ORDER BY value DESC) / sum(value) OVER () * 100, 5) AS cumulative_percentage FROM g""",
)
def chart_pareto(spark, folder):
    spec = ChartSpec("pareto", ("column:p_retailprice",), "p_brand", aggregation="sum")
    out = chart_data(load(spark, folder, "part", "p_partkey"), spec)
    return shown(
        out.select("x", "value", "individual_percentage", "cumulative_percentage"), 5, value=2
    )


@query(
    "chart_donut",
    "C7 W7",
    """SELECT p_type AS x, count(*)::DOUBLE AS value, round(100.0 * count(*) / sum(count(*)) OVER (), 5) AS share_percentage
       FROM part GROUP BY 1""",
)
def chart_donut(spark, folder):
    spec = ChartSpec("donut", ("count:records",), "p_type")
    out = chart_data(load(spark, folder, "part"), spec)
    return shown(out.select("x", "value", "share_percentage"), 5)


@query(
    "chart_scatter",
    "C8 J3",
    "SELECT p_partkey AS row_key, p_size::DOUBLE AS x, p_retailprice AS y, p_type AS series FROM part",
)
def chart_scatter(spark, folder):
    spec = ChartSpec("scatter", ("column:p_retailprice",), "p_size", "p_type")
    return chart_data(load(spark, folder, "part", "p_partkey"), spec)


_HISTOGRAM = """WITH s AS (SELECT min({c}) AS lo, max({c}) AS hi FROM {t}),
    b AS (SELECT least(floor(({c} - lo) / ((hi - lo) / {n})), {n} - 1)::BIGINT AS bin, count(*) AS c FROM {t}, s GROUP BY 1)
    SELECT g.bin, round(lo + g.bin * ((hi - lo) / {n}), 4) AS bin_start,
    round(lo + (g.bin + 1) * ((hi - lo) / {n}), 4) AS bin_end, coalesce(b.c, 0) AS count
    FROM (SELECT unnest(range(0, {n}))::BIGINT AS bin) g CROSS JOIN s LEFT JOIN b ON b.bin = g.bin"""


@query(
    "chart_histogram",
    "C9 A12",
    _HISTOGRAM.format(c="c_acctbal", t="customer", n=20),
)
def chart_histogram(spark, folder):
    spec = ChartSpec("histogram", ("column:c_acctbal",), bins=20)
    return shown(chart_data(load(spark, folder, "customer"), spec), 4)


_BOX = """WITH q AS (SELECT {g} AS x, min({v}) AS minimum, quantile_cont({v}, 0.25) AS q1, median({v}) AS median,
    quantile_cont({v}, 0.75) AS q3, max({v}) AS maximum, count({v}) AS count FROM {t} GROUP BY 1),
    w AS (SELECT q.x, min({v}) FILTER (WHERE {v} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS lower_whisker,
    max({v}) FILTER (WHERE {v} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS upper_whisker,
    count(*) FILTER (WHERE {v} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outlier_count
    FROM {t} JOIN q ON q.x = {g} GROUP BY q.x)
    SELECT x, round(minimum, 4) AS minimum, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
    round(maximum, 4) AS maximum, count, round(lower_whisker, 4) AS lower_whisker,
    round(upper_whisker, 4) AS upper_whisker, outlier_count FROM q JOIN w USING (x)"""


@query("chart_box", "C10 A13 A14", _BOX.format(g="event_type", v="value", t="events"))
def chart_box(spark, folder):
    spec = ChartSpec("box", ("column:value",), "event_type")
    out = chart_data(load(spark, folder, "events"), spec)
    return shown(out.drop("lower_fence", "upper_fence"), 4)


@query(
    "chart_heatmap",
    "C11 J8",
    """WITH g AS (SELECT o_orderpriority AS x, o_orderstatus AS series, avg(o_totalprice) AS v FROM orders GROUP BY ALL)
    SELECT x, series, round(v, 4) AS value FROM (SELECT DISTINCT x FROM g) CROSS JOIN (SELECT DISTINCT series FROM g)
    LEFT JOIN g USING (x, series)""",
)
def chart_heatmap(spark, folder):
    spec = ChartSpec("heatmap", ("column:o_totalprice",), "o_orderpriority", "o_orderstatus")
    out = chart_data(load(spark, folder, "orders"), spec)
    return shown(out.select("x", "series", "value"), 4)


@query(
    "chart_waterfall",
    "C12 W6",
    """WITH g AS (SELECT c_mktsegment AS x, sum(c_acctbal) AS value FROM customer GROUP BY 1)
    SELECT x, round(value, 2) AS value, round(sum(value) OVER (ORDER BY lower(x)), 2) AS end_value,
    round(sum(value) OVER (ORDER BY lower(x)) - value, 2) AS start_value FROM g""",
)
def chart_waterfall(spark, folder):
    spec = ChartSpec(
        "waterfall", ("column:c_acctbal",), "c_mktsegment", aggregation="sum", sort_by="label",
        descending=False,
    )
    out = chart_data(load(spark, folder, "customer"), spec)
    return shown(out.select("x", "value", "end_value", "start_value"), 2)


@query(
    "chart_funnel",
    "C13",
    """SELECT event_type AS x, count(*)::DOUBLE AS value,
       round(100.0 * count(*) / max(count(*)) OVER (), 5) AS percentage_of_maximum FROM events GROUP BY 1""",
)
def chart_funnel(spark, folder):
    spec = ChartSpec("funnel", ("count:records",), "event_type")
    out = chart_data(load(spark, folder, "events"), spec)
    return shown(out.select("x", "value", "percentage_of_maximum"), 5)


@query(
    "chart_combo",
    "C14",
    """SELECT l_returnflag AS x, round(sum(l_extendedprice), 2) AS primary_value,
       round(sum(l_extendedprice) / sum(l_quantity), 2) AS secondary_value, count(*) AS record_count FROM lineitem GROUP BY 1""",
)
def chart_combo(spark, folder):
    registry = _registry()
    picks = tuple(f"metric:{k.metric_id}" for k in registry.kpis[:2])
    out = chart_data(load(spark, folder, "lineitem"), ChartSpec("combo", picks, "l_returnflag"), registry)
    return shown(out.select("x", "primary_value", "secondary_value", "record_count"), 2)


@query(
    "chart_scorecard",
    "C15 E12",
    """SELECT 'returns' AS measure, round(100.0 * count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 6) AS value,
       count(*) AS record_count, 'kpi' AS classification FROM lineitem""",
)
def chart_scorecard(spark, folder):
    registry = _registry()
    spec = ChartSpec("scorecard", (f"metric:{registry.kpis[2].metric_id}",))
    out = chart_data(load(spark, folder, "lineitem"), spec, registry)
    kind = classification(resolve_measures(spec, registry))
    return shown(out.select("measure", "value", "record_count", F.lit(kind).alias("classification")), 6)


# ---- board -------------------------------------------------------------------


@query(
    "board_column",
    "C16 T5",
    """WITH g AS (SELECT p_brand AS x, sum(p_retailprice) AS y, count(*) AS record_count, min(p_partkey) AS f FROM part GROUP BY 1)
    SELECT x, round(y, 2) AS y, record_count, row_number() OVER (ORDER BY abs(y) DESC, f) AS position,
    count(*) OVER () AS group_count, count(*) OVER () > 16 AS truncated FROM g QUALIFY position <= 16""",
)
def board_column(spark, folder):
    out = B.grouped(load(spark, folder, "part", "p_partkey"), "column", "p_brand", "p_retailprice", B.MAX_GROUPS)
    return shown(out.drop("total_records"), 2)


@query(
    "board_table_all",
    "C16 T5",
    """WITH g AS (SELECT p_name AS x, sum(p_retailprice) AS y, count(*) AS record_count, min(p_partkey) AS f FROM part GROUP BY 1)
    SELECT x, round(y, 2) AS y, record_count, row_number() OVER (ORDER BY abs(y) DESC, f) AS position,
    count(*) OVER () AS group_count, false AS truncated FROM g""",
)
def board_table_all(spark, folder):
    out = B.grouped(load(spark, folder, "part", "p_partkey"), "table", "p_name", "p_retailprice")
    return shown(out.drop("total_records"), 2)


@query(
    "board_pie",
    "C16 T5",
    """WITH g AS (SELECT p_brand AS x, count(*)::DOUBLE AS y, min(p_partkey) AS f FROM part GROUP BY 1)
    SELECT x, y, row_number() OVER (ORDER BY abs(y) DESC, f) AS position FROM g QUALIFY position <= 8""",
)
def board_pie(spark, folder):
    out = B.grouped(load(spark, folder, "part", "p_partkey"), "pie", "p_brand", limit=B.MAX_PIE_GROUPS)
    return shown(out.select("x", "y", "position"), 2)


@query(
    "board_line",
    "C16 T5",
    """SELECT strftime(ts, '%Y-%m-%d') AS x, round(sum(value), 4) AS y, count(*) AS record_count FROM events
       GROUP BY 1 ORDER BY x LIMIT 16""",
)
def board_line(spark, folder):
    out = B.grouped(load(spark, folder, "events", "event_id"), "line", "ts", "value", B.MAX_GROUPS)
    return shown(out.select("x", "y", "record_count"), 4)


@query(
    "board_waterfall",
    "C16 T5 W6",
    """WITH g AS (SELECT c_mktsegment AS x, sum(c_acctbal) AS y, min(c_custkey) AS f FROM customer GROUP BY 1)
    SELECT x, round(y, 2) AS y, round(sum(y) OVER (ORDER BY f), 2) AS end_value FROM g""",
)
def board_waterfall(spark, folder):
    table = load(spark, folder, "customer", "c_custkey")
    out = B.grouped(table, "waterfall", "c_mktsegment", "c_acctbal")
    return shown(out.select("x", "y", "end_value"), 2)


@query(
    "board_pareto",
    "C16 W5",
    """WITH g AS (SELECT o_orderpriority AS x, sum(o_totalprice) AS y FROM orders GROUP BY 1)
    SELECT x, round(y, 2) AS y, round(sum(y) OVER (ORDER BY y DESC) / sum(y) OVER () * 100, 5) AS cumulative_percentage FROM g""",
)
def board_pareto(spark, folder):
    out = B.grouped(load(spark, folder, "orders", "o_orderkey"), "pareto", "o_orderpriority", "o_totalprice")
    return shown(out.select("x", "y", "cumulative_percentage"), 5, y=2)


_STACK = """WITH c AS (SELECT p_brand AS x, p_type AS series, sum(p_retailprice) AS y, min(p_partkey) AS f FROM part GROUP BY ALL),
    xs AS (SELECT x, row_number() OVER (ORDER BY sum(y) DESC, min(f)) AS xp FROM c GROUP BY x QUALIFY xp <= 12),
    ss AS (SELECT series, row_number() OVER (ORDER BY sum(y) DESC, min(f)) AS sp FROM c GROUP BY series QUALIFY sp <= 8),
    d AS (SELECT x, series, coalesce(y, 0) AS y, xp, sp FROM xs CROSS JOIN ss LEFT JOIN c USING (x, series))"""


@query(
    "board_stacked",
    "C17 T6 J8",
    _STACK + " SELECT x, series, round(y, 2) AS y, xp AS x_position, sp AS series_position,\n    (SELECT count(DISTINCT x) FROM c) AS x_count, (SELECT count(DISTINCT series) FROM c) AS series_count FROM d",
)
def board_stacked(spark, folder):
    table = load(spark, folder, "part", "p_partkey")
    out = B.stacked(table, "stacked_column", "p_brand", "p_retailprice", "p_type", B.MAX_STACK_GROUPS, B.MAX_STACK_SERIES)
    return shown(out, 2)


@query(
    "board_stacked_all",
    "C17 T6",
    """SELECT p_brand AS x, p_type AS series, round(sum(p_retailprice), 2) AS y FROM part GROUP BY ALL""",
)
def board_stacked_all(spark, folder):
    table = load(spark, folder, "part", "p_partkey")
    out = B.stacked(table, "grouped_column", "p_brand", "p_retailprice", "p_type")
    return shown(out.select("x", "series", "y"), 2)


@query(
    "board_scatter_all",
    "C19 T7",
    """SELECT p_partkey AS row_key, p_size::DOUBLE AS x, p_retailprice AS y FROM part""",
)
def board_scatter_all(spark, folder):
    out = B.points(load(spark, folder, "part", "p_partkey"), "p_size", "p_retailprice")
    return out.select("row_key", "x", "y")


@query("board_box_all", "C21 T8 A13", _BOX.format(g="p_type", v="p_retailprice", t="part"))
def board_box_all(spark, folder):
    out = B.box(load(spark, folder, "part"), "p_retailprice", "p_type")
    return shown(out.drop("lower_fence", "upper_fence"), 4)


@query(
    "board_stacked_percent",
    "C17 W8",
    _STACK + " SELECT x, series, round(y / sum(y) OVER (PARTITION BY x) * 100, 5) AS percentage FROM d",
)
def board_stacked_percent(spark, folder):
    table = load(spark, folder, "part", "p_partkey")
    out = B.stacked(table, "stacked_100_column", "p_brand", "p_retailprice", "p_type", B.MAX_STACK_GROUPS, B.MAX_STACK_SERIES)
    return shown(out.select("x", "series", "percentage"), 5)


@query(
    "board_stacked_problems",
    "C17 F8",
    """WITH c AS (SELECT l_returnflag AS x, l_linestatus AS s, sum(l_tax - l_discount) AS y FROM lineitem GROUP BY ALL)
    SELECT 'negative_values' AS problem FROM c HAVING min(y) < 0
    UNION ALL SELECT 'no_positive_value' FROM c HAVING max(y) <= 0""",
)
def board_stacked_problems(spark, folder):
    table = load(spark, folder, "lineitem")
    table = Table(table.df.withColumn("gap", F.col("l_tax") - F.col("l_discount")))
    return B.stacked_problems(table, "l_returnflag", "gap", "l_linestatus")


@query(
    "board_combo",
    "C18",
    """SELECT o_orderpriority AS x, round(sum(o_totalprice), 2) AS y, sum(o_custkey)::DOUBLE AS secondary_y,
       count(*) AS record_count, count(*) OVER () AS group_count FROM orders GROUP BY 1""",
)
def board_combo(spark, folder):
    out = B.combo(load(spark, folder, "orders"), "o_orderpriority", "o_totalprice", "o_custkey")
    return shown(out, 2)


@query(
    "board_scatter",
    "C19 T7",
    """SELECT p_partkey AS row_key, p_size::DOUBLE AS x, p_retailprice AS y, (SELECT count(*) FROM part) AS valid_count,
       (SELECT count(*) FROM part) > 250 AS truncated FROM part ORDER BY p_partkey LIMIT 250""",
)
def board_scatter(spark, folder):
    return B.points(load(spark, folder, "part", "p_partkey"), "p_size", "p_retailprice", limit=B.MAX_POINTS)


@query(
    "board_bubble",
    "C19 T7",
    """SELECT c_custkey AS row_key, c_nationkey::DOUBLE AS x, c_custkey::DOUBLE AS y, c_acctbal AS size,
       (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS valid_count FROM customer WHERE c_acctbal > 0
       ORDER BY c_custkey LIMIT 250""",
)
def board_bubble(spark, folder):
    table = load(spark, folder, "customer", "c_custkey")
    return B.points(table, "c_nationkey", "c_custkey", "c_acctbal", B.MAX_POINTS).drop("truncated")


@query(
    "board_gauge",
    "C20 E9",
    """SELECT 'o_totalprice' AS x, round(sum(o_totalprice), 2) AS y, count(*) AS record_count, 1e9::DOUBLE AS target,
       round(sum(o_totalprice) - 1e9, 2) AS gap_to_target, round(sum(o_totalprice) / 1e9 * 100, 6) AS percentage_of_target FROM orders""",
)
def board_gauge(spark, folder):
    return shown(B.card(load(spark, folder, "orders"), "o_totalprice", 1e9), 2, percentage_of_target=6)


@query("board_histogram", "C21 A12 M21", _HISTOGRAM.format(c="l_extendedprice", t="lineitem", n=10))
def board_histogram(spark, folder):
    return shown(B.bins(load(spark, folder, "lineitem"), "l_extendedprice").drop("label"), 4)


@query(
    "board_histogram_labels",
    "M21 C21",
    _HISTOGRAM.format(c="l_extendedprice", t="lineitem", n=10)
    .replace("SELECT g.bin, round(", "SELECT g.bin, printf('%.4g', ")
    .replace(", 4) AS bin_start,\n    round(", ") || '–' || printf('%.4g', ")
    .replace(", 4) AS bin_end", ") AS label"),
)
def board_histogram_labels(spark, folder):
    out = B.bins(load(spark, folder, "lineitem"), "l_extendedprice")
    return shown(out.select("bin", "label", "count"))


@query("board_box", "C21 T8 A13",
       _BOX.format(g="p_brand", v="p_retailprice", t="part").replace(
           "FROM q JOIN w USING (x)",
           "FROM q JOIN w USING (x) ORDER BY count DESC, x LIMIT 16"))
def board_box(spark, folder):
    out = B.box(load(spark, folder, "part"), "p_retailprice", "p_brand", B.MAX_GROUPS)
    return shown(out.drop("lower_fence", "upper_fence"), 4)


@query(
    "automatic_chart",
    "C22",
    """SELECT p_type AS x, 'column' AS chart, round(sum(p_retailprice), 2) AS y, count(*) AS record_count FROM part GROUP BY 1""",
)
def automatic_chart(spark, folder):
    """Chart chosen from profiled types, then its first points."""
    from metricloom.operators.profile import profile

    table = load(spark, folder, "part", "p_partkey")
    kinds = {r["column"]: r["inferred_type"] for r in profile(table).select("column", "inferred_type").collect()}
    chart = B.automatic_chart(kinds, "p_type", "p_retailprice")
    out = B.grouped(table, chart, "p_type", "p_retailprice").withColumn("chart", F.lit(chart))
    return shown(out.select("x", "chart", "y", "record_count"), 2)


# ---- facts -------------------------------------------------------------------


def _yearly(spark, folder):
    spec = ChartSpec(
        "time_line", ("column:o_totalprice",), "o_orderdate", "o_orderstatus", aggregation="sum",
        granularity="month",
    )
    return chart_data(load(spark, folder, "orders"), spec)


_MONTHS = """g AS (SELECT strftime(o_orderdate, '%Y-%m') AS x, o_orderstatus AS series, sum(o_totalprice) AS value
    FROM orders GROUP BY ALL)"""


@query(
    "fact_extremes",
    "E9 T9",
    f"""WITH {_MONTHS} SELECT 'o_totalprice' AS measure, arg_max(x, value) AS high_x, arg_max(series, value) AS high_series,
    round(max(value), 2) AS high_value, arg_min(x, value) AS low_x, arg_min(series, value) AS low_series,
    round(min(value), 2) AS low_value, count(*) AS record_count FROM g""",
)
def fact_extremes(spark, folder):
    out = X.extremes(_yearly(spark, folder), "x")
    return shown(
        out.select(
            "measure",
            F.col("highest.x").alias("high_x"),
            F.col("highest.series").alias("high_series"),
            F.col("highest.value").alias("high_value"),
            F.col("lowest.x").alias("low_x"),
            F.col("lowest.series").alias("low_series"),
            F.col("lowest.value").alias("low_value"),
            "record_count",
        ),
        2,
    )


@query(
    "fact_time_changes",
    "E9 W10",
    f"""WITH {_MONTHS}, c AS (SELECT series, min(x) AS first_period, arg_min(value, x) AS a, max(x) AS last_period,
    arg_max(value, x) AS b, count(*) AS record_count FROM g GROUP BY series HAVING count(*) >= 2)
    SELECT series, first_period, round(a, 2) AS first_value, last_period, round(b, 2) AS last_value,
    round(b - a, 2) AS absolute_change, round((b - a) / abs(a) * 100, 5) AS percentage_change, record_count FROM c""",
)
def fact_time_changes(spark, folder):
    out = X.time_changes(_yearly(spark, folder)).drop("measure", "division_by_zero")
    return shown(out, 2, percentage_change=5)


@query(
    "fact_movements",
    "W9 E10",
    f"""WITH {_MONTHS}, s AS (SELECT series, x, lag(x) OVER w AS p, value - lag(value) OVER w AS d FROM g
    WINDOW w AS (PARTITION BY series ORDER BY x))
    SELECT arg_max(series, d) AS gain_series, arg_max(x, d) AS gain_to, arg_max(p, d) AS gain_from, round(max(d), 2) AS gain,
    arg_min(series, d) AS drop_series, arg_min(x, d) AS drop_to, round(min(d), 2) AS "drop" FROM s WHERE d IS NOT NULL""",
)
def fact_movements(spark, folder):
    out = X.movements(_yearly(spark, folder))
    return shown(
        out.select(
            F.col("gain.series").alias("gain_series"),
            F.col("gain.to_x").alias("gain_to"),
            F.col("gain.from_x").alias("gain_from"),
            F.col("gain.movement").alias("gain"),
            F.col("drop.series").alias("drop_series"),
            F.col("drop.to_x").alias("drop_to"),
            F.col("drop.movement").alias("drop"),
        ),
        2,
    )


@query(
    "fact_association",
    "E9 A6",
    """SELECT 'numeric_association' AS type, round(corr(p_size, p_retailprice), 6) AS coefficient, false AS constant_input,
       count(*) AS record_count, 'high' AS confidence FROM part""",
)
def fact_association(spark, folder):
    spec = ChartSpec("scatter", ("column:p_retailprice",), "p_size")
    out = X.association(chart_data(load(spark, folder, "part"), spec))
    return shown(out.drop("reason"), 6)


@query(
    "fact_distribution",
    "E9 A5",
    """WITH r AS (SELECT value AS v, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events),
    h AS (SELECT median(v) FILTER (WHERE i <= ceil(n / 2.0)) AS q1, median(v) AS m,
          median(v) FILTER (WHERE i > floor(n / 2.0)) AS q3, count(*) AS n, min(v) AS lo, max(v) AS hi, avg(v) AS a FROM r)
    SELECT n AS record_count, round(lo, 6) AS minimum, round(q1, 6) AS q1, round(m, 6) AS median, round(q3, 6) AS q3,
    round(hi, 6) AS maximum, round(a, 6) AS mean,
    (SELECT count(*) FROM events, h h2 WHERE value < h2.q1 - 1.5 * (h2.q3 - h2.q1) OR value > h2.q3 + 1.5 * (h2.q3 - h2.q1)) AS outlier_count
    FROM h""",
)
def fact_distribution(spark, folder):
    out = X.distribution(load(spark, folder, "events").df.select("value"))
    return shown(out.drop("iqr", "lower_fence", "upper_fence"), 6)


@query(
    "fact_target",
    "E9 C20",
    """SELECT 'value' AS measure, round(sum(value), 4) AS current_value, round(sum(value) - 50000, 4) AS gap_to_target,
       round(sum(value) / 50000 * 100, 6) AS percentage_of_target, count(*) AS record_count FROM events""",
)
def fact_target(spark, folder):
    out = X.target_comparison(B.card(load(spark, folder, "events"), "value", 50000.0)).drop("target")
    return shown(out, 4, percentage_of_target=6)


@query(
    "fact_top_contribution",
    "E9 E10",
    """WITH g AS (SELECT p_brand AS x, sum(p_retailprice) AS v FROM part GROUP BY 1 ORDER BY v DESC LIMIT 10)
    SELECT 'p_retailprice' AS measure, arg_max(x, v) AS top_category, round(max(v), 2) AS top_value,
    round(max(v) / sum(v) * 100, 5) AS share_percentage, count(*) AS record_count FROM g""",
)
def fact_top_contribution(spark, folder):
    spec = ChartSpec("pareto", ("column:p_retailprice",), "p_brand", aggregation="sum")
    rows = chart_data(load(spark, folder, "part", "p_partkey"), spec)
    return shown(X.top_contribution(rows, "x_position"), 5, top_value=2)


@query(
    "fact_numbers",
    "E10",
    """WITH g AS (SELECT p_brand AS x, sum(p_retailprice) AS v FROM part GROUP BY 1 ORDER BY v DESC LIMIT 10),
    r AS (SELECT *, row_number() OVER (ORDER BY v DESC) AS i FROM g)
    SELECT count(*) AS point_count, round(sum(v), 2) AS total, round(max(v) - min(v), 2) AS gap,
    round(max(v) / sum(v) * 100, 5) AS top_share, round(sum(v) FILTER (WHERE i <= 3) / sum(v) * 100, 5) AS top_three_share,
    round(min(v) / max(v) * 100, 5) AS retention FROM r""",
)
def fact_numbers(spark, folder):
    spec = ChartSpec("category_bar", ("column:p_retailprice",), "p_brand", aggregation="sum")
    rows = chart_data(load(spark, folder, "part", "p_partkey"), spec)
    out = X.summary_numbers(rows, "x_position").drop("measure", "largest_positive", "largest_negative")
    return shown(out, 5, total=2, gap=2)


@query("chart_observations", "E9")
def chart_observations(spark, folder):
    return X.observations(_yearly(spark, folder), "time_line", "x", X.MAX_OBSERVATIONS)


@query("chart_findings", "E10 E11 T13 X5 M6")
def chart_findings(spark, folder):
    return X.findings(_yearly(spark, folder), "time_line", "x", "sum", X.MAX_FINDINGS)


def _numbers_as_text(sql: str) -> str:
    """Expand n(...) in oracle SQL to the short number text."""
    out, rest = "", sql
    while (at := rest.find(" n(")) >= 0:
        depth, end = 0, at + 2
        while True:
            depth += {"(": 1, ")": -1}.get(rest[end], 0)
            end += 1
            if not depth:
                break
        c = f"({rest[at + 3 : end - 1]})"
        out += rest[:at] + (
            f" (CASE WHEN abs({c}) >= 1e9 THEN printf('%.2fB', {c} / 1e9) WHEN abs({c}) >= 1e6 THEN printf('%.2fM', {c} / 1e6) "
            f"WHEN {c} = floor({c}) THEN format('{{:,}}', {c}::BIGINT) WHEN abs({c}) >= 1000 THEN format('{{:,.2f}}', {c}) ELSE printf('%.2f', {c}) END)"
        )
        rest = rest[end:]
    return out + rest


@query(
    "finding_sentences",
    "E11 M6",
    _numbers_as_text(
        """WITH g AS (SELECT o_orderpriority AS x, sum(o_totalprice) AS v FROM orders GROUP BY 1),
    f AS (SELECT max(v) - min(v) AS gap, arg_max(x, v) AS hi, arg_min(x, v) AS lo, max(v) AS top, min(v) AS low, sum(v) AS total,
      count(*) AS points, (SELECT sum(v) FROM (SELECT v FROM g ORDER BY v DESC LIMIT 3)) AS three FROM g)
    SELECT 'From ' || hi || ' down to ' || lo || ' the displayed values span ' || n(gap) || ' for o_totalprice.' AS finding FROM f
    UNION ALL SELECT 'o_totalprice peaks at ' || hi || ' with ' || n(top) || '; its smallest displayed value is at ' || lo || ' with ' || n(low) || '.' FROM f
    UNION ALL SELECT 'Together the displayed values of o_totalprice make ' || n(total) || ' over ' || points || ' points.' FROM f
    UNION ALL SELECT hi || ' alone holds ' || n(top / total * 100) || '% of what is displayed of o_totalprice.' FROM f
    UNION ALL SELECT 'The top three points hold ' || n(three / total * 100) || '% of what is displayed of o_totalprice.' FROM f"""
    ),
)
def finding_sentences(spark, folder):
    spec = ChartSpec("category_bar", ("column:o_totalprice",), "o_orderpriority", aggregation="sum")
    rows = chart_data(load(spark, folder, "orders"), spec)
    return X.findings(rows, "category_bar", "x_position", "sum").select("finding")


@query(
    "kind_sentences",
    "E11 M6",
    _numbers_as_text(
        """WITH q AS (SELECT sum(value) AS v, count(*) AS c FROM events)
    SELECT 'value stands at ' || n(v) || ', ' || CASE WHEN v > 50000 THEN '+' ELSE '-' END || n(abs(v - 50000)) || ' against a target of ' || n(50000) || '.' AS finding FROM q
    UNION ALL SELECT 'The ' || count(*) || ' displayed pairs correlate at ' || n(corr(p_size, p_retailprice)) || '.' FROM part"""
    ),
)
def kind_sentences(spark, folder):
    """Sentences about a target and about a scatter."""
    target = X.target_comparison(B.card(load(spark, folder, "events"), "value", 50000.0))
    spec = ChartSpec("scatter", ("column:p_retailprice",), "p_size")
    pairs = X.association(chart_data(load(spark, folder, "part"), spec))
    return X.target_sentences(target).unionByName(X.association_sentences(pairs))
