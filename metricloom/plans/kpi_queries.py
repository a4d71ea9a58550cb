"""Queries over KPI definitions, formulas and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions import values as V
from metricloom.functions.frames import union_all
from metricloom.operators import kpi as K
from metricloom.operators.quantiles import exact_quantiles
from metricloom.plans.registry import load, query, shown


@query(
    "source_kpi_aggregations",
    "K1 A1 A2 A3",
    """SELECT l_returnflag, count(*) AS record_count,
       round(sum(l_quantity), 2) AS qty_sum, round(avg(l_quantity), 4) AS qty_mean,
       round(median(l_quantity), 4) AS qty_median, min(l_quantity) AS qty_min,
       max(l_quantity) AS qty_max
       FROM lineitem GROUP BY l_returnflag""",
)
def source_kpi_aggregations(spark, folder):
    table = load(spark, folder, "lineitem")
    kpis = [K.Kpi(f"qty_{name}", "source", name, column="l_quantity") for name in K.AGGREGATIONS]
    values = K.evaluate(table, kpis, ["l_returnflag"])
    return shown(values, 4, qty_sum=2)


@query(
    "formula_row_kpi",
    "K2 K18",
    """SELECT l_linestatus, count(*) AS record_count,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS net,
       round(avg(abs(l_tax - l_discount) * 100), 4) AS spread
       FROM lineitem GROUP BY l_linestatus""",
)
def formula_row_kpi(spark, folder):
    kpis = [
        K.formula_kpi("net", "[l_extendedprice] * (1 - [l_discount])", "row", "sum"),
        K.formula_kpi("spread", "ABS([l_tax] - [l_discount]) * 100", "row", "mean"),
    ]
    return shown(K.evaluate(load(spark, folder, "lineitem"), kpis, ["l_linestatus"]), 4, net=2)


@query(
    "formula_aggregate_kpi",
    "K3",
    """SELECT l_returnflag, l_linestatus, count(*) AS record_count,
       round(sum(l_extendedprice) / sum(l_quantity), 6) AS unit_price,
       round((max(l_extendedprice) - min(l_extendedprice)) / median(l_quantity), 6) AS spread,
       round(-avg(l_discount) + count(l_tax), 6) AS mixed
       FROM lineitem GROUP BY ALL""",
)
def formula_aggregate_kpi(spark, folder):
    kpis = [
        K.formula_kpi("unit_price", "SUM([l_extendedprice]) / SUM([l_quantity])", "aggregate"),
        K.formula_kpi(
            "spread",
            "(MAX([l_extendedprice]) - MIN([l_extendedprice])) / MEDIAN([l_quantity])",
            "aggregate",
        ),
        K.formula_kpi("mixed", "-MEAN([l_discount]) + COUNT([l_tax])", "aggregate"),
    ]
    keys = ["l_returnflag", "l_linestatus"]
    return shown(K.evaluate(load(spark, folder, "lineitem"), kpis, keys), 6)


@query(
    "formula_status_counts",
    "K5",
    """SELECT CASE WHEN nullif(l_linenumber, 3) IS NULL THEN 'missing_input'
            WHEN l_discount = 0 THEN 'division_by_zero' ELSE 'valid' END AS status,
       count(*) AS record_count FROM lineitem GROUP BY 1""",
)
def formula_status_counts(spark, folder):
    table = load(spark, folder, "lineitem")
    df = table.df.withColumn("line", F.nullif("l_linenumber", F.lit(3)))
    table = V.Table(df)
    kpi = K.formula_kpi("x", "[line] / [l_discount]", "row", "mean")
    status = K.Measure(table, kpi).row_status
    return table.df.groupBy(status.alias("status")).agg(F.count("*").alias("record_count"))


@query(
    "formula_preview",
    "K6 K17",
    """SELECT count(*) AS total_records,
       count(*) FILTER (WHERE l_discount <> 0) AS valid_result_count,
       0::BIGINT AS missing_input_count,
       count(*) FILTER (WHERE l_discount = 0) AS division_by_zero_count,
       0::BIGINT AS non_finite_result_count,
       round(min(l_tax / l_discount) FILTER (WHERE l_discount <> 0), 6) AS minimum,
       round(max(l_tax / l_discount) FILTER (WHERE l_discount <> 0), 6) AS maximum,
       round(avg(l_tax / l_discount) FILTER (WHERE l_discount <> 0), 6) AS mean
       FROM lineitem""",
)
def formula_preview(spark, folder):
    kpi = K.formula_kpi("x", "[l_tax] / [l_discount]", "row", "mean")
    return shown(K.preview(load(spark, folder, "lineitem"), kpi), 6)


@query(
    "aggregate_preview",
    "K6",
    """SELECT count(*) AS total_records, 1::BIGINT AS valid_result_count,
       0::BIGINT AS missing_input_count, 0::BIGINT AS division_by_zero_count,
       0::BIGINT AS non_finite_result_count,
       round(sum(o_totalprice) / count(o_totalprice), 4) AS minimum,
       round(sum(o_totalprice) / count(o_totalprice), 4) AS maximum,
       round(sum(o_totalprice) / count(o_totalprice), 4) AS mean FROM orders""",
)
def aggregate_preview(spark, folder):
    kpi = K.formula_kpi("x", "SUM([o_totalprice]) / COUNT([o_totalprice])", "aggregate")
    return shown(K.preview(load(spark, folder, "orders"), kpi), 4)


_OPS = {
    "add": "l_tax + l_discount",
    "subtract": "l_tax - l_discount",
    "multiply": "l_tax * l_discount",
    "ratio": "l_tax / nullif(l_discount, 0)",
    "percentage_ratio": "l_tax / nullif(l_discount, 0) * 100",
    "percentage_difference": "(l_tax - l_discount) / nullif(l_discount, 0) * 100",
    "margin_percentage": "(l_tax - l_discount) / nullif(l_tax, 0) * 100",
}


@query(
    "two_column_operations",
    "K7 K9 K10",
    " UNION ALL ".join(
        f"SELECT '{op}' AS operation, l_returnflag, round(avg({sql}), 5) AS value, "
        f"count({sql}) AS valid_count FROM lineitem GROUP BY l_returnflag"
        for op, sql in _OPS.items()
    ),
)
def two_column_operations(spark, folder):
    table = load(spark, folder, "lineitem")
    measures = []
    for i, op in enumerate(K.OPERATIONS):
        display = "percentage" if op in K.PERCENTAGE_OPERATIONS else "number"
        kpi = K.operation_kpi(op, op, "l_tax", "l_discount", "mean", display_format=display)
        measures.append(K.Measure(table, kpi, f"k{i}"))
    wide = K.aggregate_measures(table.df, ["l_returnflag"], measures)
    rows = F.array(
        *[
            F.struct(
                F.lit(m.kpi.name).alias("operation"),
                m.value.alias("value"),
                F.col(f"{m.prefix}_n").alias("valid_count"),
            )
            for m in measures
        ]
    )
    return shown(wide.select("l_returnflag", F.inline(rows)), 5)


@query(
    "ratio_of_sums",
    "K8",
    """SELECT l_linenumber, count(*) AS record_count,
       count(*) FILTER (WHERE l_linenumber = 3) AS missing_inputs,
       CASE WHEN l_linenumber <> 3
            THEN round((sum(l_extendedprice) - sum(l_quantity)) / sum(l_extendedprice) * 100, 6)
       END AS value
       FROM lineitem GROUP BY l_linenumber""",
)
def ratio_of_sums(spark, folder):
    table = load(spark, folder, "lineitem")
    holes = F.when(F.col("l_linenumber") != 3, F.col("l_quantity"))
    table = V.Table(table.df.withColumn("l_quantity", holes))
    out = K.ratio_of_sums(
        table, "l_extendedprice", "l_quantity", ["l_linenumber"], "margin_percentage"
    )
    return shown(out, 6)


@query(
    "conditional_rate",
    "K11 K12 K13",
    """SELECT o_orderpriority,
       round(100.0 * count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) / count(*), 6) AS rate,
       round(100 * sum(CASE WHEN o_orderstatus IN ('F', 'P') THEN o_totalprice ELSE 0 END)
             / sum(o_totalprice), 6) AS share,
       count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) AS numerator_record_count,
       count(*) AS denominator_record_count,
       round(sum(CASE WHEN o_orderstatus IN ('F', 'P') THEN o_totalprice ELSE 0 END), 2) AS numerator,
       round(sum(o_totalprice), 2) AS denominator
       FROM orders GROUP BY o_orderpriority""",
)
def conditional_rate(spark, folder):
    table = load(spark, folder, "orders")
    rate = K.Measure(table, K.rate_kpi("rate", "o_orderstatus", ["F", "P"]), "k0")
    share = K.Measure(
        table, K.rate_kpi("share", "o_orderstatus", ["F", "P"], "o_totalprice"), "k1"
    )
    wide = K.aggregate_measures(table.df, ["o_orderpriority"], [rate, share])
    return shown(
        wide.select(
            "o_orderpriority",
            rate.value.alias("rate"),
            share.value.alias("share"),
            *[c.alias(n) for n, c in share.detail.items()],
        ),
        6,
        numerator=2,
        denominator=2,
    )


@query(
    "conditional_rate_missing",
    "K11 K12 F1",
    """WITH t AS (SELECT nullif(l_returnflag, 'A') AS flag, nullif(l_linenumber, 3) AS v FROM lineitem)
       SELECT round(100.0 * count(*) FILTER (WHERE flag = 'R') / count(*), 6) AS rate,
       round(100.0 * sum(v) FILTER (WHERE flag = 'R') / sum(v), 6) AS share FROM t""",
)
def conditional_rate_missing(spark, folder):
    df = load(spark, folder, "lineitem").df.select(
        F.nullif("l_returnflag", F.lit("A")).alias("flag"),
        F.nullif("l_linenumber", F.lit(3)).alias("v"),
    )
    kpis = [K.rate_kpi("rate", "flag", ["R"]), K.rate_kpi("share", "flag", ["R"], "v")]
    return shown(K.evaluate(V.Table(df), kpis).drop("record_count"), 6)


@query(
    "condition_values_unknown",
    "K14 F7 X4",
    """SELECT v AS value FROM (VALUES ('F'), ('X'), ('P')) t(v)
       WHERE v NOT IN (SELECT o_orderstatus FROM orders)""",
)
def condition_values_unknown(spark, folder):
    kpi = K.rate_kpi("r", "o_orderstatus", ["F", "X", "P"])
    return K.missing_condition_values(load(spark, folder, "orders"), kpi)


@query(
    "eligible_records",
    "K19 A15",
    """WITH t AS (SELECT nullif(l_linenumber, 3) AS line, nullif(l_tax, 0) AS tax, l_returnflag
                  FROM lineitem)
       SELECT l_returnflag, count(line) AS source_n,
       count(*) FILTER (WHERE line IS NOT NULL AND tax IS NOT NULL) AS formula_n,
       count(*) AS rate_n, count(tax) AS share_n, count(*) AS total_n
       FROM t GROUP BY l_returnflag""",
)
def eligible_records(spark, folder):
    df = load(spark, folder, "lineitem").df.select(
        F.nullif("l_linenumber", F.lit(3)).alias("line"),
        F.nullif("l_tax", F.lit(0.0)).alias("tax"),
        "l_returnflag",
    )
    table = V.Table(df)
    kpis = {
        "source_n": K.source_kpi("line"),
        "formula_n": K.formula_kpi("f", "SUM([line]) / SUM([tax])", "aggregate"),
        "rate_n": K.rate_kpi("r", "l_returnflag", ["R"]),
        "share_n": K.rate_kpi("s", "l_returnflag", ["R"], "tax"),
    }
    measures = {n: K.Measure(table, k, n) for n, k in kpis.items()}
    return df.groupBy("l_returnflag").agg(
        *[F.count_if(m.eligible).alias(n) for n, m in measures.items()],
        F.count("*").alias("total_n"),
    )


@query(
    "row_level_values",
    "K18 F11 B17",
    """SELECT o_orderpriority, count(*) FILTER (WHERE o_totalprice < 150000) AS breaches,
       count(*) FILTER (WHERE o_totalprice >= 150000) AS meets,
       round(avg(CASE WHEN o_orderstatus = 'F' THEN 100.0 ELSE 0 END), 6) AS indicator_mean
       FROM orders GROUP BY o_orderpriority""",
)
def row_level_values(spark, folder):
    table = load(spark, folder, "orders")
    value = K.Measure(table, K.source_kpi("o_totalprice")).row_value
    flag = K.Measure(table, K.rate_kpi("r", "o_orderstatus", ["F"])).row_value
    return shown(
        table.df.groupBy("o_orderpriority").agg(
            F.count_if(value < 150000).alias("breaches"),
            F.count_if(value >= 150000).alias("meets"),
            F.avg(flag).alias("indicator_mean"),
        ),
        6,
    )


@query("metric_definitions", "K15 K16 K20 K21")
def metric_definitions(spark, folder):
    """Definitions with the value each KPI has on the whole table."""
    from metricloom.plans.battery_queries import lineitem_registry

    table = load(spark, folder, "lineitem")
    registry = lineitem_registry()
    defined = K.metric_definitions(table, registry).withColumn(
        "source_columns", F.array_join("source_columns", ",")
    )
    measures = [K.Measure(table, k, f"k{i}") for i, k in enumerate(registry.kpis)]
    wide = K.aggregate_measures(table.df, [], measures)
    rows = F.array(
        *[
            F.struct(F.lit(m.kpi.metric_id).alias("metric_id"), m.value.alias("value"))
            for m in measures
        ]
    )
    return shown(defined.join(F.broadcast(wide.select(F.inline(rows))), "metric_id"), 2)


@query(
    "exact_quartiles",
    "A4 A2",
    """SELECT l_returnflag, count(*) AS value_count,
       round(quantile_cont(l_extendedprice, 0.25), 6) AS q1,
       round(quantile_cont(l_extendedprice, 0.5), 6) AS q2,
       round(quantile_cont(l_extendedprice, 0.75), 6) AS q3
       FROM lineitem GROUP BY l_returnflag""",
)
def exact_quartiles(spark, folder):
    df = load(spark, folder, "lineitem").df
    q = exact_quantiles(df, ["l_returnflag"], F.col("l_extendedprice"), [0.25, 0.5, 0.75])
    at = F.col("quantiles")
    return shown(
        q.select(
            "l_returnflag", "value_count", at[0].alias("q1"), at[1].alias("q2"), at[2].alias("q3")
        ),
        6,
    )


@query(
    "exact_medians_many_groups",
    "A2 A4",
    """SELECT l_suppkey, count(*) AS value_count, round(median(l_extendedprice), 6) AS median
       FROM lineitem GROUP BY l_suppkey""",
)
def exact_medians_many_groups(spark, folder):
    df = load(spark, folder, "lineitem").df
    q = exact_quantiles(df, ["l_suppkey"], F.col("l_extendedprice"), [0.5])
    return shown(q.select("l_suppkey", "value_count", F.col("quantiles")[0].alias("median")), 6)


@query(
    "parsed_numbers",
    "F2 M1 M2 M7 M8 F12",
    r"""WITH t AS (SELECT unnest([l_extendedprice::VARCHAR, ' ' || l_linenumber::VARCHAR || ' ',
            CASE WHEN l_linenumber = 1 THEN 'N/A' WHEN l_linenumber = 2 THEN 'nan'
                 WHEN l_linenumber = 3 THEN 'inf' WHEN l_linenumber = 4 THEN '1d'
                 WHEN l_linenumber = 5 THEN '1e2' ELSE '-.5' END]) AS s FROM lineitem)
        SELECT count(*) AS cell_count,
        count(*) FILTER (WHERE lower(trim(s)) IN ('', 'na', 'n/a', 'null', 'none', 'nan')) AS missing_count,
        count(*) FILTER (WHERE regexp_full_match(trim(s), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')) AS number_count,
        round(sum(CASE WHEN regexp_full_match(trim(s), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')
                  THEN trim(s)::DOUBLE END), 2) AS total FROM t""",
)
def parsed_numbers(spark, folder):
    df = load(spark, folder, "lineitem").df
    line = F.col("l_linenumber")
    odd = (
        F.when(line == 1, "N/A")
        .when(line == 2, "nan")
        .when(line == 3, "inf")
        .when(line == 4, "1d")
        .when(line == 5, "1e2")
        .otherwise("-.5")
    )
    cells = df.select(
        F.explode(
            F.array(
                F.col("l_extendedprice").cast("string"),
                F.concat(F.lit(" "), line.cast("string"), F.lit(" ")),
                odd,
            )
        ).alias("s")
    )
    table = V.Table(cells)
    return shown(
        cells.agg(
            F.count("*").alias("cell_count"),
            F.count_if(table.missing("s")).alias("missing_count"),
            F.count(table.num("s")).alias("number_count"),
            F.sum(table.num("s")).alias("total"),
        ),
        2,
    )


@query(
    "parsed_dates",
    "M9 M10",
    """WITH t AS (SELECT o_orderdate AS d, o_orderkey % 3 AS k FROM orders)
       SELECT strftime(d, '%Y') AS y, year(d) || '-Q' || quarter(d) AS q,
       strftime(d, '%Y-%m') AS m, count(*) FILTER (WHERE k <> 2) AS parsed,
       count(*) FILTER (WHERE k = 2) AS refused FROM t GROUP BY ALL""",
)
def parsed_dates(spark, folder):
    df = load(spark, folder, "orders").df
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 3
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 1, F.date_format(d, "yyyy/M/d"))
        .otherwise(F.date_format(d, "yyyyMMdd"))
    )
    cells = df.select(text.alias("s"), d.alias("d"))
    moment = V.Table(cells).moment("s")
    groups = [
        V.period_label(F.col("d"), g).alias(n)
        for g, n in (("year", "y"), ("quarter", "q"), ("month", "m"))
    ]
    same = V.period_label(moment, "day") == V.period_label(F.col("d"), "day")
    return cells.groupBy(*groups).agg(
        F.count_if(same).alias("parsed"), F.count_if(moment.isNull()).alias("refused")
    )


@query(
    "granularity_choice",
    "M11 A10",
    """WITH m AS (SELECT 'lineitem' AS source, count(DISTINCT strftime(l_shipdate, '%Y-%m')) AS months FROM lineitem
       UNION ALL SELECT 'events', count(DISTINCT strftime(ts, '%Y-%m')) FROM events)
       SELECT source, months, CASE WHEN months >= 24 THEN 'year' WHEN months >= 6 THEN 'quarter'
       WHEN months >= 2 THEN 'month' ELSE 'day' END AS granularity FROM m""",
)
def granularity_choice(spark, folder):
    parts = []
    for name, date in (("lineitem", "l_shipdate"), ("events", "ts")):
        table = load(spark, folder, name)
        # Two steps instead of one distinct count: map-side combine on the month.
        months = table.df.select(F.trunc(table.day(date), "month").alias("m")).distinct()
        parts.append(months.agg(F.lit(name).alias("source"), F.count("m").alias("months")))
    return union_all(parts).withColumn("granularity", V.granularity_for(F.col("months")))


@query(
    "number_formats",
    "M6 M12 M14 M15 M21",
    """WITH t AS (SELECT o_orderstatus, round(sum(o_totalprice), 2) AS v, count(*) AS record_count
                  FROM orders GROUP BY o_orderstatus)
       SELECT o_orderstatus, CASE WHEN v >= 1e9 THEN printf('%.2fB', v / 1e9)
         WHEN v >= 1e6 THEN printf('%.2fM', v / 1e6) ELSE printf('%.2f', v) END AS total_text,
       record_count FROM t""",
)
def number_formats(spark, folder):
    df = load(spark, folder, "orders").df
    total = F.round(F.sum("o_totalprice"), 2)
    out = df.groupBy("o_orderstatus").agg(
        total.alias("t"), F.count("*").alias("record_count")
    )
    return out.select("o_orderstatus", V.human_number(F.col("t")).alias("total_text"), "record_count")


@query(
    "percentage_change_rules",
    "M16 B21",
    """WITH y AS (SELECT strftime(o_orderdate, '%Y') AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1),
       c AS (SELECT y, v, lag(v) OVER (ORDER BY y) AS p FROM y)
       SELECT y, round((v - p) / p * 100, 6) AS percentage_change,
       CASE WHEN abs(v - p) <= 1e-12 THEN 'stable' WHEN v > p THEN 'increasing' ELSE 'decreasing' END AS direction,
       v > p AS favorable FROM c WHERE p IS NOT NULL""",
)
def percentage_change_rules(spark, folder):
    from pyspark.sql import Window

    table = load(spark, folder, "orders")
    years = table.df.groupBy(V.period_label(table.day("o_orderdate"), "year").alias("y")).agg(
        F.sum("o_totalprice").alias("v")
    )
    # A few years; the window is over aggregated rows.
    w = Window.partitionBy(F.lit(0)).orderBy("y")
    rows = years.withColumn("p", F.lag("v").over(w)).where(F.col("p").isNotNull())
    label = V.direction(F.col("v") - F.col("p"))
    return shown(
        rows.select(
            "y",
            V.percent_change(F.col("v"), F.col("p")).alias("percentage_change"),
            label.alias("direction"),
            V.favorable(label, F.lit("higher")).alias("favorable"),
        ),
        6,
    )


@query(
    "binary_label_rate",
    "K3 K11",
    """SELECT quality, count(*) AS record_count, round(avg(toxic) * 100, 6) AS toxic_rate
       FROM labels GROUP BY quality""",
)
def binary_label_rate(spark, folder):
    kpi = K.formula_kpi("toxic_rate", "MEAN([toxic]) * 100", "aggregate")
    return shown(K.evaluate(load(spark, folder, "labels"), [kpi], ["quality"]), 6)
