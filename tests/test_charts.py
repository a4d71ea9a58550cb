import pytest
from pyspark.sql import functions as F

from conftest import one
from metricloom.functions.frames import placed
from metricloom.operators import board as B
from metricloom.operators import chart_facts as X
from metricloom.operators import kpi as K
from metricloom.operators.charts import (
    ChartError,
    ChartSpec,
    chart_data,
    check_columns,
    guards,
    histogram,
    profile_facts,
    unknown_filter_values,
    drawable,
)
from metricloom.operators.profile import profile

ROWS = [
    ("2024-01-10", "A", "N", 100, 50, -5),
    ("2024-01-20", "B", "S", 250, 80, 10),
    ("2024-02-10", "A", "S", 150, 60, 20),
    ("2024-02-20", "B", "N", 240, 90, -30),
    ("2024-03-10", "A", "N", 180, 70, 15),
    ("2024-03-20", "B", "S", 260, 100, 40),
]


@pytest.fixture(scope="module")
def sales(table):
    return table("date segment region revenue cost net", ROWS, key=True)


def listed(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_time_and_category(sales):
    spec = ChartSpec("time_line", ("column:revenue",), "date", aggregation="sum")
    assert listed(chart_data(sales, spec), "x", "value", "record_count") == [
        ("2024-01", 350, 2), ("2024-02", 390, 2), ("2024-03", 440, 2),
    ]
    spec = ChartSpec("category_bar", ("column:revenue",), "segment", aggregation="sum", top_n=1)
    assert listed(chart_data(sales, spec), "x", "value", "x_position") == [("B", 750, 1)]
    spec = ChartSpec("category_bar", ("count:records",), "segment", sort_by="source")
    assert listed(chart_data(sales, spec), "x", "value") == [("A", 3), ("B", 3)]
    spec = ChartSpec("category_bar", ("column:revenue",), "segment", "region")
    assert len(listed(chart_data(sales, spec), "x", "series", "value")) == 4


def test_filters(sales):
    base = dict(chart="category_bar", measures=("count:records",), x="segment")
    spec = ChartSpec(**base, filter_column="region", filter_values=("N",), filter_mode="exclude")
    assert listed(chart_data(sales, spec), "x", "value") == [("B", 2), ("A", 1)]
    spec = ChartSpec(**base, date_start="2024-02-10", date_end="2024-03-10", date_column="date")
    assert listed(chart_data(sales, spec), "x", "value") == [("A", 2), ("B", 1)]
    spec = ChartSpec(**base, filter_column="region", filter_values=("N", "W"))
    assert listed(unknown_filter_values(sales, spec), "value") == [("W",)]


def test_post_steps(sales):
    spec = ChartSpec("pareto", ("column:revenue",), "segment", aggregation="sum")
    out = listed(chart_data(sales, spec), "x", "cumulative_percentage")
    assert out[0] == ("B", pytest.approx(750 / 1180 * 100)) and out[1] == ("A", pytest.approx(100))
    spec = ChartSpec("waterfall", ("column:net",), "region", aggregation="sum", sort_by="source")
    assert listed(chart_data(sales, spec), "x", "start_value", "end_value") == [("N", 0, -20), ("S", -20, 50)]
    spec = ChartSpec("funnel", ("column:revenue",), "segment", aggregation="sum")
    assert listed(chart_data(sales, spec), "x", "percentage_of_maximum")[1] == ("A", pytest.approx(430 / 750 * 100))
    spec = ChartSpec("scorecard", ("column:cost",), aggregation="max")
    assert one(chart_data(sales, spec))["value"] == 100
    spec = ChartSpec("scatter", ("column:cost",), "revenue")
    assert chart_data(sales, spec).count() == 6


def test_rules(sales):
    for bad in (
        dict(chart="heatmap", measures=("count:records",), x="a", series="a"),
        dict(chart="pareto", measures=("count:records", "column:x"), x="a"),
        dict(chart="combo", measures=("count:records",), x="a"),
        dict(chart="donut", measures=("count:records",), x="a", scale="log"),
        dict(chart="category_bar", measures=("count:records",), x="a", top_n=51),
        dict(chart="histogram", measures=("column:a",), bins=4),
        dict(chart="category_bar", measures=("count:records",), x="a", filter_values=("v",)),
        dict(chart="time_line", measures=("count:records",), x="a", date_start="2025-01-01", date_end="2024-01-01"),
    ):
        with pytest.raises(ChartError):
            ChartSpec(**bad)
    with pytest.raises(ChartError):
        chart_data(sales, ChartSpec("donut", ("column:revenue",), "segment"))
    with pytest.raises(ChartError):
        chart_data(sales, ChartSpec("histogram", ("count:records",)))
    facts = profile_facts(profile(sales, columns=["date", "segment", "region", "revenue"]))
    check_columns(ChartSpec("time_line", ("column:revenue",), "date"), facts)
    with pytest.raises(ChartError):
        check_columns(ChartSpec("time_line", ("column:revenue",), "segment"), facts)
    spec = ChartSpec("pareto", ("column:net",), "region", aggregation="sum")
    assert listed(guards(chart_data(sales, spec), spec), "problem") == [("needs_nonnegative_values",)]


def test_histogram_keeps_empty_bins(table):
    t = table("v", [(0,), (1,), (10,), (10,)])
    out = histogram(t.df, t.num("v"), 5).orderBy("bin").collect()
    assert [r["count"] for r in out] == [2, 0, 0, 0, 2]
    t = table("v", [(3,), (3,)])
    out = histogram(t.df, t.num("v"), 5).collect()
    assert [(r["bin_start"], r["count"]) for r in out] == [(3, 2)]


def test_board(sales):
    assert listed(B.grouped(sales, "column", "segment", "revenue"), "x", "y") == [("B", 750), ("A", 430)]
    assert one(B.card(sales, "revenue"))["y"] == 1180
    box = {r["x"]: r for r in B.box(sales, "revenue", "segment").collect()}["A"]
    assert [box[k] for k in ("minimum", "q1", "median", "q3", "maximum")] == [100, 125, 150, 165, 180]
    gauge = one(B.card(sales, "revenue", 1000.0))
    assert gauge["percentage_of_target"] == pytest.approx(118)
    stacked = B.stacked(sales, "stacked_100_column", "segment", "revenue", "region")
    assert sum(r["percentage"] for r in stacked.collect()) == pytest.approx(200)
    assert listed(B.stacked_problems(sales, "segment", "net", "region"), "problem") == [("negative_values",)]
    assert B.points(sales, "revenue", "cost", "net").count() == 4
    kinds = {"d": "date/time", "n": "numeric", "m": "numeric", "c": "categorical"}
    chosen = [B.automatic_chart(kinds, *p) for p in (("n", "m"), ("d", "n"), ("c", "n"), ("n",), ("c",))]
    assert chosen == ["scatter", "line", "column", "histogram", "column"]
    with pytest.raises(ChartError):
        B.automatic_chart(kinds, "n", "c")


def test_range_text(spark):
    from pyspark.sql import functions as F

    values = [0.0, 12345.678, 1.23456, 0.5, -99.996, 9999.6, 0.000123456, 0.00001234, 1234, 1e300]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").select(B.range_text(F.col("v")))
    assert [r[0] for r in df.collect()] == [f"{v:.4g}" for v in values]


def test_human_numbers(spark):
    from pyspark.sql import functions as F

    from metricloom.functions.values import human_number, signed_number

    values = [0.0, 5.0, 2.675, -0.125, 999.999, 1000.0, 1234567.0, 12345.675, -2.5e9, 1e6]
    want = ["0", "5", "2.67", "-0.12", "1000.00", "1,000", "1.23M", "12,345.67", "-2.50B", "1.00M"]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(human_number(F.col("v"))).collect()] == want
    assert [r[0] for r in df.select(signed_number(F.col("v"))).collect()][:4] == ["0", "+5", "+2.67", "-0.12"]


def test_facts(sales):
    spec = ChartSpec("time_line", ("column:revenue",), "date", "segment", aggregation="sum")
    rows = chart_data(sales, spec)
    ends = one(X.extremes(rows, "x"))
    assert (ends["highest"]["value"], ends["lowest"]["value"]) == (260, 100)
    change = {r["series"]: r for r in X.time_changes(rows).collect()}
    assert change["A"]["absolute_change"] == 80 and change["A"]["percentage_change"] == pytest.approx(80)
    move = one(X.movements(rows))
    assert (move["gain"]["movement"], move["drop"]["movement"]) == (50, -10)
    text = [r["finding"] for r in X.findings(rows, "time_line", "x", "sum", 5).orderBy("position").collect()]
    assert text[0] == "revenue peaks at 2024-03 / B with 260; its smallest displayed value is at 2024-01 / A with 100."
    assert len(text) == 5 == len(set(text))
    assert X.observations(rows, "time_line", "x").count() == 3


def test_distribution_hinges(table):
    for values in ([1, 2, 3, 4, 5], [1, 2, 3, 4], [7], [1, 1, 1, 50]):
        t = table("v", [(v,) for v in values])
        out = one(X.distribution(t.df.select(t.num("v").alias("value"))))
        ordered, n = sorted(values), len(values)
        half = (n + 1) // 2

        def middle(part):
            k = len(part)
            return (part[(k - 1) // 2] + part[k // 2]) / 2

        assert (out["q1"], out["q3"]) == (middle(ordered[:half]), middle(ordered[n - half :]))


def test_association(table):
    t = table("x y", [(1, 2), (2, 4), (3, 6)])
    pairs = t.df.select(t.num("x").alias("x"), t.num("y").alias("y"))
    assert one(X.association(pairs))["coefficient"] == pytest.approx(1.0)
    assert one(X.association(pairs.limit(2)))["type"] == "association_skipped"
    t = table("x y", [(1, 2), (1, 4), (1, 6)])
    flat = one(X.association(t.df.select(t.num("x").alias("x"), t.num("y").alias("y"))))
    assert flat["coefficient"] is None and flat["constant_input"] is True


def test_conditional_measure(sales):
    registry = K.Registry((K.rate_kpi("north", "region", ["N"], "revenue"),))
    spec = ChartSpec("category_bar", (f"metric:{registry.primary_id}",), "segment")
    out = dict(listed(chart_data(sales, spec, registry), "x", "value"))
    assert out["A"] == pytest.approx(280 / 430 * 100)
    with pytest.raises(ChartError):
        chart_data(
            sales,
            ChartSpec("category_bar", (f"metric:{registry.primary_id}",), "segment", aggregation="sum"),
            registry,
        )


def test_many_series_stay_distributed(spark, table):
    rows = [("ab"[i % 2], f"s{i}", i) for i in range(2000)]
    spec = ChartSpec(chart="heatmap", x="k", series="s", measures=("column:v",))
    out = chart_data(table("k s v", rows), spec)
    assert out.count() == 4000 and out.where("value IS NULL").count() == 2000
    with pytest.raises(ChartError):
        drawable(table("k s v", rows), spec)


@pytest.mark.parametrize("partitions", [1, 7])
def test_places_and_running_sums(spark, partitions):
    """Places over range partitions equal a sort of everything, ties and descending order included."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(i, (i * 37) % 11, i % 3 - 1) for i in range(500)]
    frame = spark.createDataFrame(rows, "k int, v int, y int").repartition(5)
    got = placed(frame, [F.desc("v"), F.col("k")], "place", {"total": F.col("y")}).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    want = {r[0]: (i, sum(x[2] for x in order[:i])) for i, r in enumerate(order, 1)}
    assert {r.k: (r.place, r.total) for r in got} == want and len(got) == 500
    assert placed(frame.limit(0), [F.col("k")], "place").count() == 0
