import pytest
from pyspark.sql import functions as F

from conftest import one
from metricloom.functions.formula import FormulaError, compile_formula
from metricloom.operators import kpi as K

NUMBERS = frozenset({"revenue", "cost", "discount", "tax", "odd]name"})


@pytest.mark.parametrize(
    "text, level",
    [
        ("", "row"),
        ("[missing] + 1", "row"),
        ("SUM([revenue])", "row"),
        ("[revenue] / SUM([cost])", "aggregate"),
        ("SUM([revenue] + [cost])", "aggregate"),
        ("1 + 2", "row"),
        ("__import__('os')", "row"),
        ("[revenue] ** 2", "row"),
        ("[revenue] // 2", "row"),
        ("[revenue] if 1 else 2", "row"),
        ("IF([revenue], 1, 2)", "row"),
        ("[revenue", "row"),
        ("revenue + 1", "row"),
        ("[revenue] + 1_000", "row"),
        ("[revenue] + " + "1 + " * 60 + "1", "row"),
        ("-" * 12 + "[revenue]", "row"),
        ("[revenue] + 1e101", "row"),
        ("[revenue]; 1", "row"),
        ("[revenue] < 2", "row"),
    ],
)
def test_refused_formulas(text, level):
    with pytest.raises(FormulaError):
        compile_formula(text, level, NUMBERS)


@pytest.mark.parametrize(
    "text, level, label",
    [
        ("[revenue]-[cost]", "row", "[revenue] - [cost]"),
        ("([revenue] - [cost]) / [revenue] * 100", "row", "([revenue] - [cost]) / [revenue] * 100"),
        ("[revenue] - ([cost] - [tax])", "row", "[revenue] - ([cost] - [tax])"),
        ("abs(-[odd]]name])", "row", "ABS(-[odd]]name])"),
        ("sum([revenue]) / count([cost])", "aggregate", "SUM([revenue]) / COUNT([cost])"),
    ],
)
def test_canonical_label(text, level, label):
    assert compile_formula(text, level, NUMBERS).label == label


def test_row_and_aggregate_values(table):
    t = table("revenue cost discount tax", [(100, 60, 5, 2), (50, 30, 0, 1)])
    row = K.formula_kpi("p", "[revenue] - [cost] - [discount] - [tax]", "row", "sum")
    whole = K.formula_kpi("m", "(SUM([revenue]) - SUM([cost])) / SUM([revenue]) * 100", "aggregate")
    out = one(K.evaluate(t, [row, whole]))
    assert out["p"] == 33 + 19
    assert out["m"] == pytest.approx(40.0)


def test_status_order_and_preview(table):
    t = table(
        "revenue cost units",
        [(10, 6, 1), (20, 0, 2), ("", 5, 3)],
    )
    kpi = K.formula_kpi("r", "[cost] / [revenue]", "row", "mean")
    out = one(K.preview(t, kpi))
    assert (out["total_records"], out["valid_result_count"], out["missing_input_count"]) == (3, 2, 1)
    assert (out["minimum"], out["maximum"], out["mean"]) == (0.0, 0.6, 0.3)
    status = K.Measure(t, K.formula_kpi("x", "[revenue] / [cost]", "row", "mean")).row_status
    found = [r[0] for r in t.df.select(status).collect()]
    assert found == ["valid", "division_by_zero", "missing_input"]
    big = K.Measure(t, K.formula_kpi("b", "[units] * 1e100 * 1e100 * 1e100 * 1e100", "row")).row_status
    assert {r[0] for r in t.df.select(big).collect()} == {"non_finite_result"}


def test_aggregate_status(table):
    t = table("revenue cost", [(10, 0), (5, 0)])
    m = K.Measure(t, K.formula_kpi("x", "SUM([revenue]) / SUM([cost])", "aggregate"))
    out = one(K.aggregate_measures(t.df, [], [m]).select(m.value.alias("v"), m.value_status.alias("s")))
    assert out == {"v": None, "s": "division_by_zero"}


def test_charts_do_not_filter_other_inputs(table):
    t = table("revenue cost", [(10, 5), (20, "")])
    kpi = K.formula_kpi("x", "SUM([revenue]) / SUM([cost])", "aggregate")
    assert one(K.evaluate(t, [kpi]))["x"] == 6.0
    m = K.Measure(t, kpi)
    assert one(K.aggregate_measures(t.df, [], [m]).select(m.value.alias("v")))["v"] == 2.0


def test_plan_stays_in_the_jvm(table):
    t = table("revenue cost", [(1, 2)])
    kpi = K.formula_kpi("x", "[revenue] / [cost]", "row", "mean")
    plan = t.df.select(F.sum(K.Measure(t, kpi).row_value))._jdf.queryExecution().toString()
    assert "Python" not in plan.split("Optimized")[1]
