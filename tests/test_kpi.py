import pytest

from conftest import one
from metricloom.operators import kpi as K

ROWS = [
    ("2024-01-01", "N", "New", "open", 100),
    ("2024-01-02", "N", "Old", "closed", 200),
    ("2024-01-03", "S", "New", "open", 150),
    ("2024-02-01", "S", "Old", "closed", 100),
    ("2024-02-02", "N", "Old", "closed", 50),
    ("2024-02-03", "S", "Old", "", 100),
]


@pytest.fixture
def sales(table):
    return table("date region customer_type status net_sales", ROWS)


def test_conditional_rate_and_share(sales):
    rate = K.rate_kpi("open rate", "status", ["open"])
    share = K.rate_kpi("new share", "customer_type", ["New"], "net_sales")
    out = one(K.evaluate(sales, [rate, share]))
    assert out["open rate"] == pytest.approx(100 * 2 / 6)
    assert out["new share"] == pytest.approx(250 / 700 * 100)


def test_zero_denominator_is_null(table):
    t = table("flag v", [("a", 1), ("b", -1)])
    assert one(K.evaluate(t, [K.rate_kpi("x", "flag", ["a"], "v")]))["x"] is None


@pytest.mark.parametrize(
    "operation, expected",
    [
        ("add", 16.0),
        ("subtract", 4.0),
        ("multiply", 60.0),
        ("ratio", 10 / 6),
        ("percentage_ratio", 1000 / 6),
        ("percentage_difference", 400 / 6),
        ("margin_percentage", 40.0),
    ],
)
def test_operations(table, operation, expected):
    t = table("revenue cost", [(10, 6)])
    display = "percentage" if operation in K.PERCENTAGE_OPERATIONS else "number"
    kpi = K.operation_kpi("x", operation, "revenue", "cost", "mean", display_format=display)
    assert one(K.evaluate(t, [kpi]))["x"] == pytest.approx(expected, abs=1e-7)


def test_ratio_of_sums_needs_every_input(table):
    t = table("g revenue cost", [("a", 10, 5), ("a", 20, 10), ("b", 5, ""), ("b", 5, 1)])
    rows = {r["g"]: r["value"] for r in K.ratio_of_sums(t, "revenue", "cost", ["g"]).collect()}
    assert rows == {"a": 2.0, "b": None}
    assert K.operation_formula("margin_percentage", "r", "c", "ratio_of_sums") == (
        "((SUM([r]) - SUM([c])) / SUM([r])) * 100",
        "aggregate",
        "formula",
    )


def test_definition_rules():
    with pytest.raises(K.KpiError):
        K.operation_kpi("x", "ratio", "a", "b", "sum")
    with pytest.raises(K.KpiError):
        K.operation_kpi("x", "margin_percentage", "a", "b", "mean")
    with pytest.raises(K.KpiError):
        K.operation_kpi("x", "add", "a", "a", "sum")
    with pytest.raises(K.KpiError):
        K.rate_kpi("x", "c", [])
    with pytest.raises(K.KpiError):
        K.rate_kpi("x", "c", ["v"], target=120.0)
    with pytest.raises(K.KpiError):
        K.formula_kpi("x", "SUM([a])", "aggregate", target=1.0, target_scope="row")


def test_registry():
    a, b = K.source_kpi("a"), K.source_kpi("b", "mean")
    registry = K.Registry((a,)).add(b)
    assert registry.primary_id == a.metric_id
    registry = registry.set_primary(b.metric_id)
    changed = registry.update(b.metric_id, aggregation="max")
    assert changed.primary_id == changed.kpis[1].metric_id != b.metric_id
    assert registry.remove(b.metric_id).kpis == (a,)
    assert a.metric_id == K.source_kpi("a").metric_id and len(a.metric_id) == 16
    with pytest.raises(K.KpiError):
        K.Registry((a, a))
    with pytest.raises(K.KpiError):
        K.Registry(tuple(K.source_kpi(c) for c in "abcdef"))
    with pytest.raises(K.KpiError):
        K.Registry((K.source_kpi("a", target=1.0, target_scope="period"),))
    with pytest.raises(K.KpiError):
        K.Registry((K.source_kpi("a", target=1.0, target_scope="segment"),), "d")


def test_unknown_condition_values(sales):
    kpi = K.rate_kpi("x", "status", ["open", "lost"])
    assert [r["value"] for r in K.missing_condition_values(sales, kpi).collect()] == ["lost"]
