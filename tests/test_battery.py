import json

import pytest
from pyspark.sql import functions as F

from conftest import one
from metricloom.operators import evidence as E
from metricloom.operators import kpi as K
from metricloom.operators.battery import Battery
from metricloom.operators.insights import build_insights, issues, skipped, support_rows
from metricloom.operators.profile import profile

FX1 = [
    (f"2024-0{m}-{d:02d}", s, v, v / 2, 7)
    for m, cells in ((1, {"A": (10, 10), "B": (5, 5)}), (2, {"A": (20, 20), "B": (10, 10)}),
                     (3, {"A": (30, 30), "B": (10, 30)}))
    for s, pair in cells.items()
    for d, v in enumerate(pair, 1)
]
NUMBERS = ["revenue", "cost", "constant"]


@pytest.fixture(scope="module")
def sales(table):
    return table("date segment revenue cost constant", FX1, key=True)


def battery(t, *kpis, date="date", cats=("segment",), numbers=NUMBERS):
    return Battery(t, K.Registry(kpis, date, cats), numeric_columns=numbers)


@pytest.fixture(scope="module")
def full(sales):
    return battery(
        sales,
        K.source_kpi("revenue", target=20.0, target_scope="row"),
        K.formula_kpi("margin", "(SUM([revenue]) - SUM([cost])) / SUM([revenue]) * 100", "aggregate"),
        K.source_kpi("cost", "median"),
        K.rate_kpi("a share", "segment", ["A"], "revenue", target=60.0),
    )


def metric(frame, name="revenue"):
    return frame.where(F.col("metric") == name)


def test_snapshot(full):
    out = one(metric(full.snapshot()))
    assert (out["current_value"], out["valid_record_count"], out["gap_to_target"]) == (190.0, 12, None)
    share = one(metric(full.snapshot(), "a share"))
    assert share["current_value"] == pytest.approx(120 / 190 * 100)
    assert share["meets_target"] is True
    assert share["numerator"] == 120.0 and share["denominator_record_count"] == 12


def test_time_line(full):
    change = one(metric(full.period_change()))
    assert (change["previous_value"], change["current_value"]) == (60.0, 100.0)
    assert change["percentage_change"] == pytest.approx(66.6666666667)
    base = one(metric(full.period_baseline()))
    assert base["baseline_value"] == 45.0
    assert base["percentage_change"] == pytest.approx(122.2222222222)
    trend = one(metric(full.trend()))
    assert trend["slope_per_period"] == 35.0
    assert trend["direction"] == "increasing" and trend["favorable"] is True
    flat = one(metric(full.trend(), "margin"))
    assert (flat["slope_per_period"], flat["r_squared"], flat["direction"]) == (0.0, 0.0, "stable")
    assert one(metric(full.period_change(), "cost"))["current_value"] == 15.0


def test_segments(full):
    ranking = one(metric(full.segment_ranking()))
    assert (ranking["top_segment"], ranking["top_value"]) == ("A", 120.0)
    assert (ranking["bottom_segment"], ranking["bottom_value"]) == ("B", 70.0)
    rows = metric(full.contribution_rows()).collect()
    assert [(r["absolute_change"], r["contribution_percentage"]) for r in rows] == [(20.0, 50.0)] * 2
    cohorts = one(metric(full.cohort_comparison()))
    assert (cohorts["best_cohort"], cohorts["best_percentage_change"]) == ("B", 100.0)
    assert (cohorts["worst_cohort"], cohorts["worst_percentage_change"]) == ("A", 50.0)
    shares = [r["share_percentage"] for r in metric(full.segment_share_rows()).collect()]
    assert sum(shares) == pytest.approx(100.0, abs=1e-9)


def test_targets_and_rows(full, sales):
    breach = one(metric(full.benchmark_breach()))
    assert (breach["breach_count"], breach["record_count"]) == (7, 12)
    worst = full.segment_benchmark_rows().where("position = 1").first()
    assert (worst["segment"], worst["breach_count"]) == ("B", 5)
    assert worst["average_value"] == pytest.approx(35 / 3)
    r = one(metric(full.correlations()).where("associated_metric = 'cost'"))
    assert r["coefficient"] == 1.0 and r["strength"] == "strong"
    assert full.correlations().where("associated_metric = 'constant'").isEmpty()
    period = battery(sales, K.source_kpi("revenue", target=70.0, target_scope="period"))
    out = one(period.period_target())
    assert (out["missed_period_count"], out["current_meets_target"]) == (2, True)
    assert [r["value"] for r in period.period_target_rows().orderBy("period").collect()] == [30, 60, 100]
    segment = battery(sales, K.source_kpi("revenue", target=100.0, target_scope="segment"))
    out = one(segment.segment_target())
    assert (out["worst_segment"], out["best_segment"], out["missed_segment_count"]) == ("B", "A", 1)


def test_insights_are_sequential_and_repeatable(full, sales):
    insights = build_insights(full, profile(sales))
    rows = insights.orderBy("id").collect()
    assert [r["id"] for r in rows] == [f"INS-{i:03d}" for i in range(1, len(rows) + 1)]
    assert rows[0]["type"] == "metric_snapshot"
    assert json.loads(rows[0]["observation"])["current_value"] == 190.0
    again = E.build_evidence(build_insights(full, profile(sales)), "d").select("evidence_id", "rank")
    first = E.build_evidence(insights, "d")
    assert sorted(map(tuple, again.collect())) == sorted(
        map(tuple, first.select("evidence_id", "rank").collect())
    )
    ranked = first.orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1))
    assert all(a["combined"] >= b["combined"] for a, b in zip(ranked, ranked[1:]))
    picked = E.recommended(first, 10, 2).collect()
    assert len(picked) == 10
    assert {r["metric"] for r in picked} == {"revenue", "margin", "cost", "a share"}
    assert sum(r["kind"] == "association" for r in picked) <= 2
    everything = E.recommended(first)
    assert everything.count() == sum(r["kind"] != "diagnostic" for r in ranked)
    support = support_rows(full)
    packed = E.package(first, support)
    assert packed.where("size(support_rows) > 12").isEmpty()
    assert packed.count() == len(ranked)
    story = E.stories(E.recommended(first, 10, 2), 5).collect()
    assert all(1 <= len(r["evidence_ids"]) <= 3 for r in story) and len(story) <= 5


def test_scores(full):
    rows = E.score(build_insights(full)).where("metric = 'revenue'").collect()
    found = {r["type"]: r for r in rows}
    change = found["period_change"]
    assert change["impact"] == pytest.approx(0.666667)
    # Four records per period: low confidence.
    assert change["combined"] == pytest.approx(0.5 * 0.666667 + 0.2 * 0.35 + 0.3, abs=1e-5)
    assert found["trend"]["relevance"] == 0.85


def test_lower_is_better_cohorts(table):
    rows = []
    for region, old, new in (("North", 100, 60), ("South", 100, 150)):
        rows += [("2024-02-01", region, old)] * 2 + [("2024-03-01", region, new)] * 2
    rows += [("2024-02-01", "East", 5), ("2024-03-01", "West", 5), ("2024-03-02", "West", 6)]
    t = table("date region cost", rows)
    b = battery(t, K.source_kpi("cost", "mean", direction="lower"), cats=("region",), numbers=["cost"])
    out = one(b.cohort_comparison())
    assert (out["best_cohort"], out["worst_cohort"]) == ("North", "South")
    assert (out["cohort_count"], out["excluded_cohort_count"]) == (2, 2)


def test_iqr(table):
    t = table("segment revenue", [("a", v) for v in (10, 11, 12, 13, 100)], key=True)
    b = battery(t, K.source_kpi("revenue"), date=None, numbers=["revenue"])
    out = one(b.anomalies())
    assert (out["q1"], out["q3"], out["lower_bound"], out["upper_bound"]) == (11, 13, 8, 16)
    assert [r["value"] for r in b.outliers().collect()] == [100.0]


def test_missing_date_cancels_the_time_line(table):
    t = table("date segment revenue", [("2024-01-01", "A", 1), ("", "A", 2), ("2024-02-01", "B", 3)])
    b = battery(t, K.source_kpi("revenue"), numbers=["revenue"])
    assert b.period_change().isEmpty() and b.trend().isEmpty() and b.cohort_rows().isEmpty()
    out = one(skipped(b).where("reason = 'missing_dates'"))
    assert "trend" in out["analyses"] and out["record_count"] == 3
    t = table("date segment revenue", [("2024-01-01", "A", 1), ("soon", "A", 2)])
    b = battery(t, K.source_kpi("revenue"), numbers=["revenue"])
    assert one(skipped(b).where("size(analyses) > 1"))["reason"] == "unparseable_date"


def test_cancelling_values(table):
    rows = [("2024-01-01", "A", 10), ("2024-01-02", "B", -10), ("2024-02-01", "A", 5), ("2024-02-02", "B", -5)]
    t = table("date segment revenue", rows)
    b = battery(t, K.source_kpi("revenue"), numbers=["revenue"])
    change = one(b.period_change())
    assert change["percentage_change"] is None and change["direction"] == "stable"
    out = one(b.segment_contribution())
    assert out["percentage_status"] == "not_calculated_zero_overall_change"
    assert one(skipped(b))["analyses"] == ["segment_share:segment"]


def test_reconciliation(table):
    rows = [("2024-01-01", s, v) for s, v in (("A", 1), ("B", 1), ("C", 1))]
    rows += [("2024-02-01", s, v) for s, v in (("A", 2), ("B", 2), ("C", 2))]
    b = battery(table("date segment revenue", rows), K.source_kpi("revenue"), numbers=["revenue"])
    parts = [r["contribution_percentage"] for r in b.contribution_rows().collect()]
    assert sum(parts) == pytest.approx(100, abs=1e-9)
    assert sum(r["share_percentage"] for r in b.segment_share_rows().collect()) == pytest.approx(100, abs=1e-9)


def test_quarters_and_issues(table):
    rows = [(f"2024-0{m}-15", "only", m * 10) for m in range(1, 7)]
    b = battery(table("date region revenue", rows), K.source_kpi("revenue"), cats=("region",), numbers=["revenue"])
    change = one(b.period_change())
    assert (change["previous_period"], change["current_period"]) == ("2024-Q1", "2024-Q2")
    assert change["percentage_change"] == 150.0
    found = {r["analysis"]: (r["available"], r["required"]) for r in issues(b).collect()}
    assert found["period_baseline_comparison"] == (1, 2)
    assert found["trend"] == (2, 3)
    assert found["segment_ranking:region"] == (1, 2)
    assert found["cohort_period_comparison:region"] == (1, 2)


def test_missing_categories_count_for_totals_only(table):
    rows = [("A", "x", 10), ("A", "y", 20), ("B", "x", 30), ("B", "", 40), ("", "y", 50), ("n/a", "y", 1)]
    t = table("c1 c2 v", rows)
    b = battery(t, K.source_kpi("v"), date=None, cats=("c1", "c2"), numbers=["v"])
    shares = {(r["category_column"], r["segment"]): r["value"] for r in b.segment_share_rows().collect()}
    assert shares == {("c1", "A"): 30, ("c1", "B"): 70, ("c2", "x"): 40, ("c2", "y"): 71}
    missing = {r["category_column"]: r["missing_category_count"] for r in b.segment_share().collect()}
    assert missing == {"c1": 2, "c2": 1}


def test_grouping_sets_equal_the_grid(table):
    """More than three categories switch the cells to one grouping set per category."""
    import random

    rng = random.Random(1)
    rows = [
        (f"2024-{rng.randint(1, 4):02d}-10", *(rng.choice("pqr") for _ in range(4)), rng.randint(1, 99))
        for _ in range(200)
    ]
    t = table("date a b c d v", rows)
    wide = battery(t, K.source_kpi("v"), cats=("a", "b", "c", "d"), numbers=["v"])
    values = lambda x: {
        (r["category_column"], r["segment"]): r["value"] for r in x.segment_ranking_rows().collect()
    }
    got = values(wide)
    for name in "abcd":
        assert {k: v for k, v in got.items() if k[0] == name} == values(
            battery(t, K.source_kpi("v"), cats=(name,), numbers=["v"])
        )
    assert one(wide.snapshot())["current_value"] == sum(r[-1] for r in rows)
    assert one(wide.period_change()) == one(battery(t, K.source_kpi("v"), cats=(), numbers=["v"]).period_change())


def test_wide_categories_are_refused(table):
    t = table("c v", [(f"v{i}", i) for i in range(60)])
    with pytest.raises(K.KpiError):
        battery(t, K.source_kpi("v"), date=None, cats=("c",), numbers=["v"]).segment_ranking_rows()


def test_correlation_sums_compute_each_kpi_once_a_row(table, capsys):
    rows = [(2, 3, 1), (4, None, 5), (None, 7, 6), (8, 9, None), (10, 11, 12)]
    b = battery(
        table("a b c", rows), K.source_kpi("a"), K.formula_kpi("net", "[a] * [b]", "row", "sum"),
        date=None, cats=(), numbers=["a", "b", "c"],
    )
    b.table.df.select(b.measures[1].row_value).explain()
    alone = capsys.readouterr().out.count("rint(")
    sums = b.correlation_sums()
    sums.explain()
    assert 0 < capsys.readouterr().out.count("rint(") <= alone
    got = {(r["metric"], r["associated_metric"]): tuple(r)[2:] for r in sums.collect()}
    assert got == {
        ("a", "b"): (3, 20.0, 23.0, 168.0, 211.0, 188.0),
        ("a", "c"): (3, 16.0, 18.0, 120.0, 170.0, 142.0),
        ("net", "a"): (3, 188.0, 20.0, 36.0 + 72.0**2 + 110.0**2, 168.0, 1688.0),
        ("net", "b"): (3, 188.0, 23.0, 36.0 + 72.0**2 + 110.0**2, 211.0, 1876.0),
        ("net", "c"): (2, 116.0, 13.0, 36.0 + 110.0**2, 145.0, 1326.0),
    }
