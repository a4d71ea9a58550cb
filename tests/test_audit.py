import json

import pytest
from pyspark.sql import functions as F

from metricloom.operators import audit as A

TEXTS = [
    "Revenue rose to 1,250.50 in March.",
    "Growth was 12% because of price.",
    "Nothing numeric here, please review it.",
    "About five percent of rows were late.",
    "Région5 and 7é stay, 8 does not.",
    "Values 1e3 and -4.5 and 1,00 and 3.",
    "x" * 801,
    "   ",
    "Q3 drove 2024-05 up; compare A1 with 10.",
    "Costs are $5 and 12,345.",
]
ALLOWED = ["1250.5", "12", "1000", "-4.5", "8", "10", "12345.00"]


#: Bad length, number of numbers, one unverified, digits that are no number; worked out by hand.
EXPECTED = [
    (False, 1, False, False),
    (False, 1, False, False),
    (False, 0, False, False),
    (False, 0, False, False),
    (False, 1, False, True),  # 5 and 7 touch letters
    (False, 5, True, False),  # 1e3, -4.5, 1, 00 and 3
    (True, 0, False, False),
    (True, 0, False, False),
    (False, 3, True, True),  # 2024, 05 and 10; Q3 and A1 are names
    (False, 2, True, False),
]


def test_number_rules(spark):
    df = spark.createDataFrame([(i, t, ALLOWED) for i, t in enumerate(TEXTS)], "i int, text string, n array<string>")
    rows = A.audit_commentary(df, "text", "n").orderBy("i").collect()
    for r, text, expected in zip(rows, TEXTS, EXPECTED, strict=True):
        assert (r["bad_length"], r["number_count"], r["unverified_number"], r["leftover_digit"]) == expected, text
    assert [r["causal_language"] for r in rows][1] and rows[3]["spelled_number"]
    assert rows[1]["forbidden_symbol"] and rows[9]["forbidden_symbol"]
    assert [r["i"] for r in rows if r["accepted"]] == [0, 2]


def test_percent_needs_a_percentage_fact(spark):
    df = spark.createDataFrame(
        [("Up 12% now", ["12"], ["percentage change"]), ("Up 12% now", ["12"], ["total"])],
        "text string, n array<string>, f array<string>",
    )
    rows = A.audit_commentary(df, "text", "n", None, "f").collect()
    assert [r["accepted"] for r in rows] == [True, False]


def test_labels_are_removed_before_counting(spark):
    df = spark.createDataFrame([("Zone 51 North beat Zone 5", ["Zone 51 North", "Zone 5"])], "text string, l array<string>")
    row = A.audit_commentary(df, "text", None, "l").first()
    assert row["number_count"] == 0 and row["accepted"]


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("password=abc next", "password=[REDACTED] next"),
        ("API-Key: x,y", "API-Key: [REDACTED],y"),
        ("Authorization Bearer abc.def==", "Authorization Bearer [REDACTED]"),
        ("tokens = 5", "tokens = 5"),
        ("plain", "plain"),
    ],
)
def test_secrets(spark, text, expected):
    assert value(spark, text, A.redact_secrets) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Up 1,250.5% in a2b and Seven or 3",
         "Up the configured threshold in a2b and the configured threshold or the configured threshold"),
        ("$5 apples, first", "the configured threshold apples, the configured threshold"),
        ("no numbers", "no numbers"),
        ("x7 7x 9", "x7 7x the configured threshold"),
    ],
)
def test_number_redaction(spark, text, expected):
    assert value(spark, text, A.redact_numbers) == expected


def test_shortened(spark):
    long = "word " * 60
    got = value(spark, long, A.shortened)
    assert len(got) <= 160 and got.endswith("word...") and "  " not in got
    assert value(spark, " a   b ", A.shortened) == "a b"
    assert value(spark, "x" * 200, A.shortened) == "x" * 157 + "..."


def test_context_label(spark):
    df = spark.createDataFrame(
        [("North is up", ["North"]), ("Northern is up", ["North"]), ("C++ (x) ok", ["C++ (x)"]), ("any", [])],
        "t string, l array<string>",
    )
    assert [r[0] for r in df.select(A.names_label(F.col("t"), F.col("l"))).collect()] == [True, False, True, True]


def test_flatten_bounds(spark):
    doc = {
        "a": 1, "flag": True, "s": "North  East", "id": "EVD-0123456789ABCDEF",
        "list": list(range(12)),
        "deep": {"b": {"c": {"d": {"e": 5, "f": {"g": 6}}}}},
        "worst_segment": {"segment": "South", "breach_percentage": 12.5},
    }
    df = spark.createDataFrame([("k", json.dumps(doc))], "k string, j string")
    numbers = {r["path"]: r["number"] for r in A.flatten_numbers(df, "k", "j", 5, 12, 8).collect()}
    assert numbers["facts.a"] == 1 and "facts.flag" not in numbers
    assert sum(p.startswith("facts.list") for p in numbers) == 8
    assert numbers["facts.deep.b.c.d.e"] == 5 and "facts.deep.b.c.d.f.g" not in numbers
    labels = {r["path"]: r["label"] for r in A.flatten_labels(df, "k", "j", 5, 12, 8, 120).collect()}
    assert labels == {"facts.s": "North East", "facts.worst_segment.segment": "South"}
    top = A.top_facts(A.flatten_numbers(df, "k", "j"), "k", 8).orderBy("position").collect()
    assert len(top) == 8 and top[0]["path"] == "facts.worst_segment.breach_percentage"
    assert top[0]["reference"] == "k::FACT-001"


def test_groups(spark):
    points = spark.createDataFrame(
        [("ok", f"t{i}", ["s"]) for i in range(5)]
        + [("same", "T", ["s"]) for _ in range(5)]
        + [("few", "t", ["s"])]
        + [("links", f"t{i}", ["a", "b", "c"]) for i in range(5)],
        "r string, t string, s array<string>",
    )
    assert sorted(r["r"] for r in A.report_problems(points, "r", "t", "s").collect()) == ["few", "links", "same"]
    facts = spark.createDataFrame([("a",), ("b",)], "reference string")
    refs = spark.createDataFrame(
        [("good", "a"), ("good", "b"), ("twice", "a"), ("twice", "a"), ("odd", "z")], "g string, reference string"
    )
    assert sorted(r["g"] for r in A.reference_problems(refs, facts, "g").collect()) == ["odd", "twice"]


def test_every_fact_is_found(spark):
    import json

    deep = {"l1": {"l2": {"l3": {"l4": {"l5": {"l6": {"value": 7}}}}}}}
    facts = {f"k{i:02d}": i for i in range(13)} | {"list": list(range(100, 109)), "text": "x" * 200, "odd": "[[[{", **deep}
    df = spark.createDataFrame([(1, json.dumps(facts))], "id int, facts string")
    found = {r["number"] for r in A.flatten_numbers(df, "id", "facts").collect()}
    assert found == {*map(float, range(13)), *map(float, range(100, 109)), 7.0}
    assert {r["label"] for r in A.flatten_labels(df, "id", "facts").collect()} == {"x" * 200, "[[[{"}
    some = A.flatten_numbers(df, "id", "facts", 5, 12, 8)
    left = A.omitted_leaves(A.flatten_numbers(df, "id", "facts"), some, "id").first()
    assert left["omitted_count"] == 22 + 1 - some.count()


@pytest.mark.parametrize(
    "told, fact, accepted",
    [
        ("1e-13", "0", False), ("0.0000000000004", "0", False), ("0.000", "-0", True), ("1" * 40, "1" * 40, True),
        ("1" * 40, "1" * 39 + "2", False), ("1,250.0", "1.25E3", True), ("+7", "07", True), ("-7", "7", False),
        ("1e400", "10e399", True), ("5", "x", False), ("100", "1e2", True), ("0.50", ".5", True),
    ],
)
def test_exact_numbers(spark, told, fact, accepted):
    texts = spark.createDataFrame([(f"It is {told} now", [fact])], "text string, numbers array<string>")
    row = A.audit_commentary(texts, "text", "numbers").first()
    assert row["accepted"] == accepted and row["number_count"] == 1
