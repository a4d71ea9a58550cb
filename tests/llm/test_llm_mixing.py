"""Mixing, the pipeline, and the registered queries on the smallest tables."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import SMALL, oracle_sql, queries
from check_queries import compare, connect
from metricloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "k", 3) for i, t, s in rows], SCHEMA)


def brute_targets(sizes):
    """Cap and share again until no source is above three times its size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weights = {s: 1 + k % 3 for k, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        rest = total - sum(capped.values())
        weight = sum(w for s, w in weights.items() if s not in capped)
        goal = {s: capped.get(s, rest * w / weight if weight else 0.0) for s, w in weights.items()}
        new = {s: 3.0 * sizes[s] for s in goal if s not in capped and goal[s] > 3 * sizes[s]}
        if not new:
            return goal
        capped |= new


def test_permutations():
    for length in (1, 2, 3, 7, 64, 1000):
        index = np.arange(length)
        got = mixing.permuted(index, np.full(length, length), np.full(length, 12345, np.uint64))
        assert sorted(got) == list(index)
    both = [mixing.permuted(np.arange(100), np.full(100, 100), np.full(100, k, np.uint64)).tolist() for k in (1, 2)]
    assert both[0] != both[1]


def test_draws_in_two_levels(monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 7)
    rows = pd.DataFrame({"key": ["=a", "=b"], "blocks": [9, 4], "part": [0, 0], "from": [0, 0], "slots": [5000, 3]})
    groups = pd.concat(mixing._dealt(23, 1, "groups")([rows]))
    drawn = pd.concat(mixing._dealt(23, 1, "shards")([groups]))
    assert drawn.equals(pd.concat(mixing._dealt(23, 1, "shards")([groups])))
    for key, slots in (("=a", 5000), ("=b", 3)):
        mine = drawn[drawn["key"] == key].sort_values("part")
        assert mine["part"].is_unique and mine["part"].between(0, 22).all()
        assert mine["from"].tolist() == (mine["slots"].cumsum() - mine["slots"]).tolist()
        assert mine["slots"].sum() == slots
    counts = drawn[drawn["key"] == "=a"]["slots"].to_numpy()
    assert len(counts) == 23 and ((counts - 5000 / 23) ** 2 / (5000 / 23)).sum() < 60


def test_offsets_of_sources(spark):
    docs = frame(spark, [(i, "w " * (i % 5), "abc"[i % 3] if i % 7 else None) for i in range(400)])
    mixing_chunk, mixing.CHUNK = mixing.CHUNK, 20
    try:
        rows = mixing.placed(mixing.measured(docs)).collect()
    finally:
        mixing.CHUNK = mixing_chunk
    assert len(rows) == 400
    for key in {r.key for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.key == key), key=lambda r: (r.chunk, r.place)):
            assert r.first == at
            at += r.size


def test_many_sources(spark):
    sizes = {f"s{i:04}": (i * 37) % 101 for i in range(600)} | {"hot": 30_000, None: 12}
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())]
    want = brute_targets(sizes)
    got = {r.source: r.target for r in mixing.targets(mixing.measured(frame(spark, rows))).selectExpr("nullif(substring(key, 2), '') source", "target").collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[s] - t) < 1e-6 * max(1, t) for s, t in want.items())


def test_mixing(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 400))), ["a", "b", "é", "c", None, "tiny"][i % 6] if i % 6 < 5 or i < 8 else "a") for i in range(300)]
    rows += [(1000, None, "b"), (1001, "", "only empty"), (None, "w " * 500, "a"), (1002, "w " * 3000, "c"), (1002, "w " * 3000, "c")]
    docs = frame(spark, rows)
    got = mixing.mixing(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    goals = brute_targets(sizes)
    names = {i: s for i, _, s in rows}
    taken = {}
    for r in got:
        source = names[r.doc_id]
        assert r.source_size == sizes[source] and abs(r.target - goals[source]) < 1e-6 * max(1, goals[source])
        assert 0 <= r.taken <= 3 * r.size
        taken[source] = taken.get(source, 0) + r.taken
    for s, goal in goals.items():
        assert abs(taken[s] - goal) <= 2 * mixing.BLOCK + 0.01 * goal, (s, taken[s], goal)
    again = mixing.mixing(docs.repartition(3)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert mixing.mixing(docs.limit(0)).count() == 0
    blocks = mixing.mixed_blocks(docs)
    per_source = {r.source: r.n for r in blocks.groupBy("source").agg(F.sum("n_words").alias("n")).collect()}
    assert per_source == {s: n for s, n in taken.items() if n}
    assert all(len(r.text.split()) == r.n_words for r in blocks.collect())


def test_targets_reach_caps(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate({"a": 1000, "b": 5, "c": 7, "d": 400, None: 3}.items())]
    got = {r.doc_id: r.target for r in mixing.mixing(frame(spark, rows)).collect()}
    want = brute_targets({"a": 1000, "b": 5, "c": 7, "d": 400, None: 3})
    assert all(abs(got[i] - t) < 1e-6 for i, t in enumerate(want[s] for s in ("a", "b", "c", "d", None)))
    assert abs(sum(got.values()) - 1415) < 1e-6


def test_small_sources_take_their_targets(spark):
    sizes = {"hot": 60_000, **{f"s{n:03}": n for n in (3, 10, 20, 31, 33, 64, 65, 96, 128, 130, 200, 300)}, "without": 0, None: 7}
    docs = frame(spark, [(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())])
    got = dict(zip(sizes, sorted(mixing.mixing(docs).collect(), key=lambda r: r.doc_id), strict=True))
    for s, r in got.items():
        assert r.taken <= 3 * r.size
        if s == "hot":
            assert abs(r.taken - r.target) <= mixing.BLOCK
        else:
            assert r.taken == r.target == 3 * r.size, s


def test_uncapped_sources_come_near_their_targets(spark):
    sizes = {"a": 300, "b": 290, "c": 65, "d": 130, "e": 70}
    for r in mixing.mixing(frame(spark, [(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())])).collect():
        assert 0 < r.taken and abs(r.taken - r.target) <= mixing.BLOCK


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL)
        assert after.columns == docs.columns, name
        assert after.exceptAll(before).count() == 0, name
        assert 0.5 * before.count() < after.count() <= before.count(), name
        before = after
    texts = {r.text for r in before.select("text").collect()}
    assert len(texts) == before.count()


def test_pipeline_takes_odd_rows(spark):
    rows = [(None, None, None), (1, "", "s"), (1, "", "s"), (2, "abc " * 9000, None), (3, "A b c", "s"), (3, "A b c", "s")]
    docs = frame(spark, rows).drop("key", "size").withColumn("id", F.lit(1)).withColumn("print", F.lit("p"))
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SMALL)
        assert (now.count() == 0) == empty


def test_run(spark):
    first, second = corpus_pipeline.run(spark, SMALL), corpus_pipeline.run(spark, SMALL)
    assert first.count() > 0
    assert first.exceptAll(second).count() == 0


LLM = [n for n in queries() if n.startswith("op") and n[2].isdigit()]


@pytest.mark.skipif(not Path(SMALL).exists(), reason="test data is absent")
@pytest.mark.parametrize("name", LLM)
def test_query(spark, name):
    problem = compare(spark, connect(SMALL), SMALL, name)
    if name in oracle_sql():
        assert problem is None
    else:
        assert problem.startswith("no oracle (")
