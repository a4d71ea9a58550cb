"""Hard negatives and the conversation trie against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.llm import hard_negatives, prefix_trie

CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, part string, lo long"


def brute_negatives(rows, positives=5, negatives=10):
    out = []
    for i, (a, label, vector) in enumerate(rows):
        if a is None or a % 100:
            continue
        scores = []
        for j, (b, other, values) in enumerate(rows):
            if i != j:
                size = min(len(vector), len(values))
                score = sum(x * y for x, y in zip(vector[:size], values[:size]))
                scores.append((-score, b is not None, b or 0, b, other == label))
        scores.sort(key=lambda s: s[:3])
        for s, _, _, positive, _ in [x for x in scores if x[4]][:positives]:
            hard = [x for x in scores if not x[4] and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(a, positive, rank, x[3], -s, -x[0]) for rank, x in enumerate(hard, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(400):
        size = [12, 12, 12, 9][k % 4]
        vector = rng.integers(-40, 90, size).tolist()
        rows.append((k if k % 4 else k * 25, int(rng.integers(0, 3)), vector))
    rows += [rows[4]] * 3 + [rows[7]] * 12 + [(None, 1, rows[9][2]), (8, 2, rows[9][2]), (500, 0, [])]
    frame = spark.createDataFrame(rows, "id long, label long, vector array<long>").withColumn(
        "id", F.coalesce("id", F.lit(-(2**63)))
    )
    got = hard_negatives.hard_negatives(frame, F.col("id") % 100 == 0, rows_per_task=64, block_bytes=12 * 8 * 20)
    want = brute_negatives(rows)
    assert want and sorted(map(tuple, got.collect()), key=repr) == want


def test_scan_leaves_nothing_out():
    rng = np.random.default_rng(5)
    columns = rng.integers(-9, 20, (23, 700)).astype("float32")
    low, high = columns.min(axis=1).astype(np.int64), columns.max(axis=1).astype(np.int64)
    for _ in range(20):
        anchor = rng.integers(-9, 20, 23).astype("float32")
        exact = anchor @ columns
        least, most = sorted(rng.choice(exact, 2))
        places, scores = hard_negatives.vertical_scan(columns, np.arange(700), anchor, (low, high), int(least), int(most))
        assert places.tolist() == np.flatnonzero((exact >= least) & (exact <= most)).tolist()
        assert scores.tolist() == exact[places].tolist()
        places, _ = hard_negatives.vertical_scan(columns, np.arange(700), anchor, (low, high), -(10**9), 10**9, 7)
        assert set(np.flatnonzero(exact >= np.sort(exact)[-7])) <= set(places.tolist())


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.001], 1), (1, None, 1), (2, [0.1, nan], 1), (3, [inf, 0.0], 1), (4, [None, 0.0], 1), (5, [0.3], None), (None, [], 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("vector", F.lit("x"))
    got = hard_negatives.quantised(frame, F.col("label")).collect()
    assert [tuple(r) for r in got] == [(0, 1, [128, -1]), (-(2**63), 2, [])]
    empty = hard_negatives.hard_negatives(hard_negatives.quantised(frame.limit(0), F.col("label")), F.col("id") % 100 == 0)
    assert empty.collect() == [] and empty.columns[0] == "anchor_id"
    large = spark.createDataFrame([(0, 1, [2**40, 1])], "id long, label long, vector array<long>")
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(large, F.col("id") % 100 == 0)


def test_node_table():
    rng = np.random.default_rng(2)
    for size in (0, 1, 2, 50, 5000):
        lo, hi = rng.integers(0, 2**63, (2, size)).astype(np.uint64)
        table = prefix_trie.NodeTable(lo, hi)
        assert sorted(table.slots(lo, hi).tolist()) == list(range(size))
        assert (table.slots(lo + np.uint64(1), hi) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.NodeTable(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


def taken_over(c):
    return zlib.crc32(str(c).encode()) % 6


def brute_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, digest, (role, text)))
    turns = {c: [t[3] for t in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = taken_over(c)
        block = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built = tuple(turns.get(block, [])[:h] + turns[c][h:])
        for d in range(len(built) + 1):
            members[built[:d]].append(c)
        ends[built].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return sorted(
        (
            members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), children[n], leaves[n], saved[n],
            hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest(),
        )
        for n in members
    )


@pytest.mark.parametrize("most_rows", [11, 40, 10**6])
def test_trie(spark, most_rows):
    rng = random.Random(most_rows)
    rows = []
    for c in [*range(-3, 0), *range(0, 40), *range(100, 140), *range(201, 230)]:
        for turn in range(rng.choice([1, 2, 3, 4, 6, 8])):
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(["user", "bot", None]), rng.choice(["a", "bé", "", None, "long text"])))
    long = [("user", rng.choice("xyz")) for _ in range(90)]
    # copies and branches of conversations that span many shards, one of them the first of a block
    for c, cut in [(300, 90), (301, 90), (305, 88), (308, 30), (321, 90), (322, 90), (399, 6), (400, 90), (410, 7)]:
        rows += [(c, t, r, x if t < cut - 1 or c % 2 else "other") for t, (r, x) in enumerate(long[:cut])]
    rows += [(500, 1, "user", "same")] * 50 + [(501, 1, "user", "same")] * 3 + [(None, 1, "user", "no conversation")]
    rows = [(*r, 3, "p", 7) for r in rows]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, CONVERSATIONS)
    got = prefix_trie.prefix_trie(frame, F.crc32(F.col("conv").cast("string").cast("binary")) % 6, most_rows=most_rows)
    key = lambda r: tuple(-(10**9) if v is None else v for v in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute_trie(rows), key=key)


def test_empty_trie(spark):
    nothing = spark.createDataFrame([(None, 1, "a", "b", 1, "p", 2)], CONVERSATIONS)
    assert prefix_trie.prefix_trie(nothing).collect() == []
    assert prefix_trie.prefix_trie(nothing.limit(0)).collect() == []
