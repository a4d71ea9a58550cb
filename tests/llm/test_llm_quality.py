"""Document counts against brute force, and decision lists on planted and given labels."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import SMALL
from metricloom.llm import quality_rules as Q
from metricloom.llm.common import read

SCHEMA = "doc_id long, text string, n_words string, quality string, bad string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        len(lines), sum(a == b for a, b in zip(words, words[1:])), len(set(words)),
    )


def cases():
    rng = random.Random(4)
    texts = [None, "", " ", "\n\n \t", "a", " é|b", "w " * 7, "w " * 8, "w " * 9, "x\ny\nx\n\n x\n", "\x00 \x1f|", "😀 " * 30 + "#$%&"]
    for _ in range(150):
        pool = rng.choice([["a", "b"], ["ab", "é", "<x>", "12"], [f"w{i}" for i in range(40)]])
        texts.append("".join(rng.choice(pool) + rng.choice([" ", "  ", "\n", "\t", "\x0b", " "]) for _ in range(rng.randrange(60))))
    line = " ".join(f"w{i}" for i in range(9))
    texts += [line + "\n" + line, line + " " + line[3:], "b " + line + "\nc\n" + line * 3]
    return texts


@pytest.mark.parametrize("together", [1, 300, 4_000_000])
def test_counts(spark, together, monkeypatch):
    texts = [t.encode() if t else b"" for t in cases()]
    got, start = [], 0
    while start < len(texts):  # as the batches are cut
        stop = start + 1
        while stop < len(texts) and sum(map(len, texts[start : stop + 1])) <= together:
            stop += 1
        counts = Q._counts(texts[start:stop])
        got += list(zip(*(counts[c].tolist() for c in Q.COUNTS[:8])))
        start = stop
    assert got == [brute(t) for t in cases()]


def test_statistics_of_any_table(spark):
    texts = [*cases(), "long " * 300_000 + "end", " ".join(f"w{i}" for i in range(200_000)) * 2]
    rows = [(None if i == 3 else i // 2, t, "x", "y", "z") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [(r.doc_id, *(r[c] for c in Q.COUNTS[:8])) for r in Q.statistics(frame).collect()]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(got, key=key) == sorted(((r[0], *brute(r[1])) for r in rows), key=key)


def planted(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(rng.randrange(25, 80))]
        kind = rng.randrange(5)
        if kind == 0:
            words = [w + "##" if rng.random() < 0.8 else w for w in words]
        elif kind == 1:
            words = [w.upper() + "WW" if rng.random() < 0.9 else w for w in words]
        docs.append((i, " ".join(words), "x", "y", "z"))
        bad = kind < 2 if rng.random() > 0.01 else kind >= 2
        labels.append((i, int(not bad), 0))
        if i % 50 == 0:
            labels.append((i, None, 1))
    return docs, labels, {i for i, t, *_ in docs if "##" in t or "WW" in t}


def test_rules_find_planted_causes(spark):
    docs, labels, bad = planted(1500, 1)
    copies = [(10_000 + i, "the same good words again " + " ".join("kmno"[k % 4] * (k // 4 + 1) for k in range(30)), "x", "y", "z") for i in range(500)]
    labels += [(10_000 + i, 1, 0) for i in range(500)]
    frame = spark.createDataFrame(docs + copies, SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = Q.quality(frame, marks).collect()
    rejected = {r.doc_id for r in got if not r.kept}
    assert len(rejected ^ bad) <= 15 and not {r for r in rejected if r >= 10_000} and len(got) == 2000
    assert all(r.reason for r in got if not r.kept)


def test_without_labels(spark):
    docs, labels, _ = planted(40, 2)
    docs += [(100, None, "x", "y", "z"), (101, "few words", "x", "y", "z"), (None, "a b c d e f g h " * 5, "x", "y", "z")]
    frame = spark.createDataFrame(docs, SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for nothing in (marks.limit(0), marks.withColumn("quality", F.lit(None).cast("int")), marks.withColumn("quality", F.lit(1))):
        got = Q.quality(frame, nothing).collect()
        assert len(got) == len(docs) and all(r.kept != r.base_failed for r in got)
        assert {r.doc_id for r in got if r.base_failed} == {100, 101, None}
    assert Q.quality(frame.limit(0), marks).collect() == []


def test_held_out_labels(spark):
    """Rules from two thirds of the labels decide the others."""
    folder = SMALL.replace("0.001", "0.01")
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    stats = Q.statistics(docs).cache()
    listed = Q.learn(Q.labelled_cells(stats, labels.where(~held)))
    judged = stats.join(labels.where(held), "doc_id").select(
        "quality", F.when(Q.base_failed(), False).otherwise(listed.keeps()).alias("kept")
    ).collect()
    bad = [r.kept for r in judged if r.quality == 0]
    good = [r.kept for r in judged if r.quality == 1]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.35 * len(bad)
