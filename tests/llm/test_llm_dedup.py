"""Exact, near and substring deduplication against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from metricloom.llm import exact_dedup, simhash, substring_dedup
from metricloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, kept int, id int"


def frame(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "d", 7, i and i % 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(60)]
    out = list(base)
    for t in base[:25]:
        ws = t.split()
        if len(ws) > 40:
            ws[rng.randrange(len(ws))] = "changed"
            out.append(" ".join(ws))
    passage = " ".join(rng.choices(words, k=55))
    out += [f"{t} {passage} {rng.choice(words)}" for t in base[:12]]
    out += base[:10] + ["", None, "A  b\tC", "x " * 300, "the same " * 60]
    rng.shuffle(out)
    return list(enumerate(out, 1))


def test_exact(spark, texts):
    rows = [*texts, (None, "only null id"), (None, "w1"), (1, texts[0][1])]
    docs = frame(spark, rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    want = sorted(
        (
            (i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())
            for i, t in rows
        ),
        key=repr,
    )
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    stay = exact_dedup.without_copies(docs)
    assert stay.columns == docs.columns
    kept = stay.collect()
    assert sorted(r.text or "" for r in kept) == sorted(groups)


def test_exact_index_grows(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    first = frame(spark, [(1, "a"), (2, "a"), (3, "b")])
    assert exact_dedup.without_copies(first, index).count() == 2
    again = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    second = frame(spark, [(4, "a"), (5, "c"), (6, "c")])
    assert [r.doc_id for r in exact_dedup.without_copies(second, again).collect()] == [6]
    assert again.rows().count() == 3
    assert exact_dedup.exact_dedup(frame(spark, []).limit(0), again).count() == 0


def test_buckets_follow_the_rows(spark, texts, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET_ROWS", 3)
    monkeypatch.setattr(exact_dedup, "BUCKETS", 2)
    docs = frame(spark, [(i, f"text {i % 4}") for i in range(10)])
    assert exact_dedup.index_for(docs).buckets == 4
    assert exact_dedup.index_for(docs.limit(0)).buckets == 2
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(docs).collect()} == {(i, max(j for j in range(10) if j % 4 == i % 4)) for i in range(10)}


def test_hot_digest(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 3)
    rows = [(i, "hot") for i in range(50)] + [(100 + i, f"t{i}") for i in range(20)]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()}
    assert got[3].keep_id == 49 and got[3].group_size == 50 and got[105].kept


def brute_print(text):
    table = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    words = text.translate(table).replace("\t", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, ids):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return [least[find(k)] for k in range(len(prints))]


def test_simhash(spark, texts, monkeypatch):
    docs = frame(spark, texts)
    prints = [brute_print(t or "") for _, t in texts]
    want = roots(prints, [i for i, _ in texts])
    got = {r.doc_id: r for r in simhash.simhash_groups(docs).collect()}
    assert [got[i].fingerprint for i, _ in texts] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i, _ in texts] == want
    stay = simhash.one_of_each_group(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(set(want))


def test_simhash_odd_rows(spark):
    docs = frame(spark, [(None, "a b c"), (5, "a b c"), (5, "a b c"), (7, None), (8, ""), (7, "x y z u v")])
    got = simhash.simhash_groups(docs).collect()
    assert len(got) == 6
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {7}
    stay = simhash.one_of_each_group(docs).collect()
    assert {(r.doc_id, r.text) for r in stay} == {(None, "a b c"), (7, None), (7, "x y z u v")} and len(stay) == 3
    assert simhash.one_of_each_group(docs.limit(0)).count() == 0
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [8, 4096])
def test_links_lose_nothing(spark, monkeypatch, tile):
    """Dense clusters: the forests connect exactly what brute force connects."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(3)
    prints = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(60):
            p = centre
            for b in rng.sample(range(64), rng.randint(0, 7)):
                p ^= 1 << b
            prints.add(p)
    prints = sorted(prints)
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    found = simhash.grouped_prints(spark.createDataFrame(rows, "id long, print long")).collect()
    got = {r["print"]: r.component_id for r in found}
    assert [got[p] for _, p in rows] == roots(prints, range(len(prints)))


def test_forest_walk():
    rng = np.random.default_rng(1)
    prints = np.unique(rng.integers(0, 1 << 12, 300, np.uint64))
    ends = simhash.forest(prints, 1)
    assert all((int(prints[a]) ^ int(prints[b])).bit_count() <= 1 for a, b in ends)
    assert len({b for _, b in ends}) == len(ends)


def test_components_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (300, 301), (301, 300)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[301] == 300 and 500 not in got


def brute_substring(rows):
    seen, out = {}, {}
    distinct = sorted({(i, t or "") for i, t in rows})
    for i, t in distinct:
        words = t.encode().split()
        gone = set()
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone.update(range(k, k + 20))
            seen[window] = True
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("limits", [{}, {"seen": 2, "sample": 1, "least": 2}])
def test_substring(spark, texts, limits):
    got = substring_dedup.substring_dedup(frame(spark, texts).repartition(5), **limits).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_substring(texts)
    assert len(got) == len(texts)


def test_substring_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(None, passage), (4, passage), (4, passage), (9, "short"), (10, None), (11, "a b " * 4000)]
    got = substring_dedup.substring_dedup(frame(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    # of "a b a b ...", the windows from the third on repeat the first two: words 2 to the end go
    assert by == {None: [(30, 0)], 4: [(30, 30), (30, 30)], 9: [(1, 0)], 10: [(0, 0)], 11: [(8000, 7998)]}
    assert substring_dedup.substring_dedup(frame(spark, rows).limit(0)).count() == 0
    text = {r.doc_id: r.text for r in substring_dedup.without_repeats(frame(spark, rows)).collect()}
    assert text[4] == "" and text[9] == "short"


def test_substring_tells_ids_apart_by_whole_hashes(spark):
    """Two texts of one id whose 64-bit hashes agree in the low 32 bits."""
    passage, clean = " ".join(f"p{i}" for i in range(30)), " ".join(f"c{i}" for i in range(25))
    rows = [(None, f"{passage} {passage} a38021"), (None, f"{clean} b38675")]
    docs = frame(spark, rows)
    marks = [r.mark for r in docs.select(F.xxhash64("text").alias("mark")).collect()]
    assert marks[0] != marks[1] and marks[0] & 0xFFFFFFFF == marks[1] & 0xFFFFFFFF
    got = substring_dedup.substring_dedup(docs).collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == [(26, 0), (61, 30)]


def test_stretches_of_many_texts():
    """Minimisers over all texts at once equal those of text by text."""
    rng = random.Random(21)
    texts = [" \t".join(rng.choices([f"w{k}" for k in range(rng.choice([1, 2, 300]))], k=rng.randrange(0, 400))).encode() for _ in range(60)]
    texts += [b"", b"a b", b"same " * 900]
    hashes = substring_dedup._Hashes()
    one, text = substring_dedup._word_hashes(texts, hashes)
    assert np.bincount(text, minlength=len(texts)).tolist() == [len(t.split()) for t in texts]
    least, windows = substring_dedup._stretches(one, text)
    want, counts = [], []
    for t in texts:
        some, _, lengths, _ = substring_dedup.super_kmers(t.split(), hashes)
        for m, c in zip(some.tolist(), lengths.tolist()):
            if counts and want[-1] == (t, m):
                counts[-1] += c  # a stretch that is cut
            else:
                want.append((t, m))
                counts.append(c)
    assert least.tolist() == [m for _, m in want] and windows.tolist() == counts
