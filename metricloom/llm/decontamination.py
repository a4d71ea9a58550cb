"""Benchmark decontamination with a generalised suffix automaton.

Items and documents are sequences of words: runs of ASCII letters and digits and of all
other non-ASCII characters, with A-Z lower-cased.  The automaton of all items accepts every
word sequence that occurs in an item.  The words of a document are streamed through it; the
length of the longest match that ends at each word tells which words lie in a window of
``window`` item words (an item of fewer words is one window), and each state knows the items
its windows occur in.

The automaton lives in every task, so its size is bounded: distinct items are dealt by a hash
into shards of about ``SHARD_WORDS`` words at most.  Executor tasks build one automaton each;
the driver passes on the bytes of one at a time and never opens them.  With several shards,
each but the last leaves slim rows (digest of the text, stretches, items) of the documents it
hits, and the last pass takes them up, so a task holds one automaton.

Results for unusual input: NULL and wordless documents have no words and are not
contaminated; NULL, empty and wordless items have no windows; repeated items count by their
id, once for each distinct id; a NULL item id is left out of ``items_sha256`` but counts.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import ROW, in_batches, text_of, unwrapped, wrapped, written

WINDOW = 13
#: A document is contaminated from this share of hit words on: one in so many.
COVERAGE = 20
#: Item words in one automaton.
SHARD_WORDS = 2_000_000
#: Bytes of a built automaton in one row.
PIECE = 8 << 20

_KEPT = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
#: Lower-cases A-Z and turns every separating byte into a space.
_TABLE = bytes(
    c if c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the windows of its items.

    ``step`` maps state * words + word to a state; ``link`` and ``longest`` are the suffix
    link and the longest length of each state.  ``at_window[s]`` is the state on the suffix
    path of ``s`` that holds the windows of full length, or -1; ``short[s]`` lists (length,
    items) of shorter items that end in the matches of ``s``.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        for _, words in items:
            for w in words:
                self.number.setdefault(w, len(self.number))
        self.count = max(1, len(self.number))
        self.step: dict[int, int] = {}
        self.link, self.longest = [-1], [0]
        self._next: list[dict[int, int]] = [{}]
        ends: list[list[int]] = []
        for _, words in items:
            last, states = 0, []
            for w in words:
                last = self._extend(last, self.number[w])
                states.append(last)
            ends.append(states)
        for state, following in enumerate(self._next):
            for word, target in following.items():
                self.step[state * self.count + word] = target
        del self._next
        self._windows(items, ends)

    def _extend(self, last: int, word: int) -> int:
        following = self._next
        if word in following[last]:
            target = following[last][word]
            if self.longest[target] == self.longest[last] + 1:
                return target
            return self._clone(last, word, target)
        state = self._add(self.longest[last] + 1, {})
        at = last
        while at != -1 and word not in following[at]:
            following[at][word] = state
            at = self.link[at]
        if at == -1:
            self.link[state] = 0
        else:
            target = following[at][word]
            exact = self.longest[target] == self.longest[at] + 1
            self.link[state] = target if exact else self._clone(at, word, target)
        return state

    def _clone(self, at: int, word: int, target: int) -> int:
        copy = self._add(self.longest[at] + 1, dict(self._next[target]))
        self.link[copy] = self.link[target]
        self.link[target] = copy
        while at != -1 and self._next[at].get(word) == target:
            self._next[at][word] = copy
            at = self.link[at]
        return copy

    def _add(self, longest: int, following: dict[int, int]) -> int:
        self.longest.append(longest)
        self.link.append(0)
        self._next.append(following)
        return len(self.longest) - 1

    def _windows(self, items, ends) -> None:
        size = self.window
        order = np.argsort(self.longest, kind="stable").tolist()
        self.at_window = [-1] * len(self.longest)
        self.short: list[tuple] = [()] * len(self.longest)
        self.items: dict[int, list[int]] = {}
        shorts: dict[int, dict[int, list[int]]] = {}
        for state in order[1:]:
            link = self.link[state]
            if self.longest[link] < size <= self.longest[state]:
                self.at_window[state] = state
            elif self.longest[link] >= size:
                self.at_window[state] = self.at_window[link]
        for i, (_, words) in enumerate(items):
            if not words:
                continue
            if len(words) < size:
                at = ends[i][-1]
                # the state whose matches include exactly this many words
                while self.longest[self.link[at]] >= len(words):
                    at = self.link[at]
                shorts.setdefault(at, {}).setdefault(len(words), []).append(i)
            else:
                for at in {self.at_window[s] for s in ends[i][size - 1 :]}:
                    self.items.setdefault(at, []).append(i)
        for state in order[1:]:
            own = tuple((n, tuple(who)) for n, who in sorted(shorts.get(state, {}).items()))
            self.short[state] = self.short[self.link[state]] + own
        self.any_short = any(self.short)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Stretches of hit words (end exclusive, in order, disjoint) and the items found."""
        get, step, link, longest = self.number.get, self.step, self.link, self.longest
        at_window, short, count, size = self.at_window, self.short, self.count, self.window
        stretches: list[list[int]] = []
        states: set[int] = set()
        found: set[int] = set()
        state = length = 0
        shortest = 1 if self.any_short else size
        for i, word in enumerate(words):
            number = get(word)
            if number is None:
                state = length = 0
                continue
            target = step.get(state * count + number)
            while target is None and state:
                state = link[state]
                length = longest[state]
                target = step.get(state * count + number)
            if target is None:
                continue
            state = target
            length += 1
            if length < shortest:
                continue
            reach = 0
            if length >= size:
                reach = length
                states.add(at_window[state])
            if short[state]:
                for n, who in short[state]:
                    if n <= length:
                        reach = max(reach, n)
                        found.update(who)
            if reach:
                start = i + 1 - reach
                while stretches and stretches[-1][1] >= start:
                    start = min(start, stretches.pop()[0])
                stretches.append([start, i + 1])
        for s in states:
            found.update(self.items[s])
        return [(a, b) for a, b in stretches], found


@dataclass(frozen=True)
class Shard:
    """One automaton with the ids of its items, as text."""

    automaton: Automaton
    ids: list[str | None]


class Packed:
    """The bytes of a shard, opened once by each Python worker that needs it."""

    def __init__(self, data: bytes):
        self.data = data

    @cached_property
    def shard(self) -> Shard:
        return pickle.loads(self.data)


def _packed(items: list[tuple[str | None, str]], window: int) -> bytes:
    return pickle.dumps(Shard(Automaton([(i, words_of(t)) for i, t in items], window), [i for i, _ in items]), protocol=5)


def _built(window: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids = [None if pd.isna(i) else i for i in rows["item_id"]]
        data = _packed(sorted(zip(ids, rows["text"], strict=True), key=lambda r: (r[0] or "", r[1])), window)
        starts = range(0, len(data), PIECE)
        return pd.DataFrame(
            {"part": rows["part"].iloc[0], "piece": range(len(starts)), "data": [data[a : a + PIECE] for a in starts]}
        )

    return run


def shards_of(benchmark: DataFrame, words: int = SHARD_WORDS, window: int = WINDOW):
    """Yield the shards as built by executor tasks, one after the other."""
    slim = benchmark.select(F.col("item_id").cast("string").alias("item_id"), text_of().alias("text")).distinct()
    slim = written(slim, "items")
    chars = slim.agg(F.sum(F.length("text"))).first()[0] or 0
    # a word has a character and a gap at least
    parts = max(1, -(-chars // (2 * words)))
    placed = slim.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    built = written(
        placed.groupBy("part").applyInPandas(_built(window), "part long, piece int, data binary"), "automata"
    )
    for part in range(parts):
        pieces = built.where(F.col("part") == part).orderBy("piece").collect()
        yield Packed(b"".join(bytes(p.data) for p in pieces) if pieces else _packed([], window))


def _merged(one: list, two: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted([*one, *two]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = "n_words long, hits array<struct<start:long,end:long>>, items array<string>, nameless boolean"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scanned(batch: pa.RecordBatch, shard) -> pa.RecordBatch:
    """Add what one shard finds to what earlier shards found."""
    automaton, ids = shard.value.shard.automaton, shard.value.shard.ids
    columns = {n: batch[n] for n in batch.schema.names}
    known, hits, items, nameless = [], [], [], []
    for text, old, had, unknown in zip(
        columns["text"], columns["hits"].to_pylist(), columns["items"].to_pylist(),
        columns["nameless"].to_pylist(), strict=True,
    ):
        words = words_of(text.as_py())
        spans, found = automaton.scan(words)
        names = {ids[i] for i in found}
        known.append(len(words))
        hits.append(_merged([(s["start"], s["end"]) for s in old], spans) if old else spans)
        items.append(sorted((names - {None}) | set(had)))
        nameless.append(bool(unknown) or None in names)
    columns |= {
        "n_words": pa.array(known, pa.int64()),
        "hits": pa.array([[{"start": a, "end": b} for a, b in h] for h in hits], _SPANS),
        "items": pa.array(items, pa.list_(pa.string())),
        "nameless": pa.array(nameless, pa.bool_()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _nothing() -> dict:
    return {
        "n_words": F.lit(0).cast("long"),
        "hits": F.array().cast("array<struct<start:long,end:long>>"),
        "items": F.array().cast("array<string>"),
        "nameless": F.lit(False),
    }


def _finds(texts: DataFrame, shard) -> DataFrame:
    """digest, hits, items and nameless of the distinct texts that a shard hits."""
    rows = texts.withColumns(_nothing()).mapInArrow(in_batches(_scanned, shard), f"digest binary, text string, {_FOUND}")
    found = rows.where(F.size("hits") > 0).select("digest", F.struct("hits", "items", "nameless").alias("found"))
    # equal texts have equal finds
    return found.groupBy("digest").agg(F.first("found").alias("found")).select("digest", "found.*")


def scanned(rows: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``rows``, whose last column is ``text``, with n_words, hits, items and nameless."""
    context = rows.sparkSession.sparkContext
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    digest = F.unhex(F.sha2(F.col("text"), 256)).alias("digest")
    slim, last, nothing = [], None, _nothing()
    for packed in shards_of(benchmark, shard_words, window):
        if last is not None:
            slim.append(written(_finds(rows.select(digest, "text"), last), "finds"))
            last.destroy()
        last = context.broadcast(packed)
    if not slim:
        return rows.withColumns(_nothing()).mapInArrow(in_batches(_scanned, last), f"{kept}, {_FOUND}")
    earlier = slim[0]
    for other in slim[1:]:
        earlier = earlier.unionByName(other)
    # a text has one row per shard at most
    earlier = earlier.groupBy("digest").agg(
        F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits_"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items_"),
        F.max("nameless").alias("nameless_"),
    )
    keyed = rows.select(F.struct(*rows.columns).alias("all_"), digest)
    out = keyed.join(earlier.hint("merge"), "digest", "left").select(
        "all_.*", nothing["n_words"].alias("n_words"),
        *[F.coalesce(f"{n}_", nothing[n]).alias(n) for n in ("hits", "items", "nameless")],
    )
    return out.mapInArrow(in_batches(_scanned, last), f"{kept}, {_FOUND}")


def _counted(rows: DataFrame, *keep: str) -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.withColumn("n_hit", n_hit).select(
        *keep, "n_words", "n_hit", "items", "nameless", "hits",
        ((F.col("n_hit") > 0) & (F.col("n_hit") * COVERAGE >= F.col("n_words"))).alias("contaminated"),
    )


def decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    rows = scanned(docs.select("doc_id", text_of().alias("text")), benchmark)
    return _counted(rows, "doc_id").select(
        "doc_id", "n_words", "n_hit",
        (F.size("items") + F.col("nameless").cast("int")).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def _cut(text: str | None, spans: list) -> str | None:
    """The text without the words of the spans; other characters stay."""
    if not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    marked = np.frombuffer(raw.translate(_TABLE), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    parts, at = [], 0
    for s in spans:
        parts.append(raw[at : starts[s["start"]]])
        at = ends[s["end"] - 1]
    return b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass")


def _without_spans(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [_cut(t, h) for t, h in zip(batch["text"].to_pylist(), batch["hits"].to_pylist(), strict=True)]
    return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])


def without_benchmark_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and text of every document, with the hit words cut out of the text."""
    rows = scanned(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), benchmark)
    return rows.select("doc_id", "text", "hits").mapInArrow(in_batches(_without_spans), "doc_id long, text string")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged."""
    rows = scanned(wrapped(docs, text=text_of()), benchmark)
    return unwrapped(_counted(rows, ROW).where(~F.col("contaminated")))
