"""Toxic passages as maximal scoring segments of token log-odds.

Tokens are runs of ASCII letters and non-ASCII characters, lower-cased.  Their features are the
word, its pieces of 4 to 6 bytes with the word's ends marked, and its first 3 to 7 bytes as a
stem that an ending follows; they are hashed into a table of fixed size.  They are computed
over the bytes of many texts at once.  The log-odds of a
feature between toxic and other documents carry an informative Dirichlet prior: the feature's
share in the whole corpus.  Features whose log-odds are not well above their deviation count
as 0.  A token scores its largest log-odds minus ``DRIFT``, so that ordinary text drifts down
and a linear scan (Ruzzo and Tompa) finds every maximal segment that scores above 0.

Scores become comparable by extreme-value statistics: lambda and K of Karlin and Altschul,
from the token scores of the non-toxic documents, turn the score S of a segment in a text of
n tokens into E = K n exp(-lambda S).  A logistic curve turns log(1 / E) of the best segment, its
sum over all segments with E below ``SIGNIFICANT``, the sum of lambda S over all segments and
log n into a score from 0 to 1.

Labels train on a bounded sample: at most ``SAMPLE`` distinct texts of each class, in the order
of a hash; in the logistic curve they weigh as much as all labelled texts of their class, so
that scores do not shift with the size of the input.  Prior counts cover all documents.  The driver gets tables of at most ``BUCKETS`` rows.

Results for unusual input: NULL, empty and letterless texts have no segment and get the score
of such texts; without labels of both classes every score is the share of toxic labels (0
without any) and no segment is found; NULL labels are ignored; of repeated labels of an id,
the toxic one counts; equal texts count once in training, as toxic if one of them is.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import bounded_sample, crc_remainder, in_batches, text_of, written

BUCKETS = 1 << 20
SAMPLE = 20_000
PRIOR = 100_000.0
DEVIATIONS = 4.0
#: A feature needs so many toxic sample texts to be looked at.
LEAST = 5
DRIFT = 2.0
SIGNIFICANT = 0.01
PIECES = (4, 5, 6)
#: Bytes of a stem with the mark of the word's start.
STEMS = (4, 5, 6, 7, 8)
#: Bytes of text that are looked at together.
TOGETHER = 400_000
_WORD = re.compile("[a-zA-Z\x80-\U0010ffff]+")
_TABLE = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
_BITS = np.uint64(64 - BUCKETS.bit_length() + 1)


def _hashed(keys: np.ndarray, salt: int) -> np.ndarray:
    """Buckets of packed bytes."""
    keys = (keys + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    keys ^= keys >> np.uint64(29)
    return ((keys * np.uint64(0xBF58476D1CE4E5B9)) >> _BITS).astype(np.int32)


class Words:
    """The words of some texts: the text each belongs to and the buckets of its features."""

    def __init__(self, texts: list[bytes], numbers: list[int]):
        counts = []
        parts = []
        for text in texts:
            words = text.split()
            counts.append(len(words))
            if words:
                parts.append(b" ".join(words))
        self.text_of = np.repeat(np.array(numbers, np.int64), counts)
        raw = np.frombuffer(b" " + b" ".join(parts) + b" " * 8, np.uint8)
        size = len(raw) - 7 if parts else 1
        self.raw, self.size = raw, size
        space = raw[:size] == 32
        self.starts = np.flatnonzero(space)[:-1]
        self.lengths = np.diff(np.flatnonzero(space)) - 1
        self.before = np.cumsum(space)

    def __len__(self) -> int:
        return len(self.text_of)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        if not len(self):
            return np.empty(0, np.uint64)
        inside = np.arange(self.size) - np.repeat(self.starts, np.diff(np.append(self.starts, self.size)))
        powers = np.cumprod(np.full(int(self.lengths.max()) + 2, 0x100000001B3, np.uint64))
        worth = (self.raw[: self.size].astype(np.uint64) + np.uint64(7)) * powers[np.minimum(inside, len(powers) - 1)]
        worth[self.raw[: self.size] == 32] = 0
        return np.add.reduceat(worth, self.starts)

    def features(self, chosen: np.ndarray | None = None):
        """(word numbers, buckets) for every kind of feature, of the ``chosen`` words."""
        if not len(self):
            return
        everything = np.arange(len(self))
        some = everything if chosen is None else everything[chosen]
        yield some, _hashed(self.hashes()[some], 1)
        packed = self.raw[: self.size].astype(np.uint64)
        wide = self.raw.astype(np.uint64)
        for n in range(2, max(*STEMS, *PIECES) + 1):
            packed = packed | (wide[n - 1 : n - 1 + self.size] << np.uint64(8 * (n - 1)))
            if n in PIECES and self.size >= n:
                last = self.size - n + 1
                # no space between the first and the last byte
                word = self.before[1 : last + 1] - 1
                whole = self.before[n - 2 : n - 2 + last] - 1 == word
                whole &= self.raw[1 : last + 1] != 32
                if chosen is not None:
                    whole &= chosen[np.minimum(word, len(self) - 1)]
                places = np.flatnonzero(whole)
                yield word[places], _hashed(packed[places], 10 + n)
            if n in STEMS:
                long = some[self.lengths[some] >= n]
                yield long, _hashed(packed[self.starts[long]], 100 + n)


def prepared(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE)


def grouped(texts):
    """:class:`Words` of about ``TOGETHER`` bytes; a long text comes in several of them."""
    some, numbers, size = [], [], 0
    for number, text in enumerate(texts):
        rest = prepared(text)
        while rest:
            part = rest
            if len(rest) > TOGETHER:
                cut = rest.find(b" ", TOGETHER)
                part = rest if cut < 0 else rest[:cut]
            rest = rest[len(part) :]
            some.append(part)
            numbers.append(number)
            size += len(part)
            if size > TOGETHER:
                yield Words(some, numbers)
                some, numbers, size = [], [], 0
    if some:
        yield Words(some, numbers)


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """``toxic``, ``text`` and ``weight`` of at most ``size`` distinct texts of each class.

    A row's weight is the number of distinct texts of its class over those in the sample.
    """
    marked = docs.where(crc_remainder(5) != 0).select("doc_id", F.xxhash64(text_of()).alias("mark"))
    known = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    distinct = marked.join(known, "doc_id").groupBy("mark").agg(
        F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id")
    )
    distinct = written(distinct, "labelled")
    counts = distinct.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))
    chosen = bounded_sample(distinct, "toxic", F.col("mark"), size)
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("mark", F.xxhash64("text"))
    picked = rows.join(F.broadcast(chosen.select("doc_id", "mark", "toxic")), ["doc_id", "mark"])
    sample = written(picked.select("mark", "toxic", "text").dropDuplicates(["mark"]).select("toxic", "text"), "toxic-sample")
    # one row a class on either side
    weights = counts.join(sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("sampled")), "toxic").select(
        "toxic", (F.col("n") / F.col("sampled")).alias("weight")
    )
    return sample.join(F.broadcast(weights), "toxic").select("toxic", "text", "weight")


def _class_counts(batches):
    """Distinct words of documents of either class per bucket, for one task."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        toxic = np.array(batch["toxic"].to_pylist()) > 0
        for words in grouped(batch["text"].to_pylist()):
            pairs = words.hashes() + words.text_of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            once = np.zeros(len(words), bool)
            once[np.unique(pairs, return_index=True)[1]] = True
            for number, bucket in words.features(once):
                bad = toxic[words.text_of[number]]
                counts[1] += np.bincount(bucket[bad], minlength=BUCKETS)
                counts[0] += np.bincount(bucket[~bad], minlength=BUCKETS)
    used = np.flatnonzero(counts.any(axis=0))
    for start in range(0, len(used), 50_000):
        some = used[start : start + 50_000]
        yield pa.RecordBatch.from_pydict(
            {"bucket": pa.array(some, pa.int64()), "c0": pa.array(counts[0, some], pa.int64()), "c1": pa.array(counts[1, some], pa.int64())}
        )


def _corpus_counts(wanted):
    """Occurrences of the wanted buckets, and of all features in bucket -1, for one task."""

    def run(batches):
        buckets = wanted.value
        place = np.full(BUCKETS, len(buckets), np.int32)
        place[buckets] = np.arange(len(buckets))
        counts, total = np.zeros(len(buckets) + 1, np.int64), 0
        for batch in batches:
            for words in grouped(batch["text"].to_pylist()):
                for _, bucket in words.features():
                    counts += np.bincount(place[bucket], minlength=len(counts))
                    total += len(bucket)
        used = np.flatnonzero(counts[:-1])
        yield pa.RecordBatch.from_pydict(
            {"bucket": pa.array([-1, *buckets[used].tolist()], pa.int64()), "n": pa.array([total, *counts[used].tolist()], pa.int64())}
        )

    return run


def log_odds(c1: np.ndarray, c0: np.ndarray, n1: float, n0: float, share: np.ndarray) -> np.ndarray:
    """Log-odds with the Dirichlet prior ``PRIOR * share``; 0 where below ``DEVIATIONS``."""
    prior = PRIOR * share
    a, b = c1 + prior, c0 + prior
    odds = np.log(a / (n1 + PRIOR - a)) - np.log(b / (n0 + PRIOR - b))
    return np.where(odds > DEVIATIONS * np.sqrt(1 / a + 1 / b), odds, 0.0)


def maximal_segments(places: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) in linear time.

    ``places`` and ``scores`` are the tokens that score above 0; every other token scores
    ``-drift``.
    """
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum with it
    total, at = 0.0, 0
    for place, score in zip(places, scores, strict=True):
        total -= drift * (place - at)
        start, before = place, total
        total += score
        at = place + 1
        while True:
            # segments whose sum before is not below ours cannot be joined
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= before:
                k -= 1
            if k < 0 or stack[k][3] >= total:
                stack.append((start, at, before, total))
                break
            start, before = stack[k][0], stack[k][2]
            del stack[k:]
    return [(a, b, high - low) for a, b, low, high in stack]


@dataclass
class Model:
    """Log-odds by bucket, extreme-value parameters and the logistic curve."""

    odds: np.ndarray
    decay: float = 1.0
    scale: float = 1.0
    curve: tuple[float, ...] = (0.0,) * 5
    #: Score of every text, where the labels could not train.
    constant: float | None = None

    def scored(self, texts: list[str | None]) -> list[tuple[int, list[int], list[float]]]:
        """Of every text the number of tokens, and places and scores of those above 0."""
        out = [[0, [], []] for _ in texts]
        for words in grouped(texts):
            best = np.zeros(len(words), np.float32)
            for number, bucket in words.features():
                odds = self.odds[bucket]
                hits = np.flatnonzero(odds > DRIFT)
                np.maximum.at(best, number[hits], odds[hits])
            first = np.flatnonzero(np.diff(words.text_of, prepend=-1))
            ends = np.append(first[1:], len(words))
            places = np.flatnonzero(best > 0)
            cuts = np.searchsorted(places, np.append(first, len(words)))
            for k, (a, b) in enumerate(zip(first.tolist(), ends.tolist(), strict=True)):
                mine = out[words.text_of[a]]
                here = places[cuts[k] : cuts[k + 1]]
                mine[1].extend((here - a + mine[0]).tolist())
                mine[2].extend((best[here] - DRIFT).tolist())
                mine[0] += b - a
        return [tuple(x) for x in out]

    def segments(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int, float, float]]]]:
        """Number of tokens, and start, end, score and log(1 / E) of every maximal segment."""
        out = []
        for count, places, scores in self.scored(texts):
            size = math.log(self.scale * max(1, count))
            found = [(a, b, s, self.decay * s - size) for a, b, s in maximal_segments(places, scores)]
            out.append((count, found))
        return out

    def evidence(self, texts: list[str | None]) -> list[tuple[float, ...]]:
        """What the logistic curve gets of every text."""
        limit = -math.log(SIGNIFICANT)
        out = []
        for count, found in self.segments(texts):
            logs = [log for *_, log in found]
            out.append(
                (
                    _curbed(max([-20.0, *logs])),
                    _curbed(sum(log for log in logs if log > limit)),
                    _curbed(sum(self.decay * s for _, _, s, _ in found)),
                    math.log1p(count) / 10,
                )
            )
        return out

    def score(self, texts: list[str | None]) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(texts)
        first, *weights = self.curve
        sums = [first + sum(w * x for w, x in zip(weights, e, strict=True)) for e in self.evidence(texts)]
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) for z in sums]


def _curbed(x: float) -> float:
    """Keeps a very toxic text from leading the fit."""
    return max(-20.0, min(50.0, x)) / 10


def extreme_values(histogram: dict[float, int], strongest: float) -> tuple[float, float]:
    """lambda and K from the token scores of ordinary text.

    lambda solves E[exp(lambda s)] = 1.  K is the share of tokens that score above 0 times
    exp(lambda * their mean score): right for segments of one such token, an upper bound for
    rarer chains of them.  Where ordinary text has no such token, one of the ``strongest``
    score is taken as seen.
    """
    total = sum(histogram.values())
    positive = sum(n for s, n in histogram.items() if s > 0)
    table = dict(histogram)
    if not positive:
        table[max(0.25, strongest)] = 1
        total, positive = total + 1, 1
    if sum(s * n for s, n in table.items()) >= 0:
        return 1e-3, 1.0
    scores = np.array(list(table), float)
    shares = np.array(list(table.values()), float) / total
    low, high = 1e-6, 50.0
    for _ in range(200):
        middle = (low + high) / 2
        if float(shares @ np.exp(np.minimum(700, middle * scores))) > 1:
            high = middle
        else:
            low = middle
    above = scores > 0
    mean = float(scores[above] @ shares[above] / shares[above].sum())
    return low, positive / total * math.exp(min(50.0, low * mean))


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, ridge: float = 0.05) -> np.ndarray:
    """Coefficients, intercept first, by Newton steps with a small ridge; a row counts ``weights`` times."""
    c = np.ones(len(x)) if weights is None else weights
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (c * p * (1 - p))[:, None]).T @ a + penalty, a.T @ (c * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _histogram(shared):
    """Token scores of the non-toxic texts of one task, in steps of a quarter."""

    def run(batches):
        model, counts = shared.value, Counter()
        for batch in batches:
            texts = [t for bad, t in zip(batch["toxic"].to_pylist(), batch["text"].to_pylist(), strict=True) if not bad]
            for count, _, scores in model.scored(texts):
                counts[-DRIFT] += count - len(scores)
                counts.update(max(0.25, round(s * 4) / 4) for s in scores)
        if counts:
            yield pa.RecordBatch.from_pydict(
                {"score": pa.array(list(counts), pa.float64()), "n": pa.array(list(counts.values()), pa.int64())}
            )

    return run


def _evidence(batch: pa.RecordBatch, shared) -> pa.RecordBatch:
    found = pa.array(map(list, shared.value.evidence(batch["text"].to_pylist())), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([batch["toxic"], batch["weight"], found], ["toxic", "weight", "evidence"])


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    context = docs.sparkSession.sparkContext
    sample = labelled_sample(docs, labels, size)
    classes = {r.toxic > 0: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(classes) < 2:
        return Model(np.zeros(BUCKETS, np.float32), constant=float(bool(classes.get(True))))
    per_bucket = written(
        sample.mapInArrow(_class_counts, "bucket long, c0 long, c1 long")
        .groupBy("bucket").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "class-counts",
    )
    n0, n1 = per_bucket.agg(F.sum("c0"), F.sum("c1")).first()
    counted = per_bucket.where(F.col("c1") >= LEAST).toPandas()
    buckets = counted["bucket"].to_numpy()
    corpus = (
        docs.select(text_of().alias("text"))
        .mapInArrow(_corpus_counts(context.broadcast(buckets)), "bucket long, n long")
        .groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    seen = dict(zip(corpus["bucket"].tolist(), corpus["n"].tolist(), strict=True))
    share = np.array([seen.get(b, 0) + 1 for b in buckets.tolist()]) / max(1, seen.get(-1, 0) + BUCKETS)
    odds = np.zeros(BUCKETS, np.float32)
    odds[buckets] = log_odds(counted["c1"].to_numpy(float), counted["c0"].to_numpy(float), n1 or 0, n0 or 0, share)
    model = Model(odds)
    steps = sample.mapInArrow(_histogram(context.broadcast(model)), "score double, n long")
    model.decay, model.scale = extreme_values(
        {r.score: r.n for r in steps.groupBy("score").agg(F.sum("n").alias("n")).collect()},
        float(odds.max()) - DRIFT,
    )
    rows = sample.mapInArrow(in_batches(_evidence, context.broadcast(model)), "toxic int, weight double, evidence array<double>").toPandas()
    x = np.array(rows["evidence"].tolist())
    model.curve = tuple(logistic(x, (rows["toxic"].to_numpy() > 0).astype(float), rows["weight"].to_numpy(float)).tolist())
    return model


def _scores(batch: pa.RecordBatch, shared) -> pa.RecordBatch:
    scores = shared.value.score(batch["text"].to_pylist())
    return pa.RecordBatch.from_arrays(
        [*batch.columns[:-1], pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "score"]
    )


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Documents whose crc32 remainder by 5 is 0 are held out of the training.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    rows = docs.select("doc_id", (crc_remainder(5) == 0).alias("held_out"), text_of().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(in_batches(_scores, shared), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _passages(batch: pa.RecordBatch, shared) -> pa.RecordBatch:
    model, limit = shared.value, -math.log(SIGNIFICANT)
    ids, starts, ends, logs, parts = [], [], [], [], []
    texts = batch["text"].to_pylist()
    for key, text, (_, segments) in zip(batch["doc_id"].to_pylist(), texts, model.segments(texts), strict=True):
        found = [s for s in segments if s[3] > limit]
        if found:
            # lower-casing keeps the places for all but a few letters; the passage is cut from it
            low = (text or "").lower()
            spans = [m.span() for m in _WORD.finditer(low)]
            for a, b, _, log in found:
                ids.append(key)
                starts.append(a)
                ends.append(b)
                logs.append(log)
                parts.append(low[spans[a][0] : spans[b - 1][1]])
    return pa.RecordBatch.from_pydict(
        {"doc_id": pa.array(ids, batch["doc_id"].type), "first_token": pa.array(starts, pa.int64()),
         "end_token": pa.array(ends, pa.int64()), "evidence": pa.array(logs, pa.float64()), "passage": pa.array(parts, pa.string())}
    )


def toxic_passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every significant passage: doc_id, first_token, end_token, evidence and passage."""
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(
        in_batches(_passages, shared), "doc_id long, first_token long, end_token long, evidence double, passage string"
    )
