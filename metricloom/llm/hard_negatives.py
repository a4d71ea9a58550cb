"""Hard negatives by a vertical scan over columnar vectors (branch and bound on dimensions).

Vectors lie in tiles by dimension.  For an anchor, the dimensions are read in descending
magnitude of the anchor's components.  After some dimensions a row's score lies between its
partial sum plus the least and plus the largest contribution that the tile's smallest and
largest components still allow.  Rows that can no longer enter a result leave the bitmap of
candidates; the rest are read on until their scores are exact.

The first scan finds an anchor's positives (its best rows of the same label), the second its
negatives: for each positive the best rows of other labels whose score lies in a window given by
the positive's score.  Anchors travel in blocks of bounded size, and every block meets every
row.  A scan of a small pilot part of the rows comes first; its k-th best scores only
raise the bar that rows of the whole scan must reach, so they shrink the work and not the result.

Results for unusual input: rows with a NULL label, a NULL vector or a NULL or non-finite
component take no part; vectors of different lengths are filled up with zeros; equal rows count
as many times as they stand in the table, as anchors, positives and negatives; rows that share an
id are different rows; a NULL id is no anchor and comes before all ids among ties; an anchor
without positives or without negatives has no row; an empty table gives no row.  Scores must fit
a long: a table whose vectors are too long or large for that raises an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.llm.common import id_of, real_id, written
from metricloom.session import new_path

POSITIVES = 5
NEGATIVES = 10
#: Bounds of a negative's score in percent of the positive's.
LOW, HIGH = 30, 90
ROWS_PER_TASK = 65_536
TILE = 8192
#: Dimensions that are read between two looks at the bounds.
STEP = 8
#: One row of so many goes into the pilot.
PILOT = 64
#: Bytes of anchor vectors in one block.
BLOCK_BYTES = 16 << 20
_FOUND = "anchor long, goal long, score long, id long, copies long"


def quantised(embeddings: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """``id``, ``label`` and ``vector`` (floor of the scaled components) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fit).select(
        id_of("vec_id").alias("id"), label.cast("long").alias("label"),
        F.transform(vector, lambda x: F.floor(x * scale).cast("long")).alias("vector"),
    )


class Anchors:
    """A block of anchors with the score windows that each looks for."""

    def __init__(self, rows: pa.Table, size: int, kind: str):
        self.rows = rows["row"].to_numpy()
        self.labels = rows["label"].to_numpy()
        self.copies = rows["copies"].to_numpy()
        self.vectors = _matrix(rows["vector"].combine_chunks(), size).astype(kind)
        self.goals = rows["goals"].to_pylist()
        self.bars = rows["bars"].to_pylist()


def _matrix(vectors, size: int) -> np.ndarray:
    """Rows of equal length from a list array."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], pa.list_(pa.int64()))
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    values = vectors.flatten().to_numpy()
    full = np.zeros((len(lengths), size), np.int64)
    if size:
        full[np.arange(size) < lengths[:, None]] = values
    return full


class _Tile:
    """Rows in order of label and id, by dimension, with the extremes of every label's rows."""

    def __init__(self, batch: pa.RecordBatch, size: int, kind: str):
        label, ident = batch["label"].to_numpy(), batch["id"].to_numpy()
        order = np.lexsort((ident, label))
        self.label, self.id = label[order], ident[order]
        self.row = batch["row"].to_numpy()[order]
        self.copies = batch["copies"].to_numpy()[order]
        self.columns = np.ascontiguousarray(_matrix(batch["vector"], size)[order].T.astype(kind))
        self.extremes = {None: self._extremes(slice(None))}

    def _extremes(self, part: slice):
        columns = self.columns[:, part].astype(np.int64)
        return columns.min(axis=1), columns.max(axis=1)

    def part_of(self, label: int):
        """Place of the rows of a label and their extremes."""
        part = slice(*np.searchsorted(self.label, [label, label + 1]))
        if part.start < part.stop and label not in self.extremes:
            self.extremes[label] = self._extremes(part)
        return part, self.extremes.get(label)


def vertical_scan(columns, candidates, anchor, extremes, least, most, best: int = 0):
    """Exact scores of the candidates whose score may lie from ``least`` to ``most``.

    With ``best``, rows that cannot be among the ``best`` largest leave as well.
    """
    order = np.argsort(-np.abs(anchor.astype(np.float64)), kind="stable")
    low, high = extremes
    whole = anchor.astype(np.int64)
    both = np.stack([whole * low, whole * high])[:, order]
    # contributions that are still to come after each number of dimensions
    up = np.append(np.cumsum(both.max(axis=0)[::-1])[::-1], 0)
    down = np.append(np.cumsum(both.min(axis=0)[::-1])[::-1], 0)
    sums = np.zeros(len(candidates), anchor.dtype)
    contiguous = len(candidates) > 0 and candidates[-1] - candidates[0] + 1 == len(candidates)
    for start in range(0, len(order), STEP):
        dims = order[start : start + STEP]
        block = columns[dims, candidates[0] : candidates[-1] + 1] if contiguous else columns[np.ix_(dims, candidates)]
        sums = sums + anchor[dims] @ block
        done = min(start + STEP, len(order))
        if best and len(sums) > best:
            least = max(least, int(np.partition(sums, len(sums) - best)[len(sums) - best]) + int(down[done]))
        bitmap = (sums >= least - up[done]) & (sums <= most - down[done])
        left = np.count_nonzero(bitmap)
        if left < 0.9 * len(sums) or done == len(order):
            candidates, sums, contiguous = candidates[bitmap], sums[bitmap], False
        if not left:
            break
    return candidates, sums.astype(np.int64)


def _window(goal: int, low: int, high: int) -> tuple[int, int]:
    """Scores s with low * goal <= 100 * s <= high * goal."""
    return -((-low * goal) // 100), (high * goal) // 100


def _scan(batches, shared, same: bool, best: int, bounds: tuple[int, int], size: int, kind: str):
    """The ``best`` rows of a task for every anchor and window, as rows of ``_FOUND``."""
    anchors: Anchors = shared.value
    smallest, largest = -(1 << 62), 1 << 62
    found = {}  # (anchor, window) -> (scores, ids, copies), best first
    windows, bars = [], []
    for goals, bar in zip(anchors.goals, anchors.bars):
        windows.append([(smallest, largest)] if same else [_window(g, *bounds) for g in goals])
        bars.append([smallest if b is None else b for b in bar])

    def enter(key, bar, scores, ids, copies):
        old = found.get(key)
        if old is not None:
            scores, ids, copies = (np.concatenate(p) for p in zip(old, (scores, ids, copies)))
        order = np.lexsort((ids, -scores))[:best]
        found[key] = (scores[order], ids[order], copies[order])
        return max(bar, int(scores[order[-1]])) if len(order) == best else bar

    for batch in batches:
        for start in range(0, batch.num_rows, TILE):
            tile = _Tile(batch.slice(start, TILE), size, kind)
            everything = np.arange(len(tile.id))
            for n, anchor in enumerate(anchors.vectors):
                part, extremes = tile.part_of(int(anchors.labels[n]))
                own = everything[part]
                if same:
                    # the anchor itself is another row only if the table repeats it
                    if anchors.copies[n] == 1:
                        own = own[tile.row[own] != anchors.rows[n]]
                    candidates = own
                else:
                    candidates = np.concatenate([everything[: part.start], everything[part.stop :]])
                    extremes = tile.extremes[None]
                limits = [(max(a, bar), b) for (a, b), bar in zip(windows[n], bars[n])]
                limits = [(a, b) for a, b in limits if a <= b]
                if not len(candidates) or not limits:
                    continue
                places, scores = vertical_scan(
                    tile.columns, candidates, anchor, extremes,
                    min(a for a, _ in limits), max(b for _, b in limits), best if same else 0,
                )
                if not len(places):
                    continue
                for w, (a, b) in enumerate(windows[n]):
                    inside = np.flatnonzero((scores >= max(a, bars[n][w])) & (scores <= b))
                    if len(inside):
                        some = places[inside]
                        copies = tile.copies[some] - (tile.row[some] == anchors.rows[n])
                        bars[n][w] = enter((n, w), bars[n][w], scores[inside], tile.id[some], copies)
    keys = list(found)
    for start in range(0, len(keys), 4096):
        some = keys[start : start + 4096]
        counts = [len(found[k][0]) for k in some]
        parts = [np.concatenate([found[k][i] for k in some]) for i in range(3)]
        goals = [None if same else anchors.goals[n][w] for n, w in some]
        repeated = np.repeat(np.arange(len(some)), counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(anchors.rows[[n for n, _ in some]][repeated], pa.int64()),
                pa.array(goals, pa.int64()).take(pa.array(repeated)),
                *(pa.array(p, pa.int64()) for p in parts),
            ],
            names=["anchor", "goal", "score", "id", "copies"],
        )


def _best(found: DataFrame, best: int) -> DataFrame:
    """The first ``best`` rows of every anchor and goal, with the rank before and the copies that fit."""
    order = W.partitionBy("anchor", "goal").orderBy(F.desc("score"), "id")
    before = F.coalesce(F.sum("copies").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (
        found.withColumn("before", before)
        .where(F.col("before") < best)
        .withColumn("copies", F.least("copies", best - F.col("before")))
    )


def _bars(pilot: DataFrame, best: int) -> DataFrame:
    """Score of the last of ``best`` rows, where the pilot has so many."""
    full = _best(pilot, best).groupBy("anchor", "goal").agg(F.sum("copies").alias("n"), F.min("score").alias("bar"))
    return full.where(F.col("n") >= best).select("anchor", "goal", "bar")


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    rows_per_task: int = ROWS_PER_TASK,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Negatives of every anchor and positive among ``rows`` (``id``, ``label``, ``vector``).

    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = rows.sparkSession
    distinct = rows.groupBy("id", "label", "vector").agg(F.count(F.lit(1)).alias("copies"))
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(rows.count() / rows_per_task))
    numbered = distinct.repartition(tasks).withColumn("row", F.monotonically_increasing_id())
    anchor = (F.col("id") != F.lit(-(2**63))) & is_anchor
    table = written(numbered.withColumn("is_anchor", F.coalesce(anchor, F.lit(False))), "vectors")
    extent = table.agg(
        F.max(F.size("vector")), F.max(F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector")))),
        F.count_if("is_anchor"),
    ).first()
    size, largest, n_anchors = (x or 0 for x in extent)
    total = size * largest * largest
    if total >= 1 << 62:
        raise ValueError("Scores of these vectors do not fit a long.")
    kind = "float32" if total < 1 << 24 else "float64" if total < 1 << 53 else "int64"
    blocks = max(1, math.ceil(n_anchors * size * 8 / block_bytes))
    heads = table.where("is_anchor").drop("is_anchor").repartition(blocks).withColumn("block", F.spark_partition_id())
    heads = written(heads, "anchors")
    pilot = table.where(F.pmod(F.xxhash64("row"), F.lit(PILOT)) == 0).repartition(max(1, tasks // PILOT))
    pilot = written(pilot, "pilot")

    def scan(source: DataFrame, block: DataFrame, goals: DataFrame, same: bool, best: int, path: str) -> None:
        wanted = goals.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("goal", "bar")).alias("all"))
        ready = block.join(wanted, "row").select(
            "row", "label", "vector", "copies", F.col("all.goal").alias("goals"), F.col("all.bar").alias("bars")
        )
        shared = spark.sparkContext.broadcast(Anchors(ready.toArrow(), size, kind))
        chosen = source.select("row", "id", "label", "vector", "copies")
        found = chosen.mapInArrow(lambda b: _scan(b, shared, same, best, (low, high), size, kind), _FOUND)
        found.write.mode("append").parquet(path)
        shared.unpersist()

    def both(block: DataFrame, goals: DataFrame, same: bool, best: int, path: str) -> None:
        """Pilot and whole scan of one block of anchors for its rows of anchor and goal."""
        first = new_path(spark, "pilot-found")
        scan(pilot, block, goals.withColumn("bar", F.lit(None).cast("long")), same, best, first)
        bars = _bars(spark.read.schema(_FOUND).parquet(first), best)
        raised = goals.join(bars, (goals["anchor"] == bars["anchor"]) & goals["goal"].eqNullSafe(bars["goal"]), "left")
        scan(table, block, raised.select(goals["anchor"], goals["goal"], "bar"), same, best, path)

    first, second = new_path(spark, "positives"), new_path(spark, "negatives")
    for number in range(blocks):
        block = heads.where(F.col("block") == number).drop("block", "id")
        goals = block.select(F.col("row").alias("anchor"), F.lit(None).cast("long").alias("goal"))
        both(block, goals, True, positives, first)
    chosen = written(_best(spark.read.schema(_FOUND).parquet(first), positives).drop("goal", "before"), "positives")
    windows = chosen.select("anchor", F.col("score").alias("goal")).distinct()
    for number in range(blocks):
        block = heads.where(F.col("block") == number).drop("block", "id")
        goals = windows.join(block.select(F.col("row").alias("anchor")), "anchor")
        both(block, goals, False, negatives, second)
    hard = _best(spark.read.schema(_FOUND).parquet(second), negatives)
    ranked = hard.select(
        "anchor", F.col("goal").alias("positive_score"), F.col("id").alias("negative"), F.col("score").alias("negative_score"),
        F.explode(F.sequence((F.col("before") + 1).cast("int"), (F.col("before") + F.col("copies")).cast("int"))).alias("rank"),
    )
    pairs = (
        chosen.select("anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score"), F.col("copies").alias("times"))
        .join(heads.select(F.col("row").alias("anchor"), "id", F.col("copies").alias("anchors")), "anchor")
    )
    rows_of = ranked.join(pairs, ["anchor", "positive_score"])
    repeated = rows_of.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times") * F.col("anchors"))))
    return repeated.select(
        F.col("id").alias("anchor_id"), real_id("positive", "positive_id"), "rank", real_id("negative", "negative_id"),
        "positive_score", "negative_score",
    )
