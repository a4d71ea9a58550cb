"""Mixing sources to target weights by packed blocks.

The words of every source are numbered through and packed into blocks of ``block`` words.
Every output shard gets a multinomial draw of each source's slots; a slot is mapped through a
pseudorandom permutation of its source's block indexes (a new one for every pass over the
source), and slots and blocks are joined by index.

Order within a source: documents are dealt by a hash into chunks of about ``CHUNK`` rows, so
that running sums never need a whole source in one task.  Draws depend on the seed, the source
and its size only, so reruns agree.

Results for unusual input: NULL texts have no words; NULL is a source of its own, the last;
sources without words have target 0; rows that repeat id and text are separate documents; NULL
ids come back as NULL.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.functions import frames
from metricloom.llm.common import id_of, in_batches, real_id, text_of, written

BLOCK = 64
#: Target of a source is at most so many times its size.
REPEATS = 3
WEIGHTS = (1, 2, 3)
#: Documents in one running sum, about.
CHUNK = 2000
#: Slots of an output shard, about.
SHARD_SLOTS = 4096
#: Shards of one draw; a source's slots are dealt to groups of shards first.
GROUP = 4096
#: Slots of one task, about, as long as that makes no more than ``MOST_TASKS``.
TASK_SLOTS = 1 << 18
MOST_TASKS = 20_000
SEED = 20240
WORDS = r"[^\x20\x09-\x0D]+"


def measured(docs: DataFrame) -> DataFrame:
    """Slim rows: id, mark (a hash of the text), source, its non-null key and size in words."""
    source = F.col("source").cast("string")
    return docs.select(
        id_of().alias("id"),
        F.xxhash64(text_of()).alias("mark"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"),
        F.regexp_count(text_of(), F.lit(WORDS)).cast("long").alias("size"),
    )


def targets(rows: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """key, source_size and target of every source.

    Weights 1, 2, 3 repeat over the sources in code point order, NULL last.  The targets are
    the smaller of ``repeats`` times the size and a common level times the weight; the level
    is found by running sums over the sources in the order of size over weight.  Places and
    running sums are taken over ranges of sources, so no task sees all of them.
    """
    sums = rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.max("source").alias("source"))
    numbered = frames.placed(sums, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))
    cap = (F.col("source_size") * repeats).cast("double")
    table = numbered.select("key", "source_size", weight.alias("weight"), cap.alias("cap"))
    ratio = F.col("cap") / F.col("weight")
    # caps and weights are whole numbers: the sums are exact in any order
    ranked = frames.placed(
        table, [ratio, F.col("key")], "rank", {"caps": F.col("cap"), "weights": F.col("weight")}
    )
    size, weights = table.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    left = F.lit(size) - (F.col("caps") - F.col("cap"))
    level = left / (F.lit(weights) - (F.col("weights") - F.col("weight")))
    ranked = ranked.withColumn("level", level)
    free = ranked.where("cap >= level * weight").agg(F.min(F.struct("rank", "level"))).first()[0]
    reached = F.lit(free["level"]) if free else F.col("level")
    return ranked.select("key", "source_size", F.least("cap", reached * F.col("weight")).alias("target"))


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with the number of their first word in their source and a key (chunk, place)."""
    chunks = max(1, -(-rows.count() // CHUNK))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "mark"), F.lit(chunks)))
    inner = W.partitionBy("key", "chunk").orderBy("id", "mark")
    before = inner.rowsBetween(W.unboundedPreceding, -1)
    local = dealt.withColumn("place", F.row_number().over(inner)).withColumn(
        "local", F.coalesce(F.sum("size").over(before), F.lit(0))
    )
    sums = dealt.groupBy("key", "chunk").agg(F.sum("size").alias("chunk_size"))
    # one running sum over all chunks, less what lies before the source's first chunk
    summed = frames.placed(sums, [F.col("key"), F.col("chunk")], "nth", {"upto": F.col("chunk_size")})
    summed = summed.select("key", "chunk", (F.col("upto") - F.col("chunk_size")).alias("before"))
    starts = summed.groupBy("key").agg(F.min("before").alias("start"))
    offsets = summed.hint("merge").join(starts.hint("merge"), "key").select(
        "key", "chunk", (F.col("before") - F.col("start")).alias("base")
    )
    return local.join(offsets, ["key", "chunk"]).select(
        "id", "mark", "source", "key", "size", "chunk", "place", (F.col("base") + F.col("local")).alias("first")
    )


def _seed(*parts) -> int:
    return int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:8], "big")


def _dealt(shards: int, seed: int, level: str):
    """Multinomial counts of a row's slots over the parts of its range of shards.

    On level "groups" the parts are groups of ``GROUP`` shards, drawn by their widths; on level
    "shards" they are the shards of a group.  Together they are one draw over all shards.
    """

    def run(batches):
        for rows in batches:
            for key, blocks, group, start, slots in rows.itertuples(index=False, name=None):
                if level == "groups":
                    parts = np.arange(-(-shards // GROUP))
                    width = np.minimum(shards - parts * GROUP, GROUP)
                else:
                    parts = np.arange(group * GROUP, min(shards, (group + 1) * GROUP))
                    width = np.ones(len(parts))
                draw = np.random.default_rng(_seed(seed, level, key, int(group), int(slots)))
                counts = draw.multinomial(int(slots), width / width.sum())
                firsts = start + np.cumsum(counts) - counts
                used = np.flatnonzero(counts)
                for at in range(0, len(used), 10_000):
                    some = used[at : at + 10_000]
                    yield pd.DataFrame(
                        {"key": key, "blocks": blocks, "part": parts[some], "from": firsts[some], "slots": counts[some]}
                    )

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, length: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Image of each ``index`` under the permutation of 0..length-1 that ``key`` names.

    A Feistel network over the next even number of bits; images outside the range are mapped
    again until they fall inside.
    """
    bits = np.ceil(np.log2(np.maximum(length, 2))).astype(np.uint64)
    half = (bits + np.uint64(1)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    limit = length.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = out[todo] >> h, out[todo] & m
        for i in range(rounds):
            left, right = right, left ^ (_mixed(right + k + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= limit[todo]]
    return out.astype(np.int64)


def _mapped(seed: int):
    def run(batches):
        for rows in batches:
            if not len(rows):
                continue
            blocks = rows["blocks"].to_numpy(np.int64)
            slot = rows["slot"].to_numpy(np.int64)
            rows["epoch"] = slot // blocks
            names = pd.factorize(rows["key"])
            seeds = np.array([_seed(seed, k) for k in names[1]], np.uint64)[names[0]]
            seeds = _mixed(seeds + rows["epoch"].to_numpy(np.uint64))
            rows["block"] = permuted(slot % blocks, blocks, seeds)
            yield rows[["key", "shard", "slot", "epoch", "block"]]

    return run


def slots(source_targets: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The output slots: key, shard, slot, epoch and the block index each slot takes.

    The last block of a source is only partly filled: slots are counted by the mean filling of
    its blocks, at least one for a positive target.
    """
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    counted = F.greatest(F.round(F.col("target") * blocks / F.col("source_size")).cast("long"), F.lit(1))
    wanted = source_targets.select(
        "key",
        F.when((F.col("target") > 0) & (F.col("source_size") > 0), counted).otherwise(0).alias("slots"),
        blocks.alias("blocks"),
    ).where("slots > 0")
    wanted = written(wanted, "wanted")
    total = wanted.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, round(total / SHARD_SLOTS))
    # a given number of partitions is not folded: few small rows become many slots
    tasks = min(MOST_TASKS, max(1, -(-total // TASK_SLOTS)))
    row = "key string, blocks long, part long, `from` long, slots long"
    whole = wanted.select("key", "blocks", F.lit(0).alias("part"), F.lit(0).cast("long").alias("from"), "slots")
    groups = whole.repartition("key").mapInPandas(_dealt(shards, seed, "groups"), row)
    drawn = groups.repartition(tasks, "key", "part").mapInPandas(_dealt(shards, seed, "shards"), row)
    spread = drawn.withColumnRenamed("part", "shard").repartition(tasks, "key", "shard").select(
        "key", "blocks", "shard", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("slots") - 1)).alias("slot")
    )
    return spread.mapInPandas(_mapped(seed), "key string, shard long, slot long, epoch long, block long")


def segments(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The blocks each document has words in, with the number of its words there."""
    last = F.col("first") + F.col("size")
    each = rows.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((last - 1) / block)))
    )
    here = F.least(last, (F.col("block") + 1) * block) - F.greatest(F.col("first"), F.col("block") * block)
    return each.select("key", "chunk", "place", "block", here.alias("words"))


def mixing(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document.

    A slot takes all words of its block; a document gets the words it has there.
    """
    rows = written(placed(written(measured(docs), "sizes")), "placed")
    goals = written(targets(rows), "targets")
    times = slots(goals, block).groupBy("key", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = (
        # the planner takes exploded rows for few: never broadcast them unasked
        segments(rows, block).hint("merge").join(times.hint("merge"), ["key", "block"])
        .groupBy("key", "chunk", "place").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    )
    sized = rows.hint("merge").join(taken.hint("merge"), ["key", "chunk", "place"], "left")
    # one row a source on the other side; a hot source's rows are split by adaptive execution
    return sized.join(goals, "key").select(
        real_id("id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def _cut(block: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, blocks, starts, counts, texts = [], [], [], [], []
        for key, text, firsts in zip(
            batch["key"].to_pylist(), batch["text"], batch["firsts"].to_pylist(), strict=True
        ):
            words = text.as_py().encode("utf-8", "surrogatepass").split()
            for first in firsts:
                at = 0
                while at < len(words):
                    index = (first + at) // block
                    end = min(len(words), (index + 1) * block - first)
                    keys.append(key)
                    blocks.append(index)
                    starts.append(first + at)
                    counts.append(end - at)
                    texts.append(b" ".join(words[at:end]).decode("utf-8", "surrogatepass"))
                    at = end
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array(blocks, pa.int64()), pa.array(starts, pa.int64()),
             pa.array(counts, pa.int64()), pa.array(texts, pa.string())],
            ["key", "block", "start", "words", "part"],
        )

    return run


def mixed_blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself: shard, position, source, epoch, block, n_words and text of every slot.

    ``position`` orders the slots of a shard.  A block has at most ``block`` words, so the
    list of its parts is short.
    """
    rows = written(placed(written(measured(docs), "sizes")), "placed")
    drawn = slots(written(targets(rows), "targets"), block)
    firsts = rows.where("size > 0").groupBy("key", "id", "mark").agg(F.collect_list("first").alias("firsts"))
    source = F.col("source").cast("string")
    texts = docs.select(
        id_of().alias("id"), F.xxhash64(text_of()).alias("mark"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"), text_of().alias("text"),
    )
    keys = ["key", "id", "mark"]
    # rows that repeat id, source and text are cut once, at all their places
    once = F.row_number().over(W.partitionBy(*keys).orderBy(*keys))
    whole = texts.join(firsts.hint("merge"), keys).withColumn("copy", once).where("copy = 1")
    parts = whole.select("key", "text", "firsts").mapInArrow(
        in_batches(_cut(block)), "key string, block long, start long, words long, part string"
    )
    packed = parts.groupBy("key", "block").agg(
        F.sum("words").alias("n_words"), F.sort_array(F.collect_list(F.struct("start", "part"))).alias("parts")
    )
    return drawn.hint("merge").join(packed.hint("merge"), ["key", "block"]).select(
        "shard",
        F.xxhash64("key", "slot", F.lit(SEED)).alias("position"),
        F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).alias("source"),
        "epoch", "block", "n_words",
        F.array_join(F.transform("parts", lambda p: p["part"]), " ").alias("text"),
    )
