"""Prefix trie of conversations in node tables addressed by minimal perfect hashes.

A node is a distinct sequence of first turns.  Its digest is a sum, modulo 2^128, of mixed SHA-256
hashes of its turns and their places, so that prefixes of one conversation follow by a running
sum and a conversation of any length can be cut into runs.  Every digest that names two
different (parent, turn) pairs stops the job, so digests stand for whole sequences.

Turns are sorted by conversation over shards of bounded size.  A shard enumerates the distinct
digests of its prefixes, gives each a slot by a minimal perfect hash, verifies the slot's digest
and scatters counts into flat arrays.  After the counts of all shards have met (one row of a
node and shard, so a frequent first turn is one row a shard), every node is credited to the shard
that holds its smallest member; values flow up through the array of parent slots in the order
of depth, and the sums of all shards add up.

A conversation that spans shards is a run in each.  What is credited to it in later runs enters
the shard of an earlier run at the run's last node, and leaves its own shard at the
node before the run, so each value flows to each ancestor once.  There is at most one such
conversation per border of two shards.

Results for unusual input: rows with a NULL conv_id belong to no conversation and are ignored; NULL
roles and texts are empty; rows of a conversation with equal turns come in the order of a hash
of role and text (equal rows are turns of their own); an empty table has no node.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.llm.common import written

#: Turns of a shard: so many if that gives every core one, and never more than the second.
SHARD_ROWS = 20_000
MOST_ROWS = 1_000_000
#: Turns of the block's first conversation that any conversation may take over.
HEAD = 5
_NONE = np.iinfo(np.int64).max
_LOCAL = (
    "part int, lo long, hi long, plo long, phi long, klo long, khi long, depth int, n_chars long,"
    " n long, n_ends long, first long, ends string"
)
_SUMS = (
    "lo long, hi long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long,"
    " saved_tokens long, ends string, sha string, part int, alone boolean, local boolean"
)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def placed_hash(klo: np.ndarray, khi: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a turn at a depth adds to the digest."""
    d = depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    lo = _mixed(_mixed(klo + d) ^ khi)
    hi = _mixed(_mixed(khi ^ d) + klo * np.uint64(3) + np.uint64(0x632BE59BD9B4E019))
    return lo, hi


class NodeTable:
    """Slots 0 to n - 1 for n distinct 128-bit digests, by a minimal perfect hash in levels.

    A level hashes the digests left over into twice as many bits; those alone on their bit
    stay, the others go on.  A digest's slot is the rank of its bit.  The digest kept in the slot
    tells members from others.
    """

    def __init__(self, lo: np.ndarray, hi: np.ndarray):
        self.levels = []
        left = np.arange(len(lo))
        slots = np.empty(len(lo), np.int64)
        used = 0
        while len(left):
            size = 2 * len(left)
            bit = self._bit(lo[left], hi[left], len(self.levels), size)
            alone = np.bincount(bit, minlength=size) == 1
            rank = np.cumsum(alone) - 1 + used
            stays = alone[bit]
            slots[left[stays]] = rank[bit[stays]]
            self.levels.append((size, alone, rank))
            used += int(alone.sum())
            left = left[~stays]
            if len(self.levels) > 200:
                raise ValueError("Digests are not distinct.")
        self.lo, self.hi = np.empty_like(lo), np.empty_like(hi)
        self.lo[slots], self.hi[slots] = lo, hi
        if not np.array_equal(self.slots(lo, hi), slots):
            raise ValueError("Slots do not hold their digests.")

    @staticmethod
    def _bit(lo, hi, level: int, size: int) -> np.ndarray:
        salt = np.uint64(level * 0xD6E8FEB86659FD93 % 2**64)
        return (_mixed(lo + salt + _mixed(hi)) % np.uint64(size)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.lo)

    def slots(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Slot of every digest, -1 for those that are not in the table."""
        found = np.full(len(lo), -1, np.int64)
        left = np.arange(len(lo))
        for level, (size, alone, rank) in enumerate(self.levels):
            bit = self._bit(lo[left], hi[left], level, size)
            here = alone[bit]
            found[left[here]] = rank[bit[here]]
            left = left[~here]
        if len(self):
            same = (found >= 0) & (self.lo[found] == lo) & (self.hi[found] == hi)
            found[~same] = -1
        return found


def _u64(values) -> np.ndarray:
    return np.asarray(values, np.int64).view(np.uint64)


def _distinct(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((lo, hi))
    lo, hi = lo[order], hi[order]
    new = np.ones(len(lo), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    return lo[new], hi[new]


def _turns_of_shard(own: pd.DataFrame, others: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Turns of a shard in order of conversation and depth, with prefix digests; and its runs.

    ``others`` holds the shard's runs (kind 0: ``n_head``, turns to skip, turns before, the digest
    before) and the turns taken over from the block's first conversation (kind 1).
    """
    runs = others[others["kind"] == 0].sort_values("conv").reset_index(drop=True)
    heads = others[others["kind"] == 1]
    own = own.sort_values("id")
    run = runs["conv"].to_numpy()
    conv = own["conv"].to_numpy()
    at = np.searchsorted(run, conv)
    place = np.arange(len(own)) - np.searchsorted(conv, conv) + runs["before"].to_numpy()[at] + 1
    skip, n_head = runs["skip"].to_numpy()[at], runs["n_head"].to_numpy()[at]
    kept = place > skip
    depth = place - skip + n_head
    columns = [
        np.concatenate([conv[kept], heads["conv"].to_numpy()]),
        np.concatenate([depth[kept], heads["depth"].to_numpy()]),
        *(np.concatenate([own[c].to_numpy()[kept], heads[c].to_numpy()]) for c in ("klo", "khi", "n_chars")),
    ]
    order = np.lexsort((columns[1], columns[0]))
    conv, depth, klo, khi, n_chars = (np.asarray(c, np.int64)[order] for c in columns)
    lo, hi = placed_hash(_u64(klo), _u64(khi), depth)
    at = np.searchsorted(run, conv)
    starts = np.searchsorted(conv, conv)
    sums = []
    for add, before in ((lo, "lo"), (hi, "hi")):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(add, dtype=np.uint64)])
        sums.append((total[1:] - total[:-1][starts] if len(conv) else add) + _u64(runs[before])[at])
    return pd.DataFrame(
        {
            "conv": conv, "depth": depth, "klo": klo, "khi": khi, "n_chars": n_chars,
            "lo": sums[0].view(np.int64), "hi": sums[1].view(np.int64),
            "plo": (sums[0] - lo).view(np.int64), "phi": (sums[1] - hi).view(np.int64),
        }
    ), runs


def _local_nodes(key: tuple, own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """One row for every prefix in a shard, with the counts of its conversations."""
    turns, runs = _turns_of_shard(own, others)
    conv, depth = turns["conv"].to_numpy(), turns["depth"].to_numpy()
    lo, hi, plo, phi = (_u64(turns[c]) for c in ("lo", "hi", "plo", "phi"))
    zero = np.zeros(1, np.uint64)
    blo, bhi = _u64(runs["lo"]), _u64(runs["hi"])
    # the root as well, and the nodes before runs that go on from another shard
    table = NodeTable(*_distinct(np.concatenate([lo, blo, zero]), np.concatenate([hi, bhi, zero])))
    slot = table.slots(lo, hi)
    root = int(table.slots(zero, zero)[0])
    size = len(table)
    n = np.bincount(slot, minlength=size)
    first = np.full(size, _NONE, np.int64)
    np.minimum.at(first, slot, conv)
    parent = np.full((2, size), 0, np.int64)
    fields = {name: np.zeros(size, np.int64) for name in ("klo", "khi", "depth", "n_chars")}
    for name, values in fields.items():
        values[slot] = turns[name].to_numpy()
    parent[0, slot], parent[1, slot] = plo.view(np.int64), phi.view(np.int64)
    starting = np.sort(runs.loc[runs["before"] == 0, "conv"].to_numpy())
    n[root] = len(starting)
    if len(starting):
        first[root] = starting[0]
    # conversations that end here: at the last turn of their last run, or before a run without turns
    last = np.append(conv[1:] != conv[:-1], True) if len(conv) else np.zeros(0, bool)
    closing = runs.loc[runs["closing"], "conv"].to_numpy()
    ended = last & np.isin(conv, closing)
    silent = np.setdiff1d(closing, conv)
    run = np.searchsorted(runs["conv"].to_numpy(), silent)
    enders = np.concatenate([conv[ended], silent])
    places = np.concatenate([slot[ended], table.slots(blo[run], bhi[run])])
    order = np.lexsort((enders, places))
    enders, places = enders[order], places[order]
    n_ends = np.bincount(places, minlength=size)
    ends = [None] * size
    cuts = np.flatnonzero(np.append(True, places[1:] != places[:-1])) if len(places) else []
    for a, b in zip(cuts, [*cuts[1:], len(places)]):
        ends[places[a]] = ",".join(map(str, enders[a:b].tolist()))
    return pd.DataFrame(
        {
            "part": key[0], "lo": table.lo.view(np.int64), "hi": table.hi.view(np.int64),
            "plo": parent[0], "phi": parent[1], **{k: fields[k] for k in ("klo", "khi", "depth", "n_chars")},
            "n": n, "n_ends": n_ends, "first": pd.arrays.IntegerArray(first, first == _NONE), "ends": ends,
        }
    )


def _shard_sums(nodes: pd.DataFrame) -> pd.DataFrame:
    """What a shard knows of its nodes' subtrees; the sums of all shards are the whole."""
    lo, hi = _u64(nodes["lo"]), _u64(nodes["hi"])
    table = NodeTable(lo, hi)
    size = len(table)
    slot = table.slots(lo, hi)
    back = np.empty(size, np.int64)
    back[slot] = np.arange(size)
    nodes = nodes.take(back)
    depth = nodes["depth"].to_numpy()
    n, n_ends = nodes["n_convs"].to_numpy(), nodes["all_ends"].to_numpy()
    here = nodes["n"].to_numpy()
    conv = nodes["conv_id"].to_numpy()
    credited = (here > 0) & nodes["is_first"].to_numpy()
    parent = table.slots(_u64(nodes["plo"]), _u64(nodes["phi"]))
    parent[(here == 0) | (depth == 0)] = -1
    leaves = nodes["more_leaves"].to_numpy() + (credited & (n == n_ends))
    saved = nodes["more_saved"].to_numpy() + np.where(credited, (n - 1) * nodes["n_chars"].to_numpy(), 0)
    children = np.zeros(size, np.int64)
    np.add.at(children, parent[credited & (parent >= 0)], 1)
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(depth[order]) != 0))
    for a, b in zip(cuts, [*cuts[1:], size]):
        level = order[a:b]
        level = level[parent[level] >= 0]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    above = pd.arrays.IntegerArray(conv[np.maximum(parent, 0)], (parent < 0) | ~credited)
    ends = nodes["ends"].to_numpy()
    alone = nodes["alone"].to_numpy()
    whole = nodes["n_ends"].to_numpy() == n_ends
    sha = [
        hashlib.sha256((e or "").encode()).hexdigest() if w and (e or c) else None
        for e, w, c in zip(ends, whole, credited.tolist())
    ]
    return pd.DataFrame(
        {
            "lo": nodes["lo"].to_numpy(), "hi": nodes["hi"].to_numpy(), "conv_id": conv,
            "depth": np.where(here > 0, depth, -1).astype(np.int64), "parent_conv_id": above, "n_convs": n,
            "n_children": children, "n_leaves": leaves, "saved_tokens": saved,
            "ends": [None if w else e for e, w in zip(ends, whole)], "sha": sha, "part": nodes["part"].to_numpy(),
            "alone": alone, "local": here > 0,
        }
    )


def _streamed_digests(batches):
    """SHA-256 of the comma-joined chunks of every node; rows come sorted by node and shard."""
    node, state = None, None
    for batch in batches:
        out = []
        for lo, hi, ends in zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "ends"))):
            if (lo, hi) != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (lo, hi), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ends.encode())
        if out:
            yield _digest_batch(out)
    if node is not None:
        yield _digest_batch([(*node, state.hexdigest())])


def _digest_batch(rows):
    return pa.RecordBatch.from_pylist([dict(zip(("lo", "hi", "merged"), r)) for r in rows])


def _run_totals(key: tuple, turns: pd.DataFrame) -> pd.DataFrame:
    """What all turns of a run add to the digest."""
    kept = turns[turns["depth"] > 0]
    lo, hi = placed_hash(_u64(kept["klo"]), _u64(kept["khi"]), kept["depth"].to_numpy())
    total = [np.array([x.sum(dtype=np.uint64)]).view(np.int64)[0] for x in (lo, hi)]
    return pd.DataFrame({"conv": [key[0]], "part": [key[1]], "lo": [total[0]], "hi": [total[1]]})


def _digests_before(runs: pd.DataFrame) -> pd.DataFrame:
    """Running sums of a conversation's runs, without the run itself."""
    runs = runs.sort_values("part")
    for name in ("lo", "hi"):
        value = _u64(runs[name])
        runs[name] = (np.cumsum(value, dtype=np.uint64) - value).view(np.int64)
    return runs[["conv", "part", "lo", "hi"]]


def prefix_trie(
    conversations: DataFrame, n_head: Column | None = None, shard_rows: int = SHARD_ROWS, most_rows: int = MOST_ROWS
) -> DataFrame:
    """The nodes of the trie; ``n_head`` gives the turns that a conversation takes over.

    ``n_head`` is a column over ``conv`` with values from 0 to ``HEAD``: that many first turns of the
    conversation ``conv - conv % 100`` take the place of its own first turns.
    """
    spark = conversations.sparkSession
    n_head = F.lit(0) if n_head is None else n_head
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the length of the role tells where the text begins
    whole = F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256)
    slim = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(whole, 1, 32)).alias("k"), F.length(text).cast("long").alias("n_chars"),
        F.monotonically_increasing_id().alias("row"),
    )
    total = conversations.count()
    parts = max(1, math.ceil(total / most_rows), min(spark.sparkContext.defaultParallelism, math.ceil(total / shard_rows)))
    keys = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("k"), F.col("row")]

    def half(start: int) -> Column:
        """Eight bytes of the hash as a signed long."""
        return F.conv(F.hex(F.substring("k", start, 8)), 16, -10).cast("long")

    dealt = slim.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    turns = written(
        dealt.select(
            F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"), "conv", "n_chars",
            half(1).alias("klo"), half(9).alias("khi"),
        ),
        "turns",
    )
    runs = written(_runs(turns, n_head), "runs")
    spanning = runs.where("n_runs > 1")
    heads = _heads(turns, runs)
    no_turn = [F.lit(0).cast("long").alias(c) for c in ("depth", "klo", "khi", "n_chars")]
    borders = _borders(turns, spanning, heads)
    # at most two spanning runs a shard
    described = runs.join(F.broadcast(borders), ["conv", "part"], "left")
    others = described.select(
        "part", F.lit(0).alias("kind"), "conv", "n_head", "skip", "before", "closing",
        F.coalesce("lo", F.lit(0)).alias("lo"), F.coalesce("hi", F.lit(0)).alias("hi"), *no_turn,
    ).unionByName(
        heads.select(
            "part", F.lit(1).alias("kind"), "conv", *[F.lit(0).cast("long").alias(c) for c in ("n_head", "skip", "before")],
            F.lit(False).alias("closing"), *[F.lit(0).cast("long").alias(c) for c in ("lo", "hi")],
            F.col("depth").cast("long").alias("depth"), "klo", "khi", "n_chars",
        )
    )
    local = written(
        turns.groupBy("part").cogroup(others.groupBy("part")).applyInPandas(_local_nodes, _LOCAL), "local-nodes"
    )
    return _merged(local, borders)


def _runs(turns: DataFrame, n_head: Column) -> DataFrame:
    """One row for every conversation and shard: turns before the run, turns to skip and to take over."""
    pieces = turns.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    by_part = W.partitionBy("conv").orderBy("part")
    pieces = pieces.select(
        "conv", "part", "n",
        F.coalesce(F.sum("n").over(by_part.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(W.partitionBy("conv")).alias("length"),
        F.count(F.lit(1)).over(W.partitionBy("conv")).alias("n_runs"),
        F.lead("part").over(by_part).isNull().alias("closing"),
        n_head.cast("long").alias("skip"), (F.col("conv") - F.col("conv") % 100).alias("base"),
    )
    bases = pieces.where("before = 0 AND conv % 100 = 0").select(F.col("conv").alias("base"), F.col("length").alias("base_length"))
    taken = F.least("skip", F.coalesce("base_length", F.lit(0)))
    return pieces.join(bases, "base", "left").select(
        "conv", "part", "n", "before", "n_runs", "closing", "skip", "base", taken.alias("n_head")
    )


def _heads(turns: DataFrame, runs: DataFrame) -> DataFrame:
    """Turns that conversations take over, in the shard of the conversation's first run."""
    leading = turns.where("conv % 100 = 0").join(
        runs.where(f"conv % 100 = 0 AND before < {HEAD}").select("conv", "part", "before"), ["conv", "part"]
    )
    place = F.row_number().over(W.partitionBy("conv", "part").orderBy("id"))
    leading = leading.withColumn("place", place).where(F.col("place") <= HEAD)
    leading = leading.withColumn("depth", F.col("place") + F.col("before")).where(F.col("depth") <= HEAD)
    return (
        runs.where("before = 0 AND n_head > 0").select("conv", "part", "base", "n_head")
        .join(leading.select(F.col("conv").alias("base"), "depth", "klo", "khi", "n_chars"), "base")
        .where("depth <= n_head")
        .select("conv", "part", "depth", "klo", "khi", "n_chars")
    )


def _borders(turns: DataFrame, spanning: DataFrame, heads: DataFrame) -> DataFrame:
    """Digest before every run of the conversations that span shards."""
    few = F.broadcast(spanning.select("conv", "part", "before", "skip", "n_head"))
    place = F.row_number().over(W.partitionBy("conv", "part").orderBy("id")) + F.col("before")
    own = turns.join(few, ["conv", "part"]).withColumn("place", place)
    depth = F.when(F.col("place") > F.col("skip"), F.col("place") - F.col("skip") + F.col("n_head")).otherwise(0)
    own = own.select("conv", "part", depth.cast("long").alias("depth"), "klo", "khi")
    taken = heads.join(F.broadcast(spanning.select("conv", "part")), ["conv", "part"])
    taken = taken.select("conv", "part", F.col("depth").cast("long").alias("depth"), "klo", "khi")
    schema = "conv long, part int, lo long, hi long"
    totals = own.unionByName(taken).groupBy("conv", "part").applyInPandas(_run_totals, schema)
    return written(totals.groupBy("conv").applyInPandas(_digests_before, schema), "borders")


def _merged(local: DataFrame, borders: DataFrame) -> DataFrame:
    """Counts of all shards, the shards' sums of subtrees, and their sum."""
    # a node has one row a shard
    node = W.partitionBy("lo", "hi")
    real = F.col("n") > 0
    pair = F.struct("plo", "phi", "klo", "khi", "depth")
    known = local.select(
        "*", F.sum("n").over(node).alias("n_convs"), F.sum("n_ends").over(node).alias("all_ends"),
        F.min("first").over(node).alias("conv_id"), F.max("part").over(node).alias("last_part"),
        F.min("part").over(node).alias("first_part"),
        F.min(F.when(real, pair)).over(node).alias("one"), F.max(F.when(real, pair)).over(node).alias("other"),
    )
    same = F.when(F.col("one") == F.col("other"), True).otherwise(
        F.raise_error(F.lit("Two different conversation prefixes share a digest.")).cast("boolean")
    )
    known = written(
        known.where(same).select(
            "part", "lo", "hi", "plo", "phi", "depth", "n_chars", "n", "n_ends", "ends", "n_convs", "all_ends",
            "conv_id", F.coalesce(F.col("first") == F.col("conv_id"), F.lit(False)).alias("is_first"),
            (F.col("first_part") == F.col("last_part")).alias("alone"),
        ),
        "known-nodes",
    )
    credit = known.where("is_first").join(
        F.broadcast(borders.select(F.col("conv").alias("conv_id"), "part")), ["conv_id", "part"]
    )
    credit = credit.groupBy("conv_id", "part").agg(
        F.count_if(F.col("n_convs") == F.col("all_ends")).alias("leaves"),
        F.sum((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"),
    )
    by_part = W.partitionBy("conv").orderBy("part")
    later = by_part.rowsBetween(0, W.unboundedFollowing)
    runs = borders.join(credit.withColumnRenamed("conv_id", "conv"), ["conv", "part"], "left").select(
        "conv", "part", "lo", "hi", F.row_number().over(by_part).alias("place"), F.lag("part").over(by_part).alias("earlier"),
        F.sum(F.coalesce("leaves", F.lit(0))).over(later).alias("leaves"),
        F.sum(F.coalesce("saved", F.lit(0))).over(later).alias("saved"),
    ).where("place > 1")
    # what a run and those after it are credited: out of its own shard, into the shard of the run before
    moved = runs.select("part", "lo", "hi", (-F.col("leaves")).alias("leaves"), (-F.col("saved")).alias("saved")).unionByName(
        runs.select(F.col("earlier").alias("part"), "lo", "hi", "leaves", "saved")
    )
    moved = moved.groupBy("part", "lo", "hi").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    ready = known.join(F.broadcast(moved), ["part", "lo", "hi"], "left").fillna(0, ["more_leaves", "more_saved"])
    sums = written(ready.groupBy("part").applyInPandas(_shard_sums, _SUMS), "shard-sums")
    chunks = sums.where("ends IS NOT NULL").select("lo", "hi", "part", "ends")
    digests = (
        chunks.repartition("lo", "hi").sortWithinPartitions("lo", "hi", "part")
        .mapInArrow(_streamed_digests, "lo long, hi long, merged string")
    )
    names = ("n_children", "n_leaves", "saved_tokens")
    alone = sums.where("alone").select("lo", "hi", "conv_id", "depth", "parent_conv_id", "n_convs", *names, "sha")
    split = sums.where("NOT alone").groupBy("lo", "hi").agg(
        F.max("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_conv_id").alias("parent_conv_id"),
        F.max("n_convs").alias("n_convs"), *[F.sum(c).alias(c) for c in names], F.max("sha").alias("sha"),
    )
    split = split.join(digests, ["lo", "hi"], "left").withColumn("sha", F.coalesce("merged", "sha")).drop("merged")
    nothing = hashlib.sha256(b"").hexdigest()
    return alone.unionByName(split).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", *names, F.coalesce("sha", F.lit(nothing)).alias("ends_sha256")
    )
