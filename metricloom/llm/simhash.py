"""SimHash fingerprints and near-duplicate groups, found with pivot distance tables.

A fingerprint has 64 bits; two link when at most ``BITS`` of them differ.  Distances to
random reference fingerprints concentrate around 32 (a single one keeps 57 % of unrelated
pairs within 4), so no cell of pivot distances alone is small at scale.  Pairs are brought
together by bit blocks first: of six blocks, two fingerprints within 4 bits agree on two, so
one of the 15 block pairs is a common key.  Inside a key a table of Hamming distances to the
pivots is computed; pairs whose coordinates differ by more than 4 anywhere are discarded (by
the triangle inequality none of these links) and the survivors are verified on their bits.

Only distinct fingerprints take part, so copies never form pairs.  A key with more than
``TILE`` fingerprints is cut into chunks of about that size, and every pair of chunks is a
group of its own, so that no task holds more than two chunks at once.  Links are reported as a
spanning forest of what a group links, and components join the forests.

Results for unusual input: NULL texts and texts without words have fingerprint zero and link
like any other; NULL ids count as the smallest id and come back as NULL; repeated rows share
one answer.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.llm.common import ROW, id_of, in_batches, real_id, text_of, unwrapped, wrapped, written
from metricloom.llm.components import components

BITS = 4
SHINGLE = 4
SEED = 42
BLOCKS = 6
PIVOTS = 16
#: Fingerprints of one key that are compared at once; larger keys are cut into chunks.
TILE = 4096
#: Up to this size a key's fingerprints are compared pair by pair, many keys at once.
SMALL = 32
#: Shingles hashed at once.
PIECE = 100_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 hashes of the word shingles, repeats included.

    Words are what ASCII white space separates after lower-casing A-Z; a text of fewer words
    than a shingle is one shingle, a text without words has fingerprint zero.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, count, PIECE):
        part = words[start : start + PIECE + shingle - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        if len(part) > shingle:
            pairs = zip(starts[: len(part) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
            hashes = [digest(joined[a:b], SEED) for a, b in pairs]
        else:
            hashes = [digest(joined, SEED)]
        ones += _ones(np.array(hashes, np.uint64))
    bits = (2 * ones > count).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set, the highest first."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(axis=0, dtype=np.int64)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _fingerprints(batch: pa.RecordBatch) -> pa.RecordBatch:
    prints = [_signed(fingerprint(t.as_py())) for t in batch["text"]]
    return pa.RecordBatch.from_arrays(
        [*batch.columns[:-1], pa.array(prints, pa.int64())], [*batch.schema.names[:-1], "print"]
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``id`` (see :func:`id_of`), ``mark``, a hash of the text, and the fingerprint ``print``."""
    slim = docs.select(id_of().alias("id"), F.xxhash64(text_of()).alias("mark"), text_of().alias("text"))
    return slim.mapInArrow(in_batches(_fingerprints), "id long, mark long, print long")


def pivots(count: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints, drawn from a fixed seed."""
    return np.random.default_rng(7).integers(0, 2**64, count, np.uint64)


def pivot_table(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint to every reference."""
    return np.bitwise_count(prints[:, None] ^ references[None, :]).astype(np.int8)


def forest(prints: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Index pairs that connect all fingerprints linked through each other.

    A breadth-first walk: the fingerprint at hand is compared with those that no group has
    yet, first by the pivot table, then by the bits of the survivors.
    """
    table = pivot_table(prints, pivots())
    left = np.argsort(table[:, 0], kind="stable")
    links: list[tuple[int, int]] = []
    queue: list[int] = []
    while len(left):
        if queue:
            at = queue.pop()
        else:
            at, left = int(left[0]), left[1:]
        # the rest is ordered by the first coordinate: only a stretch of it can be near
        first = table[left, 0]
        low = np.searchsorted(first, table[at, 0] - bits, "left")
        high = np.searchsorted(first, table[at, 0] + bits, "right")
        some = left[low:high]
        for column in range(1, table.shape[1], 5):
            part = table[some, column : column + 5]
            some = some[(np.abs(part - table[at, column : column + 5]) <= bits).all(axis=1)]
        near = some[np.bitwise_count(prints[some] ^ prints[at]) <= bits]
        if len(near):
            links.extend((at, int(b)) for b in near)
            queue.extend(near.tolist())
            left = left[~np.isin(left, near)]
    return links


def _links_of_sorted(batches):
    """Forests of all keys of a partition that is sorted by key; one key spans few batches."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        group = _group_numbers(rows)
        whole = group < group[-1] if len(group) else np.zeros(0, bool)
        rest = rows[~whole].reset_index(drop=True)
        yield _links_of_groups(rows["print"].to_numpy(np.int64)[whole], group[whole])
    if rest is not None and len(rest):
        yield _links_of_groups(rest["print"].to_numpy(np.int64), _group_numbers(rest))


def _group_numbers(rows: pd.DataFrame) -> np.ndarray:
    keys = rows[["pair", "key", "tile"]].to_numpy(np.int64)
    return np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))]) if len(keys) else np.zeros(0, int)


def _links_of_groups(signed: np.ndarray, group: np.ndarray, bits: int = BITS) -> pd.DataFrame:
    """Links within groups of consecutive rows: by walks in large groups, by pairs in small ones."""
    prints = signed.view(np.uint64)
    ends: list[np.ndarray] = []
    sizes = np.bincount(group) if len(group) else np.zeros(0, int)
    starts = np.cumsum(sizes) - sizes
    for g in np.flatnonzero(sizes > SMALL).tolist():
        some = forest(prints[starts[g] : starts[g] + sizes[g]], bits)
        ends.append(np.array(some, np.int64).reshape(-1, 2) + starts[g])
    rows = np.flatnonzero(sizes[group] <= SMALL) if len(group) else np.zeros(0, int)
    table = pivot_table(prints[rows], pivots())
    for shift in range(1, min(SMALL, int(sizes.max(initial=0)))):
        left = np.flatnonzero(group[rows[shift:]] == group[rows[:-shift]])
        far = np.abs(table[left] - table[left + shift]).max(axis=1, initial=0)
        left = left[far <= bits]
        pairs = np.stack([rows[left], rows[left + shift]], 1)
        ends.append(pairs[np.bitwise_count(prints[pairs[:, 0]] ^ prints[pairs[:, 1]]) <= bits])
    both = np.concatenate(ends) if ends else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"a": signed[both[:, 0]], "b": signed[both[:, 1]]})


def block_masks(blocks: int = BLOCKS) -> list[int]:
    """Masks of the pairs of blocks, for blocks of nearly equal width."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [x | y for x, y in combinations(single, 2)]


def keyed(distinct: DataFrame) -> DataFrame:
    """Each distinct fingerprint under its 15 block-pair keys; large keys cut into tiles.

    A key of n chunks becomes n * (n + 1) / 2 pairs of chunks; a fingerprint goes to the n
    pairs its chunk belongs to.  Keys of fewer than two fingerprints are left out.
    """
    masks = [_signed(m) for m in block_masks()]
    pairs = F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(m).alias("mask")) for i, m in enumerate(masks)])
    rows = distinct.select("print", F.inline(pairs)).select(
        "print", "pair", F.col("print").bitwiseAND(F.col("mask")).alias("key")
    )
    sizes = rows.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = rows.hint("merge").join(sizes.hint("merge"), ["pair", "key"])
    small = sized.where(F.col("size") <= TILE).select("print", "pair", "key", F.lit(0).alias("tile"))
    chunks = F.ceil(F.col("size") / TILE)
    large = sized.where(F.col("size") > TILE).select(
        "print", "pair", "key", chunks.cast("int").alias("n"),
        F.pmod(F.xxhash64("print"), chunks).cast("int").alias("c"),
    )
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    tiles = large.select("print", "pair", "key", "c", "n", other.alias("d")).select(
        "print", "pair", "key",
        (F.least("c", "d") * F.col("n") + F.greatest("c", "d") + 1).alias("tile"),
    )
    return small.unionByName(tiles)


def links(distinct: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints that connect all near ones."""
    rows = keyed(distinct).repartition("pair", "key", "tile").sortWithinPartitions("pair", "key", "tile", "print")
    return rows.mapInPandas(_links_of_sorted, "a long, b long").distinct()


def grouped_prints(prints: DataFrame) -> DataFrame:
    """For distinct fingerprints: ``print``, ``root``, the smallest fingerprint reachable, and
    ``component_id``, the smallest id reachable.  ``prints`` has ``id`` and ``print``.
    """
    distinct = written(prints.groupBy("print").agg(F.min("id").alias("least")), "prints")
    found = components(links(distinct))
    rooted = distinct.join(found.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(smallest, "root").select("print", "root", "component_id")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    prints = written(fingerprints(docs), "fingerprints")
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return _with_component(prints).select(
        real_id("id"), hexed.alias("fingerprint"), real_id("component_id", "component_id")
    )


def _with_component(prints: DataFrame) -> DataFrame:
    """Rows of ``prints`` with their component.

    A fingerprint of many rows (fewer than 1000 can have more than a thousandth of them each)
    is looked up in a broadcast; its rows join under other keys, spread over the tasks.
    """
    groups = written(grouped_prints(prints), "groups")
    counts = prints.groupBy("print").agg(F.count(F.lit(1)).alias("n"))
    total = prints.count()
    hot = counts.where(F.col("n") * 1000 > total).join(groups, "print").select(
        F.col("print").alias("hot"), F.col("root").alias("hot_root"), F.col("component_id").alias("hot_component")
    )
    marked = prints.join(F.broadcast(hot), F.col("print") == F.col("hot"), "left")
    spread = marked.withColumn("salt", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(1 << 20)) + 1).otherwise(F.lit(0)))
    found = spread.join(groups.withColumn("salt", F.lit(0).cast("long")), ["print", "salt"], "left")
    return found.select(
        "id", "mark", "print",
        F.coalesce("hot_root", "root").alias("root"),
        F.coalesce("hot_component", "component_id").alias("component_id"),
    )


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, one row a group.

    If several texts of a group share that id, the one with the smallest hash stays.
    """
    prints = written(fingerprints(docs), "fingerprints")
    first = _with_component(prints).where(F.col("id") == F.col("component_id"))
    # the rows that carry a group's smallest id: copies that repeat it, as a rule one row
    kept = first.groupBy("root").agg(F.min(F.struct("id", "mark")).alias("one")).select("one.*")
    keys = ["id", "mark"]
    rows = wrapped(docs, id=id_of(), mark=F.xxhash64(text_of())).join(kept.hint("merge"), keys)
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*keys))
    return unwrapped(rows.select(ROW, place.alias("place")).where("place = 1"))
