"""Records of text files whose borders depend on all the text before them.

A quoted line break of a CSV cell, or a brace in a JSON string, makes a record border a question of state.  A
file is read in its usual byte ranges, in pieces that end with a separator (a line break, a closing
brace).  A piece maps the state before it to the state after it: inside quotes or not, and how
deep in braces.  The maps of a range compose to one map; the maps of the ranges before it tell
every range the state in which it begins.  A second pass cuts each range into records; only the ends
of records that cross a range's border meet in a shuffle, at most two texts a range.  What the second
pass finds stays on the executors' disks, and every reader of the records starts from there.

No file is one task, and the driver holds one entry for every range that begins inside a record.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: file, byte range, place in the range, text, and what is wrong with it
RECORDS = "file string, block long, place long, text string, problem string"
_PARTS = RECORDS + ", part string, closed boolean"
_BATCH = 5000


@dataclass(frozen=True)
class CsvLines:
    """Lines of strict CSV: quotes open a cell only at its start, and end it."""

    separator: str = "\n"

    def after(self, line: str, inside: bool) -> tuple[bool, int, str | None]:
        """(inside quotes, change of depth, problem) after a line; a malformed record ends with its line."""
        if '"' not in line:
            return inside, 0, None
        at, size = 0, len(line)
        while True:
            if inside or line.startswith('"', at):
                end = _QUOTED.match(line, at if inside else at + 1).end()
                if end == size:
                    return True, 0, None
                at, inside = end + 1, False
                if at == size:
                    return False, 0, None
                if line[at] not in ",\r":
                    return False, 0, "text after a closing quote"
                at += 1
            else:
                stop = _CELL_END.search(line, at)
                if stop is None:
                    return False, 0, None
                at = stop.end()
            if at == size:
                return False, 0, None


@dataclass(frozen=True)
class JsonObjects:
    """Text up to closing braces; a brace in a string is text."""

    separator: str = "}"

    def after(self, piece: str, inside: bool) -> tuple[bool, int, str | None]:
        """State after a piece and the brace that ends it."""
        if inside:
            end = _STRING.match(piece).end()
            if end >= len(piece):
                return True, 0, None
            piece = piece[end + 1 :]
        bare = _STRINGS.sub("", piece)
        if '"' in bare:  # a string that goes on behind the brace
            return True, bare[: bare.index('"')].count("{"), None
        return False, bare.count("{") - 1, None


_QUOTED = re.compile(r'(?:[^"]++|"")*+')
_CELL_END = re.compile("[,\r]")
_STRING = re.compile(r'(?:[^"\\]++|\\(?:.|$))*+', re.S)
_STRINGS = re.compile(r'"(?:[^"\\]++|\\.)*+"', re.S)


def _pieces(spark: SparkSession, path: str, kind) -> DataFrame:
    """Pieces of all files in the order of their ranges."""
    lines = spark.read.option("lineSep", kind.separator).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.when(F.is_valid_utf8("value"), F.col("value")).alias("text"),
        F.when(~F.is_valid_utf8("value"), F.hex(F.col("value").cast("binary"))).alias("bytes"),
    )


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        file, block, text, raw = (batch.column(n) for n in ("file", "block", "text", "bytes"))
        if not len(text):
            continue
        if file[0] == file[-1] and block[0] == block[-1]:  # ranges come one after the other
            where = repeat(file[0].as_py()), repeat(block[0].as_py())
        else:
            where = file.to_pylist(), block.to_pylist()
        yield from zip(*where, text.to_pylist(), repeat(None) if raw.null_count == len(raw) else raw.to_pylist())


def _maps(batches, kind):
    """For each range, the state and depth after it if it begins outside (0) or inside (1) quotes."""
    where, states = None, None
    done = []
    for file, block, text, _ in _rows(batches):
        if (file, block) != where:
            if where is not None:
                done.append((*where, *states))
            where, states = (file, block), [False, 0, True, 0]
        for i in (0, 2):
            states[i], change, _ = kind.after(text or "", states[i])
            states[i + 1] += change
    if where is not None:
        done.append((*where, *states))
    if done:
        columns = list(zip(*done))
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], names=["file", "block", "out0", "deeper0", "out1", "deeper1"]
        )


def _starts(maps: DataFrame) -> DataFrame:
    """State at the start of every range that does not begin at a record."""
    ordered = F.sort_array(F.collect_list(F.struct("block", "out0", "deeper0", "out1", "deeper1")))
    state = "struct<inside:boolean,depth:bigint>"

    def step(known, m):
        last = F.element_at(known, -1)
        after = F.struct(
            F.when(last["inside"], m["out1"]).otherwise(m["out0"]).alias("inside"),
            (last["depth"] + F.when(last["inside"], m["deeper1"]).otherwise(m["deeper0"])).alias("depth"),
        )
        return F.concat(known, F.array(after))

    first = F.array(F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("depth"))).cast(f"array<{state}>")
    files = maps.groupBy("file").agg(ordered.alias("maps"))
    known = files.select("file", "maps", F.aggregate("maps", first, step).alias("states"))
    ranges = known.select("file", F.explode(F.arrays_zip(F.col("maps.block").alias("block"), F.col("states"))).alias("r"))
    return ranges.where("r.block IS NOT NULL AND (r.states.inside OR r.states.depth <> 0)").select(
        "file", F.col("r.block").alias("block"), F.col("r.states.inside").alias("inside"), F.col("r.states.depth").alias("depth")
    )


def _cut(batches, kind, starts):
    """Whole records of the ranges, and the parts of those that cross a border (``part`` is head or tail)."""
    known = starts.value
    where, out = None, []
    texts, inside, depth, problem, place, begun = [], False, 0, None, 0, True
    dirty = None

    def flush():
        columns = list(zip(*out))
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
        names = ["file", "block", "place", "text", "problem", "part", "closed"]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        out.clear()
        return batch

    def end(closed: bool):
        text = kind.separator.join(texts)
        part = None if begun and closed else "tail" if begun else "head"
        out.append((*where, place, text, problem, part, closed))

    for file, block, text, raw in _rows(batches):
        if (file, block) != where:
            if where is not None and texts:
                end(False)
            where, place, texts, problem = (file, block), 0, [], None
            inside, depth = known.get(where, (False, 0))
            begun = where not in known
            dirty = block == 0
        if dirty and text:
            text, dirty = text.removeprefix("\ufeff"), False
        texts.append(raw if text is None else text)
        if text is None:
            problem = "not UTF-8"
        inside, change, wrong = kind.after(text or "", inside)
        depth += change
        problem = problem or wrong
        if not inside and depth <= 0:
            end(True)
            place, texts, problem, begun, depth = place + 1, [], None, True, 0
            if len(out) >= _BATCH:
                yield flush()
    if where is not None and texts:
        end(False)
    if out:
        yield flush()


def records(spark: SparkSession, path: str, kind) -> DataFrame:
    """Records of every file below ``path`` as ``RECORDS``; an open end has the problem ``open end``.

    Texts keep everything but the separator behind the record.
    """
    pieces = _pieces(spark, path, kind)
    maps = pieces.mapInArrow(
        lambda b: _maps(b, kind), "file string, block long, out0 boolean, deeper0 long, out1 boolean, deeper1 long"
    )
    starts = {(r.file, r.block): (r.inside, r.depth) for r in _starts(maps).collect()}  # at most one entry a range
    shared = spark.sparkContext.broadcast(starts)
    cut = pieces.mapInArrow(lambda b: _cut(b, kind, shared), _PARTS).persist(StorageLevel.DISK_ONLY)
    whole = cut.where("part IS NULL").select("file", "block", "place", "text", "problem")
    parts = cut.where("part IS NOT NULL")
    chain = W.partitionBy("file").orderBy("block", "place")
    joined = (
        parts.withColumn("chain", F.sum((F.col("part") == "tail").cast("int")).over(chain))
        .groupBy("file", "chain")
        .agg(
            F.min(F.struct("block", "place")).alias("at"), F.sort_array(F.collect_list(F.struct("block", "place", "text"))).alias("all"),
            F.max("problem").alias("problem"), F.max("closed").alias("closed"),
        )
    )
    text = F.array_join(F.transform("all", lambda x: x["text"]), kind.separator)
    crossing = joined.select(
        "file", F.col("at.block").alias("block"), F.col("at.place").alias("place"), text.alias("text"),
        F.coalesce("problem", F.when(~F.col("closed"), "open end")).alias("problem"),
    )
    return whole.unionByName(crossing)


def _cells_of(text: str) -> tuple[list[list[str]], str | None]:
    """Rows of cells of one record text (several where a lone carriage return ends a row)."""
    plain = text[:-1] if text.endswith("\r") else text
    if '"' not in plain and "\r" not in plain:
        return [plain.split(",")] if plain else [], None
    try:
        return [row for row in csv.reader(io.StringIO(text, newline=""), strict=True) if row], None
    except csv.Error as error:
        return [], str(error)


def _parsed(batches):
    csv.field_size_limit(2**31 - 1)
    for batch in batches:
        found = []
        for file, block, place, text, problem in zip(*(batch.column(n).to_pylist() for n in ("file", "block", "place", "text", "problem"))):
            rows, wrong = ([], problem) if problem else _cells_of(text)
            if wrong:
                found.append((file, block, place, 0, None, text, wrong))
            found += [(file, block, place, i, row, text, None) for i, row in enumerate(rows)]
        if found:
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found), types)],
                names=["file", "block", "place", "line", "cells", "raw", "problem"],
            )


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of strict CSV: file, block, place, line (their order), cells, raw text and problem; blank lines are left out."""
    schema = "file string, block long, place long, line int, cells array<string>, raw string, problem string"
    return records(spark, path, CsvLines()).mapInArrow(_parsed, schema)


def json_items(spark: SparkSession, path: str) -> DataFrame:
    """Objects of top-level JSON arrays: file, block, place, text, and problem.

    A file may also hold one object without an array.  What stands between objects must be the
    array's brackets and commas.
    """
    blanks = F.lit(" \t\r\n")
    trimmed = records(spark, path, JsonObjects()).withColumn("body", F.ltrim("text", blanks))
    sign = F.substring("body", 1, 1)
    signed = trimmed.withColumn("sign", F.when(sign.isin("[", ","), sign).otherwise(""))
    rest = F.when(F.col("sign") == "", F.col("body")).otherwise(F.ltrim(F.expr("substring(body, 2)"), blanks))
    first = (F.col("block") == 0) & (F.col("place") == 0)
    marked = signed.select(
        "file", "block", "place", "text", "problem", "sign", rest.alias("rest"), first.alias("first"),
        (F.instr("text", "{") == 0).alias("bare"),
    )
    led = F.startswith("rest", F.lit("{"))
    objects = marked.where("NOT bare").select(
        "file", "block", "place", F.concat("rest", F.lit("}")).alias("text"),
        F.coalesce(
            "problem", F.when(~led, "no object"),
            F.when(F.col("first") & (F.col("sign") == ","), "a comma before the first object")
            .when(~F.col("first") & (F.col("sign") != ","), "objects without a comma"),
        ).alias("problem"),
    )
    # what stands behind the last object, and whether a bracket stands at either end: a few rows a file
    last = F.row_number().over(W.partitionBy("file").orderBy(F.desc("block"), F.desc("place"))) == 1
    tails = marked.where("bare").withColumn("last", last)
    proper = F.col("last") & F.col("text").rlike(r"^[\x20\t\r\n]*(\[[\x20\t\r\n]*)?\]?[\x20\t\r\n]*$")
    stray = tails.where(~proper).select("file", "block", "place", "text", F.lit("text between or behind the objects").alias("problem"))
    opens = marked.where("first").select("file", F.col("text").rlike(r"^[\x20\t\r\n]*\[").cast("int").alias("n"))
    closes = tails.where("last").select("file", (-F.contains("text", F.lit("]")).cast("int")).alias("n"))
    ends = opens.unionByName(closes).groupBy("file").agg(F.sum("n").alias("n")).where("n <> 0")
    open_ended = ends.select(
        "file", F.lit(2**62).alias("block"), F.lit(0).cast("long").alias("place"), F.lit("").alias("text"),
        F.lit("the brackets of the array do not match").alias("problem"),
    )
    return objects.unionByName(stray).unionByName(open_ended)
