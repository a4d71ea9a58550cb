"""Places of pattern matches in texts, with built-in functions only.

A span is a struct of ``s`` and ``e`` (code points, end exclusive) and the matched ``m``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items of one fold; see :func:`running`.
FOLD = 256
_KIND = "array<struct<s:int,e:int,m:string>>"


def no_spans() -> Column:
    return F.array().cast(_KIND)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function`` of a value that is computed once, however often the function's lambdas name it."""
    return F.element_at(F.transform(F.array(value), function), 1)


def running(
    items: Column, kind: str, zero: Column, state: str, move: Callable[[Column, Column], Column],
    emit: Callable[[Column, Column], Column], out: str,
) -> Column:
    """``emit(state, item)`` of every item, with the state that ``move`` made of those before.

    ``items`` is bound or a column; ``kind``, ``state`` and ``out`` are the types of an item, a state and a
    result.  Folds of bounded length keep the work linear.
    """
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(items) - 1) / FOLD).cast("int")),
        lambda b: F.slice(items, b * FOLD + 1, F.lit(FOLD)),
    )

    def spread(at: Column, block: Column) -> Column:
        return F.struct(
            F.aggregate(block, at["at"], move).alias("at"),
            F.concat(at["out"], F.array(F.struct(at["at"].alias("at"), block.alias("block")))).alias("out"),
        )

    def step(at: Column, item: Column) -> Column:
        return F.struct(
            move(at["at"], item).alias("at"), F.concat(at["out"], F.array(emit(at["at"], item))).alias("out")
        )

    none = F.array().cast(f"array<struct<at:{state},block:array<{kind}>>>")
    started = F.aggregate(blocks, F.struct(zero.alias("at"), none.alias("out")), spread)["out"]
    nothing = F.array().cast(f"array<{out}>")
    folded = F.transform(
        started, lambda x: F.aggregate(x["block"], F.struct(x["at"].alias("at"), nothing.alias("out")), step)["out"]
    )
    return F.when(F.size(items) == 0, nothing).otherwise(F.flatten(folded))


def located(text: Column, found: Column, pattern: str) -> Column:
    """Spans of ``found``, the matches of ``pattern`` in ``text``.

    The pattern must not match the empty text; the gaps are what splitting by it leaves.
    """
    gaps = F.split(text, pattern, -1)
    pieces = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(found)), found,
        lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("own"), m.alias("m")),
    )

    def placed(at: Column, p: Column) -> Column:
        start = at + p["gap"]
        return F.struct(start.alias("s"), (start + p["own"]).alias("e"), p["m"].alias("m"))

    def added_up(bound_pieces: Column) -> Column:
        return running(
            bound_pieces, "struct<gap:int,own:int,m:string>", F.lit(0), "int",
            lambda at, p: at + p["gap"] + p["own"], placed, "struct<s:int,e:int,m:string>",
        )

    return F.when(F.size(found) == 0, no_spans()).otherwise(bound(pieces, added_up))


def outside(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that overlap none of ``others``, by start; linear but for the sort.

    A span is met at its end: the largest end among the others that started before tells.
    """
    asked = F.transform(spans, lambda x: F.struct(x["e"].alias("at"), F.lit(0).alias("rank"), x["s"].alias("far")))
    known = F.transform(others, lambda x: F.struct(x["s"].alias("at"), F.lit(1).alias("rank"), x["e"].alias("far")))
    judged = bound(F.array_sort(F.concat(asked, known)), lambda events: running(
        events, "struct<at:int,rank:int,far:int>", F.lit(-1), "int",
        lambda most, x: F.when(x["rank"] == 1, F.greatest(most, x["far"])).otherwise(most),
        lambda most, x: F.struct(x["far"].alias("s"), x["at"].alias("e"), ((x["rank"] == 0) & (most <= x["far"])).alias("free")),
        "struct<s:int,e:int,free:boolean>",
    ))
    free = F.transform(
        F.filter(judged, lambda x: x["free"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit("").alias("m"))
    )
    return F.when(F.size(spans) == 0, no_spans()).otherwise(free)


def ordered(spans: Column, rank: int, kind: str) -> Column:
    """Structs that sort by start, then the rank of the kind, then end."""
    return F.transform(
        spans,
        lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(kind).alias("kind")),
    )


def joined(ordered_spans: Column) -> Column:
    """kind:start:end of sorted structs, comma-joined."""
    text = F.transform(
        ordered_spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))
    )
    return F.array_join(text, ",")


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with spans (s, e, label; sorted by s) replaced; overlapping ones act as one."""
    def step(state: Column, x: Column) -> Column:
        overlap = x["s"] < state["at"]
        return F.struct(
            F.greatest(state["at"], x["e"]).alias("at"),
            F.when(overlap, state["out"]).otherwise(
                F.concat(state["out"], F.substring(text, state["at"] + 1, x["s"] - state["at"]), x["label"])
            ).alias("out"),
        )

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
