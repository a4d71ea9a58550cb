"""Secrets by patterns and by sliding-window entropy, with built-in functions only.

Candidates are runs of at least ``WINDOW`` characters of A-Z, a-z, 0-9, + / _ = - that hold a
digit.  Each belongs to a character class (hexadecimal, letters and digits, or with symbols)
with a least entropy of its own.  A window of ``WINDOW`` characters slides over a candidate;
its Shannon entropy follows from the counts of the characters, of which two change at a step.
The windows that reach the least entropy of the class are joined to spans.  Candidates on the
allow list (identifiers with dashes in the places of a UUID, words that mark examples, series
of digits or letters, dates) are suppressed, and so are spans inside a pattern's span.

Results for unusual input: NULL and empty texts have no spans; repeated rows repeat theirs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import text_of
from metricloom.llm.spans import bound, joined, located, matches, no_spans, ordered, replaced, running

WINDOW = 20
#: Least entropy in bits of a window, by character class.
LEAST = {"hex": 3.0, "alnum": 3.6, "symbols": 3.8}
#: Windows of a candidate that one fold looks at.
PIECE = 512
#: Counts in a long, and the bits of each; no count is above ``WINDOW``.
PACKED, BITS = 12, 5
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    r"|example|sample|placeholder|dummy|xxxx|0123456789|1234567890|abcdefgh"
    r"|^[a-z]+[-_=][a-z_=-]*[0-9]{1,4}$|^[0-9]{4}-[0-9]{2}-[0-9]{2}[-_a-z0-9]*$|^[-_=+/]*[0-9]+[-_=+/]*$"
)
#: Runs are maximal, so a match starts where none of their characters stands before.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
_ASSIGNED = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
#: Parts of a run that holds an allowed word; the rule of the allow list is for each of them.
PART = r"(?<![^/=])[^/=]{20,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"


def _passing(kind: str, spans: Column) -> Column:
    if kind == "assign":
        # the shortest lead to the value: up to the first : or =
        value = lambda x: F.regexp_extract(x["m"], _ASSIGNED, 1)
        return F.filter(spans, lambda x: F.length(value(x)) >= 6)
    if kind == "access":
        return F.filter(spans, lambda x: x["e"] - x["s"] >= 20)
    return spans


def _term(count: Column) -> Column:
    """c log2 c of a count in a window."""
    table = F.array(*[F.lit(0.0), *[F.lit(c * math.log2(c)) for c in range(1, WINDOW + 1)]])
    return F.element_at(table, count + 1)


def high_windows(codes: Column, least: Column, window: int = WINDOW) -> Column:
    """Windows (first places from 0) of an array of codes that reach the least entropy.

    The state holds the sum of c log2 c and the counts of the alphabet in the window, ``PACKED`` of
    them in a long; a step changes two counts.
    """
    old = F.concat(F.array_repeat(F.lit(-1), window), codes)
    steps = F.transform(F.zip_with(
        codes, F.slice(old, F.lit(1), F.size(codes)), lambda new, gone: F.struct(new.alias("new"), gone.alias("old"))
    ), lambda x, i: F.struct(*[
        part for name in ("new", "old") for part in (
            F.floor(x[name] / PACKED).cast("int").alias(name),
            F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x[name], F.lit(PACKED)) * BITS).alias(f"{name}_unit"),
        )
    ], i.alias("i")))
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // PACKED)).alias("counts"), F.lit(0.0).alias("sum"),
        F.array().cast("array<int>").alias("out"),
    )

    def count(counts: Column, word: Column, unit: Column) -> Column:
        packed = F.element_at(counts, word + 1)
        return F.call_function("div", packed, unit).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def step(state: Column, x: Column) -> Column:
        full = x["old"] >= 0
        left = F.when(full, count(state["counts"], x["old"], x["old_unit"])).otherwise(F.lit(1))
        same = full & (x["old"] == x["new"]) & (x["old_unit"] == x["new_unit"])
        here = count(state["counts"], x["new"], x["new_unit"]) - same.cast("int")
        total = state["sum"] + _term(left - 1) - _term(left) + _term(here + 1) - _term(here)
        high = (x["i"] >= window - 1) & (F.lit(math.log2(window)) - total / window >= least)
        return F.struct(
            F.transform(
                state["counts"],
                lambda c, k: c + F.when(k == x["new"], x["new_unit"]).otherwise(F.lit(0))
                - F.when(full & (k == x["old"]), x["old_unit"]).otherwise(F.lit(0)),
            ).alias("counts"),
            total.alias("sum"),
            F.when(high, F.concat(state["out"], F.array(x["i"] - window + 1))).otherwise(state["out"]).alias("out"),
        )

    return F.aggregate(steps, start, step, lambda state: state["out"])


def entropy_spans(candidate: Column, least: Column, window: int = WINDOW) -> Column:
    """Places (s, e) within a candidate whose windows reach the least entropy, joined.

    The candidate is cut into pieces of ``PIECE`` windows, so that no fold grows with its length.
    """
    codes = F.transform(F.split(candidate, "(?!$)"), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def windows(all_codes: Column) -> Column:
        pieces = F.sequence(F.lit(0), F.floor((F.size(all_codes) - 1) / PIECE).cast("int"))
        return F.flatten(F.transform(pieces, lambda b: F.transform(
            high_windows(F.slice(all_codes, b * PIECE + 1, F.lit(PIECE + window - 1)), least, window), lambda i: i + b * PIECE
        )))

    def spans(starts: Column) -> Column:
        """Windows that overlap or touch are one span."""
        far = F.lit(-window - 1)
        before = F.concat(F.array(far), F.slice(starts, F.lit(1), F.size(starts) - 1))
        opens = F.filter(F.zip_with(starts, before, lambda i, j: F.when(i - j > window, i)), lambda i: i.isNotNull())
        after = F.concat(F.slice(starts, F.lit(2), F.size(starts) - 1), F.array(F.lit(None).cast("int")))
        closes = F.filter(
            F.zip_with(starts, after, lambda i, j: F.when(j.isNull() | (j - i > window), i + window)), lambda i: i.isNotNull()
        )
        return F.zip_with(opens, closes, lambda s, e: F.struct(s.alias("s"), e.alias("e")))

    none = F.array().cast("array<struct<s:int,e:int>>")
    return bound(bound(codes, windows), lambda starts: F.when(F.size(starts) == 0, none).otherwise(spans(starts)))


def least_entropy(candidate: Column) -> Column:
    return (
        F.when(candidate.rlike("^[0-9a-fA-F]+$"), F.lit(LEAST["hex"]))
        .when(candidate.rlike("^[0-9a-zA-Z]+$"), F.lit(LEAST["alnum"]))
        .otherwise(F.lit(LEAST["symbols"]))
    )


def _judged(run: Column) -> Column:
    """The run, or where the allow list speaks against it, the parts of it that the list does not name."""
    parts = F.transform(
        located(run["m"], matches(run["m"], PART), PART),
        lambda p: F.struct((run["s"] + p["s"]).alias("s"), (run["s"] + p["e"]).alias("e"), p["m"].alias("m")),
    )
    unnamed = F.filter(parts, lambda p: p["m"].rlike("[0-9]") & ~p["m"].rlike(ALLOWED))
    return F.when(run["m"].rlike(ALLOWED), unnamed).otherwise(F.array(run))


def found_secrets(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, ``text`` and the spans: assign, access, hex and entropy."""
    rows = docs.select(*keep, text_of().alias("text"))
    for kind, pattern in PATTERNS.items():
        rows = rows.withColumn(f"found_{kind}", matches(F.col("text"), pattern))
    rows = rows.withColumn("found_long", matches(F.col("text"), CANDIDATE))
    for kind, pattern in PATTERNS.items():
        rows = rows.withColumn(kind, _passing(kind, located(F.col("text"), F.col(f"found_{kind}"), pattern)))
    rows = rows.withColumn(
        "long", F.flatten(F.transform(located(F.col("text"), F.col("found_long"), CANDIDATE), _judged))
    )
    inner = F.flatten(
        F.transform(
            "long",
            lambda x: F.transform(
                bound(least_entropy(x["m"]), lambda least: entropy_spans(x["m"], least)),
                lambda p: F.struct((x["s"] + p["s"]).alias("s"), (x["s"] + p["e"]).alias("e"), F.lit("").alias("m")),
            ),
        )
    )
    rows = rows.withColumn("windows", F.when(F.size("long") > 0, inner).otherwise(no_spans()))
    # a window lies in a pattern's span if the largest end among the spans that start by then covers it
    known = F.transform(F.concat(*PATTERNS), lambda x: F.struct(x["s"].alias("s"), F.lit(0).alias("rank"), x["e"].alias("e")))
    asked = F.transform("windows", lambda x: F.struct(x["s"].alias("s"), F.lit(1).alias("rank"), x["e"].alias("e")))
    judged = bound(F.array_sort(F.concat(known, asked)), lambda events: running(
        events, "struct<s:int,rank:int,e:int>", F.lit(-1), "int",
        lambda most, x: F.when(x["rank"] == 0, F.greatest(most, x["e"])).otherwise(most),
        lambda most, x: F.struct(x["s"].alias("s"), x["e"].alias("e"), ((x["rank"] == 1) & (x["e"] > most)).alias("fresh")),
        "struct<s:int,e:int,fresh:boolean>",
    ))
    fresh = F.when(F.size("windows") == 0, no_spans()).otherwise(F.transform(
        F.filter(judged, lambda x: x["fresh"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit("").alias("m"))
    ))
    return rows.select(*keep, "text", *PATTERNS, fresh.alias("entropy"))


def _all(*kinds: str) -> Column:
    parts = [ordered(F.col(kind), rank, kind) for rank, kind in enumerate(kinds)]
    return F.sort_array(F.concat(*parts))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    rows = found_secrets(docs, "doc_id")
    return rows.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in PATTERNS],
        F.sha2(joined(_all(*PATTERNS)).cast("binary"), 256).alias("base_sha256"),
        joined(_all(*PATTERNS, "entropy")).alias("spans"),
    )


def without_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and the text with every span replaced by its kind in brackets."""
    rows = found_secrets(docs, "doc_id")
    marks = F.transform(
        _all(*PATTERNS, "entropy"),
        lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.concat(F.lit("["), x["kind"], F.lit("]")).alias("label")),
    )
    return rows.select("doc_id", replaced(F.col("text"), marks).alias("text"))
