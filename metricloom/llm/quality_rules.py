"""Quality rules as a decision list learned by sequential covering.

Every document gets counts (words, symbols, repeats and so on).  Ratios of the counts lie on a fixed
grid.  A rule is a conjunction of thresholds on ratios; it grows on two thirds of the
labelled statistics by the condition of largest information gain, is cut back on the other third
to the beginning that covers most bad rows beyond good ones there, and enters the list if that is
precise.
The rows that it covers leave, and the next rule is learned on the rest.  Every step is one grouped
count over all labelled statistics, so nothing is sampled and the driver sees counts per grid
cell only.  The list becomes one ordered conditional expression: the first rule that holds rejects.

Each distinct vector of statistics has one vote, the majority of its labels (a tie is bad), so that
copies do not outweigh the rest.

Results for unusual input: a NULL text has no words; NULL labels and labels of unknown
documents are ignored, of repeated labels of an id the lowest counts; without labels of both
kinds there are no rules and the base conditions alone decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import text_of, written

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Bytes of text that are looked at together; a longer text is looked at alone.
TOGETHER = 4_000_000
MOST_RULES = 12
MOST_CONDITIONS = 4
#: Share of bad rows among those that a rule covers, on the part that cuts it back.
PRECISION = 0.95
#: Bad rows that a rule covers on the part that cuts it back.
LEAST = 5
LAST_CELL = 1000
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_stutters", "n_distinct", "n_upper", "n_lower", "n_digits", "n_marks",
)
_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


@dataclass(frozen=True)
class Ratio:
    """A ratio of two counts; its grid cells are 1 / ``cells`` wide."""

    name: str
    above: str
    below: str
    cells: int

    def value(self) -> Column:
        return F.coalesce(F.try_divide(F.expr(self.above).cast("double"), F.expr(self.below)), F.lit(0.0))

    def cell(self) -> Column:
        return F.least(F.floor(self.value() * self.cells), F.lit(LAST_CELL)).cast("int")


RATIOS = (
    Ratio("symbols_per_character", "n_symbols", "word_chars", 400),
    Ratio("repeated_lines", "n_dup_lines", "n_lines", 100),
    Ratio("repeated_words", "n_repeat_words", "n_words", 100),
    Ratio("stutters", "n_stutters", "n_words", 200),
    Ratio("upper_letters", "n_upper", "n_upper + n_lower", 100),
    Ratio("digits_per_character", "n_digits", "word_chars", 200),
    Ratio("marks_per_word", "n_marks", "n_words", 50),
    Ratio("distinct_words", "n_distinct", "n_words", 100),
    Ratio("characters_per_word", "word_chars", "n_words", 8),
    Ratio("words_per_line", "n_words", "n_lines", 1),
    Ratio("words", "n_words", "1", 1),
)


@dataclass(frozen=True)
class Condition:
    """``ratio`` at or above (below, if not ``above``) a cell of its grid."""

    ratio: Ratio
    cell: int
    above: bool

    def on_cells(self) -> Column:
        cell = F.col(self.ratio.name)
        return cell >= self.cell if self.above else cell < self.cell

    def column(self) -> Column:
        return self.ratio.cell() >= self.cell if self.above else self.ratio.cell() < self.cell

    def __str__(self) -> str:
        return f"{self.ratio.name} {'>=' if self.above else '<'} {self.cell / self.ratio.cells:g}"


Rule = tuple[Condition, ...]


def _all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that holds rejects a document."""

    rules: tuple[Rule, ...]

    def reason(self) -> Column:
        """Text of the first rule that holds, NULL if none does; over the columns of ``statistics``."""
        out = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            out = F.when(_all([c.column() for c in rule]), F.lit(" and ".join(map(str, rule)))).otherwise(out)
        return out

    def keeps(self) -> Column:
        out = F.lit(True)
        for rule in reversed(self.rules):
            out = F.when(_all([c.column() for c in rule]), F.lit(False)).otherwise(out)
        return out


def _classes() -> dict[str, np.ndarray]:
    kinds = {
        "space": bytes([32, *range(9, 14)]), "n_symbols": SYMBOLS, "n_digits": b"0123456789", "n_marks": b"!?;:()[]{}\"~^=_",
        "n_upper": bytes(range(65, 91)), "n_lower": bytes(range(97, 123)), "inside": bytes(range(128, 192)),
    }
    return {name: np.isin(np.arange(256), list(chosen)) for name, chosen in kinds.items()}


_CLASSES = _classes()


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers that are equal where both parts are."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def _counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Counts of some texts, taken over all their bytes at once."""
    sizes = np.array([len(t) for t in texts])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    flags = {name: table[raw] for name, table in _CLASSES.items()}

    def per_text(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return np.diff(total[bounds])

    out = {c: per_text(flags[c]) for c in ("n_symbols", "n_digits", "n_marks", "n_upper", "n_lower")}
    letters = ~flags["space"]
    out["word_chars"] = per_text(letters & ~flags["inside"])
    begins = letters.copy()
    begins[1:] &= ~letters[:-1]
    firsts = bounds[:-1][sizes > 0]
    begins[firsts] = letters[firsts]
    starts = np.flatnonzero(begins)
    text = np.searchsorted(bounds, starts, "right") - 1
    n = len(texts)
    out["n_words"] = np.bincount(text, minlength=n)
    # words without the space between them, numbered by what they are
    offsets = np.concatenate([np.cumsum(letters)[starts] - 1, [np.count_nonzero(letters)]])
    packed = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[letters])]
    )
    word = packed.dictionary_encode().indices.to_numpy().astype(np.int64)
    same_text = text[1:] == text[:-1]
    out["n_stutters"] = np.bincount(text[1:][same_text & (word[1:] == word[:-1])], minlength=n)
    kinds = len(word) + 1
    out["n_distinct"] = np.bincount(np.unique(text * kinds + word) // kinds, minlength=n)
    out["n_repeat_words"] = np.bincount(text[_in_repeated_windows(text, word)], minlength=n)
    lines, repeated = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        spoken = [line for line in t.split(b"\n") if line.strip()]
        lines[i], repeated[i] = len(spoken), len(spoken) - len(set(spoken))
    out["n_lines"], out["n_dup_lines"] = lines, repeated
    return out


def _in_repeated_windows(text: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Whether a word lies in a window that its text holds twice or more."""
    covered = np.zeros(len(word) + 1, np.int64)
    if len(word) < WINDOW:
        return covered[:-1] > 0
    number, width = word, 1
    while width < WINDOW:  # windows of twice the width from two of the width
        number = _pairs(number[:-width], number[width:])
        width *= 2
    last = len(word) - WINDOW + 1
    inside = np.flatnonzero(text[:last] == text[WINDOW - 1 :])
    _, which, times = np.unique(_pairs(text[inside], number[inside]), return_inverse=True, return_counts=True)
    again = inside[times[which] > 1]
    np.add.at(covered, again, 1)
    np.add.at(covered, again + WINDOW, -1)
    return np.cumsum(covered)[:-1] > 0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch["doc_id"], batch["text"].cast(pa.binary())
        start, size = 0, 0
        for row in range(batch.num_rows + 1):
            more = len(texts[row].as_py()) if row < batch.num_rows else 0
            if start < row and (row == batch.num_rows or size + more > TOGETHER):
                counts = _counts(texts[start:row].to_pylist())
                columns = [pa.array(counts[c], pa.int64()) for c in COUNTS]
                yield pa.RecordBatch.from_arrays([ids[start:row], *columns], names=["doc_id", *COUNTS])
                start, size = row, 0
            size += more


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of every document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_counted, _SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def labelled_cells(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Grid cells of distinct labelled statistics: a column per ratio, ``bad`` and ``grows``."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    votes = (
        stats.where(~base_failed()).groupBy("doc_id", *COUNTS).agg(F.count(F.lit(1)).alias("times"))
        .join(known, "doc_id").groupBy(*COUNTS)
        .agg(F.sum("times").alias("all"), F.sum(F.when(F.col("quality") > 0, F.col("times")).otherwise(0)).alias("good"))
    )
    return written(
        votes.select(
            *[r.cell().alias(r.name) for r in RATIOS], (2 * F.col("good") <= F.col("all")).alias("bad"),
            (F.pmod(F.xxhash64(*COUNTS), F.lit(3)) > 0).alias("grows"),
        ),
        "labelled-cells",
    )


def _grid(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Bad and good rows by ratio and cell."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("ratio"), F.col(r.name).alias("cell")) for i, r in enumerate(RATIOS)]))
    counts = rows.select(cells.alias("at"), "bad").groupBy("at.ratio", "at.cell").agg(
        F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")
    )
    grid = {r.name: (np.zeros(LAST_CELL + 2), np.zeros(LAST_CELL + 2)) for r in RATIOS}
    for ratio, cell, bad, good in counts.collect():  # at most LAST_CELL + 1 cells a ratio
        grid[RATIOS[ratio].name][0][cell], grid[RATIOS[ratio].name][1][cell] = bad, good
    return grid


def _best_condition(grid) -> tuple[float, Condition | None, float]:
    """Condition of the largest information gain, and the share of bad rows that it covers."""
    best = (0.0, None, 0.0)
    for ratio in RATIOS:
        bad, good = grid[ratio.name]
        all_bad, all_good = bad.sum(), good.sum()
        if not all_bad:
            return best
        below = np.concatenate([[0], np.cumsum(bad)]), np.concatenate([[0], np.cumsum(good)])
        for above in (True, False):
            p, n = (all_bad - below[0], all_good - below[1]) if above else below
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - math.log2(all_bad / (all_bad + all_good))), 0)
            cell = int(np.argmax(gain))
            if gain[cell] > best[0] + 1e-9:
                best = (float(gain[cell]), Condition(ratio, cell, above), float(p[cell] / (p[cell] + n[cell])))
    return best


def _cut_back(rows: DataFrame, rule: Rule) -> Rule:
    """The beginning of a rule that separates best on rows it did not grow on; none if it is not precise."""
    parts = [rule[: i + 1] for i in range(len(rule))]
    held = [_all([c.on_cells() for c in part]) for part in parts]
    bad = F.col("bad")
    counts = rows.agg(*[f(h) for h in held for f in (lambda h: F.count_if(h & bad), lambda h: F.count_if(h & ~bad))]).first()
    scored = []
    for i, part in enumerate(parts):
        p, n = counts[2 * i], counts[2 * i + 1]
        if p >= LEAST and p >= PRECISION * (p + n):
            scored.append((p - n, -i, part))
    return max(scored, key=lambda s: s[:2])[2] if scored else ()


def learn(cells: DataFrame) -> DecisionList:
    """Sequential covering over the rows of ``labelled_cells``."""
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        left = cells.where(_all([~_all([c.on_cells() for c in rule]) for rule in rules]))
        growing, rule = left.where("grows"), ()
        while len(rule) < MOST_CONDITIONS:
            gain, condition, pure = _best_condition(_grid(growing.where(_all([c.on_cells() for c in rule]))))
            if condition is None:
                break
            rule += (condition,)
            if pure == 1:
                break
        rule = _cut_back(left.where("NOT grows"), rule) if rule else ()
        if not rule:
            break
        rules.append(rule)
    return DecisionList(tuple(rules))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts of every document and whether it is kept; ``reason`` names the rule that rejects it."""
    stats = written(statistics(docs), "statistics")
    listed = learn(labelled_cells(stats, labels))
    failed = base_failed()
    reason = F.when(failed, F.lit("base")).otherwise(listed.reason())
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(listed.keeps()).alias("kept"), reason.alias("reason"),
    )
