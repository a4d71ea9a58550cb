"""KPI definitions and their compilation to mergeable aggregates.

A KPI becomes a :class:`Measure`: a row filter, a list of partial states that can be
merged (sum, count, min, max), and a final expression over the merged states.  One
``groupBy`` can therefore carry the states of every KPI, and coarser groupings are
merged from finer ones without reading the table again.  Medians cannot be merged and
are computed by :func:`metricloom.operators.quantiles.exact_quantiles`.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.formula import Formula, FormulaError, compile_formula
from metricloom.functions.values import Table, clean, finite, near_zero
from metricloom.operators.quantiles import exact_quantiles

# KPI vocabulary and limits.
AGGREGATIONS = ("sum", "mean", "median", "min", "max")
OPERATIONS = (
    "add",
    "subtract",
    "multiply",
    "ratio",
    "percentage_ratio",
    "percentage_difference",
    "margin_percentage",
)
PERCENTAGE_OPERATIONS = ("percentage_ratio", "percentage_difference", "margin_percentage")
RATIO_OPERATIONS = ("ratio",) + PERCENTAGE_OPERATIONS
DISPLAY_FORMATS = ("number", "percentage", "currency")
TARGET_SCOPES = ("dataset", "row", "period", "segment")
MAX_KPIS = 5
MAX_INCLUDED_VALUES = 20


class KpiError(ValueError):
    """A KPI definition is not valid."""


@dataclass(frozen=True)
class Kpi:
    """One KPI: a source column, a formula, or a conditional rate."""

    name: str
    kind: str
    aggregation: str
    column: str | None = None
    formula: str | None = None
    level: str | None = None
    condition_column: str | None = None
    included_values: tuple[str, ...] = ()
    base: str | None = None
    value_column: str | None = None
    direction: str = "higher"
    target: float | None = None
    target_scope: str = "dataset"
    display_format: str = "number"

    def __post_init__(self) -> None:
        if not self.name.strip():
            raise KpiError("A KPI needs a name.")
        if self.direction not in ("higher", "lower"):
            raise KpiError("The direction is 'higher' or 'lower'.")
        if self.display_format not in DISPLAY_FORMATS:
            raise KpiError(f"The display format is one of {DISPLAY_FORMATS}.")
        if self.target_scope not in TARGET_SCOPES:
            raise KpiError(f"The target scope is one of {TARGET_SCOPES}.")
        if self.target is not None:
            if self.target_scope == "row" and not self.row_level:
                raise KpiError("A row target needs a row-level KPI.")
            if self.kind == "conditional" and not 0 <= self.target <= 100:
                raise KpiError("A conditional target lies between 0 and 100.")
        if self.kind == "conditional":
            if self.base not in ("record_count", "value_sum"):
                raise KpiError("The base is 'record_count' or 'value_sum'.")
            if not 1 <= len(self.included_values) <= MAX_INCLUDED_VALUES:
                raise KpiError(f"Select 1 to {MAX_INCLUDED_VALUES} condition values.")
            if self.base == "value_sum" and not self.value_column:
                raise KpiError("A value share needs a value column.")

    @property
    def row_level(self) -> bool:
        return self.kind == "source" or (self.kind == "formula" and self.level == "row")

    @property
    def metric_id(self) -> str:
        """``MET-`` plus twelve hex digits over the defining fields."""
        identity = {
            "aggregation": self.aggregation,
            "base": self.base,
            "column": self.column,
            "condition": self.condition_column,
            "formula": self.formula,
            "kind": self.kind,
            "level": self.level,
            "name": self.name,
            "value_column": self.value_column,
            "values": list(self.included_values),
        }
        text = json.dumps(identity, sort_keys=True, separators=(",", ":"))
        return "MET-" + hashlib.sha256(text.encode()).hexdigest()[:12].upper()

    @property
    def source_columns(self) -> tuple[str, ...]:
        if self.kind == "source":
            return (self.column,)
        if self.kind == "conditional":
            pair = (self.condition_column, self.value_column)
            return tuple(c for c in dict.fromkeys(pair) if c)
        from metricloom.functions.formula import _REFERENCE

        found = (m.replace("]]", "]") for m in _REFERENCE.findall(self.formula))
        return tuple(dict.fromkeys(found))

    @property
    def formula_label(self) -> str | None:
        """Canonical definition text, as stored in the metric-definition table."""
        if self.kind == "formula":
            return compile_formula(
                self.formula, self.level, frozenset(self.source_columns)
            ).label
        if self.kind == "conditional":
            values = ", ".join(self.included_values)
            match = f"[{self.condition_column}] IN ({values})"
            if self.base == "record_count":
                return f"COUNT WHERE {match} / COUNT * 100"
            return f"SUM([{self.value_column}]) WHERE {match} / SUM([{self.value_column}]) * 100"
        return None


def source_kpi(column: str, aggregation: str = "sum", **settings) -> Kpi:
    if aggregation not in AGGREGATIONS:
        raise KpiError(f"The aggregation is one of {AGGREGATIONS}.")
    return Kpi(column, "source", aggregation, column=column, **settings)


def formula_kpi(
    name: str, formula: str, level: str = "row", aggregation: str = "sum", **settings
) -> Kpi:
    if level == "aggregate":
        aggregation = "formula"
    elif aggregation not in AGGREGATIONS:
        raise KpiError(f"The aggregation is one of {AGGREGATIONS}.")
    return Kpi(name, "formula", aggregation, formula=formula, level=level, **settings)


def rate_kpi(
    name: str,
    condition_column: str,
    included_values: Sequence[str],
    value_column: str | None = None,
    **settings,
) -> Kpi:
    """Share of records, or of a summed value, whose condition is in a value set."""
    values = tuple(dict.fromkeys(v.strip() for v in included_values))
    if any(not v for v in values):
        raise KpiError("Condition values may not be empty.")
    return Kpi(
        name,
        "conditional",
        "conditional_rate",
        condition_column=condition_column,
        included_values=values,
        base="value_sum" if value_column else "record_count",
        value_column=value_column,
        **{"display_format": "percentage", **settings},
    )


def operation_formula(operation: str, left: str, right: str, aggregation: str) -> tuple[str, str, str]:
    """Formula text, level and aggregation of a two-column operation."""
    if operation not in OPERATIONS:
        raise KpiError(f"The operation is one of {OPERATIONS}.")
    if left == right:
        raise KpiError("Choose two different columns.")
    if operation in RATIO_OPERATIONS and aggregation == "sum":
        raise KpiError("Ratios cannot be summed.")
    if aggregation == "ratio_of_sums" and operation not in RATIO_OPERATIONS:
        raise KpiError("Only ratios can be ratios of sums.")
    over_sums = aggregation == "ratio_of_sums"
    a, b = (f"[{c.replace(']', ']]')}]" for c in (left, right))
    if over_sums:
        a, b = f"SUM({a})", f"SUM({b})"
    texts = {
        "add": f"{a} + {b}",
        "subtract": f"{a} - {b}",
        "multiply": f"{a} * {b}",
        "ratio": f"{a} / {b}",
        "percentage_ratio": f"{a} / {b} * 100",
        "percentage_difference": f"(({a} - {b}) / {b}) * 100",
        "margin_percentage": f"(({a} - {b}) / {a}) * 100",
    }
    if over_sums:
        return texts[operation], "aggregate", "formula"
    return texts[operation], "row", aggregation


def operation_kpi(
    name: str, operation: str, left: str, right: str, aggregation: str = "mean", **settings
) -> Kpi:
    """KPI from one of the seven two-column operations."""
    text, level, final = operation_formula(operation, left, right, aggregation)
    display = settings.get("display_format", "number")
    if operation in PERCENTAGE_OPERATIONS and display != "percentage":
        raise KpiError("Percentage operations need the percentage format.")
    if operation == "ratio" and display == "percentage":
        raise KpiError("A plain ratio is not a percentage.")
    return formula_kpi(name, text, level, final, **settings)


@dataclass(frozen=True)
class Registry:
    """One to five KPIs with their date and category columns."""

    kpis: tuple[Kpi, ...]
    date_column: str | None = None
    category_columns: tuple[str, ...] = ()
    primary: str | None = None

    def __post_init__(self) -> None:
        if not 1 <= len(self.kpis) <= MAX_KPIS:
            raise KpiError(f"Configure 1 to {MAX_KPIS} KPIs.")
        names = [k.name.lower() for k in self.kpis]
        ids = [k.metric_id for k in self.kpis]
        if len(set(names)) != len(names) or len(set(ids)) != len(ids):
            raise KpiError("KPIs must be distinct.")
        for kpi in self.kpis:
            if kpi.target is None:
                continue
            if kpi.target_scope == "period" and self.date_column is None:
                raise KpiError("A period target needs a date column.")
            if kpi.target_scope == "segment" and not self.category_columns:
                raise KpiError("A segment target needs a category column.")
        if self.primary is not None and self.primary not in ids:
            raise KpiError("The primary KPI is not configured.")

    @property
    def primary_id(self) -> str:
        return self.primary or self.kpis[0].metric_id

    def kpi(self, metric_id: str) -> Kpi:
        for kpi in self.kpis:
            if kpi.metric_id == metric_id:
                return kpi
        raise KpiError(f"Unknown KPI {metric_id}.")

    def add(self, *kpis: Kpi) -> Registry:
        return replace(self, kpis=self.kpis + kpis)

    def remove(self, metric_id: str) -> Registry:
        self.kpi(metric_id)
        left = tuple(k for k in self.kpis if k.metric_id != metric_id)
        primary = None if self.primary == metric_id else self.primary
        return replace(self, kpis=left, primary=primary)

    def update(self, metric_id: str, **settings) -> Registry:
        old = self.kpi(metric_id)
        new = replace(old, **settings)
        primary = new.metric_id if self.primary == metric_id else self.primary
        return replace(
            self, kpis=tuple(new if k is old else k for k in self.kpis), primary=primary
        )

    def set_primary(self, metric_id: str) -> Registry:
        self.kpi(metric_id)
        return replace(self, primary=metric_id)


@dataclass(frozen=True)
class State:
    """One mergeable partial aggregate."""

    name: str
    kind: str
    expression: Column

    def first(self) -> Column:
        """Aggregate over rows."""
        fold = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[self.kind]
        return fold(self.expression).alias(self.name)

    def merge(self) -> Column:
        """Aggregate over already aggregated states."""
        fold = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}[self.kind]
        return fold(F.col(self.name)).alias(self.name)


class Measure:
    """A KPI compiled against one table.

    ``eligible_only`` follows the analysis battery: only rows with every input count.
    Charts pass ``False``: there each aggregate skips its own missing inputs.
    """

    def __init__(
        self, table: Table, kpi: Kpi, prefix: str = "k0", *, eligible_only: bool = True
    ) -> None:
        table.require(*kpi.source_columns)
        self.table = table
        self.kpi = kpi
        self.prefix = prefix
        self.eligible_only = eligible_only

    @cached_property
    def formula(self) -> Formula | None:
        if self.kpi.kind != "formula":
            return None
        numeric = {c for c in self.table.columns if not self.table.is_temporal(c)}
        return compile_formula(self.kpi.formula, self.kpi.level, numeric)

    @cached_property
    def matches(self) -> Column:
        """Whether the condition of a rate holds; never NULL."""
        condition = self.table.raw_text(self.kpi.condition_column)
        return condition.isin(*self.kpi.included_values)

    @cached_property
    def row_value(self) -> Column | None:
        """Per-row KPI value: number, formula result, or 100/0 for record rates."""
        kpi = self.kpi
        if kpi.kind == "source":
            return self.table.num(kpi.column)
        if kpi.kind == "formula":
            return self.formula.value(self.table.num) if kpi.level == "row" else None
        if kpi.base == "record_count":
            return F.when(self.matches, F.lit(100.0)).otherwise(F.lit(0.0))
        return None

    @cached_property
    def row_status(self) -> Column:
        if self.formula is None or self.kpi.level != "row":
            raise KpiError("Only row formulas have a row status.")
        return self.formula.status(self.table.num)

    @cached_property
    def eligible(self) -> Column:
        kpi = self.kpi
        if kpi.kind == "conditional":
            if kpi.base == "record_count":
                return F.lit(True)
            return self.table.num(kpi.value_column).isNotNull()
        if kpi.kind == "formula" and kpi.level == "aggregate":
            present = F.lit(True)
            for name in self.formula.columns:
                present = present & self.table.num(name).isNotNull()
            return present
        return self.row_value.isNotNull()

    def _calls(self) -> list[tuple[str, Column, str]]:
        """(function, row expression, slot) for every aggregate the KPI needs."""
        kpi = self.kpi
        if kpi.kind == "conditional":
            return []
        if kpi.kind == "formula" and kpi.level == "aggregate":
            out = []
            for i, (function, name) in enumerate(self.formula.calls):
                number = self.table.num(name)
                if self.eligible_only:
                    number = F.when(self.eligible, number)
                out.append((function, number, f"{self.prefix}_f{i}"))
            return out
        return [(kpi.aggregation.upper(), self.row_value, f"{self.prefix}_v")]

    @property
    def medians(self) -> list[tuple[str, Column]]:
        """(slot, row expression) of every median, which has no mergeable state."""
        return [(slot, expr) for fn, expr, slot in self._calls() if fn == "MEDIAN"]

    @cached_property
    def states(self) -> list[State]:
        p = self.prefix
        count = F.when(self.eligible, F.lit(1)) if self.eligible_only else F.lit(1)
        out = [State(f"{p}_n", "count", count)]
        if self.kpi.kind == "conditional":
            if self.kpi.base == "record_count":
                weight, valid = F.lit(1.0), F.lit(True)
            else:
                weight = self.table.num(self.kpi.value_column)
                valid = weight.isNotNull()
            out += [
                State(f"{p}_num", "sum", F.when(self.matches, weight).otherwise(F.lit(0.0))),
                State(f"{p}_den", "sum", weight),
                State(f"{p}_num_n", "count", F.when(self.matches & valid, F.lit(1))),
                State(f"{p}_den_n", "count", F.when(valid, F.lit(1))),
            ]
            return out
        for function, expression, slot in self._calls():
            if function in ("SUM", "MEAN"):
                out.append(State(f"{slot}_s", "sum", expression))
            if function in ("COUNT", "MEAN"):
                out.append(State(f"{slot}_c", "count", expression))
            if function == "MIN":
                out.append(State(f"{slot}_lo", "min", expression))
            if function == "MAX":
                out.append(State(f"{slot}_hi", "max", expression))
        return out

    def _final(self, function: str, slot: str) -> Column:
        match function:
            case "SUM":
                return F.col(f"{slot}_s")
            case "MEAN":
                return F.try_divide(F.col(f"{slot}_s"), F.col(f"{slot}_c"))
            case "COUNT":
                return F.coalesce(F.col(f"{slot}_c"), F.lit(0)).cast("double")
            case "MIN":
                return F.col(f"{slot}_lo")
            case "MAX":
                return F.col(f"{slot}_hi")
        return F.col(f"{slot}_med")

    @cached_property
    def value(self) -> Column:
        """Final KPI value over merged states; NULL where undefined."""
        if self.kpi.kind == "conditional":
            den = F.col(f"{self.prefix}_den")
            rate = F.try_divide(F.col(f"{self.prefix}_num"), den) * 100
            return clean(finite(F.when(~near_zero(den), rate)))
        if self.kpi.kind == "formula" and self.kpi.level == "aggregate":
            return self.formula.value(call=self._resolver())
        (function, _, slot), = self._calls()
        return clean(finite(self._final(function, slot)))

    @cached_property
    def value_status(self) -> Column:
        """Status of an aggregate formula over merged states."""
        return self.formula.status(call=self._resolver())

    def _resolver(self) -> Callable[[str, str], Column]:
        slots = {call: f"{self.prefix}_f{i}" for i, call in enumerate(self.formula.calls)}
        return lambda fn, name: clean(self._final(fn, slots[(fn, name)]))

    @property
    def detail(self) -> dict[str, Column]:
        """Numerator, denominator and their record counts for a conditional rate."""
        p = self.prefix
        if self.kpi.kind != "conditional":
            return {
                "numerator": F.lit(None).cast("double"),
                "denominator": F.lit(None).cast("double"),
                "numerator_record_count": F.lit(None).cast("long"),
                "denominator_record_count": F.lit(None).cast("long"),
            }
        return {
            "numerator": clean(F.col(f"{p}_num")),
            "denominator": clean(F.col(f"{p}_den")),
            "numerator_record_count": F.col(f"{p}_num_n"),
            "denominator_record_count": F.col(f"{p}_den_n"),
        }


def aggregate_measures(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[Measure],
    *,
    extra: Sequence[Column] = (),
    few_groups: bool | None = None,
) -> DataFrame:
    """One ``groupBy`` that carries the states of every measure, plus exact medians.

    The result keeps the keys, ``extra`` aggregates and one raw-state set per
    measure; read finished values through ``measure.value``.
    """
    states = [s.first() for m in measures for s in m.states]
    grouped = df.groupBy(*keys).agg(*extra, *states)
    for measure in measures:
        for slot, expression in measure.medians:
            middle = exact_quantiles(
                df, keys, expression, [0.5], few_groups=few_groups if keys else True
            ).select(
                *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                F.col("quantiles")[0].alias(f"{slot}_med"),
            )
            condition = F.lit(True)
            for i, k in enumerate(keys):
                condition = condition & F.col(k).eqNullSafe(F.col(f"_k{i}"))
            grouped = grouped.join(middle, condition, "left").drop(
                *[f"_k{i}" for i in range(len(keys))]
            )
    return grouped


def evaluate(table: Table, kpis: Sequence[Kpi], keys: Sequence[str] = ()) -> DataFrame:
    """KPI values per group with chart semantics, one column per KPI named by it."""
    measures = [
        Measure(table, k, f"k{i}", eligible_only=False) for i, k in enumerate(kpis)
    ]
    grouped = aggregate_measures(
        table.df, keys, measures, extra=[F.count("*").alias("record_count")]
    )
    return grouped.select(
        *keys, "record_count", *[m.value.alias(m.kpi.name) for m in measures]
    )


def preview(table: Table, kpi: Kpi) -> DataFrame:
    """Counts per status and the range of a formula KPI's results, as one row."""
    measure = Measure(table, kpi, eligible_only=False)
    if kpi.level == "aggregate":
        grouped = aggregate_measures(
            table.df, [], [measure], extra=[F.count("*").alias("total_records")]
        ).select("total_records", measure.value.alias("v"), measure.value_status.alias("s"))
        one = lambda s: (F.col("s") == s).cast("long")
        return grouped.select(
            "total_records",
            F.col("v").isNotNull().cast("long").alias("valid_result_count"),
            one("missing_input").alias("missing_input_count"),
            one("division_by_zero").alias("division_by_zero_count"),
            one("non_finite_result").alias("non_finite_result_count"),
            F.col("v").alias("minimum"),
            F.col("v").alias("maximum"),
            F.col("v").alias("mean"),
        )
    status = measure.row_status if kpi.kind == "formula" else F.when(
        measure.row_value.isNull(), "missing_input"
    ).otherwise("valid")
    rows = table.df.select(measure.row_value.alias("v"), status.alias("s"))
    return rows.agg(
        F.count("*").alias("total_records"),
        F.count_if(F.col("s") == "valid").alias("valid_result_count"),
        F.count_if(F.col("s") == "missing_input").alias("missing_input_count"),
        F.count_if(F.col("s") == "division_by_zero").alias("division_by_zero_count"),
        F.count_if(F.col("s") == "non_finite_result").alias("non_finite_result_count"),
        F.min("v").alias("minimum"),
        F.max("v").alias("maximum"),
        clean(F.avg("v")).alias("mean"),
    )


def ratio_of_sums(
    table: Table, left: str, right: str, keys: Sequence[str] = (), operation: str = "ratio"
) -> DataFrame:
    """Ratio of two sums per group; NULL when any input of the group is missing."""
    if operation not in RATIO_OPERATIONS:
        raise KpiError(f"The operation is one of {RATIO_OPERATIONS}.")
    a, b = table.num(left), table.num(right)
    grouped = table.df.groupBy(*keys).agg(
        F.sum(a).alias("l"),
        F.sum(b).alias("r"),
        F.count_if(a.isNull() | b.isNull()).alias("missing_inputs"),
        F.count("*").alias("record_count"),
    )
    l, r = F.col("l"), F.col("r")
    result = {
        "ratio": F.try_divide(l, r),
        "percentage_ratio": F.try_divide(l, r) * 100,
        "percentage_difference": F.try_divide(l - r, r) * 100,
        "margin_percentage": F.try_divide(l - r, l) * 100,
    }[operation]
    value = F.when(F.col("missing_inputs") == 0, clean(finite(result)))
    return grouped.select(*keys, "record_count", "missing_inputs", value.alias("value"))


def missing_condition_values(table: Table, kpi: Kpi) -> DataFrame:
    """Condition values of a rate that do not occur in the table (must be empty)."""
    wanted = table.df.sparkSession.createDataFrame(
        [(v,) for v in kpi.included_values], "value string"
    )
    present = table.df.select(table.raw_text(kpi.condition_column).alias("value"))
    present = present.where(F.col("value").isin(*kpi.included_values)).distinct()
    return wanted.join(F.broadcast(present), "value", "left_anti")


def metric_definitions(table: Table, registry: Registry) -> DataFrame:
    """One row per KPI: how it is computed, shown and compared."""
    rows = []
    for kpi in registry.kpis:
        rows.append(
            (
                kpi.metric_id,
                kpi.name,
                {"formula": "derived", "conditional": "conditional_rate"}.get(kpi.kind, "source"),
                kpi.formula_label,
                list(kpi.source_columns),
                kpi.aggregation,
                kpi.level or ("aggregate" if kpi.kind == "conditional" else "row"),
                kpi.display_format,
                kpi.direction,
                None if kpi.target is None else float(kpi.target),
                kpi.target_scope,
                kpi.metric_id == registry.primary_id,
            )
        )
    return table.df.sparkSession.createDataFrame(
        rows,
        "metric_id string, name string, metric_type string, formula string, "
        "source_columns array<string>, aggregation string, calculation_level string, "
        "display_format string, kpi_direction string, target double, target_scope string, "
        "is_primary boolean",
    )


__all__ = [
    "Kpi",
    "KpiError",
    "FormulaError",
    "Measure",
    "Registry",
    "State",
    "aggregate_measures",
    "evaluate",
    "formula_kpi",
    "metric_definitions",
    "missing_condition_values",
    "operation_formula",
    "operation_kpi",
    "preview",
    "ratio_of_sums",
    "rate_kpi",
    "source_kpi",
]
