"""KPI formulas compiled to Catalyst columns.

The grammar is a small subset of Python's own expression grammar, so the text is
handed to :mod:`ast` after column references are swapped for placeholder names.
Only a fixed set of node types is accepted; nothing is ever evaluated in Python.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricloom.functions.values import LARGEST_DOUBLE, clean, finite

# Size limits and function names of the formula language.
MAX_CHARACTERS = 1000
MAX_NODES = 100
MAX_DEPTH = 10
MAX_COLUMNS = 20
AGGREGATES = ("SUM", "MEAN", "MEDIAN", "MIN", "MAX", "COUNT")

_REFERENCE = re.compile(r"\[((?:[^\]]|\]\])*)\]")
_PLACEHOLDER = re.compile(r"__c(\d+)__")
_SYMBOL = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/"}


class FormulaError(ValueError):
    """The formula text is not valid."""


@dataclass(frozen=True)
class Formula:
    """A checked formula: its tree, referenced columns and aggregate calls."""

    text: str
    level: str
    columns: tuple[str, ...]
    calls: tuple[tuple[str, str], ...]
    tree: ast.expr
    names: tuple[str, ...]

    def _column_name(self, node: ast.expr) -> str:
        return self.names[int(_PLACEHOLDER.fullmatch(node.id).group(1))]

    def value(
        self,
        column: Callable[[str], Column] | None = None,
        call: Callable[[str, str], Column] | None = None,
    ) -> Column:
        """Double column; NULL where an input is missing or the result undefined."""
        return finite(self._value(self.tree, column, call))

    def error(
        self,
        column: Callable[[str], Column] | None = None,
        call: Callable[[str, str], Column] | None = None,
    ) -> Column:
        """First failure in evaluation order, or NULL where the value is valid."""
        return self._error(self.tree, column, call)

    def status(
        self,
        column: Callable[[str], Column] | None = None,
        call: Callable[[str, str], Column] | None = None,
    ) -> Column:
        return F.coalesce(self.error(column, call), F.lit("valid"))

    def _value(self, node, column, call) -> Column:
        match node:
            case ast.Constant():
                return F.lit(float(node.value))
            case ast.Name():
                return column(self._column_name(node))
            case ast.UnaryOp():
                inner = self._value(node.operand, column, call)
                return clean(-inner if isinstance(node.op, ast.USub) else inner)
            case ast.Call():
                name = node.func.id.upper()
                if name == "ABS":
                    return clean(F.abs(self._value(node.args[0], column, call)))
                return call(name, self._column_name(node.args[0]))
            case ast.BinOp():
                left = self._value(node.left, column, call)
                right = self._value(node.right, column, call)
                match _SYMBOL[type(node.op)]:
                    case "+":
                        return clean(left + right)
                    case "-":
                        return clean(left - right)
                    case "*":
                        return clean(left * right)
                return clean(F.try_divide(left, right))
        raise FormulaError("Unsupported formula part.")

    def _error(self, node, column, call) -> Column:
        here = self._value(node, column, call)
        overflow = F.when(
            ~(F.abs(here) <= F.lit(LARGEST_DOUBLE)), F.lit("non_finite_result")
        )
        match node:
            case ast.Constant():
                return F.lit(None).cast("string")
            case ast.Name():
                return F.when(here.isNull(), F.lit("missing_input"))
            case ast.UnaryOp():
                return self._error(node.operand, column, call)
            case ast.Call():
                if node.func.id.upper() == "ABS":
                    return self._error(node.args[0], column, call)
                return F.coalesce(F.when(here.isNull(), F.lit("missing_input")), overflow)
            case ast.BinOp():
                parts = [
                    self._error(node.left, column, call),
                    self._error(node.right, column, call),
                ]
                if isinstance(node.op, ast.Div):
                    divisor = self._value(node.right, column, call)
                    parts.append(F.when(divisor == 0, F.lit("division_by_zero")))
                return F.coalesce(*parts, overflow)
        raise FormulaError("Unsupported formula part.")

    @property
    def label(self) -> str:
        """Canonical text: normal spacing, only the needed parentheses."""

        def write(node: ast.expr, outer: int) -> str:
            match node:
                case ast.Constant():
                    number = float(node.value)
                    return str(int(number)) if number.is_integer() else str(number)
                case ast.Name():
                    return "[" + self._column_name(node).replace("]", "]]") + "]"
                case ast.Call():
                    return f"{node.func.id.upper()}({write(node.args[0], 0)})"
                case ast.UnaryOp():
                    sign = "-" if isinstance(node.op, ast.USub) else "+"
                    return sign + write(node.operand, 3)
            symbol = _SYMBOL[type(node.op)]
            rank = 1 if symbol in "+-" else 2
            right_rank = rank + 1 if symbol in "-/" else rank
            joined = f"{write(node.left, rank)} {symbol} {write(node.right, right_rank)}"
            return f"({joined})" if rank < outer else joined

        return write(self.tree, 0)


def compile_formula(
    text: str, level: str, numeric_columns: set[str] | frozenset[str]
) -> Formula:
    """Check a formula against its level and the numeric columns of the table."""
    source = text.strip()
    if not source or len(source) > MAX_CHARACTERS:
        raise FormulaError(f"A formula has 1 to {MAX_CHARACTERS} characters.")
    if level not in ("row", "aggregate"):
        raise FormulaError("The level is 'row' or 'aggregate'.")
    names: list[str] = []

    def keep(match: re.Match) -> str:
        name = match.group(1).replace("]]", "]")
        if name not in numeric_columns:
            raise FormulaError(f"[{name}] is not a numeric column.")
        names.append(name)
        return f" __c{len(names) - 1}__ "

    outside = _REFERENCE.sub(" ", source)
    if re.search(r"[^A-Za-z0-9_.+\-*/()\s]", outside) or "__" in outside or "**" in outside:
        raise FormulaError("The formula holds an unsupported character.")
    if "//" in outside or re.search(r"\b0\d|\d_|\d[jJ]\b|\b0[xXbBoO]", outside):
        raise FormulaError("The formula holds an unsupported operator or number.")
    flat = re.sub(r"\s+", " ", _REFERENCE.sub(keep, source)).strip()
    try:
        tree = ast.parse(flat, mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError) as problem:
        raise FormulaError("The formula cannot be read.") from problem

    calls: list[tuple[str, str]] = []
    columns: list[str] = []
    bare = 0
    nodes = 0

    def name_of(node: ast.Name) -> str:
        found = _PLACEHOLDER.fullmatch(node.id)
        if found is None:
            raise FormulaError(f"{node.id} is not supported.")
        return names[int(found.group(1))]

    def walk(node: ast.expr, depth: int) -> None:
        nonlocal bare, nodes
        nodes += 1
        if nodes > MAX_NODES:
            raise FormulaError("The formula has too many parts.")
        if depth > MAX_DEPTH:
            raise FormulaError("The formula is nested too deep.")
        match node:
            case ast.Constant():
                if isinstance(node.value, bool) or not isinstance(node.value, (int, float)):
                    raise FormulaError("Only numbers may be constants.")
                if abs(float(node.value)) > 1e100:
                    raise FormulaError("A constant is too large.")
            case ast.Name():
                name = name_of(node)
                bare += 1
                if name not in columns:
                    columns.append(name)
            case ast.UnaryOp(op=ast.USub() | ast.UAdd()):
                walk(node.operand, depth + 1)
            case ast.BinOp() if type(node.op) in _SYMBOL:
                walk(node.left, depth + 1)
                walk(node.right, depth + 1)
            case ast.Call(func=ast.Name()) if len(node.args) == 1 and not node.keywords:
                function = node.func.id.upper()
                if function == "ABS":
                    walk(node.args[0], depth + 1)
                elif function in AGGREGATES:
                    argument = node.args[0]
                    if not isinstance(argument, ast.Name):
                        raise FormulaError(f"{function} takes exactly one column.")
                    name = name_of(argument)
                    nodes += 1
                    if name not in columns:
                        columns.append(name)
                    if (function, name) not in calls:
                        calls.append((function, name))
                else:
                    raise FormulaError(f"{node.func.id} is not supported.")
            case _:
                raise FormulaError("The formula holds an unsupported part.")

    walk(tree, 1)
    if not 1 <= len(columns) <= MAX_COLUMNS:
        raise FormulaError(f"A formula names 1 to {MAX_COLUMNS} columns.")
    if level == "row" and calls:
        raise FormulaError("A row formula has no aggregate functions.")
    if level == "aggregate" and (bare or not calls):
        raise FormulaError("An aggregate formula puts every column inside a function.")
    return Formula(source, level, tuple(columns), tuple(calls), tree, tuple(names))
