"""Column helpers shared by every operator: missing markers, numbers, dates, labels.

All helpers return Catalyst expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cell texts that count as missing, and texts that count as boolean.
MISSING_MARKERS = ("", "na", "n/a", "null", "none", "nan")
BOOLEAN_VALUES = ("true", "false", "yes", "no", "y", "n")

WHITESPACE = " \t\n\r\f\u000b"
NUMBER_PATTERN = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
ISO_PATTERN = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:\d{2})?)?$"
)
SLASH_PATTERN = r"^\d{4}/\d{1,2}/\d{1,2}$"
LARGEST_DOUBLE = 1.7976931348623157e308
NEAR_ZERO = 1e-12

_NUMERIC = (T.NumericType,)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def quoted(name: str) -> Column:
    """Column by exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    """Trim every ASCII whitespace character, not only spaces."""
    return F.btrim(c, F.lit(WHITESPACE))


def collapse_spaces(c: Column) -> Column:
    """Single spaces instead of any run of (Unicode) white space."""
    return F.btrim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def is_missing_text(c: Column) -> Column:
    return c.isNull() | F.lower(strip(c)).isin(*MISSING_MARKERS)


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.abs(c) <= F.lit(LARGEST_DOUBLE), c)


def clean(c: Column) -> Column:
    """Round to ten decimals and drop the sign of zero."""
    return F.rint(c * F.lit(1e10)) / F.lit(1e10) + F.lit(0.0)


def near_zero(c: Column) -> Column:
    return F.abs(c) <= F.lit(NEAR_ZERO)


def parse_number(c: Column, *, thousands: bool = False) -> Column:
    """Text to double; anything that is not a plain finite number becomes NULL."""
    text = strip(c)
    if thousands:
        text = F.regexp_replace(text, ",", "")
    return finite(F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double")))


def parse_timestamp(c: Column) -> Column:
    """Text to timestamp for full ISO dates (optional time and offset) or y/m/d."""
    text = strip(c)
    iso = F.replace(text, F.lit("Z"), F.lit("+00:00"))
    return F.when(iso.rlike(ISO_PATTERN), iso.try_cast("timestamp")).when(
        text.rlike(SLASH_PATTERN), F.try_to_timestamp(text, F.lit("yyyy/M/d"))
    )


def percent_change(new: Column, old: Column) -> Column:
    """Change over the signed old value in percent; NULL when old is exactly zero."""
    return F.try_divide(new - old, old) * 100


def direction(change: Column) -> Column:
    return (
        F.when(change.isNull(), F.lit(None).cast("string"))
        .when(near_zero(change), "stable")
        .when(change > 0, "increasing")
        .otherwise("decreasing")
    )


def favorable(direction_label: Column, kpi_direction: Column) -> Column:
    return F.when(
        direction_label != "stable",
        (direction_label == "increasing") == (kpi_direction == "higher"),
    )


def count_confidence(n: Column) -> Column:
    return F.when(n >= 30, "high").when(n >= 10, "medium").otherwise("low")


def correlation_strength(r: Column) -> Column:
    return (
        F.when(F.abs(r) >= 0.7, "strong").when(F.abs(r) >= 0.4, "moderate").otherwise("weak")
    )


def period_label(moment: Column, granularity: str) -> Column:
    """Calendar label of a date or timestamp for one fixed granularity."""
    patterns = {"year": "yyyy", "quarter": "yyyy-'Q'q", "month": "yyyy-MM", "day": "yyyy-MM-dd"}
    return F.date_format(moment, patterns[granularity])


def period_label_by(moment: Column, granularity: Column) -> Column:
    """Calendar label where the granularity itself is a column."""
    return (
        F.when(granularity == "year", period_label(moment, "year"))
        .when(granularity == "quarter", period_label(moment, "quarter"))
        .when(granularity == "month", period_label(moment, "month"))
        .otherwise(period_label(moment, "day"))
    )


def granularity_for(months: Column) -> Column:
    return (
        F.when(months >= 24, "year")
        .when(months >= 6, "quarter")
        .when(months >= 2, "month")
        .otherwise("day")
    )


def bounded_score(c: Column) -> Column:
    """Clamp to [0, 1] with six decimals."""
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), 6)


def spreadsheet_safe(c: Column) -> Column:
    """Prefix an apostrophe where a spreadsheet would read a formula."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def human_number(c: Column) -> Column:
    """Short number text: B and M suffixes, commas from a thousand, else two decimals."""

    def fixed(x: Column, pattern: str) -> Column:
        # Unlike format_string, this rounds the exact binary value.
        return F.call_function("format_number", x, F.lit(pattern))

    size = F.abs(c)
    whole = c == F.floor(c)
    large = F.when(whole, fixed(c, "#,##0")).otherwise(fixed(c, "#,##0.00"))
    small = F.when(whole, fixed(c, "0")).otherwise(fixed(c, "0.00"))
    return (
        F.when(c.isNull(), "unavailable")
        .when(c == 0, "0")
        .when(size >= 1e9, F.concat(fixed(c / 1e9, "0.00"), F.lit("B")))
        .when(size >= 1e6, F.concat(fixed(c / 1e6, "0.00"), F.lit("M")))
        .when(size >= 1e3, large)
        .otherwise(small)
    )


def signed_number(c: Column) -> Column:
    text = human_number(F.abs(c))
    return (
        F.when(c.isNull(), "unavailable")
        .when(c > 0, F.concat(F.lit("+"), text))
        .when(c < 0, F.concat(F.lit("-"), text))
        .otherwise("0")
    )


def significant(c: Column, digits: int = 12) -> Column:
    """Keep ``digits`` significant digits; values within 1e-12 of zero become zero."""
    text = F.format_string(f"%.{digits - 1}e", c)
    return F.when(near_zero(c), F.lit(0.0)).otherwise(text.try_cast("double"))


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility form, which has no built-in function."""
    return texts.str.normalize("NFKC")


def label_text(c: Column, limit: int = 60) -> Column:
    """Label for display: no control characters, single spaces, dots after ``limit``."""
    flat = collapse_spaces(F.regexp_replace(nfkc(c), r"\p{C}", " "))
    flat = F.replace(flat, F.lit("$"), F.lit("\\$"))
    cut = F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))
    return F.when(F.length(flat) > limit, cut).otherwise(flat)


def name_tokens(name: str) -> list[str]:
    """Lower-case word tokens of a column name; camel case counts as a boundary."""
    import re

    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    return [t for t in re.split(r"[^a-z0-9]+", spaced.lower()) if t]


class Table:
    """A DataFrame plus the typed views of its columns that operators need.

    ``row_key`` names a unique ordering column; operators whose result depends on
    row order require it.  Text columns follow the missing-marker rules; typed
    columns only treat NULL (and non-finite doubles) as missing.
    """

    def __init__(self, df: DataFrame, row_key: str | None = None) -> None:
        self.df = df
        self.row_key = row_key
        self.types = {f.name: f.dataType for f in df.schema.fields}
        zone = df.sparkSession.conf.get("spark.sql.session.timeZone", "UTC")
        self._utc = zone in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")
        self._zone = zone

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def require(self, *names: str) -> None:
        absent = [n for n in names if n not in self.types]
        if absent:
            raise ValueError(f"Unknown columns: {absent}")

    def is_text(self, name: str) -> bool:
        return isinstance(self.types[name], T.StringType)

    def is_number(self, name: str) -> bool:
        return isinstance(self.types[name], _NUMERIC)

    def is_temporal(self, name: str) -> bool:
        return isinstance(self.types[name], _TEMPORAL)

    def num(self, name: str) -> Column:
        """Finite double or NULL."""
        self.require(name)
        if self.is_text(name):
            c = quoted(name)
            return F.when(~is_missing_text(c), parse_number(c))
        if self.is_number(name):
            kind = self.types[name]
            c = quoted(name).cast("double")
            return finite(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c
        return F.lit(None).cast("double")

    def text(self, name: str) -> Column:
        """Stripped text, or NULL where the cell is missing."""
        self.require(name)
        if self.is_text(name):
            c = quoted(name)
            return F.when(~is_missing_text(c), strip(c))
        kind = self.types[name]
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return finite(quoted(name)).cast("string")
        return quoted(name).cast("string")

    def raw_text(self, name: str) -> Column:
        """Stripped text where missing markers stay as they are and NULL is empty."""
        if self.is_text(name):
            return F.coalesce(strip(quoted(name)), F.lit(""))
        return F.coalesce(self.text(name), F.lit(""))

    def missing(self, name: str) -> Column:
        self.require(name)
        if self.is_text(name):
            return is_missing_text(quoted(name))
        kind = self.types[name]
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return finite(quoted(name)).isNull()
        return quoted(name).isNull()

    def moment(self, name: str) -> Column:
        """UTC wall-clock timestamp of a temporal or parseable text column."""
        self.require(name)
        kind = self.types[name]
        if isinstance(kind, (T.DateType, T.TimestampNTZType)):
            return quoted(name)
        if isinstance(kind, T.TimestampType):
            c = quoted(name)
            return c if self._utc else F.to_utc_timestamp(c, self._zone)
        if self.is_text(name):
            c = quoted(name)
            moment = F.when(~is_missing_text(c), parse_timestamp(c))
            return moment if self._utc else F.to_utc_timestamp(moment, self._zone)
        return F.lit(None).cast("timestamp")

    def day(self, name: str) -> Column:
        return F.to_date(self.moment(name))
