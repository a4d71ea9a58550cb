"""Readers for CSV, JSON, NDJSON and Parquet, with checks that return frames.

Text formats are read as strings: types are inferred by the profile, not by the reader.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.frames import literal_frame, union_all
from metricloom.functions.values import Table, quoted
from metricloom.session import new_path
from metricloom.sources import files
from metricloom.sources.records import csv_rows, json_items

CORRUPT = "_corrupt_record"
UNSAFE_TEXT = r"[\p{Cc}&&[^\t\n\r]]"


class SourceError(ValueError):
    """A source breaks a rule."""


@dataclass(frozen=True)
class Loaded:
    """Accepted rows and the raw text of rejected ones."""

    rows: DataFrame
    rejects: DataFrame


def check_headers(names: list[str] | tuple[str, ...], max_columns: int | None = None) -> list[str]:
    """Trimmed column names; empty or (after normalization) equal names are errors."""
    clean = [n.strip() for n in names]
    if not clean or any(not n for n in clean):
        raise SourceError("A column name is empty.")
    if any(unicodedata.category(ch) == "Cc" and ch not in "\t\n\r" for n in clean for ch in n):
        raise SourceError("A column name holds a control character.")
    if max_columns is not None and len(clean) > max_columns:
        raise SourceError(f"The table has {len(clean)} columns; the maximum is {max_columns}.")
    folded = [unicodedata.normalize("NFKC", n).casefold() for n in clean]
    if len(set(folded)) != len(folded):
        raise SourceError("Two columns have the same name.")
    return clean


def _is_corrupt(name: str) -> Column:
    """Rows that did not parse.

    Spark refuses queries that read nothing but the corrupt-record column, so the test
    also reads one data column; its second half is always true.
    """
    return quoted(CORRUPT).isNotNull() & (F.length(F.coalesce(quoted(name), F.lit(""))) >= 0)


def read_csv(spark: SparkSession, path: str, *, max_columns: int | None = None) -> Loaded:
    """Strict CSV with a header; malformed rows and rows of the wrong width become rejects.

    Quoted cells may hold line breaks wherever the file is split.  Every file repeats the header.
    """
    # The header is read as plain cells: with header=true Spark renames repeated names.
    first = spark.read.options(header=False, multiLine=False, quote='"', escape='"').csv(path).limit(1).collect()
    if not first:
        raise SourceError("The file has no header.")
    names = check_headers([v or "" for v in first[0]], max_columns)
    rows = csv_rows(spark, path)
    heading = F.expr("block = 0 AND place = 0 AND line = 0")
    same = F.transform("cells", F.trim) == F.array(*map(F.lit, names))
    good = F.col("problem").isNull() & (F.size("cells") == len(names))
    body = rows.withColumn("good", F.coalesce(F.when(heading, F.when(same, F.lit(None)).otherwise(False)).otherwise(good), F.when(~heading, False)))
    cells = [F.element_at("cells", i + 1).alias(n) for i, n in enumerate(names)]
    return Loaded(body.where("good").select(*cells), body.where("NOT good").select("raw"))


def read_json(spark: SparkSession, path: str, *, lines: bool = False) -> Loaded:
    """Flat records as text: an array of objects in each file, or with ``lines`` one object a line.

    An array is cut at the borders of its objects, wherever the file is split; an object that
    names a key twice becomes a reject.
    """
    rejects = literal_frame(spark, [], "raw string")
    if lines:
        source = path
        lists = F.json_object_keys("value").alias("keys")
        keyed = spark.read.text(path).select(F.monotonically_increasing_id().alias("place"), lists)
        order = ["place"]
    else:
        items = json_items(spark, path)
        items = items.withColumn("keys", F.json_object_keys("text"))
        keys = F.col("keys")
        # control characters in strings have no keys either; elsewhere a line break is a blank
        bad = F.col("problem").isNotNull() | keys.isNull() | (F.size(keys) != F.size(F.array_distinct(keys)))
        keyed = items.where(~bad)
        rejects = items.where(bad).select(F.col("text").alias("raw"))
        source = new_path(spark, "json-items")
        keyed.select(F.translate("text", "\r\n", "  ")).write.text(source)
        order = ["file", "block", "place"]
    raw = (
        spark.read.option("primitivesAsString", True)
        .option("allowNonNumericNumbers", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(source)
    )
    nested = nested_columns(raw)
    if nested:
        raise SourceError(f"Nested values are not supported: {nested}")
    if raw.columns in ([CORRUPT], []):
        raise SourceError("No record of the source can be read as a flat JSON object.")
    names = check_headers(_first_seen(keyed, order, [c for c in raw.columns if c != CORRUPT]))
    good = raw
    if CORRUPT in raw.columns:
        bad = _is_corrupt(names[0])
        rejects = rejects.unionByName(raw.where(bad).select(quoted(CORRUPT).alias("raw")))
        good = raw.where(~bad)
    empty = F.lit("")
    return Loaded(good.select(*[F.coalesce(quoted(n), empty).alias(n) for n in names]), rejects)


def _first_seen(records: DataFrame, order: list[str], names: list[str]) -> list[str]:
    """``names`` in the order in which the records first use them; ``order`` ends with a number.

    The reader sorts them.  Records of one range with the same list of keys are counted by the
    first of them, so the keys of a range leave its task once.
    """
    *range_of, place = order
    lists = records.groupBy(*range_of, "keys").agg(F.min(place).alias(place))
    keys = lists.select(F.struct(*order).alias("record"), F.posexplode("keys").alias("item", "key"))
    first = keys.groupBy("key").agg(F.min(F.struct("record", "item")).alias("at"))
    seen = [r["key"] for r in first.where(F.col("key").isin(names)).orderBy("at").collect()]
    return seen + [n for n in names if n not in seen]


def nested_columns(df: DataFrame) -> list[str]:
    kinds = (T.StructType, T.ArrayType, T.MapType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def format_of(path: str) -> str:
    suffix = path.rsplit(".", 1)[-1].lower()
    known = {
        "csv": "csv", "json": "json", "ndjson": "ndjson", "jsonl": "ndjson",
        "parquet": "parquet", "xlsx": "xlsx",
    }
    if suffix not in known:
        raise SourceError(f"Unknown format of {path}.")
    return known[suffix]


def read_table(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    *,
    sheet: str | None = None,
    strict: bool = True,
    max_rows: int | None = None,
    max_columns: int | None = None,
    row_key: str | None = None,
) -> Table:
    """One table from any supported format; ``strict`` refuses rejected rows."""
    kind = format or format_of(path)
    if kind == "parquet":
        df = spark.read.parquet(path)
        check_headers(df.columns, max_columns)
    elif kind == "xlsx":
        from metricloom.sources.workbooks import read_sheet

        if sheet is None:
            raise SourceError("Name the sheet to read.")
        df = read_sheet(spark, path, sheet)
    else:
        loaded = (
            read_csv(spark, path, max_columns=max_columns)
            if kind == "csv"
            else read_json(spark, path, lines=kind == "ndjson")
        )
        df = loaded.rows
        check_headers(df.columns, max_columns)
        rejects = loaded.rejects if strict else None
    _check_rows(df, rejects if kind in ("csv", "json", "ndjson") else None, max_rows)
    return Table(df, row_key)


def _check_rows(df: DataFrame, rejects: DataFrame | None, max_rows: int | None) -> None:
    """Refuse sources with rejects, without rows or with too many, in one job."""
    counted = df.limit(1 if max_rows is None else max_rows + 1).agg(F.count("*").alias("n"))
    bad = F.lit(0)
    if rejects is not None:
        bad = rejects.limit(1).agg(F.count("*")).scalar()
    row = counted.select("n", bad.alias("bad")).first()
    if row["bad"]:
        raise SourceError("The source has malformed rows.")
    if not row["n"]:
        raise SourceError("The source has no rows.")
    if max_rows is not None and row["n"] > max_rows:
        raise SourceError(f"The source has more than {max_rows} rows.")


def unsafe_cells(table: Table) -> DataFrame:
    """Cells with control characters other than tab and line breaks."""
    texts = [c for c in table.columns if table.is_text(c)]
    key = F.col(table.row_key) if table.row_key else F.lit(None).cast("string")
    hits = F.array_compact(
        F.array(*[F.when(quoted(c).rlike(UNSAFE_TEXT), F.lit(c)) for c in texts])
    )
    return table.df.select(key.alias("row_key"), F.explode(hits).alias("column"))


def sniff(content: Column) -> Column:
    """Format of file content: Parquet, a workbook, JSON, CSV, or ``unsupported``.

    A zip container is a workbook only if it names the workbook part; other content that is
    not UTF-8 text is unsupported.
    """
    text = content.cast("string")
    start = F.substring(F.ltrim(text, F.lit("\ufeff \t\r\n\f\v")), 1, 1)
    plain = F.is_valid_utf8(text) & ~F.contains(text, F.lit("\0"))
    return _format(F.substring(content, 1, 4), F.contains(content, F.lit(b"xl/workbook.xml")), plain, start)


def _format(head: Column, workbook: Column, plain: Column, start: Column) -> Column:
    zipped = head == F.lit(b"PK\x03\x04")
    return (
        F.when(head == F.lit(b"PAR1"), "parquet")
        .when(zipped & workbook, "xlsx")
        .when(zipped | ~plain, "unsupported")
        .when(start.isin("[", "{"), "json")
        .otherwise("csv")
    )


def catalog(spark: SparkSession, path: str, step: int = files.RANGE) -> DataFrame:
    """(path, format, sha256, source_id, bytes) of every file below a path.

    Files of more than ``step`` bytes are read in ranges, by jobs of this call; only those that
    cannot be cut are read as a whole like the others.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    sizes = {r["path"]: r["length"] for r in found.where(F.col("length") > step).select("path", "length").collect()}
    parts = [_whole(found.where(F.col("length") <= step))]
    if uncut := [files.pattern(p) for p in sizes if not files.can_cut(p)]:
        parts.append(_whole(spark.read.format("binaryFile").load(uncut)))
    known = files.facts(spark, {p: n for p, n in sizes.items() if files.can_cut(p)}, step)
    if known:
        rows = [(p, s.head, s.workbook, s.plain, s.start, files.sha256_hex(s.digest), s.size) for p, s in known.items()]
        names = "path string, head binary, workbook boolean, plain boolean, start string, sha256 string, bytes long"
        large = literal_frame(spark, rows, names)
        kind = _format(F.col("head"), F.col("workbook"), F.col("plain"), F.col("start"))
        parts.append(large.select("path", kind.alias("format"), "sha256", source_id(F.col("sha256")).alias("source_id"), "bytes"))
    return union_all(parts)


def _whole(found: DataFrame) -> DataFrame:
    digest = F.sha2("content", 256)
    return found.select(
        "path",
        sniff(F.col("content")).alias("format"),
        digest.alias("sha256"),
        source_id(digest).alias("source_id"),
        F.col("length").alias("bytes"),
    )


def source_id(digest: Column, sheet: Column | None = None) -> Column:
    """``SRC-`` and twelve hex digits of the content hash, or of hash and sheet."""
    if sheet is not None:
        digest = F.sha2(F.concat(digest, F.lit("\0"), sheet), 256)
    return F.concat(F.lit("SRC-"), F.upper(F.substring(digest, 1, 12)))


def row_digest(df: DataFrame) -> DataFrame:
    """Order-independent fingerprint of a table of any size, as one row.

    Every column goes into a row's hash with a mark for NULL, which the hash would skip, and
    with the names and types of all columns before it.
    """
    schema = F.lit(df.schema.simpleString())
    cells = [part for c in df.columns for part in (quoted(c).isNull(), quoted(c))]
    h = F.xxhash64(schema, *cells).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("row_count"), F.sum(h).alias("row_digest"))
