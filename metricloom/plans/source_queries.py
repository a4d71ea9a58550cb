"""Round trips of given tables through the text formats and sinks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.functions import values as V
from metricloom.operators import kpi as K
from metricloom.plans.log_queries import _log
from metricloom.plans.registry import load, query, shown
from metricloom.session import new_path
from metricloom.sources import sinks, workbooks
from metricloom.sources import tables as S

_ORDER_SUMS = """SELECT o_orderpriority, count(*) AS record_count, round(sum(o_totalprice), 2) AS total,
    strftime(min(o_orderdate), '%Y-%m-%d') AS first_day FROM orders GROUP BY 1"""


def _order_text(spark, folder):
    return load(spark, folder, "orders").df.select(
        "o_orderkey", "o_orderpriority", "o_totalprice",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
    )


def _order_sums(table):
    return shown(
        table.df.groupBy("o_orderpriority").agg(
            F.count("*").alias("record_count"),
            F.sum(table.num("o_totalprice")).alias("total"),
            V.period_label(F.min(table.day("o_orderdate")), "day").alias("first_day"),
        ),
        2,
    )


@query("csv_round_trip", "S1 S5 S10", _ORDER_SUMS)
def csv_round_trip(spark, folder):
    path = new_path(spark, "orders-csv")
    _order_text(spark, folder).write.option("header", True).csv(path)
    return _order_sums(S.read_table(spark, path, "csv"))


@query(
    "csv_rejects",
    "S1",
    "SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS rejected, count(*) FILTER (WHERE o_orderstatus <> 'P') AS accepted FROM orders",
)
def csv_rejects(spark, folder):
    """Orders in status P get one cell too many and must come out as rejects."""
    path = new_path(spark, "broken-csv")
    orders = load(spark, folder, "orders").df
    extra = F.when(F.col("o_orderstatus") == "P", ",x").otherwise("")
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit(","), "o_orderstatus", extra)
    # Every part file carries its own header line.
    orders.select(line.alias("key,status")).write.option("header", True).option(
        "quote", ""
    ).option("sep", "\t").csv(path)
    loaded = S.read_csv(spark, path)
    accepted = loaded.rows.agg(F.count("*").alias("accepted"))
    return accepted.select(
        loaded.rejects.agg(F.count("*")).scalar().alias("rejected"), "accepted"
    )


@query(
    "csv_quoted_breaks",
    "S1",
    """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus <> 'P') AS accepted, count(*) FILTER (WHERE o_orderstatus = 'P') AS rejected,
    sum(length('key ' || o_orderkey || chr(10) || 'said "' || o_orderpriority || '", ok')) FILTER (WHERE o_orderstatus <> 'P')::BIGINT AS characters,
    min('key ' || o_orderkey || chr(10) || 'said "' || o_orderpriority || '", ok') FILTER (WHERE o_orderstatus <> 'P') AS first_note
    FROM orders GROUP BY 1""",
)
def csv_quoted_breaks(spark, folder):
    """Cells with line breaks, quotes and commas; orders in status P get text behind a closing quote."""
    path = new_path(spark, "noted-csv")
    orders = load(spark, folder, "orders").df
    note = F.concat(
        F.lit('"key '), F.col("o_orderkey").cast("string"), F.lit('\nsaid ""'), F.col("o_orderpriority"), F.lit('"", ok"'),
        F.when(F.col("o_orderstatus") == "P", "!").otherwise(""),
    )
    body = F.array_join(F.sort_array(F.collect_list(F.concat("o_orderpriority", F.lit(","), note))), "\n")
    # one text per file and day of month; its first line is the header
    day = F.dayofmonth("o_orderdate")
    files = orders.groupBy(day.alias("day")).agg(F.concat(F.lit("o_orderpriority,note\n"), body).alias("value"))
    files.repartition(31, "day").where("value IS NOT NULL").sortWithinPartitions("day").select("day", "value").write.partitionBy(
        "day"
    ).text(path)
    rows = S.csv_rows(spark, path)
    body_rows = rows.where("NOT (block = 0 AND place = 0)")
    good = F.col("problem").isNull() & (F.size("cells") == 2)
    priority = F.when(good, F.col("cells")[0]).otherwise(F.substring_index("raw", ",", 1))
    told = F.when(good, F.col("cells")[1])
    # a malformed row ends with its line, so the first line of such a note is a reject of its own
    return body_rows.where(good | F.contains("raw", F.lit("!"))).groupBy(
        F.when(good, priority).otherwise(F.regexp_extract("raw", '""([^"]*)""', 1)).alias("o_orderpriority")
    ).agg(
        F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected"),
        F.sum(F.length(told)).alias("characters"), F.min(told).alias("first_note"),
    )


@query("json_array_items", "S2 S9", _ORDER_SUMS)
def json_array_items(spark, folder):
    """One top-level array with braces in its strings, cut at the borders of its objects."""
    path = new_path(spark, "orders-array")
    orders = _order_text(spark, folder).withColumn("note", F.lit('{not "the" end}'))
    record = F.to_json(F.struct(*orders.columns))
    # a file for each priority, written record by record
    place = W.partitionBy("o_orderpriority").orderBy("o_orderkey")
    lead = F.when(F.row_number().over(place) == 1, "[\n").otherwise(" ")
    tail = F.when(F.lead(F.lit(True)).over(place), ",").otherwise("\n]")
    lines = orders.select("o_orderpriority", "o_orderkey", record.alias("record"))
    lines.select("o_orderpriority", F.concat(lead, "record", tail).alias("value")).write.partitionBy("o_orderpriority").text(path)
    loaded = S.read_json(spark, path)
    rows = loaded.rows.where("note = '{not \"the\" end}'")
    return _order_sums(V.Table(rows))


@query("json_round_trip", "S2 S5 S9", _ORDER_SUMS)
def json_round_trip(spark, folder):
    path = new_path(spark, "orders-json")
    _order_text(spark, folder).write.json(path)
    return _order_sums(S.read_table(spark, path, "ndjson"))


_BOOK = """<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"
 xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Orders" sheetId="1" r:id="r1"/>
 <sheet name="Notes" sheetId="2" r:id="r2" state="hidden"/></sheets></workbook>"""
_LINKS = """<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">
 <Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>"""
_STYLES = """<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cellXfs><xf numFmtId="0"/>
 <xf numFmtId="14"/></cellXfs></styleSheet>"""
_SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def _as_workbook(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A workbook of one month's orders: key, total, and the day as a styled serial number."""
    text = '<c r="{}{}" t="inlineStr"><is><t>{}</t></is></c>'
    head, tail = _SHEET.split("{}")
    out = io.BytesIO()
    path, last = None, 1
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, body in (
            ("xl/workbook.xml", _BOOK), ("xl/_rels/workbook.xml.rels", _LINKS), ("xl/styles.xml", _STYLES),
            ("xl/worksheets/sheet2.xml", _SHEET.format("")),
        ):
            book.writestr(name, body)
        with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
            names = "".join(text.format(c, 1, n) for c, n in zip("ABC", ("key", "total", "day")))
            sheet.write(f'{head}<row r="1">{names}</row>'.encode())
            for rows in parts:
                path = rows["path"].iloc[0]
                lines = [
                    f'<row r="{i}">{text.format("A", i, key)}<c r="B{i}"><v>{total!r}</v></c><c r="C{i}" s="1"><v>{day}</v></c></row>'
                    for i, (key, total, day) in enumerate(zip(rows["key"], rows["o_totalprice"], rows["day"]), last + 1)
                ]
                sheet.write("".join(lines).encode())
                last += len(lines)
            sheet.write(tail.encode())
    yield pd.DataFrame({"path": [path], "content": [out.getvalue()]})


def _workbook_cells(spark, folder):
    """Cells of one workbook for every priority and month, written by the executors."""
    orders = load(spark, folder, "orders").df.select(
        F.coalesce(F.col("o_orderkey").cast("string"), F.lit("nan")).alias("key"), "o_totalprice", F.date_diff("o_orderdate", F.lit("1899-12-30")).alias("day"),
        F.concat("o_orderpriority", F.lit("/"), F.date_format("o_orderdate", "yyyy-MM"), F.lit(".xlsx")).alias("path"),
    )
    files = orders.groupBy("path").applyInPandas(_as_workbook, "path string, content binary")
    # read several times: sheet names, header and rows
    place = new_path(spark, "workbooks")
    files.write.parquet(place)
    return workbooks.cells_of(spark.read.parquet(place))


@query(
    "workbook_cells",
    "S3",
    """SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day,
    count(DISTINCT o_orderkey) AS order_keys FROM orders GROUP BY 1""",
)
def workbook_cells(spark, folder):
    cells = _workbook_cells(spark, folder).where("sheet = 'Orders' AND row_number > 1 AND problem IS NULL")
    cell = lambda i: F.max(F.when(F.col("column") == i, F.col("value")))
    rows = cells.groupBy("path", "row_number").agg(cell(1).alias("key"), cell(2).alias("total"), cell(3).alias("day"))
    out = rows.groupBy(F.substring_index("path", "/", 1).alias("o_orderpriority")).agg(
        F.count("*").alias("orders"), F.sum(F.col("total").cast("double")).alias("total"),
        F.substring(F.min("day"), 1, 10).alias("first_day"), F.count_distinct("key").alias("order_keys"),
    )
    return shown(out, 2)


@query(
    "workbook_sheets",
    "S4",
    """SELECT o_orderpriority, 'Orders' AS sheet, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS workbooks FROM orders GROUP BY 1""",
)
def workbook_sheets(spark, folder):
    """Visible sheets; every workbook also hides one."""
    found = workbooks.sheets_of(_workbook_cells(spark, folder))
    return found.groupBy(F.substring_index("path", "/", 1).alias("o_orderpriority"), "sheet").agg(F.count("*").alias("workbooks"))


@query(
    "versioned_output",
    "S13",
    "SELECT 'l_extendedprice' AS metric, round(sum(l_extendedprice), 2) AS current_value FROM lineitem",
)
def versioned_output(spark, folder):
    """Two versions are written; readers get the second."""
    path = new_path(spark, "snapshot")
    table = load(spark, folder, "lineitem")
    for column in ("l_quantity", "l_extendedprice"):
        value = K.evaluate(table, [K.source_kpi(column)])
        sinks.write_versioned(
            value.select(F.lit(column).alias("metric"), F.col(column).alias("current_value")), path
        )
    return shown(sinks.read_latest(spark, path), 2)


@query(
    "appended_log",
    "S14 S15",
    """SELECT event_type AS task_type, 2 * count(*) AS run_count, max(CASE WHEN event_type = 'error' THEN '''=' ELSE '' END || event_type)
       AS note FROM events GROUP BY 1""",
)
def appended_log(spark, folder):
    path = new_path(spark, "log")
    schema = "event_id long, task_type string, status string, note string"
    note = F.concat(F.when(F.col("task_type") == "error", "=").otherwise(""), "task_type")
    rows = _log(spark, folder).select("event_id", "task_type", "status", note.alias("note"))
    sinks.append_log(rows, path, schema)
    sinks.append_log(rows, path, schema)
    log = sinks.read_log(spark, path, schema)
    return log.groupBy("task_type").agg(F.count("*").alias("run_count"), F.max("note").alias("note"))


@query(
    "significant_digits",
    "M13",
    "SELECT o_orderkey, printf('%.11e', o_totalprice / 3)::DOUBLE AS value FROM orders",
)
def significant_digits(spark, folder):
    return load(spark, folder, "orders").df.select(
        "o_orderkey", V.significant(F.col("o_totalprice") / 3).alias("value")
    )


@query("chart_labels", "M5 M3")
def chart_labels(spark, folder):
    return load(spark, folder, "documents").df.select(
        "doc_id", V.label_text(F.col("text")).alias("label")
    )
