import csv
import hashlib
import io
import json
import random
import tracemalloc
import zipfile
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import one
from metricloom.functions.values import Table
from metricloom.operators import runlog as R
from metricloom.sources import records, sinks, tables, workbooks


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("﻿name,value\na,1\n\n\"x, y\",2\nshort\nlong,3,4\n".encode())
    loaded = tables.read_csv(spark, str(path))
    assert sorted(map(tuple, loaded.rows.collect())) == [("a", "1"), ("x, y", "2")]
    assert sorted(r["raw"] for r in loaded.rejects.collect()) == ["long,3,4", "short"]
    with pytest.raises(tables.SourceError):
        tables.read_table(spark, str(path))
    assert tables.read_table(spark, str(path), strict=False).df.count() == 2


def test_headers(spark, tmp_path):
    for bad in (["a", ""], ["a", "A "], ["ﬁ", "fi"], ["a\x07"], []):
        with pytest.raises(tables.SourceError):
            tables.check_headers(bad)
    assert tables.check_headers([" a ", "b"]) == ["a", "b"]
    path = tmp_path / "b.csv"
    path.write_text("a,a\n1,2\n")
    with pytest.raises(tables.SourceError):
        tables.read_csv(spark, str(path))


def test_json(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('[{"d": "2024-01-01", "v": 2.50}, {"v": null, "flag": true}]')
    rows = tables.read_json(spark, str(path)).rows.select("d", "v", "flag").collect()
    assert sorted(map(tuple, rows)) == [("", "", "true"), ("2024-01-01", "2.50", "")]
    lines = tmp_path / "a.ndjson"
    lines.write_text('{"v": 1}\n{"v": \n')
    loaded = tables.read_json(spark, str(lines), lines=True)
    assert loaded.rows.count() == 1 and loaded.rejects.count() == 1
    nested = tmp_path / "n.json"
    nested.write_text('[{"v": {"w": 1}}]')
    with pytest.raises(tables.SourceError):
        tables.read_json(spark, str(nested))


def test_limits(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("v\n1\n2\n3\n")
    with pytest.raises(tables.SourceError):
        tables.read_table(spark, str(path), max_rows=2)
    assert tables.read_table(spark, str(path), max_rows=3).df.count() == 3
    path.write_text("v\n")
    with pytest.raises(tables.SourceError):
        tables.read_table(spark, str(path))


MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, rows, hidden=False):
    state = ' state="hidden"' if hidden else ""
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {MAIN} {REL}><sheets><sheet name="Data" sheetId="1" r:id="r1"/>'
                      f'<sheet name="More" sheetId="2" r:id="r2"{state}/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels",
                      '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                      '<Relationship Id="r1" Target="worksheets/sheet1.xml"/>'
                      '<Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>date</t></si><si><r><t>rev</t></r><r><t>enue</t></r></si></sst>")
        book.writestr("xl/styles.xml", f'<styleSheet {MAIN}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
        book.writestr("xl/worksheets/sheet2.xml", f"<worksheet {MAIN}><sheetData/></worksheet>")


HEAD = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'


def test_workbooks(spark, tmp_path):
    body = (
        '<row r="2"><c r="A2" s="1"><v>45292</v></c><c r="B2"><v>12.5</v></c></row>'
        '<row r="3"><c r="B3"/></row>'
        '<row r="4"><c r="A4" t="inlineStr"><is><t>later</t></is></c><c r="B4" t="b"><v>1</v></c></row>'
    )
    workbook(tmp_path / "a.xlsx", HEAD + body, hidden=True)
    workbook(tmp_path / "b.xlsx", HEAD + '<row r="2"><c r="B2"><v>7</v></c></row>')
    found = {(r["path"][-6:], r["sheet"]) for r in workbooks.sheets(spark, str(tmp_path)).collect()}
    assert found == {("a.xlsx", "Data"), ("b.xlsx", "Data"), ("b.xlsx", "More")}
    rows = workbooks.read_sheet(spark, str(tmp_path), "Data").select("row_number", "date", "revenue").collect()
    assert sorted(map(tuple, rows)) == [(2, "", "7"), (2, "2024-01-01T00:00:00", "12.5"), (4, "later", "true")]
    workbook(tmp_path / "c.xlsx", HEAD + '<row r="2"><c r="A2"><f>1+1</f><v>2</v></c></row>')
    with pytest.raises(tables.SourceError):
        workbooks.read_sheet(spark, str(tmp_path / "c.xlsx"), "Data")


def test_catalog(spark, tmp_path):
    (tmp_path / "x").write_text(" [1]")
    (tmp_path / "y").write_text("a,b\n1,2\n")
    workbook(tmp_path / "z", HEAD)
    out = {r["path"][-1]: r for r in tables.catalog(spark, str(tmp_path)).collect()}
    (tmp_path / "p").write_bytes(b"PAR1....PAR1")
    (tmp_path / "q").write_bytes(b"PK\x03\x04 some other archive")
    (tmp_path / "r").write_bytes(b"\xff\xfe\x00binary")
    out = {r["path"][-1]: r for r in tables.catalog(spark, str(tmp_path)).collect()}
    assert [out[k]["format"] for k in "xyzpqr"] == ["json", "csv", "xlsx", "parquet", "unsupported", "unsupported"]
    assert out["x"]["source_id"] == "SRC-" + out["x"]["sha256"][:12].upper()


def test_catalog_of_large_files(spark, tmp_path):
    """Files longer than a range are hashed and sniffed range by range, none as a whole."""
    dice = random.Random(5)
    contents = {
        "text": ("é€😀\n" * 300).encode(), "cut": ("é€😀\n" * 300).encode() + b"\xe2\x82", "late": b" \r\n" * 500 + b"[1]",
        "mark": "\ufeff {".encode() + b"1" * 1500, "nul": b"a" * 2300 + b"\0", "odd": dice.randbytes(3001),
        "p.parquet": b"PAR1" + bytes(1096), "exact": b"a" * 3000, "over": b"a" * 1101, "names, {a}*[1]?%20": dice.randbytes(2100),
        "book": b"PK\x03\x04" + b"z" * 990 + b"xl/workbook.xml" + b"q" * 50, "zip": b"PK\x03\x04" + b"z" * 2000, "small": b"a,b\n",
    }
    (tmp_path / "below").mkdir()
    for i, (name, content) in enumerate(contents.items()):
        (tmp_path / ("below" if i % 2 else "") / name).write_bytes(content)
    whole = {r["path"].rsplit("/", 1)[1]: r for r in tables.catalog(spark, str(tmp_path)).collect()}
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)  # the reader of whole files refuses longer ones
    try:
        cut = {r["path"].rsplit("/", 1)[1]: r for r in tables.catalog(spark, str(tmp_path), 1000).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert cut == whole and set(cut) == set(contents)
    assert {n: r["sha256"] for n, r in cut.items()} == {n: hashlib.sha256(c).hexdigest() for n, c in contents.items()}
    formats = {"late": "json", "mark": "json", "p.parquet": "parquet", "book": "xlsx", "text": "csv", "exact": "csv", "over": "csv", "small": "csv"}
    assert {n: r["format"] for n, r in cut.items()} == {n: formats.get(n, "unsupported") for n in contents}


def test_ranges_get_smaller(spark, tmp_path):
    """The end of a file that is longer than a record of the reader; packed names are read whole."""
    content = random.Random(6).randbytes(9_700_001)
    (tmp_path / "a.bin").write_bytes(content)
    (tmp_path / "a.gz").write_bytes(content[: 5 << 20])
    got = {r["path"][-5:]: (r["sha256"], r["bytes"]) for r in tables.catalog(spark, str(tmp_path), 4 << 20).collect()}
    assert got == {n: (hashlib.sha256(c).hexdigest(), len(c)) for n, c in (("a.bin", content), ("/a.gz", content[: 5 << 20]))}


def test_digest_ignores_order(spark):
    df = spark.range(100).select("id", (F.col("id") * 2).alias("v"))
    a, b = tables.row_digest(df).first(), tables.row_digest(df.orderBy(F.desc("id"))).first()
    assert a == b and a != tables.row_digest(df.where("id > 0")).first()


def test_digest_sees_nulls_and_names(spark):
    a = spark.createDataFrame([(None, 1)], "a int, b int")
    b = spark.createDataFrame([(1, None)], "a int, b int")
    digest = lambda df: tables.row_digest(df).first()["row_digest"]
    assert len({digest(a), digest(b), digest(a.toDF("a", "c")), digest(a.selectExpr("a", "cast(b as long) b"))}) == 4


def test_json_columns_come_as_first_seen(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"zeta": 1, "alpha": 2}, {"mid": 3, "alpha": 4}]')
    (tmp_path / "b.ndjson").write_text('{"zeta": 1, "alpha": 2}\n{"mid": 3}\n')
    for name in ("a.json", "b.ndjson"):
        assert tables.read_table(spark, str(tmp_path / name)).columns == ["zeta", "alpha", "mid"]
    (tmp_path / "c.json").write_text("[1, 2]")
    with pytest.raises(tables.SourceError):
        tables.read_json(spark, str(tmp_path / "c.json"))


def test_unsafe_cells(spark):
    df = spark.createDataFrame([(1, "ok\t\n", "a\x07"), (2, "\x1b", "b")], "k int, a string, b string")
    out = tables.unsafe_cells(Table(df, "k")).collect()
    assert sorted(map(tuple, out)) == [(1, "b"), (2, "a")]


def test_sinks(spark, tmp_path):
    folder = str(tmp_path / "out")
    with pytest.raises(Exception):
        sinks.read_latest(spark, folder)
    sinks.write_versioned(spark.range(3), folder)
    sinks.write_versioned(spark.range(5), folder, "parquet")
    assert sinks.read_latest(spark, folder).count() == 5
    log = str(tmp_path / "log")
    schema = "name string, n int"
    row = spark.createDataFrame([("=1+1", 1)], schema)
    sinks.append_log(row, log, schema)
    sinks.append_log(row, log, schema)
    assert [tuple(r) for r in sinks.read_log(spark, log, schema).collect()] == [("'=1+1", 1)] * 2
    with pytest.raises(tables.SourceError):
        sinks.append_log(row.select("n", "name"), log, schema)


def test_run_log(spark):
    raw = spark.createDataFrame(
        [("w", 1, True, True, 1500.0004, 120, 30, 1.5e9, 2.5e6), ("w", 2, False, True, 10.0, -1, 5, 0.0, None),
         ("v", 1, False, False, 20.0, None, None, None, None)],
        "workflow_run_id string, attempt int, validated boolean, responded boolean, wall_time_ms double, "
        "prompt_tokens long, completion_tokens long, eval_duration_ns double, load_duration_ns double",
    )
    log = R.derive(raw)
    first = one(log.where("validated"))
    assert first["completion_tokens_per_second"] == 20.0 and first["total_tokens"] == 150
    assert first["ollama_load_duration_ms"] == 2.5 and first["wall_time_ms"] == 1500.0
    second = one(log.where("attempt = 2"))
    assert second["status"] == "validation_rejected" and second["total_tokens"] is None
    assert second["completion_tokens_per_second"] is None
    assert {r["workflow_run_id"]: r["retry_count"] for r in R.retries(log).collect()} == {"w": 1, "v": 0}
    assert len([f for f in R.SCHEMA.split(", ")]) == 28
    named = log.selectExpr("*", "'t' task_type", "'p' prompt_version", "'m' model")
    rates = one(R.validation_rates(named))
    assert rates["first_attempt_rate"] == 0.5 and rates["validated_count"] == 1
    assert one(R.medians(named))["median_wall_time_ms"] == 20.0


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_strict_csv_over_splits(spark, tmp_path, small_splits):
    """Cells with line breaks across many byte ranges, against the csv module."""
    rng = random.Random(6)
    rows = []
    for i in range(300):
        kind = rng.randrange(6)
        long = "\n".join(["x" * rng.randrange(9) for _ in range(rng.choice([2, 60]))])
        rows.append([str(i), ["plain", 'a "quoted" one', "1,2", long, "\r\nq\r", 'mid"dle'][kind], "é\n" * rng.randrange(3)])
    text = io.StringIO()
    csv.writer(text, lineterminator="\r\n").writerows([["key", "note", "more"], *rows])
    path = tmp_path / "split.csv"
    path.write_bytes(text.getvalue().encode("utf-8-sig"))
    loaded = tables.read_csv(spark, str(path))
    assert loaded.rows.rdd.getNumPartitions() > 20
    got = sorted(loaded.rows.collect(), key=lambda r: int(r["key"]))
    assert [list(r) for r in got] == rows and loaded.rejects.count() == 0


def test_strict_csv_rejects(spark, tmp_path, small_splits):
    filler = "".join(f'{i},"n\nm"\n' for i in range(100, 140))
    path = tmp_path / "bad.csv"
    path.write_bytes(b'k,v\n1,"a"b\n2,"x\ny"z\n3,ok"still\n' + filler.encode() + b"4,\xff\n5,1,2\n\n6,\"open\n7,8\n")
    loaded = tables.read_csv(spark, str(path))
    assert {r["k"] for r in loaded.rows.collect()} == {"3", *map(str, range(100, 140))}
    raws = {r["raw"] for r in loaded.rejects.collect()}
    assert {'1,"a"b', '2,"x\ny"z', "5,1,2"} <= raws and any(r.startswith('6,"open') for r in raws) and len(raws) == 5


def test_json_array_over_splits(spark, tmp_path, small_splits):
    rng = random.Random(7)
    items = [{"z": str(i), "a": rng.choice(["}", '{"', "\\", '\\"}', "é}{", "plain", "x" * 200]), "n": i} for i in range(200)]
    path = tmp_path / "split.json"
    path.write_text(json.dumps(items, indent=rng.choice([None, 1]), ensure_ascii=False))
    loaded = tables.read_json(spark, str(path))
    assert loaded.rows.columns == ["z", "a", "n"]
    got = sorted(loaded.rows.collect(), key=lambda r: int(r["z"]))
    assert [(r["z"], r["a"], int(r["n"])) for r in got] == [(x["z"], x["a"], x["n"]) for x in items]
    assert loaded.rejects.count() == 0


@pytest.mark.parametrize(
    "text, good, bad",
    [
        ('[{"a": 1}, {"a": 2, "a": 3}, {"b": "\x01"}]', 1, 2),
        ('[{"a": 1} {"a": 2}]', 1, 1),
        ('[{"a": 1}, {"a": 2}', 2, 1),
        ('[{"a": 1}], {"a": 2}', 1, 2),
        ('[{"a": 1}}]', 1, 1),
        ('{"a": 1}', 1, 0),
        ('[{"a": 1}, {"a": "open]', 1, 2),
    ],
)
def test_json_rejects(spark, tmp_path, text, good, bad):
    path = tmp_path / "bad.json"
    path.write_text(text)
    loaded = tables.read_json(spark, str(path))
    assert (loaded.rows.count(), loaded.rejects.count()) == (good, bad)


def test_json_ranges_are_cut_once(spark, tmp_path, small_splits, monkeypatch):
    cut, seen = records._cut, str(tmp_path / "seen")

    def noted(batches, kind, starts):
        for batch in batches:
            with open(seen, "a") as log:
                log.write(f"{batch.column('block')[0]}\n")
            yield from cut([batch], kind, starts)

    monkeypatch.setattr(records, "_cut", noted)
    path = tmp_path / "once.json"
    path.write_text(json.dumps([{"a": i, "b": "{}"} for i in range(40)]))
    loaded = tables.read_json(spark, str(path))
    assert loaded.rows.columns == ["a", "b"] and loaded.rows.count() == 40
    blocks = Path(seen).read_text().split()
    assert len(blocks) > 5 and len(blocks) == len(set(blocks))


def test_large_sheets_are_read_in_pieces(spark, tmp_path):
    n = 40_000
    rows = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c><c r="B{i}"><v>1.5</v></c></row>' for i in range(2, n + 2))
    workbook(tmp_path / "a.xlsx", HEAD + rows)
    workbook(tmp_path / "b.xlsx", HEAD + rows + "<row")
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.xlsx")).select("path", "content").orderBy("path")
    found = workbooks.cells_of(files).groupBy(F.col("path").substr(-6, 6).alias("path")).agg(
        F.count("*").alias("n"), F.count("problem").alias("bad"), F.max("row_number").alias("last")
    )
    # two sheets, the two names of the head and two numbers a row; nothing of a broken workbook
    assert sorted(map(tuple, found.collect())) == [("a.xlsx", 2 * n + 4, 0, n + 1), ("b.xlsx", 1, 1, 0)]
    whole = pa.RecordBatch.from_pandas(files.toPandas())
    tracemalloc.start()
    sizes = [len(batch) for batch in workbooks._read(iter([whole]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 2 * n + 5 and max(sizes) <= 10_000
    assert peak < 12_000_000, peak
