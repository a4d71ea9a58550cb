"""Profile, ingest-check and fingerprint queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions.frames import union_all
from metricloom.functions.values import Table
from metricloom.operators import kpi as K
from metricloom.operators import profile as P
from metricloom.plans.battery_queries import lineitem_registry
from metricloom.plans.registry import load, query, shown
from metricloom.sources import tables as S
from metricloom.sources.sinks import safe_text

_TYPES = {
    "lineitem": {
        "l_orderkey": "n", "l_partkey": "n", "l_suppkey": "n", "l_linenumber": "n",
        "l_quantity": "n", "l_extendedprice": "n", "l_discount": "n", "l_tax": "n",
        "l_returnflag": "c", "l_linestatus": "c", "l_shipdate": "d",
    },
}


def _numeric_sql(table: str, ordinal: int, c: str) -> str:
    return (
        f"SELECT {ordinal}::BIGINT AS ordinal, '{c}' AS \"column\", 'numeric' AS inferred_type, "
        f"count(*) AS row_count, count(*) - count({c}) AS missing_count, "
        f"count(DISTINCT {c}) AS unique_count, round(min({c}), 4)::DOUBLE AS minimum, "
        f"round(max({c}), 4)::DOUBLE AS maximum, round(avg({c}), 4) AS mean, "
        f"round(median({c}), 4)::DOUBLE AS median, round(sum({c}::DOUBLE), 2) AS total, "
        f"round(stddev_pop({c}), 4) AS standard_deviation, NULL::VARCHAR AS earliest, "
        f"NULL::VARCHAR AS latest FROM {table}"
    )


def _category_sql(table: str, ordinal: int, c: str, kind: str = "categorical") -> str:
    return (
        f"SELECT {ordinal}::BIGINT, '{c}', '{kind}', count(*), count(*) - count({c}), "
        f"count(DISTINCT {c}), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {table}"
    )


def _date_sql(table: str, ordinal: int, c: str) -> str:
    return (
        f"SELECT {ordinal}::BIGINT, '{c}', 'date/time', count(*), count(*) - count({c}), "
        f"count(DISTINCT {c}), NULL, NULL, NULL, NULL, NULL, NULL, "
        f"strftime(min({c}), '%Y-%m-%dT%H:%M:%S'), strftime(max({c}), '%Y-%m-%dT%H:%M:%S') FROM {table}"
    )


_MAKE = {"n": _numeric_sql, "c": _category_sql, "d": _date_sql}
_PROFILE_COLUMNS = (
    "ordinal", "column", "inferred_type", "row_count", "missing_count", "unique_count", "minimum",
    "maximum", "mean", "median", "total", "standard_deviation", "earliest", "latest",
)


@query(
    "profile_typed",
    "P1 P2 P3 P4 P5 P6 P7 A9 A10",
    " UNION ALL ".join(
        _MAKE[k]("lineitem", i, c) for i, (c, k) in enumerate(_TYPES["lineitem"].items())
    ),
)
def profile_typed(spark, folder):
    out = P.profile(load(spark, folder, "lineitem")).select(*_PROFILE_COLUMNS)
    return shown(out, 4, total=2)


@query(
    "profile_text",
    "P1 P2 P3 P5 P6 P7 M7 M9",
    " UNION ALL ".join(
        (
            _numeric_sql("orders", 0, "o_custkey"),
            _category_sql("orders", 1, "o_orderstatus"),
            _numeric_sql("orders", 2, "o_totalprice"),
            _date_sql("orders", 3, "o_orderdate"),
            _category_sql("orders", 4, "o_orderpriority"),
        )
    ),
)
def profile_text(spark, folder):
    """The same statistics when every cell is text and types must be inferred."""
    df = load(spark, folder, "orders").df
    names = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    text = df.select(
        *[
            F.date_format(n, "yyyy-MM-dd").alias(n) if n == "o_orderdate" else F.col(n).cast("string")
            for n in names
        ]
    )
    return shown(P.profile(Table(text)).select(*_PROFILE_COLUMNS), 4, total=2)


@query(
    "profile_documents",
    "P7 P8 P9 P10",
    r"""SELECT 'doc_id' AS "column", 'identifier' AS inferred_type, count(DISTINCT doc_id) AS unique_count FROM documents
    UNION ALL SELECT 'text', CASE WHEN max(length(trim(text))) >= 100 OR avg(length(trim(text))) >= 40 THEN 'free text'
        ELSE 'categorical' END, count(DISTINCT trim(text, E' \t\n\r\f\x0b')) FROM documents
    UNION ALL SELECT 'lang', 'categorical', count(DISTINCT lang) FROM documents
    UNION ALL SELECT 'source', 'categorical', count(DISTINCT source) FROM documents
    UNION ALL SELECT 'n_chars', 'numeric', count(DISTINCT n_chars) FROM documents""",
)
def profile_documents(spark, folder):
    out = P.profile(load(spark, folder, "documents"))
    return out.select("column", "inferred_type", "unique_count")


@query(
    "identifier_inference",
    "P8 P9",
    """SELECT 'c_name' AS "column", 'identifier' AS inferred_type, count(DISTINCT c_name) AS unique_count
       FROM (SELECT replace(c_name, '#', '-') AS c_name FROM customer)
    UNION ALL SELECT 'c_mktsegment', 'categorical', count(DISTINCT c_mktsegment) FROM customer
    UNION ALL SELECT 'cust_key', 'identifier', count(DISTINCT c_custkey) FROM customer""",
)
def identifier_inference(spark, folder):
    df = load(spark, folder, "customer").df.select(
        F.regexp_replace("c_name", "#", "-").alias("c_name"),
        "c_mktsegment",
        F.col("c_custkey").alias("cust_key"),
    )
    return P.profile(Table(df)).select("column", "inferred_type", "unique_count")


@query(
    "profile_candidates",
    "P4 P11",
    """SELECT * FROM (
       SELECT 'l_returnflag' AS "column", false AS is_kpi_candidate, false AS is_date_candidate,
         count(DISTINCT l_returnflag) BETWEEN 2 AND least(50, greatest(2, count(*) // 2)) AS is_category_candidate FROM lineitem
       UNION ALL SELECT 'l_shipdate', false, count(DISTINCT l_shipdate) > 1, false FROM lineitem
       UNION ALL SELECT 'l_tax', count(DISTINCT l_tax) > 1, false, false FROM lineitem
       UNION ALL SELECT 'fixed', false, false, false)""",
)
def profile_candidates(spark, folder):
    df = load(spark, folder, "lineitem").df
    df = df.select("l_returnflag", "l_shipdate", "l_tax", F.lit("same").alias("fixed"))
    return P.profile(Table(df)).select(
        "column", "is_kpi_candidate", "is_date_candidate", "is_category_candidate"
    )


@query("profile_approximate", "P3 P5")
def profile_approximate(spark, folder):
    """Distinct counts and medians from sketches, for very wide or large tables."""
    out = P.profile(load(spark, folder, "lineitem"), approximate=True)
    return out.select("column", "inferred_type", "row_count", "unique_count", "median")


@query(
    "semantic_types",
    "P12 M4",
    """SELECT 'o_orderkey' AS "column", CASE WHEN count(DISTINCT o_orderkey) <= least(20, greatest(2, count(*) // 5))
         THEN 'NUMERIC_DISCRETE' ELSE 'NUMERIC_CONTINUOUS' END AS semantic_type FROM orders
    UNION ALL SELECT 'orderPriority', 'CATEGORICAL_ORDINAL'
    UNION ALL SELECT 'o_orderstatus', 'CATEGORICAL_NOMINAL'
    UNION ALL SELECT 'ship_state', 'GEOGRAPHIC'
    UNION ALL SELECT 'o_orderdate', 'TEMPORAL'
    UNION ALL SELECT 'late', 'BOOLEAN_FLAG'
    UNION ALL SELECT 'month_number_value', CASE WHEN count(DISTINCT month(o_orderdate)) <= least(20, greatest(2, count(*) // 5))
         THEN 'NUMERIC_DISCRETE' ELSE 'NUMERIC_CONTINUOUS' END FROM orders""",
)
def semantic_types(spark, folder):
    df = load(spark, folder, "orders").df.select(
        "o_orderkey",
        F.col("o_orderpriority").alias("orderPriority"),
        "o_orderstatus",
        F.col("o_orderstatus").alias("ship_state"),
        "o_orderdate",
        F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("late"),
        F.month("o_orderdate").alias("month_number_value"),
    )
    return P.semantic_types(P.profile(Table(df))).select("column", "semantic_type")


@query(
    "value_catalog",
    "P13 W12",
    """WITH v AS (SELECT 'p_brand' AS "column", p_brand AS value FROM part
       UNION ALL SELECT 'p_type', p_type FROM part),
    c AS (SELECT "column", value, count(*) AS value_count FROM v GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY lower(value), value) AS position,
          count(*) OVER (PARTITION BY "column") AS distinct_count FROM c)
    SELECT "column", position, value, value_count, distinct_count, distinct_count > 20 AS truncated
    FROM r WHERE position <= 20""",
)
def value_catalog(spark, folder):
    out = P.value_catalog(load(spark, folder, "part"), ["p_brand", "p_type"], 20)
    return shown(out.drop("ordinal"))


@query(
    "data_dictionary",
    "P14 W12",
    """SELECT * FROM (
       SELECT 'N1' AS token, 'p_partkey' AS name, 'numeric' AS kind, count(DISTINCT p_partkey) AS unique_count FROM part
       UNION ALL SELECT 'N2', 'p_size', 'numeric', count(DISTINCT p_size) FROM part
       UNION ALL SELECT 'N3', 'p_retailprice', 'numeric', count(DISTINCT p_retailprice) FROM part
       UNION ALL SELECT 'C1', 'p_name', 'categorical', count(DISTINCT p_name) FROM part
       UNION ALL SELECT 'C2', 'p_brand', 'categorical', count(DISTINCT p_brand) FROM part
       UNION ALL SELECT 'C3', 'p_type', 'categorical', count(DISTINCT p_type) FROM part)""",
)
def data_dictionary(spark, folder):
    out = P.dictionary(P.profile(load(spark, folder, "part")))
    return out.select("token", "name", "kind", "unique_count")


@query("profile_summaries", "P15 M18")
def profile_summaries(spark, folder):
    frame = P.profile(load(spark, folder, "part"))
    whole = P.profile_summary(frame).select(F.lit("all").alias("kind"), "summary")
    visual = P.visual_summary(frame).select(
        F.lit("visual").alias("kind"),
        F.to_json(F.struct("column", "semantic_type", "unique_count", "missing_count")).alias("summary"),
    )
    return whole.unionByName(visual)


@query(
    "numeric_summary",
    "P15",
    """SELECT 'p_size' AS "column", count(DISTINCT p_size) AS unique_count, round(avg(p_size), 6) AS mean FROM part
       UNION ALL SELECT 'p_retailprice', count(DISTINCT p_retailprice), round(avg(p_retailprice), 6) FROM part
       UNION ALL SELECT 'p_partkey', count(DISTINCT p_partkey), round(avg(p_partkey), 6) FROM part""",
)
def numeric_summary(spark, folder):
    out = P.numeric_summary(P.profile(load(spark, folder, "part")), 40)
    return shown(out.select("column", "unique_count", "mean"), 6)


@query("measure_catalog", "P16")
def measure_catalog(spark, folder):
    table = load(spark, folder, "lineitem")
    return P.measure_catalog(P.profile(table), K.metric_definitions(table, lineitem_registry()), 50)


@query(
    "preview_rows",
    "S12",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5",
)
def preview_rows(spark, folder):
    rows = P.preview_rows(load(spark, folder, "orders", "o_orderkey"))
    return rows.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "unsafe_text_cells",
    "S8",
    """SELECT doc_id AS row_key, 'text' AS "column" FROM documents WHERE contains(text, 'zw')
       UNION ALL SELECT doc_id, 'source' FROM documents WHERE source = 'src1'""",
)
def unsafe_text_cells(spark, folder):
    """Documents with bell and escape characters put in where a rare pair stands."""
    table = load(spark, folder, "documents", "doc_id")
    df = table.df.withColumn("text", F.replace("text", F.lit("zw"), F.lit("\x07")))
    df = df.withColumn("source", F.when(F.col("source") == "src1", "\x1b[1m").otherwise(F.col("source")))
    return S.unsafe_cells(Table(df, "doc_id"))


@query(
    "row_digest",
    "S11",
    "SELECT count(*) AS row_count, true AS same_reordered, false AS same_changed, false AS same_renamed, false AS same_swapped FROM orders",
)
def row_digest(spark, folder):
    orders = load(spark, folder, "orders").df
    pair = orders.select("o_orderkey", "o_custkey", F.lit(None).cast("long").alias("gap"))
    swapped = pair.select("o_orderkey", F.col("gap").alias("o_custkey"), F.col("o_custkey").alias("gap"))
    changed = orders.withColumn("o_custkey", F.col("o_custkey") + (F.col("o_orderkey") == 1).cast("int"))
    frames = {
        "row_digest": orders, "reordered": orders.orderBy(F.desc("o_custkey")), "changed": changed,
        "renamed": orders.withColumnRenamed("o_custkey", "c"), "pair": pair, "swapped": swapped,
    }
    digests = {n: S.row_digest(f).select(F.struct("row_count", "row_digest")).scalar() for n, f in frames.items()}
    one = spark.range(1).select(*[d.alias(n) for n, d in digests.items()])
    whole = F.col("row_digest")
    return one.select(
        F.col("row_digest.row_count").alias("row_count"),
        (F.col("reordered") == whole).alias("same_reordered"),
        (F.col("changed") == whole).alias("same_changed"),
        (F.col("renamed") == whole).alias("same_renamed"),
        (F.col("swapped") == F.col("pair")).alias("same_swapped"),
    )


@query("row_digest_value", "S11")
def row_digest_value(spark, folder):
    out = S.row_digest(load(spark, folder, "orders").df)
    return out.select("row_count", F.col("row_digest").cast("string").alias("row_digest"))


@query(
    "file_formats",
    "S5 S6",
    """SELECT f || '.parquet' AS file, 'parquet' AS format FROM unnest(['benchmark', 'conversations', 'customer', 'documents',
    'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) AS t(f)""",
)
def file_formats(spark, folder):
    name = F.element_at(F.split("path", "/"), -1)
    return S.catalog(spark, f"{folder}/*.parquet").select(name.alias("file"), "format")


@query("file_catalog", "S6 S11")
def file_catalog(spark, folder):
    return S.catalog(spark, folder)


@query(
    "content_sniffing",
    "S6 S5",
    r"""SELECT CASE WHEN regexp_matches(props, '^\s*[\[{]') THEN 'json' ELSE 'csv' END AS format, count(*) AS n
       FROM events GROUP BY 1
       UNION ALL SELECT CASE WHEN regexp_matches(html, '^\s*[\[{]') THEN 'json' ELSE 'csv' END, count(*) FROM pages GROUP BY 1""",
)
def content_sniffing(spark, folder):
    events = load(spark, folder, "events").df.select(F.col("props").cast("binary").alias("c"))
    pages = load(spark, folder, "pages").df.select(F.col("html").cast("binary").alias("c"))
    parts = [
        df.groupBy(S.sniff(F.col("c")).alias("format")).agg(F.count("*").alias("n"))
        for df in (events, pages)
    ]
    return union_all(parts)


@query(
    "content_fingerprints",
    "S11 M17",
    """SELECT doc_id, sha256(text) AS sha256, 'SRC-' || upper(substr(sha256(text), 1, 12)) AS source_id,
       'SRC-' || upper(substr(sha256(sha256(text) || chr(0) || lang), 1, 12)) AS sheet_source_id FROM documents""",
)
def content_fingerprints(spark, folder):
    df = load(spark, folder, "documents").df
    digest = F.sha2("text", 256)
    return df.select(
        "doc_id",
        digest.alias("sha256"),
        S.source_id(digest).alias("source_id"),
        S.source_id(digest, F.col("lang")).alias("sheet_source_id"),
    )


@query(
    "spreadsheet_safe_export",
    "S15",
    """SELECT c_custkey, CASE WHEN regexp_matches(t, '^[=+@-]') THEN '''' || t ELSE t END AS t
       FROM (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '=' || c_name
             WHEN c_acctbal < 0 THEN printf('%.2f', c_acctbal) ELSE c_name END AS t FROM customer)""",
)
def spreadsheet_safe_export(spark, folder):
    df = load(spark, folder, "customer").df
    t = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("="), "c_name"))
        .when(F.col("c_acctbal") < 0, F.format_string("%.2f", "c_acctbal"))
        .otherwise(F.col("c_name"))
    )
    return safe_text(df.select("c_custkey", t.alias("t")))


@query(
    "header_and_nesting_checks",
    "S7 S9 S10",
    """SELECT 'embedding' AS nested_column, count(*) AS row_count FROM embeddings""",
)
def header_and_nesting_checks(spark, folder):
    table = load(spark, folder, "embeddings")
    S.check_headers(table.columns, max_columns=200)
    nested = S.nested_columns(table.df)
    return table.df.agg(F.count("*").alias("row_count")).select(
        F.explode(F.array(*[F.lit(n) for n in nested])).alias("nested_column"), "row_count"
    )


