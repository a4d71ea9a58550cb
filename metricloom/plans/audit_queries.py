"""Text-audit queries over whole documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions.values import collapse_spaces
from metricloom.operators import audit as A
from metricloom.plans.registry import load, query, shown

_FLAT = r"trim(regexp_replace({t}, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'))"
_EDGE = r"(^|[^\p{{L}}\p{{N}}_])({w})($|[^\p{{L}}\p{{N}}_])"


def _has(text: str, words) -> str:
    return f"regexp_matches({text}, '(?i){_EDGE.format(w='|'.join(words))}')"


_SPELLED = (
    r"(^|[^\p{{L}}\p{{N}}_])({w})\s+({u})($|[^\p{{L}}\p{{N}}_])".format(
        w="|".join(A.NUMBER_WORDS), u="|".join(A.UNIT_WORDS)
    )
)


@query(
    "audit_language",
    "N5 N6 N7 N9 N4",
    f"""WITH t AS (SELECT doc_id, {_FLAT.format(t='text')} AS t FROM documents)
    SELECT doc_id, length(t) = 0 OR length(t) > 800 AS bad_length, {_has('t', A.CAUSAL_WORDS)} AS causal_language,
    {_has('t', A.ACTION_WORDS)} AS action_language, regexp_matches(t, '(?i){_SPELLED}') AS spelled_number,
    regexp_matches(t, '[%$€£¥₹]') AS numeric_symbol FROM t""",
)
def audit_language(spark, folder):
    t = collapse_spaces(F.col("text"))
    return load(spark, folder, "documents").df.select(
        "doc_id",
        ((F.length(t) == 0) | (F.length(t) > A.MAX_COMMENTARY)).alias("bad_length"),
        A.is_causal(t).alias("causal_language"),
        A.has_action(t).alias("action_language"),
        A.has_spelled_number(t).alias("spelled_number"),
        A.has_numeric_symbol(t).alias("numeric_symbol"),
    )


@query("audit_commentary", "N3 N4 N5 N6 N9")
def audit_commentary(spark, folder):
    """All rules on every document; its own length is the only allowed number."""
    docs = load(spark, folder, "documents").df.select(
        "doc_id",
        "text",
        F.array(F.col("n_chars").cast("string")).alias("numbers"),
        F.array("source", "lang").alias("labels"),
    )
    return A.audit_commentary(docs, "text", "numbers", "labels").drop("text", "numbers", "labels")


@query(
    "audit_own_numbers",
    "N3",
    """SELECT o_orderkey, true AS accepted, 2::BIGINT AS number_count FROM orders
       WHERE o_orderstatus <> 'P'
       UNION ALL SELECT o_orderkey, false, 2 FROM orders WHERE o_orderstatus = 'P'""",
)
def audit_own_numbers(spark, folder):
    """Sentences built from facts: accepted with the right number, refused with a wrong one."""
    orders = load(spark, folder, "orders").df
    total = F.col("o_totalprice").cast("decimal(18,2)")
    told = F.when(F.col("o_orderstatus") == "P", total + F.lit(1).cast("decimal(18,2)")).otherwise(total)
    texts = orders.select(
        "o_orderkey",
        F.concat(
            F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" is worth "),
            F.format_number(told.cast("double"), 2), F.lit(" in the priority "),
            F.col("o_orderpriority"), F.lit("."),
        ).alias("text"),
        F.array(F.col("o_orderkey").cast("string"), total.cast("string")).alias("numbers"),
        F.array("o_orderpriority").alias("labels"),
    )
    out = A.audit_commentary(texts, "text", "numbers", "labels")
    return out.select("o_orderkey", "accepted", F.col("number_count").cast("long").alias("number_count"))


@query(
    "audit_exact_numbers",
    "N3",
    "SELECT o_orderkey, (o_orderkey + 1) % 4 IN (1, 2) AS accepted FROM orders",
)
def audit_exact_numbers(spark, folder):
    """Tiny, very long and differently written numbers: equal only if their exact values are."""
    orders = load(spark, folder, "orders").df
    key = (F.col("o_orderkey") + 1).cast("string")
    long = "000000000000000000000000000000"
    cases = [
        (F.concat(key, F.lit("e-13")), F.lit("0")),
        (F.concat(key, F.lit(f"{long}1")), F.concat(key, F.lit(f"{long}1"))),
        (F.concat(key, F.lit(".50")), F.concat(key, F.lit("5e-1"))),
        (F.concat(key, F.lit(f"{long}1")), F.concat(key, F.lit(f"{long}2"))),
    ]
    kind = F.pmod(F.col("o_orderkey") + 1, F.lit(4))
    told, fact = (
        F.coalesce(*[F.when(kind == i, case[part]) for i, case in enumerate(cases)]) for part in (0, 1)
    )
    texts = orders.select("o_orderkey", F.concat(F.lit("The rate is "), told, F.lit(".")).alias("text"), F.array(fact).alias("numbers"))
    return A.audit_commentary(texts, "text", "numbers").select("o_orderkey", "accepted")


@query(
    "audit_names_label",
    "N8",
    r"""SELECT conv_id, turn, regexp_matches(text, '(^|[^\p{L}\p{N}_])(the|les)($|[^\p{L}\p{N}_])') AS named
       FROM conversations""",
)
def audit_names_label(spark, folder):
    labels = F.array(F.lit("the"), F.lit("les"))
    return load(spark, folder, "conversations").df.select(
        "conv_id", "turn", A.names_label(F.col("text"), labels).alias("named")
    )


@query(
    "audit_mentions_metric",
    "N13",
    """SELECT doc_id, contains(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'),
       CASE WHEN lang = 'en' THEN 'the in' ELSE 'le un' END) AS mentioned FROM documents""",
)
def audit_mentions_metric(spark, folder):
    metric = F.when(F.col("lang") == "en", "The-In").otherwise("LE / un")
    return load(spark, folder, "documents").df.select(
        "doc_id", A.mentions_metric(F.col("text"), metric).alias("mentioned")
    )


@query(
    "secret_redaction",
    "N11",
    r"""WITH r AS (SELECT doc_id, text, regexp_replace(regexp_replace(text,
         '(?i)\b(password|passwd|token|api[_-]?key|secret)\b(\s*[:=]\s*)([^\s,;]+)', '\1\2[REDACTED]', 'g'),
         '(?i)\bbearer\s+[a-z0-9._~+\-/]+=*', 'Bearer [REDACTED]', 'g') AS t FROM documents)
       SELECT doc_id, t <> text AS changed, sha256(t) AS digest FROM r""",
)
def secret_redaction(spark, folder):
    t = A.redact_secrets(F.col("text"))
    return load(spark, folder, "documents").df.select(
        "doc_id", (t != F.col("text")).alias("changed"), F.sha2(t, 256).alias("digest")
    )


@query("number_redaction", "N10")
def number_redaction(spark, folder):
    t = A.redact_numbers(F.col("text"))
    return load(spark, folder, "documents").df.select(
        "doc_id", (t != F.col("text")).alias("changed"), F.length(t).alias("length"),
        F.sha2(t, 256).alias("digest"),
    )


@query(
    "short_texts",
    "N16 N9",
    f"""WITH t AS (SELECT doc_id, {_FLAT.format(t='text')} AS t FROM documents), h AS (SELECT *, substr(t, 1, 157) AS h FROM t)
    SELECT doc_id, CASE WHEN length(t) <= 160 THEN t ELSE rtrim(CASE WHEN contains(h, ' ')
      THEN regexp_extract(h, '^(.*) ', 1) ELSE h END, ' ,;:-') || '...' END AS short FROM h""",
)
def short_texts(spark, folder):
    return load(spark, folder, "documents").df.select(
        "doc_id", A.shortened(F.col("text")).alias("short")
    )


@query(
    "interpretation_rules",
    "N12",
    r"""SELECT conv_id, turn, CASE WHEN length(trim(text)) = 0 THEN 'empty' WHEN length(trim(text)) > 400 THEN 'too_long'
       WHEN regexp_matches(text, '[\p{Nd}%$€£₹]') THEN 'number_or_symbol' END AS problem FROM conversations""",
)
def interpretation_rules(spark, folder):
    return load(spark, folder, "conversations").df.select(
        "conv_id", "turn", A.interpretation_problems(F.col("text")).alias("problem")
    )


@query(
    "facts_answered_once",
    "N12",
    """WITH e AS (SELECT DISTINCT l_orderkey % 1000 AS g, l_linenumber AS f FROM lineitem),
    a AS (SELECT o_custkey % 1000 AS g, (o_orderkey % 7 + 1) AS f, count(*) AS n FROM orders GROUP BY ALL)
    SELECT coalesce(a.g, e.g) AS g, count(*) FILTER (WHERE a.f IS NULL) AS missing,
    count(*) FILTER (WHERE e.f IS NULL) AS unknown, count(*) FILTER (WHERE a.n > 1) AS repeated
    FROM a FULL JOIN e ON a.g = e.g AND a.f = e.f GROUP BY 1
    HAVING count(*) FILTER (WHERE a.f IS NULL OR e.f IS NULL OR a.n > 1) > 0""",
)
def facts_answered_once(spark, folder):
    expected = load(spark, folder, "lineitem").df.select(
        (F.col("l_orderkey") % 1000).alias("g"), F.col("l_linenumber").cast("long").alias("f")
    )
    answers = load(spark, folder, "orders").df.select(
        (F.col("o_custkey") % 1000).alias("g"), (F.col("o_orderkey") % 7 + 1).alias("f")
    )
    return A.answered_once(answers, expected.distinct(), "g", "f")


def _facts(spark, folder):
    orders = load(spark, folder, "orders").df
    return orders.select(
        "o_orderkey",
        F.to_json(
            F.struct(
                F.col("o_totalprice").alias("current_value"),
                F.struct(
                    F.col("o_orderpriority").alias("segment"), F.col("o_custkey").alias("value")
                ).alias("top_segment"),
                F.array(F.lit(1), F.lit(2)).alias("counts"),
                F.col("o_orderstatus").alias("note"),
            )
        ).alias("facts"),
    )


@query(
    "fact_numbers_flat",
    "N1",
    """SELECT o_orderkey, 'facts.current_value' AS path, 'current value' AS label, round(o_totalprice, 2) AS number FROM orders
    UNION ALL SELECT o_orderkey, 'facts.top_segment.value', 'top segment value', o_custkey FROM orders
    UNION ALL SELECT o_orderkey, 'facts.counts[0]', 'counts item', 1 FROM orders
    UNION ALL SELECT o_orderkey, 'facts.counts[1]', 'counts item', 2 FROM orders""",
)
def fact_numbers_flat(spark, folder):
    return shown(A.flatten_numbers(_facts(spark, folder), "o_orderkey", "facts"), 2)


@query(
    "fact_labels_flat",
    "N2",
    """SELECT o_orderkey, 'facts.top_segment.segment' AS path, o_orderpriority AS label, true AS business FROM orders
    UNION ALL SELECT o_orderkey, 'facts.note', o_orderstatus, false FROM orders""",
)
def fact_labels_flat(spark, folder):
    out = A.flatten_labels(_facts(spark, folder), "o_orderkey", "facts", max_length=120)
    return out.withColumn("business", A.is_business_path(F.col("path")))


@query(
    "event_props_facts",
    "N1",
    """SELECT event_id, 'facts.k' AS path, 'k' AS label, json_extract(props, '$.k')::DOUBLE AS number FROM events
       WHERE json_extract(props, '$.k') IS NOT NULL""",
)
def event_props_facts(spark, folder):
    return A.flatten_numbers(load(spark, folder, "events").df, "event_id", "props")


@query(
    "top_facts",
    "T12",
    """SELECT o_orderkey, o_orderkey || '::FACT-001' AS reference, 'facts.top_segment.value' AS path FROM orders
    UNION ALL SELECT o_orderkey, o_orderkey || '::FACT-002', 'facts.current_value' FROM orders
    UNION ALL SELECT o_orderkey, o_orderkey || '::FACT-003', 'facts.counts[0]' FROM orders
    UNION ALL SELECT o_orderkey, o_orderkey || '::FACT-004', 'facts.counts[1]' FROM orders""",
)
def top_facts(spark, folder):
    facts = A.flatten_numbers(_facts(spark, folder), "o_orderkey", "facts")
    return A.top_facts(facts, "o_orderkey", A.MAX_FACTS_PER_EVIDENCE).select("o_orderkey", "reference", "path")


@query(
    "fact_reference_problems",
    "N14",
    """WITH r AS (SELECT o_custkey AS g, o_orderpriority AS reference, count(*) AS n FROM orders GROUP BY ALL),
    k AS (SELECT DISTINCT o_orderpriority AS reference FROM orders WHERE o_orderpriority < '4')
    SELECT g, sum(n)::BIGINT AS reference_count, count(*) FILTER (WHERE k.reference IS NULL) AS unknown_count,
    count(*) FILTER (WHERE n > 1) AS repeated_count FROM r LEFT JOIN k USING (reference) GROUP BY g
    HAVING count(*) FILTER (WHERE k.reference IS NULL OR n > 1) > 0 OR sum(n) > 6""",
)
def fact_reference_problems(spark, folder):
    orders = load(spark, folder, "orders").df
    references = orders.select(F.col("o_custkey").alias("g"), F.col("o_orderpriority").alias("reference"))
    facts = references.where(F.col("reference") < "4").select("reference")
    return A.reference_problems(references, facts, "g")


@query(
    "quoted_values",
    "N14",
    """SELECT event_id, contains(props, round(value, 0)::BIGINT::VARCHAR) AS quoted FROM events""",
)
def quoted_values(spark, folder):
    whole = F.round("value", 0).cast("long").cast("string")
    return load(spark, folder, "events").df.select(
        "event_id", A.quotes_value(F.col("props"), F.array(whole)).alias("quoted")
    )


@query(
    "report_point_rules",
    "N15 X5",
    f"""SELECT conv_id, count(*) AS point_count, count(DISTINCT lower({_FLAT.format(t='text')})) AS distinct_count
       FROM conversations GROUP BY conv_id
       HAVING count(*) <> 5 OR count(DISTINCT lower({_FLAT.format(t='text')})) <> count(*)""",
)
def report_point_rules(spark, folder):
    points = load(spark, folder, "conversations").df
    return A.report_problems(points, "conv_id", "text").drop("bad_links")
