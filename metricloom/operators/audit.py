"""Bulk checks of written text against computed facts.

Every rule is a column expression or an equi-join with a facts table; texts are never
cut and never leave the JVM.  Rules that need a text's own facts take an array of
allowed numbers or labels per text, whose size is bounded by the facts of one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.values import collapse_spaces

# Length limits and word patterns of the text rules.
MAX_COMMENTARY = 800
MAX_HEADLINE = 180
MAX_INTERPRETATION = 400
MAX_STORY_FACTS = 6
MAX_SUMMARY_FACTS = 3
SUMMARY_POINTS = 5
MAX_SUMMARY_STORIES = 2
SHORT_TEXT = 160
MAX_FACTS_PER_EVIDENCE = 8
CAUSAL_WORDS = (
    "cause", "caused", "causes", "causal", "because", "drive", "drives", "driven", "lead to",
    "leads to", "led to", "result in", "results in", "resulted in",
)
NUMBER_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen",
    "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety",
    "hundred", "thousand", "million", "billion", "trillion", "first", "second", "third",
    "fourth", "fifth",
)
UNIT_WORDS = (
    "percent(?:age)?", "records?", "rows?", "columns?", "days?", "weeks?", "months?", "years?",
    "dollars?", "euros?", "pounds?", "rupees?",
)
ACTION_WORDS = (
    "review", "investigate", "compare", "monitor", "prioritize", "validate", "assess",
    "examine", "track", "confirm", "focus", "check", "address", "test", "discuss", "escalate",
)
NUMERIC_SYMBOLS = "%$€£¥₹"
NUMBER_TOKEN = (
    r"(?U)(?<![\w])[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w])"
)
SECRET_ASSIGNMENT = (
    r"(?iuU)\b(password|passwd|token|api[_-]?key|secret)\b(\s*[:=]\s*)([^\s,;]+)"
)
BEARER = r"(?iuU)\bbearer\s+[a-z0-9._~+\-/]+=*"
BUSINESS_LEAVES = (
    "segment", "period", "region", "product", "category", "cohort", "series", "channel",
    "department", "territory", "market", "country", "state", "city", "branch",
)
# Path parts of numeric facts, most useful first.
FACT_PRIORITY = (
    "worst_performing_change.percentage_change",
    "worst_performing_change.absolute_change",
    "worst_performing_change.current_value",
    "best_performing_change.percentage_change",
    "best_performing_change.absolute_change",
    "percentage_change",
    "worst_segment.breach_percentage",
    "worst_segment.average_gap_to_target",
    "worst_segment.gap_to_target",
    "worst_segment.average_value",
    "worst_segment.value",
    "current_gap_to_target",
    "missed_period_count",
    "missed_segment_count",
    "target",
    "coefficient",
    "top_segment.share_percentage",
    "top_segment.value",
    "highest.value",
    "current_value",
    "gap_to_target",
    "baseline_value",
    "absolute_change",
    "breach_percentage",
    "breach_count",
    "anomaly_count",
    "outlier_count",
    "missing_percentage",
    "bottom_segment.value",
    "lowest.value",
    "previous_value",
    "lower_bound",
    "upper_bound",
    ".value",
    "record_count",
    ".count",
)


def _words(words) -> str:
    return r"(?U)\b(" + "|".join(words) + r")\b"


def is_causal(text: Column) -> Column:
    # Folding the text once is cheaper than a case-insensitive alternation.
    return F.lower(text).rlike(_words(CAUSAL_WORDS))


def has_action(text: Column) -> Column:
    return F.lower(text).rlike(_words(ACTION_WORDS))


def has_spelled_number(text: Column) -> Column:
    units = "|".join(UNIT_WORDS)
    return F.lower(text).rlike(r"(?U)\b(" + "|".join(NUMBER_WORDS) + r")\b\s+(?:" + units + r")\b")


def has_numeric_symbol(text: Column) -> Column:
    return text.rlike(f"[{NUMERIC_SYMBOLS}]")


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER_TOKEN), F.lit(0))


_NUMBER_PARTS = r"^([-+]?)([0-9]*)(?:\.([0-9]*))?(?:[eE]([-+]?[0-9]+))?$"


def exact_number(token: Column) -> Column:
    """The same text for number tokens of the same exact value, at any length and exponent.

    Significant digits without zeros at either end, and the exponent of the last one; NULL
    for what is no number.
    """
    plain = F.translate(token, ",", "")
    sign, whole, fraction, power = (F.regexp_extract(plain, _NUMBER_PARTS, i) for i in range(1, 5))
    digits = F.concat(whole, fraction)
    zero = F.lit("0")
    exponent = (
        F.when(power == "", F.lit("0")).otherwise(power).try_cast("decimal(38,0)")
        - F.length(fraction)
        + (F.length(digits) - F.length(F.rtrim(digits, zero)))
    )
    value = F.concat(
        F.when(sign == "-", "-").otherwise(""), F.trim(digits, zero), F.lit("e"), exponent.cast("string")
    )
    return (
        F.when(~plain.rlike(_NUMBER_PARTS) | (digits == ""), None)
        .when(F.trim(digits, zero) == "", zero)
        .otherwise(value)
    )


def without_labels(text: Column, labels: Column) -> Column:
    """Remove allowed labels from a text, longest first."""
    ordered = F.array_sort(
        labels, lambda a, b: F.length(b).cast("int") - F.length(a).cast("int")
    )
    return F.aggregate(ordered, text, lambda t, label: F.replace(t, label, F.lit("")))


def audit_commentary(
    texts: DataFrame,
    text: str = "text",
    numbers: str | None = None,
    labels: str | None = None,
    fact_labels: str | None = None,
    max_length: int = MAX_COMMENTARY,
) -> DataFrame:
    """One flag per rule for every text, and ``accepted`` when none is raised.

    ``numbers``, ``labels`` and ``fact_labels`` name array columns with the allowed
    number texts, the allowed context labels and the labels of the allowed facts.
    """
    empty = F.array().cast("array<string>")
    allowed = F.coalesce(F.col(numbers), empty) if numbers else empty
    context = F.coalesce(F.col(labels), empty) if labels else empty
    named = F.coalesce(F.col(fact_labels), empty) if fact_labels else empty
    staged = texts.withColumn("_t", collapse_spaces(F.coalesce(F.col(text), F.lit(""))))
    staged = staged.withColumn(
        "_c", without_labels(F.col("_t"), context) if labels else F.col("_t")
    )
    tokens = number_tokens(F.col("_c"))
    staged = staged.withColumn("_tokens", tokens)
    allowed_values = F.transform(allowed, exact_number)
    values = F.transform("_tokens", exact_number)
    unknown = F.exists(
        values, lambda v: v.isNull() | ~F.coalesce(F.array_contains(allowed_values, v), F.lit(False))
    )
    rest = F.regexp_replace("_c", NUMBER_TOKEN, "")
    percent = F.exists(named, lambda n: F.lower(n).contains("percent"))
    symbols = F.when(
        (F.size("_tokens") > 0) & percent, F.replace(F.col("_c"), F.lit("%"), F.lit(""))
    ).otherwise(F.col("_c"))
    checked = staged.select(
        *texts.columns,
        ((F.length("_t") == 0) | (F.length("_t") > max_length)).alias("bad_length"),
        F.size("_tokens").alias("number_count"),
        unknown.alias("unverified_number"),
        rest.rlike(r"(?U)\d").alias("leftover_digit"),
        has_numeric_symbol(symbols).alias("forbidden_symbol"),
        has_spelled_number(F.col("_c")).alias("spelled_number"),
        is_causal(F.col("_t")).alias("causal_language"),
    )
    flags = (
        "bad_length", "unverified_number", "leftover_digit", "forbidden_symbol",
        "spelled_number", "causal_language",
    )
    bad = F.lit(False)
    for name in flags:
        bad = bad | F.col(name)
    return checked.withColumn("accepted", ~bad)


def names_label(text: Column, labels: Column) -> Column:
    """Whether a text holds one of its labels as a whole word; true without labels."""
    quote = lambda s: F.concat(
        F.lit(r"(?U)(?<!\w)"), F.regexp_replace(s, r"([^\w\s])", r"\\$1"), F.lit(r"(?!\w)")
    )
    found = F.exists(labels, lambda label: F.regexp(text, quote(label)))
    return (F.size(F.coalesce(labels, F.array().cast("array<string>"))) == 0) | found


def normalized_words(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " ")


def mentions_metric(text: Column, metric: Column) -> Column:
    return normalized_words(text).contains(F.btrim(normalized_words(metric)))


def redact_numbers(text: Column) -> Column:
    """Replace numbers and number words, drop currency and percent signs."""
    out = F.regexp_replace(
        text, r"(?U)(?<![A-Za-z])[-+]?\d+(?:[.,]\d+)*%?(?![A-Za-z])", "the configured threshold"
    )
    out = F.regexp_replace(out, "(?iu)" + _words(NUMBER_WORDS), "the configured threshold")
    return F.regexp_replace(out, f"[{NUMERIC_SYMBOLS}]", "")


def redact_secrets(text: Column) -> Column:
    hidden = F.regexp_replace(text, SECRET_ASSIGNMENT, "$1$2[REDACTED]")
    return F.regexp_replace(hidden, BEARER, "Bearer [REDACTED]")


def shortened(text: Column, limit: int = SHORT_TEXT) -> Column:
    """Cut at a word boundary and add dots when longer than ``limit``."""
    flat = collapse_spaces(text)
    head = F.substring(flat, 1, limit - 3)
    whole = F.when(head.contains(" "), F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(head)
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.concat(F.rtrim(whole, F.lit(" ,;:-")), F.lit("..."))
    )


def interpretation_problems(text: Column) -> Column:
    """Rule broken by an interpretation text, or NULL."""
    flat = F.btrim(F.coalesce(text, F.lit("")))
    return (
        F.when(F.length(flat) == 0, "empty")
        .when(F.length(flat) > MAX_INTERPRETATION, "too_long")
        .when(flat.rlike(r"(?U)[\d%$€£₹]"), "number_or_symbol")
    )


def answered_once(answers: DataFrame, expected: DataFrame, group: str, fact: str) -> DataFrame:
    """Groups whose answers do not cover every expected fact exactly once."""
    given = answers.groupBy(group, fact).agg(F.count("*").alias("_n"))
    want = expected.select(F.col(group).alias("_g"), F.col(fact).alias("_f"))
    matched = given.join(want, (F.col(group) == F.col("_g")) & (F.col(fact) == F.col("_f")), "full")
    return (
        matched.groupBy(F.coalesce(group, "_g").alias(group))
        .agg(
            F.count_if(F.col(fact).isNull()).alias("missing"),
            F.count_if(F.col("_f").isNull()).alias("unknown"),
            F.count_if(F.col("_n") > 1).alias("repeated"),
        )
        .where(F.col("missing") + F.col("unknown") + F.col("repeated") > 0)
    )


# ------------------------------------------------------------------ facts


def flatten_numbers(
    df: DataFrame,
    key: str,
    json: str,
    max_depth: int | None = None,
    max_keys: int | None = None,
    max_items: int | None = None,
) -> DataFrame:
    """(key, path, label, number) of the numeric leaves of JSON text, level by level.

    Everything by default.  The limits keep the first keys and items of every object and
    array and the upper levels; :func:`omitted_leaves` counts what they leave out.
    """
    return _leaves(df, key, json, max_depth, max_keys, max_items, None, numeric=True)


def flatten_labels(
    df: DataFrame,
    key: str,
    json: str,
    max_depth: int | None = None,
    max_keys: int | None = None,
    max_items: int | None = None,
    max_length: int | None = None,
) -> DataFrame:
    """(key, path, label) of the text leaves of JSON text, or of those of ``max_length``."""
    return _leaves(df, key, json, max_depth, max_keys, max_items, max_length, numeric=False)


def omitted_leaves(whole: DataFrame, limited: DataFrame, key: str) -> DataFrame:
    """(key, omitted_count) of the keys whose limited leaves are not the whole ones."""
    left = whole.join(limited.select(key, "path"), [key, "path"], "left_anti")
    return left.groupBy(key).agg(F.count("*").alias("omitted_count"))


def json_depth(df: DataFrame, json: str) -> int:
    """Deepest nesting of brackets in a JSON column, outside its strings."""
    bare = F.regexp_replace(F.col(json), r'"(?:[^"\\]|\\.)*+"', "")
    steps = F.transform(
        F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "(?!$)"),
        lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0),
    )
    deepest = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, d: F.struct(
            (s["now"] + d).alias("now"), F.greatest(s["most"], s["now"] + d).alias("most")
        ),
    )["most"]
    return df.agg(F.max(deepest)).first()[0] or 0


def _leaves(
    df, key, json, max_depth, max_keys, max_items, max_length, *, numeric: bool
) -> DataFrame:
    if max_depth is None:
        max_depth = json_depth(df, json)
    level = df.select(
        F.col(key).alias("_key"), F.lit("facts").alias("path"), F.try_parse_json(json).alias("v")
    ).where(F.col("v").isNotNull())
    found = []
    for depth in range(max_depth + 1):
        kind = F.schema_of_variant("v")
        if numeric:
            leaf = kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$")
            value = F.try_variant_get("v", "$", "double").alias("number")
        else:
            leaf = kind == "STRING"
            value = collapse_spaces(F.try_variant_get("v", "$", "string")).alias("label")
        found.append(level.where(leaf).select("_key", "path", value))
        if depth == max_depth:
            break
        nested = level.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        nested = nested.select("_key", F.col("path").alias("_p"), "v")
        children = df.sparkSession.tvf.variant_explode(F.col("v").outer())
        level = nested.lateralJoin(children.toDF("_i", "_k", "_child")).select(
            "_key", "_p", "_i", "_k", F.col("_child").alias("v")
        )
        item = F.col("_k").isNull()
        inside = F.lit(True)
        if max_items is not None:
            inside = inside & (~item | (F.col("_i") < max_items))
        if max_keys is not None:
            inside = inside & (item | (F.col("_i") < max_keys))
        step = F.when(
            F.col("_k").isNull(), F.concat(F.lit("["), F.col("_i").cast("string"), F.lit("]"))
        ).otherwise(F.concat(F.lit("."), F.col("_k")))
        level = level.where(inside).select(
            "_key", F.concat("_p", step).alias("path"), "v"
        )
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    out = out.withColumnRenamed("_key", key)
    if numeric:
        return out.withColumn("label", fact_label(F.col("path")))
    usable = F.length("label") > 0
    if max_length is not None:
        usable = usable & (F.length("label") <= max_length)
    generated = F.col("label").rlike(r"^(EVD|STY)-[0-9A-F]{16}$")
    return out.where(usable & ~generated)


def fact_label(path: Column) -> Column:
    text = F.regexp_replace(path, r"^facts\.", "")
    text = F.regexp_replace(text, r"\[[0-9]+\]", " item")
    return collapse_spaces(F.translate(text, "._", "  "))


def is_business_path(path: Column) -> Column:
    leaf = F.lower(F.regexp_extract(path, r"([^.]*)$", 1))
    names = "|".join(BUSINESS_LEAVES)
    return ~leaf.isin("category_column", "period_granularity", "granularity") & leaf.rlike(
        f"^(.*_)?({names})$"
    )


def fact_priority(path: Column) -> Column:
    """Index of the first marker found in a path; the number of markers if none."""
    folded = F.lower(path)
    rank = F.lit(len(FACT_PRIORITY))
    for i in range(len(FACT_PRIORITY) - 1, -1, -1):
        rank = F.when(folded.contains(FACT_PRIORITY[i]), i).otherwise(rank)
    return rank


def top_facts(facts: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Numeric facts per evidence by priority, all or the first ``limit``, with reference ids."""
    order = Window.partitionBy(key).orderBy(fact_priority(F.col("path")), F.lower("path"))
    numbered = facts.withColumn("_n", F.row_number().over(order))
    if limit is not None:
        numbered = numbered.where(F.col("_n") <= limit)
    return numbered.select(
        key,
        F.concat(F.col(key).cast("string"), F.format_string("::FACT-%03d", "_n")).alias("reference"),
        F.col("_n").alias("position"),
        "path",
        "label",
        "number",
    )


def reference_problems(
    references: DataFrame, facts: DataFrame, group: str, maximum: int = MAX_STORY_FACTS
) -> DataFrame:
    """Groups with unknown, repeated or too many fact references.

    ``references`` holds one row per quoted reference.
    """
    known = facts.select("reference", F.lit(True).alias("_known")).distinct()
    counted = references.groupBy(group, "reference").agg(F.count("*").alias("_n"))
    return (
        counted.join(known, "reference", "left")
        .groupBy(group)
        .agg(
            F.sum("_n").alias("reference_count"),
            F.count_if(F.col("_known").isNull()).alias("unknown_count"),
            F.count_if(F.col("_n") > 1).alias("repeated_count"),
        )
        .where(
            (F.col("unknown_count") > 0)
            | (F.col("repeated_count") > 0)
            | (F.col("reference_count") > maximum)
        )
    )


def quotes_value(text: Column, values: Column) -> Column:
    """Whether a text quotes one of its selected values; true without values."""
    return (F.size(values) == 0) | F.exists(values, lambda v: text.contains(v))


def report_problems(points: DataFrame, report: str, text: str, stories: str | None = None) -> DataFrame:
    """Reports whose points are not five distinct texts with one or two stories each."""
    links = (
        F.count_if(~F.size(F.coalesce(F.col(stories), F.array())).between(1, MAX_SUMMARY_STORIES))
        if stories
        else F.lit(0)
    )
    return (
        points.groupBy(report)
        .agg(
            F.count("*").alias("point_count"),
            F.count_distinct(F.lower(collapse_spaces(F.col(text)))).alias("distinct_count"),
            links.alias("bad_links"),
        )
        .where(
            (F.col("point_count") != SUMMARY_POINTS)
            | (F.col("distinct_count") != F.col("point_count"))
            | (F.col("bad_links") > 0)
        )
    )
