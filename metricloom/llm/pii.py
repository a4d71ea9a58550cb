"""Personal data: patterns, and terms that give them away, with built-in functions only.

The patterns find the protected entities (email, ip, card, phone).  The terms of a document that
holds an entity are judged by information theory: with shares p of the rows of the whole corpus, the
information of an entity is IC(e) = -log p(e), and a term t discloses
PMI(e; t) = log p(e, t) / (p(e) p(t)) of it, wherever in the document it stands.  A term that
shares at least ``SUPPORT`` different texts with an entity and discloses at least ``DISCLOSURE`` of
IC(e) becomes a span of kind ``term`` wherever it stands in any document.  Sanitising generalises an
entity to its kind and a term to its class (name, word), or removes both.

A term is a whole word of four letters or more.  All shares count rows; copies of a text support
a term only once.

Skew: counts of entities, terms and pairs combine before the shuffle, so a frequent entity or term is
one row a task.  Entities of too few texts leave before their documents are read for terms.  Entities
and disclosing terms are broadcast only up to ``BROADCAST_ROWS`` counted rows and joined by a sort-merge
join beyond, with the same result.

Results for unusual input: NULL and empty texts have no spans; rows with equal id and text
share one answer; NULL ids take part; a corpus in which no entity repeats has no terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import id_of, real_id, text_of, written
from metricloom.llm.spans import located, matches, no_spans, ordered, outside, replaced

SUPPORT = 3
DISCLOSURE = 0.9
#: Rows of the small side of a broadcast join.
BROADCAST_ROWS = 500_000
#: Possessive loops and starts at the edge of a run keep the matching linear; ``\G`` lets an
#: email start right after another.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TERM = r"(?<!\p{L})\p{L}{4,}+"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn checksum of a text of digits."""
    total = F.aggregate(
        F.transform(
            F.split(F.reverse(digits), "(?!$)"),
            lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
                F.element_at(F.array(*[F.lit(n) for n in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)
            ),
        ),
        F.lit(0), lambda a, b: a + b,
    )
    return total % 10 == 0


def _passing(kind: str, spans: Column) -> Column:
    if kind == "ip":
        # leading zeros do not matter; more than nine further digits cannot be 255 or less
        part = lambda p: F.ltrim(p, F.lit("0"))
        fits = lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255)
        return F.filter(spans, lambda x: F.forall(F.split(x["m"], r"\.", -1), fits))
    if kind == "card":
        fits = lambda x: F.when(
            F.length(_digits(x["m"])).between(13, 19), luhn(_digits(x["m"]))
        ).otherwise(F.lit(False))
        return F.filter(spans, fits)
    if kind == "phone":
        return F.filter(spans, lambda x: F.length(_digits(x["m"])).between(9, 15))
    return spans


def found_entities(docs: DataFrame) -> DataFrame:
    """id, mark (a hash of the text), the spans of every kind and ``entities``, hashes of their values."""
    rows = docs.select(id_of().alias("id"), text_of().alias("text"))
    text = F.col("text")
    for kind, pattern in PATTERNS.items():
        found = matches(text, pattern)
        if kind in ("email", "phone"):
            found = F.when(F.contains(text, F.lit("@" if kind == "email" else "+")), found).otherwise(F.array().cast("array<string>"))
        rows = rows.withColumn(f"found_{kind}", found)
    for kind, pattern in PATTERNS.items():
        rows = rows.withColumn(kind, _passing(kind, located(text, F.col(f"found_{kind}"), pattern)))

    def named(kind: str) -> Column:
        return F.transform(kind, lambda x: F.xxhash64(F.lit(kind), F.lower(x["m"])))

    entities = F.array_distinct(F.concat(*[named(kind) for kind in PATTERNS]))
    bare = [F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit("").alias("m"))).alias(k) for k in PATTERNS]
    slim = rows.select("id", F.xxhash64("text").alias("mark"), "text", *PATTERNS, entities.alias("entities"))
    return slim.select("id", "mark", "text", *bare, "entities")


def _small(df: DataFrame, limit: int, weight: Column | None = None) -> DataFrame:
    """``df`` to be broadcast if its rows (or their weights) are counted to be few, else sorted and merged."""
    weight = F.lit(1) if weight is None else weight
    few = (df.agg(F.sum(weight)).first()[0] or 0) <= limit
    return F.broadcast(df) if few else df.hint("merge")


def disclosing(
    docs: DataFrame, found: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE, limit: int = BROADCAST_ROWS
) -> DataFrame:
    """entity, term and share of every term that discloses its entity; ``share`` is PMI over IC."""
    held = found.select("mark", F.explode("entities").alias("entity"))
    entities = held.groupBy("entity", "mark").agg(F.count(F.lit(1)).alias("n")).groupBy("entity").agg(
        F.sum("n").alias("df_entity"), F.count(F.lit(1)).alias("texts")
    )
    entities = written(entities.where(F.col("texts") >= support).drop("texts"), "entities")
    # documents with such an entity, once for each, then their words: nothing but pairs meets in a shuffle
    known = found.where(F.size("entities") > 0).select("mark", "text", F.explode("entities").alias("entity"))
    known = known.join(_small(entities.select("entity"), limit), "entity")
    words = known.select("entity", "mark", F.explode(F.array_distinct(matches(F.lower("text"), _TERM))).alias("term"))
    pairs = words.groupBy("entity", "term", "mark").agg(F.count(F.lit(1)).alias("n")).groupBy("entity", "term").agg(
        F.sum("n").alias("both"), F.count(F.lit(1)).alias("texts")
    )
    pairs = pairs.where(F.col("texts") >= support)
    everywhere = docs.select(F.explode(F.array_distinct(matches(F.lower(text_of()), _TERM))).alias("term"))
    terms = everywhere.groupBy("term").agg(F.count(F.lit(1)).alias("df_term"))
    total = docs.count()
    # the exploded side looks small to the planner: never broadcast it unasked
    joined_up = pairs.hint("merge").join(terms.hint("merge"), "term").hint("merge").join(entities.hint("merge"), "entity")
    n = F.lit(float(max(total, 1)))
    pmi = F.log(n * F.col("both") / (F.col("df_entity") * F.col("df_term")))
    information = F.log(n / F.col("df_entity"))
    # an entity of every document has no information left to disclose: no share, no term
    return joined_up.select("entity", "term", F.try_divide(pmi, information).alias("share")).where(F.col("share") >= disclosure)


def _with_terms(docs: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """id, mark, base spans and ``terms``, the sorted spans of disclosing terms."""
    found = found_entities(docs)
    spans = written(found.drop("text", "entities"), "entity-spans")
    told = written(disclosing(docs, found, limit=limit).select("term").distinct(), "disclosing")
    texts = docs.select(id_of().alias("id"), text_of().alias("text")).withColumn("mark", F.xxhash64("text"))
    # places only in documents that hold such a term
    words = texts.select("id", "mark", F.explode(F.array_distinct(matches(F.lower("text"), _TERM))).alias("term"))
    holders = words.join(_small(told, limit), "term").groupBy("id", "mark").agg(F.collect_set("term").alias("held"))
    holders = written(holders, "holders")
    places = F.filter(located(F.col("text"), matches(F.col("text"), _TERM), _TERM), lambda x: F.array_contains("held", F.lower(x["m"])))
    bare = F.transform(places, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit("").alias("m")))
    terms = (
        texts.join(_small(holders, limit, F.size("held")), ["id", "mark"])
        .select("id", "mark", bare.alias("terms")).groupBy("id", "mark").agg(F.first("terms").alias("terms"))
    )
    rows = spans.hint("merge").join(terms.hint("merge"), ["id", "mark"], "left")
    # spans of terms never cut into base spans
    apart = F.when(F.col("terms").isNull(), no_spans()).otherwise(outside(F.col("terms"), F.concat(*PATTERNS)))
    return rows.select("id", "mark", *PATTERNS, apart.alias("terms"))


def _by_kind(*kinds: str) -> Column:
    """kind:start:end by kind as listed, then start."""

    def named(kind: str) -> Column:
        name = F.lit("term" if kind == "terms" else kind)
        return F.transform(
            F.array_sort(F.col(kind)), lambda x: F.concat_ws(":", name, x["s"].cast("string"), x["e"].cast("string"))
        )

    return F.array_join(F.concat(*[named(kind) for kind in kinds]), ",")


def pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of every document."""
    return _with_terms(docs).select(
        real_id("id"),
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in PATTERNS],
        F.sha2(_by_kind(*PATTERNS).cast("binary"), 256).alias("base_sha256"),
        _by_kind(*PATTERNS, "terms").alias("spans"),
    )


def sanitised(docs: DataFrame, remove: bool = False) -> DataFrame:
    """doc_id and the text with entities and disclosing terms generalised, or removed.

    A term is generalised to ``[name]`` if it starts with a capital, else to ``[word]``.
    """
    answers = _with_terms(docs)
    texts = docs.select(id_of().alias("id"), text_of().alias("text")).withColumn("mark", F.xxhash64("text"))
    both = texts.hint("merge").join(answers.dropDuplicates(["id", "mark"]).hint("merge"), ["id", "mark"])
    spans = F.sort_array(F.concat(*[ordered(F.col(k), i, k) for i, k in enumerate((*PATTERNS, "terms"))]))
    first = lambda x: F.substring(F.col("text"), x["s"] + 1, F.lit(1))
    general = lambda x: F.when(x["kind"] != "terms", x["kind"]).when(
        F.upper(first(x)) == first(x), "name"
    ).otherwise("word")
    marks = F.transform(
        spans,
        lambda x: F.struct(
            x["s"].alias("s"), x["e"].alias("e"),
            (F.lit("") if remove else F.concat(F.lit("["), general(x), F.lit("]"))).alias("label"),
        ),
    )
    return both.select(real_id("id"), replaced(F.col("text"), marks).alias("text"))
