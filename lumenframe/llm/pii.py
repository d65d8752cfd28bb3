"""Personal data: base spans by pattern, and terms that give protected entities away.

Base spans are emails, IP addresses, cards and phones.  Removing them is not enough where other terms point
at them: a term is information about an entity when both occur together more than chance allows.  For
entity e and term t anywhere in its texts, over all different texts,

    PMI(t; e) = log(p(t, e) / (p(t) p(e)))        IC(e) = -log p(e)

and the disclosed share is PMI / IC.  Terms with a share of ``generalise`` or more become their class, those
with ``remove`` or more go.  Only pairs seen in ``support`` different texts count, so an entity of fewer texts
has no terms.  A term has three letters or more and lies outside email addresses.

Everything is DataFrame functions.  Scale: texts are never shuffled unless they hold a disclosing term; pairs
are made of the whole texts whose entities have the support, and aggregated before they are shuffled, with
entities as numbers.  Copies are counted with their text's number of copies, and divided by it afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, stored

KINDS = ("email", "ip", "card", "phone", "term")

# Java forms of the contract's patterns that match the same spans in linear time: possessive runs, and a run
# is entered only at its start or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: cheap conditions that a text with a match meets
GATES = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
WORD = r"\p{L}++"
NONE = "array<struct<kind:string,start:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body or a lambda in it names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(lens: Column, block: int = 256) -> Column:
    """The sums of all elements up to each one of an int array, in two levels, so long arrays stay cheap."""

    def scan(a: Column) -> Column:  # from 0, one element more than a
        return F.aggregate(a, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def within(blocks: Column) -> Column:
        bases = scan(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x)))
        return F.flatten(F.zip_with(blocks, F.slice(bases, 1, F.size(blocks)), lambda b, base: F.transform(F.slice(scan(b), 2, F.size(b)), lambda v: v + base)))

    def cut(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda k: F.slice(a, k * block + 1, F.lit(block)))

    return let(lens, lambda a: F.when(F.size(a) > 0, let(cut(a), within)).otherwise(F.array().cast("array<int>")))


def pieces(text: Column, pattern: str, body: Callable[[Column, Column], Column]) -> Column:
    """``body(found, gaps)``: the matches of ``pattern``, and the texts before each and after the last."""
    both = F.struct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return let(both, lambda x: body(x["found"], x["gaps"]))


def placed(text: Column, pattern: str) -> Column:
    """array<struct<value, end>> of the matches of ``pattern``, in order; ends are code points, exclusive."""

    def ends(found: Column, gaps: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
        return F.zip_with(found, running(steps), lambda m, e: F.struct(m.alias("value"), e.alias("end")))

    return pieces(text, pattern, ends)


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    n = F.length(d)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 0, F.substring(d, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(d, i, F.lit(1)).cast("int") + 1)),
    )
    return total % 10 == 0


def valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(v, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        d = digits(v)
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(digits(v)).between(9, 15)
    return F.lit(True)


def spans_of(kind: str, places: Column) -> Column:
    return F.transform(places, lambda p: F.struct(F.lit(kind).alias("kind"), (p["end"] - F.length(p["value"])).alias("start"), p["end"].alias("end"), p["value"].alias("value")))


def matches(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, value>> of the kind's valid matches, in order; offsets are code points."""
    rows = F.filter(spans_of(kind, placed(text, PATTERNS[kind])), lambda r: valid(kind, r["value"]))
    return F.when(text.rlike(GATES[kind]), rows).otherwise(F.array().cast(NONE))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds a column for each base kind with its spans."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({k: matches(t, k) for k in KINDS[:4]})


def words_of(text: Column) -> Column:
    """The different words of a whole text, lower case, at least three letters each, without those in email addresses (no other base span has letters)."""
    t = F.coalesce(text, F.lit(""))
    bare = F.when(t.rlike(GATES["email"]), F.regexp_replace(t, PATTERNS["email"], " ")).otherwise(t)
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(bare), F.lit(f"({WORD})"), F.lit(1)), lambda w: F.length(w) >= 3))


def disclosing(docs: DataFrame, spans: DataFrame, keys: DataFrame, support: int = 3, generalise: float = 0.6, remove: float = 0.85, broadcast_rows: int = 500_000) -> DataFrame:
    """(entity, term, removed) for the terms that exceed a threshold.

    ``spans(text_key, entity)`` has a row per base span, ``keys(text_key)`` one per row of ``docs``.  All counts are of
    different texts, so exact copies of a document add nothing.
    """
    copies = stored(keys.groupBy("text_key").agg(F.count("*").alias("copies")), "copies")
    n = copies.count()
    # an entity of fewer texts has no pair with the support
    entities = spans.select("text_key", "entity").distinct()
    known = entities.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support)
    known = stored(known.withColumn("id", F.monotonically_increasing_id()), "entities")
    if known.isEmpty():
        return known.select("entity", F.lit("").alias("term"), F.lit(True).alias("removed"))
    held = stored(entities.join(known, "entity").groupBy("text_key").agg(F.collect_list("id").alias("ids")), "held")
    repeated = copies.where("copies > 1")
    words = docs.select(_key().alias("text_key"), words_of(F.col("text")).alias("words"))

    def near(df: DataFrame, other: DataFrame, how: str) -> DataFrame:
        return df.join(F.broadcast(other) if other.count() <= broadcast_rows else other, "text_key", how)

    def texts(df: DataFrame, *by: str) -> DataFrame:
        """Different texts by ``by``: rows by number of copies are a multiple of it."""
        each = df.groupBy(*by, "copies").agg(F.count("*").alias("rows"))
        return each.groupBy(*by).agg(F.sum(F.expr("rows div copies")).alias("n"))

    weighed = near(words, repeated, "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    # counted for all words, then joined: the sums are made before rows are shuffled, and no join meets an occurrence
    n_t = texts(weighed.select("copies", F.explode("words").alias("term")), "term").where(F.col("n") >= support).withColumnRenamed("n", "n_t")
    pairs = near(weighed, held, "inner").select("copies", "words", F.explode("ids").alias("id")).select("copies", "id", F.explode("words").alias("term"))
    joint = texts(pairs, "id", "term").where(F.col("n") >= support).withColumnRenamed("n", "n_et")
    scored = joint.join(known, "id").join(n_t, "term")
    pmi = F.log(F.col("n_et") * F.lit(float(n)) / (F.col("n_t") * F.col("n_e")))
    share = pmi / F.greatest(F.log(F.lit(float(n)) / F.col("n_e")), F.lit(1e-9))
    return scored.withColumn("share", share).where(F.col("share") >= generalise).select("entity", "term", (F.col("share") >= remove).alias("removed"))


def term_spans(text: Column, terms: Column) -> Column:
    """array<struct<kind, start, end, value>> of the words of ``text`` in ``terms``, outside email addresses."""

    def blank(found: Column, gaps: Column) -> Column:
        return woven(found, gaps, lambda m: F.repeat(F.lit(" "), F.length(m)))

    bare = F.when(text.rlike(GATES["email"]), pieces(text, PATTERNS["email"], blank)).otherwise(text)
    return let(bare, lambda t: spans_of("term", F.filter(placed(t, WORD), lambda p: F.array_contains(terms, F.lower(p["value"])))))


def woven(found: Column, gaps: Column, by: Callable[[Column], Column]) -> Column:
    """The text again, with ``by`` of each match in its place."""
    return F.array_join(F.concat(F.flatten(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.array(g, by(m)))), F.slice(gaps, -1, 1)), "")


def _key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def analyse(docs: DataFrame, **thresholds) -> tuple[DataFrame, DataFrame]:
    """(found, extra): the base spans of each row of ``docs``, and the disclosing terms of each document.

    found: doc_id, text_key, spans array<struct<kind, start, end>>.  extra: doc_id, terms, gone (those to remove).
    """
    spans = F.concat(*KINDS[:4])
    rows = base_spans(docs.select("doc_id", "text")).select("doc_id", _key().alias("text_key"), spans.alias("all"))
    found = stored(rows.select("doc_id", "text_key", F.transform("all", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"), F.array_distinct(F.transform("all", lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"])))).alias("entities")), "spans")
    each = found.where(F.size("entities") > 0).select("doc_id", "text_key", F.explode("entities").alias("entity"))
    told = stored(disclosing(docs, each, found.select("text_key"), **thresholds), "disclosing")
    # a row per entity, so no join multiplies documents by terms
    lists = told.groupBy("entity").agg(F.collect_list("term").alias("terms"), F.collect_list(F.when(F.col("removed"), F.col("term"))).alias("gone"))
    extra = each.select("doc_id", "entity").distinct().join(lists, "entity").groupBy("doc_id").agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("terms", "gone")))
    return found, extra


def rows_of(docs: DataFrame, extra: DataFrame, broadcast_rows: int = 50_000) -> DataFrame:
    """The rows of ``docs`` that have terms in ``extra``, with these."""
    few = extra.count() <= broadcast_rows
    return docs.join(F.broadcast(extra) if few else extra, "doc_id")


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced: base spans by [EMAIL], [IP], [CARD], [PHONE]; disclosing terms by their class, or removed.

    The class of a term is [NAME] where it begins with a capital, else [TERM].  Null texts stay null; rows without
    findings are unchanged, repeated rows stay repeated, rows without a doc_id keep their terms, all columns stay.
    """
    found, extra = analyse(docs, **thresholds)
    extra = stored(extra, "terms")
    few = extra.count() <= 50_000
    key, terms, gone = (fresh(docs, c) for c in ("_key_of_terms", "_terms", "_gone"))
    told = extra.select(F.col("doc_id").alias(key), F.col("terms").alias(terms), F.col("gone").alias(gone))
    out = docs.join(F.broadcast(told) if few else told, F.col("doc_id") == F.col(key), "left").drop(key)
    new = F.col("text")
    for kind in KINDS[:4]:
        new = _replaced(new, PATTERNS[kind], lambda m, k=kind: F.when(valid(k, m), F.lit(f"[{k.upper()}]")).otherwise(m), GATES[kind])

    def word(m: Column) -> Column:
        kind = F.when(m.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")
        return F.when(F.array_contains(gone, F.lower(m)), F.lit("")).when(F.array_contains(terms, F.lower(m)), kind).otherwise(m)

    new = let(new, lambda t: F.when(F.col(terms).isNotNull(), pieces(t, WORD, lambda f, g: woven(f, g, word))).otherwise(t))
    return out.withColumn("text", new).select(*docs.columns)


def _replaced(text: Column, pattern: str, by: Callable[[Column], Column], gate: str) -> Column:
    return let(text, lambda t: F.when(t.rlike(gate), pieces(t, pattern, lambda f, g: woven(f, g, by))).otherwise(t))


def op8_information_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and disclosing terms of every document: counts, the digest of the base spans, and all spans.

    Null text: empty.  Repeated rows each give their row.  Extra columns play no part.
    """
    docs = documents(spark, sf_dir)
    found, extra = analyse(docs)
    marked = rows_of(docs.select("doc_id", "text"), stored(extra, "terms"))
    more = marked.select("doc_id", _key().alias("text_key"), F.transform(term_spans(F.col("text"), F.col("terms")), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("more"))
    more = more.groupBy("doc_id", "text_key").agg(F.first("more").alias("more"))
    n = found.alias("f").join(more.alias("m"), F.col("f.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("f.text_key") == F.col("m.text_key")), "left").select("f.doc_id", "f.spans", F.coalesce("m.more", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("more"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return n.select("doc_id", *map(count, KINDS[:4]), F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(F.concat("spans", "more")).alias("spans"), F.size("more").cast("long").alias("n_term"))
