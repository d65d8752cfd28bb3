"""Cached probe results, completed conversions, and recovery of interrupted replacements, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTITY = ("m", "c", "s", "i", "d")


def lookup(files: DataFrame, cache: DataFrame, kind: str, strong: bool = False) -> DataFrame:
    """Adds value and hit: the cached value of ``kind`` where the file's identity (and, if strong, its digest ``f``) is unchanged."""
    keys = ["path", *IDENTITY, *(["f"] if strong else [])]
    known = cache.where(F.col("kind") == kind)
    on = None
    for k in keys:
        c = files[k].eqNullSafe(known[k])
        on = c if on is None else on & c
    return files.join(known, on, "left").select(*(files[c] for c in files.columns), known["value"].alias("value"), known["kind"].isNotNull().alias("hit"))


def upserted(cache: DataFrame, new: DataFrame, keys: tuple = ("kind", "path")) -> DataFrame:
    """The cache with new rows in place of those with their key.  One aggregation; later rows win."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    row = F.struct(*cache.columns)
    return both.groupBy(*keys).agg(F.max_by(row, "_new").alias("_row")).select("_row.*")


def retained(cache: DataFrame, newest: str, limit: int = 200_000) -> DataFrame:
    """At most ``limit`` entries, the newest."""
    return cache.orderBy(F.desc(newest), "path").limit(limit)


def completed(sources: DataFrame, completions: DataFrame, files: DataFrame) -> DataFrame:
    """(path, output) of sources whose recorded conversion holds: both identities as they were."""
    now = files.select(F.col("path").alias("output"), F.col("identity").alias("_now"))
    kept = completions.join(now, "output").where(F.col("output_identity").eqNullSafe(F.col("_now")))
    s = sources.select("path", "identity")
    return s.join(kept, s["path"] == kept["source"]).where(F.col("identity").eqNullSafe(F.col("source_identity"))).select("path", "output")


def recovery(transactions: DataFrame, observed: DataFrame) -> DataFrame:
    """Adds decision and message: what to do with each interrupted replacement.

    ``transactions(id, source, final, backup, temporary, source_identity, output_identity, root)``;
    ``observed(path, identity, output_identity)`` has a row per existing file, where output_identity is its
    identity by digest.  Four left joins on path; one ordered choice.
    """
    t = transactions
    for place in ("source", "final", "backup", "temporary"):
        seen = observed.select(F.col("path").alias(place), F.col("identity").alias(f"_{place}_id"), F.col("output_identity").alias(f"_{place}_out"), F.lit(True).alias(f"_{place}"))
        t = t.join(seen, place, "left")
    there = lambda p: F.coalesce(F.col(f"_{p}"), F.lit(False))
    original = lambda p: there(p) & F.col(f"_{p}_id").eqNullSafe(F.col("source_identity"))
    output = lambda p: there(p) & F.col(f"_{p}_out").eqNullSafe(F.col("output_identity"))
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    decision = (
        F.when(output("final") & (original("backup") | ~there("backup")), "finish")
        .when(original("source") & ~there("backup"), "discard")
        .when(original("backup"), "restore")
        .otherwise("unresolved")
    )
    t = t.withColumn("decision", decision)
    message = (
        F.when(F.col("decision") == "finish", F.concat(F.lit("finish installed output "), name("final")))
        .when(F.col("decision") == "discard", F.concat(F.lit("discard uncommitted output for "), name("source")))
        .when(F.col("decision") == "restore", F.concat(F.lit("restore original "), name("source")))
        .otherwise("cannot identify a trustworthy original or validated output")
    )
    t = t.withColumn("message", message).withColumn("drop_temporary", F.col("decision").isin("discard", "restore") & output("temporary"))
    return t.select(*transactions.columns, "decision", "message", "drop_temporary")


def recovery_report(decided: DataFrame) -> DataFrame:
    d = F.col("decision")
    return decided.agg(F.count_if(d == "finish").alias("completed"), F.count_if(d.isin("discard", "restore")).alias("rolled_back"), F.count_if(d == "unresolved").alias("unresolved"))


STATES = ("prepared", "source_staged", "output_installed", "original_disposed")


def next_state(state: Column) -> Column:
    """The state after this one of a replacement; null after the last."""
    return F.element_at(F.create_map(*(x for a, b in zip(STATES[:-1], STATES[1:], strict=True) for x in (F.lit(a), F.lit(b)))), state)
