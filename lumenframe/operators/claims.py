"""Names that stay free: numbered names for many files at once, none given twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..running import kept
from .order import row_numbers
from .scan import running_sums

NUMBER = r" (\d+)(?:\.[^.]*)?\z"


def taken_numbers(existing: DataFrame, bases: DataFrame) -> DataFrame:
    """(_base, _n) of ``existing(name)`` that are a name of ``bases(_base)``: itself, 1, or with a number from 2 on as a counter writes it."""
    number = F.coalesce(F.regexp_extract("name", NUMBER, 1).try_cast("bigint"), F.lit(1).cast("bigint"))
    bare = F.regexp_replace("name", r" \d+(\.[^.]*)?\z", "$1")
    forms = existing.select("name", F.lit(1).cast("bigint").alias("_n"), F.col("name").alias("_base")).unionByName(existing.select("name", number.alias("_n"), bare.alias("_base")).where("_n >= 2"))
    plain = (F.col("_n") == 1) | (F.regexp_extract("name", NUMBER, 1) == F.col("_n").cast("string"))
    return forms.where(plain).select("_base", "_n").distinct().join(bases, "_base", "left_semi")


def contests(ranked: DataFrame, existing: DataFrame) -> DataFrame:
    """(_base, _n, _child, _first): numbered names of a base that are also the plain name of another base, whose first move is ``_first``."""
    first = ranked.where("_k = 1").select(F.col("_base").alias("_child"), F.col("path").alias("_first"), "stem", "suffix")
    n = F.regexp_extract("stem", r"\A(.*) ([1-9]\d*)\z", 2).try_cast("bigint")
    parent = F.concat(F.regexp_extract("stem", r"\A(.*) ([1-9]\d*)\z", 1), F.col("suffix"))
    asked = first.select(parent.alias("_base"), n.alias("_n"), "_child", "_first").where("_n >= 2")
    asked = asked.join(ranked.where("_k = 1").select("_base"), "_base", "left_semi")
    return asked.join(existing.select(F.col("name").alias("_child")), "_child", "left_anti").select("_base", "_n", "_child", "_first")


def lost_numbers(ranked: DataFrame, taken: DataFrame, asked: DataFrame) -> DataFrame:
    """(_base, _n): the names that a base doesn't get as a move of another base comes first.

    Who would claim a number follows from how many numbers below it are gone, and that from the contests below.  Claims
    are held against claims until none changes; each round settles at least the lowest open number of every base.
    """
    asked = kept(asked.withColumns({"_child_gets": F.lit(False), "_parent_gets": F.lit(False)}))
    while True:
        gone = taken.select("_base", "_n", F.lit(1).alias("_w"), F.lit(0).alias("_asks"))
        gone = gone.unionByName(asked.select(F.col("_child").alias("_base"), F.lit(1).cast("bigint").alias("_n"), F.col("_parent_gets").cast("int").alias("_w"), F.lit(0).alias("_asks")))
        gone = gone.unionByName(asked.select("_base", "_n", F.col("_child_gets").cast("int").alias("_w"), F.lit(1).alias("_asks")))
        below = running_sums(gone, ["_base"], ["_n"], "_w", "_below").where("_asks = 1").select("_base", "_n", (F.col("_n") - F.col("_below") + F.col("_w")).alias("_k"))
        told = asked.join(below, ["_base", "_n"]).join(ranked.select("_base", "_k", F.col("path").alias("_claims")), ["_base", "_k"], "left")
        child = F.col("_claims").isNull() | (F.col("_first") < F.col("_claims"))
        new = kept(told.select("_base", "_n", "_child", "_first", child.alias("_child_gets"), (~child).alias("_parent_gets"), ((child != F.col("_child_gets")) | (~child != F.col("_parent_gets"))).alias("_changed")))
        asked, changed = new.drop("_changed"), not new.where("_changed").isEmpty()
        if not changed:
            break
    return asked.where("_child_gets").select("_base", "_n").unionByName(asked.where("_parent_gets").select(F.col("_child").alias("_base"), F.lit(1).cast("bigint").alias("_n")))


def free_names(moves: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds target to ``moves(path, stem, suffix)``, in order of path: stem and suffix, or "stem N" and suffix, the first from 2 on that is free.

    A name is free if neither ``existing(name)`` nor an earlier move has it, of whatever stem.  The k-th move of a base gets its k-th free
    number.  Scale: moves and taken numbers of a base are counted by running sums over ranges, so a base may hold a third of all moves;
    only names that two bases can claim take part in the rounds of ``lost_numbers``.
    """
    m = moves.withColumn("_base", F.concat("stem", "suffix"))
    ranked = kept(row_numbers(m, ["_base"], ["path"], "_k"))
    taken = kept(taken_numbers(existing, ranked.where("_k = 1").select("_base")))
    asked = kept(contests(ranked, existing))
    if not asked.isEmpty():
        taken = kept(taken.unionByName(lost_numbers(ranked, taken, asked)).distinct())
    # a taken number with v free ones below it is passed by the moves after the v-th
    passed = row_numbers(taken, ["_base"], ["_n"], "_r").select("_base", (F.col("_n") - F.col("_r")).alias("_at"), F.lit(1).alias("_kind"), *(F.lit(None).cast(m.schema[c].dataType).alias(c) for c in moves.columns))
    served = ranked.select("_base", F.col("_k").alias("_at"), F.lit(0).alias("_kind"), *moves.columns)
    told = running_sums(served.unionByName(passed), ["_base"], ["_at", "_kind"], "_kind", "_passed").where("_kind = 0")
    n = F.col("_at") + F.col("_passed")
    return told.withColumn("target", F.when(n == 1, F.col("_base")).otherwise(F.concat("stem", F.lit(" "), n.cast("string"), F.col("suffix")))).select(*moves.columns, "target")
