"""Renames that wait for each other, settled by pointer jumping; and paths below renamed folders, in one join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, dir_of, name_of
from ..running import checkpoints, kept


def settled(plan: DataFrame, taken: DataFrame) -> DataFrame:
    """src, dst, act, round of ``plan(src, dst[, pos])`` over the existing ``taken(path)``: what becomes of each rename.

    act is move, skip (the target stays taken, another rename gets it, or the source isn't there) or stuck (renames that wait for each other in a
    ring, and those that wait for them).  A rename goes when its target is free, so it may wait for the one whose source the target is; ``round``
    counts how many go one after the other before it.  Renames are tried in order of ``pos`` (else ``src``), again and
    again: of those to one target, the first after the one that frees it gets it, else the first of all.  A rename to itself moves;
    of several from one source, the first counts.

    Scale: those that get a target form chains without branches, which are ranked by jumps: each round doubles how far
    a rename looks ahead, so a chain of 100,000 takes 17.  A round in which no chain ends leaves rings only.  Targets that a
    third of all renames want are pre-aggregated.
    """
    checkpoints(plan.sparkSession)
    pos = F.col("pos") if "pos" in plan.columns else F.col("src")
    there = taken.select("path").distinct()
    p = plan.select("src", "dst", pos.alias("pos")).groupBy("src").agg(F.min(F.struct("pos", "dst")).alias("r")).select("src", "r.dst", "r.pos")
    p = kept(p.join(there.select(F.col("path").alias("src"), F.lit(True).alias("_is")), "src", "left"))
    sources = p.where("_is and src <> dst")
    q = sources.select(F.col("src").alias("dst"), F.col("pos").alias("_freed"))
    full = there.select(F.col("path").alias("dst"), F.lit(True).alias("_full"))
    asked = sources.join(q, "dst", "left").join(full, "dst", "left")
    late = F.coalesce(F.col("pos") < F.col("_freed"), F.lit(False))
    row = F.struct("src", F.col("_freed").isNotNull().alias("waits"), F.coalesce("_full", F.lit(False)).alias("full"))
    first = kept(asked.groupBy("dst").agg(F.min_by(row, F.struct(late, "pos")).alias("r")).select("r.src", "dst", "r.waits", "r.full"))
    # a target whose own rename isn't among the first of its target stays taken
    goes = first.select(F.col("src").alias("dst"), F.lit(True).alias("_goes"))
    ahead = F.when(F.col("waits") & F.col("_goes"), F.col("dst"))
    nodes = first.join(goes, "dst", "left").select("src", "dst", ahead.alias("next"), F.when(ahead.isNull(), ~F.col("full")).alias("good"), F.when(ahead.isNull(), 0).otherwise(1).cast("long").alias("far"))
    nodes, left = kept(nodes), None
    while (now := nodes.where("next is not null").count()) and now != left:
        left = now
        ends = nodes.select(F.col("src").alias("next"), F.col("next").alias("_next"), F.col("good").alias("_good"), F.col("far").alias("_far"))
        jumped = nodes.where("next is not null").join(ends, "next").select("src", "dst", F.col("_next").alias("next"), F.col("_good").alias("good"), (F.col("far") + F.col("_far")).alias("far"))
        nodes = kept(nodes.where("next is null").unionByName(jumped))
    told = nodes.select("src", F.when(F.col("next").isNotNull(), "stuck").when(F.col("good"), "move").otherwise("skip").alias("_act"), F.when(F.col("good"), F.col("far")).alias("_far"))
    itself = F.when(F.col("_is") & (F.col("src") == F.col("dst")), "move")
    out = p.join(told, "src", "left").select("src", "dst", F.coalesce(itself, "_act", F.lit("skip")).alias("act"), F.coalesce(F.when(itself.isNotNull(), 0), "_far").cast("int").alias("round"))
    return kept(out)


def relocated(paths: DataFrame, moves: DataFrame) -> DataFrame:
    """``paths(path)`` after the folder renames ``moves(src, dst)``, which change last names only.

    ``src`` is a folder's path before any rename.  An index of the distinct folders by all their prefixes meets the renames once and
    composes the names of every level; paths then take their folder's.  Work follows the number of folders, not paths times depth.
    """
    at = dir_of(F.col("path"))
    folders = paths.select(at.alias("_dir")).where("_dir <> ''").distinct()
    prefixes = folders.select("_dir", F.explode(ancestors(F.concat("_dir", F.lit("/x")))).alias("src"))
    new = moves.select("src", F.struct(F.size(F.split("src", "/")).alias("level"), name_of(F.col("dst")).alias("name")).alias("_new"))
    names = prefixes.join(new, "src").groupBy("_dir").agg(F.map_from_entries(F.collect_list("_new")).alias("_names"))  # as many as a path is deep
    parts = F.transform(F.split("_dir", "/"), lambda part, k: F.coalesce(F.try_element_at("_names", k + 1), part))
    told = names.select("_dir", F.array_join(parts, "/").alias("_to"))
    path = F.when(F.col("_to").isNull(), F.col("path")).otherwise(F.concat("_to", F.lit("/"), name_of(F.col("path"))))
    return kept(paths.withColumn("_dir", at).join(told, "_dir", "left").select(path.alias("path")))
