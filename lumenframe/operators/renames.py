"""Rename plans for files and folders, and what applying or undoing them does to a table of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions import names as N
from ..functions.folding import folded
from ..functions.paths import dir_of, name_of, pruned, with_path_parts
from ..running import checkpoints, kept
from .chains import relocated, settled

RENAMED = tuple(x for k in ("photo", "heic", "gif", "video", "mp4", "webp") for x in V.KINDS[k])


def _at(dir_: str, name) -> F.Column:
    return F.when(F.col(dir_) == "", name).otherwise(F.concat(F.col(dir_), F.lit("/"), name))


def plan_files(files: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """(src, dst) for ``files(path)``; with ``dates(path, date)``, names begin with a date.

    Series of a folder, cleaned name, site and extension are numbered without gaps.  A .mov with the stem of
    another renamed file follows it; sidecars follow their file.  Unchanged names give no row.

    Scale: two windows (series, and series of the .mov files that follow none) and two joins, all by folder
    and name.
    """
    # dealt evenly, however few files the table has, and taken apart once: filters pushed below would do it again
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    f = kept(with_path_parts(files.select("path").repartition(tasks, "path")).where(~pruned(F.col("path"))))
    media = f.where(F.col("ext").isin(*RENAMED))
    media = N.with_parsed(media.withColumn("guid", N.is_guid(F.col("stem"))))
    media = N.with_cleaned(media.withColumn("random", F.col("guid") | N.looks_random(F.col("stem"))), compose=True)
    # used by six branches below: computed once, and the plans of the branches stay small
    checkpoints(files.sparkSession)
    media = media.select("path", "dir", "name", "stem", "ext", "guid", "random", "opaque", "number", "is_dup", "site", "cleaned")
    media = kept(media)
    folder = F.coalesce(F.nullif(name_of(F.col("dir")), F.lit("")), F.lit("media"))
    token = F.when(F.col("guid"), F.lower("stem")).otherwise(F.col("stem"))
    loose = media.where("random").select("path", "dir", "stem", F.concat(folder, F.lit(" ["), token, F.lit("]")).alias("new"), "ext", F.lit(False).alias("leads"))
    opaque = media.where("not random and opaque").select("path", "dir", "stem", F.col("stem").alias("new"), "ext", F.lit(False).alias("leads"))
    named = media.where("not random and not opaque and cleaned <> ''").select("path", "dir", "name", "stem", "ext", "number", "is_dup", "site", "cleaned")
    named = named.withColumns({"_key": folded(F.col("cleaned")), "_site": folded(F.coalesce("site", F.lit("")))})

    def assigned(df: DataFrame) -> DataFrame:
        df = N.numbered_series(df, ["dir", "_key", "_site", "ext"])
        new = F.concat("cleaned", N.tag(F.col("site"), F.col("seq"), F.col("width")))
        return df.select("path", "dir", "stem", new.alias("new"), "ext", "_key", "_site", "seq", "name")

    def dated(df: DataFrame) -> DataFrame:
        if dates is None:
            return df
        return df.join(dates.select("path", "date"), "path", "left").withColumn("new", F.when(F.col("date").isNull(), F.col("new")).otherwise(N.date_prefixed(F.col("new"), F.col("date")))).drop("date")

    stills = dated(assigned(named.where("ext <> '.mov'")))
    # what a stem became, the last series of the folder winning
    final = stills.groupBy("dir", "stem").agg(F.max_by("new", F.struct("_key", "_site", "ext", "name")).alias("lead"))
    movs = named.where("ext = '.mov'").join(final, ["dir", "stem"], "left")
    mirrored = movs.where("lead is not null").select("path", "dir", "stem", F.col("lead").alias("new"), "ext")
    own = dated(assigned(movs.where("lead is null").drop("lead")))
    finals = final.join(own.select("dir", "stem"), ["dir", "stem"], "left_anti").unionByName(own.groupBy("dir", "stem").agg(F.max_by("new", "name").alias("lead")))
    aside = f.where(F.col("ext").isin(*V.SIDECAR)).join(finals, ["dir", "stem"]).select("path", "dir", "stem", F.col("lead").alias("new"), "ext")
    cols = ["path", "dir", "stem", "new", "ext"]
    every = stills.select(*cols).unionByName(own.select(*cols)).unionByName(mirrored.select(*cols)).unionByName(aside.select(*cols)).unionByName(dated(loose.select(*cols))).unionByName(opaque.select(*cols))
    out = every.select(F.col("path").alias("src"), _at("dir", F.concat("new", "ext")).alias("dst"))
    return out.where("src <> dst")


def plan_folders(folders: DataFrame) -> DataFrame:
    """(src, dst, depth) for ``folders(path)``, deepest first; names that end in brackets or clean to nothing stay."""
    f = folders.select("path").where(~pruned(F.concat("path", F.lit("/x"))))
    f = f.withColumns({"dir": dir_of(F.col("path")), "name": name_of(F.col("path"))}).where(~F.col("name").rlike(N.BRACKET))
    f = N.with_cleaned(f, "name", "new", compose=True).where("new <> '' and new <> name")
    return f.select(F.col("path").alias("src"), _at("dir", F.col("new")).alias("dst"), F.size(F.split("path", "/")).alias("depth")).orderBy(F.desc("depth"), "src")


def folders_of(files: DataFrame) -> DataFrame:
    """(path) of all folders that hold a file, at any depth."""
    from ..functions.paths import ancestors

    # each folder is taken apart once, not each file
    held = files.where(F.contains("path", F.lit("/"))).select(dir_of(F.col("path")).alias("_dir")).distinct()
    return held.select(F.explode(ancestors(F.concat("_dir", F.lit("/x")))).alias("path")).distinct()


def plan_all(files: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """(phase, src, dst): the file plan (phase 1), then the folder plan over the folders of ``files(path)`` (phase 2), to be applied in this order."""
    first = plan_files(files, dates).select(F.lit(1).alias("phase"), "src", "dst")
    return first.unionByName(plan_folders(folders_of(files)).select(F.lit(2).alias("phase"), "src", "dst"))


def apply_all(plan: DataFrame, files: DataFrame) -> tuple[DataFrame, int, int]:
    """Applies ``plan(phase, src, dst)`` to ``files(path)``: (paths after, renamed, skipped).  Files go first, then folders, deepest first, with all they hold.

    A folder's rename changes its last name only, so folders are settled where they were, and each path takes the new names of
    all its folders in one pass, whatever its depth (``relocated``).
    """
    checkpoints(plan.sparkSession)
    plan = kept(plan.select("phase", "src", "dst"))  # read by several steps below
    _, after, renamed, skipped = applied(plan.where("phase = 1"), files.select("path"))
    folders = plan.where("phase = 2").select("src", "dst", F.struct(-F.size(F.split("src", "/")), "src").alias("pos"))
    taken = folders_of(after).unionByName(after)
    told = settled(folders, taken)
    if not told.where("act = 'stuck'").isEmpty():  # what holds a ring of renames waits for ever, too
        done, _, n, m = _in_rounds(folders, taken)
        return relocated(after, done), renamed + n, skipped + m
    n = {r["act"]: r["count"] for r in told.groupBy("act").count().collect()}
    return relocated(after, told.where("act = 'move'")), renamed + n.get("move", 0), skipped + n.get("skip", 0)


def blocked_by_descendants(pending: DataFrame) -> DataFrame:
    """Adds blocked: whether another pending source lies inside this one.  By exploding ancestors, so the join has equal keys."""
    from ..functions.paths import ancestors

    inner = pending.where(F.contains("src", F.lit("/"))).select(F.explode(ancestors(F.col("src"))).alias("src")).distinct().withColumn("blocked", F.lit(True))
    return pending.join(inner, "src", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def applied(plan: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """Applies ``plan(src, dst)`` to ``paths(path)``: (applied with round, paths after, renamed, skipped).

    A plan of which no source lies inside another is settled by jumps along its chains (``settled``), else in rounds.
    """
    checkpoints(plan.sparkSession)
    plan = kept(plan.select("src", "dst").distinct())
    if not blocked_by_descendants(plan).where("blocked").isEmpty():
        return _in_rounds(plan, paths)
    told = settled(plan, paths)
    n = {r["act"]: r["count"] for r in told.groupBy("act").count().collect()}
    done = told.where("act = 'move'").select("src", "dst", "round")
    after = paths.join(done.select(F.col("src").alias("path"), "dst"), "path", "left").select(F.coalesce("dst", "path").alias("path"))
    return done, kept(after), n.get("move", 0), n.get("skip", 0) + n.get("stuck", 0)


def _in_rounds(plan: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """Simulates a plan with sources inside others on ``paths(path)``: (applied with round, paths after, renamed, skipped).

    In each round every rename whose target is free goes, unless a pending source lies inside its own; of
    several to one target, the first by source.  Those whose target will itself move wait.  When a round moves
    nothing, the rest are skipped: each round but the last has fewer pending than the one before, so it ends.
    """
    import itertools

    checkpoints(plan.sparkSession)
    pending, done, skipped, renamed = plan.select("src", "dst").distinct(), None, 0, 0
    for k in itertools.count():
        if pending.isEmpty():
            break
        p = blocked_by_descendants(pending)
        p = p.join(paths.select(F.col("path").alias("dst"), F.lit(True).alias("_there")).distinct(), "dst", "left")
        p = p.join(pending.select(F.col("src").alias("dst"), F.lit(True).alias("_moves")), "dst", "left")
        there, moves = F.coalesce("_there", F.lit(False)), F.coalesce("_moves", F.lit(False))
        p = p.withColumn("_rank", F.expr("row_number() over (partition by dst, blocked order by src)"))
        act = F.when(F.col("blocked"), "wait").when(there & moves, "wait").when(there, "skip").when(F.col("_rank") > 1, "wait").otherwise("move")
        p = kept(p.select("src", "dst", act.alias("act")))
        n = {r["act"]: r["count"] for r in p.groupBy("act").count().collect()}
        if not n.get("move") and not n.get("skip"):
            skipped += n.get("wait", 0)
            break
        moved = p.where("act = 'move'").select("src", "dst", F.lit(k).alias("round"))
        done = moved if done is None else done.unionByName(moved)
        renamed, skipped = renamed + n.get("move", 0), skipped + n.get("skip", 0)
        after = paths.join(moved.select(F.col("src").alias("path"), "dst"), "path", "left").select(F.coalesce("dst", "path").alias("path"))
        paths = kept(after)
        pending = p.where("act = 'wait'").select("src", "dst")
    if done is None:
        done = plan.select("src", "dst", F.lit(0).alias("round")).limit(0)
    return done, paths, renamed, skipped


def undo(batches: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last batch of ``batches(batch_id, seq, src, dst)`` reversed, in reverse order: (steps with done, paths after).

    A step is done if its target still exists and its source is free.
    """
    last = batches.join(batches.agg(F.max("batch_id").alias("batch_id")), "batch_id").orderBy(F.desc("seq"))
    there = paths.select("path").distinct()
    steps = last.join(there.withColumnRenamed("path", "dst").withColumn("_is", F.lit(True)), "dst", "left").join(there.withColumnRenamed("path", "src").withColumn("_taken", F.lit(True)), "src", "left")
    # a source that another step of the batch gives back is free by then
    freed = last.select(F.col("dst").alias("src"), F.lit(True).alias("_freed")).distinct()
    steps = steps.join(freed, "src", "left")
    ok = F.coalesce("_is", F.lit(False)) & (~F.coalesce("_taken", F.lit(False)) | F.coalesce("_freed", F.lit(False)))
    steps = steps.select(F.col("dst").alias("from"), F.col("src").alias("to"), "seq", ok.alias("done")).orderBy(F.desc("seq"))
    after = paths.join(steps.where("done").select(F.col("from").alias("path"), "to"), "path", "left").select(F.coalesce("to", "path").alias("path"))
    return steps, after
