"""Decisions over the files of a library: classes, pairs, protection, collisions, what is already done.

``files`` has path, dir, name, stem, suffix, ext (see ``functions.paths``).  Joins are by equal keys, and each
build side is reduced to a row per key first, so none of them multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions.measures import webp_flags
from ..functions.paths import intended_output, kind_of, pruned, with_path_parts


def classify(files: DataFrame) -> DataFrame:
    """Media jobs: visible files of a known kind outside bundles that are no links; WebP only if animated.

    ``files(path, ...)`` with path relative to the library; ``head`` (first bytes) and ``is_symlink`` where known.
    """
    df = with_path_parts(files).where(~pruned(F.col("path"))).withColumn("kind", kind_of(F.col("ext")))
    if "is_symlink" in files.columns:
        df = df.where(~F.coalesce("is_symlink", F.lit(False)))
    animated = webp_flags(F.col("head"))["animated"] if "head" in files.columns else F.lit(False)
    return df.where("kind is not null").where((F.col("kind") != "webp") | animated)


def resumed_count(jobs: DataFrame, by: tuple = ()) -> DataFrame:
    """How many of ``resumed`` jobs a former run left unfinished, and how many there are: one row, or one for each group of columns ``by``."""
    return jobs.groupBy(*by).agg(F.count_if("unfinished").alias("resumed"), F.count("*").alias("candidates"))


def walk() -> list:
    """The order of a walk: the files of a folder before its subfolders, names by code point."""
    return [F.split("dir", "/"), F.col("name")]


def walk_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*walk())


def live_pairs(files: DataFrame) -> DataFrame:
    """(video, still, dir) of each .mov and the first still with its folder and stem, whatever the case."""
    keyed = files.withColumn("lstem", F.lower("stem"))
    stills = keyed.where(F.col("kind").isin("photo", "heic")).groupBy("dir", "lstem").agg(F.min_by("path", "name").alias("still"))
    videos = keyed.where((F.col("kind") == "video") & (F.col("ext") == ".mov")).select("dir", "lstem", F.col("path").alias("video"))
    return videos.join(stills, ["dir", "lstem"]).select("video", "still", "dir")


def verified_pairs(pairs: DataFrame, ids: DataFrame, has_tool: bool) -> DataFrame:
    """Pairs whose halves carry the same content id in ``ids(path, content_id)``; all of them without the tool."""
    if not has_tool:
        return pairs
    a = ids.select(F.col("path").alias("video"), F.col("content_id").alias("_a"))
    b = ids.select(F.col("path").alias("still"), F.col("content_id").alias("_b"))
    return pairs.join(a, "video", "left").join(b, "still", "left").where("_a <> '' and _a = _b").select(*pairs.columns)


def protected(pairs: DataFrame) -> DataFrame:
    """(path, detail) of both halves of each pair."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    halves = F.array(
        F.struct(F.col("video").alias("path"), F.concat(F.lit("Live Photo video of "), last("still"), F.lit(" (--convert-live-photos to convert)")).alias("detail")),
        F.struct(F.col("still").alias("path"), F.concat(F.lit("Live Photo still of "), last("video"), F.lit(" (--convert-live-photos to convert)")).alias("detail")),
    )
    return pairs.select(F.explode(halves).alias("x")).groupBy("x.path").agg(F.max("x.detail").alias("detail"))


def without(df: DataFrame, other: DataFrame, key: str = "path") -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_anti")


def open_jobs(jobs: DataFrame, status: DataFrame, done: DataFrame, standard: tuple, validate: bool) -> DataFrame:
    """Jobs that still need work: not completed, and no MP4 of a ``standard`` status (unless it must be healthy and isn't)."""
    good = F.col("status").isin(*standard)
    if validate:
        good = good & F.col("healthy")
    finished = status.where(good).select("path")
    return without(without(jobs, done), finished.join(jobs.where("kind = 'mp4'").select("path"), "path", "left_semi"))


def with_outputs(jobs: DataFrame, files: DataFrame, order: str) -> DataFrame:
    """Adds output: the intended one, or with a token where an earlier job or a file has it.

    The token comes from the path, so a second run plans the same.
    """
    want = jobs.withColumn("_out", intended_output(F.col("kind"), F.col("path"), F.col("output") if "output" in jobs.columns else F.lit(None).cast("string")))
    want = want.withColumn("_rank", F.expr(f"row_number() over (partition by _out order by `{order}`, path)"))
    there = files.select(F.col("path").alias("_out"), F.lit(True).alias("_there")).distinct()
    want = want.join(there, "_out", "left")
    taken = (F.col("_out") != F.col("path")) & ((F.col("_rank") > 1) | F.coalesce("_there", F.lit(False)))
    token = F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 8)
    renamed = F.regexp_replace("_out", r"(\.[^./]+)\z", "")
    out = F.when(taken, F.concat(renamed, F.lit("."), token, F.regexp_extract("_out", r"(\.[^./]+)\z", 1))).otherwise(F.col("_out"))
    return want.withColumn("output", out).drop("_out", "_rank", "_there")


def sidecars(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """(path, sidecar): existing photo.aae, photo.xmp and photo.jpg.xmp of each job, upper or lower case."""
    ext = F.array(*(F.lit(x) for s in V.SIDECAR for x in (s, s.upper())))
    base = F.when(F.col("dir") == "", F.col("stem")).otherwise(F.concat_ws("/", "dir", "stem"))
    may = F.array_distinct(F.flatten(F.transform(ext, lambda e: F.array(F.concat(base, e), F.concat(F.col("path"), e)))))
    wanted = jobs.select("path", F.explode(may).alias("sidecar"))
    return wanted.join(files.select(F.col("path").alias("sidecar")).distinct(), "sidecar", "left_semi").select("path", "sidecar")


def requirements(jobs: DataFrame, convert_heic: bool, by: tuple = ()) -> DataFrame:
    """Which tools the jobs need: one row, or one for each group of columns ``by``."""
    k = F.col("kind")
    photo = k == "photo"
    needs = {"video": k.isin("video", "mp4", "gif", "webp"), "photos": photo | (k == "heic") if convert_heic else photo, "animated_webp": k == "webp"}
    return jobs.groupBy(*by).agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in needs.items()))


def tally(outcomes: DataFrame) -> DataFrame:
    """status, n, bytes_saved for all statuses, with zeros."""
    spark = outcomes.sparkSession
    every = spark.createDataFrame([(s,) for s in V.STATUSES], "status string")
    got = outcomes.groupBy("status").agg(F.count("*").alias("n"), F.sum("bytes_saved").alias("bytes_saved"))
    return every.join(got, "status", "left").select("status", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n", "bytes_saved")))


def summary_line(counts: DataFrame, dry_run: bool = False) -> DataFrame:
    """One row with the closing line of a run."""
    n = {s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)) for s in V.STATUSES}
    some = [F.when(n[s] > 0, F.concat(n[s].cast("string"), F.lit(f" {s}"))) for s in ("converted", "remuxed", "repaired")]
    tenths = F.round(F.sum("bytes_saved") * 10 / F.lit(1024 * 1024)).cast("bigint")
    saved = F.concat(F.when(tenths < 0, "-").otherwise(""), F.floor(F.abs(tenths) / 10).cast("string"), F.lit("."), (F.abs(tenths) % 10).cast("string"), F.lit(" MB saved"))
    line = F.concat(F.lit("done: "), F.concat_ws(", ", *some, *(F.concat(n[s].cast("string"), F.lit(f" {s}")) for s in ("skipped", "failed")), saved))
    if dry_run:
        line = F.concat(F.lit("dry run complete: "), n["planned"].cast("string"), F.lit(" would be converted, "), n["skipped"].cast("string"), F.lit(" skipped"))
    return counts.agg(line.alias("line"))


def resumed(jobs: DataFrame, journal: DataFrame) -> DataFrame:
    """Adds unfinished: whether the journal holds the same file (path, size, mtime) as queued, running or interrupted.

    Order by unfinished first, then ``ord``, to take up where a run stopped.
    """
    key = ["path", "size", "mtime_ns"]
    left = journal.where(F.col("status").isin("queued", "running", "interrupted")).select(*key).distinct().withColumn("unfinished", F.lit(True))
    return jobs.join(left, key, "left").withColumn("unfinished", F.coalesce("unfinished", F.lit(False)))


def admitted(requests: DataFrame) -> DataFrame:
    """Adds required, reserved (by earlier admissions on the device) and decision for ``requests(seq, device, free, source_size)``.

    Only admitted requests reserve space: "admit" where the rest of the device holds what is required, else "wait"
    where something is reserved that will be released, else "fail".  Whether a request is admitted depends on
    all decisions before it on its device, so a device is one task's work, which holds one number and reads
    the requests as they come.
    """
    import numpy as np
    import pyarrow as pa

    from ..functions.measures import required_space
    from ..running import checkpoints

    checkpoints(requests.sparkSession)
    df = requests.withColumn("required", required_space(F.col("source_size")))
    dealt = df.repartition("device").sortWithinPartitions("device", "seq")
    names = df.columns

    def fold(frames):
        device, held = None, 0
        for batch in frames:
            col = {c: batch.column(names.index(c)).to_pylist() for c in ("device", "free", "required")}
            reserved, told = np.zeros(batch.num_rows, np.int64), []
            for k, (d, free, required) in enumerate(zip(col["device"], col["free"], col["required"], strict=True)):
                if k == 0 and device is None or d != device:
                    device, held = d, 0
                reserved[k] = held
                fits = free is not None and required is not None and free - held >= required
                told.append("admit" if fits else "wait" if held else "fail")
                held += required if fits else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reserved), pa.array(told, pa.string())], [*names, "reserved", "decision"])

    return dealt.mapInArrow(fold, f"{_ddl(df)}, reserved long, decision string")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def snapshot_faults(files: DataFrame) -> DataFrame:
    """Adds fault: why a file can't be a safe source, or null."""
    f = F.when(F.col("is_symlink"), "source is a symbolic link").when(~F.coalesce("is_file", F.lit(True)), "source is not a regular file").when(F.col("nlink") > 1, "source has multiple hard links").when(~F.coalesce("readable", F.lit(True)), "source is not readable")
    return files.withColumn("fault", f)
