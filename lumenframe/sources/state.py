"""Readers and writers of what a run keeps: inventories, packet lines, caches, plans, batches, journals, settings.

State files whose names begin with a dot are invisible to Spark's readers, so small ones are read by the
driver as text and parsed as rows; tables that grow are Parquet.
"""

from __future__ import annotations

import json
import os
import shlex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.inventory import normalised
from . import runs
from .runs import located, read_text, write_text


def inventories(raw: DataFrame) -> DataFrame:
    """Adds inventory to rows with the probe's JSON ``text``; null where it can't be read or the probe failed."""
    text = F.col("text")
    if "returncode" in raw.columns:
        text = F.when(F.col("returncode") == 0, text)
    return raw.withColumn("inventory", normalised(text))


def packet_lines(spark: SparkSession, path: str, named: str = r"([^/]+)\z") -> DataFrame:
    """path, stream_index, pts_time, dts_time, duration_time of the lines of text files; ``named`` finds a row's path in its file's."""
    from ..operators.timeline import packet_fields

    lines = spark.read.schema("value string").text(path, recursiveFileLookup=True)
    return packet_fields(lines.select("value", F.regexp_extract(F.col("_metadata.file_path"), named, 1).alias("path")))


def duration(raw: DataFrame) -> DataFrame:
    """Adds duration: the container's, in seconds, or null."""
    from ..functions.measures import number

    return raw.withColumn("duration", number(F.get_json_object("text", "$.format.duration")))


def decoded_frames(raw: DataFrame) -> DataFrame:
    """path, pos, stream_index, best_effort_timestamp_time, pts_time from a decoder's JSON ``text``."""
    kind = "struct<frames:array<struct<stream_index:string,best_effort_timestamp_time:string,pts_time:string>>>"
    frames = F.from_json("text", kind)["frames"]
    return raw.select("path", F.posexplode(frames).alias("pos", "f")).select("path", "pos", "f.*")


def _read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table; empty if there is none."""
    found = runs.read(spark, path)
    return spark.createDataFrame([], S.CACHE) if found is None else found


def write_cache(cache: DataFrame, path: str, dirty: bool = True) -> None:
    """Replaces the cache in one step; ``cache`` may come from it.  A write that fails leaves the old one."""
    if dirty:
        runs.replace(cache, path)


def write_journal_file(journal: DataFrame, path: str, started: str, updated: str, finished: str | None, interrupted: bool) -> None:
    """Writes ``journal(path, kind, size, mtime_ns, status, detail, updated_at)`` as one version 1 journal.  A finished run is told by its time."""
    entry = F.struct("kind", F.struct("size", "mtime_ns").alias("identity"), "status", "detail", "updated_at")
    files = {r["path"]: json.loads(r["entry"]) for r in journal.select("path", F.to_json(entry).alias("entry")).toLocalIterator()}
    write_text(path, json.dumps({"version": 1, "started_at": started, "updated_at": updated, "finished_at": finished, "interrupted": interrupted, "files": files}, ensure_ascii=False, indent=2))


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, size, mtime_ns, status, detail, updated_at of a version 1 journal; none if it is damaged."""
    df = spark.createDataFrame([(read_text(path),)], "text string").select(F.from_json("text", S.JOURNAL).alias("j")).where("j.version = 1")
    return df.select(F.explode("j.files").alias("path", "f")).select("path", "f.kind", "f.identity.size", "f.identity.mtime_ns", "f.status", "f.detail", "f.updated_at")


def write_plan(plan: DataFrame, root: str, path: str) -> None:
    """Writes ``plan(src, dst)`` (relative) as one JSON file; non-ASCII stays as it is."""
    rows = [{"from": r["src"], "to": r["dst"]} for r in plan.toLocalIterator()]
    write_text(path, json.dumps({"root": root, "renames": rows}, ensure_ascii=False, indent=2))


def _in_library(plan: DataFrame) -> DataFrame:
    """``plan(src, dst)`` with an error for an absolute path or one with ".."."""
    bad = lambda c: F.col(c).startswith("/") | F.array_contains(F.split(c, "/"), "..")
    told = F.raise_error(F.concat(F.lit("plan path leaves the library: "), F.col("src"), F.lit(" -> "), F.col("dst")))
    return plan.withColumn("src", F.when(bad("src") | bad("dst"), told).otherwise(F.col("src")))


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of a plan file, which a reader may have edited.  An absolute path or one with ".." is an error."""
    df = spark.createDataFrame([(read_text(path),)], "text string").select(F.explode(F.from_json("text", S.PLAN)["renames"]).alias("r"))
    return _in_library(df.select(F.col("r.from").alias("src"), F.col("r.to").alias("dst")))


def save_plan(plan: DataFrame, root: str, path: str) -> None:
    """Writes ``plan(src, dst)`` (relative) as a folder of JSON lines, by Spark's tasks; for plans of any size."""
    plan.select(F.lit(root).alias("root"), F.col("src").alias("from"), F.col("dst").alias("to")).write.json(path)


def load_plan(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of what ``save_plan`` wrote, edited or not.  An absolute path or one with ".." is an error."""
    rows = spark.read.schema("root string, from string, to string").json(path)
    return _in_library(rows.select(F.col("from").alias("src"), F.col("to").alias("dst")))


ENTRY = "path string, kind string, identity struct<size:bigint,mtime_ns:bigint>, status string, detail string, updated_at string"
RUN = "version int, started_at string, updated_at string, finished_at string, interrupted boolean"


def save_journal(journal: DataFrame, path: str, started: str, updated: str, finished: str | None, interrupted: bool) -> None:
    """Writes ``journal(path, kind, size, mtime_ns, status, detail, updated_at)`` as JSON lines under ``path``, by Spark's tasks; the run's own row comes last, so a journal without it isn't whole."""
    entry = journal.select("path", "kind", F.struct("size", "mtime_ns").alias("identity"), "status", "detail", "updated_at")
    entry.write.json(f"{path}/files")
    run = {"version": F.lit(1), "started_at": F.lit(started), "updated_at": F.lit(updated), "finished_at": F.lit(finished).cast("string"), "interrupted": F.lit(interrupted)}
    journal.sparkSession.range(1).select(*(c.alias(n) for n, c in run.items())).write.json(f"{path}/run")


def load_journal(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, size, mtime_ns, status, detail, updated_at of what ``save_journal`` wrote; none if it isn't whole or of another version."""
    files, done = located(f"{path}/run/_SUCCESS")
    if not files.exists(done):
        return spark.createDataFrame([], "path string, kind string, size long, mtime_ns long, status string, detail string, updated_at string")
    whole = spark.read.schema(RUN).json(f"{path}/run").where("version = 1").select("version").limit(1)
    rows = spark.read.schema(ENTRY).json(f"{path}/files").join(F.broadcast(whole))  # a row, or none
    return rows.select("path", "kind", "identity.size", "identity.mtime_ns", "status", "detail", "updated_at")


def record_batch(applied: DataFrame, table: str, time: str, order: tuple = ("src",)) -> bool:
    """Appends ``applied(src, dst, ...)`` as the next batch, its rows numbered from 0 by ``order``; nothing when there are none.

    The batches are a Parquet table wherever Spark can read and write.
    """
    from ..operators.order import row_numbers

    spark = applied.sparkSession
    if applied.isEmpty():
        return False
    have = read_batches(spark, table).agg(F.max("batch_id")).first()[0] or 0
    rows = row_numbers(applied, [], list(order), "seq").select(F.lit(have + 1).cast("long").alias("batch_id"), F.lit(time).alias("time"), (F.col("seq") - 1).alias("seq"), "src", "dst")
    rows.write.mode("append").parquet(table)
    return True


def read_batches(spark: SparkSession, table: str) -> DataFrame:
    """batch_id, time, seq, src, dst of all recorded batches; empty if there are none."""
    return _read_or_empty(spark, table, "batch_id long, time string, seq long, src string, dst string")


MANIFEST = "struct<version:int,state:string,root:string,source:string,final:string,temporary:string,backup:string,sidecars:array<string>,disposed_sidecars:array<string>,disposal:struct<mode:string,root:string,graveyard:string>>"


def _manifests(texts: DataFrame) -> DataFrame:
    from ..functions.paths import inside

    df = texts.withColumn("m", F.from_json("text", MANIFEST))
    ok = F.col("m.version") == 1
    for c in ("source", "final", "temporary", "backup"):
        ok = ok & inside(F.col(f"m.{c}"), F.col("m.root"))
    return df.select("manifest", "m.version", "m.state", "m.root", "m.source", "m.final", "m.temporary", "m.backup", "m.sidecars", "m.disposed_sidecars", "m.disposal", F.coalesce(ok, F.lit(False)).alias("valid"))


def read_manifests(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Rows of the transaction manifests in these folders; ``valid`` is false for damaged ones or paths outside the root."""
    rows = [(p, text) for d in sorted(folders) for p in [os.path.join(d, "manifest.json")] if (text := read_text(p)) is not None]
    return _manifests(spark.createDataFrame(rows, "manifest string, text string"))


def find_manifests(spark: SparkSession, root: str, named: str = "manifest.json") -> DataFrame:
    """``read_manifests`` of all files ``named`` (a pattern) under ``root``, at any depth, found and read by Spark's tasks.

    Folders that begin with a dot are not looked into; bundles are left out.  Paths are as the file system tells them.
    """
    from ..functions.paths import pruned

    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", named).schema("value string").text(root)
    path = F.col("_metadata.file_path")
    below = F.regexp_replace(path, r"\A[a-z][a-z0-9+.-]*:/*", "/")
    start = F.regexp_replace(F.lit(root), r"\A[a-z][a-z0-9+.-]*:/*", "/")
    rest = F.substring(below, F.length(F.rtrim(start, F.lit("/"))) + 2, F.length(below))
    return _manifests(texts.select(path.alias("manifest"), F.col("value").alias("text"), rest.alias("_rest")).where(~pruned(F.col("_rest"))).select("manifest", "text"))


def settings(text: str) -> list[str]:
    """Arguments of a settings file: a flag a line, with its value after white space; # begins a comment line."""
    out: list[str] = []
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            out.extend(line.split(None, 1))
    return out


def command_text(arguments: list[str]) -> str:
    return shlex.join(arguments)


def settings_rows(lines: DataFrame) -> DataFrame:
    """The same as a query over ``lines(value)``: flag and value."""
    v = F.trim("value")
    return lines.where((v != "") & ~v.startswith("#")).select(F.get(F.split(v, r"\s+", 2), F.lit(0)).alias("flag"), F.get(F.split(v, r"\s+", 2), F.lit(1)).alias("value"))


def disposal_names(moves: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds target to ``moves(path, stem, suffix)``: the name, or "stem N", the first from 2 on that neither ``existing(name)`` nor an earlier move has.

    Moves are served in order of path, and no two get one name: see ``free_names``.
    """
    from ..operators.claims import free_names

    return free_names(moves, existing)
