"""Tables that are replaced or merged as a whole step: sorted by age in runs, with one pointer to those that count.

A table is a folder.  ``runs/`` holds Parquet folders that never change; ``versions/`` holds small JSON files, and the one
with the highest number names the runs that count.  A step writes its run with Spark's tasks and then gives the next version
its name by one rename, which fails if another step has taken the number.  So a step that dies midway leaves the old
state, a reader holds the version it began with, and nothing is changed in place.  Runs that no longer count go after ``GRACE`` seconds.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: seconds that a run is kept for its readers once it no longer counts
GRACE = 3600.0
#: the step that wrote a row
STEP = "_step"


class Conflict(RuntimeError):
    """Another step has committed the version meanwhile."""


def located(path: str):
    """(file system, path) where the running session finds ``path``; one without a scheme is in its default file system."""
    spark = SparkSession.getActiveSession()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(path: str) -> str | None:
    """A small state file, dot names included, wherever the session's file systems reach; null if it isn't there."""
    files, p = located(path)
    if not files.exists(p):
        return None
    stream = files.open(p)
    try:
        return SparkSession.getActiveSession().sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(path: str, text: str, new: bool = False) -> None:
    """Writes a small state file whole: beside its place first, then by one rename.  ``new``: a ``Conflict`` if there is one already."""
    sc = SparkSession.getActiveSession().sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    files, p = located(path)
    beside = hadoop.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}") if p.getParent() is not None else hadoop.Path(f".{p.getName()}.{uuid.uuid4().hex}")
    stream = files.create(beside, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    kind = getattr(hadoop, "Options$Rename")
    how = sc._gateway.new_array(kind, 1)
    how[0] = kind.NONE if new else kind.OVERWRITE
    context = hadoop.FileContext.getFileContext(files.getUri(), sc._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(beside), files.makeQualified(p), how)
    except Exception as e:
        files.delete(beside, False)
        if new and files.exists(p):
            raise Conflict(path) from e
        raise


def state(table: str) -> dict:
    """The latest version: its number, runs from the oldest on with their rows, last batch, schema, and the runs that are waiting to go."""
    files, at = located(f"{table}/versions")
    names = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
    numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
    if not numbers:
        return {"version": 0, "runs": [], "batch": -1, "schema": None, "gone": []}
    return json.loads(read_text(f"{table}/versions/{max(numbers):012d}.json"))


def _write_run(df: DataFrame, table: str) -> dict:
    name = uuid.uuid4().hex
    df.write.parquet(f"{table}/runs/{name}")
    return {"name": name, "rows": df.sparkSession.read.schema(df.schema).parquet(f"{table}/runs/{name}").count()}


def _commit(table: str, before: dict, runs: list[dict], batch: int, schema: T.StructType) -> None:
    now, named = time.time(), {r["name"] for r in runs}
    gone = before["gone"] + [{"name": r["name"], "at": now} for r in before["runs"] if r["name"] not in named]
    late = [g for g in gone if g["at"] < now - GRACE]
    after = {"version": before["version"] + 1, "runs": runs, "batch": batch, "schema": schema.json(), "gone": [g for g in gone if g not in late]}
    write_text(f"{table}/versions/{after['version']:012d}.json", json.dumps(after), new=True)
    for g in late:
        files, p = located(f"{table}/runs/{g['name']}")
        files.delete(p, True)
    if (old := after["version"] - 100) > 0:  # versions are read at once, so old ones are needed by nobody
        files, p = located(f"{table}/versions/{old:012d}.json")
        files.delete(p, False)


def sweep(table: str, older: float = 86_400.0) -> int:
    """Deletes what steps that died have left: runs no version waits for, unchanged for ``older`` seconds.  Their count."""
    now = state(table)
    files, at = located(f"{table}/runs")
    known = {r["name"] for r in (*now["runs"], *now["gone"])}
    dead = [x for x in (files.listStatus(at) if files.exists(at) else []) if x.getPath().getName() not in known and x.getModificationTime() / 1000 < time.time() - older]
    for x in dead:
        files.delete(x.getPath(), True)
    return len(dead)


def _read(spark: SparkSession, table: str, runs: list[dict], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*(f"{table}/runs/{r['name']}" for r in runs))


def replace(df: DataFrame, table: str) -> None:
    """``df`` becomes the table's whole content, in one step.  It may read the table itself."""
    before = state(table)
    run = _write_run(df.withColumn(STEP, F.lit(before["version"] + 1).cast("long")), table)
    _commit(table, before, [run], before["batch"], T.StructType([*df.schema.fields, T.StructField(STEP, T.LongType())]))


def newest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order`` (an expression), then by step."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.expr(order), F.col(STEP))).alias("_row")).select(*keys, "_row.*")


def merge(df: DataFrame, table: str, keys: list[str], order: str, batch: int | None = None, tries: int = 5) -> None:
    """Puts the rows of ``df`` into the table, of each key the last by ``order``; a ``batch`` that isn't after the last one was put in already.

    Each older run has over twice the rows of the next; a new one is merged with those before it that would break this.  So
    a reader reads at most twice the rows of the largest run, which has a row a key, however many batches there were, and a
    row is rewritten about as often as the table's rows can be halved down to a batch's.
    """
    spark, first = df.sparkSession, None
    for left in reversed(range(tries)):
        before = state(table)
        if batch is not None and batch <= before["batch"]:
            return
        step = before["version"] + 1
        schema = T.StructType([*df.schema.fields, T.StructField(STEP, T.LongType())])
        if first is None:
            first = _write_run(newest(df.withColumn(STEP, F.lit(step).cast("long")), keys, order).select(*schema.names), table)
        runs, rows, taken = list(before["runs"]), first["rows"], []
        while runs and runs[-1]["rows"] <= 2 * rows:
            taken.append(runs.pop())
            rows += taken[-1]["rows"]
        run = first
        if taken:
            run = _write_run(newest(_read(spark, table, [*taken, first], schema), keys, order).select(*schema.names), table)
        gone = {**before, "runs": before["runs"] + ([first] if taken else [])}
        try:
            return _commit(table, gone, [*runs, run], before["batch"] if batch is None else batch, schema)
        except Conflict:
            if not left:
                raise


def read(spark: SparkSession, table: str, keys: list[str] | None = None, order: str | None = None) -> DataFrame | None:
    """The table's rows, with ``keys`` the last of each by ``order``; null where there is no table yet.  A version is read whole."""
    now = state(table)
    if now["schema"] is None:
        return None
    df = _read(spark, table, now["runs"], T.StructType.fromJson(json.loads(now["schema"])))
    return (df if keys is None else newest(df, keys, order)).drop(STEP)
