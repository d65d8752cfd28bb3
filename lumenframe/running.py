"""Running streams and loops to their end, with their files in the shared folder the session names."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: folders of our own, by application, where the session names none
_OWN: dict[str, str] = {}


def checkpoints(spark: SparkSession) -> str:
    """This application's folder in that of ``spark.checkpoint.dir``, or the context's checkpoint folder.  Lets workers import this package.

    Only in a local session that names neither is a folder of our own made; elsewhere that is an error, as
    executors would not see it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or _OWN.get(sc.applicationId)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="lumenframe-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), sc.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)
    at = f"{named.rstrip('/')}/lumenframe-core/{sc.applicationId}"
    if at not in _RUNS:  # this application's folder, which goes when it ends
        _RUNS.add(at)
        p = sc._jvm.org.apache.hadoop.fs.Path(at)
        files = p.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(p)
        files.deleteOnExit(p)
    return at


_RUNS: set[str] = set()


def kept(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: plans stay short, and lost executors cost one step."""
    path = f"{checkpoints(df.sparkSession)}/kept/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB, as operators with timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def streamed(spark: SparkSession, rows: DataFrame, query: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """The result of a streaming query over files of ``rows``, once all are read."""
    at = f"{checkpoints(spark)}/streams/{uuid.uuid4().hex}"
    rows.write.parquet(f"{at}/in")
    out, name = query(spark.readStream.schema(rows.schema).parquet(f"{at}/in")), f"streamed_{uuid.uuid4().hex}"
    if mode == "append":
        q = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{at}/out")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/{name}/{batch_id}")

    q = out.writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start()
    last = q.lastProgress
    q.awaitTermination()
    last = q.lastProgress or last
    return spark.read.schema(out.schema).parquet(f"{at}/{name}/{last['batchId']}")
