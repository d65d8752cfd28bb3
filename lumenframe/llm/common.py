"""What the operators of this subpackage share: shared-folder tables, link components, small helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: folders of our own, by application, where the session names none
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only in a local session that names neither (tests in one JVM) is a folder of our own made; elsewhere that
    is an error, as executors would not see it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or _OWN.get(sc.applicationId)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="lumenframe-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    ship_code(spark)
    return named.rstrip("/")


#: what an Arrow batch of rows may take, unless the session sets another size: whole texts come a few at a time
BATCH_BYTES = "8m"


def ship_code(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did, and bounds the batches they get."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def lean(work: Callable) -> Callable:
    """``work`` over batches, which gives memory back to the system when a task is through: workers are kept for the next stage."""

    def run(frames: Iterator) -> Iterator:
        yield from work(frames)
        trim()

    return run


def trim() -> None:
    import ctypes

    import pyarrow as pa

    WORDS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def run_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the application ends."""
    at = f"{shared_dir(spark)}/lumenframe/{spark.sparkContext.applicationId}"
    if at not in _RUNS:
        _RUNS.add(at)
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(p)
        files.deleteOnExit(p)
    return at


_RUNS: set[str] = set()


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage ends here, and any executor may be lost."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{what}-{uuid.uuid4().hex}"
    # what was shuffled for the table is of no use once it is written, and would lie on disk until the driver collects garbage
    was = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if was is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, was)
    out = spark.read.parquet(path)
    out._stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table that ``stored`` wrote, once nothing lazy reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    have, name, n = {c.lower() for c in df.columns}, stem, 0
    while name.lower() in have:
        n += 1
        name = f"{stem}_{n}"
    return name


def unsigned_crc32(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """word (bytes) -> 64-bit hash.  A cache of bounded size; what it holds never changes a result."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, seed=0x5EED)
        return h


WORDS = WordHashes()


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of the whole text: A-Z lower-cased, cut at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash per run of ``size`` words, in order; a shorter sequence is one shingle as a whole, none if empty."""
    if not len(words):
        return words
    size_here = min(size, len(words))
    n = len(words) - size_here + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(size_here):
        h *= np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
        h += words[k : k + n]
    return mix64(h + np.uint64(size_here))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(text or ""), size))


def batches(frames: Iterator, size: int) -> Iterator:
    """Cuts pandas frames into pieces of at most ``size`` rows."""
    for pdf in frames:
        for at in range(0, len(pdf), size):
            yield pdf.iloc[at : at + size]


def labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of 0 .. n - 1 by the links (u, v)."""
    lab = np.arange(n)
    while len(u):
        a, b = lab[u], lab[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(lab, a, low)
        np.minimum.at(lab, b, low)
        while True:
            further = lab[lab]
            if (further == lab).all():
                break
            lab = further
    return lab


def _stars(frames: Iterator) -> Iterator:
    """(id, root) of the links of one task."""
    import pyarrow as pa

    got = list(frames)
    u, v = (np.concatenate([np.zeros(0, np.int64), *(b.column(k).to_numpy() for b in got)]) for k in (0, 1))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = ids[labels(len(ids), at[: len(u)], at[len(u) :])] if len(ids) else ids
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(root, pa.int64())], ["id", "root"])


def components(edges: DataFrame, spark: SparkSession, at_once: int = 200_000) -> DataFrame:
    """(id, root) for every id of ``edges(a, b)``: root is the smallest id reachable.

    Up to ``at_once`` links one task joins.  Beyond, the large-star and the small-star step alternate until no
    edge changes.  Each step is a minimum per node (partial aggregates, so hubs cost nothing) and a join on
    the node; each round is written to the shared folder, so the plan stays short and lost executors cost one
    round.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct(), "edges")
    mark = _mark(e)
    if mark[0] <= at_once:
        return e.coalesce(1).mapInArrow(_stars, "id long, root long")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = stored(small.where("u <> v").distinct(), "edges")
        forget(e)
        e, was, mark = new, mark, _mark(new)
        if mark == was:
            break
    # a star for each component: each id has one edge, to its root
    out = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
    return out.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def sorted_groups(frames: Iterator, keys: list[str], least: int = 1) -> Iterator:
    """Arrow tables of the rows that share ``keys``, from batches in which such rows follow each other; groups of fewer than ``least`` rows are passed over."""
    import pyarrow as pa

    held: list = []
    held_key = None
    for batch in frames:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)) for k in keys]
        cut = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            cut[1:] |= c[1:] != c[:-1]
        edges = np.concatenate([[0], np.flatnonzero(cut), [batch.num_rows]])
        sizes = np.diff(edges)
        want = sizes >= least
        want[0] = want[-1] = True  # may go on in the batch before or after
        for a, n in zip(edges[:-1][want].tolist(), sizes[want].tolist(), strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != held_key:
                if sum(h.num_rows for h in held) >= least:
                    yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(a, n))
    if held and sum(h.num_rows for h in held) >= least:
        yield pa.Table.from_batches(held)


def block_pairs(rows: DataFrame, key: str, member: str, size: str, block: int, room: int) -> DataFrame:
    """Deals ``rows(key, member, band, alike, size, ...)`` so that any two rows of a key that may have to meet share a group (key, i, j).

    Two rows have to meet unless their bands differ by more than one or both are ``alike``.  A key of up to
    ``block`` rows and ``room`` in sizes is one group, in which all meet.  Beyond (``split``), rows go by a hash in blocks
    of their band and ``alike``, and each pair of blocks is a group.  ``own`` says on which side a row is.
    """
    whole = stored(rows.groupBy(key).agg(((F.count("*") > block) | (F.sum(size) > room)).alias("split")), "groups")
    few = whole.count() <= 500_000
    told = rows.join(F.broadcast(whole) if few else whole, key)
    told = told.withColumn("cell", F.when(F.col("split"), 2 * F.col("band").cast("long") + F.col("alike").cast("long")).otherwise(0))
    parts = F.greatest(F.lit(1), F.ceil(F.greatest(F.count("*") / block, F.sum(size) / room))).cast("long")
    cells = told.where("split").groupBy(key, "cell").agg(parts.alias("parts"))
    cells = stored(cells.groupBy(key).agg(F.collect_list(F.struct("cell", "parts")).alias("cells")), "cells")  # a few per band
    few = cells.count() <= 100_000
    m = told.join(F.broadcast(cells) if few else cells, key, "left")
    mine = F.element_at(F.filter("cells", lambda c: c["cell"] == F.col("cell")), 1)["parts"]
    own = F.when(F.col("split"), F.col("cell") * (1 << 31) + F.pmod(F.xxhash64(member), mine)).otherwise(F.lit(0).cast("long"))
    meets = F.filter("cells", lambda c: (F.abs(F.floor(c["cell"] / 2) - F.floor(F.col("cell") / 2)) <= 1) & ~((c["cell"] % 2 == 1) & (F.col("cell") % 2 == 1)))
    others = F.when(F.col("split"), F.flatten(F.transform(meets, lambda c: F.sequence(c["cell"] * (1 << 31), c["cell"] * (1 << 31) + c["parts"] - 1)))).otherwise(F.array(F.lit(0).cast("long")))
    m = m.withColumn("own", own).withColumn("other", F.explode(others))
    m = m.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("band", "alike", "cell", "cells", "other", "split", *([size] if size != member else []))
    return m.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", member)


def vector_matrix(column, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, matrix in double) of an Arrow list column: those of the given or their common length without null or non-finite components."""
    import pyarrow as pa

    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(col)
    offsets = np.asarray(col.offsets)
    lens = np.diff(offsets)
    ok = ~np.asarray(col.is_null()) & (lens > 0)
    flat = np.asarray(col.values.to_numpy(zero_copy_only=False), dtype=np.float64)
    bad = ~np.isfinite(flat)
    if bad.any():
        sums = np.concatenate([[0], np.cumsum(bad)])
        ok &= (sums[offsets[1:]] - sums[offsets[:-1]]) == 0
    if dim is not None:
        ok &= lens == dim
    rows = np.flatnonzero(ok)
    if not n or not len(rows):
        return rows[:0], np.zeros((0, dim or 0))
    d = int(lens[rows[0]])
    rows = rows[lens[rows] == d]
    return rows, flat[offsets[rows][:, None] + np.arange(d)]
