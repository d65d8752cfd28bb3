"""Near-duplicate embeddings by sorted projection passes.

Each pass hashes a vector to the signs of random projections and orders the vectors of a label by the
concatenated signs, so near vectors share a long prefix and stand close; each vector is compared with the
next ``window``.  Verified pairs of all passes are united.  Equal vectors are one vector with a weight.

A pass carries a byte per component and the length of the error that leaves, which bounds the cosine from both
sides; pairs that the bounds don't decide are verified with the exact vectors, unless decided ones join them.

The windows are bounded, so they find the components, not every pair in a dense one: links are then counted
by block products inside each component, which miss no pair of it, whatever its size.  The angle to the
component's first vector spares most of them: vectors within half the linking angle all link with each other,
and vectors whose angles differ by more than the linking angle never do.

Scale: a pass is a range partitioning of distinct vectors, cut evenly however many share a label or a
neighbourhood.  Exact vectors cross the network for equal vectors, undecided pairs and members of components.
Components are found by joins.  A large component is split in blocks; a task holds two blocks and emits one
count per vector, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block_pairs, components, lean, ship_code, sorted_groups, stored, vector_matrix

LINKS = "a long, b long, sure boolean"


def usable(vectors: DataFrame, kind: str) -> DataFrame:
    """vec_id, label, v (components packed as ``kind``) of the rows whose vectors may link."""

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            lens = np.diff(np.asarray(batch.column(2).offsets)) if batch.num_rows else np.zeros(0, int)
            for d in sorted(set(lens.tolist()) - {0}):
                rows, m = vector_matrix(batch.column(2), d)
                ok = np.abs(m).max(axis=1, initial=0) > 0
                rows, m = pa.array(rows[ok]), m[ok] + 0.0  # no negative zero
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([r.tobytes() for r in m.astype(kind)], pa.binary())], ["vec_id", "label", "v"])

    return vectors.where("label is not null and vec_id is not null").select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(lean(pack), "vec_id long, label string, v binary")


def unit(rows: list[bytes], kind: str) -> np.ndarray:
    m = np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), -1).astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # lengths beyond the range of doubles
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def by_length(rows: list[bytes]) -> Iterator[np.ndarray]:
    lens = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    for n in np.unique(lens):
        yield np.flatnonzero(lens == n)


def passes(classes: DataFrame, kind: str, count: int, bits: int, seed: int) -> DataFrame:
    """rep, label, pass, key, code, step, error: the packed signs of ``bits`` random projections, different in each pass, and the unit vector in bytes of ``step`` with the length of its error."""

    def hashed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in frames:
            rows = batch.column(2).to_pylist()
            for part in by_length(rows):
                m = unit([rows[i] for i in part], kind)
                d = m.shape[1]
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((count, bits, d))
                step = (np.abs(m).max(axis=1) / 127).astype(np.float32)
                code = np.rint(m / step[:, None].astype(np.float64)).astype(np.int8)
                error = np.sqrt(((m - code * step[:, None].astype(np.float64)) ** 2).sum(axis=1)).astype(np.float32)
                take = pa.array(part)
                same = [batch.column(0).take(take), batch.column(1).take(take)]
                told = [pa.array([r.tobytes() for r in code], pa.binary()), pa.array(step), pa.array(error)]
                for p in range(count):
                    signs = np.packbits(m @ planes[d][p].T > 0, axis=1)
                    yield pa.RecordBatch.from_arrays([*same, pa.array([p] * len(part), pa.int8()), pa.array([r.tobytes() for r in signs], pa.binary()), *told], ["rep", "label", "pass", "key", "code", "step", "error"])

    return classes.select("rep", "label", "v").mapInArrow(lean(hashed), "rep long, label string, pass byte, key binary, code binary, step float, error float")


def window_links(ordered: DataFrame, window: int, least: float) -> DataFrame:
    """(a, b, sure) of neighbours within ``window`` places whose cosine is, or may be, at least ``least``, but for pairs that runs of sure ones join anyway."""

    def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[tuple] = []
        for batch in frames:
            rows = carry + list(zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True))
            for a, b, sure in _near(rows, window, least):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure, pa.bool_())], ["a", "b", "sure"])
            carry = rows[-window:]

    return ordered.select("rep", "label", "pass", "code", "step", "error").mapInArrow(lean(compare), LINKS)


def _near(rows: list[tuple], window: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    ids = np.array([r[0] for r in rows], dtype=np.int64)
    for part in by_length([r[3] for r in rows]):
        codes = np.frombuffer(b"".join(rows[i][3] for i in part), np.int8).reshape(len(part), -1)
        m = codes.astype(np.float32) * np.array([rows[i][4] for i in part], np.float32)[:, None]
        # the error's length, and what rounding to single precision adds
        error = np.array([rows[i][5] for i in part], np.float64) * (1 + 1e-6) + 1.2e-7 * (codes.shape[1] + 4)
        numbers: dict = {}
        group = np.array([numbers.setdefault((rows[i][1], rows[i][2]), len(numbers)) for i in part])
        own = ids[part]
        run = np.zeros(len(part), dtype=np.int64)
        for off in range(1, min(window, len(part) - 1) + 1):
            cosine, slack = np.einsum("ij,ij->i", m[:-off], m[off:]).astype(np.float64), error[:-off] + (1 + error[:-off]) * error[off:]
            near = (cosine + slack >= least) & (group[:-off] == group[off:])
            sure = near & (cosine - slack >= least)
            if off == 1:
                run[1:] = np.cumsum(~sure)
            else:
                near &= run[:-off] != run[off:]
            if near.any():
                yield own[:-off][near], own[off:][near], sure[near]


def verified(pairs: DataFrame, classes: DataFrame, kind: str, least: float) -> DataFrame:
    """(a, b) of ``pairs`` with cosine of at least ``least`` in double precision."""

    def keep(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            x, y, close = batch.column(2).to_pylist(), batch.column(3).to_pylist(), np.zeros(batch.num_rows, bool)
            for part in by_length(x):
                close[part] = np.einsum("ij,ij->i", unit([x[i] for i in part], kind), unit([y[i] for i in part], kind)) >= least
            take = pa.array(np.flatnonzero(close))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], ["a", "b"])

    left = pairs.select("a", "b").join(classes.select(F.col("rep").alias("a"), F.col("v").alias("x")), "a")
    return left.join(classes.select(F.col("rep").alias("b"), F.col("v").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(lean(keep), "a long, b long")


def angles(members: DataFrame, kind: str, least: float) -> DataFrame:
    """``members(root, rep, weight, v, pivot)`` with band and alike: the angle to the pivot in linking angles, and whether it is within half of one."""
    turn = float(np.arccos(np.clip(least, -1, 1)))

    def tell(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            v, pivot, angle = batch.column(3).to_pylist(), batch.column(4).to_pylist(), np.zeros(batch.num_rows)
            for part in by_length(v):
                angle[part] = np.arccos(np.clip(np.einsum("ij,ij->i", unit([v[i] for i in part], kind), unit([pivot[i] for i in part], kind)), -1, 1))
            band = np.floor(angle / (turn * 1.0001 + 1e-6)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(band), pa.array(angle <= turn / 2 - 1e-6)], ["root", "rep", "weight", "v", "band", "alike"])

    return members.select("root", "rep", "weight", "v", "pivot").mapInArrow(lean(tell), "root long, rep long, weight long, v binary, band long, alike boolean")


def count_links(members: DataFrame, kind: str, least: float, block: int = 4096) -> DataFrame:
    """rep, n: the weight of the other vectors with cosine of at least ``least``, in ``members(root, rep, weight, v, band, alike)``."""

    def product(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for t in sorted_groups(frames, ["root", "i", "j"]):
            i, j = t["i"][0].as_py(), t["j"][0].as_py()
            own, rep, weight, rows = t["own"].to_numpy(), t["rep"].to_numpy(), t["weight"].to_numpy(), t["v"].to_pylist()
            for part in by_length(rows):
                x = unit([rows[k] for k in part], kind)
                left, right = np.flatnonzero(own[part] == i), np.flatnonzero(own[part] == j)
                back = np.zeros(len(right), np.int64)
                for at in range(0, len(left), 512):
                    p = left[at : at + 512]
                    cosine = x[p] @ x[right].T
                    near = cosine >= least
                    # rounding may differ between a product of matrices and one of two vectors: decide close calls by the latter
                    for a, b in np.argwhere(np.abs(cosine - least) < 1e-12):
                        near[a, b] = float((x[p[a]] * x[right[b]]).sum()) >= least
                    if i == j:
                        near[np.arange(len(p)), np.arange(at, at + len(p))] = False
                    out.extend(zip(rep[part[p]].tolist(), (near @ weight[part[right]]).tolist(), strict=True))
                    back += near.T @ weight[part[p]]
                if i != j:
                    out.extend(zip(rep[part[right]].tolist(), back.tolist(), strict=True))
            if len(out) > 50_000:
                yield _counts(out)
                out = []
        yield _counts(out)

    met = block_pairs(members.withColumn("size", F.lit(1)), "root", "rep", "size", block, block).mapInArrow(lean(product), "rep long, n long")
    # in a component of several blocks, alike vectors have not met: they all link
    many = members.groupBy("root").agg(F.count("*").alias("k"), F.sum(F.when(F.col("alike"), F.col("weight"))).alias("total")).where(F.col("k") > block).select("root", "total")
    many = stored(many, "many")
    few = many.count() <= 500_000
    sure = members.where("alike").select("root", "rep", "weight").join(F.broadcast(many) if few else many, "root").select("rep", (F.col("total") - F.col("weight")).alias("n"))
    return met.unionByName(sure).groupBy("rep").agg(F.sum("n").alias("n"))


def _counts(out: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["rep", "n"])


def near_duplicates(vectors: DataFrame, least: float = 0.98, count: int = 8, window: int = 32, bits: int = 40, seed: int = 7, block: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors(vec_id, embedding, label)``.

    Rows with a null label, or a vector that is null, zero or not finite, have no links and are kept; so are
    rows without a vec_id (component null).  Vectors of different lengths don't link.  Repeated rows link
    with each other.  ``block`` bounds a task's work, never the result.
    """
    spark = vectors.sparkSession
    ship_code(spark)
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    rows = stored(usable(vectors, kind), "vectors")
    named = [F.xxhash64("label", "v").alias("h"), F.xxhash64(F.lit(1), "v", "label").alias("g")]
    classes = stored(rows.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).select("*", *named), "classes")
    ordered = passes(classes, kind, count, bits, seed)
    ordered = ordered.repartitionByRange("pass", "label", "key", "rep").sortWithinPartitions("pass", "label", "key", "rep")
    links = stored(window_links(ordered, window, least).distinct(), "links")
    sure = links.where("sure").select("a", "b")
    joined = stored(components(sure, spark), "roots")
    rooted = links.where("not sure")
    for x in ("a", "b"):
        rooted = rooted.join(joined.select(F.col("id").alias(x), F.col("root").alias(f"r{x}")), x, "left").withColumn(f"r{x}", F.coalesce(f"r{x}", x))
    open_ = stored(rooted.where("ra <> rb").select("a", "b").distinct(), "undecided")
    if open_.isEmpty():
        roots = joined.select(F.col("id").alias("rep"), "root")
    else:
        more = stored(verified(open_, classes, kind, least), "verified")
        roots = stored(components(sure.unionByName(more), spark), "roots").select(F.col("id").alias("rep"), "root")
    pivots = classes.join(roots.select(F.col("root").alias("rep")).distinct(), "rep", "left_semi").select(F.col("rep").alias("root"), F.col("v").alias("pivot"))
    members = stored(angles(classes.join(roots, "rep").join(pivots, "root"), kind, least), "members")
    counts = count_links(members, kind, least, block)
    found = classes.select("rep", "h", "g", "weight").join(roots, "rep", "left").join(counts, "rep", "left")
    found = found.select("h", "g", F.coalesce("root", "rep").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    mine = rows.select("vec_id", *named).join(found, ["h", "g"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("root").alias("component_id"))
    out = vectors.select("vec_id").join(mine, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))


def op5_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all embeddings within their labels; see ``near_duplicates``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
