"""Exact top-k search by vector-approximation files.

Vectors are stored twice: exact, and as one byte per component, the number of its cell.  A scan of the cells
bounds every score from both sides; a row can only be among the first k if its upper bound reaches the kth
best lower bound of all rows.  The exact vectors of those rows are then read in the order of their upper
bounds until the kth score is certain.

Scale: the scan reads a quarter of the bytes, shuffles only rows that may win, and meets the queries in
chunks of fixed size, which are what is broadcast.  More queries mean more chunks, each one scan of the cells;
the exact vectors are read once for all chunks, and only those of rows that may win are shuffled.  Of equal
vectors only the k + 1 with the smallest ids can win, so copies cost nothing further.  A query with many rows
left is read in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, lean, ship_code, stored, vector_matrix

CELLS = 256
BIG = float(1 << 61)


def packed(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, dim, v (packed 64-bit integers, floor(scale * x)) of the rows with whole, finite vectors."""

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            lens = np.diff(np.asarray(batch.column(1).offsets)) if batch.num_rows else np.zeros(0, int)
            for d in sorted(set(lens.tolist()) - {0}):
                rows, m = vector_matrix(batch.column(1), d)
                ints = np.clip(np.floor(m * scale), -BIG, BIG).astype("<i8")
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([d] * len(rows), pa.int32()), pa.array([r.tobytes() for r in ints], pa.binary())], ["vec_id", "dim", "v"])

    return vectors.where("vec_id is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(lean(pack), "vec_id long, dim int, v binary")


def ranges(exact: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Least and greatest value of each component, by dimension: as many numbers as there are components."""

    def partial(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in frames:
            for d, m in matrices(batch):
                a, b = m.min(axis=0), m.max(axis=0)
                if d in low:
                    a, b = np.minimum(a, low[d][0]), np.maximum(b, low[d][1])
                low[d] = a, b
        rows = [(d, k, int(a[k]), int(b[k])) for d, (a, b) in low.items() for k in range(d)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 4)], ["dim", "at", "low", "high"])

    got = exact.mapInArrow(lean(partial), "dim long, at long, low long, high long").groupBy("dim", "at").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    out = {}
    for d in {r["dim"] for r in got}:
        rows = sorted((r["at"], r["low"], r["high"]) for r in got if r["dim"] == d)
        out[d] = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    return out


def matrices(batch: pa.RecordBatch, dtype: str = "<i8") -> Iterator[tuple[int, np.ndarray]]:
    """(dim, matrix) of the packed column ``v``, rows in order within each dimension."""
    dims = np.asarray(batch.column(batch.schema.get_field_index("dim")))
    col = batch.column(batch.schema.get_field_index("v"))
    for d in sorted(set(dims.tolist())):
        rows = col.filter(pa.array(dims == d)).to_pylist()
        yield d, np.frombuffer(b"".join(rows), dtype=dtype).reshape(len(rows), d)


def cell_width(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whole-number cell widths that cover low .. high with ``CELLS`` cells."""
    return np.maximum(1, -(-(high.astype(object) - low + 1) // CELLS)).astype(np.float64)


def approximations(exact: DataFrame, bounds: dict) -> DataFrame:
    """vec_id, dim, v: a byte per component."""

    def code(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            dims = np.asarray(batch.column(1))
            for d, m in matrices(batch):
                low, high = bounds[d]
                cells = np.minimum((m - low) // cell_width(low, high), CELLS - 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(dims == d)), pa.array([d] * len(m), pa.int32()), pa.array([r.tobytes() for r in cells], pa.binary())], ["vec_id", "dim", "v"])

    return exact.mapInArrow(lean(code), "vec_id long, dim int, v binary")


def scan(cells: DataFrame, bounds: dict, queries, k: int) -> DataFrame:
    """query_id, vec_id, lower, upper of the rows that may be among the first k of a query, as far as one task can tell."""

    def bound(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = {}
        for d, (ids, q) in queries.value.items():
            low, high = bounds[d]
            width = cell_width(low, high)
            q = q.astype(np.float64)
            # a cell holds whole numbers start .. start + width - 1: its middle, and half of what it spans
            slack = np.abs(q) @ ((width - 1) / 2)
            slack = slack + 1 + 1e-9 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).astype(np.float64))
            plan[d] = ids, q, low + (width - 1) / 2, width, slack
        kth = {d: np.full((len(p[0]), k), -np.inf) for d, p in plan.items()}
        held: list[tuple] = []
        for batch in frames:
            dims, ids = np.asarray(batch.column(1)), np.asarray(batch.column(0))
            for d, codes in matrices(batch, np.uint8):
                if d not in plan:
                    continue
                qids, q, mid, width, slack = plan[d]
                vec = ids[dims == d]
                for at in range(0, len(vec), 4096):
                    v, c = vec[at : at + 4096], codes[at : at + 4096]
                    score = q @ (c * width + mid).T
                    lower = np.where(v[None, :] == qids[:, None], -np.inf, score - slack[:, None])
                    best = np.concatenate([kth[d], lower], axis=1)
                    kth[d] = np.partition(best, best.shape[1] - k, axis=1)[:, -k:]
                    upper = lower + 2 * slack[:, None]
                    i, j = np.nonzero((upper >= kth[d].min(axis=1)[:, None]) & np.isfinite(lower))
                    held.append((d, i, v[j], lower[i, j], upper[i, j]))
            if sum(len(h[1]) for h in held) > 200_000:
                held = list(_still(held, kth))
        for d, i, v, lo, up in _still(held, kth):
            yield pa.RecordBatch.from_arrays([pa.array(plan[d][0][i]), pa.array(v), pa.array(lo), pa.array(up)], ["query_id", "vec_id", "lower", "upper"])

    return cells.mapInArrow(lean(bound), "query_id long, vec_id long, lower double, upper double")


def _still(held: list[tuple], kth: dict) -> Iterator[tuple]:
    for d in sorted({h[0] for h in held}):
        i, v, lo, up = (np.concatenate([h[x] for h in held if h[0] == d]) for x in (1, 2, 3, 4))
        ok = up >= kth[d].min(axis=1)[i]
        yield d, i[ok], v[ok], lo[ok], up[ok]


def candidates(exact: DataFrame, k: int, broadcast_rows: int = 500_000) -> DataFrame:
    """vec_id, dim, v, times: the rows of ``exact`` that may be among the first k of some query; ``times`` says how often a row occurs.

    Only ids and hashes of vectors are shuffled, and the vectors of repeated rows.
    """
    named = exact.select("vec_id", "dim", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v", F.octet_length("v")).alias("g"), "v")
    own = ["vec_id", "dim", "h", "g"]
    ids = stored(named.groupBy(*own).agg(F.count("*").alias("times")), "ids")
    repeated = stored(ids.where("times > 1"), "repeated")
    if not repeated.isEmpty():
        few = repeated.count() <= broadcast_rows
        again = F.broadcast(repeated) if few else repeated
        once = named.join(again.select(*own), own, "left_anti").withColumn("times", F.lit(1).cast("long"))
        named = once.unionByName(named.join(again, own).groupBy(*own).agg(F.first("v").alias("v"), F.first("times").alias("times")))
    else:
        named = named.withColumn("times", F.lit(1).cast("long"))
    # the id beyond which a vector's copies can't win: k others are before it even where the query is one of them
    crowded = stored(ids.groupBy("dim", "h", "g").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("dim", "h", "g"), "crowded")
    if not crowded.isEmpty():
        few = crowded.count() <= broadcast_rows
        place = F.row_number().over(Window.partitionBy("dim", "h", "g").orderBy("vec_id"))
        first = ids.join(F.broadcast(crowded) if few else crowded, ["dim", "h", "g"]).withColumn("place", place).where(F.col("place") <= k + 1)
        last = stored(first.groupBy("dim", "h", "g").agg(F.max("vec_id").alias("last")), "last")
        named = named.join(F.broadcast(last) if few else last, ["dim", "h", "g"], "left").where(F.col("last").isNull() | (F.col("vec_id") <= F.col("last")))
    return named.select("vec_id", "dim", "v", F.least("times", F.lit(k)).alias("times"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, chunk: int = 4096, part: int = 8192, broadcast_rows: int = 2_000_000) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of floor(scale * x) for each row of ``vectors(vec_id, embedding)`` that ``is_query`` selects.

    Vectors that are null, empty or hold null or non-finite components take no part; nor do rows without a
    vec_id.  Vectors of different lengths don't meet.  A query's own rows are those of its vec_id.  Ties go
    to the smaller vec_id.  Repeated rows are candidates each; as queries they count once.  ``chunk``, ``part`` and
    ``broadcast_rows`` bound what a task holds, never the result.
    """
    spark = vectors.sparkSession
    ship_code(spark)
    exact = stored(packed(vectors, scale), "exact")
    asked = exact.where(is_query).groupBy("vec_id").agg(F.min_by(F.struct("dim", "v"), F.struct("dim", "v")).alias("q")).select("vec_id", "q.dim", "q.v")
    asked = stored(asked, "queries")
    exact = stored(candidates(exact, k), "candidates")
    bounds = ranges(exact)
    cells = stored(approximations(exact, bounds), "cells")
    chunks = max(1, -(-asked.count() // chunk))
    left, held = [], []
    for c in range(chunks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).collect()  # about ``chunk`` rows
        by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in sorted({r["dim"] for r in rows}):
            own = sorted((r["vec_id"], bytes(r["v"])) for r in rows if r["dim"] == d)
            by_dim[d] = np.array([x[0] for x in own], dtype=np.int64), np.frombuffer(b"".join(x[1] for x in own), dtype="<i8").reshape(len(own), d)
        held.append(spark.sparkContext.broadcast(by_dim))
        may = stored(scan(cells, bounds, held[-1], k), "bounds")
        # the kth best lower bound of all tasks' rows; tasks pass on their first k
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lower"), "vec_id"))
        kth = may.withColumn("place", place).where(F.col("place") <= k).groupBy("query_id").agg(F.min("lower").alias("kth"), F.count("*").alias("n"))
        sizes = stored(may.join(kth, "query_id").where((F.col("n") < k) | (F.col("upper") >= F.col("kth"))).groupBy("query_id", "vec_id").agg(F.max("upper").alias("upper")), "left")
        parts = sizes.groupBy("query_id").agg(F.ceil(F.count("*") / part).alias("parts"))
        left.append(stored(sizes.join(parts, "query_id").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).drop("parts"), "left"))
        forget(may)
        forget(sizes)
    ids = left[0].select("vec_id")
    for more in left[1:]:
        ids = ids.unionByName(more.select("vec_id"))
    ids = stored(ids.distinct(), "wanted")
    few = ids.count() <= broadcast_rows
    read = stored(exact.join(F.broadcast(ids) if few else ids, "vec_id", "left_semi").select("vec_id", "v", "times"), "read")
    results = []
    for rows, queries in zip(left, held, strict=True):
        best = rows.join(read, "vec_id").groupBy("query_id", "part").applyInArrow(_certain(queries, k), "query_id long, vec_id long, score long")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        results.append(stored(best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest"))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def _certain(queries, k: int):
    """Reads a query's rows by falling upper bound until no further one can be among the first k."""

    def read(key: tuple, table: pa.Table) -> pa.Table:
        qid = key[0].as_py()
        q = next(m[np.flatnonzero(ids == qid)[0]] for ids, m in queries.value.values() if (ids == qid).any())
        upper, ids, times = table["upper"].to_numpy(), table["vec_id"].to_numpy(), table["times"].to_numpy()
        order, vectors = np.lexsort((ids, -upper)), table["v"]
        safe = float(np.abs(q.astype(np.float64)).max(initial=0))
        best: list[tuple[int, int]] = []  # (-score, vec_id), ascending
        for at in range(0, len(order), k):
            if len(best) == k and upper[order[at]] < -best[-1][0]:
                break  # nothing further can reach the kth score
            part = order[at : at + k]
            m = np.frombuffer(b"".join(vectors[int(i)].as_py() for i in part), dtype="<i8").reshape(len(part), len(q))
            if safe * float(np.abs(m.astype(np.float64)).max(initial=0)) * len(q) < 2**62:
                s = (m @ q).tolist()
            else:  # whole numbers beyond 64 bits; the result is held within them
                s = [max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(r, q, strict=True)))) for r in m]
            best = sorted([*best, *((-x, int(ids[i])) for x, i in zip(s, part, strict=True) for _ in range(int(times[i])))])[:k]
        return pa.table({"query_id": pa.array([qid] * len(best), pa.int64()), "vec_id": pa.array([b[1] for b in best], pa.int64()), "score": pa.array([-b[0] for b in best], pa.int64())})

    return read


def op1_vector_approximation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 greatest integer inner products of every vector whose vec_id is divisible by 100 with all other vectors."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
