"""Hard-negative mining over a pivot table.

Vectors get one more component, sqrt(M² - |x|²), and queries a zero: then |q - x|² = |q|² + M² - 2 q·x, and a larger
inner product is a smaller distance.  The table stores each row's distances to a few pivots.  By the triangle
inequality they bracket the distance to any query, and so the score; only rows whose bracket meets what a query
still looks for have their exact score taken.

Rows lie in layers by their length, each with an M of its own (a power of two), so one long vector doesn't loosen
the brackets of all others.  The table is ordered by layer, nearest pivot and distance: rows of a block are
alike, and one bracket for the block spares most blocks that of its rows.

Scale: the vectors are shuffled once, into that order; copies spread by vec_id.  Anchors meet the table in chunks
of fixed size, which are what is broadcast: a scan for their positives, and one for the negatives between the bounds
that the positives set.  A task passes on the first few rows per anchor and bound, so what is shuffled doesn't
grow with the rows of a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, lean, run_dir, ship_code, stored, vector_matrix

BIG = float(1 << 61)
LEAST, MOST = -(1 << 63), (1 << 63) - 1
BLOCK, TOGETHER = 2048, 256


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, dim, v (packed 64-bit integers, floor(scale * x)) of the rows that take part."""

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            lens = np.diff(np.asarray(batch.column(2).offsets)) if batch.num_rows else np.zeros(0, int)
            for d in sorted(set(lens.tolist()) - {0}):
                rows, m = vector_matrix(batch.column(2), d)
                ints, at = np.clip(np.floor(m * scale), -BIG, BIG).astype("<i8"), pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([d] * len(rows), pa.int32()), pa.array([r.tobytes() for r in ints], pa.binary())], ["vec_id", "label", "dim", "v"])

    rows = vectors.where("vec_id is not null and label is not null").select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(lean(pack), "vec_id long, label long, dim int, v binary")


def once(rows: DataFrame) -> DataFrame:
    """One row for each vec_id: of those that share one, the first by label and vector.  Only ids are shuffled, and repeated rows."""
    repeated = stored(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated")
    if repeated.isEmpty():
        return rows
    again = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "dim", "v")).alias("r")).select("vec_id", "r.*")
    return rows.join(repeated, "vec_id", "left_anti").unionByName(again)


def numbers(column, d: int) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), d)


def choose_pivots(rows: DataFrame, n: int, sample: int) -> dict[int, np.ndarray]:
    """``n`` vectors of each dimension that lie far apart among ``sample`` rows by hash of vec_id.  They decide what is spared, never the result."""
    drawn: dict[int, list[bytes]] = {}
    for r in rows.select("dim", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect():
        drawn.setdefault(r["dim"], []).append(bytes(r["v"]))
    out = {}
    for d, vs in drawn.items():
        m = np.frombuffer(b"".join(vs), "<i8").reshape(len(vs), d).astype(np.float64)
        picked, away = [0], np.full(len(m), np.inf)
        for _ in range(min(n, len(m)) - 1):
            away = np.minimum(away, ((m - m[picked[-1]]) ** 2).sum(axis=1))
            picked.append(int(away.argmax()))
        out[d] = m[picked]
    return out


def layer_of(m: np.ndarray) -> np.ndarray:
    """The power of two that is at least a vector's length."""
    return np.ceil(np.log2(np.maximum(np.sqrt((m * m).sum(axis=1)), 1)) + 1e-9).astype(np.int64)


def reach(m: np.ndarray, pivots: np.ndarray, layer: int, query: bool) -> np.ndarray:
    """Distances of rows, or queries, to the pivots in a layer's space."""
    most = 4.0**layer
    last = np.sqrt(np.maximum(0, most - (pivots * pivots).sum(axis=1)))
    own = np.zeros(len(m)) if query else np.sqrt(np.maximum(0, most - (m * m).sum(axis=1)))
    out = np.empty((len(m), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((m - p) ** 2).sum(axis=1) + (own - last[j]) ** 2)
    return out


def pivot_table(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` with their layer, distances to the pivots (packed), nearest pivot and distance to it, in that order."""

    def add(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            dims = np.asarray(batch.column(2))
            for d in sorted(set(dims.tolist())):
                own = batch.filter(pa.array(dims == d))
                m = numbers(own.column(3), d).astype(np.float64)
                layers, far = layer_of(m), np.empty((len(m), len(pivots.get(d, np.zeros((1, d))))))
                for e in sorted(set(layers.tolist())):
                    far[layers == e] = reach(m[layers == e], pivots.get(d, np.zeros((1, d))), e, False)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(layers), pa.array(far.argmin(axis=1)), pa.array(far.min(axis=1)), pa.array([r.tobytes() for r in far], pa.binary())], ["vec_id", "label", "dim", "v", "layer", "nearest", "near", "far"])

    order = ["dim", "layer", "nearest", "near", "vec_id"]
    table = rows.select("vec_id", "label", "dim", "v").mapInArrow(lean(add), "vec_id long, label long, dim int, v binary, layer long, nearest long, near double, far binary")
    return stored(table.repartitionByRange(*order).sortWithinPartitions(*order), "pivots")


class Search:
    """The first ``k`` rows per slot that a task has seen.  A slot of an anchor is a range low .. high of scores.

    ``same``: rows of the anchor's label are looked for, else those of others.
    """

    def __init__(self, asked: tuple, pivots: np.ndarray, k: int, same: bool):
        self.ids, self.label, self.v, self.low, self.high = asked
        self.q = self.v.astype(np.float64)
        self.norm = (self.q * self.q).sum(axis=1)
        self.pivots, self.k, self.same = pivots, k, same
        self.far: dict[int, np.ndarray] = {}
        self.kth = np.full(self.low.shape, LEAST)
        self.best: list[np.ndarray] = [np.zeros((4, 0), np.int64)]  # anchor, slot, score, vec_id
        self.new = 0
        self.largest = float(np.abs(self.q).max(initial=0))

    def bracket(self, at: np.ndarray, layer: int, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of anchors ``at`` with rows whose distances lie in least .. most (rows x pivots)."""
        if layer not in self.far:
            self.far[layer] = reach(self.q, self.pivots, layer, True)
        far, near, wide = self.far[layer][at], np.zeros((len(at), len(least))), np.full((len(at), len(least)), np.inf)
        for j in range(far.shape[1]):
            f = far[:, j, None]
            np.maximum(near, f - most[None, :, j], out=near)
            np.maximum(near, least[None, :, j] - f, out=near)
            np.minimum(wide, f + most[None, :, j], out=wide)
        total = (self.norm[at] + 4.0**layer)[:, None]
        slack = 1 + 1e-9 * total
        return (total - wide * wide) / 2 - slack, (total - near * near) / 2 + slack

    def block(self, layer: int, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, far: np.ndarray) -> None:
        want = np.maximum(self.low, self.kth)
        open_ = want <= self.high
        floor = np.where(open_, want, MOST).min(axis=1).astype(np.float64)
        ceiling = np.where(open_, self.high, LEAST).max(axis=1).astype(np.float64)
        live = np.flatnonzero(open_.any(axis=1))
        if len(live):
            low, high = self.bracket(live, layer, far.min(axis=0)[None], far.max(axis=0)[None])
            live = live[(high[:, 0] >= floor[live]) & (low[:, 0] <= ceiling[live])]
        x, large = v.astype(np.float64), float(np.abs(v.astype(np.float64)).max(initial=0))
        for a in range(0, len(live), TOGETHER):
            at = live[a : a + TOGETHER]
            low, high = self.bracket(at, layer, far, far)
            may = (high >= floor[at, None]) & (low <= ceiling[at, None]) & ((labels[None, :] == self.label[at, None]) == self.same) & (ids[None, :] != self.ids[at, None])
            if may.any():
                self.take(at, may, ids, x, v, self.largest * large * v.shape[1])
        if self.new > 20_000:
            self.settle()

    def take(self, at: np.ndarray, may: np.ndarray, ids: np.ndarray, x: np.ndarray, v: np.ndarray, size: float) -> None:
        """Exact scores of the pairs that may count."""
        i, j = np.nonzero(may)
        if size < 2.0**53:  # products and sums of whole numbers are exact
            s = (self.q[at] @ x.T)[i, j] if len(i) * 20 > may.size else np.einsum("ij,ij->i", self.q[at[i]], x[j])
            s = np.rint(s).astype(np.int64)
        else:  # whole numbers beyond 64 bits are held within them
            s = np.array([max(LEAST, min(MOST, sum(int(a) * int(b) for a, b in zip(self.v[at[p]], v[r], strict=True)))) for p, r in zip(i, j, strict=True)], np.int64)
        for slot in range(self.low.shape[1]):
            a = at[i]
            ok = (s >= self.low[a, slot]) & (s <= self.high[a, slot]) & (s >= self.kth[a, slot])
            if ok.any():
                self.best.append(self.first(np.stack([a[ok], np.full(int(ok.sum()), slot), s[ok], ids[j[ok]]])))
                self.new += self.best[-1].shape[1]

    def first(self, rows: np.ndarray) -> np.ndarray:
        """The first ``k`` of each slot: higher scores first, then smaller vec_ids."""
        rows = rows[:, np.lexsort((rows[3], ~rows[2], rows[1], rows[0]))]
        new = np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)]) if rows.shape[1] else np.zeros(0, bool)
        start = np.flatnonzero(new)
        place = np.arange(rows.shape[1]) - np.repeat(start, np.diff(np.append(start, rows.shape[1])))
        return rows[:, place < self.k]

    def settle(self) -> None:
        best = self.first(np.concatenate(self.best, axis=1))
        self.best, self.new = [best], 0
        full = np.flatnonzero((best[:2, self.k - 1 :] == best[:2, : best.shape[1] - self.k + 1]).all(axis=0)) + self.k - 1 if best.shape[1] >= self.k else np.zeros(0, int)
        self.kth[best[0, full], best[1, full]] = best[2, full]


def scan(table: DataFrame, asked, pivots: dict, k: int, same: bool) -> DataFrame:
    """anchor_id, slot, vec_id, score: of each task, the first ``k`` rows per slot."""

    def look(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {d: Search(a, pivots.get(d, np.zeros((1, d))), k, same) for d, a in asked.value.items()}
        for batch in frames:
            dims, layers = np.asarray(batch.column(2)), np.asarray(batch.column(4))
            cut = np.flatnonzero(np.concatenate([[True], (dims[1:] != dims[:-1]) | (layers[1:] != layers[:-1]), [True]])) if len(dims) else [0]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if (s := found.get(int(dims[a]))) is None:
                    continue
                for p in range(a, b, BLOCK):
                    part = batch.slice(p, min(BLOCK, b - p))
                    far = part.column(5).to_pylist()
                    s.block(int(layers[a]), np.asarray(part.column(0)), np.asarray(part.column(1)), numbers(part.column(3), int(dims[a])), np.frombuffer(b"".join(far), np.float64).reshape(len(far), -1))
        for s in found.values():
            s.settle()
            who, slot, score, vec = s.best[0]
            yield pa.RecordBatch.from_arrays([pa.array(s.ids[who]), pa.array(slot.astype(np.int32)), pa.array(vec), pa.array(score)], ["anchor_id", "slot", "vec_id", "score"])

    out = table.select("vec_id", "label", "dim", "v", "layer", "far").mapInArrow(lean(look), "anchor_id long, slot int, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256, n_pivots: int = 12, sample: int = 1024, chunk: int = 16_384) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of ``vectors(vec_id, label, embedding)`` that ``is_anchor`` selects.

    Scores are inner products of floor(scale * x).  An anchor's positives are its first rows of the same label; for each,
    its negatives are the first rows of other labels with least * positive <= 100 * score <= most * positive.  Ties
    go to the smaller vec_id.  Rows without a vec_id or label, and vectors that are null, empty or hold null or non-finite
    components take no part; vectors of different lengths don't meet; scores beyond 64 bits are held within them.
    Of rows that share a vec_id, the first by label and vector counts.  Other columns are left out; an empty
    table gives no rows.  ``n_pivots``, ``sample`` (of rows, for the pivots) and ``chunk`` (of anchors) never change the result.
    """
    spark = vectors.sparkSession
    ship_code(spark)
    rows = stored(whole_vectors(vectors, scale), "vectors")
    rows = once(rows)
    pivots = choose_pivots(rows, n_pivots, sample)
    table = pivot_table(rows, pivots)
    anchors = stored(table.where(is_anchor).select("vec_id", "label", "dim", "v"), "anchors")
    path = f"{run_dir(spark)}/negatives-{uuid.uuid4().hex}"
    chunks = max(1, -(-anchors.count() // chunk))
    for c in range(chunks):
        got = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).collect()  # about ``chunk`` rows
        asked, place = {}, {}
        for d in sorted({r["dim"] for r in got}):
            own = sorted((r["vec_id"], r["label"], bytes(r["v"])) for r in got if r["dim"] == d)
            place |= {x[0]: (d, n) for n, x in enumerate(own)}
            asked[d] = np.array([x[0] for x in own]), np.array([x[1] for x in own]), np.frombuffer(b"".join(x[2] for x in own), "<i8").reshape(len(own), d), np.full((len(own), 1), LEAST), np.full((len(own), 1), MOST)
        held = spark.sparkContext.broadcast(asked)
        near = stored(scan(table, held, pivots, positives, True).select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        bounds = {d: (a[0], a[1], a[2], np.full((len(a[0]), positives), MOST), np.full((len(a[0]), positives), LEAST)) for d, a in asked.items()}
        for r in near.collect():  # ``positives`` per anchor of the chunk
            d, n = place[r["anchor_id"]]
            bounds[d][3][n, r["slot"]], bounds[d][4][n, r["slot"]] = -(-least * r["positive_score"] // 100), most * r["positive_score"] // 100
        within = spark.sparkContext.broadcast(bounds)
        hard = scan(table, within, pivots, negatives, False).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
        hard.join(near, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
        forget(near)
        held.unpersist()
        within.unpersist()
    return spark.read.parquet(path)


def op12_pivot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose vec_id is divisible by 50; a seventh of the labels is shifted first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", label.alias("label"), "embedding")
    return mine(vectors, F.col("vec_id") % 50 == 0)
