"""Sharding along a Hilbert curve, so that each shard covers a small box of several metadata dimensions.

Every dimension is quantised to ``2**bits`` cells at quantiles of all its rows: texts by the counts of their
values, or, where these are very many, by the bytes that follow what all begin with.  Rows are ordered by the curve index of their cell and the order is cut into runs whose
row counts differ by at most one (law ``rows``).

Scale: cell counts are an aggregate of at most ``2**(bits * dimensions)`` rows, collected as that bound is a
parameter.  Rows of one cell are dealt into as many sub-cells as its count asks for, so that no task
orders more than about ``per_task`` rows, however many rows share a cell.  The text is read once, for its
size and checksum, and never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ship_code, unsigned_crc32

CELLS_AT_MOST = 1 << 18


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of each row of ``cells`` (rows x dimensions, each in 0 .. 2**bits - 1).

    Gray-code form of the transform: undo the excess rotations from the high bit down, Gray encode,
    then interleave the bits.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        top, low = 1 << b, (1 << b) - 1
        for d in range(dims):
            turned = (x[d] & top) != 0
            swap = np.where(turned, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flips = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flips = np.where(x[dims - 1] & (1 << b), flips ^ ((1 << b) - 1), flips)
    x ^= flips
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | ((x[d] >> b) & 1)
    return out


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def as_number(df: DataFrame, name: str, skip: int = 0) -> Column:
    """An order-keeping double of a column: numbers as they are, other values by the six bytes after the first ``skip`` characters of their string."""
    kind = dict(df.dtypes)[name]
    if kind in NUMBERS or kind.startswith("decimal"):
        return F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(None).cast("double"))
    rest = F.substring(F.col(f"`{name}`").cast("string"), skip + 1, 6)
    return F.conv(F.rpad(F.substring(F.hex(rest.cast("binary")), 1, 12), 12, "0"), 16, 10).cast("double")


def common_starts(df: DataFrame, dims: Sequence[str]) -> dict[str, int]:
    """How many characters all values of each text column begin with alike: as many as the least and the greatest do."""
    kinds = dict(df.dtypes)
    texts = [d for d in dims if kinds[d] not in NUMBERS and not kinds[d].startswith("decimal")]
    if not texts:
        return {}
    ends = df.agg(*(f(F.col(f"`{d}`").cast("string")).alias(f"{n}{i}") for i, d in enumerate(texts) for n, f in (("a", F.min), ("b", F.max)))).first()
    out = {}
    for i, d in enumerate(texts):
        low, high = ends[f"a{i}"] or "", ends[f"b{i}"] or ""
        out[d] = next((k for k, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(len(low), len(high)))
    return out


def text_bounds(df: DataFrame, name: str, levels: Sequence[float], most: int = 65_536) -> list[str] | None:
    """The values of a text column at ``levels`` of all its rows, by the counts of its values; None where it has more than ``most``."""
    v = F.col(f"`{name}`").cast("string")
    counts = df.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count("*").alias("n"))
    found = counts.limit(most + 1).collect()
    if len(found) > most:
        return None
    found = sorted(((r["v"], r["n"]) for r in found), key=lambda x: x[0].encode("utf-8", "surrogatepass"))
    ends = np.cumsum([n for _, n in found])
    return [found[int(np.searchsorted(ends, level * ends[-1]))][0] for level in levels] if found else []


def hilbert_rank(df: DataFrame, dims: Sequence[str], order: Sequence[str], bits: int = 5, per_task: int = 100_000, keep: dict[str, Column] | None = None) -> tuple[DataFrame, int]:
    """(the columns ``keep``, hilbert, rank from 0), and the number of rows.

    ``order`` names columns that order the rows of a cell, so that the rank depends on the rows alone.
    Null dimensions take cell 0.  Equal rows are interchangeable.
    """
    if bits * len(dims) > CELLS_AT_MOST.bit_length() - 1:
        raise ValueError("too many cells to plan on the driver")
    ship_code(df.sparkSession)
    cuts_n = (1 << bits) - 1
    levels = [(i + 1) / (cuts_n + 1) for i in range(cuts_n)]
    kinds = dict(df.dtypes)
    texts = {d: text_bounds(df, d, levels) for d in dims if kinds[d] not in NUMBERS and not kinds[d].startswith("decimal")}
    starts = common_starts(df, [d for d, bounds in texts.items() if bounds is None])
    values = [F.col(f"`{d}`").cast("string") if texts.get(d) is not None else as_number(df, d, starts.get(d, 0)) for d in dims]
    numbers = [i for i, d in enumerate(dims) if texts.get(d) is None]
    cuts = df.agg(*(F.percentile_approx(values[i], levels, 10_000).alias(f"q{i}") for i in numbers)).first() if numbers else {}
    cell = []
    for i, (d, v) in enumerate(zip(dims, values, strict=True)):
        bounds = sorted(set((texts[d] if texts.get(d) is not None else cuts[f"q{i}"]) or []), key=lambda x: x.encode("utf-8", "surrogatepass") if isinstance(x, str) else x)
        # the number of bounds up to the value
        cell.append(F.coalesce(_steps(v, bounds), F.lit(0)).cast("int"))

    @F.pandas_udf("int")
    def index(*cols: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cols], axis=1), bits).astype(np.int32))

    counts = {r[0]: r[1] for r in df.select(*(c.alias(f"c{i}") for i, c in enumerate(cell))).groupBy(*(f"c{i}" for i in range(len(cell)))).count().select(index(*(F.col(f"c{i}") for i in range(len(cell)))), "count").collect()}
    total, first, plan = 0, {}, []
    for h in sorted(counts):
        first[h], total = total, total + counts[h]
        plan.append((h, first[h], max(1, -(-counts[h] // per_task))))
    if not plan:
        plan = [(0, 0, 1)]
    # at most 2**(bits * dims) rows: small enough to broadcast, by the check above
    cols = list(zip(*plan, strict=True))
    cells = F.broadcast(df.sparkSession.createDataFrame(pa.table({"hilbert": pa.array(cols[0], pa.int32()), "cell_at": pa.array(cols[1], pa.int64()), "parts": pa.array(cols[2], pa.int32())})))
    rows = df.select(*(c.alias(n) for n, c in (keep or {c: F.col(f"`{c}`") for c in df.columns}).items()), index(*cell).alias("hilbert"))
    rows = rows.join(cells, "hilbert").withColumn("part", F.pmod(F.xxhash64(*order), F.col("parts")).cast("int"))
    parts = rows.groupBy("hilbert", "part").agg(F.count("*").alias("n"))
    w = F.expr("coalesce(sum(n) over (partition by hilbert order by part rows between unbounded preceding and 1 preceding), 0)")
    if max(p[2] for p in plan) == 1:
        rows = rows.withColumn("part_at", F.lit(0).cast("long"))
    else:
        rows = rows.join(parts.select("hilbert", "part", w.cast("long").alias("part_at")), ["hilbert", "part"])
    by = ", ".join(f"`{c}`" for c in order)
    rank = F.expr(f"cell_at + part_at + row_number() over (partition by hilbert, part order by {by}) - 1")
    return rows.withColumn("rank", rank.cast("long")).drop("cell_at", "parts", "part", "part_at"), total


def _steps(v: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at most v (null for null)."""
    if not bounds:
        return F.when(v.isNotNull(), 0)
    return F.when(v.isNotNull(), F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= v)))


def shard_rows(df: DataFrame, dims: Sequence[str], shards: int, order: Sequence[str], keep: dict[str, Column] | None = None, bits: int = 5) -> DataFrame:
    """``hilbert_rank`` cut into ``shards`` runs: shard int and slot long (gapless from 0 in its shard).  Counts differ by one at most."""
    ranked, total = hilbert_rank(df, dims, order, bits=bits, keep=keep)
    shard = F.expr(f"cast((rank * {shards}L) div {max(total, 1)}L as int)")
    start = F.expr(f"(cast(shard as bigint) * {total}L + {shards - 1}L) div {shards}L")
    return ranked.withColumn("shard", shard).withColumn("slot", (F.col("rank") - start).cast("long"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in curve order: min/max statistics of the files then prune on every dimension."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 by law ``rows``, along a Hilbert curve of n_chars, lang and source.

    Null text: empty (size 16).  Null dimensions share the first cell.  Repeated rows take neighbouring
    slots.  An empty table gives no rows; extra columns play no part.
    """
    docs = documents(spark, sf_dir)
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = {"doc_id": F.col("doc_id"), "size": (F.octet_length(text) + 16).cast("long"), "text_crc32": unsigned_crc32(F.col("text")).cast("long")}
    out = shard_rows(docs, ["n_chars", "lang", "source"], 40, ["doc_id", "text_crc32", "size"], keep)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
