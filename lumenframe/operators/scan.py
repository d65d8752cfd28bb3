"""Scans in order over keyed rows, however many share a key: registers that restart, and automata.

Rows are range-partitioned by key and order, so a key with a third of all rows goes to many tasks.  Each task works on
its range alone; of the ranges before, it needs to know only what is handed over to the key it begins with.  What a
range hands over is one small row, so all of these together are a row per task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..running import checkpoints, kept

RANGE = "_range"


def dealt(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``df`` written in ranges of ``keys`` and ``order``; ``_range`` numbers them in that order."""
    spark = df.sparkSession
    path = f"{checkpoints(spark)}/dealt/{uuid.uuid4().hex}"
    df.repartitionByRange(*keys, *order).withColumn(RANGE, F.spark_partition_id()).write.parquet(path)
    return spark.read.schema(T.StructType([*df.schema.fields, T.StructField(RANGE, T.IntegerType())])).parquet(path)


def handed_over(df: DataFrame, keys: list[str], summary: dict[str, Column]) -> DataFrame:
    """A row per key and range with ``summary`` (aggregates), for keys in several ranges: at most two rows a range."""
    several = F.count("*").over(Window.partitionBy(*keys))
    return df.groupBy(*keys, RANGE).agg(*(c.alias(n) for n, c in summary.items())).withColumn("_several", several).where("_several > 1").drop("_several")


def with_carry(df: DataFrame, carry: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Adds ``columns`` of ``carry`` (a row per key and range, for keys in several ranges) by key and range; keys may be null."""
    c = carry.select(*(F.col(k).alias(f"_carry_key{n}") for n, k in enumerate(keys)), F.col(RANGE).alias("_carry_range"), *columns)
    on = F.col(RANGE) == F.col("_carry_range")
    for n, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_carry_key{n}"))
    return df.join(F.broadcast(c), on, "left").drop("_carry_range", *(f"_carry_key{n}" for n in range(len(keys))))


def last_known(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], ends: Column, run: str = "run") -> DataFrame:
    """Adds to each row the last value that isn't null of each of ``values`` since the run began, and the run's number from 0.

    A row where ``ends`` is true is the last of its run.  Rows with equal keys and order count in any order among
    themselves.  Null keys are a key.  Scale: windows within ranges, and a row per range for what is handed over.
    """
    names = list(values)
    d = dealt(df.withColumns({f"_v{k}": v for k, v in enumerate(values.values())} | {"_ends": F.coalesce(ends, F.lit(False)).cast("long")}), keys, order)
    here = Window.partitionBy(*keys, RANGE).orderBy(*order)
    d = d.withColumn("_run", F.coalesce(F.sum("_ends").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy(*keys, RANGE, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_l{k}": F.last(f"_v{k}", ignorenulls=True).over(inside) for k in range(len(names))})
    # what a range hands over: its ends, and the values known after the last of them
    place = F.struct(*order)
    after = lambda k: F.max_by(F.when(F.col("_ends") == 0, F.col(f"_l{k}")), place)
    over = handed_over(d, keys, {"_n": F.sum("_ends"), **{f"_t{k}": after(k) for k in range(len(names))}})
    by = Window.partitionBy(*keys).orderBy(RANGE)
    over = over.withColumn("_done", F.sum("_n").over(by))
    open_ = Window.partitionBy(*keys, "_done").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, 0)
    over = over.withColumns({f"_t{k}": F.last(f"_t{k}", ignorenulls=True).over(open_) for k in range(len(names))})
    over = over.select(*keys, RANGE, F.lag("_done").over(by).alias("_before"), *(F.lag(f"_t{k}").over(by).alias(f"_c{k}") for k in range(len(names))))
    d = with_carry(d, over, keys, ["_before", *(f"_c{k}" for k in range(len(names)))])
    known = {n: F.coalesce(F.col(f"_l{k}"), F.when(F.col("_run") == 0, F.col(f"_c{k}"))) for k, n in enumerate(names)}
    return d.select(*df.columns, *(c.alias(n) for n, c in known.items()), (F.col("_run") + F.coalesce("_before", F.lit(0))).cast("long").alias(run))


@dataclass(frozen=True)
class Automaton:
    """States by name, the first of them at the start, and the moves (state, event) -> state.  Any other event leaves the state as it is."""

    states: tuple[str, ...]
    moves: dict[tuple[str, str], str]
    events: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "events", tuple(sorted({e for _, e in self.moves})))

    def table(self) -> np.ndarray:
        """The state after each event in each state; the last row is that of unknown events."""
        t = np.tile(np.arange(len(self.states)), (len(self.events) + 1, 1))
        for (state, event), after in self.moves.items():
            t[self.events.index(event), self.states.index(state)] = self.states.index(after)
        return t

    def legal(self, state: Column, event: Column) -> Column:
        return F.coalesce(F.array_contains(F.array(*(F.lit(f"{s} {e}") for s, e in self.moves)), F.concat(state, F.lit(" "), event)), F.lit(False))

    def after(self, state: Column, event: Column) -> Column:
        moves = F.create_map(*(x for (s, e), a in self.moves.items() for x in (F.lit(f"{s} {e}"), F.lit(a))))
        return F.coalesce(F.element_at(moves, F.concat(state, F.lit(" "), event)), state)


def composed(maps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The composition of each row's map with those before it, back to the last row that is ``first``: by doubling."""
    out, known = maps.copy(), first.copy()  # known: the composition reaches back as far as it should
    step, rows = 1, np.arange(len(maps))
    while step < len(maps) and not known.all():
        more = np.flatnonzero(~known & (rows >= step))
        out_new, known_new = np.take_along_axis(out[more], out[more - step], axis=1), known[more - step]
        out[more], known[more] = out_new, known_new
        step *= 2
    return out


def traced(log: DataFrame, machine: Automaton, keys: list[str], order: list[str], event: str = "event") -> DataFrame:
    """Adds ``before``, ``after`` and ``legal`` to the rows of ``log``: the state of their key before and after each event, in ``order``.

    Events without a move, unknown and null ones leave the state as it is and aren't legal.  Rows with equal keys and
    order count in any order among themselves.  Keys (of any type, null included) begin in the first state.

    A state's way through events is a map from states to states, and maps compose: a task tells the maps of the rows of its
    first key from the beginning of its range, and the map of each key that ends its range.
    """
    spark = log.sparkSession
    checkpoints(spark)
    size, table = len(machine.states), machine.table()
    code = F.coalesce(F.element_at(F.create_map(*(x for k, e in enumerate(machine.events) for x in (F.lit(e), F.lit(k)))), F.col(event)), F.lit(len(machine.events)))
    # keys travel as 128 bits of hashes, and rows as they are in a column that isn't looked at
    row = F.struct(*(F.col(f"`{c}`") for c in log.columns))
    hashes = (F.xxhash64(*keys).alias("_k1"), F.xxhash64(F.lit(1), *keys).alias("_k2"))
    plain = log.select(*hashes, *(F.col(o).alias(f"_o{k}") for k, o in enumerate(order)), code.cast("int").alias("_code"), row.alias("_row"))
    by = ["_k1", "_k2", *(f"_o{k}" for k in range(len(order)))]
    sorted_ = plain.repartitionByRange(*by).sortWithinPartitions(*by).select("_k1", "_k2", "_code", "_row", F.spark_partition_id().alias(RANGE))
    named = pa.list_(pa.int32())

    def walk(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = last = None
        so_far = np.arange(size)
        for batch in frames:
            if not (n := batch.num_rows):
                continue
            key, codes, rows, at = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1), batch.column(2).to_numpy(), batch.column(3), batch.column(4)
            if begun is None:
                begun = last = key[0]
            first = np.concatenate([[(key[0] != last).any()], (key[1:] != key[:-1]).any(axis=1)])
            maps = table[codes].copy()
            if not first[0]:
                maps[0] = maps[0][so_far]
            whole = composed(maps, np.concatenate([[True], first[1:]]))
            before = np.concatenate([so_far[None], whole[:-1]])
            before[first] = np.arange(size)
            last, so_far = key[-1], whole[-1]
            m = int((key == begun).all(axis=1).sum())  # they come first
            ways = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * size), pa.array(before[:m].astype(np.int32).ravel()))
            state = np.concatenate([np.full(m, -1), before[m:, 0]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), batch.column(1), at, pa.array(state), pa.concat_arrays([ways.cast(named), pa.nulls(n - m, named)]), pa.nulls(n, named)], names)
        if begun is not None:
            own = [pa.array(last[k : k + 1].copy()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, rows.type), *own, at[:1], pa.array([-1], pa.int32()), pa.nulls(1, named), pa.array([so_far.tolist()], named)], names)

    names = ["_row", "_k1", "_k2", RANGE, "_state", "_from", "_whole"]
    kinds = (plain.schema["_row"].dataType, T.LongType(), T.LongType(), T.IntegerType(), T.IntegerType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.IntegerType()))
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
    found = kept(sorted_.mapInArrow(walk, schema))
    # at the start of a range: what the maps of the ranges before, that end with its first key, make of the first state
    ends = found.where("_whole is not null").select("_k1", "_k2", F.col(RANGE).alias("_e"), "_whole")
    begins = found.where("_from is not null").groupBy(RANGE).agg(F.min(F.struct("_k1", "_k2")).alias("_k")).select(RANGE, "_k._k1", "_k._k2")
    held = begins.join(F.broadcast(ends), ["_k1", "_k2"], "left").withColumn("_e", F.when(F.col("_e") < F.col(RANGE), F.col("_e"))).groupBy(RANGE).agg(F.array_sort(F.collect_list(F.when(F.col("_e").isNotNull(), F.struct("_e", "_whole")))).alias("_maps"))
    carry = held.select(F.col(RANGE).alias("_at"), F.aggregate("_maps", F.lit(0), lambda s, m: F.element_at(m["_whole"], s + 1)).alias("_carry"))
    rows = found.where("_whole is null").drop("_k1", "_k2").join(F.broadcast(carry), F.col(RANGE) == F.col("_at"), "left")
    state = F.when(F.col("_state") >= 0, F.col("_state")).otherwise(F.element_at("_from", F.coalesce("_carry", F.lit(0)) + 1))
    named = F.element_at(F.array(*(F.lit(s) for s in machine.states)), state + 1)
    out = rows.select("_row.*", named.alias("before"))
    return out.withColumns({"after": machine.after(F.col("before"), F.col(event)), "legal": machine.legal(F.col("before"), F.col(event))})


def folded(trace: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, state, events, illegal: the state in which each key of ``traced`` rows ends, and how many of its events had no move."""
    return trace.groupBy(*keys).agg(F.max_by("after", F.struct(*order)).alias("state"), F.count("*").alias("events"), F.count_if(~F.col("legal")).alias("illegal"))


def running_sums(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of the whole numbers ``value`` over the rows of the key up to this one, in ``order``.  Rows with equal keys and order count in any order among themselves."""
    d = dealt(df, keys, order)
    by = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    over = handed_over(d, keys, {"_sum": F.sum(value)}).withColumn("_before", F.sum("_sum").over(by)).where("_before is not null")
    here = F.sum(value).over(Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    d = with_carry(d.withColumn("_here", here), over, keys, ["_before"])
    return d.select(*df.columns, (F.coalesce("_here", F.lit(0)) + F.coalesce("_before", F.lit(0))).cast("long").alias(name))
