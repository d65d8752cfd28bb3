"""Progress as streams: packet spans, the fold of a converter's progress lines, and the heartbeat rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.measures import percent, speed
from ..operators.scan import last_known
from ..operators.timeline import packet_times
from ..sources import runs


def packet_spans(packets: DataFrame, keys: tuple = ("path", "stream_index")) -> DataFrame:
    """Running spans per stream of a streaming ``packets``: a minimum and a maximum per key are all its state."""
    return packet_times(packets).groupBy(*keys).agg(F.greatest(F.lit(0.0), F.max("end") - F.min("start")).alias("span"))


def progress_runs(lines: DataFrame, key: str = "key", order: str = "pos") -> DataFrame:
    """key, pos, run, current, speed at each ``progress=`` line of ``lines(key, pos, value)`` (batch).

    ``out_time_us`` and ``out_time_ms`` both count microseconds; the last of either stands until the next.  A run ends
    with its ``progress=end``; the next one of the key begins anew, with number ``run`` from 0.  Scale: see ``last_known``.
    """
    name, value = F.regexp_extract(F.trim("value"), r"\A([^=]*)=", 1), F.regexp_extract(F.trim("value"), r"\A[^=]*=(.*)\z", 1)
    df = lines.where(F.contains("value", F.lit("="))).select(key, order, name.alias("_name"), value.alias("_value")).where(F.col("_name").isin("out_time_us", "out_time_ms", "speed", "progress"))
    time = F.when(F.col("_name").isin("out_time_us", "out_time_ms"), F.col("_value").try_cast("bigint") / 1_000_000)
    fast = F.when(F.col("_name") == "speed", F.struct(speed(F.col("_value")).alias("v")))
    ends = (F.col("_name") == "progress") & (F.trim("_value") == "end")
    df = last_known(df, [key], [order], {"_time": time, "_fast": fast}, ends)
    return df.where("_name = 'progress'").select(key, order, "run", F.coalesce("_time", F.lit(0.0)).alias("current"), F.col("_fast.v").alias("speed"))


def progress_events(lines: DataFrame, key: str = "key", order: str = "pos") -> DataFrame:
    """``progress_runs`` without the number of the run."""
    return progress_runs(lines, key, order).drop("run")


STATE = "last_time double, last_percent int"
BEAT = "key string, at double, percent int, current double"


def _told(at: np.ndarray, share: np.ndarray, last_time: float, last_percent: int) -> tuple[list[int], float, int]:
    """Which updates are worth a line, and the last line's time and step after them.

    The rule needs the last line, so it goes from line to line: by a search for the next one, not row by row.
    """
    k, lines = 0, []
    while k < len(at):
        late = k + int(np.searchsorted(at[k:], last_time + 60))
        far = np.flatnonzero(share[k:late] >= last_percent + 10)
        k = k + int(far[0]) if len(far) else late
        if k < len(at):
            lines.append(k)
            last_time = float(at[k])
            if not np.isnan(share[k]):
                last_percent = int(share[k]) - int(share[k]) % 10
            k += 1
    return lines, last_time, last_percent


def _beats(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values(["at", "current"], kind="stable")
    at, share = rows["at"].to_numpy(float), rows["percent"].astype("float64").to_numpy()
    lines, *last = _told(at, share, *(state.get if state.exists else (float(at[0]), -10)))
    state.update(tuple(last))
    if lines:
        out = rows.iloc[lines]
        yield pd.DataFrame({"key": key[0], "at": out["at"].to_numpy(float), "percent": out["percent"].astype("Int32").to_numpy(), "current": out["current"].to_numpy(float)}).astype({"percent": "Int32"})


def heartbeats(updates: DataFrame) -> DataFrame:
    """key, at, percent, current of the updates that are worth a line: ten percent further, or a minute later.

    ``updates(key, at, current, total)`` is a stream; ``at`` in seconds.  State per key: the last line's time and
    its ten-percent step.  The rule needs the last emitted step, which no window function keeps.
    """
    df = updates.select("key", F.col("at").cast("double").alias("at"), F.greatest(F.lit(0.0), F.col("current")).cast("double").alias("current"), percent(F.col("current"), F.col("total")).alias("percent"))
    return df.groupBy("key").applyInPandasWithState(_beats, BEAT, STATE, "append", GroupStateTimeout.NoTimeout)


LIFE = "at double, percent int, total double"


def _lived(idle: float):
    """A key's life: begun by ``start``, told of by ``update``, ended by ``finish`` or ``clear``, or when nothing came for ``idle`` seconds."""

    def serve(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        df = pd.concat(list(frames))
        order = np.lexsort((df["pos"].to_numpy(), df["at"].to_numpy(float)))
        at, action, current, totals = df["at"].to_numpy(float)[order], df["action"].to_numpy(object)[order], df["current"].to_numpy(float)[order], df["total"].to_numpy(float)[order]
        live = tuple(state.get) if state.exists else None
        turns = [*np.flatnonzero(action != "update").tolist(), len(at)]
        a, out = 0, []
        for b in turns:  # what lies between two turns is updates alone
            if live is not None and b > a:
                total = live[2]
                now = np.fmax(current[a:b], 0.0)
                share = np.clip(np.trunc(now / total * 100), 0, 100) if total is not None and total > 0 else np.full(b - a, np.nan)
                lines, last, step = _told(at[a:b], share, live[0], live[1])
                live = (last, step, total)
                out.extend((at[a + k], share[k], now[k]) for k in lines)
            if b < len(at):
                live = (float(at[b]), -10, None if np.isnan(totals[b]) else float(totals[b])) if action[b] == "start" else None
            a = b + 1
        if live is not None:
            state.update(live)
            state.setTimeoutTimestamp(int((max(float(at[-1]), state.getCurrentWatermarkMs() / 1000) + idle) * 1000))
        elif state.exists:
            state.remove()
        if out:
            when, share, now = (np.array(x, dtype=float) for x in zip(*out, strict=True))
            yield pd.DataFrame({"key": key[0], "at": when, "percent": pd.array(share, "Float64").astype("Int32"), "current": now})

    return serve


def lifetimes(events: DataFrame, idle: float = 3600.0, late: str = "10 minutes") -> DataFrame:
    """key, at, percent, current of the updates worth a line, of keys that come and go.

    ``events(key, pos, at, action, current, total)`` is a stream; ``at`` in seconds, equal ones in order of ``pos``.  ``start``
    begins a key (again), with its ``total``; updates of a key that isn't begun tell nothing; ``finish`` and ``clear`` end it.
    Events are served in order within a batch and batches as they come; what comes ``late`` after the
    rest, and what is not after 1970 began, is left out.
    State: a row per key that is begun; a key that was left alone for ``idle`` seconds of event time goes, too.  Events with
    other actions, or without time, are left out.
    States go to Python with the rows, many keys in a batch; no key asks for its own.
    """
    e = events.where(F.col("action").isin("start", "update", "finish", "clear") & F.col("at").isNotNull())
    e = e.select("key", "pos", F.col("at").cast("double").alias("at"), "action", F.col("current").cast("double").alias("current"), F.col("total").cast("double").alias("total"))
    e = e.withColumn("moment", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).withWatermark("moment", late)
    return e.groupBy("key").applyInPandasWithState(_lived(idle), BEAT, LIFE, "append", GroupStateTimeout.EventTimeTimeout)


def latest(updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order`` (an expression): current states from a log of changes, batch or streaming."""
    rest = [c for c in updates.columns if c not in keys]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.expr(order)).alias("_row")).select(*keys, "_row.*")


def write_journal(updates: DataFrame, table: str, checkpoint: str, every: str = "1 second"):
    """Starts a query that merges ``updates(path, status, detail, at)`` into ``table``, a step per ``every`` at most.  ``journal`` reads it; a batch that is repeated changes nothing."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        runs.merge(batch, table, ["path"], "at", batch_id)

    return updates.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def journal(spark: SparkSession, table: str, finished: bool = True) -> DataFrame:
    """path, status, detail, at: the latest row of each path, of equal times that of the later batch.

    Of a run that didn't finish, what was queued or running counts as interrupted.
    """
    now = runs.read(spark, table, ["path"], "at")
    if now is None:
        now = spark.createDataFrame([], "path string, status string, detail string, at long")
    if finished:
        return now
    return now.withColumn("status", F.when(F.col("status").isin("queued", "running"), "interrupted").otherwise(F.col("status")))


FOLD = "current double, speed double"
EVENT = "key string, pos long, current double, speed double"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    current, fast = state.get if state.exists else (0.0, None)
    rows = pd.concat(list(frames)).sort_values("pos")
    out, ended = [], False
    for pos, name, value, time, told in zip(*(rows[c].tolist() for c in ("pos", "name", "value", "time", "fast")), strict=True):
        ended = False
        if name in ("out_time_us", "out_time_ms"):
            current = current if time is None or pd.isna(time) else time
        elif name == "speed":
            fast = None if told is None or pd.isna(told) else told
        else:
            out.append((key[0], pos, current, fast))
            if ended := value.strip() == "end":
                current, fast = 0.0, None
    if ended:
        state.remove()
    else:
        state.update((current, fast))
    if out:
        yield pd.DataFrame(out, columns=["key", "pos", "current", "speed"]).astype({"pos": "int64", "current": "float64", "speed": "float64"})


def progress_stream(lines: DataFrame) -> DataFrame:
    """``progress_events`` of a stream of ``lines(key, pos, value)``: the registers of a key are its state, which goes with its ``progress=end``."""
    name, value = F.regexp_extract(F.trim("value"), r"\A([^=]*)=", 1), F.regexp_extract(F.trim("value"), r"\A[^=]*=(.*)\z", 1)
    df = lines.where(F.contains("value", F.lit("="))).select("key", F.col("pos").cast("long").alias("pos"), name.alias("name"), value.alias("value"))
    df = df.where(F.col("name").isin("out_time_us", "out_time_ms", "speed", "progress")).withColumns({"time": F.col("value").try_cast("bigint") / 1_000_000, "fast": speed(F.col("value"))})
    return df.groupBy("key").applyInPandasWithState(_fold, EVENT, FOLD, "append", GroupStateTimeout.NoTimeout)


def stop(spark: SparkSession, tag: str | None = None) -> list[str]:
    """Cancels a run: the executions under ``tag`` (``spark.addTag``), or else all streaming queries.  Their ids; what they have written stays."""
    if tag is not None:
        return [str(x) for x in spark.interruptTag(tag)]
    ended = []
    for q in spark.streams.active:
        q.stop()
        ended.append(str(q.id))
    return ended
