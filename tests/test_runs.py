"""Tables of runs, lives of keys and case folding."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from lumenframe import schemas as S
from lumenframe.functions.folding import folded
from lumenframe.running import rocksdb
from lumenframe.sources import runs, state
from lumenframe.streaming import progress


@pytest.fixture(params=["plain", "file://"])
def table(request, tmp_path):
    return f"{tmp_path}/table" if request.param == "plain" else f"file://{tmp_path}/table"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_replace_reads_itself_and_survives_a_failed_task(spark, table):
    assert runs.read(spark, table) is None
    runs.replace(spark.range(10), table)
    old = runs.read(spark, table)
    runs.replace(runs.read(spark, table).where("id > 6"), table)
    assert rows_of(runs.read(spark, table)) == [(7,), (8,), (9,)]
    assert old.count() == 10  # a reader keeps the version it began with
    bad = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("dies"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="dies"):
        runs.replace(bad, table)
    assert rows_of(runs.read(spark, table)) == [(7,), (8,), (9,)]
    assert runs.sweep(table, older=-60) == 1 and runs.sweep(table, older=-60) == 0
    assert rows_of(runs.read(spark, table)) == [(7,), (8,), (9,)]


def test_merge_against_brute_force(spark, table):
    r = random.Random(5)
    want, most = {}, 0
    for batch in range(14):
        rows = [(r.choice([None, *map(str, range(30))]), r.randrange(20), f"{batch}-{n}") for n in range(r.choice([1, 3, 40]))]
        rows = list({k[:2]: k for k in rows}.values())  # no ties inside a batch
        for key, at, value in rows:
            if key not in want or want[key][0] <= at:
                want[key] = (at, value)
        df = spark.createDataFrame(rows, "key string, at int, value string")
        runs.merge(df, table, ["key"], "at", batch)
        runs.merge(spark.createDataFrame([("x", 99, "again")], df.schema), table, ["key"], "at", batch)  # that batch is in already
        sizes = [x["rows"] for x in runs.state(table)["runs"]]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
        most = max(most, len(sizes))
    assert rows_of(runs.read(spark, table, ["key"], "at")) == sorted(((k, *v) for k, v in want.items()), key=repr)
    assert most <= 6 and sum(sizes) <= 2 * len(want)
    runs.merge(spark.createDataFrame([], "key string, at int, value string"), table, ["key"], "at", 14)
    assert len(rows_of(runs.read(spark, table, ["key"], "at"))) == len(want)


def test_two_writers_of_a_version(spark, table, monkeypatch):
    runs.merge(spark.createDataFrame([("a", 1)], "key string, at int"), table, ["key"], "at")
    stale, real = runs.state(table), runs.state
    seen = []

    def first_stale(t):
        seen.append(t)
        return stale if len(seen) == 1 else real(t)

    runs.merge(spark.createDataFrame([("b", 2)], "key string, at int"), table, ["key"], "at")
    monkeypatch.setattr(runs, "state", first_stale)
    runs.merge(spark.createDataFrame([("c", 3)], "key string, at int"), table, ["key"], "at")
    assert len(seen) == 2 and [x[0] for x in rows_of(runs.read(spark, table, ["key"], "at"))] == ["a", "b", "c"]
    seen.clear()
    with pytest.raises(runs.Conflict):
        runs.replace(spark.range(1), table)
    assert [x[0] for x in rows_of(runs.read(spark, table, ["key"], "at"))] == ["a", "b", "c"]


def test_text_is_swapped_whole(spark, tmp_path):
    at = f"{tmp_path}/state.json"
    state.write_text(at, "one")
    state.write_text(at, "two")
    assert state.read_text(at) == "two"
    assert [n for n in os.listdir(tmp_path) if not n.endswith(".crc")] == ["state.json"]
    with pytest.raises(runs.Conflict):
        runs.write_text(at, "three", new=True)
    assert state.read_text(at) == "two"


def brute_lives(events, idle=None):
    live, out = {}, []
    for key, pos, at, action, current, total in events:
        if action == "start":
            live[key] = [at, -10, total]
        elif action in ("finish", "clear"):
            live.pop(key, None)
        elif action == "update" and key in live:
            last, step, whole = live[key]
            now = max(0.0, current)
            percent = max(0, min(100, int(now / whole * 100))) if whole and whole > 0 else None
            if (percent is not None and percent >= step + 10) or at - last >= 60:
                out.append((key, at, percent, now))
                live[key][0] = at
                if percent is not None:
                    live[key][1] = percent - percent % 10
    return out, live


LIFE = "key string, pos long, at double, action string, current double, total double"


def run_lives(spark, tmp_path, batches, **given):
    at = str(tmp_path)
    os.makedirs(f"{at}/in")
    out = []
    with rocksdb(spark):
        df = progress.lifetimes(spark.readStream.schema(LIFE).parquet(f"{at}/in"), **given)
        q = df.writeStream.foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{at}/state").start()
        held = []
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, LIFE).coalesce(1).write.parquet(f"{at}/b{k}")
            for n in os.listdir(f"{at}/b{k}"):
                if n.endswith(".parquet"):
                    os.rename(f"{at}/b{k}/{n}", f"{at}/in/{k}-{n}")
            q.processAllAvailable()
            told = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
            held.append(told[-1])
        q.stop()
    return out, held


def test_lives_over_batches(spark, tmp_path):
    r = random.Random(3)
    events = []
    for pos in range(600):
        action = r.choices(["update", "start", "finish", "clear"], [20, 3, 1, 1])[0]
        events.append((r.choice("abcd"), pos, 1 + pos * 7.5, action, r.uniform(-5, 130), r.choice([100.0, None, 0.0, 100.0])))
    out, _ = run_lives(spark, tmp_path, [events[:200], events[200:230], events[230:]], late="1 hour", idle=1e6)
    want, _ = brute_lives(events)
    assert want and sorted(out, key=repr) == sorted(want, key=repr)


def test_lives_end(spark, tmp_path):
    begun = [(f"k{n}", n, 1.0 + n, "start", None, 100.0) for n in range(50)]
    ended = [(f"k{n}", 100 + n, 60.0 + n, "finish" if n % 2 else "clear", None, None) for n in range(40)]
    later = [("new", 1000, 9000.0, "start", None, None), ("k45", 1001, 9000.5, "update", 50.0, None), (None, 1002, 9001.0, "update", 1.0, None), ("k1", 1003, None, "start", 1.0, 1.0)]
    out, held = run_lives(spark, tmp_path, [begun, ended, later, [("new", 2000, 9002.0, "update", 1.0, None)]], idle=600.0, late="10 seconds")
    assert held[1] < held[0] / 2 and held[-1] < held[1]  # what ended has gone, and by the timer what was left alone
    assert [x[0] for x in out] == ["k45"]


def test_folding_of_every_letter(spark):
    letters = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x30000))]
    df = spark.createDataFrame([(c, f"A{c}ß") for c in letters] + [(None, None), ("", "")], "c string, t string")
    for c, t, f, g in df.select("c", "t", folded(F.col("c")), folded(F.col("t"))).toLocalIterator():
        assert f == (None if c is None else c.casefold()) and g == (None if t is None else t.casefold())


def test_cache_renewed_in_place(spark, table):
    empty = spark.createDataFrame([], S.CACHE)
    state.write_cache(empty, table)
    assert state.read_cache(spark, table).count() == 0
    state.write_cache(empty, table, dirty=False)
    assert runs.state(table)["version"] == 1
    state.write_cache(state.read_cache(spark, table), table)
    assert runs.state(table)["version"] == 2 and state.read_cache(spark, table).count() == 0


def test_states_of_lives_travel_with_rows(spark, tmp_path):
    # with transformWithState each key asks for its state and timer by itself, several round trips a key
    df = progress.lifetimes(spark.readStream.schema(LIFE).parquet(str(tmp_path)))
    assert "TransformWithState" not in df._jdf.queryExecution().analyzed().toString()
