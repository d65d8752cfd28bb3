"""Registers and automata over logs: hot keys in many ranges, ties of ranges and batches, against plain loops."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import replacement as R
from lumenframe.operators import scan as S
from lumenframe.operators.caches import recovery
from lumenframe.streaming import progress


@pytest.fixture(params=["1", "13"])
def ranges(spark, request):
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    for k, v in zip(was, (request.param, "false", "17"), strict=True):
        spark.conf.set(k, v)
    yield int(request.param)
    for k, v in was.items():
        spark.conf.set(k, v)


def progress_rows(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    said = ["out_time_us=1500000", "out_time_us=N/A", "out_time_ms=7000000", "out_time_us=-4", "speed=1.5x", "speed=N/A", "speed=2x", "progress=continue", "progress=continue", "progress=end", "noise", "frame=3", " progress=end ", "=", "a=b=c"]
    keys = ["hot"] * 12 + [f"k{i}" for i in range(6)] + ["once"]
    rows = [(rng.choice(keys), i, rng.choice(said)) for i in range(n)]
    return rows + [("quiet", n + i, "progress=continue") for i in range(3)]


def progress_by_rule(rows: list[tuple]) -> list[tuple]:
    out, state = [], defaultdict(lambda: [0.0, None, 0])
    for key, pos, line in sorted(rows, key=lambda r: r[1]):
        name, eq, value = line.strip().partition("=")
        s = state[key]
        if not eq:
            continue
        if name in ("out_time_us", "out_time_ms"):
            try:
                s[0] = int(value) / 1_000_000
            except ValueError:
                pass
        elif name == "speed":
            try:
                s[1] = float(value.rstrip("x"))
            except ValueError:
                s[1] = None
        elif name == "progress":
            out.append((key, pos, s[2], s[0], s[1]))
            if value.strip() == "end":
                state[key] = [0.0, None, s[2] + 1]
    return sorted(out)


def test_progress_runs(spark, ranges):
    """A key with two thirds of all lines; values end with their run; the stream form tells the same."""
    from lumenframe.running import streamed

    rows = progress_rows(1, 1500)
    df = spark.createDataFrame(rows, "key string, pos long, value string").repartition(4)
    want = progress_by_rule(rows)
    assert max(w[2] for w in want) > 50
    assert sorted(map(tuple, progress.progress_runs(df).collect())) == want
    assert sorted(map(tuple, progress.progress_events(df).collect())) == [(k, p, c, s) for k, p, _, c, s in want]
    if ranges == 1:
        assert sorted(map(tuple, streamed(spark, df, progress.progress_stream, "append").collect())) == [(k, p, c, s) for k, p, _, c, s in want]


def test_second_run_begins_anew(spark):
    lines = [("a", 1, "out_time_us=9000000"), ("a", 2, "speed=3x"), ("a", 3, "progress=end"), ("a", 4, "progress=continue")]
    got = progress.progress_events(spark.createDataFrame(lines, "key string, pos long, value string")).collect()
    assert sorted(map(tuple, got)) == [("a", 3, 9.0, 3.0), ("a", 4, 0.0, None)]


def test_last_known(spark, ranges):
    """Several keys, null ones included; an empty table."""
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([1, 1, 1, 2]), i, rng.choice([None, None, None, i]), rng.random() < 0.02) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, m int, at long, v long, e boolean")
    got = {r["at"]: (r["seen"], r["run"]) for r in S.last_known(df, ["k", "m"], ["at"], {"seen": F.col("v")}, F.col("e")).collect()}
    state, want = defaultdict(lambda: [None, 0]), {}
    for k, m, at, v, e in rows:
        s = state[k, m]
        s[0] = v if v is not None else s[0]
        want[at] = tuple(s)
        if e:
            state[k, m] = [None, s[1] + 1]
    assert got == want
    assert S.last_known(df.limit(0), ["k", "m"], ["at"], {"seen": F.col("v")}, F.col("e")).count() == 0


def lives(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    steps = ["prepare", "stage", "install", "dispose", "sidecar", "cleanup"]
    at, rows = defaultdict(int), []
    for i in range(n):
        key = rng.choice(["hot"] * 10 + [f"k{j}" for j in range(9)] + [None])
        event = steps[at[key] % 6] if rng.random() < 0.8 else rng.choice([*steps, "roll back", "recover", "refuse", "burn", None])
        at[key] += 1
        rows.append((key, i, event, f"x{i}" if i % 3 else None))
    return rows


def by_rule(rows: list[tuple]) -> dict:
    state, out = defaultdict(lambda: R.ABSENT), {}
    for key, i, event, _ in rows:
        before = state[key]
        state[key] = R.LIFE.moves.get((before, event), before)
        out[i] = (before, state[key], (before, event) in R.LIFE.moves)
    return out


def test_traced(spark, ranges):
    """A log of which most belongs to one key; rows keep all their columns."""
    rows = lives(2, 1200)
    df = spark.createDataFrame(rows, "key string, at long, event string, `a.b` string").repartition(3)
    got = R.history(df, ["key"], ["at"])
    assert got.columns == [*df.columns, "before", "after", "legal", "fault", "decision"]
    want = by_rule(rows)
    for r in got.collect():
        assert (r["before"], r["after"], r["legal"]) == want[r["at"]]
        assert r["fault"] == (None if r["legal"] else f"{r['event'] or 'nothing'} in {r['before']}")
    last = {key: want[i][1] for key, i, *_ in rows}
    wrong = defaultdict(int)
    for key, i, *_ in rows:
        wrong[key] += not want[i][2]
    assert {r["key"]: (r["state"], r["illegal"]) for r in R.standing(df, ["key"], ["at"]).collect()} == {k: (v, wrong[k]) for k, v in last.items()}
    assert R.history(df.limit(0), ["key"], ["at"]).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_composed(seed):
    """Prefixes by doubling, back to the last first row."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 70))
    maps, first = rng.integers(0, 5, size=(n, 5)), rng.random(n) < 0.1
    first[0] = True
    got = S.composed(maps, first)
    for i in range(n):
        way = maps[i]
        for j in range(i - 1, -1, -1):
            if first[j + 1]:
                break
            way = way[maps[j]]
        assert (got[i] == way).all()


class Disk:
    """What a commit does to files, event by event; for the test alone."""

    def __init__(self, sidecars):
        self.files = {"source": "original", "temporary": "output"}
        self.sidecars = set(sidecars)

    def apply(self, event):
        f = self.files
        if event == "stage":
            f["backup"] = f.pop("source")
        elif event == "install":
            f["final"] = f.pop("temporary")
        elif event == "dispose":
            f.pop("backup")
        elif event == "roll back":
            if f.get("final") == "output":
                f["temporary"] = f.pop("final")
            if "backup" in f and "source" not in f:
                f["source"] = f.pop("backup")
            f.pop("temporary", None)


def test_every_prefix_recovers(spark):
    """Wherever a commit stops, the automaton's decision is that of recovery over the files as they then are."""
    rows, cases, observed = [], [], []
    for disposable in (True, False):
        events = ["prepare", "stage", "install", "dispose", "sidecar", "sidecar", "cleanup"] if disposable else ["prepare", "stage", "install", "roll back"]
        disk = Disk(["a", "b"])
        for n, event in enumerate(events):
            disk.apply(event)
            key = f"{disposable}{n}"
            rows += [(key, m, e) for m, e in enumerate(events[: n + 1])]
            if event not in ("cleanup", "roll back"):  # else no record is left to recover
                cases.append((key, *(f"{key}/{p}" for p in ("source", "final", "backup", "temporary")), "original", "output", "/"))
            observed += [(f"{key}/{p}", what, what) for p, what in disk.files.items()]
    kinds = "id string, source string, final string, backup string, temporary string, source_identity string, output_identity string, root string"
    told = {r["id"]: r["decision"] for r in recovery(spark.createDataFrame(cases, kinds), spark.createDataFrame(observed, "path string, identity string, output_identity string")).collect()}
    got = {r["id"]: r["decision"] for r in R.standing(spark.createDataFrame(rows, "id string, at int, event string"), ["id"], ["at"]).collect()}
    assert {k: v for k, v in got.items() if v is not None} == told and len(told) == 9 and set(told.values()) == {"discard", "restore", "finish"}
    assert {k for k, v in got.items() if v is None} == {"True6", "False3"}


def test_prepared(spark):
    ident = lambda m: (m, 1, 10, 2, 3)
    rows = [("1", "lib", "lib/d/a.mov", "lib/d/a.mp4", "lib/d/a.tmp", ident(5), ident(5)), ("2", "lib", "music/a.mov", "music/a.mp4", "music/a.tmp", ident(5), None), ("3", "lib", "lib/d/a.mov", "lib/a.mp4", "lib/d/a.tmp", ident(5), None), ("4", "lib", "lib/a.mov", "lib/a.mp4", "lib/a.tmp", ident(5), ident(6)), ("5", "lib", "lib/a.mov", "lib/a.mp4", "lib/a.tmp", ident(5), (5, 9, 10, 2, 3))]
    kind = "struct<m:long,c:long,s:long,i:long,d:long>"
    got = {r["id"]: r for r in R.prepared(spark.createDataFrame(rows, f"id string, root string, source string, final string, temporary string, identity {kind}, expected {kind}")).collect()}
    assert {k: r["problem"] for k, r in got.items()} == {"1": None, "2": "source escapes transaction root: music/a.mov", "3": "source, temporary output, and final output must share a directory", "4": "source changed before transaction preparation", "5": None}
    assert got["1"]["backup"].startswith("lib/d/.replacing-") and got["1"]["backup"].endswith("/a.mov") and got["1"]["backup"] != got["3"]["backup"]


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_state_files(spark, tmp_path, scheme):
    """Paths with and without a scheme mean the same place; folders are made; manifests are found at any depth."""
    from lumenframe.sources import state

    at = f"{scheme}{tmp_path}/deep/er"
    state.write_text(f"{at}/.note.json", "ä")
    assert state.read_text(f"{at}/.note.json") == "ä" and state.read_text(f"{at}/none") is None
    plan = spark.createDataFrame([("a é.jpg", "b.jpg"), ("c", "d")], "src string, dst string")
    state.save_plan(plan, "/lib", f"{at}/plan")
    assert sorted(map(tuple, state.load_plan(spark, f"{at}/plan").collect())) == [("a é.jpg", "b.jpg"), ("c", "d")]
    state.save_plan(spark.createDataFrame([("a", "../b")], "src string, dst string"), "/lib", f"{at}/bad")
    with pytest.raises(Exception, match="plan path leaves the library"):
        state.load_plan(spark, f"{at}/bad").collect()
    rows = [("x", "video", 1, 2, "done", None, "now"), ("y", "photo", 3, 4, "queued", "d", "now")]
    df = spark.createDataFrame(rows, "path string, kind string, size long, mtime_ns long, status string, detail string, updated_at string")
    state.save_journal(df, f"{at}/journal", "then", "now", None, True)
    assert sorted(map(tuple, state.load_journal(spark, f"{at}/journal").collect())) == rows
    df.write.json(f"{at}/torn/files")
    assert state.load_journal(spark, f"{at}/torn").count() == 0 and state.load_journal(spark, f"{at}/none").count() == 0
    text = '{{"version": 1, "state": "prepared", "root": "/lib", "source": "/lib/{0}", "final": "/lib/f", "temporary": "/lib/t", "backup": "/lib/b", "sidecars": ["/lib/s.xmp"]}}'
    for folder in ("txn-1", "a/b/c/txn-2", "film.photoslibrary/txn-3", "txn-4"):
        state.write_text(f"{at}/lib/{folder}/manifest.json", "{" if folder == "txn-4" else text.format(folder[-1]))
    found = {r["manifest"].split("/")[-2]: r for r in state.find_manifests(spark, f"{at}/lib").collect()}
    assert {k: r["valid"] for k, r in found.items() if k != "txn-3"} == {"txn-1": True, "txn-2": True, "txn-4": False} and found["txn-2"]["source"] == "/lib/2" and found["txn-1"]["sidecars"] == ["/lib/s.xmp"]


def test_commits_meet_files_without_broadcast(spark):
    # exploded rows look small to Spark, and a broadcast of all files passes through the driver
    from lumenframe.operators import replacement

    t = spark.sql("select id, concat('a', id) source, concat('b', id) final, concat('c', id) temporary, id source_identity, id output_identity, true disposable, array(concat('s', id)) sidecars from range(3)")
    observed = spark.sql("select explode(array(concat('a', id), concat('c', id), concat('s', id))) path, id identity, id output_identity from range(3)")
    df = replacement.committed(t, observed)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r["event"] for r in df.where("id = 1").orderBy("seq").collect()] == ["prepare", "stage", "install", "dispose", "sidecar", "cleanup"]
