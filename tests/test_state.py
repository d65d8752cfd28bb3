"""Admissions, names, batches, phases, functions of the caller, digests and numbering against plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import measures as M
from lumenframe.operators import injected, library, renames
from lumenframe.operators.order import row_numbers
from lumenframe.sources import state


def test_admitted(spark):
    """A request that can't be met reserves nothing: later small ones are admitted.  Against the rule, row by row."""
    rng = random.Random(1)
    mib = 1024 * 1024
    rows = [("a", 1, 1000 * mib, 5000 * mib), ("a", 2, 1000 * mib, 10 * mib), ("a", 3, 1000 * mib, 700 * mib), ("a", 4, 1000 * mib, 60 * mib)]
    rows += [(f"d{rng.randrange(3)}", i, 2000 * mib, rng.randrange(1, 1200) * mib) for i in range(300)] + [("n", 1, None, 5)]
    got = {(r["device"], r["seq"]): (r["reserved"], r["decision"]) for r in library.admitted(spark.createDataFrame(rows, "device string, seq long, free long, source_size long").repartition(3)).collect()}
    held = defaultdict(int)
    for device, seq, free, size in sorted(rows, key=lambda r: (r[0], r[1])):
        need = max(64 * mib, size * 5 // 4)
        fits = free is not None and free - held[device] >= need
        assert got[device, seq] == (held[device], "admit" if fits else "wait" if held[device] else "fail")
        held[device] += need if fits else 0
    assert got["a", 1][1] == "fail" and got["a", 2][1] == "admit"


def test_disposal_names(spark):
    """The first free number, gaps first; names that only look numbered don't count."""
    moves = [("p1", "a", ".jpg"), ("p2", "a", ".jpg"), ("p3", "a", ".jpg"), ("p4", "a", ".jpg"), ("q", "b", ""), ("r", "c", ".tar.gz"), ("s", "d", ".x"), ("t", "e", ".x"), ("u", "e", ".x")]
    have = ["a.jpg", "a 3.jpg", "a 5.jpg", "a 02.jpg", "b", "b 2", "c 2.tar.gz", "d 7.x"]
    got = {r["path"]: r["target"] for r in state.disposal_names(spark.createDataFrame(moves, "path string, stem string, suffix string"), spark.createDataFrame([(x,) for x in have], "name string")).collect()}
    taken, want = set(have), {}
    for path, stem, suffix in moves:
        name, n = stem + suffix, 2
        while name in taken:
            name, n = f"{stem} {n}{suffix}", n + 1
        taken.add(name)
        want[path] = name
    assert {k: v for k, v in got.items() if k != "r"} == {k: v for k, v in want.items() if k != "r"} and got["p2"] == "a 4.jpg"


def test_batches(spark, tmp_path):
    """Batches are numbered wherever Spark reads and writes, and the last one is taken back alone."""
    table = f"file://{tmp_path}/batches"
    for k, names in enumerate((["x", "y"], [], ["z"])):
        assert state.record_batch(spark.createDataFrame([(n, n + "2") for n in names], "src string, dst string"), table, "now") == bool(names)
    rows = state.read_batches(spark, table)
    assert sorted((r["batch_id"], r["seq"], r["src"]) for r in rows.collect()) == [(1, 0, "x"), (1, 1, "y"), (2, 0, "z")]
    steps, after = renames.undo(rows, spark.createDataFrame([("x2",), ("y2",), ("z2",)], "path string"))
    assert [(r["from"], r["to"]) for r in steps.collect()] == [("z2", "z")] and {r[0] for r in after.collect()} == {"x2", "y2", "z"}


def test_phases(spark):
    """Files first, then folders, deepest first, with all they hold; a taken folder stays."""
    files = spark.createDataFrame([("old_trips/my_days/red_bolt (7).jpg",), ("old_trips/x.txt",), ("Old Trips/y.txt",), ("two_b/z.png",)], "path string")
    plan = renames.plan_all(files)
    assert {(r["phase"], r["src"], r["dst"]) for r in plan.collect()} >= {(1, "old_trips/my_days/red_bolt (7).jpg", "old_trips/my_days/Red Bolt [1].jpg"), (2, "old_trips/my_days", "old_trips/My Days"), (2, "old_trips", "Old Trips"), (2, "two_b", "Two B")}
    after, renamed, skipped = renames.apply_all(plan, files)
    assert {r[0] for r in after.collect()} == {"old_trips/My Days/Red Bolt [1].jpg", "old_trips/x.txt", "Old Trips/y.txt", "Two B/Z.png"} and (renamed, skipped) == (4, 1)


def test_outcomes(spark):
    def work(row):
        if row["path"] == "b":
            raise ValueError("torn")
        if row["path"] == "c":
            raise injected.Cancelled
        return "converted", "fine", 3

    got = {r["path"]: (r["status"], r["detail"], r["bytes_saved"]) for r in injected.outcomes(spark.createDataFrame([("a",), ("b",), ("c",)], "path string"), work).collect()}
    assert got == {"a": ("converted", "fine", 3), "b": ("failed", "unexpected processing error: torn", 0), "c": ("skipped", "cancelled; partial output removed, original kept", 0)}


@pytest.mark.parametrize("n", [0, 1, 1000, 64 * 1024, 64 * 1024 + 1, 150_000, 400_000])
def test_sampled_digest(spark, n):
    data = random.Random(n).randbytes(n)
    size, h = 64 * 1024, hashlib.blake2b(digest_size=16)
    for at in sorted({0, max(0, n // 2 - size // 2), max(0, n - size)}):
        h.update(at.to_bytes(8, "little") + data[at : at + size])
    assert spark.createDataFrame([(bytearray(data),)], "b binary").select(M.sampled_digest("b")).first()[0] == h.hexdigest()


def test_row_numbers(spark):
    """A key with most rows, ties and nulls: numbers without gaps, in order."""
    rng = random.Random(3)
    rows = [(None if i % 50 == 0 else "hot" if i % 4 else f"k{i % 7}", rng.randrange(40), i) for i in range(2000)]
    out = row_numbers(spark.createDataFrame(rows, "k string, v int, i int").repartition(5), ["k"], [F.desc("v"), F.col("i")]).collect()
    want = {}
    for k in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = n
    assert {r["i"]: r["n"] for r in out} == want


def test_streams(spark, tmp_path):
    """Registers go with their end; a run can be stopped."""
    from lumenframe.running import streamed
    from lumenframe.streaming import progress

    lines = [("a", 1, "out_time_us=2000000"), ("a", 2, "speed=1.5x"), ("a", 3, "progress=end"), ("a", 4, "progress=continue"), ("b", 5, "speed=N/A"), ("b", 6, "out_time_ms=5"), ("b", 7, "progress=continue")]
    out = streamed(spark, spark.createDataFrame(lines, "key string, pos long, value string"), progress.progress_stream, "append")
    assert sorted(tuple(r) for r in out.collect()) == [("a", 3, 2.0, 1.5), ("a", 4, 0.0, None), ("b", 7, 5e-06, None)]
    spark.range(3).select(F.col("id").cast("string").alias("path"), F.lit("queued").alias("status"), F.lit("").alias("detail"), F.col("id").alias("at")).write.parquet(f"{tmp_path}/in")
    q = progress.write_journal(spark.readStream.schema("path string, status string, detail string, at long").parquet(f"{tmp_path}/in"), f"{tmp_path}/table", f"{tmp_path}/state", "0 seconds")
    q.processAllAvailable()
    assert progress.stop(spark) == [str(q.id)] and not q.isActive
    assert {r["status"] for r in progress.journal(spark, f"{tmp_path}/table", finished=False).collect()} == {"interrupted"}


@pytest.mark.parametrize("seed", range(3))
def test_names_of_several_bases(spark, seed):
    """No two moves get one name, whoever claims it first: against serving one after the other."""
    rng = random.Random(seed)
    stems = ["a", "a 2", "a 3", "a 4", "a 2 2", "a 2 3", "a 10", "a 02", "b", "b 2", "c"]
    moves = [(f"p{i:03}", rng.choice(stems + ["a"] * 6), rng.choice([".jpg", ".jpg", ""])) for i in rng.sample(range(1000), 120)]
    have = ["a 3.jpg", "a 5.jpg", "b", "b 2 2", "a 2 3.jpg", "c.jpg"] if seed else []
    got = {r["path"]: r["target"] for r in state.disposal_names(spark.createDataFrame(moves, "path string, stem string, suffix string"), spark.createDataFrame([(x,) for x in have], "name string")).collect()}
    taken, want = set(have), {}
    for path, stem, suffix in sorted(moves):
        name, n = stem + suffix, 2
        while name in taken:
            name, n = f"{stem} {n}{suffix}", n + 1
        taken.add(name)
        want[path] = name
    assert got == want


def test_contested_names(spark):
    moves = [("1", "a", ".jpg"), ("2", "a", ".jpg"), ("3", "a 2", ".jpg")]
    got = state.disposal_names(spark.createDataFrame(moves, "path string, stem string, suffix string"), spark.createDataFrame([], "name string")).collect()
    assert {r["path"]: r["target"] for r in got} == {"1": "a.jpg", "2": "a 2.jpg", "3": "a 2 2.jpg"}
    assert state.disposal_names(spark.createDataFrame([], "path string, stem string, suffix string"), spark.createDataFrame([("a",)], "name string")).count() == 0
