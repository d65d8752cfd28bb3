"""Chains of renames against a pass-by-pass simulation, and paths below renamed folders."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import chains, renames


def passes(plan: list[tuple], paths: set) -> tuple[dict, set]:
    """Renames tried in order, pass after pass; a target that will itself move is waited for."""
    there, pending, sources, did = set(paths), list(plan), {s for s, _ in plan}, {}
    while pending:
        left, progress = [], False
        for s, d in pending:
            if d in there and s != d and d in sources:
                left.append((s, d))
                continue
            progress = True
            sources.discard(s)
            if d in there and s != d:
                did[s] = "skip"
            else:
                did[s] = "move"
                there.discard(s)
                there.add(d)
        if not progress:
            did |= {s: "stuck" for s, _ in left}
            break
        pending = left
    return did, there


@pytest.mark.parametrize("seed", range(5))
def test_settled(spark, seed):
    """Chains, rings, targets that several want in any order, taken ones."""
    rng = random.Random(seed)
    names = [f"n{i:03}" for i in range(120)]
    sources = rng.sample(names, 80)
    plan = [(s, rng.choice(names + [f"free{i}" for i in range(20)] + ["kept"])) for s in sources]
    paths = set(sources) | {"kept"} | set(rng.sample([n for n in names if n not in sources], 10))
    rng.shuffle(plan)
    df = spark.createDataFrame([(s, d, i) for i, (s, d) in enumerate(plan)], "src string, dst string, pos int")
    got = {r["src"]: r for r in chains.settled(df, spark.createDataFrame([(p,) for p in sorted(paths)], "path string")).collect()}
    did, after = passes(plan, paths)
    assert {s: r["act"] if r["act"] == "move" else "no" for s, r in got.items()} == {s: a if a == "move" else "no" for s, a in did.items()}
    moved = {s: d for s, d in plan if got[s]["act"] == "move"}
    assert {moved.get(p, p) for p in paths} == after and len({moved.get(p, p) for p in paths}) == len(paths)
    for s, r in got.items():
        if r["act"] == "move" and r["round"]:
            assert got[moved[s]]["round"] == r["round"] - 1


def test_long_chain(spark):
    """100,000 renames that wait one for the other take 17 jumps; a ring stays."""
    n = 100_000
    name = lambda c: F.concat(F.lit("n"), F.lpad(c.cast("string"), 9, "0"))
    plan = spark.range(n).select(name(F.col("id")).alias("src"), name(F.col("id") + 1).alias("dst")).unionByName(spark.createDataFrame([("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("w", "r1"), ("gone", "n"), ("self", "self")], "src string, dst string"))
    taken = plan.where("src <> 'gone'").select(F.col("src").alias("path"))
    written = []
    keep = chains.kept
    chains.kept = lambda df: written.append(1) or keep(df)
    try:
        out = chains.settled(plan, taken)
    finally:
        chains.kept = keep
    assert len(written) <= 17 + 5
    assert {r["act"]: r["n"] for r in out.groupBy("act").agg(F.count("*").alias("n")).collect()} == {"move": n + 1, "stuck": 3, "skip": 2}
    assert out.where("act = 'move' and src <> 'self'").agg(F.count_if(F.col("round") != n - 1 - F.substring("src", 2, 9).cast("int"))).first()[0] == 0


def test_hot_target(spark):
    """A target that most renames want goes to one; what waits for the others stays."""
    plan = [(f"s{i:04}", "t") for i in range(500)] + [("t", "u"), ("x", "s0003"), ("y", "s0499")]
    did, _ = passes(plan, {s for s, _ in plan})
    got = {r["src"]: r["act"] for r in chains.settled(spark.createDataFrame([(s, d, i) for i, (s, d) in enumerate(plan)], "src string, dst string, pos int"), spark.createDataFrame([(s,) for s, _ in plan], "path string")).collect()}
    assert {s for s, a in got.items() if a == "move"} == {s for s, a in did.items() if a == "move"} == {"t", "s0000"}


def test_empty(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert chains.settled(none, spark.createDataFrame([], "path string")).count() == 0
    done, after, n, m = renames.applied(none, spark.createDataFrame([("a",)], "path string"))
    assert (done.count(), [r[0] for r in after.collect()], n, m) == (0, ["a"], 0, 0)


def test_relocated(spark):
    """Every level's new name in one pass; folders that only look alike stay."""
    moves = [("a_b", "A B"), ("a_b/c_d", "a_b/C D"), ("a_b/c_d/e", "a_b/c_d/E"), ("x/y", "x/Y"), ("q", "Q")]
    paths = ["a_b/f", "a_b/c_d/f", "a_b/c_d/e/f", "a_b/c_d/e/g/h/i", "a_bc/f", "x/y", "x/y/z", "x/f", "top", "q/q/q", "a_b/c_d/e/f"]
    got = sorted(r[0] for r in chains.relocated(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(moves, "src string, dst string")).collect())
    assert got == sorted(["A B/f", "A B/C D/f", "A B/C D/E/f", "A B/C D/E/g/h/i", "a_bc/f", "x/y", "x/Y/z", "x/f", "top", "Q/q/q", "A B/C D/E/f"])


def test_apply_all_by_rule(spark):
    """Both phases against renames of one path after another, folders deepest first."""
    rng = random.Random(6)
    parts = ["old_trips", "Old Trips", "my_days", "x_1", "plain", "a.b.c"]
    files = sorted({"/".join([*(rng.choice(parts) for _ in range(rng.randrange(0, 4))), f"{rng.choice(['red_bolt', 'sea'])} ({rng.randrange(30)}).{rng.choice(['jpg', 'png', 'txt'])}"]) for _ in range(150)})
    df = spark.createDataFrame([(f,) for f in files], "path string")
    plan = renames.plan_all(df)
    after, renamed, skipped = renames.apply_all(plan, df)
    rows = plan.collect()
    _, now = passes(sorted((r["src"], r["dst"]) for r in rows if r["phase"] == 1), set(files))
    done = len(files) - len(now & set(files) & {r["src"] for r in rows if r["phase"] == 1})
    folders = sorted(((r["src"], r["dst"]) for r in rows if r["phase"] == 2), key=lambda p: (-p[0].count("/"), p[0]))
    assert len(folders) > 10 and done
    moved = 0
    for src, dst in folders:  # a folder with the new name is itself never renamed here
        held = {p for f in now for p in [f, *("/".join(f.split("/")[:k]) for k in range(1, f.count("/") + 1))]}
        if dst not in held:
            moved += 1
            now = {dst + f[len(src) :] if f.startswith(src + "/") else f for f in now}
    assert {r[0] for r in after.collect()} == now and renamed >= moved and renamed + skipped == len(rows)
