from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import names as N
from lumenframe.operators import renames as R

STEMS = {
    "misty vale (1)": ("misty vale", 1, False, None, False),
    "misty vale [03]": ("misty vale", 3, False, None, False),
    "Copy of party": ("party", None, True, None, False),
    "party - copy": ("party", None, True, None, False),
    "party copy 2": ("party", 2, True, None, False),
    "photocopy": ("photocopy", None, False, None, False),
    "Terminator 2": ("Terminator 2", None, False, None, False),
    "2023-01-05": ("2023-01-05", None, False, None, False),
    "Wren Tally - 2": ("Wren Tally", 2, False, None, False),
    "Tilly-Marsh-001": ("Tilly-Marsh", 1, False, None, False),
    "Nova-Quinn-Example.com-4": ("Nova-Quinn-", 4, False, "Example.com", False),
    "Nova Quinn [Example.com 04]": ("Nova Quinn", 4, False, "Example.com", False),
    "Nova [ue73up]": ("Nova [ue73up]", None, False, None, True),
}
RANDOM = {"ue73up": True, "x9k2mq31": True, "photo2023": False, "party2023": False, "4kvideo": False, "IMG1234": False, "misty vale": False, "holiday": False}
CLEAN = {
    "misty_vale": "Misty Vale", "misty.vale": "Misty Vale", "  misty vale ": "Misty Vale", "day of the tentacle": "Day of the Tentacle", "USA trip": "USA Trip",
    "McDonald visit": "McDonald Visit", "IMG_1234": "IMG_1234", "PXL_20230101_123456": "PXL_20230101_123456", "Screenshot 2023-01-05 at 10.15.30": "Screenshot 2023-01-05 at 10.15.30",
    "été": "Été",
}


def test_parse(spark):
    df = N.with_parsed(spark.createDataFrame([(s,) for s in STEMS], "stem string"))
    got = {r["stem"]: (r["base"], r["number"], r["is_dup"], r["site"], r["opaque"]) for r in df.collect()}
    assert got == STEMS


def test_random(spark):
    df = spark.createDataFrame([(s,) for s in RANDOM], "stem string")
    assert {r[0]: r[1] for r in df.select("stem", N.looks_random(F.col("stem"))).collect()} == RANDOM


def test_clean(spark):
    df = N.with_cleaned(spark.createDataFrame([(s,) for s in CLEAN], "base string"), compose=True)
    assert {r["base"]: r["cleaned"] for r in df.collect()} == CLEAN


PLANS = {
    "gaps and padding": ([f"misty vale ({n}).jpg" for n in (1, 2, 4, 5, 6, 7, 8, 9, 10, 11)], {"misty vale (1).jpg": "Misty Vale [01].jpg", "misty vale (4).jpg": "Misty Vale [03].jpg", "misty vale (11).jpg": "Misty Vale [10].jpg"}),
    "no padding": (["trip (1).jpg", "trip (3).jpg"], {"trip (1).jpg": "Trip [1].jpg", "trip (3).jpg": "Trip [2].jpg"}),
    "random": (["Nova/ue73up.jpg"], {"Nova/ue73up.jpg": "Nova/Nova [ue73up].jpg"}),
    "camera": (["IMG_1234.JPG", "IMG_5678.jpg"], {"IMG_1234.JPG": "IMG_1234.jpg"}),
    "copies": (["party.jpg", "Copy of party.jpg"], {"party.jpg": "Party.jpg", "Copy of party.jpg": "Party [1].jpg"}),
    "lone copy": (["Copy of party.jpg"], {"Copy of party.jpg": "Party.jpg"}),
    "pair and sidecar": (["my_shot.heic", "my_shot.mov", "my_shot.AAE"], {"my_shot.heic": "My Shot.heic", "my_shot.mov": "My Shot.mov", "my_shot.AAE": "My Shot.aae"}),
    "per extension": (["trip (1).jpg", "trip (3).png"], {"trip (1).jpg": "Trip [1].jpg", "trip (3).png": "Trip [1].png"}),
    "standard": (["Misty Vale [1].jpg", "Misty Vale [2].jpg"], {}),
    "hidden": ([".x/trip (1).jpg", "A.app/trip (1).jpg"], {}),
}


def test_plans(spark):
    """All cases in one plan, each in a folder of its own; a plan of the result is empty."""
    names = list(PLANS)
    paths = [(f"{i}/{p}",) for i, n in enumerate(names) for p in PLANS[n][0]]
    plan = {r["src"]: r["dst"] for r in R.plan_files(spark.createDataFrame(paths, "path string")).collect()}
    for i, n in enumerate(names):
        want = PLANS[n][1]
        got = {k.split("/", 1)[1]: v.split("/", 1)[1] for k, v in plan.items() if k.startswith(f"{i}/")}
        assert {k: got.get(k) for k in want} == want, n
        if not want:
            assert not got, n
    after = [(plan.get(p, p),) for (p,) in paths]
    assert R.plan_files(spark.createDataFrame(after, "path string")).count() == 0


def test_date_prefix(spark):
    plan = R.plan_files(spark.createDataFrame([("misty_vale.jpg",)], "path string"), spark.createDataFrame([("misty_vale.jpg", "2020-01-02")], "path string, date string"))
    assert [r["dst"] for r in plan.collect()] == ["2020-01-02 Misty Vale.jpg"]


def test_applied_and_undone(spark):
    plan = spark.createDataFrame([("a", "b"), ("b", "c"), ("d/x", "d/y"), ("d", "e"), ("p", "q"), ("s", "t"), ("t", "s")], "src string, dst string")
    paths = spark.createDataFrame([(p,) for p in ("a", "b", "d/x", "d", "p", "q", "s", "t")], "path string")
    done, after, renamed, skipped = R.applied(plan, paths)
    assert (renamed, skipped) == (4, 3)
    assert {r[0] for r in after.collect()} == {"b", "c", "d/y", "e", "p", "q", "s", "t"}
    batches = spark.createDataFrame([(1, 0, "x", "y"), (2, 0, "b", "c"), (2, 1, "a", "b")], "batch_id int, seq int, src string, dst string")
    steps, back = R.undo(batches, spark.createDataFrame([("b",), ("c",)], "path string"))
    assert [(r["from"], r["done"]) for r in steps.collect()] == [("b", True), ("c", True)]
    assert {r[0] for r in back.collect()} == {"a", "b"}


@pytest.mark.parametrize("folder,new", [("old_trips", "Old Trips"), ("Fine", None), ("x [a]", None)])
def test_folders(spark, folder, new):
    got = [r["dst"] for r in R.plan_folders(spark.createDataFrame([(folder,)], "path string")).collect()]
    assert got == ([new] if new else [])


def test_folders_are_taken_apart_once_each(spark):
    files = spark.createDataFrame([(f"a/b{k % 3}/{k}.jpg",) for k in range(300)] + [("top.jpg",), ("/root.jpg",)], "path string")
    found = R.folders_of(files)
    assert sorted(r["path"] for r in found.collect()) == ["", "a", "a/b0", "a/b1", "a/b2"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Generate") :]  # distinct folders come below


def test_files_are_planned_in_many_tasks(spark, monkeypatch):
    parts, kept = [], R.kept
    monkeypatch.setattr(R, "kept", lambda df: parts.append(df.rdd.getNumPartitions()) or kept(df))
    files = spark.createDataFrame([(f"a/n_{k}.jpg",) for k in range(50)], "path string").coalesce(1)
    assert R.plan_files(files).count() == 50
    assert parts[0] == int(spark.conf.get("spark.sql.shuffle.partitions"))
