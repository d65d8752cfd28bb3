"""Line deduplication against the rule, line by line."""

from __future__ import annotations

import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import lines as L

SPACES = " \t\n\x0b\x0c\r"


def low(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def by_rule(rows: list[tuple], least: int = 20, copies: int = 3) -> list[tuple]:
    holders = defaultdict(set)
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                if len(key := low(line.strip(SPACES))) >= least:
                    holders[key].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if doc is None or len(h := holders.get(low(x.strip(SPACES)), ())) < copies or doc == max(h)]
        out.append((doc, len(lines), len(lines) - len(keep), None if text is None else "\n".join(keep)))
    return sorted(out, key=repr)


def corpus(seed: int = 3, n: int = 300) -> list[tuple]:
    rng = random.Random(seed)
    pool = [f"This is a common line number {i} of many" for i in range(40)] + ["short", "", "ÄÖÜ äöü ß long enough to be counted", "äÖü äöü ß long enough to be counted", "漢" * 19, "漢" * 20, "é" * 20]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randrange(0, 12)):
            x = rng.choice(pool) if rng.random() < 0.7 else f"own line {rng.random()} of document {i}"
            lines.append(rng.choice(["", " ", "\t"]) + (x.upper() if x.isascii() and rng.random() < 0.3 else x) + rng.choice(["", " \r"]))
        rows.append((i, "\n".join(lines)))
    hot = "the line that a third of all documents hold"
    rows += [(1000 + i, "\n".join([hot] * (1 + i % 4) + [f"and one of its own, {i} indeed"])) for i in range(200)]
    rows += [(5, "another text of document five\n" + hot), (5, "another text of document five\n" + hot), (7, rows[7][1]), (None, hot), (None, None), (2000, None), (2001, ""), (2002, "\n\n"), (2003, "x" * 200_000 + "\n" + hot)]
    return rows


def run(df, **settings) -> list[tuple]:
    out = L.without_lines(df, L.line_bitmaps(df, **settings), ("lines", "gone"))
    assert out.columns == [*df.columns, "lines", "gone"]
    return sorted(((r["doc_id"], r["lines"], r["gone"], r["text"]) for r in out.collect()), key=repr)


@pytest.mark.parametrize("parts", ["1", "9"])
def test_rule(spark, parts):
    """Hot lines that go through several ranges, one range alone, copies, nulls, long lines, other columns."""
    rows = corpus()
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, pos int, keep string").repartition(5)
        assert run(df) == by_rule(rows)
        assert run(df, least=30, copies=5) == by_rule(rows, 30, 5)
        assert run(df, copies=2) == by_rule(rows, copies=2)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_dropped int")
    assert run(df) == []
    assert L.line_bitmaps(df).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_stream(seed):
    """However rows are cut in batches and tasks: decided rows and notes tell the same."""
    rng = random.Random(seed)
    rows = sorted({(h, -h, d, 0, p) for h in range(6) for d in rng.sample(range(9), rng.randrange(1, 9)) for p in range(rng.randrange(1, 4))}, key=lambda r: (r[0], r[1], -r[2], r[3], r[4]))
    rows = [r for r in rows for _ in range(rng.choice([1, 1, 2]))]
    docs = {h: {r[2] for r in rows if r[0] == h} for h in range(6)}
    want = {r for r in rows if len(docs[r[0]]) >= 3 and r[2] != max(docs[r[0]])}
    cuts = sorted(rng.sample(range(1, len(rows)), 4))
    found = defaultdict(set)
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        s, at = L._Stream(3), a
        while at < b:
            n = min(b - at, rng.randrange(1, 5))
            for kind, m in s.rows(np.array(rows[at : at + n], np.int64)):
                found[kind] |= set(map(tuple, m.tolist()))
            at += n
        for kind, m in s.end():
            found[kind] |= set(map(tuple, m.tolist()))
    notes = defaultdict(set)
    for r in found[L.NOTE]:
        notes[r[0]].add(r[2])
    assert found[L.DROP] | {r for r in found[L.OPEN] if len(notes[r[0]]) >= 3 and r[2] < max(notes[r[0]])} == want


def test_bitmaps():
    """The bitmap of any set of lines, and short for regular ones."""
    rng = random.Random(2)
    for n in (1, 7, 8, 9, 100):
        lines = [str(i) for i in range(n)]
        gone = np.array(sorted(rng.sample(range(n), max(1, n // 2))))
        assert L.kept_lines(lines, L.keep_bits(gone)) == [x for i, x in enumerate(lines) if i not in set(gone.tolist())]
    assert len(L.keep_bits(np.arange(100_000))) < 100


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_query(spark):
    import hashlib

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((d, n, gone, hashlib.sha256((t or "").encode()).hexdigest()) for d, n, gone, t in by_rule(docs))
    got = L.op11_line_bitmaps(spark, "/root/testdata/sf0.001")
    assert sorted(tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()) == want
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"}
    assert got.where(F.col("n_dropped") > 0).count()
