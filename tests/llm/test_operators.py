"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import hilbert, html, jaccard, neardup, packing, pieces, pii, toxicity, vafile, windows
from lumenframe.llm.common import components, labels

WORDS = [f"w{i}" for i in range(4000)]


def text(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng: random.Random, t: str, n: int) -> str:
    w = t.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    docs = [(i, text(rng, rng.randint(60, 200))) for i in range(60)]
    docs += [(100 + i, edited(rng, docs[i % 12][1], i % 9)) for i in range(60)]
    docs += [(200, None), (201, ""), (202, "  \n "), (203, "one two"), (204, "ONE two"), (205, docs[0][1]), (205, docs[0][1]), (None, docs[1][1]), (206, "x" * 50_000), (207, text(rng, 9000))]
    return docs


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "n", 1) for i, t in corpus], "doc_id long, text string, lang string, node string, n int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=8).astype("f4")], 1) for i in range(300)]
    rows += [(300, None, 1), (301, [1.0, None, 3.0], 1), (302, [float("nan")] * 8, 1), (303, rows[0][1], 1), (400, [1e30] * 8, 1), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for r in vafile.top_k(df, F.col("vec_id") % 100 == 0, 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ints = {i: [max(-(2**61), min(2**61, int(np.floor(1024.0 * float(np.float32(x)))))) for x in v] for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    for q in (0, 100, 200, 400):
        scored = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(ints[q], v)))), i) for i, v in ints.items() if i != q]
        best = sorted(scored, key=lambda x: (-x[0], x[1]))[:5]
        assert got[q] == [(i, s) for s, i in best]
    assert set(got) == {0, 100, 200, 400}
    assert vafile.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_copies(spark):
    """A vector that a third of all rows share, repeated rows, an id with two vectors, several chunks and parts, against brute force."""
    rng = np.random.default_rng(2)
    hot, rows = rng.normal(size=6), []
    for i in range(400):
        rows.append((i, (hot if i % 3 == 0 else rng.normal(size=6)).tolist()))
    rows += [rows[9]] * 30 + [rows[10]] * 3 + [(11, rng.normal(size=6).tolist()), (20, rows[3][1]), (20, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in vafile.top_k(df, F.col("vec_id") % 10 == 0, 4, chunk=9, part=3, broadcast_rows=0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ints = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in rows]
    assert len(got) == 40
    for q in got:
        own = min((v.tolist() for i, v in ints if i == q), key=lambda v: np.array(v, "<i8").tobytes())
        assert got[q] == [(i, s) for s, i in sorted(((int(np.dot(own, v)), i) for i, v in ints if i != q), key=lambda x: (-x[0], x[1]))[:4]], q


def test_packing(spark, docs, corpus, empty):
    rows = packing.pack(docs, limit=64).collect()
    enc = packing.encoder("byte_bpe_50k.json")
    want = []
    for d, t in corpus:
        ids = [*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        at, take, k = 0, len(ids) % 64 or 64, 0
        while at < len(ids):
            want.append((d, k, at, take, zlib.crc32(np.array(ids[at : at + take], "<u4").tobytes())))
            at, take, k = at + take, 64, k + 1
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    rooms: list[int] = []
    for w in sorted((w[3] for w in want), reverse=True):  # best-fit decreasing, piece by piece
        fit = min((r for r in rooms if r >= w), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((64 if fit is None else fit) - w)
    assert len(seqs) == len(rooms)
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("t", ["a b", "a  b", " a", "a ", "a\nb c", "<|endoftext|> x", "it's o'clock", "ÀÉ ñ 漢字 😀", "a b", "\t", "x" * 1000 + " y"])
def test_encoder(t):
    enc = packing.encoder("byte_bpe_50k.json")
    assert np.frombuffer(enc.packed(t), "<u4").tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def test_hilbert(spark):
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    h = hilbert.hilbert_index(cells, 3)
    assert sorted(h) == list(range(512))
    walk = cells[np.argsort(h)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
    rows = [(i if i % 11 else None, f"s{i % 7}" if i % 5 else None, i * i % 97, "same") for i in range(403)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_chars long, part string")
    out = hilbert.shard_rows(df, ["n_chars", "source"], 40, ["doc_id", "n_chars", "source"]).collect()
    per = defaultdict(list)
    for r in out:
        per[r["shard"]].append(r["slot"])
    assert len(out) == 403 and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    assert hilbert.shard_rows(df.limit(0), ["n_chars"], 40, ["doc_id"]).count() == 0


def test_hilbert_query(spark, tmp_path):
    """The registered query against its contract, with nulls, long texts and repeats; written files prune on every dimension."""
    rng = random.Random(17)
    rows = [(None if i % 90 == 0 else i, None if i % 40 == 0 else "" if i % 41 == 0 else text(rng, rng.randint(1, 60)), rng.choice(["en", "de", None]), f"https://common.example/start/{rng.randrange(20):02d}", rng.randrange(5000), "mine") for i in range(3000)]
    rows += rows[:30] + [(9999, "é" * 200_000, "en", "x", 1, "mine")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = hilbert.op3_hilbert_shards(spark, str(tmp_path)).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=key) == sorted(want, key=key)
    per = defaultdict(list)
    for r in out:
        per[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert set(per) == set(range(40)) and max(map(len, per.values())) - min(map(len, per.values())) <= 1 and all(sorted(v) == list(range(len(v))) for v in per.values())
    sharded = hilbert.shard_rows(df.select("doc_id", "n_chars", "source"), ["n_chars", "source"], 40, ["doc_id"])
    hilbert.write_shards(sharded, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(rows)
    held = back.groupBy("shard").agg(F.min("n_chars").alias("a"), F.max("n_chars").alias("b"), F.min("source").alias("c"), F.max("source").alias("d")).collect()
    # a range of either dimension concerns a part of the files; cut by one dimension alone, the other would concern all
    assert sum(r["a"] <= 2600 and r["b"] >= 2500 for r in held) <= 20 and sum(r["c"] <= "https://common.example/start/07" <= r["d"] for r in held) <= 20


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("size,num", [(4, 85), (5, 80)])
def test_jaccard(docs, corpus, empty, size, num):
    sets = [(d, shingles(t, size)) for d, t in corpus if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, u in sets[:i]:
            if s and u and 100 * len(s & u) >= num * len(s | u) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    rows = jaccard.jaccard_components(docs, size, num, 100).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["component_id"] == find(r["doc_id"]), r
            assert r["n_shingles"] == len(dict(sets)[r["doc_id"]])
    assert len({find(d) for d in root}) < len(root) - 20
    assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_common_columns(spark):
    """Many copies and near copies, in columns that go in several parts, against brute force."""
    rng = random.Random(11)
    bases = [text(rng, 24) for _ in range(6)]
    near = [" ".join(b.split(" ")[:-k] + [f"n{i}x{k}x{j}" for j in range(k)]) for i, b in enumerate(bases) for k in (1, 2)]
    rows = bases * 1600 + near + [f"f{i} g{i} h{i} i{i} j{i}" for i in range(10_800)]
    assert len(rows) // 4096 >= 4
    sets = {t: shingles(t, 5) for t in bases + near}
    want = {t: rows.index(t) for t in sets}
    for _ in sets:
        for t, s in sets.items():
            want[t] = min(want[u] for u, v in sets.items() if 100 * len(s & v) >= 80 * len(s | v))
    out = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)).collect()}
    assert out == {i: want.get(t, i) for i, t in enumerate(rows)} and set(want.values()) == set(range(6))


def test_jaccard_families(spark):
    """A group of near copies around the threshold, sizes in several classes, in families of many blocks, against brute force."""
    rng = random.Random(12)
    base = text(rng, 160).split(" ")
    rows = [" ".join(w if rng.random() > rate else f"e{rng.randrange(10**9)}" for w in base[: 160 - 8 * (i % 9)]) for i in range(400) for rate in (0.005 * (i % 9),)]
    rows += rows[:40]
    sets = [shingles(t, 5) for t in rows]
    at = [jaccard.shingle_set(t, 5) for t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df, block=16, block_members=2000).collect()}
    assert got == {i: find(i) for i in range(len(rows))} and len(set(got.values())) > 20
    # every pair of blocks, with nothing joined before
    named = [(0, i, i, len(s), s.tobytes()) for i, s in enumerate(at)]
    links = jaccard.family_links(spark.createDataFrame(named, "family long, node long, root long, n long, members binary"), 80, 100, 16, 2000).collect()
    assert all(100 * len(sets[r["a"]] & sets[r["b"]]) >= 80 * len(sets[r["a"]] | sets[r["b"]]) for r in links)
    flat = labels(len(rows), np.array([r["a"] for r in links]), np.array([r["b"] for r in links]))
    assert flat.tolist() == [find(i) for i in range(len(rows))]


def test_common_line(spark):
    """Pairs whose only shared columns are common to very many rows meet, whatever the number of parts."""
    rng = random.Random(13)
    lines = [text(rng, 24) for _ in range(4)]
    rows = [(i, f"{lines[i % 4]} {text(rng, 6)}") for i in range(8000)]
    pairs = [(10_000 + i, f"{lines[i // 2 % 4]}" + (f" x{i}" if i % 2 else "")) for i in range(8)]
    out = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows + pairs + [(20_000 + i, f"q{i} r{i}") for i in range(9000)], "doc_id long, text string")).collect()}
    assert all(out[10_000 + i] == out[10_000 + i - i % 2] for i in range(8))


def test_components(spark):
    rng = random.Random(14)
    order = list(range(300))
    rng.shuffle(order)
    chain = list(zip(order, order[1:], strict=False)) + [(1000 + i, 1001 + i) for i in range(0, 60, 3)] + [(5000, 5000)]
    edges = spark.createDataFrame(chain, "a long, b long")
    want = {i: 0 for i in order} | {1000 + i + k: 1000 + i for i in range(0, 60, 3) for k in (0, 1)}
    for at_once in (0, 10**6):
        assert {r["id"]: r["root"] for r in components(edges, spark, at_once).collect()} == want
    assert components(edges.limit(0), spark).count() == 0


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = [(i, (base[i % 60] + rng.normal(scale=0.04, size=16) * (i >= 60)).tolist(), i % 60 % 3) for i in range(200)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("inf")] * 16, 1), (903, rows[5][1], None), (904, rows[5][1], 2), (905, rows[5][1], 2), (None, rows[5][1], 2)]
    out = {r["vec_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    good = [(i, np.array(v), k) for i, v, k in rows if i is not None and v and k is not None and np.isfinite(v).all() and any(v)]
    links = defaultdict(set)
    for a, x, k in good:
        for b, y, m in good:
            if a != b and k == m and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a].add(b)
    pairs = sum(map(len, links.values()))
    assert pairs > 100
    assert sum(r["n_links"] for r in out.values()) >= 0.9 * pairs
    for i in (900, 901, 902, 903):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (0, i, True)
    assert len(out) == len(rows)
    assert all(r["n_links"] <= len(links[i]) for i, r in out.items() if i is not None)


def cosine_links(rows, least):
    """Brute force: links of usable vectors, and the smallest id reachable."""
    good = [(i, np.array(v, np.float64), k) for i, v, k in rows]
    m, label = np.stack([x / np.sqrt(x @ x) for _, x, _ in good]), np.array([k for _, _, k in good])
    near = (m @ m.T >= least) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    order = np.argsort([i for i, _, _ in good])
    place = np.empty(len(good), int)
    place[order] = np.arange(len(good))
    root = labels(len(good), place[a], place[b])
    return near.sum(axis=1), [good[order[root[place[k]]]][0] for k in range(len(good))]


@pytest.mark.parametrize("kind,noise", [("float", 0.02), ("float", 0.07), ("double", 0.1)])
def test_near_duplicates_dense(spark, kind, noise):
    """A label with one dense neighbourhood of more than a block, chains, and copies: links found, none below the bound, the same for any block."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    base /= np.sqrt(base @ base)
    rows = [(i, base + rng.normal(scale=noise, size=16) * (i % 5 > 0), 1) for i in range(300)]
    turn = np.linspace(0, 3, 120)
    rows += [(1000 + i, np.cos(t) * np.eye(16)[0] + np.sin(t) * np.eye(16)[1], 2) for i, t in enumerate(turn)]
    rows = [(i, np.asarray(v, "f4" if kind == "float" else "f8").astype(float).tolist(), k) for i, v, k in rows]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    n, root = cosine_links(rows, 0.98)
    found = [{r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(df, block=b).collect()} for b in (16, 4096)]
    assert found[0] == found[1]
    told = np.array([found[0][i][0] for i, _, _ in rows])
    assert (told <= n).all() and told.sum() >= 0.99 * n.sum() > 1000
    assert np.mean([found[0][i][1] == x for (i, _, _), x in zip(rows, root, strict=True)]) >= 0.95


def test_near_duplicates_recall(spark):
    """Recall against brute force on the table of the smallest scale."""
    import duckdb

    rows = duckdb.sql("select vec_id, embedding, label from read_parquet('/root/testdata/sf0.1/embeddings.parquet') where label is not null").fetchall()
    rows = [r for r in rows if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    n, root = cosine_links(rows, 0.98)
    out = {r["vec_id"]: r for r in neardup.op5_sorted_projections(spark, "/root/testdata/sf0.1").collect()}
    told = np.array([out[i]["n_links"] for i, _, _ in rows])
    assert (told <= n).all() and told.sum() >= 0.99 * n.sum()
    assert np.mean([out[i]["component_id"] == x for (i, _, _), x in zip(rows, root, strict=True)]) >= 0.99


def test_passages(spark, docs, corpus, empty):
    rng = random.Random(9)
    passage, near = text(rng, 70), text(rng, 90)
    planted = [(500 + i, f"{text(rng, 80)} {passage} {text(rng, 40)}") for i in range(6)] + [(600, f"{text(rng, 30)} {near} {text(rng, 30)}"), (601, f"{text(rng, 50)} {edited(rng, near, 1)} {text(rng, 20)}"), (700, text(rng, 300)), (701, f"{passage[:150]} {text(rng, 100)}")]
    df = spark.createDataFrame(planted, "doc_id long, text string")
    found = windows.passages(df).collect()
    texts = dict(planted)
    cut = defaultdict(set)
    for r in found:
        a, b = texts[r["doc_id"]].split(" ")[r["start"] : r["end"]], texts[r["other_id"]].split(" ")[r["other_start"] : r["other_end"]]
        s, u = shingles(" ".join(a), 5), shingles(" ".join(b), 5)
        assert len(s & u) / len(s | u) >= 0.8 and r["end"] - r["start"] >= 50 and r["other_id"] < r["doc_id"]
        cut[r["doc_id"]].update(range(r["start"], r["end"]))
    assert all(set(range(80, 150)) <= cut[500 + i] for i in range(1, 6)) and len(cut[601]) >= 60
    assert not cut[500] and not cut[600] and not cut[700] and not cut[701]
    clean = {r["doc_id"]: r["text"] for r in windows.remove_passages(df).collect()}
    assert passage in clean[500] and all(passage not in clean[500 + i] for i in range(1, 6)) and clean[700] == texts[700]
    kept = windows.remove_passages(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {200, 201, 202, 203, 206, 207, 0, None} <= ids and 205 not in ids
    assert windows.passages(empty).count() == 0


def test_passages_all_partners(spark):
    """A popular line whose first holder shares nothing more, and pairs that share more around it: every repeat is found, whatever partition, batch or chunk."""
    rng = random.Random(31)
    line = text(rng, 30)
    docs = [(i, f"{text(rng, 40)} {line} {text(rng, 40)}") for i in range(60)]
    for i in range(0, 40, 2):
        more = text(rng, 25)
        docs[i + 20 - i % 4 // 2] = (i + 20 - i % 4 // 2, f"{text(rng, 30)} {line} {more} {text(rng, 30)}")
        docs.append((100 + i, f"{text(rng, 20)} {line} {more} {text(rng, 20)}"))
    rng.shuffle(docs)
    grams, want = defaultdict(list), defaultdict(set)
    for d, t in sorted(docs):
        w = t.split(" ")
        for k in range(len(w) - 49):
            run = tuple(w[k : k + 50])
            if any(o < d for o in grams[run]):
                want[d].update(range(k, k + 50))
            grams[run].append(d)
    assert len(want) >= 15
    for parts, how in ((5, {"back": None, "enough": 1}), (1, {}), (5, {}), (40, {})):  # {}: as registered
        cut = defaultdict(set)
        for r in windows.passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), **how).collect():
            cut[r["doc_id"]].update(range(r["start"], r["end"]))
        assert all(want[d] <= cut[d] for d in want), (parts, how)


def test_passages_exact_repeats(spark):
    """Every word of every exact repeat is found with the registered settings: popular lines of many lengths, passages inside texts that repeat themselves, and long shared stretches."""
    rng = random.Random(77)
    lines = [text(rng, n) for n in (12, 30, 44, 49, 50, 51, 60, 140)]
    docs = []
    for i in range(300):
        parts = [text(rng, rng.randint(5, 40))]
        for _ in range(rng.randint(1, 4)):
            parts += [rng.choice(lines), text(rng, rng.choice([0, 1, 3, 30]))]
        if i % 17 == 0:
            parts += [lines[0]] * 9 + [lines[3]] * 3
        docs.append((i, " ".join(parts)))
    grams, want = defaultdict(list), defaultdict(set)
    for d, t in docs:
        w = t.split()
        for k in range(len(w) - 49):
            run = tuple(w[k : k + 50])
            if any(o < d for o in grams[run]):
                want[d].update(range(k, k + 50))
            grams[run].append(d)
    rng.shuffle(docs)
    cut = defaultdict(set)
    for r in windows.passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect():
        cut[r["doc_id"]].update(range(r["start"], r["end"]))
    assert len(want) > 200 and all(want[d] <= cut[d] for d in want)


def test_runs_inside():
    tokens = np.random.default_rng(1).integers(0, 2**63, 40, dtype=np.uint64)
    twice = np.concatenate([tokens, tokens])
    for width in (1, 2, 7, 32, 46, 80, 81):
        h = windows.run_hashes(twice, width)
        assert len(h) == max(0, 81 - width) and len(set(h.tolist())) == min(40, len(h))
        spans = [(3, 9), (8, 60), (70, 79)]
        want = [any(a <= s and s + width - 1 <= b for a, b in spans) for s in range(len(h))]
        assert windows.inside(spans, len(h), width).tolist() == want


def test_compact_windows():
    rng = np.random.default_rng(0)
    tokens = rng.integers(0, 2**63, 120, dtype=np.uint64)
    starts = np.array([0, 50, 60, 120])
    got = set(zip(*(x.tolist() for x in windows.compact_windows(tokens, starts, 12))))
    want = set()
    for a, b in zip(starts[:-1], starts[1:]):
        for c in range(a, b):
            lo = max([i for i in range(a, c) if tokens[i] < tokens[c]], default=a - 1) + 1
            hi = min([i for i in range(c + 1, b) if tokens[i] < tokens[c]], default=b) - 1
            if hi - lo + 1 >= 12:
                want.add((lo, c, hi))
    assert got == want


def base_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_pii(spark, tmp_path):
    rng = random.Random(2)
    texts = ["mail a.b@c-d.org, x@y.zz@q.rr! a@b a%b@c.d%e@f.g", "ip 1.2.3.4.5.6.7.8 and 300.1.1.1 and 001.002.003.255", "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 4111111111111111 9", "tel +1 (555) 123-4567 or +12 or +4930 1234 5678 90-", "é😀 bob@example.com 😀 +49 30 1234567 x", None, "", "7" * 30_000, "a" * 30_000, "1 " * 20_000, "a@b.c," * 600, "u%d@h.example 10.0.0.7 +49 30 1234567, " * 10_000]
    texts += [" ".join(rng.choice(["@", "a", ".", "4111", " ", "+", "1", "-", "b.c", "é"]) for _ in range(60)).replace(" ", rng.choice(["", " "])) for _ in range(60)]
    texts += [f"{text(rng, 20)} zorgon quibble vip{i % 2}@corp.example.com {text(rng, 20)}" for i in range(8)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, spans int").write.parquet(str(tmp_path / "documents.parquet"))
    out = pii.op8_information_sanitisation(spark, str(tmp_path)).collect()
    assert len(out) == len(docs)
    for r in out:
        want = base_spans(dict(docs)[r["doc_id"]] or "")
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["spans"].startswith(told) and r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest(), r["doc_id"]
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(k == w[0] for w in want) for k in ("email", "ip", "card", "phone")]
    by = {r["doc_id"]: r for r in out}
    told = {texts[i][int(a) : int(b)] for i in range(len(texts) - 8, len(texts)) for k, a, b in (x.split(":") for x in by[i]["spans"].split(",")) if k == "term"}
    assert {"zorgon", "quibble"} <= told and not told & {w for w in WORDS}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert clean[0].startswith("mail [EMAIL], [EMAIL]") and "[CARD]" in clean[2] and "zorgon" not in clean[len(texts) - 1] and clean[5] is None and clean[6] == ""


def test_disclosing_whole_texts(spark):
    """Terms at the far ends of long texts count, and shares against brute force where one text has many copies."""
    rng = random.Random(6)
    texts = [f"Zorgonia {text(rng, 60)} ann@corp.example.com {text(rng, 60)} +49 30 1234567 {text(rng, 60)} quibbleton{'' if i % 2 else ' common'}" for i in range(4)]
    texts += [f"{text(rng, 30)} ip 10.0.0.{i % 3} wandering{'' if i % 4 else ' common'}" for i in range(9)] + [f"common {text(rng, 20)}" for _ in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:1] * 700 + texts[5:6] * 40)), "doc_id long, text string")
    own = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    words = [set(re.findall(r"[^\W\d_]{3,}", own.sub(" ", t).lower())) for t in texts]
    ents = [{f"{k}:{t[a:b].lower()}" for k, a, b in base_spans(t)} for t in texts]
    want = set()
    for e in set().union(*ents):
        for t in set().union(*words):
            n, n_e, n_t, n_et = len(texts), sum(e in x for x in ents), sum(t in x for x in words), sum(e in x and t in y for x, y in zip(ents, words))
            if n_et >= 3 and (share := np.log(n_et * n / (n_t * n_e)) / np.log(n / n_e)) >= 0.6:
                want.add((e, t, bool(share >= 0.85)))
    keyed = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", pii._key().alias("text_key"))
    each = spark.createDataFrame([(i, e) for i, x in enumerate(ents) for e in x], "i long, entity string").join(keyed, "i").select("text_key", "entity")
    assert {tuple(r) for r in pii.disclosing(docs, each, docs.select(pii._key().alias("text_key"))).collect()} == want
    assert {("email:ann@corp.example.com", t, True) for t in ("zorgonia", "quibbleton")} <= want
    extra = {r["doc_id"]: set(r["terms"]) for r in pii.analyse(docs)[1].collect()}
    assert all({"zorgonia", "quibbleton"} <= extra[i] for i in [*range(4), len(texts)])


def test_html(spark):
    shell = "<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy now</div>{}<footer>(c) 2020</footer></body></html>"
    pages = [(i, f"https://h{i % 2}.example.com/{i}", shell.format(f"<div class='post-{i}'><h1>T &amp; {i}</h1><p>Some  longer text that is the article, number {i}.<br><p>Second\n part</div><div class='comments'>Nice page, I like it a lot, thanks</div>"), "x") for i in range(6)]
    pages += [(90, None, None, "x"), (91, "http://x/", "", "x"), (92, "nonsense", "<p>Plain &lt;text&gt; <script>var a = '<p>'</script>here<!-- no -->", "x"), (93, "https://h0.example.com/z", "<b>" * 3000 + "deep" + "<div>" * 3000, "x"), (0, pages[0][1], pages[0][2], "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    rows = html.extract_pages(df).collect()
    got = {r["page_id"]: r["text"] for r in rows}
    for i in range(6):
        assert got[i] == f"T & {i}\nSome longer text that is the article, number {i}.\nSecond part"
    assert got[90] == got[91] == "" and got[92] == "Plain <text> here" and got[93] == "deep" and len(rows) == len(pages)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert html.extract_pages(df.limit(0)).count() == 0


MISNAMED = ["content sidebar-right", "widget Blog", "post share-enabled", "layout header-fixed", "comment-policy-article", "story subscription-free", "page-header", "menu-recipe", "entry", ""]


def test_html_known_articles(spark):
    """Generated pages of hosts whose article classes mislead, with everything beside an article; the article is known."""
    rng = random.Random(21)
    pages, want = [], {}
    for i in range(200):
        host = i % len(MISNAMED)
        paras = [text(rng, rng.randint(12, 60)) + " &eacute;&amp;" for _ in range(rng.randint(1, 6))]
        beside = [f"<nav><ul>{'<li><a href=/x>menu item</a></li>' * 8}</ul></nav>", f"<div class='sidebar-{i}'><p>{text(rng, 15)}</p></div>", "<div class=ad>Buy now</div>", "<form><input name=q> search here <button>Go</button></form>", "<div id=cookie-notice>We use cookies</div>", "<script>var x = '<p>no</p>'</script><style>p{}</style>"]
        after = [f"<div class='comments c{i}'><p>{text(rng, 20)}</p></div>" * (i % 4), "<footer>(c) 2020</footer>", "<div hidden>unseen</div>"]
        rng.shuffle(beside)
        body = "".join(f"<p>{x.replace(' ', chr(10) + ' ', 1)}</p>" for x in paras)
        pages.append((i, f"https://h{host}.example.org/{i}", f"<!doctype html><html><body>{''.join(beside)}<div class='{MISNAMED[host]}'><h1>Head {i}</h1>{body}</div>{''.join(after)}</body></html>"))
        want[i] = "\n".join([f"Head {i}", *(x.replace("&eacute;&amp;", "é&") for x in paras)])
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == want


@pytest.mark.parametrize("piece", ["<svg>", "<blockquote>x", "<b>x</i>", "<div>x", '<a href="x ', "<select>x", "<!-- x", "<tr><td>", "<a"])
def test_html_in_proportion(piece):
    """Time for a page of unclosed elements grows with its length, not with its square."""
    import time

    took = []
    for n in (100_000, 800_000):
        began = time.process_time()
        html.extract(piece * (n // len(piece)), None, set())
        took.append(time.process_time() - began)
    assert took[1] < 20 * took[0] + 0.5


def test_pieces(spark, docs, corpus, empty):
    odd = [(800, "  a  b "), (801, "▁x ▁ y"), (802, "漢字 😀\n\n\ttab"), (803, "é́")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    out = pieces.sampled(df)
    rows = out.collect()
    assert all(r["lossless"] and len(r["ids"]) == r["n_ids"] for r in rows) and len(rows) == len(corpus) + 4
    again = {(r["doc_id"], r["ids_crc32"]) for r in pieces.sampled(df.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["ids_crc32"]) for r in rows}
    assert {r["doc_id"]: r["text"] for r in pieces.decoded(out.where("doc_id >= 800")).collect()} == dict(odd)
    assert pieces.sampled(empty).count() == 0


def test_pieces_distribution():
    import itertools

    lat = pieces.lattices("piece_bpe_32k.model", 1.0)
    v, word, n = lat.v, " hello", 40_000
    ids = {lat.v.raw[a : a + k].tobytes().decode("utf-8", "replace"): i for i, (a, k) in enumerate(zip(v.raw_at, v.raw_len)) if np.isfinite(v.log[i])}
    weight = {}
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[at:i])
                at = i
        parts.append(word[at:])
        if all(p in ids for p in parts):
            weight[tuple(ids[p] for p in parts)] = np.exp(sum(v.log[ids[p]] for p in parts))
    flat, k = lat.sample(["hello"] * n, pieces.row_seeds(list(range(n)), ["hello"] * n, 1))
    at = np.concatenate([[0], np.cumsum(k)])
    seen = defaultdict(int)
    for i in range(n):
        seen[tuple(flat[at[i] : at[i + 1]].tolist())] += 1
    total = sum(weight.values())
    assert set(seen) <= set(weight) and max(abs(seen[s] / n - w / total) for s, w in weight.items()) < 0.01


def test_pieces_draws():
    """A draw just below 1 stays on its state's edges however large the numbers, and a unit's edges are the same whatever was built before."""
    alone, after = pieces.Lattices(pieces.Vocabulary(__import__("public_tokenizers").path("piece_bpe_32k.model"), 1.0)), pieces.lattices("piece_bpe_32k.model", 1.0)
    rng = random.Random(3)
    for _ in range(20):
        after.sample([text(rng, 2000) + " " + "".join(chr(rng.randrange(0x100, 0x3000)) for _ in range(200))], np.array([5], np.uint64))
    words = ["hello", "unbelievable", "漢字x", "a" * 40]
    seeds = pieces.row_seeds(list(range(500)), ["x"] * 500, 9)
    for w in words:
        one, two = alone.sample([w] * 500, seeds), after.sample([w] * 500, seeds)
        assert (one[0] == two[0]).all() and (one[1] == two[1]).all()
    for lat in (alone, after):
        for shift in (0, (1 << 29) - 1 - lat.states):
            lat.sums[: lat.n] += np.uint64(shift) << pieces.ABOVE
            states = np.unique(lat.sums[: lat.n - 1] >> pieces.ABOVE)[1:-1]
            last = lat.edges(states, np.full(len(states), (1 << pieces.BITS) - 1, np.uint64))
            assert ((lat.sums[last] - np.uint64(1) >> pieces.ABOVE) == states).all()
            lat.sums[: lat.n] -= np.uint64(shift) << pieces.ABOVE


def test_toxicity(spark, empty):
    rng = random.Random(4)
    bad = ["scum", "idiot,", "moron", "trash", "Loser!"]
    rows = [(i, text(rng, 80) + (" " + " ".join(rng.sample(bad, 1 + i % 3)) if i % 4 == 0 else "")) for i in range(900)]
    docs = spark.createDataFrame([*rows, (990, None), (991, ""), (992, "scum " * 20_000), (0, rows[0][1])], "doc_id long, text string")
    docs = docs.withColumn("grade", F.lit("mine"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(700)] + [(5000, 1), (3, None), (None, 1)], "doc_id long, grade int")
    model = toxicity.train(docs, labels, binary=True)
    out = {r["doc_id"]: r for r in toxicity.grade(docs, model).collect()}
    held = range(700, 900)
    assert sum(out[i]["rejected"] == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert not out[990]["rejected"] and not out[991]["rejected"] and list(model.thresholds) == sorted(model.thresholds)
    assert np.mean([out[i]["severity"] for i in held if i % 4 == 0]) > np.mean([out[i]["severity"] for i in held if i % 4]) + 0.5
    nothing = toxicity.train(empty, labels)
    assert not any(r["rejected"] for r in toxicity.grade(docs, nothing).collect())
    assert toxicity.grade(empty, model).count() == 0


def test_gradient():
    """The fit is the optimum: the likelihood, written out row by row, falls along no coordinate."""
    rng = random.Random(7)
    pool = ["good", "bad", "evil", "day", "night"]
    texts = [" ".join(rng.sample(pool, rng.randint(1, 4))) for _ in range(300)]
    grades = [min(2, ("bad" in t) + ("evil" in t) + (rng.random() < 0.2)) for t in texts]
    model = toxicity.fit(texts, grades, least=1.0)
    assert model.weights and (np.diff(model.thresholds) > 0).all()

    def loss(weights, thresholds):
        total = 0.0
        for t, y in zip(texts, grades, strict=True):
            s = sum(weights.get(f, 0.0) for f in toxicity.terms(t))
            up = 1 / (1 + np.exp(s - thresholds[y])) if y < 2 else 1.0
            down = 1 / (1 + np.exp(s - thresholds[y - 1])) if y else 0.0
            total -= np.log(up - down)
        return total / len(texts) + 1e-4 / 2 * sum(w * w for w in weights.values())

    best = loss(model.weights, model.thresholds)
    for name in model.weights:
        for step in (-0.05, 0.05):
            assert loss(model.weights | {name: model.weights[name] + step}, model.thresholds) > best
    for k in (0, 1):
        for step in (-0.05, 0.05):
            assert loss(model.weights, model.thresholds + step * (np.arange(2) == k)) > best
    above = model.above(model.score("bad evil"))
    assert abs(above.sum() - sum(k * p for k, p in enumerate(-np.diff([1.0, *above, 0.0])))) < 1e-12


def test_counts():
    """Hashed counts lose no feature, whatever shares its place."""
    rng = random.Random(8)
    texts = [" ".join(f"u{rng.randrange(3000)}" for _ in range(200)) for _ in range(120)]
    df, high = toxicity.counts(texts, [i % 3 == 0 for i in range(120)], toxicity.words_of, 3, 0)
    true = defaultdict(int)
    for t in texts:
        for w in set(t.split()):
            true[w] += 1
    assert all(df[w] == c for w, c in true.items() if c >= 3)


def test_training_sample(spark):
    """A document that occurs very often counts once in the fit, and labels alike on all its texts."""
    rows = [(i, f"{'scum idiot' if i % 2 else 'fine day'} number{i % 7}") for i in range(200)]
    labels_ = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, grade int")
    one, many = (toxicity.train(spark.createDataFrame(r, "doc_id long, text string"), labels_, binary=True) for r in (rows, rows + rows[:1] * 3000))
    assert one.weights == many.weights and one.thresholds.tolist() == many.thresholds.tolist()




def test_passages_meet_all_documents_around_a_popular_line(spark, monkeypatch):
    rng = np.random.default_rng(5)
    line = [f"l{k}" for k in range(40)]
    docs = []
    for k in range(30):  # a near copy of 55 words, 30 documents later; 49 of them in a row, 40 of these in all documents
        own = [f"w{x}" for x in rng.integers(0, 10**9, 15)]
        other = [*own[:5], f"x{k}", *own[6:]]
        pad = lambda: [f"p{x}" for x in rng.integers(0, 10**9, 60)]
        docs += [(i, " ".join([*pad(), *w[:12], *line, *w[12:], *pad()])) for i, w in ((k, own), (k + 30, other))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    links = lambda **how: {(r["doc_id"], r["other_id"]) for r in windows.passages(df, **how).collect()}
    want = {(k + 30, k) for k in range(30)}
    found = links()
    assert len(found & want) >= 27
    assert len(links(back=3) & want) < 27
    monkeypatch.setattr(windows, "BLOCK", 8)
    assert links() == found


def test_passages_of_repeated_lines_meet_once(spark, monkeypatch):
    """Lines said over and over in many documents: a few pairs of places, not one for each pair of their windows; near copies beside them are found."""
    rng = np.random.default_rng(8)
    pad = lambda n: [f"p{x}" for x in rng.integers(0, 10**9, n)]
    line = [f"l{k}" for k in range(30)]
    docs, want = [], set()
    for k in range(12):
        own = pad(60)
        for i, w in ((k, own), (k + 12, [*own[:30], f"x{k}", *own[31:]])):
            docs.append((i, " ".join([*pad(40), *["spam"] * (90 + i), *pad(40), *line * 6, *pad(40), *w, *pad(20)])))
        want.add((k + 12, k))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    sizes = {}
    stored = windows.stored
    monkeypatch.setattr(windows, "stored", lambda frame, what: sizes.__setitem__(what, (out := stored(frame, what)).count()) or out)
    found = windows.passages(df).collect()
    links = {(r["doc_id"], r["other_id"]) for r in found}
    at = {i: t.split().index("spam") for i, t in docs}
    assert all(any(r["doc_id"] == i and r["start"] <= at[i] and r["end"] >= at[i] + 90 + i for r in found) or i == 0 for i in (1, 5, 11))
    assert len(want & links) >= 11
    assert sizes["met"] < 5_000


def test_passages_around_a_popular_line_beside_repeated_words(spark, monkeypatch):
    """A line of 12 words in many documents, beside words said over and over in some, makes no candidates of all their pairs; a near copy of such a passage is found."""
    rng = np.random.default_rng(9)
    pad = lambda n: [f"p{x}" for x in rng.integers(0, 10**9, n)]
    line = [f"l{k}" for k in range(12)]
    docs = [(i, " ".join([*pad(60), *line, *([f"f{i}"] * 60 if i < 8 else pad(60))])) for i in range(60)]
    own = [*["again"] * 20, *line, *pad(60)]
    docs += [(60, " ".join([*pad(30), *own, *pad(30)])), (61, " ".join([*pad(50), *own[:60], "x", *own[61:], *pad(10)]))]
    sizes, stored = {}, windows.stored
    monkeypatch.setattr(windows, "stored", lambda frame, what: sizes.__setitem__(what, (out := stored(frame, what)).count()) or out)
    found = windows.passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {(r["doc_id"], r["other_id"]) for r in found} == {(61, 60)}
    assert sizes["places"] < 100


def test_places_are_verified_together_as_one_by_one():
    rng = np.random.default_rng(10)
    sides = [], []
    for _ in range(150):
        n, kinds = int(rng.integers(30, 300)), int(rng.choice([5, 60, 10**6]))
        a = rng.integers(0, kinds, n).astype("<u4")
        b = np.where(rng.random(n) < rng.choice([0, 0.02, 0.3]), rng.integers(0, kinds, n), a).astype("<u4")
        sides[0].append(a)
        sides[1].append(b[: 0 if rng.random() < 0.05 else n])
    ends = [np.concatenate([[0], np.cumsum([len(x) for x in side])]) for side in sides]
    got = windows.verified_places(np.concatenate(sides[0]), ends[0], np.concatenate(sides[1]), ends[1], 50, 0.8)
    assert sorted(zip(*(c.tolist() for c in got), strict=True)) == sorted((k, *r) for k, (a, b) in enumerate(zip(*sides, strict=True)) for r in windows.verified(a, b, 50, 0.8))


def test_fewest_distinct_tokens():
    rng = np.random.default_rng(11)
    for _ in range(60):
        n = int(rng.integers(12, 50))
        tokens = rng.integers(0, int(rng.choice([2, 8, 1000])), n).astype("<u4")
        c, d = (int(x) for x in rng.integers(0, n, 2))
        e, h = (min(n - 1, x + int(rng.integers(0, 4))) for x in (c, d))
        fewest, _ = windows.fewest_distinct(tokens, np.array([0, n]), {k: np.array([x + 7]) for k, x in (("lo", 0), ("c", c), ("e", e), ("d", d), ("h", h))}, 12)
        runs = [len(set(tokens[s:t].tolist())) for s in range(n) for t in range(s + 12, n + 1) if s <= e and t > c and s <= h and t > d]
        assert fewest[0] <= min(runs) and (fewest[0] == min(runs) or max(c, d) - 11 > min(e, h))


def test_tasks_leave_no_words_behind():
    from lumenframe.llm import common

    assert list(common.lean(lambda frames: (len(common.word_hashes(t)) for t in frames))(iter(["a b", "c"]))) == [2, 1]
    assert not common.WORDS
