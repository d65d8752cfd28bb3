"""Groups of two tokenizers' tokens against byte offsets, and counts against plain dictionaries."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumenframe.llm import alignment as L

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def plain():
    """(ids of a, ids of b, groups) of a text, by whole encodings and byte offsets; none if the bytes differ."""
    import sentencepiece
    from tokenizers import Tokenizer

    t, sp = Tokenizer.from_file(P.path(L.A)), sentencepiece.SentencePieceProcessor(model_file=P.path(L.B))
    t.encode_special_tokens = True
    letters = L.byte_letters()

    def groups(text: str):
        full = f" {text}"
        a, b = t.encode(full, add_special_tokens=False), sp.encode(text)
        raw_a = [bytes(letters[c] for c in x) for x in a.tokens]
        raw_b = [bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in b)]
        if b"".join(raw_a) != full.encode() or b"".join(raw_b) != full.encode():
            return None
        ends_a, ends_b = (np.cumsum([len(x) for x in raw]).tolist() for raw in (raw_a, raw_b))
        cuts = [(ends_a.index(e) + 1, ends_b.index(e) + 1) for e in sorted(set(ends_a) & set(ends_b))]
        return a.ids, b, cuts

    return groups


def texts() -> list[tuple]:
    rng = random.Random(11)
    bits = ["a", "b", " ", "  ", "\n", "\t", "é", "the", "ing", " word", "'s", "1234", "<|endoftext|>", "<s>", "<0x0A>", "漢字", "😀", " ", "\r\n", ".", "!!", "\x1c", "　", "Ａ", "ﬁ", "tokenization"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 25)))) for i in range(300)]
    rows += [(400 + i, "the tokenization of words and the words of tokenization") for i in range(50)]
    rows += [(500, None), (501, ""), (502, " "), (503, "a ▁ b"), (504, "x" * 3000), (505, "long " * 4000), (505, "long " * 4000), (None, "the words"), (None, None), (506, "the"), (507, " leading"), (508, "trailing "), (509, "\n")]
    return rows


def test_aligned(spark, plain):
    """Every column, with repeated rows, nulls and a text whose pieces aren't its bytes."""
    rows = texts()
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, pairs int, n_a int").repartition(4)
    count, told = Counter(), []
    for d, t in rows:
        got = plain(t) if t else None
        links = [(got[0][i - 1], got[1][j - 1]) for i, j in got[2]] if got else []
        count.update(links)
        told.append((d, got, links))
    highest = defaultdict(int)
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    want = []
    for d, got, links in told:
        if not got:
            want.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, cuts = got
        text = ";".join(f"{','.join(map(str, a[p:i]))}|{','.join(map(str, b[q:j]))}" for (p, q), (i, j) in zip([(0, 0), *cuts], cuts, strict=False))
        want.append((d, len(a), len(b), len(cuts), len(links), sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    out = L.aligned(df)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert sum(w[1] > 0 for w in want) > 300 and any(w[1] == 0 and t for w, (_, t) in zip(want, rows, strict=True))


def test_alignments(spark, plain):
    """Tokens and cuts as arrays, in texts of many units."""
    rows = [(d, t) for d, t in texts() if d is not None]
    got = sorted(map(tuple, L.alignments(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    want = []
    for d, t in rows:
        g = (plain(t) if t else None) or ([], [], [])
        want.append((d, list(g[0]), list(g[1]), [c[0] for c in g[2]], [c[1] for c in g[2]]))
    assert got == sorted(want, key=repr)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.aligned(df).collect() == [] and L.alignments(df).collect() == []


def test_transducer():
    """Any two ways to cut the same bytes; transitions are kept, and bytes that differ are told."""
    rng = random.Random(1)
    pieces = [bytes(x, "ascii") for x in ("a", "b", "ab", "ba", "aab", "bba", "abab")]
    t = L.Transducer(dict(enumerate(pieces)), dict(enumerate(pieces)))

    def cut(raw: bytes) -> list[int]:
        out = []
        while raw:
            k = rng.choice([k for k, p in enumerate(pieces) if raw.startswith(p)])
            out.append(k)
            raw = raw[len(pieces[k]) :]
        return out

    for _ in range(500):
        raw = bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 20)))
        a, b = cut(raw), cut(raw)
        ends = [np.cumsum([len(pieces[k]) for k in x]).tolist() for x in (a, b)]
        assert t.groups(a, b) == [(ends[0].index(e) + 1, ends[1].index(e) + 1) for e in sorted(set(ends[0]) & set(ends[1]))]
    assert t.groups([0], [1]) is None and t.groups([0], [2]) is None and t.groups([2], [0]) is None and t.groups([], []) == []
    assert t.step(L.A_LEADS, b"ab", 0) == (L.A_LEADS, b"b") and t.step(L.B_LEADS, b"a", 2) == (L.A_LEADS, b"b") and (L.A_LEADS, b"ab", 0) in t.known


def test_units():
    assert L.units_of("a b  c \n d e") == ["a", "b  c \n d", "e"] and L.units_of(" a") == [" a"] and L.units_of("a ") == ["a "] and L.units_of(" ") == [" "]
    rng = random.Random(8)
    for _ in range(2000):
        t = "".join(rng.choice("ab \n\t") for _ in range(rng.randrange(1, 12)))
        assert " ".join(L.units_of(t)) == t


def test_bounded_cache(plain):
    """Clearing what is kept changes nothing."""
    al = L.Aligner(P.path(L.A), P.path(L.B))
    al.UNITS = 5
    for _, t in texts()[:60]:
        rows, n = al.texts([t or ""])
        got = plain(t) if t else None
        assert tuple(n[0, :3]) == ((len(got[0]), len(got[1]), len(got[2])) if got else (0, 0, 0)) and len(rows[0]) == (len(L.units_of(t)) if got else 0)
