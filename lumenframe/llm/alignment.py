"""Alignment of two tokenizers' tokens by a dangling-suffix transducer.

Both tokenizers cut the same bytes.  The transducer reads their tokens in turn; its state is which side leads and
the bytes of it that the other side hasn't matched yet, a suffix of the leader's last token.  The next token of the
other side shortens these bytes or takes the lead.  Where no bytes are left, a group of tokens of both sides
closes.  Transitions are kept by (leader, suffix, next token).

A text is cut before each single blank between other characters, where neither tokenizer can join what stands on the
two sides, so such a unit's tokens and groups are those of any text that holds it: they are kept, too, in a
table of bounded size.

Scale: no text is shuffled.  Which tokens can end together is told by the vocabularies alone: one's bytes end in
the other's.  That bounds the pairs (a few hundred thousand), so their counts over the whole corpus are one array,
summed per task first, and small enough to broadcast whatever the corpus.  Documents keep their linked pairs as
numbers of such pairs, and the second pass reads these instead of texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, ship_code, stored
from .pieces import chunks_of

LONG_UNIT = 400
NONE_LEADS, A_LEADS, B_LEADS = 0, 1, -1
UNKNOWN = object()


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Byte:
    """A byte-level tokenizer file; special tokens' strings are ordinary text.

    Where the same vocabulary is at hand as ranks, these encode short units: the same ids in less time.
    """

    def __init__(self, file: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        self.short = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
            self.short = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        letters = byte_letters()
        names = sorted(((i, n) for n, i in self.tokenizer.get_vocab().items()), key=lambda x: x[0])
        self.bytes = {i: bytes(letters[c] for c in n) if all(c in letters for c in n) else n.encode() for i, n in names}

    def encode(self, units: list[str]) -> list[list[int]]:
        if self.short is None:
            return [e.ids for e in self.tokenizer.encode_batch(units, add_special_tokens=False)]
        return [self.short(u) if len(u) < LONG_UNIT else self.tokenizer.encode(u, add_special_tokens=False).ids for u in units]


class Piece:
    """A SentencePiece model, which puts a blank before a text."""

    def __init__(self, file: str):
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=file)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("a piece of this model goes on after a blank")
        self.bytes = {i: bytes([int(n[3:-1], 16)]) if sp.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)}

    def encode(self, units: list[str]) -> list[list[int]]:
        return self.model.encode([u[1:] for u in units], num_threads=1)


#: white space at an end of a text, or beside other white space
_WIDE = re.compile(r"\A\s|\s\s|\s\Z")


def units_of(text: str) -> list[str]:
    """A blank and ``text``, cut before each single blank between two characters that are no white space."""
    parts = text.split(" ")
    if text and not _WIDE.search(text):
        return parts
    out = [parts[0]]
    for p in parts[1:]:
        if p and out[-1] and not p[0].isspace() and not out[-1][-1].isspace():
            out.append(p)
        else:
            out[-1] = f"{out[-1]} {p}"
    return out


class Transducer:
    """Groups of two token sequences over the same bytes."""

    LIMIT = 500_000

    def __init__(self, a_bytes: dict[int, bytes], b_bytes: dict[int, bytes]):
        self.a, self.b = a_bytes, b_bytes
        self.known: dict[tuple[int, bytes, int], tuple[int, bytes] | None] = {}

    def step(self, leads: int, left: bytes, token: int) -> tuple[int, bytes] | None:
        """The state after the next token of the side that doesn't lead; none if its bytes differ."""
        own = self.b[token] if leads == A_LEADS else self.a[token]
        if left.startswith(own):
            state = (leads, left[len(own) :]) if len(left) > len(own) else (NONE_LEADS, b"")
        elif own.startswith(left):
            state = (B_LEADS if leads == A_LEADS else A_LEADS, own[len(left) :])
        else:
            state = None
        if len(self.known) >= self.LIMIT:
            self.known.clear()
        self.known[leads, left, token] = state
        return state

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """How many tokens of each side stand before the end of each group; none if the bytes differ."""
        known, cuts, i, j, n, m, leads, left = self.known, [], 0, 0, len(a), len(b), NONE_LEADS, b""
        while True:
            if leads == A_LEADS:
                if j == m:
                    return None
                token = b[j]
                j += 1
            else:
                if i == n:
                    return cuts if leads == NONE_LEADS and j == m else None
                token = a[i]
                i += 1
            state = known.get((leads, left, token), UNKNOWN)
            if state is UNKNOWN:
                state = self.step(leads, left, token)
            if state is None:
                return None
            leads, left = state
            if leads == NONE_LEADS:
                cuts.append((i, j))


class Units(dict):
    """unit -> number.  Numbers not yet aligned wait in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        self.new.append(unit)
        return n


class Aligner:
    """Both tokenizers, the pairs that can end together, and the units met so far."""

    UNITS, BYTES = 400_000, 64 << 20

    def __init__(self, a_file: str, b_file: str, ranks: str | None = None, pattern: str | None = None, whole: bool = True):
        self.a, self.b, self.whole = Byte(a_file, ranks, pattern), Piece(b_file), whole
        self.names = [str(i) for i in range(max(*self.a.bytes, *self.b.bytes) + 1)]
        if not all(self.a.bytes.values()) or not all(self.b.bytes.values()):
            raise ValueError("a token without bytes")
        self.transducer = Transducer(self.a.bytes, self.b.bytes)
        self.width = max(self.b.bytes) + 1
        self.pairs = self._pairs()
        self.clear()

    def _pairs(self) -> np.ndarray:
        """a * width + b of all pairs of which one's bytes end in the other's, in order."""
        ids: tuple[dict[bytes, list[int]], ...] = ({}, {})
        for have, side in zip(ids, (self.a.bytes, self.b.bytes), strict=True):
            for i, raw in side.items():
                have.setdefault(raw, []).append(i)
        found = [a * self.width + b for raw, own in ids[0].items() for k in range(len(raw)) for b in ids[1].get(raw[k:], ()) for a in own]
        found += [a * self.width + b for raw, own in ids[1].items() for k in range(1, len(raw)) for a in ids[0].get(raw[k:], ()) for b in own]
        return np.unique(np.array(found, np.int64))

    def clear(self) -> None:
        self.units, self.size = Units(), 0
        self.told: list[str] = []  # the groups of each unit
        self.ids: list[tuple[bytes, bytes, bytes, bytes]] = []  # and, if ``whole``, its tokens of both sides, and cuts
        self.counts = np.zeros((1 << 14, 4), np.int64)  # tokens of a and b, groups, 1 if the bytes differ
        self.at = np.zeros(1, np.int64)
        self.links = np.zeros(1 << 14, np.int32)

    def align(self) -> None:
        """Aligns the units that wait."""
        new, self.units.new = self.units.new, []
        if not new:
            return
        spaced = [f" {u}" for u in new]
        links: list[int] = []
        counts: list[tuple[int, int, int, int]] = []
        groups, names, width, told = self.transducer.groups, self.names, self.width, self.told
        for a, b in zip(self.a.encode(spaced), self.b.encode(spaced), strict=True):
            cuts = groups(a, b)
            counts.append((len(a), len(b), len(cuts), 0) if cuts is not None else (0, 0, 0, 1))
            own, p, q = [], 0, 0
            for i, j in cuts or ():
                own.append(f"{names[a[p]] if i - p == 1 else ','.join([names[x] for x in a[p:i]])}|{names[b[q]] if j - q == 1 else ','.join([names[x] for x in b[q:j]])}")
                links.append(a[i - 1] * width + b[j - 1])
                p, q = i, j
            told.append(";".join(own))
            if self.whole:
                self.ids.append(tuple(np.asarray(x, "<i4").tobytes() for x in (a, b, [c[0] for c in cuts or ()], [c[1] for c in cuts or ()])))
                self.size += 12 * (len(a) + len(b)) + 200
        rows = np.array(counts, np.int64)
        self.size += sum(map(len, new)) + sum(map(len, told[-len(new) :])) + 4 * len(links)
        n = len(self.at) - 1
        while n + len(new) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.counts[n : n + len(new)] = rows
        codes, end = np.searchsorted(self.pairs, np.array(links, np.int64)).astype(np.int32), int(self.at[-1])
        while end + len(codes) > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.links[end : end + len(codes)] = codes
        self.at = np.concatenate([self.at, end + np.cumsum(rows[:, 2])])

    def texts(self, texts: list[str]) -> tuple[list[list[int]], np.ndarray]:
        """The unit numbers of each text, and per text: tokens of a and b, groups, and whether it has tokens."""
        if len(self.units) > self.UNITS or self.size > self.BYTES:
            self.clear()
        look = self.units.__getitem__
        rows = [list(map(look, units_of(t))) if t else [] for t in texts]
        self.align()
        sums = np.zeros((len(texts), 4), np.int64)
        for k, r in enumerate(rows):
            if r:
                sums[k] = self.counts[r].sum(axis=0)
        sums[:, 3] = [bool(r) and not bad for r, bad in zip(rows, sums[:, 3], strict=True)]
        sums[:, :3] *= sums[:, 3:]
        return [r if ok else [] for r, ok in zip(rows, sums[:, 3], strict=True)], sums


_HELD: dict[tuple[str, str, bool], Aligner] = {}


def aligner(a: str, b: str, whole: bool = True) -> Aligner:
    """Tokenizers by the names of public files, found on each worker, or by paths; ``whole``: units keep their tokens, too."""
    if (a, b, whole) not in _HELD:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers as P

        ranks = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN) if a == "byte_bpe_50k.json" else (None, None)
        _HELD[a, b, whole] = Aligner(*(x if "/" in x else P.path(x) for x in (a, b)), *ranks, whole)
    return _HELD[a, b, whole]


A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def alignments(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """doc_id, a_ids, b_ids, a_cuts, b_cuts: the tokens of a blank and each text, and how many of each side stand before the end of each group.

    Texts that are null or empty, or whose tokens' bytes aren't those of the text, have no tokens.  Repeated rows, and
    rows without a doc_id, are rows of their own; other columns are left out.
    """
    ship_code(docs.sparkSession)
    ints = pa.list_(pa.int32())

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a, b)
        for batch in frames:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for p, q in chunks_of(texts):
                rows, _ = al.texts(texts[p:q])
                columns: list[list[np.ndarray]] = [[], [], [], []]
                for r in rows:
                    for k in range(4):
                        columns[k].append(np.frombuffer(b"".join(al.ids[u][k] for u in r), "<i4"))
                    for k in (2, 3):  # places in a unit become places in the text
                        before = np.cumsum([0, *al.counts[r, k - 2]])[:-1]
                        columns[k][-1] = (columns[k][-1] + np.repeat(before, al.counts[r, 2])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([keys.slice(p, q - p), *(pa.array(c, ints) for c in columns)], ["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(work), "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>")


def linked(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times: the groups of ``alignments`` as a digest, and which pairs of tokens end together how often (numbers of ``Aligner.pairs``)."""
    ship_code(docs.sparkSession)

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a, b, whole=False)
        for batch in frames:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for p, q in chunks_of(texts):
                rows, n = al.texts(texts[p:q])
                count = np.fromiter(map(len, rows), np.int64, len(rows))
                unit = np.concatenate([np.zeros(0, np.int64), *(np.asarray(r, np.int64) for r in rows)])
                lens = al.at[unit + 1] - al.at[unit]
                ends = np.cumsum(lens)
                links = al.links[np.arange(int(lens.sum())) + np.repeat(al.at[unit] - (ends - lens), lens)]
                doc = np.repeat(np.repeat(np.arange(len(rows)), count), lens)
                own, times = np.unique(doc * len(al.pairs) + links, return_counts=True)
                at = np.searchsorted(own, np.arange(len(rows) + 1) * len(al.pairs)).astype(np.int32)
                digests = [hashlib.sha256(";".join(map(al.told.__getitem__, r)).encode()).hexdigest() if r else "" for r in rows]
                columns = [keys.slice(p, q - p), *(pa.array(n[:, k].copy()) for k in (0, 1, 2, 2)), pa.array(digests, pa.string())]
                columns += [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32))) for x in (own % len(al.pairs), times)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(work), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>")


def flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values end to end, offsets) of a list column."""
    column = batch.column(batch.schema.get_field_index(name))
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n: how many links of ``linked`` each pair has; sums of tasks first."""

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in frames:
            if not batch.num_rows:
                continue
            pairs, times = flat(batch, "pairs")[0], flat(batch, "times")[0]
            here = np.bincount(pairs, weights=times, minlength=len(total)).astype(np.int64)
            here[: len(total)] += total
            total = here
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), pa.array(total[have])], ["pair", "n"])

    return links.select("pairs", "times").mapInArrow(lean(work), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def aligned(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """The columns of ``linked`` without pairs and times, and n_best and count_sum.

    A pair of tokens counts how often it ends together in all rows of ``docs(doc_id, text, ...)``.  n_best: links whose pair
    counts most among those of its token of ``b``, ties included; count_sum: the counts of a row's links.  Texts that are null
    or empty, or whose tokens' bytes aren't those of the text, have zeros.  Repeated rows, and rows without a doc_id,
    count each; other columns are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    links = stored(linked(docs, a, b), "links")
    al = aligner(a, b, whole=False)
    got = pair_counts(links).toArrow()  # at most a row per pair of the vocabularies
    count, highest = np.zeros(len(al.pairs), np.int64), np.zeros(al.width, np.int64)
    count[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    of = al.pairs % al.width
    np.maximum.at(highest, of, count)
    held = spark.sparkContext.broadcast((count, (count == highest[of]) & (count > 0)))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = held.value
        for batch in frames:
            (pairs, at), (times, _) = flat(batch, "pairs"), flat(batch, "times")
            sums = [np.concatenate([[0], np.cumsum(x)])[at] for x in (times * best[pairs].astype(np.int64), times * count[pairs])]
            own = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(np.diff(x).astype(np.int64)) for x in sums), batch.column(batch.schema.get_field_index("groups_sha256"))], [*columns, "n_best", "count_sum", "groups_sha256"])

    return links.mapInArrow(lean(work), f"{', '.join(f'{c} long' for c in columns)}, n_best long, count_sum long, groups_sha256 string")


def op13_suffix_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of both public vocabularies in every document, in groups that end together; see ``aligned``."""
    return aligned(documents(spark, sf_dir))
