"""Sampled segmentation into pieces by forward filtering and backward sampling, and lossless decoding.

A text is a blank and the text; blanks begin units (" word"), and no piece crosses a unit's end.  The lattice of a
unit has a state per character and an edge per piece of the vocabulary that fits; a character that no piece
covers alone has an edge of its byte pieces.  The forward pass sums the weights of all ways to each
state; from the end, each step back draws an edge in proportion.  So a segmentation is drawn with probability
proportional to the product of its pieces' weights, sharpened by ``sharpness``.

The vocabulary is of the byte-pair kind: it ranks its pieces and gives no probabilities.  Weights follow
Zipf's law over that rank.

Draws come from a counter (row key, unit, step) and are compared with whole numbers (``BITS`` of a probability),
which are made from the unit alone.  So a row's segmentation depends on its key, its text and the seed, not on
partitions, order, retries or what else a task has met.

Scale: no shuffle.  Lattices of a chunk's new units are built together with array operations and kept in a
table of bounded size; all rows of a chunk are sampled together.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, mix64, ship_code

BLANK = "▁"
PRIME = np.uint64(0x100000001B3)
#: a cumulative probability is a whole number up to 2**BITS, the number of its state stands above it
BITS = 34
ABOVE = np.uint64(BITS + 1)


class Vocabulary:
    """Pieces of a SentencePiece model with byte pieces, as arrays to look runs of characters up in."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = np.zeros(256, np.int32)
        normal = []
        for i, p in enumerate(names):
            if sp.is_byte(i):
                self.byte_id[int(p[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append((i, p.replace(BLANK, " ")))
        normal = [(i, p) for i, p in normal if " " not in p[1:]]
        ranked = sorted(normal, key=lambda x: (-sp.get_score(x[0]), x[0]))
        rank = {i: r for r, (i, _) in enumerate(ranked)}
        logs = -np.log(np.arange(len(ranked)) + 2.0)
        total = np.log(np.exp(logs).sum())
        self.log = np.full(n, -np.inf)
        for i, _ in normal:
            self.log[i] = sharpness * (logs[rank[i]] - total)
        self.byte_log = sharpness * (-np.log(len(ranked) + 2.0) - total)
        self.longest = max(len(p) for _, p in normal)
        self.full: list[tuple[np.ndarray, np.ndarray]] = []  # by length: hashes in order, ids
        self.prefix: list[np.ndarray] = []  # hashes of all beginnings of that length
        for k in range(1, self.longest + 1):
            own = sorted((_hash(p), i) for i, p in normal if len(p) == k)
            self.full.append((np.array([h for h, _ in own], np.uint64), np.array([i for _, i in own], np.int32)))
            self.prefix.append(np.unique(np.array([_hash(p[:k]) for _, p in normal if len(p) >= k], np.uint64)))
        # decoding: bytes of each piece
        raw = [p.encode() for p in (x.replace(BLANK, " ") for x in names)]
        for b, i in enumerate(self.byte_id.tolist()):
            raw[i] = bytes([b])
        self.raw_len = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw_len)])[:-1]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of a segmentation, as bytes, without the leading blank."""
        return _gather(self.raw, self.raw_at[ids], self.raw_len[ids]).tobytes()[1:]


def _hash(text: str) -> int:
    h = np.zeros(1, np.uint64)
    for c in text:
        h = h * PRIME + np.uint64(ord(c) + 1)
    return int(mix64(h)[0])


def _gather(flat: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The stretches ``flat[at : at + lens]`` end to end."""
    total = int(lens.sum())
    ends = np.cumsum(lens)
    return flat[np.arange(total) + np.repeat(at - (ends - lens), lens)]


def _find(sorted_: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_, h), max(0, len(sorted_) - 1))
    return at, sorted_[at] == h if len(sorted_) else np.zeros(len(h), bool)


class Units(dict):
    """unit -> number.  Numbers not yet built wait in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        self.new.append(unit)
        return n


class Lattices:
    """Lattices of units, edges by the state they end in, with running sums of their probabilities."""

    EDGES = 5_000_000

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.units = Units()
        self.end = np.zeros(0, np.int64)  # last state of each unit
        self.first = np.zeros(0, np.int64)
        self.states = 0
        self.n = 0
        self.sums = np.zeros(1 << 16, np.uint64)  # state, and cumulative probability below it
        self.code = np.zeros(1 << 16, np.int32)  # a piece, or -1 - k for the bytes of character k
        self.back = np.zeros(1 << 16, np.int32)  # characters

    def build(self) -> None:
        """Adds the lattices of the units that wait."""
        new, self.units.new = self.units.new, []
        if not new:
            return
        v = self.v
        lens = np.fromiter((len(u) + 1 for u in new), np.int64, len(new))
        # the leading blank of a unit is implied
        cps = np.frombuffer((" " + " ".join(new)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        starts = np.concatenate([[0], np.cumsum(lens)])
        unit = np.repeat(np.arange(len(new)), lens)
        room = starts[unit + 1] - np.arange(len(cps))
        at, h = np.arange(len(cps)), np.zeros(len(cps), np.uint64)
        alone = np.zeros(len(cps), bool)
        edges: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(1, v.longest + 1):
            ok = room[at] >= k
            at, h = at[ok], h[ok]
            if not len(at):
                break
            h = h * PRIME + (cps[at + k - 1] + np.uint64(1))
            mixed = mix64(h.copy())
            _, ok = _find(v.prefix[k - 1], mixed)
            at, h, mixed = at[ok], h[ok], mixed[ok]
            place, ok = _find(v.full[k - 1][0], mixed)
            ids = v.full[k - 1][1][place[ok]] if ok.any() else np.zeros(0, np.int32)
            if k == 1:
                alone[at[ok]] = True
            edges.append((at[ok], np.full(len(ids), k), ids, v.log[ids]))
        rest = np.flatnonzero(~alone)
        c = cps[rest]
        size = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
        edges.append((rest, np.ones(len(rest), np.int64), -1 - c.astype(np.int64), size * v.byte_log))
        p, k, ids, log = (np.concatenate([e[i] for e in edges]) for i in range(4))
        src = p + unit[p]
        dst = src + k
        depth = p - starts[unit[p]] + k
        order = np.lexsort((src, dst, depth))
        src, dst, ids, log, k, depth = src[order], dst[order], ids[order], log[order], k[order], depth[order]
        alpha = np.zeros(len(cps) + len(new))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(depth)) + 1, [len(depth)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            w = alpha[src[a:b]] + log[a:b]
            groups = np.concatenate([[0], np.flatnonzero(np.diff(dst[a:b])) + 1])
            top = np.maximum.reduceat(w, groups)
            counts = np.diff(np.concatenate([groups, [b - a]]))
            alpha[dst[a:b][groups]] = top + np.log(np.add.reduceat(np.exp(w - np.repeat(top, counts)), groups))
        order = np.lexsort((src, dst))
        src, dst, ids, log, k = src[order], dst[order], ids[order], log[order], k[order]
        prob = np.minimum(np.exp(alpha[src] + log - alpha[dst]) * (1 << BITS), 1 << BITS).astype(np.int64)
        groups = np.concatenate([[0], np.flatnonzero(np.diff(dst)) + 1])
        counts = np.diff(np.concatenate([groups, [len(dst)]]))
        sums = np.cumsum(prob)
        cdf = np.minimum(sums - np.repeat(sums[groups] - prob[groups], counts), 1 << BITS)
        cdf[groups + counts - 1] = 1 << BITS
        m = self.n + len(dst)
        while m > len(self.sums):
            self.sums, self.code, self.back = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.code, self.back))
        self.sums[self.n : m] = ((dst + self.states).astype(np.uint64) << ABOVE) + cdf.astype(np.uint64)
        self.code[self.n : m] = ids
        self.back[self.n : m] = k
        self.n = m
        first = starts[:-1] + np.arange(len(new)) + self.states
        self.first = np.concatenate([self.first, first])
        self.end = np.concatenate([self.end, first + lens])
        self.states += len(cps) + len(new)

    def edges(self, state: np.ndarray, draw: np.ndarray) -> np.ndarray:
        """The edge into each state that a draw below 2**BITS falls on."""
        return np.searchsorted(self.sums[: self.n], (state.astype(np.uint64) << ABOVE) + draw, side="right")

    def sample(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each text)."""
        if self.n > self.EDGES:
            self.clear()
        look = self.units.__getitem__
        rows = [list(map(look, t.split(" "))) for t in texts]
        count = np.fromiter(map(len, rows), np.int64, len(rows))
        unit = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
        self.build()
        row_at = np.concatenate([[0], np.cumsum(count)])
        place = np.arange(len(unit)) - np.repeat(row_at[:-1], count)
        counter = mix64(np.repeat(seeds, count) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        state, first, live = self.end[unit], self.first[unit], np.arange(len(unit))
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        steps = np.zeros(len(unit), np.int64)
        step = 0
        while len(live):
            e = self.edges(state, mix64(counter[live] + np.uint64(step * 0xD1B54A32D192ED03 & (1 << 64) - 1)) >> np.uint64(64 - BITS))
            taken.append((live, self.code[e]))
            state = state - self.back[e]
            steps[live] += 1
            go = state > first
            live, state, first = live[go], state[go], first[go]
            step += 1
        ends = np.cumsum(steps)
        codes = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        for k, (who, code) in enumerate(taken):
            codes[ends[who] - 1 - k] = code
        # byte pieces of characters without one
        lens = np.ones(len(codes), np.int64)
        odd = np.flatnonzero(codes < 0)
        per_unit = steps
        if len(odd):
            chars, which = np.unique(codes[odd], return_inverse=True)
            raw = [self.v.byte_id[np.frombuffer(chr(-1 - c).encode("utf-8", "surrogatepass"), np.uint8)] for c in chars.tolist()]
            lens[odd] = np.array([len(r) for r in raw])[which]
            extra = np.zeros(len(codes), np.int64)
            extra[odd] = lens[odd] - 1
            sums_ = np.concatenate([[0], np.cumsum(extra)])
            per_unit = steps + sums_[ends] - sums_[ends - steps]
            out = np.repeat(codes, lens)
            at = np.cumsum(lens) - lens
            for j in range(4):
                has = odd[lens[odd] > j]
                pick = which[lens[odd] > j]
                if len(has):
                    out[at[has] + j] = np.array([r[j] if len(r) > j else 0 for r in raw])[pick]
            codes = out
        total = np.concatenate([[0], np.cumsum(per_unit)])
        return codes.astype(np.int32), total[row_at[1:]] - total[row_at[:-1]]


_HELD: dict[tuple, Lattices] = {}


def lattices(model: str, sharpness: float) -> Lattices:
    key = (model, sharpness)
    if key not in _HELD:
        import public_tokenizers

        _HELD[key] = Lattices(Vocabulary(model if "/" in model else public_tokenizers.path(model), sharpness))
    return _HELD[key]


def row_seeds(keys: list, texts: list[str], seed: int) -> np.ndarray:
    """A start for the counter of each row: by its key, or by its text where that is null."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(b"t" + t.encode("utf-8", "surrogatepass") if k is None else b"k%d" % k, seed=seed) for k, t in zip(keys, texts, strict=True)), np.uint64, len(texts))


def chunks_of(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    a, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= chars:
            yield a, i + 1
            a, n = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def sampled(docs: DataFrame, model: str = "piece_bpe_32k.model", sharpness: float = 1.0, seed: int = 0) -> DataFrame:
    """doc_id, ids array<int>, n_ids, ids_crc32, decoded_crc32 and lossless of every text.

    decoded_crc32: of the bytes that the ids decode to; lossless: these are the text's.  Null and empty texts
    are one blank.  Repeated rows get the same ids, and so do rows without a doc_id with equal texts.  A draw
    that falls on the border of two edges takes the later one.  Other columns are left out.
    """
    ship_code(docs.sparkSession)

    def draw(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattices(model, sharpness)
        for batch in frames:
            keys, all_texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks_of(all_texts):
                texts = all_texts[a:b]
                ids, n = lat.sample(texts, row_seeds(keys[a:b], texts, seed))
                at = np.concatenate([[0], np.cumsum(n)])
                crc, back, same = [], [], []
                for i, t in enumerate(texts):
                    own = ids[at[i] : at[i + 1]]
                    crc.append(crc32(own.astype("<u4").tobytes()))
                    plain = lat.v.decode(own)
                    back.append(crc32(plain))
                    same.append(plain == t.encode("utf-8", "surrogatepass"))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64()), lists, pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(back, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_ids", "ids_crc32", "decoded_crc32", "lossless"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(draw), "doc_id long, ids array<int>, n_ids long, ids_crc32 long, decoded_crc32 long, lossless boolean")


def decoded(segmented: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, text of ``segmented(doc_id, ids)``: the exact inverse of ``sampled``.  Null ids give null."""
    ship_code(segmented.sparkSession)

    def join(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = lattices(model, 1.0).v
        for batch in frames:
            texts = [None if ids is None else v.decode(np.asarray(ids, np.int64)).decode("utf-8", "surrogatepass") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return segmented.select(F.col("doc_id").cast("long"), "ids").mapInArrow(lean(join), "doc_id long, text string")


def op9_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document, seeded by doc_id, and what it decodes to; see ``sampled``."""
    return sampled(documents(spark, sf_dir))
