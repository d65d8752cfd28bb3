"""Best-fit packing planned on the histogram of lengths.

``plan`` runs best-fit decreasing over counts per length: its work depends on the sequence length, not on the
number of documents.  Pieces then take the planned slots by their rank among the pieces of their length.

Scale: pieces are shuffled as a few integers each, once, by (length, hash) so that a length that holds a
third of all pieces spreads over many tasks; the driver sees one count per (length, hash bucket) run of
fixed number, and the plan, whose size the sequence length bounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, ship_code, stored

LONG_CHUNK = 400


class _Odd(Exception):
    """The text isn't plain words with one space between."""


class ChunkIds(dict):
    """" word" -> its ids as packed little-endian 32-bit integers; bounded, and refilled at will.

    A boundary between a non-space character and one space before a non-space character always is a
    boundary of the byte-level pattern, so encoding such chunks one by one gives the ids of the whole.
    """

    LIMIT = 500_000

    def __init__(self, encode, slow):
        self.encode, self.slow = encode, slow

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Odd
        if len(self) >= self.LIMIT:
            self.clear()
        ids = self.encode(" " + chunk) if len(chunk) < LONG_CHUNK else self.slow(" " + chunk)
        out = self[chunk] = np.asarray(ids, dtype="<u4").tobytes()
        return out


class Encoder:
    """Packed ids of whole texts, equal to those of the tokenizer file, faster for plain text."""

    def __init__(self, file: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        encode = self.slow
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encode = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.chunks = ChunkIds(encode, self.slow)
        self.encode = encode

    def slow(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def packed(self, text: str) -> bytes:
        if not text:
            return b""
        try:
            if any(s in text for s in self.specials):
                raise _Odd
            head, _, rest = text.partition(" ")
            if not head or head[-1].isspace() or (not rest and _):
                raise _Odd
            first = self.encode(head) if len(head) < LONG_CHUNK else self.slow(head)
            return np.asarray(first, dtype="<u4").tobytes() + (b"".join(map(self.chunks.__getitem__, rest.split(" "))) if rest else b"")
        except _Odd:
            return np.asarray(self.slow(text), dtype="<u4").tobytes()


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """``tokenizer``: the name of a public tokenizer file, found on each worker, or a path."""
    if tokenizer not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers as P

        if tokenizer == "byte_bpe_50k.json":
            _ENCODERS[tokenizer] = Encoder(P.path(tokenizer), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
        else:
            _ENCODERS[tokenizer] = Encoder(tokenizer if "/" in tokenizer else P.path(tokenizer))
    return _ENCODERS[tokenizer]


def token_pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, limit: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every text's ids followed by ``end_id``, cut to ``limit``; the first piece takes what is left over."""

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.asarray([end_id], dtype="<u4").tobytes()
        for batch in frames:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.packed(text.as_py() or "") + end
                n, at, k = len(ids) // 4, 0, 0
                take = n % limit or limit
                while at < n:
                    rows.append((doc, k, at, take, zlib.crc32(ids[4 * at : 4 * (at + take)])))
                    at, take, k = at + take, limit, k + 1
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram: runs (length, first rank, past rank, first sequence, offset).

    Pieces of ``length`` with ranks first .. past - 1 go to consecutive sequences at the same offset.
    Sequences with equal room are kept as intervals, so a step places as many pieces as an interval holds.
    """
    room: dict[int, list[list[int]]] = {}  # free tokens -> intervals of sequences [from, to)
    runs, sequences = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fit = min((r for r in room if r >= length), default=None)
            if fit is None:
                # new sequences, each filled with as many of this length as it holds
                fit, each = limit, limit // length
                need = -(-left // each)
                room[limit] = [[sequences, sequences + need]]
                sequences += need
            a, b = room[fit][-1]
            n = min(left, b - a)
            if n == b - a:
                room[fit].pop()
                if not room[fit]:
                    del room[fit]
            else:
                room[fit][-1][0] = a + n
            runs.append((length, rank, rank + n, a, limit - fit))
            if fit > length:
                _give(room, fit - length, a, a + n)
            rank, left = rank + n, left - n
    return runs


def _give(room: dict, free: int, a: int, b: int) -> None:
    have = room.setdefault(free, [])
    if have and have[-1][1] == a:
        have[-1][1] = b
    else:
        have.append([a, b])


def place(pieces: DataFrame, limit: int = 1024, buckets: int = 64) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` of 1 to ``limit``.

    The rank of a piece within its length is: pieces of lower buckets, then a row number in the bucket.
    ``buckets`` spreads each length; it grows with the row count, which is read first.
    """
    spark = pieces.sparkSession
    key = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)).cast("int")
    p = pieces.withColumn("_bucket", key)
    table = p.groupBy("length", "_bucket").count().collect()  # at most limit x buckets rows
    counts: dict[int, int] = {}
    starts = []
    for length, bucket, n in sorted(tuple(r) for r in table):
        starts.append((length, bucket, counts.get(length, 0)))
        counts[length] = counts.get(length, 0) + n
    runs = plan(counts, limit)
    by_length: dict[int, tuple[list, list, list, list]] = {}
    for length, a, b, seq, at in runs:
        r = by_length.setdefault(length, ([], [], [], []))
        for x, y in zip(r, (a, b, seq, at), strict=True):
            x.append(y)
    # from Arrow: rows from Python objects would go through workers of their own
    starts = list(zip(*(starts or [(0, 0, 0)]), strict=True))
    starts_df = spark.createDataFrame(pa.table({"length": pa.array(starts[0], pa.int64()), "_bucket": pa.array(starts[1], pa.int32()), "_at": pa.array(starts[2], pa.int64())}))
    p = p.join(F.broadcast(starts_df), ["length", "_bucket"])
    p = p.withColumn("_rank", F.expr("_at + row_number() over (partition by length, _bucket order by doc_id, piece, start, ids_crc32) - 1"))
    held = spark.sparkContext.broadcast({k: tuple(np.asarray(x, dtype=np.int64) for x in v) for k, v in by_length.items()})

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        ln, rk = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(ln), np.int64), np.zeros(len(ln), np.int64)
        order = np.argsort(ln, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(ln[order])) + 1) if len(order) else []:
            a, _, s, o = held.value[int(ln[part[0]])]
            i = np.searchsorted(a, rk[part], side="right") - 1
            seq[part], off[part] = s[i] + rk[part] - a[i], o[i]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return p.withColumn("_slot", slot("length", "_rank")).select(*pieces.columns, "_slot.sequence_id", "_slot.offset")


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, limit: int = 1024) -> DataFrame:
    """Every text of ``docs(doc_id, text, ...)`` as pieces with their places in sequences of at most ``limit`` tokens.

    Null and empty texts are one piece, the end id.  Repeated rows are packed as often as they occur.
    Other columns are left out; an empty table gives no rows.
    """
    ship_code(docs.sparkSession)
    pieces = stored(token_pieces(docs, tokenizer, end_id, limit), "pieces")
    # about 200,000 pieces of one length at most in a task; the plan's inputs stay bounded
    return place(pieces, limit, max(16, min(4096, pieces.count() // 200_000)))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens; see ``pack``."""
    return pack(documents(spark, sf_dir))
