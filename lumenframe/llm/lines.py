"""Line deduplication: which lines of a document go, as a compressed bitmap beside the text.

Every line that is long enough becomes a row of a 128-bit hash, its document and its place; the text stays
where it is.  Rows are range-partitioned and sorted by hash, then by falling doc_id, then by place.  A task streams
through its range: the first document of a hash keeps the line, those after it lose it once enough documents
hold it.

Scale: the ranges split a hash that a third of all rows share, as document and place are part of the
order.  Only the first and the last hash of a task can go on in another one; what a task can't tell about
these two leaves it as open rows, and up to ``copies`` documents of each as notes.  The notes of a hash, a
few per task, tell what becomes of its open rows.  A task holds the lines of ``copies`` documents at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, lean, ship_code, stored

SPACES = b"\t\n\x0b\x0c\r "
ORDER = ("h1", "h2", "doc_id", "version", "pos")
ROW = "h1 long, h2 long, doc_id long, version long, pos int"
DROP, OPEN, NOTE = 0, 1, 2


def version(text: Column) -> Column:
    """Tells texts of one doc_id apart, so that places fit the text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_rows(docs: DataFrame, least: int = 20) -> DataFrame:
    """h1, h2, doc_id, version, pos: the hash of each line of at least ``least`` code points, and where it stands.

    A line counts without ASCII white space around it and with A-Z lower-cased.
    """

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in frames:
            hashes, at, places = [], [], []
            for k, text in enumerate(batch.column(2)):
                for pos, line in enumerate((text.as_py() or "").encode("utf-8", "surrogatepass").lower().split(b"\n")):
                    line = line.strip(SPACES)
                    if len(line) >= least and (len(line) >= 4 * least or len(line.decode("utf-8", "surrogatepass")) >= least):
                        hashes.append(digest(line))
                        at.append(k)
                        places.append(pos)
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(places, pa.int32())], list(ORDER))

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), version(F.col("text")).alias("version"), "text").mapInArrow(lean(read), ROW)


class _Stream:
    """Goes through rows in order and tells which lines go; see the module."""

    def __init__(self, copies: int):
        self.copies = copies
        self.last: tuple | None = None  # the row before
        self.first_hash: tuple | None = None
        self.rank = 0  # of the current document among those of the current hash
        self.held: list[np.ndarray] = []  # rows that go if further documents follow
        self.top: np.ndarray | None = None  # first documents of the current hash

    def rows(self, m: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(kind, rows) of the next rows, columns as ``ORDER``; rows that repeat the one before count once."""
        before = np.concatenate([[self.last or tuple(~m[0])], m[:-1]])
        new = (m != before).any(axis=1)
        new_hash = (m[:, :2] != before[:, :2]).any(axis=1)
        new_doc = new_hash | (m[:, 2] != before[:, 2])
        m, new_hash, new_doc = m[new], new_hash[new], new_doc[new]
        if not len(m):
            return
        self.last = tuple(m[-1].tolist())
        if self.first_hash is None:
            self.first_hash = tuple(m[0, :2].tolist())
        group = np.cumsum(new_hash)
        docs = np.cumsum(new_doc)
        base = np.concatenate([[-self.rank], docs[new_hash] - 1])
        rank = docs - base[group]
        most = np.zeros(group[-1] + 1, np.int64)
        np.maximum.at(most, group, rank)
        most[0] = max(most[0], self.rank)
        first = (m[:, 0] == self.first_hash[0]) & (m[:, 1] == self.first_hash[1])
        leads = new_doc & (rank <= self.copies)
        yield OPEN, m[first]
        yield NOTE, m[first & leads]
        # what waited from the batches before
        if self.held and most[0] >= self.copies:
            yield DROP, np.concatenate(self.held)
        if most[0] >= self.copies or group[-1]:
            self.held = []
        later = ~first & (rank >= 2)
        sure = later & ((rank >= self.copies) | (most[group] >= self.copies))
        yield DROP, m[sure]
        now = group == group[-1]
        self.held.extend([m[later & ~sure & now]] if most[-1] < self.copies else [])
        top = m[~first & leads & now]
        self.top = top if group[-1] or self.top is None else np.concatenate([self.top, top])
        self.rank = int(rank[-1])

    def end(self) -> Iterator[tuple[int, np.ndarray]]:
        if self.held:
            yield OPEN, np.concatenate(self.held)
        if self.top is not None:
            yield NOTE, self.top


def dropped_lines(docs: DataFrame, least: int = 20, copies: int = 3) -> DataFrame:
    """doc_id, version, pos of the lines that go: those that ``copies`` documents or more hold, but for the largest doc_id's."""
    ship_code(docs.sparkSession)
    order = [F.col("h1"), F.col("h2"), F.desc("doc_id"), F.col("version"), F.col("pos")]

    def stream(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _Stream(copies)

        def told(found: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for kind, m in found:
                if len(m):
                    columns = [pa.array(np.full(len(m), kind, np.int32)), *(pa.array(np.ascontiguousarray(m[:, k])) for k in range(4)), pa.array(m[:, 4].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["kind", *ORDER])

        for batch in frames:
            if batch.num_rows:
                yield from told(s.rows(np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)], axis=1)))
        yield from told(s.end())

    lines = stored(line_rows(docs, least), "lines")
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(dealt.mapInArrow(lean(stream), f"kind int, {ROW}"), "found")
    # at most two hashes a task, with a few documents each
    notes = stored(found.where(F.col("kind") == NOTE).groupBy("h1", "h2").agg(F.max("doc_id").alias("keeper"), F.count_distinct("doc_id").alias("n")), "borders")
    rest = found.where(F.col("kind") == OPEN).join(F.broadcast(notes), ["h1", "h2"]).where((F.col("n") >= copies) & (F.col("doc_id") < F.col("keeper")))
    where = ["doc_id", "version", "pos"]
    return found.where(F.col("kind") == DROP).select(*where).unionByName(rest.select(*where))


def keep_bits(places: np.ndarray) -> bytes:
    """A bit per line up to the last one that goes, lowest first, set for those that stay; filled up with set bits, and compressed."""
    keep = np.ones((int(places.max()) // 8 + 1) * 8, np.uint8)
    keep[places] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1)


def kept_lines(lines: list[str], bits: bytes) -> list[str]:
    """The lines to keep; those beyond the bitmap stay."""
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), bitorder="little")
    return [x for x, k in zip(lines, keep.tolist(), strict=False) if k] + lines[len(keep) :]


def line_bitmaps(docs: DataFrame, least: int = 20, copies: int = 3) -> DataFrame:
    """doc_id, version, n_dropped, keep: the compressed bitmap of each text of ``docs(doc_id, text, ...)`` that loses lines.

    Keys (lines without ASCII white space around them, A-Z lower-cased) of at least ``least`` code points that
    ``copies`` or more different doc_ids hold go everywhere but in the largest of these; there all stay.  Rows
    without a doc_id neither count nor lose lines; null and empty texts are one empty line.  Rows that share a
    doc_id are one document, each text with a bitmap of its own (``version``); equal rows share one.  Other columns
    are left out; an empty table gives no rows.
    """

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def bitmaps(m: np.ndarray) -> pa.RecordBatch:
            cut = np.concatenate([[0], np.flatnonzero((m[1:, :2] != m[:-1, :2]).any(axis=1)) + 1, [len(m)]])
            groups = [np.unique(m[a:b, 2]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            starts = m[cut[:-1]]
            return pa.RecordBatch.from_arrays(
                [pa.array(starts[:, 0].copy()), pa.array(starts[:, 1].copy()), pa.array([len(g) for g in groups], pa.int64()), pa.array([keep_bits(g) for g in groups], pa.binary())], ["doc_id", "version", "n_dropped", "keep"]
            )

        for batch in frames:
            if not batch.num_rows:
                continue
            m = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)
            if held and (m[0, :2] != held[-1][-1, :2]).any():
                yield bitmaps(np.concatenate(held))
                held = []
            # the last document may go on
            cut = int(np.flatnonzero(np.concatenate([[True], (m[1:, :2] != m[:-1, :2]).any(axis=1)]))[-1])
            if cut:
                yield bitmaps(np.concatenate([*held, m[:cut]]))
                held = []
            held.append(m[cut:])
        if held:
            yield bitmaps(np.concatenate(held))

    gone = dropped_lines(docs, least, copies)
    return gone.repartition("doc_id", "version").sortWithinPartitions("doc_id", "version", "pos").mapInArrow(lean(pack), "doc_id long, version long, n_dropped long, keep binary")


def without_lines(docs: DataFrame, bitmaps: DataFrame, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with the lines that ``bitmaps`` tells cut from ``text``, and two more columns: lines before, and lines cut.

    Null texts stay null, with one line.  Only texts that lose lines go to Python.
    """
    ship_code(docs.sparkSession)

    @F.pandas_udf("string")
    def cut(text: pd.Series, keep: pd.Series) -> pd.Series:
        return pd.Series([None if k is None or t is None else "\n".join(kept_lines(t.split("\n"), k)) for t, k in zip(text, keep, strict=True)], dtype=object)

    v, keep, gone = (fresh(docs, c) for c in ("_version", "_keep", "_gone"))
    known = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("version").alias("_of"), F.col("n_dropped").alias(gone), F.col("keep").alias(keep))
    told = docs.withColumn(v, version(F.col("text"))).join(known, (F.col("doc_id").cast("long") == F.col("_doc")) & (F.col(v) == F.col("_of")), "left").drop("_doc", "_of")
    told = told.withColumn(names[0], F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)).cast("long") + 1).withColumn(names[1], F.coalesce(gone, F.lit(0)).cast("long"))
    text = F.when(F.col(keep).isNull(), F.col("text")).otherwise(cut(F.when(F.col(keep).isNotNull(), F.col("text")), F.col(keep)))
    return told.withColumn("text", text).select(*docs.columns, *names)


def op11_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 20 code points or more that three documents hold are left in the last of these; see ``line_bitmaps``."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = without_lines(docs, line_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
