"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

The overlap of two documents is an entry of M * transposed(M).  Only entries that size bounds leave possible
are computed:

* Equal rows of M are one row, a *node*; copies cost nothing further.
* Columns are ordered from rare to frequent (counts of hashed columns over all documents).  Two rows that
  overlap enough share a column among the first few of each in that order; only those columns enter the
  first product, and the bounds on sizes and places drop entries while they are accumulated.
* A short column (``SHORT`` entries) is multiplied as a whole.  The sizes of the parts of two sets bound their
  overlap from above; pairs below it go, and the others get the full product of their rows, exactly.
* Rows that long columns connect are a *family*.  A family is dealt in blocks by size class; each pair of blocks
  whose sizes can link is one dense product of its rows, which decides all its pairs and tells only links
  that join something: fewer than it has rows, never pairs.

Components need no pair inside what is already joined.  So the likeliest partner of each row is decided first,
twice, and then only rows of different components; a family's largest component isn't multiplied with itself.

Scale: a pair of blocks is a task's work, so a column that a third of all rows share is never in one task.
Whole sets cross the network only for rows that may link, once per pair of blocks and not once per column.
Nothing but the column counts (at most 2**24 bytes) is broadcast unchecked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block_pairs, components, documents, forget, labels, lean, mix64, shingle_set, ship_code, sorted_groups, stored

SHORT = 32
COMMON = 1024
#: rows, and members of rows, that a block of a family holds
BLOCK = 2048
BLOCK_MEMBERS = 1 << 20


def _signature(s: np.ndarray) -> int:
    """A 64-bit name of a set of hashes."""
    if not len(s):
        return 0
    h = np.bitwise_xor.reduce(mix64(s + np.uint64(0x51ED))) ^ mix64(np.array([s.sum(dtype=np.uint64) + np.uint64(len(s))], dtype=np.uint64))[0]
    return int(mix64(np.array([h], dtype=np.uint64)).view(np.int64)[0])


def part_sizes(s: np.ndarray) -> bytes:
    """How many members of a set fall in each of about a quarter as many equal parts of the hash space; a byte each."""
    log = max(3, int(len(s) // 4).bit_length())
    return np.minimum(np.bincount((s >> np.uint64(64 - log)).astype(np.int64), minlength=1 << log), 255).astype(np.uint8).tobytes()


def overlap_bound(x: bytes, y: bytes) -> int:
    """No two sets with these part sizes share more members: the sum of the smaller sizes."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    a, b = np.where(a == 255, 1 << 40, a), np.where(b == 255, 1 << 40, b)
    m = min(len(a), len(b))
    return int(np.minimum(a.reshape(m, -1).sum(axis=1), b.reshape(m, -1).sum(axis=1)).sum())


def column_counts(docs: DataFrame, size: int, log_buckets: int) -> np.ndarray:
    """An order-of-size class (twice the binary logarithm of the count) per bucket of hashed columns, over all documents."""
    blocks = 64

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << log_buckets, dtype=np.int64)
        for batch in frames:
            held: list[np.ndarray] = []
            for text in batch.column(0):
                held.append(shingle_set(text.as_py(), size))
                if sum(map(len, held[-64:])) > 1 << 20 or len(held) >= 512:
                    total += _bucketed(held, log_buckets)
                    held = []
            total += _bucketed(held, log_buckets)
        for k, part in enumerate(np.split(total, blocks)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.astype("<u4").tobytes()], pa.binary())], ["block", "counts"])

    def add(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for batch in frames:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = np.frombuffer(c, dtype="<u4").astype(np.int64)
                got[k] = got[k] + c if k in got else c
        for k, c in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.ceil(2 * np.log2(c + 1)).astype(np.uint8).tobytes()], pa.binary())], ["block", "counts"])

    parts = docs.select("text").mapInArrow(lean(count), "block int, counts binary").repartition(blocks, "block").mapInArrow(lean(add), "block int, counts binary").collect()
    out = np.zeros(1 << log_buckets, dtype=np.uint8)
    width = len(out) // blocks
    for k, c in parts:
        out[k * width : (k + 1) * width] = np.frombuffer(bytes(c), dtype=np.uint8)
    return out


def _bucketed(held: list[np.ndarray], log_buckets: int) -> np.ndarray:
    if not held:
        return np.zeros(1 << log_buckets, dtype=np.int64)
    return np.bincount((np.concatenate(held) >> np.uint64(64 - log_buckets)).astype(np.int64), minlength=1 << log_buckets)


def rows_of(docs: DataFrame, size: int, num: int, den: int, classes, common: int) -> DataFrame:
    """doc_id, n, node, part sizes, and the leading columns of each row of the matrix, rare first.

    ``few`` of them lead in the smaller role; from place ``cold`` on they are in a class beyond ``common``.
    """

    def lead(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = classes.value
        shift = np.uint64(64 - (len(freq).bit_length() - 1))
        for batch in frames:
            ns, nodes, fews, colds, grams, parts = [], [], [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), size)
                n = len(s)
                ns.append(n)
                nodes.append(_signature(s))
                how = freq[(s >> shift).astype(np.int64)]
                order = np.argsort(how, kind="stable")[: n - -(-num * n // den) + 1]
                fews.append(n - -(-2 * num * n // (num + den)) + 1 if n else 0)
                colds.append(int((how[order] <= common).sum()))
                grams.append(s[order].view(np.int64))
                parts.append(part_sizes(s))
            offsets = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
            flat = np.concatenate(grams) if grams else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int32()), pa.array(nodes, pa.int64()), pa.array(fews, pa.int32()), pa.array(colds, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(parts, pa.binary())], ["doc_id", "n", "node", "few", "cold", "grams", "parts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(lead), "doc_id long, n int, node long, few int, cold int, grams array<long>, parts binary")


def possible(n: np.ndarray, pos: np.ndarray, small: np.ndarray, node: np.ndarray, m: np.ndarray, pos2: np.ndarray, small2: np.ndarray, node2: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the bounds leave a link between entries of one column: sizes near enough, the smaller row's entry among its few, places that let the overlap be reached."""
    low, high = np.minimum(n, m), np.maximum(n, m)
    need = -(-num * (low + high) // (num + den))
    first = (n < m) | ((n == m) & (node < node2))
    reach = np.minimum(pos, pos2) + 1 + np.minimum(n - pos, m - pos2) - 1
    return (den * low >= num * high) & (reach >= need) & np.where(first, small, small2) & (node != node2)


def first_products(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Goes through the columns, whose entries lie together, in parts where they are common.

    kind 0: pairs to decide early (neighbours by size); 1: further pairs of short columns; 2: an entry of a long
    column that isn't common, in ``a`` and ``b``.
    """

    def multiply(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for t in sorted_groups(frames, ["gram", "salt"], 2):
            node, meta = t["node"].to_numpy(), t["meta"].to_numpy()
            n, pos, small = meta >> 32, (meta >> 1) & 0x7FFFFFFF, (meta & 1) == 1
            order = np.lexsort((node, n))
            node, n, pos, small = node[order], n[order], pos[order], small[order]
            gram = t["gram"][0].as_py()
            # a part of a common column is never the whole of it
            salted = t["salt"][0].as_py() >= 0
            whole = len(node) <= SHORT and not salted
            if whole:
                i, j = np.triu_indices(len(node), 1)
            else:
                k = np.arange(len(node))
                i, j = np.concatenate([k[:-1], k[:-2]]), np.concatenate([k[1:], k[2:]])
            ok = possible(n[i], pos[i], small[i], node[i], n[j], pos[j], small[j], node[j], num, den)
            i, j = i[ok], j[ok]
            out.append((np.where(j - i <= 2, 0, 1).astype(np.int8), np.full(len(i), gram), node[i], node[j]))
            held += len(i)
            if not whole and not salted:
                out.append((np.full(len(node), 2, np.int8), np.full(len(node), gram), node, node))
                held += len(node)
            if held > 100_000 or len(out) > 10_000:
                yield _products(out)
                out, held = [], 0
        yield _products(out)

    return entries.mapInArrow(lean(multiply), "kind byte, gram long, a long, b long")


def _products(out: list[tuple]) -> pa.RecordBatch:
    types = (pa.int8(), pa.int64(), pa.int64(), pa.int64())
    cols = [np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(4)]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(cols, types, strict=True)], ["kind", "gram", "a", "b"])


def bounded(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of ``pairs(a, b, shared)`` that part sizes leave possible."""

    def keep(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            low, n, m, x, y = (batch.column(k).to_pylist() for k in (2, 3, 4, 5, 6))
            ok = [k for k in range(len(low)) if (num + den) * overlap_bound(x[k], y[k]) >= num * (n[k] + m[k])]
            take = pa.array(ok, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(k).take(take) for k in range(3)], ["a", "b", "shared"])

    left = pairs.join(nodes.select(F.col("node").alias("a"), F.col("n"), F.col("parts").alias("x")), "a")
    both = left.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("parts").alias("y")), "b")
    return both.select("a", "b", "shared", "n", "m", "x", "y").mapInArrow(lean(keep), "a long, b long, shared long")


def families(long: DataFrame, spark: SparkSession) -> DataFrame:
    """(node, root, family) of the rows of ``long(gram, node, root)`` that may link across roots: rows that columns connect are a family."""
    mixed = long.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gram")
    open_ = stored(long.join(mixed, "gram").select("gram", "node", "root"), "open")
    first = stored(open_.groupBy("node").agg(F.min("gram").alias("gram"), F.first("root").alias("root")), "first")
    same = open_.select("node", "gram").join(first.select("node", F.col("gram").alias("with")), "node").select(F.col("gram").alias("a"), F.col("with").alias("b")).distinct()
    named = components(same, spark).select(F.col("id").alias("gram"), F.col("root").alias("family"))
    return first.join(named, "gram", "left").select("node", "root", F.coalesce("family", "gram").alias("family"))


def family_links(rows: DataFrame, num: int, den: int, block: int = BLOCK, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """(a, b) linked, of different roots, that join what all links among ``rows(family, node, root, n, members)`` join."""
    most = rows.groupBy("family", "root").agg(F.count("*").alias("k")).groupBy("family").agg(F.max_by("root", F.struct("k", "root")).alias("big"))
    most = stored(most, "largest")
    few = most.count() <= 500_000
    # sizes of linked rows are in the same class or the next; rows of the largest root needn't meet
    width = max(0.01, float(np.log(den / num)) * 1.001)
    told = rows.join(F.broadcast(most) if few else most, "family").withColumns({"band": F.floor(F.log("n") / width), "alike": F.col("root") == F.col("big")}).drop("big")

    def multiply(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(frames, ["family", "i", "j"], 2):
            yield _spanning(t, num, den)

    return block_pairs(told, "family", "node", "n", block, block_members).mapInArrow(lean(multiply), "a long, b long")


def _spanning(t: pa.Table, num: int, den: int, at_once: int = 256) -> pa.RecordBatch:
    """Links between the rows of two blocks that join different roots, fewer than there are rows."""
    own, node, root = (t[c].to_numpy() for c in ("own", "node", "root"))
    sets = [np.frombuffer(x, dtype=np.uint64) for x in t["members"].to_pylist()]
    n = np.array([len(x) for x in sets], dtype=np.int64)
    column = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    x, y = np.flatnonzero(own == t["i"][0].as_py()), np.flatnonzero(own == t["j"][0].as_py())
    lab = np.unique(root, return_inverse=True)[1]
    a, b = [], []
    for k in range(0, len(x), at_once):
        p = x[k : k + at_once]
        over = overlaps(p, y, column, starts, row)
        linked = (den * over >= num * (n[p][:, None] + n[y][None, :] - over)) & (lab[p][:, None] != lab[y][None, :])
        for i in np.flatnonzero(linked.any(axis=1)).tolist():
            mates = y[linked[i]]
            other, first = np.unique(lab[mates], return_index=True)
            apart = other != lab[p[i]]
            if apart.any():
                a += [node[p[i]]] * int(apart.sum())
                b += node[mates[first[apart]]].tolist()
                lab[np.isin(lab, other)] = lab[p[i]]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def overlaps(p: np.ndarray, y: np.ndarray, column: np.ndarray, starts: np.ndarray, row: np.ndarray, room: int = 1 << 23) -> np.ndarray:
    """How many columns each row of ``p`` shares with each row of ``y``; the product is taken over ranges of columns that ``room`` numbers hold."""

    def entries(rows: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows.tolist()])

    ex, ey = entries(p), entries(y)
    shared = np.intersect1d(column[ex], column[ey])
    out = np.zeros((len(p), len(y)), dtype=np.int64)
    place = np.full(len(starts) - 1, -1)
    step = max(64, room // (len(p) + len(y)))
    for at in range(0, len(shared), step):
        some = shared[at : at + step]
        sides = []
        for rows, e in ((p, ex), (y, ey)):
            place[rows] = np.arange(len(rows))
            c = np.minimum(np.searchsorted(some, column[e]), len(some) - 1)
            ok = some[c] == column[e]
            m = np.zeros((len(rows), len(some)), dtype=np.float32)
            m[place[row[e[ok]]], c[ok]] = 1
            sides.append(m)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def members(active: DataFrame, docs: DataFrame, reps: DataFrame, size: int, broadcast_rows: int = 500_000) -> DataFrame:
    """node, members: the sorted shingles of the nodes of ``active(node)``.  ``reps(node, doc_id)`` names a document of each node."""
    wanted = stored(reps.join(active.distinct(), "node").select("doc_id", "node"), "active")
    few = wanted.count() <= broadcast_rows

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            nodes, sets, held = [], [], 0
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_set(text.as_py(), size)
                # a doc_id may occur with several texts: only the node's own counts
                if _signature(s) == node:
                    nodes.append(node)
                    sets.append(s.tobytes())
                    held += len(s)
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "members"])
                    nodes, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "members"])

    texts = docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, "doc_id").select("node", "text")
    return stored(texts.mapInArrow(lean(read), "node long, members binary").dropDuplicates(["node"]), "sets")


def decide(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of the pairs whose full product reaches the threshold."""

    def product(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                low, high = (a, b) if len(a) <= len(b) else (b, a)
                at = np.minimum(np.searchsorted(high, low), len(high) - 1)
                shared = int((high[at] == low).sum())
                linked.append(den * shared >= num * (len(a) + len(b) - shared))
            take = pa.array(np.flatnonzero(linked))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], ["a", "b"])

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(lean(product), "a long, b long")


def _rooted(df: DataFrame, roots: DataFrame | None, key: str, name: str) -> DataFrame:
    """Adds the root of a node: itself, where nothing has joined it yet."""
    if roots is None:
        return df.withColumn(name, F.col(key))
    found = roots.select(F.col("id").alias(key), F.col("root").alias(name))
    return df.join(found, key, "left").withColumn(name, F.coalesce(name, key))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    return _rooted(_rooted(pairs, roots, "a", "ra"), roots, "b", "rb").where("ra <> rb").select(*pairs.columns)


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, block: int = BLOCK, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs(doc_id, text)``: documents link when ``den * intersection >= num * union``.

    Null, empty and blank texts have no shingles and link with nothing.  Rows without a doc_id get their count
    and a null component.  Repeated rows are repeated in the result.  ``block`` and ``block_members`` bound a
    task's work, never the result.
    """
    spark = docs.sparkSession
    ship_code(spark)
    docs = docs.select("doc_id", "text")
    rows_n = docs.count()
    log_buckets = min(24, max(14, int(rows_n * 4).bit_length()))
    freq = column_counts(docs, size, log_buckets)
    common = int(np.ceil(2 * np.log2(COMMON + 1)))
    held = spark.sparkContext.broadcast(freq)
    matrix = stored(rows_of(docs, size, num, den, held, common), "matrix")
    reps = stored(matrix.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes")
    # a row of each node: copies are dropped where they are, by the doc_ids that stand for nodes
    few = reps.count() <= 500_000
    alone = matrix.join((F.broadcast(reps) if few else reps), ["doc_id", "node"], "left_semi")
    nodes = stored(alone.groupBy("node").agg(F.first("n").alias("n"), F.first("parts").alias("parts")), "nodes")
    entries = alone.select("node", "n", "few", "cold", F.posexplode("grams").alias("pos", "gram"))
    meta = F.col("n").cast("long") * (1 << 32) + F.col("pos").cast("long") * 2 + (F.col("pos") < F.col("few")).cast("long")
    # columns beyond COMMON go in parts by a hash of row and column; rarer ones stay whole
    salt = F.when(F.col("pos") >= F.col("cold"), F.pmod(F.xxhash64("node", "gram"), F.lit(max(1, rows_n // 4096)))).otherwise(-1).cast("int")
    dealt = entries.select("gram", "node", meta.alias("meta"), salt.alias("salt")).repartition("gram", "salt").sortWithinPartitions("gram", "salt", "node")
    hot = alone.where("cold < size(grams)").select(F.explode(F.slice("grams", F.col("cold") + 1, F.size("grams") - F.col("cold"))).alias("gram"), "node")
    products = stored(first_products(dealt, num, den), "products")
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    first = products.where("kind < 2").select(*ordered).groupBy("a", "b").agg(F.count("*").alias("shared"))
    pairs = stored(bounded(first, nodes, num, den), "pairs")
    links: list[DataFrame] = []
    seen: list[DataFrame] = []
    roots = None
    for step in range(3):
        # the partner with the largest overlap so far, of either side; what these join needs no further look
        left = pairs if roots is None else _apart(pairs, roots)
        if step < 2:
            best = [left.groupBy(x).agg(F.max_by(y, F.struct("shared", y)).alias(y)).select("a", "b") for x, y in (("a", "b"), ("b", "a"))]
            todo = best[0].unionByName(best[1]).distinct()
        else:
            todo = left.select("a", "b")
        for done in seen:
            todo = todo.join(done, ["a", "b"], "left_anti")
        todo = stored(todo, "todo")
        new = []
        if not todo.isEmpty():
            active = todo.select(F.explode(F.array("a", "b")).alias("node"))
            new.append(stored(decide(todo, members(active, docs, reps, size), num, den), "linked"))
            seen.append(todo)
        if step == 2:
            long = products.where("kind = 2").select("gram", F.col("a").alias("node")).unionByName(hot).distinct()
            rows = stored(families(_rooted(long, roots, "node", "root"), spark), "families")
            if not rows.isEmpty():
                sets = members(rows.select("node"), docs, reps, size)
                rows = rows.join(sets, "node").withColumn("n", F.octet_length("members") / 8)
                new.append(stored(family_links(rows, num, den, block, block_members), "linked"))
        if new:
            links += new
            all_links = links[0]
            for more in links[1:]:
                all_links = all_links.unionByName(more)
            roots = stored(components(all_links, spark), "roots")
    joined = roots if roots is not None else spark.range(0).select("id", F.col("id").alias("root"))
    named = reps.join(joined.select(F.col("id").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    forget(products)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_node = stored(named.join(least, "root").select("node", "component_id"), "named")
    out = matrix.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "node").join(by_node, "node", "left")
    alone_id = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), alone_id).alias("component_id"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document, four words a shingle, 85 in 100; see ``jaccard_components``."""
    return jaccard_components(documents(spark, sf_dir), 4, 85, 100)
