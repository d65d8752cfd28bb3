"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

``P(grade <= k | x) = sigmoid(threshold_k - w.x)``: one weight per word is shared by all ordered thresholds.
The expected severity is the sum of ``P(grade > k)``.

Scale: the fit takes a bounded sample of labelled rows (``sample``, a parameter), chosen by a hash of the
row key.  Scoring is one pass over all whole texts without a shuffle; what each task holds is the model,
of at most ``features`` words and stems.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, ship_code, trim

EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’¡¿…–—"


def term(raw: str) -> str:
    return raw.strip(EDGES)


@lru_cache(maxsize=1 << 16)
def parts(raw: str) -> tuple[str, ...]:
    """The features of a word: itself without punctuation at its ends, and its leading 5, 6 and 7 letters, which inflected forms share."""
    t = term(raw)
    return (t, *(f"{t[:k]}~" for k in (5, 6, 7) if len(t) >= k)) if t else ()


def terms(text: str | None) -> set[str]:
    """The distinct features of the words of a text."""
    return {f for raw in set((text or "").lower().split()) for f in parts(raw)}


@dataclass
class Ordinal:
    """weights by word, and the ordered thresholds (one fewer than grades)."""

    weights: dict[str, float]
    thresholds: np.ndarray
    seen: dict = field(default_factory=dict, repr=False)

    def above(self, score: float) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -500, 500)))

    def score(self, text: str | None) -> float:
        seen, hits = self.seen, set()
        for raw in set((text or "").lower().split()):
            w = seen.get(raw)
            if w is None:
                if len(seen) > 100_000:
                    seen.clear()
                w = seen[raw] = tuple(f for f in parts(raw) if f in self.weights)
            if w:
                hits.update(w)
        return float(sum(self.weights[w] for w in sorted(hits)))

    def __getstate__(self):
        return {"weights": self.weights, "thresholds": self.thresholds, "seen": {}}


def minimise(loss, p: np.ndarray, steps: int, memory: int = 12) -> np.ndarray:
    """Limited-memory BFGS with a backtracking line search."""
    f, g = loss(p)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, used = g.copy(), []
        for s, y, r in reversed(past):
            a = r * (s @ q)
            q -= a * y
            used.append(a)
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(past, reversed(used), strict=True):
            q += s * (a - r * (y @ q))
        slope, t = -(g @ q), 1.0 if past else min(1.0, 1 / (np.abs(g).sum() + 1e-12))
        if slope > -1e-14:
            break
        while True:
            new = p - t * q
            fn, gn = loss(new)
            if fn <= f + 1e-4 * t * slope or t < 1e-10:
                break
            t /= 2
        s, y = new - p, gn - g
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y, 1 / (s @ y))]
        if f - fn < 1e-10:
            return new if fn < f else p
        p, f, g = new, fn, gn
    return p


def counts(texts: list[str | None], high: list[int], features, least: int, least_high: int) -> tuple[Counter, Counter]:
    """In how many texts, and in how many of the high ones, each feature occurs, for features of at least ``least`` and ``least_high``.

    Two passes, so that memory doesn't grow with the vocabulary: hashed counts, which are never too small, say
    which features may be worth a name.
    """
    size = 1 << 20
    df, up = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for x, g in zip(texts, high, strict=True):
        ids = np.unique(np.fromiter((crc32(f.encode("utf-8", "surrogatepass")) % size for f in features(x)), dtype=np.int64))
        df[ids] += 1
        if g:
            up[ids] += 1
    worth = (df >= least) & (up >= least_high)
    names, names_up = Counter(), Counter()
    for x, g in zip(texts, high, strict=True):
        own = [f for f in features(x) if worth[crc32(f.encode("utf-8", "surrogatepass")) % size]]
        names.update(own)
        if g:
            names_up.update(own)
    return names, names_up


def words_of(text: str | None) -> set[str]:
    return {t for raw in set((text or "").lower().split()) if (t := term(raw))}


def severity(texts: list[str | None], toxic: list[int]) -> list[int]:
    """Grades for rows with a 0/1 label: 0 not toxic; toxic rows 1, or 2 above the median of how many telling words they hold.

    A telling word occurs in three rows or more, at least nine in ten of them toxic.
    """
    df, high = counts(texts, toxic, words_of, 3, 3)
    telling = {t for t, c in high.items() if c >= 3 and c >= 0.9 * df[t]}
    held = [len(words_of(x) & telling) if g else 0 for x, g in zip(texts, toxic, strict=True)]
    some = sorted(c for c in held if c)
    middle = some[len(some) // 2] if some else 0
    return [(2 if some and c > middle else 1) if g else 0 for c, g in zip(held, toxic, strict=True)]


def fit(texts: list[str | None], grades: list[int], features: int = 4096, steps: int = 300, ridge: float = 1e-4, least: float = 25.0) -> Ordinal:
    """Maximum likelihood with a ridge, by L-BFGS over the whole sample; the same rows in the same order give the same model.

    Features are kept by the strength of their association with higher grades (chi-square of ``least`` or
    more), at least three documents each.  No rows: no thresholds, severity 0.  One grade only: that grade.
    """
    y = np.asarray(grades, dtype=np.int64)
    if not len(y):
        return Ordinal({}, np.zeros(0))
    top = int(y.max())
    n, pos = len(y), int((y > 0).sum())
    base = pos / n

    def strength(d, h):
        return (h - d * base) ** 2 / np.maximum(d * base * (1 - base), 1e-9)

    df, high = counts(texts, (y > 0).tolist(), terms, 3, 0)
    power = {t: strength(c, high[t]) for t, c in df.items() if c >= 3}
    kept = sorted((t for t, x in power.items() if x >= least), key=lambda t: (-power[t], t))[:features]
    at = {t: i for i, t in enumerate(kept)}
    rows, cols = array("i"), array("i")
    for i, x in enumerate(texts):
        for j in sorted(at[t] for t in terms(x) if t in at):
            rows.append(i)
            cols.append(j)
    rows, cols = np.asarray(rows, dtype=np.int32), np.asarray(cols, dtype=np.int32)
    cum = [(np.sum(y <= k) + 0.5) / (n + 1) for k in range(top)]
    theta = np.log(np.asarray(cum) / (1 - np.asarray(cum))) if top else np.zeros(0)
    gaps = np.log(np.maximum(np.diff(theta), 1e-2)) if top > 1 else np.zeros(0)
    nw = len(kept)

    def ordered(p: np.ndarray) -> np.ndarray:
        return np.concatenate([p[nw : nw + 1], p[nw : nw + 1] + np.cumsum(np.exp(p[nw + 1 :]))]) if top else np.zeros(0)

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, theta = p[:nw], ordered(p)
        s = np.bincount(rows, weights=w[cols], minlength=n) if nw else np.zeros(n)
        padded = np.concatenate([[-np.inf], theta, [np.inf]])
        with np.errstate(over="ignore"):
            a = 1 / (1 + np.exp(s - padded[y + 1]))
            b = 1 / (1 + np.exp(s - padded[y]))
        width = np.maximum(a - b, 1e-12)
        up, down = a * (1 - a) / width, b * (1 - b) / width
        gw = np.bincount(cols, weights=(1 - a - b)[rows], minlength=nw) / n + ridge * w if nw else np.zeros(0)
        gt = np.array([(np.sum(down[y == k + 1]) - np.sum(up[y == k])) / n for k in range(top)])
        tail = np.cumsum(gt[::-1])[::-1]
        return float(-np.log(width).mean() + ridge / 2 * w @ w), np.concatenate([gw, tail[:1], np.exp(p[nw + 1 :]) * tail[1:]])

    p = np.concatenate([np.zeros(nw), theta[:1], gaps])
    if top:
        p = minimise(loss, p, steps)
    theta = ordered(p)
    return Ordinal({t: float(p[i]) for t, i in at.items()}, theta)


def train(docs: DataFrame, labels: DataFrame, sample: int = 6_000, binary: bool = False) -> Ordinal:
    """Fits on at most about ``sample`` rows of ``labels(doc_id, grade)``, half of them of higher grades where there are as many.

    With ``binary``, grades are 0 and 1 and the ones are split by ``severity``.
    Rows are taken by a hash of doc_id.  Labels without a grade or a document play no part; of several grades of
    a doc_id the highest counts, of several texts the smallest.
    """
    known = labels.where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    h = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_000))
    counts = dict(known.groupBy((F.col("grade") > 0).alias("high")).count().collect())
    half = sample // 2
    share = {k: min(1.0, max(half, sample - counts.get(not k, 0)) / max(1, counts.get(k, 0))) for k in (True, False)}
    cut = F.when(F.col("grade") > 0, int(share[True] * 1_000_000)).otherwise(int(share[False] * 1_000_000))
    chosen = known.where(h < cut)  # about ``sample`` rows: small enough to broadcast
    # a doc_id that occurs with several texts counts once
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("grade").alias("grade")).select(F.lit(0).alias("one"), "*")

    def fitted(table: pa.Table) -> pa.Table:
        own = sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), table["grade"].to_pylist(), strict=True), key=lambda r: (r[0], r[1] or ""))
        texts, grades = [r[1] for r in own], [r[2] for r in own]
        m = fit(texts, severity(texts, grades) if binary else grades)
        names = [*m.weights, *(None for _ in m.thresholds)]
        parts.cache_clear()
        trim()
        return pa.table({"at": pa.array(range(len(names)), pa.int32()), "name": pa.array(names, pa.string()), "value": pa.array([*m.weights.values(), *m.thresholds.tolist()], pa.float64())})

    # the sample is bounded, so one task fits it; the driver sees the model alone
    ship_code(docs.sparkSession)
    found = sorted(rows.groupBy("one").applyInArrow(fitted, "at int, name string, value double").collect(), key=lambda r: r["at"])
    model = Ordinal({r["name"]: r["value"] for r in found if r["name"] is not None}, np.array([r["value"] for r in found if r["name"] is None]))
    # the sample holds more of the higher grades than the corpus: shift the thresholds back
    if len(model.thresholds) and share[False] > 0:
        model.thresholds = model.thresholds + np.log(share[True] / share[False])
    return model


def grade(docs: DataFrame, model: Ordinal, threshold: float = 0.5, names: tuple[str, str, str] = ("severity", "grade", "rejected")) -> DataFrame:
    """The rows of ``docs`` with severity double, grade int and rejected boolean added under ``names`` (columns of these names are replaced).

    severity: the expected grade.  grade: the likeliest, of equally likely ones the lowest.  rejected: P(grade > 0)
    reaches ``threshold``.  Null and empty texts have no features.  Equal texts get equal grades; repeated rows
    are repeated.
    """
    ship_code(docs.sparkSession)

    def judge(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in frames:
            out = []
            for t in text.tolist():
                above = model.above(model.score(t))
                parts = -np.diff(np.concatenate([[1.0], above, [0.0]]))
                out.append((float(above.sum()), int(parts.argmax()), bool(len(above) and above[0] >= threshold)))
            yield pd.DataFrame(out, columns=["severity", "grade", "rejected"]).astype({"severity": "float64", "grade": "int32", "rejected": "bool"})
        trim()

    judge.__annotations__ = {"frames": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(judge, "severity double, grade int, rejected boolean")
    held = fresh(docs, "_judged")
    return docs.withColumn(held, udf("text")).withColumns({n: F.col(f"{held}.{c}") for n, c in zip(names, ("severity", "grade", "rejected"), strict=True)}).drop(held)


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("grade"))


def op10_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's doc_id, severity, grade and rejected, by a model of the table ``labels``."""
    docs = documents(spark, sf_dir)
    model = train(docs, toxic_labels(spark, sf_dir), binary=True)
    return grade(docs.select("doc_id", "text"), model).drop("text")
