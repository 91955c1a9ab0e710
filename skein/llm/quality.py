"""A quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are of the text alone. Trees are grown leaf by leaf on at most BINS quantile bins a feature, by logistic
loss, and flattened into arrays (feature, threshold, left child, value), which score whole batches by numpy.

Training takes at most ``sample`` labelled documents, those with the least hashes of their doc_id (a documented bound:
they are gathered on the driver); scoring takes every document.

Cases: null text is empty text; empty texts are scored from their statistics as any other; a null doc_id is never held out
and has no label; null labels are ignored; several labels of a document count as their mean, rounded up; equal rows are
scored alike; without labels, or with one class only, the score is the share of label 1 (0.5 without any); an empty table
yields no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import claim

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "signs", "wide", "spaces", "line_words", "ended_lines", "equal_lines",
    "distinct_words", "top_word", "distinct_pairs", "bytes_a_sign", "sign_runs", "capital_words", "long_words", "odd_signs", "byte_entropy", "bars",
)
BINS, TREES, LEAVES, RATE, LEAST, RIDGE = 64, 120, 12, 0.1, 8, 1.0
#: Texts of a batch that are taken out of Arrow at a time.
SLICE = 256
_CLASS = np.zeros(256, np.uint8)
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), (9, 10, 11, 12, 13, 32), range(128, 256), b".,;:!?'\"()-")):
    _CLASS[list(_bytes)] = _k + 1
_SIGNS = re.compile(rb"[!-/:-@\[-`{-~]{2,}")


def statistics(text: str | None) -> list[float]:
    """FEATURES of a text; zeros for an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [np.log1p(len(raw))] + [0.0] * (len(FEATURES) - 1)
    n, w = len(raw), len(words)
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    odd, lower, upper, digits, spaces, wide, marks = np.bincount(_CLASS, by_byte, 7).tolist()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    p = by_byte[by_byte > 0] / n
    runs = _SIGNS.findall(raw)
    return [
        np.log1p(n), np.log1p(w), (n - spaces) / w, upper / n, digits / n, (odd + marks) / n, wide / n, spaces / n, w / len(lines),
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines), 1 - len(set(lines)) / len(lines), len(counts) / w, max(counts.values()) / w,
        len(set(zip(words, words[1:]))) / max(1, w - 1), n / (1 + odd + marks), len(runs) / w, sum(x[:1].isupper() for x in words) / w,
        sum(len(x) > 20 for x in words) / w, odd / n, float(-(p * np.log2(p)).sum()), by_byte[124] / w,
    ]


@dataclass
class Trees:
    """Flattened trees: a node goes to left or left + 1; leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            inner = self.left[at] >= 0
            at = np.where(inner, self.left[at] + (x[rows, self.feature[at]] > self.threshold[at]), at)
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Grows TREES trees; deterministic."""
    share = float(y.mean()) if len(y) else 0.5
    base = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    feature, threshold, left, value, roots, deepest = [], [], [], [], [], 1
    if len(y) and 0 < share < 1:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        flat = binned + np.arange(x.shape[1]) * BINS
        raw = np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)

            def best(rows: np.ndarray) -> tuple:
                sums = [np.bincount(flat[rows].ravel(), np.repeat(v[rows], x.shape[1]), x.shape[1] * BINS).reshape(-1, BINS).cumsum(1) for v in (g, h, np.ones(len(y)))]
                (gl, hl, nl), (gt, ht, nt) = sums, (s[0, -1] for s in sums)
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(nl < LEAST) | (nt - nl < LEAST)] = -1
                k = int(gain.argmax())
                return float(gain.flat[k]), k // BINS, k % BINS

            roots.append(len(feature))

            def leaf(rows: np.ndarray) -> int:
                feature.append(0), threshold.append(0.0), left.append(-1), value.append(float(-RATE * g[rows].sum() / (h[rows].sum() + RIDGE)))
                return len(feature) - 1

            everything = np.arange(len(y))
            open_leaves = [(*best(everything), leaf(everything), everything, 0)]
            for _ in range(LEAVES - 1):
                open_leaves.sort(key=lambda o: (-o[0], o[3]))
                gain, j, b, node, rows, depth = open_leaves[0]
                if gain <= 1e-6:
                    break
                open_leaves.pop(0)
                goes = binned[rows, j] <= b
                feature[node], threshold[node], left[node] = j, float(edges[j][b]), len(feature)
                deepest = max(deepest, depth + 1)
                sides = [rows[goes], rows[~goes]]
                nodes = [leaf(r) for r in sides]
                open_leaves += [(*best(r), n, r, depth + 1) for r, n in zip(sides, nodes)]
            for _, _, _, node, rows, _ in open_leaves:
                raw[rows] += value[node]
    return Trees(np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(value), np.array(roots, np.int64), deepest, base)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _all_statistics(texts: pa.Array) -> list[list[float]]:
    """statistics() of each text; few texts at a time are Python objects."""
    return [statistics(t) for at in range(0, len(texts), SLICE) for t in texts.slice(at, SLICE).to_pylist()]


def _stats(rows: DataFrame, keep: list[str]) -> DataFrame:
    kept = [rows.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for b in batches:
            x = pa.array(_all_statistics(b.column("text")), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), x], names=[*keep, "x"])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    return rows.mapInArrow(run, StructType([*kept, StructField("x", ArrayType(DoubleType()))]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 20_000, usable: Callable[[Column], Column] = lambda c: ~held_out(c)) -> Trees:
    """Fits on at most ``sample`` labelled documents whose doc_id is ``usable``."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(usable(F.col("doc_id"))).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    few = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # `sample` rows at most
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(few, "doc_id")
    got = _stats(rows, ["doc_id", "y"]).orderBy(F.xxhash64("doc_id", "x"), "doc_id").limit(2 * sample).toPandas()
    return fit(np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES)), got["y"].to_numpy(float))


def score(docs: DataFrame, trees: Trees, keep: list[str], text: str = "text") -> DataFrame:
    """row (the columns ``keep`` of docs) and score: the row is one struct, so that no column's name clashes."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    place = keep.index(text) if keep.count(text) == 1 and docs.schema[text].dataType == StringType() else None
    rows = docs.select(F.struct(*keep).alias("row"), *([F.col(text).cast("string").alias("body")] if place is None else []))  # no text travels twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for b in batches:
            texts = b.column("body") if place is None else b.column("row").field(place)
            x = np.array(_all_statistics(texts)).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.concatenate([trees.scores(x[i : i + 1024]) for i in range(0, len(x), 1024)] or [np.empty(0)]))], names=["row", "score"])

    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("score", DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    out = score(docs, train(docs, labels), ["doc_id"])
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
