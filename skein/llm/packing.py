"""Packing token sequences by best-fit decreasing.

Overlong documents are first cut into full windows; what is left of each document is an item of 1 to window-1 tokens. Items
of one length are interchangeable, so the packing is planned on the histogram of lengths (at most ``window`` counts on
the driver, whatever the corpus) and carried out by each item's rank within its length. The plan is exactly that of
best-fit decreasing item by item.

Cases: null text packs as empty text (its document is the end id alone); a document of no ids at all yields no piece;
equal rows are separate documents; an empty table yields no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import claim, materialize
from .tokens import encoder

#: Documents of a batch that are encoded at a time.
SLICE = 1_024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, at long"


class Tightest:
    """A segment tree over remaining capacities 0..window: which of them have open windows."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.leaves
        self.any[i] = is_open
        while i := i >> 1:
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def at_least(self, size: int) -> int | None:
        """The least open capacity that holds size."""
        i = size + self.leaves
        while not self.any[i]:
            while i & 1:  # a right child: what is to the right lies above
                i >>= 1
                if i <= 1:
                    return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.leaves


def plan(counts: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing on a histogram of lengths.

    Returns segments (length, first rank, first window, items a window, offset) in ascending (length, first rank), and
    the number of windows. Items of a length from a segment's first rank on go to its windows in order, ``items a
    window`` to each, the first of them at ``offset``.
    """
    tree, open_runs, made, windows = Tightest(window), {}, [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            open_runs.setdefault(capacity, []).append((first, n))
            tree.set(capacity, True)

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            capacity = tree.at_least(size)
            if capacity is None:  # as many new windows as the rest of this size needs
                capacity, first, n = window, windows, -(-left // (window // size))
                windows += n
            else:
                first, n = open_runs[capacity].pop()
                if not open_runs[capacity]:
                    tree.set(capacity, False)
            each = capacity // size
            whole, rest = min(n, left // each), 0
            if whole < n:
                rest = left - whole * each
            if whole:
                made.append((size, rank, first, each, window - capacity))
                rank += whole * each
                put(capacity - each * size, first, whole)
            if rest:
                made.append((size, rank, first + whole, rest, window - capacity))
                rank += rest
                put(capacity - rest * size, first + whole, 1)
            put(capacity, first + whole + bool(rest), n - whole - bool(rest))
            left = counts[size] - rank
    return sorted(made), windows


def cut(docs: DataFrame, tokenizer: str, end_id: int, window: int, text: str = "text") -> DataFrame:
    """Of each document its full windows and the rest: PIECES. ``at`` is a piece's rank among those of its length in ``part``."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        claim(enc)
        seen = np.zeros(window + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            slices = (batch.slice(at, SLICE) for at in range(0, batch.num_rows, SLICE))
            for doc_id, ids in ((d, ids) for b in slices for d, ids in zip(b.column(0).to_pylist(), enc.batch(b.column(1).to_pylist()))):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, window):
                    length = min(window, n - start)
                    rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, part, int(seen[length])))
                    seen[length] += 1
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 5 else pa.int64()) for i, c in enumerate(cols)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "at"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(pieces, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = 1024) -> DataFrame:
    """Packs doc_id and text of docs into sequences of at most ``window`` tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, a row for each piece. Pieces are written
    to the shared folder once, so that ranks and ids agree whatever is lost or run again.
    """
    pieces = materialize(cut(docs, tokenizer, end_id, window), "pieces")
    counts = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    made, _ = plan(histogram, window)
    base = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    keys = np.array([s[0] for s in made], np.int64)
    ranks, firsts, each, offsets = (np.array([s[i] for s in made], np.int64) for i in (1, 2, 3, 4))
    span = int(ranks.max(initial=0)) + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(keys * span + ranks, length * span + np.minimum(rank, span - 1), "right") - 1
            past = rank - ranks[k]
            out = [b.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(firsts[k] + past // each[k]), pa.array(offsets[k] + past % each[k] * length)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    # base grows with the table's parts: no broadcast
    ranked = pieces.join(base.hint("merge"), ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("at")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
