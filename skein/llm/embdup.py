"""Near duplicates of embeddings by an inverted multi-index.

Vectors are scaled to length 1 and cut into two halves, each with a codebook of its own; the product of the codebooks is a
grid of cells, OCCUPANCY vectors a cell on average. A vector visits cells by the multi-sequence order: ascending sums of two
keys, one for each half. The key of a half's centroid is ((its distance - the nearest centroid's distance) / 2) squared, a
lower bound of the squared distance that a point of its cells has in that half, so that no visit beyond 2 - 2 cosine can find
a link. A visit ends at a sum, the cut-off, that finds RECALL of the links at the threshold itself: it is the larger one of two
quantiles, over neighbours made at exactly that cosine in random directions (PROBES), and over the links that some of these probes
(COUNTED) have by brute force in the whole table (each probe with links weighs the same). Links closer than the threshold,
and those whose other end visits, too, are found more often still.

Cells are join keys: a vector is sent to the groups of cells that it visits (a group is one centroid of the first half and
a range of the second's), and is verified there, in double precision, with the residents of visited cells only. Equal
vectors are one class from the start. Groups are dealt out in blocks of at most BLOCK residents by BLOCK visitors, about, so
that no cell is gathered; of each block only counts, and a spanning forest of its links, are given on.

Codebooks are fitted on 32 vectors a centroid, SAMPLE at least and SAMPLE_MOST at most.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
lengths don't link; equal rows are linked; a null vec_id takes part, but names no component unless all are null; an empty
table yields no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, discard, materialize

SAMPLE, SAMPLE_MOST, PROBES, COUNTED, BLOCK, RECALL, BINS, OCCUPANCY = 8192, 1 << 18, 1024, 256, 4096, 0.97, 4096, 128


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 1))


def unit(vectors: list | np.ndarray) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly spread rows; deterministic."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([distances(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]))


def neighbours(x: np.ndarray, cosine: float) -> np.ndarray:
    """Of each unit vector one at the given cosine, in a random direction."""
    away = np.random.default_rng(17).standard_normal(x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    away /= np.maximum(np.sqrt((away * away).sum(1, keepdims=True)), 1e-300)
    return cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * away


class Grid:
    """The two codebooks of one vector length, and the sum of keys at which a visit ends."""

    def __init__(self, sample: np.ndarray, rows: int):
        half = max(1, sample.shape[1] // 2)
        self.k = centroids(rows)
        self.half, self.books = half, [codebook(sample[:, :half], self.k), codebook(sample[:, half:], self.k)] if sample.shape[1] > half else [codebook(sample, self.k), np.zeros((1, 0))]
        self.range = max(1, BLOCK // OCCUPANCY)  # second centroids of a group
        self.reach = 4.0

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each row the cell's two numbers, and the keys of all centroids in both halves."""
        out = []
        for part, book in zip((x[:, : self.half], x[:, self.half :]), self.books):
            d = distances(part, book)
            near = d.argmin(1)
            out.append((near, ((d - d.min(1, keepdims=True)) / 2) ** 2))
        return out[0][0], out[1][0], out[0][1], out[1][1]

    def visits(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, list[int]]]:
        """Cells in multi-sequence order up to ``reach``, by first half: (first, seconds)."""
        first, second = (x[np.argsort(k[x], kind="stable")] for k in (a, b) for x in (np.flatnonzero(k <= self.reach),))
        sorted_b = b[second]
        found = []
        for i in first:  # row i of the grid: its cells ascend, and so do the rows' first cells
            n = int(np.searchsorted(sorted_b, self.reach - a[i], "right"))
            if not n:
                break
            found.append((int(i), second[:n].tolist()))
        return found


def centroids(rows: int) -> int:
    """Of a half's codebook: as many as give OCCUPANCY rows a cell."""
    return max(1, round(math.sqrt(rows / OCCUPANCY)))


def _grids(classes: DataFrame, cosine: float) -> dict[int, Grid]:
    grids = {}
    for dim, n in sorted(tuple(r) for r in classes.groupBy("dim").agg(F.count("*")).collect()):  # as many as vectors have lengths
        own = classes.where(F.col("dim") == dim)
        some = own.orderBy(F.xxhash64("node", F.lit(1)), "node").limit(min(SAMPLE_MOST, max(SAMPLE, 32 * centroids(n)))).select("v", "node").toArrow()
        x = unit(matrix(some.column("v")))
        grids[dim] = grid = Grid(x, n)
        probes = x[:PROBES]
        c1, c2, _, _ = grid.keys(neighbours(probes, cosine))
        _, _, k1, k2 = grid.keys(probes)
        at = np.arange(len(probes))
        made = np.sort(k1[at, c1] + k2[at, c2])[min(len(at) - 1, int(RECALL * len(at)))]
        probes, ids = probes[:COUNTED], some.column("node").to_numpy()[:COUNTED]
        k1, k2 = k1[:COUNTED], k2[:COUNTED]

        def needed(batches: Iterator[pa.RecordBatch], grid=grid, probes=probes, ids=ids, k1=k1, k2=k2) -> Iterator[pa.RecordBatch]:
            h = np.zeros(len(ids) * BINS, np.int64)
            for b in batches:
                y = unit(matrix(b.column("v")))
                i, j = np.nonzero((probes @ y.T >= cosine) & (ids[:, None] != b.column("node").to_numpy()))
                if len(i):
                    rows, back = np.unique(j, return_inverse=True)
                    c1, c2, _, _ = grid.keys(y[rows])
                    h += np.bincount(i * BINS + np.minimum(((k1[i, c1[back]] + k2[i, c2[back]]) / 0.5 * BINS).astype(int), BINS - 1), minlength=len(h))
            at = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(at // BINS), pa.array(at % BINS), pa.array(h[at])], names=["probe", "bin", "n"])

        links = own.select("v", "node").mapInArrow(needed, "probe long, bin long, n long").groupBy("probe", "bin").agg(F.sum("n").alias("n"))
        seen = np.zeros((len(ids), BINS))
        for r in links.collect():  # COUNTED by BINS rows at most, a few bins a probe
            seen[r["probe"], r["bin"]] = r["n"]
        seen = seen[seen.any(1)]
        share = np.cumsum((seen / seen.sum(1, keepdims=True)).mean(0)) if len(seen) else np.ones(BINS)
        counted = (int(np.searchsorted(share, RECALL)) + 1) * 0.5 / BINS
        grid.reach = min(max(0.0, 2 - 2 * cosine), max(made, counted)) + 1e-12
    return grids


def _spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of rows and columns of a boolean matrix: the least row or column index joined to them, rows first."""
    n, m = linked.shape
    r, c = np.arange(n), np.full(m, n)
    while True:
        low = np.where(linked, r[:, None], n).min(0, initial=n)
        c2 = np.minimum(c, low)
        r2 = np.minimum(r, np.where(linked, c2[None, :], n).min(1, initial=n))
        if (r2 == r).all() and (c2 == c).all():
            return r, c
        r, c = r2, c2


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    v = F.col("embedding") if kind == "float" else F.col("embedding").cast("array<double>")
    usable = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    digest = F.when(usable, F.md5(F.concat_ws(",", F.transform(v, lambda x: (x + F.lit(0.0)).cast("string")))))  # -0 is 0
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), digest.alias("digest"), v.alias("v"))
    classes = rows.where("digest is not null").groupBy("digest").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "vectors")
    grids = _grids(classes, cosine)
    item = "array<float>" if kind == "float" else "array<double>"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row as resident of its cell, and one for each group of cells that it visits."""
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                dims = part.column("dim").to_numpy()
                for dim in np.unique(dims):
                    sub, grid = part.take(pa.array(np.flatnonzero(dims == dim))), grids[int(dim)]
                    c1, c2, k1, k2 = grid.keys(unit(matrix(sub.column("v"))))
                    who, first, band, role, seconds = [], [], [], [], []
                    for i in range(sub.num_rows):
                        groups: dict[tuple[int, int], list[int]] = {}
                        for f, cells in grid.visits(k1[i], k2[i]):
                            for s in cells:
                                groups.setdefault((f, s // grid.range), []).append(s)
                        who += [i] * (1 + len(groups))
                        first += [int(c1[i]), *(g[0] for g in groups)]
                        band += [int(c2[i]) // grid.range, *(g[1] for g in groups)]
                        role += [0] + [1] * len(groups)
                        seconds += [[int(c2[i])], *groups.values()]
                    take = pa.array(who)
                    cells = pa.array(np.stack([c1, c2], 1).astype(np.int32).tolist(), pa.list_(pa.int32()))
                    out = [pa.array([int(dim)] * len(who), pa.int32()), pa.array(first, pa.int32()), pa.array(band, pa.int32()), pa.array(role, pa.int32()), *(sub.column(c).take(take) for c in ("node", "copies", "v")), cells.take(take), pa.array(seconds, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(out, names=["dim", "first", "band", "role", "node", "copies", "v", "home", "seconds"])

    group = ["dim", "first", "band"]
    placed = classes.select("dim", "node", "copies", "v").mapInArrow(place, f"dim int, first int, band int, role int, node long, copies long, v {item}, home array<int>, seconds array<int>")
    blocks = materialize(placed.groupBy(*group).agg(*(F.greatest(F.lit(1), F.ceil(F.count_if(F.col("role") == k) / BLOCK)).cast("int").alias(f"n{k}") for k in (0, 1))), "blocks")
    large = blocks.where("n0 > 1 or n1 > 1")  # others have one block
    dealt = placed.join(large, group, "left").fillna(1, ["n0", "n1"])
    own = lambda k: F.pmod(F.xxhash64("node"), F.col(f"n{k}")).cast("int")
    every = lambda k: F.sequence(F.lit(0), F.col(f"n{k}") - 1)
    dealt = dealt.withColumn("x", F.explode(F.when(F.col("role") == 0, F.array(own(0))).otherwise(every(0)))).withColumn("y", F.explode(F.when(F.col("role") == 1, F.array(own(1))).otherwise(every(1))))

    def search(key: tuple, table: pa.Table) -> pa.Table:
        grid = grids[key[0].as_py()]
        role, ids, w = (table.column(c).to_numpy() for c in ("role", "node", "copies"))
        res, vis = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        a, b, n = [], [], []
        if len(res) and len(vis):
            x, home = unit(matrix(table.column("v"))), matrix(table.column("home"))
            cells = table.column("seconds").combine_chunks()
            at, flat = cells.offsets.to_numpy(), cells.flatten().to_numpy()
            owner = np.repeat(np.arange(len(role)), np.diff(at))
            visits = role[owner] == 1
            owner, flat = owner[visits], flat[visits]
            counts = np.zeros(len(role), np.int64)
            _, _, k1, k2 = grid.keys(x[res])
            index = np.zeros(len(role), np.int64)
            index[res] = np.arange(len(res))
            for second in np.unique(home[res, 1]):
                there, comers = res[home[res, 1] == second], owner[flat == second]
                for i in range(0, len(comers), 1024):
                    part = comers[i : i + 1024]
                    hit = (x[part] @ x[there].T >= cosine) & (ids[part][:, None] != ids[there][None, :])
                    if not hit.any():
                        continue
                    counts[part] += hit @ w[there]
                    known, back = np.unique(home[part], axis=0, return_inverse=True)
                    mine = index[there]
                    returned = (k1[mine][:, known[:, 0]] + k2[mine][:, known[:, 1]] <= grid.reach).T[back.ravel()]  # whether the resident visits the visitor's cell
                    counts[there] += (hit & ~returned).T @ w[part]
                    r, c = _spanning(hit)
                    rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
                    a += [ids[part[rows]], ids[there[cols]]]
                    b += [ids[part[r[rows]]], ids[part[c[cols]]]]
                    n.append(np.zeros(len(rows) + len(cols), np.int64))
            some = np.flatnonzero(counts)
            a.append(ids[some]), b.append(ids[some]), n.append(counts[some])
        return pa.table({k: pa.array(np.concatenate(c) if c else [], pa.int64()) for k, c in (("a", a), ("b", b), ("n", n))})

    found = dealt.select(*group, "x", "y", "role", "node", "copies", "v", "home", "seconds").groupBy(*group, "x", "y").applyInArrow(search, "a long, b long, n long")
    found = materialize(found.where("a <> b or n > 0"), "found")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    parts = components(found.where("a <> b"))
    named = classes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")).join(counts, "node", "left")
    named = materialize(named.select("digest", "least", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    discard(classes, found, blocks)
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    out = rows.select("vec_id", "digest").join(named.join(names, "component").select("digest", "n_links", "component_id"), "digest", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS reach FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
n AS (SELECT a AS node, count(*) AS n FROM l GROUP BY a)
SELECT m.node AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.c AS component_id, m.node = m.c AS kept
FROM (SELECT node, min(reach) AS c FROM r GROUP BY node) m LEFT JOIN n ON n.node = m.node"""
