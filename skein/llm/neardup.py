"""Near duplicates by MinHash: many universal hash minima with banding, signature verification, exact confirmation on full
sets, and connected components by alternating large-star and small-star.

A document's set is that of its k-word shingles (see shared.shingle_set). Documents with equal sets are one class from the
start. Classes that share a band are candidates. Links are confirmed on the full sets, so none is false; links are sought

1. from each class to the least classes of its buckets (a star, not all pairs), then
2. in blocks of the buckets that still hold several components, along the likeliest pairs by signature that would join all
   of a block's components (a forest: fewer pairs than rows); TRIES turns at most, each with other blocks, then
3. between all classes of different components that a bucket still holds, where signatures don't rule the link out.

A pair that shares a band is thus left out only if its two classes are in one component already, or its signatures differ
by 6 standard errors from what a link would give (a chance of one in a billion for a link). Steps 2 and 3 work in blocks of bounded size; step 3 compares full
sets within a block and gives only links that join components, so a pair that is no link is never a row; no bucket is ever
gathered.

Cases: null text and texts without words have the empty set and link with nothing; a null doc_id takes part, but names no
component unless all of its doc_ids are null; equal rows are linked; an empty table yields no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WordHashes, claim, components, discard, materialize, own_exchange, shingle_set

#: Hash functions, members of a block, and turns of step 2.
HASHES, BLOCK, TRIES = 180, 256, 3
#: What names a block: of a bucket's rows, of its smaller components (kind 0) or between these and the largest one (1).
KEY = ["bucket", "kind", "x", "y"]
_RANDOM = np.random.default_rng(20240607)
_A = _RANDOM.integers(0, 1 << 63, HASHES, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, HASHES, np.uint64)[:, None]
_CACHE = WordHashes()


def band_rows(percent: int) -> int:
    """As many rows in a band as leave a link at the threshold out with a chance of at most two in a million."""
    s = percent / 100
    return next(r for r in (12, 10, 9, 6, 5, 4, 3, 2, 1) if (1 - s**r) ** (HASHES // r) < 2e-6 or r == 1)


def signature(s: np.ndarray) -> np.ndarray:
    """The least values of HASHES universal hash functions (multiply-add-shift, 32 bits)."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 512):
        part = s[None, at : at + 512] * _A
        part += _B
        np.minimum(least, part.min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def sign(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest of the set, 8 bits of each minimum, and the bands' hashes."""
    r = band_rows(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_CACHE)
        for b in batches:
            n, digest, sig, bands = [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text, k, _CACHE)
                n.append(len(s))
                if not len(s):
                    digest.append(None), sig.append(None), bands.append(None)
                    continue
                m = signature(s)
                digest.append(xxhash.xxh3_128_digest(s.tobytes())), sig.append(m.astype(np.uint8).tobytes())
                bands.append(np.array([xxhash.xxh3_64_intdigest(m[i : i + r].tobytes(), seed=i) for i in range(0, HASHES - r + 1, r)], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "digest", "sig", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, digest binary, sig binary, bands array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    chunks = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    pairs = materialize(pairs.join(own_exchange(chunks, "b"), "b").withColumn("chunk", F.pmod(F.xxhash64("a"), F.col("chunks"))).drop("chunks"), "pairs")
    left = pairs.join(texts.select(F.col("node").alias("a"), "text"), "a").select("b", "chunk", F.lit(1).alias("role"), F.col("a").alias("id"), "text")
    right = pairs.select("b", "chunk").distinct().join(texts.select(F.col("node").alias("b"), "text"), "b").select("b", "chunk", F.lit(0).alias("role"), F.col("b").alias("id"), "text")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = left.unionByName(right).repartition(n, "b", "chunk").sortWithinPartitions("b", "chunk", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_CACHE)
        against = np.empty(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for hub, role, node, text in zip(*(batch.column(c).to_pylist() for c in ("b", "role", "id", "text"))):
                s = shingle_set(text, k, _CACHE)
                if role == 0:
                    against = s
                    continue
                both = np.intersect1d(s, against, assume_unique=True).size
                if 100 * both >= percent * (len(s) + len(against) - both):
                    a.append(node), b.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def least_agreement(percent: int) -> int:
    """Equal bytes of two signatures that a link at the threshold falls short of by 6 standard errors only."""
    s = percent / 100
    p = s + (1 - s) / 256
    return math.floor(HASHES * (p - 6 * math.sqrt(p * (1 - p) / HASHES)))


def dealt(members: DataFrame, parts: DataFrame, turn: int | None) -> DataFrame:
    """Rows (KEY, minor, own, node, component) of the buckets that hold several components, dealt out over blocks of them.

    turn: a block holds each row of a bucket once, with others at each turn; after the first turn, buckets of one block are left
    out. None: blocks for all pairs, but not those of a bucket's largest component with itself; minor rows are of the others.
    """
    rows = members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = rows.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("c", "component")).alias("major"), F.max("c").alias("most"), F.sum("c").alias("all")).where("all > most")
    mixed = mixed.where(F.col("all") > BLOCK) if turn else mixed
    rows = rows.join(own_exchange(mixed, "bucket"), "bucket").withColumn("minor", F.col("component") != F.col("major"))
    if turn is not None:
        own = F.pmod(F.xxhash64("node", "bucket", F.lit(turn)), F.ceil(F.col("all") / BLOCK)).cast("int")
        return rows.withColumn("own", own).select("bucket", F.lit(0).alias("kind"), F.col("own").alias("x"), F.col("own").alias("y"), "minor", "own", "node", "component")
    minors, majors = (F.ceil(c / BLOCK).cast("int") for c in (F.col("all") - F.col("most"), F.col("most")))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("minor"), minors).otherwise(majors)).cast("int"))
    with_minors = F.transform(F.sequence(F.lit(0), minors - 1), lambda j: F.struct(F.lit(0).alias("kind"), F.least("own", j).alias("x"), F.greatest("own", j).alias("y")))
    with_majors = F.transform(F.sequence(F.lit(0), majors - 1), lambda j: F.struct(F.lit(1).alias("kind"), F.col("own").alias("x"), j.alias("y")))
    of_major = F.transform(F.sequence(F.lit(0), minors - 1), lambda i: F.struct(F.lit(1).alias("kind"), i.alias("x"), F.col("own").alias("y")))
    rows = rows.withColumn("task", F.explode(F.when(F.col("minor"), F.concat(with_minors, with_majors)).otherwise(of_major)))
    return rows.select("bucket", "task.kind", "task.x", "task.y", "minor", "own", "node", "component")


def together(rows: DataFrame) -> DataFrame:
    """rows, those of a block in one partition and one after another."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *KEY).sortWithinPartitions(*KEY)


def blocks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Each block's key, and its rows of columns."""
    now, got = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            keys = zip(*(part.column(c).to_pylist() for c in KEY))
            for key, row in zip(keys, zip(*(part.column(c).to_pylist() for c in columns))):
                if key != now:
                    if got:
                        yield now, got
                    now, got = key, []
                got.append(row)
    if got:
        yield now, got


def open_pairs(key: tuple, got: list[tuple], least: int, first_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of a block's rows (minor, own, node, component, sig, bands): pairs of places, of different components, that signatures
    leave open, the likeliest first. first_only: pairs whose first common band this is."""
    bucket, kind, x, y = key
    minor, own = np.array([g[0] for g in got], bool), np.array([g[1] for g in got])
    first, second = np.flatnonzero(minor if kind else own == x), np.flatnonzero(~minor if kind else own == y)
    node, component = (np.array([g[c] for g in got], np.int64) for c in (2, 3))
    sig = np.frombuffer(b"".join(g[4] for g in got), np.uint8).reshape(len(got), -1)
    bands = np.array([g[5] for g in got], np.int64) if first_only else None
    out = []
    for at in range(0, len(first), 32):
        rows = first[at : at + 32]
        agree = (sig[rows, None, :] == sig[None, second, :]).sum(2)
        open_ = (agree >= least) & (component[rows, None] != component[None, second])
        if not kind and x == y:
            open_ &= node[rows, None] < node[None, second]
        i, j = np.nonzero(open_)
        found = np.stack([rows[i], second[j], agree[i, j]])
        if first_only and len(i):
            same = bands[found[0]] == bands[found[1]]
            found = found[:, bands[found[0], same.argmax(1)] == bucket]
        out.append(found)
    i, j, agree = np.concatenate(out, 1) if out else np.empty((3, 0), np.int64)
    order = np.lexsort((np.maximum(node[i], node[j]), np.minimum(node[i], node[j]), -agree))
    return i[order], j[order]


def joining(got: list[tuple], i: np.ndarray, j: np.ndarray, linked: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Of pairs of places in a block, in this order, those that are linked and join two of its components: fewer than it has rows."""
    into: dict[int, int] = {}

    def find(c: int) -> int:
        while c in into:
            into[c] = c = into.get(into[c], into[c])
        return c

    out, left = [], len({g[3] for g in got}) - 1
    for a, b in zip(i.tolist(), j.tolist()):
        if not left:
            break
        ca, cb = find(got[a][3]), find(got[b][3])
        if ca != cb and linked(a, b):
            into[ca] = cb
            left -= 1
            out.append((max(got[a][2], got[b][2]), min(got[a][2], got[b][2])))
    return out


def likely(members: DataFrame, classes: DataFrame, parts: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) to confirm: of each block of a bucket's classes the likeliest that would join all its components."""
    rows = dealt(members, parts, turn).join(classes.select("node", "sig", "bands"), "node")
    least, columns = least_agreement(percent), ["minor", "own", "node", "component", "sig", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, got in blocks(batches, columns):
            i, j = open_pairs(key, got, least, False)
            if found := joining(got, i, j, lambda a, b: True):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    return together(rows.select(*KEY, *columns)).mapInArrow(run, "a long, b long").distinct()


def settle(members: DataFrame, classes: DataFrame, parts: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that join all components that a bucket still holds apart and that have a link in it.

    Every pair that signatures leave open is compared on its full sets, unless other links of its block have joined it. Sets
    are compared where they meet: no row is made for a pair that is no link.
    """
    rows = dealt(members, parts, None).join(classes.select("node", "sig", "bands"), "node")
    least, own = least_agreement(percent), ["minor", "own", "node", "component"]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int64())
        for key, got in blocks(batches, [*own, "sig", "bands"]):
            i, j = open_pairs(key, got, least, True)
            if len(i):
                asking = [(*key, *got[r][:4]) for r in np.union1d(i, j).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*asking), kinds)], names=[*KEY, *own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_CACHE)
        for key, got in blocks(batches, [*own, "sig", "bands", "text"]):
            sets: dict[int, np.ndarray] = {}

            def linked(*pair: int) -> bool:
                for r in pair:
                    if r not in sets:
                        sets[r] = shingle_set(got[r][6], k, _CACHE)
                s, t = (sets[r] for r in pair)
                if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                    return False
                both = np.intersect1d(s, t, assume_unique=True).size
                return 100 * both >= percent * (len(s) + len(t) - both)

            i, j = open_pairs(key, got, least, True)
            if found := joining(got, i, j, linked):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    open_ = together(rows.select(*KEY, *own, "sig", "bands")).mapInArrow(asked, "bucket long, kind int, x int, y int, minor boolean, own int, node long, component long")
    met = materialize(open_, "open").join(texts.select("node", "sig", "bands", "text"), "node")
    return together(met.select(*KEY, *own, "sig", "bands", "text")).mapInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept of each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"), F.col(text).cast("string").alias("text"))
    signed = materialize(sign(rows, k, percent), "signed")
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
    )
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1").drop("n")
    members = materialize(banded.join(own_exchange(buckets, "bucket"), "bucket"), "members")
    wanted = members.select("node").distinct().join(classes, "node").select("node", "sig", "bands", F.col("row.doc_id").alias("d"), F.col("row.text_hash").alias("h"))
    texts = materialize(wanted.join(rows, F.col("d").eqNullSafe(rows["doc_id"]) & (F.col("h") == rows["text_hash"])).select("node", "text", "sig", "bands"), "texts")
    stars = members.where("node <> hub").groupBy("node").agg(F.min("hub").alias("p"), F.max("hub").alias("q"))
    stars = stars.select(F.col("node").alias("a"), F.explode(F.array_distinct(F.array("p", "q"))).alias("b"))
    links = materialize(confirm(stars, texts, k, percent), "links")
    parts = components(links)
    members = members.drop("hub")
    idle = False
    for turn in (*range(TRIES), None):
        if turn is None:
            more = materialize(settle(members, classes, parts, texts, k, percent), "links")
        elif idle:
            continue
        else:
            pairs = materialize(likely(members, classes, parts, percent, turn), "pairs")
            more = materialize(confirm(pairs, texts, k, percent), "links")
            discard(pairs)
        if idle := more.isEmpty():
            continue
        # From here on components are joined, not classes again.
        ends = [parts.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab"]
        between = more.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        joined = components(between).select(F.col("node").alias("component"), F.col("component").alias("into"))
        alone = joined.join(parts.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("into").alias("component"))
        parts = parts.join(joined, "component", "left").select("node", F.coalesce("into", "component").alias("component")).unionByName(alone)
        parts = materialize(parts, "parts")
    named = classes.join(parts, "node", "left").select("digest", "least", F.coalesce("component", "node").alias("component"))
    named = materialize(named, "named")
    discard(texts, members, classes, links)
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = named.join(names, "component").select("digest", "component_id")
    out = signed.select("doc_id", "text_hash", "n_shingles", "digest").join(found, "digest", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one document of each group: the one with the least doc_id; equal rows are one."""
    keep = near_groups(docs, k, percent).where("kept").select("doc_id", "text_hash").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"), F.struct(*docs.columns).alias("row"))
    out = rows.join(keep, rows["id"].eqNullSafe(keep["doc_id"]) & (rows["hash"] == keep["text_hash"]), "left_semi")
    return out.dropDuplicates(["id", "hash"]).select("row.*")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hits FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * hits >= 85 * (x.n + y.n - hits)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM n UNION SELECT r.node, u.b FROM r JOIN u ON r.reach = u.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept
FROM n JOIN (SELECT node, min(reach) AS c FROM r GROUP BY node) m ON n.doc_id = m.node"""
