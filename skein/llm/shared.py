"""What several operators share: tables in the shared folder, row keys, word hashes, graph components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named by ``spark.checkpoint.dir``. Unset, it is a temporary folder in local mode (tests); a cluster
    has to name one.
    """
    conf = spark.sparkContext.getConf()
    if named := conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local") or "cluster" in conf.get("spark.master", "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='skein-')}"
        atexit.register(_forget, _OWN[app])
    return _OWN[app]


def _forget(uri: str) -> None:
    import shutil

    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/skein/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: this cuts the lineage and survives lost executors.

    The table goes when it is discarded, at the latest when the application ends.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    where, store = _hadoop(df.sparkSession, path)
    store.deleteOnExit(where)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_skein_path", None):
            where, store = _hadoop(df.sparkSession, path)
            store.delete(where, True)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def own_exchange(df: DataFrame, *keys: str) -> DataFrame:
    """df with its long keys computed anew, so that a join on them shuffles df itself: Spark splits a hot key's rows only
    where both sides of a join come from shuffles of their own, not from an aggregate on that key."""
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0).cast("long")) for k in keys})


def asciilower(col: Column) -> Column:
    """A-Z to a-z; all else as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_CACHES: list[dict] = []


def claim(mine: dict | None = None) -> None:
    """At the start of a task: empties the caches that other operators left in this worker process, and gives memory back."""
    import ctypes

    import pyarrow as pa

    others = [c for c in _CACHES if c is not mine and c]
    for c in others:
        c.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries give memory back on demand
        ctypes.CDLL(None).malloc_trim(0)


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash; a cache of bounded size."""

    LIMIT = 1 << 18

    def __init__(self) -> None:
        _CACHES.append(self)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, k: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of the ASCII-lowered text.

    Words are runs of bytes other than space and \\t\\n\\v\\f\\r. With 1 to k-1 words the whole sequence is the only
    shingle; without words the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    if n < k:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=n)], np.uint64)
    s = h[: n - k + 1].copy()
    for i in range(1, k):
        s *= np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(29)
        s += h[i : n - k + 1 + i]
    return np.unique(mix(s))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star.

    edges: two columns of node ids of one orderable type. Returns (node, component) for each node that has an edge to
    another one; component is the least node id of its component. No adjacency list is ever gathered: each star is a
    minimum per node (partially aggregated) and a join of the edge rows with those minima.
    """

    def tidy(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    e = materialize(tidy(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    mark = lambda t: tuple(t.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    last = mark(e)
    while last[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = tidy(both.where("v > u").join(own_exchange(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own_exchange(low, "u"), "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v")
        new = materialize(tidy(small), "edges")
        now = mark(new)
        discard(e)
        e = new
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def gapless(df: DataFrame, group: str, part: str, order: list[Column], out: str) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... within each value of ``group``, ordered by the value of ``part``, then ``order``.

    ``part`` deals each group out over bounded parts, in order; only counts per (group, part) meet in one place.
    """
    from pyspark.sql import Window

    counts = df.groupBy(group, part).agg(F.count("*").alias("_n"))
    base = counts.withColumn("_base", F.sum("_n").over(Window.partitionBy(group).orderBy(part)) - F.col("_n")).drop("_n")
    local = df.withColumn("_at", F.row_number().over(Window.partitionBy(group, part).orderBy(*order)) - 1)
    keyed = base.select(F.col(group).alias("_g"), F.col(part).alias("_p"), "_base")
    return local.join(keyed, local[group].eqNullSafe(F.col("_g")) & (local[part] == F.col("_p"))).withColumn(out, (F.col("_base") + F.col("_at")).cast("long")).drop("_g", "_p", "_base", "_at")
