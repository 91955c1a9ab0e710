"""Exact repeats of at least ``least`` bytes, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A text's bytes are removed if a string of ``least`` bytes that covers them also starts anywhere else, in any text or the
same one. Finding them takes these steps:

1. Every window of ``least`` bytes has an anchor, the ``q``-gram of the least hash in it (the first one of these), which
   the window's content alone decides: equal windows have equal anchors at equal places. Of each anchor two hashes are
   taken, that of the q-gram, and that of its context: all bytes that a window containing it can have.
2. Equal contexts are repeats as a whole. Anchors that occur once are dropped. Contexts that are unique, though their
   anchor isn't, are compared.
3. A window around an anchor holds one of CORES longer strings around it, by how far it reaches to the left. Contexts none of
   whose cores occurs twice are dropped. Of the rest, contexts of an anchor meet in one place. An anchor's place follows from
   the rarest anchor of the texts that hold it, so that anchors near each other in near copies of a text share a place: contexts of a
   text that overlap there are joined to one stretch. The suffixes of a place's stretches are sorted, and a breadth-first
   backward extension over their Burrows-Wheeler transform derives common prefixes by increasing value and stops at
   ``least``. Neighbours in suffix order without a value then share ``least`` bytes.
4. A place has LIMIT contexts, about: the anchors of a larger one are dealt out by a hash. Anchors with more than CHUNK contexts
   are dealt out over several chunks of their place; these also give the hashes of all windows whose core occurs twice (of those
   that are repeated in the chunk, one each), many to a row, dealt out by hash, and windows are counted over all chunks.

Texts that occur more than once are repeats as a whole if they have ``least`` bytes; they are counted like all others, but
not searched further.

Cases: null text is empty text; texts of fewer bytes lose nothing; equal rows are two occurrences; equal or null doc_ids
don't matter; an empty table yields no rows; other columns are ignored. In a text that is cut within a character, that
character's remaining bytes are left out of the text (not of kept_sha256).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import claim, discard, materialize, mix

#: Contexts of an anchor that meet in one place, of all anchors of a place, bytes of a text whose anchors share a place, and bytes
#: whose suffixes are sorted together, about.
CHUNK, LIMIT, REGION, BATCH_BYTES, CORES = 1024, 1 << 14, 4096, 1 << 20, 4
_SEGMENT = 1 << 18
_ODD = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(77).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int, base: int) -> np.ndarray:
    factors = np.full(n + 1, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


_UP, _DOWN = _powers(_SEGMENT + 8192, _ODD), _powers(_SEGMENT + 8192, pow(_ODD, -1, 1 << 64))


def winnow(raw: bytes, least: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of raw, ascending, and their hashes."""
    places, hashes = [], []
    for at in range(0, max(1, len(raw) - least + 1), _SEGMENT):
        x = np.frombuffer(raw, np.uint8, min(len(raw) - at, _SEGMENT + least - 1), at)
        n = len(x) - q + 1
        if len(x) < least:
            continue
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_BYTES[x] * _UP[: len(x)], out=sums[1:])
        h = mix((sums[q:] - sums[:n]) * _DOWN[:n])
        key = (h & ~np.uint64((1 << 20) - 1)) | np.arange(n, dtype=np.uint64)
        w, span, low = least - q + 1, 1, key
        while 2 * span <= w:
            low, span = np.minimum(low[:-span], low[span:]), 2 * span
        if span < w:
            low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
        found = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
        found = np.unique(found[np.append(True, found[1:] != found[:-1])])
        places.append(found + at), hashes.append(h[found])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    p, first = np.unique(np.concatenate(places), return_index=True)
    return p, np.concatenate(hashes)[first].view(np.int64)


def suffix_array(t: np.ndarray, rest: np.ndarray, depth: int) -> np.ndarray:
    """Starts in order of suffix, compared up to ``depth`` bytes and the next separator, by prefix doubling.

    t: bytes + 1, separators 0; rest: bytes from each place to its separator.
    """
    n, k = len(t), 7
    padded = np.concatenate([t, np.zeros(k, t.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for i in range(k):
        key = (key << 9) | np.where(rest > i, padded[i : i + n], 0)
    sa = np.argsort(key)  # ties may come in any order
    sorted_key = key[sa]
    head = np.append(True, sorted_key[1:] != sorted_key[:-1])
    rank = np.empty(n, np.int64)
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[sa] = first
    while k < depth:
        tied = ~head | np.append(~head[1:], False)
        at = np.flatnonzero(tied)
        at = at[rest[sa[at]] >= k]
        if not len(at):
            break
        who = sa[at]
        second = rank[np.minimum(who + k, n - 1)]
        order = np.lexsort((second, rank[who])) if n > 1 << 31 else np.argsort(rank[who] * n + second)
        who, second = who[order], second[order]
        sa[at] = who
        # a new group begins where the group or the second half changes
        head[at] |= np.append(True, (rank[who][1:] != rank[who][:-1]) | (second[1:] != second[:-1]))
        first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[sa] = first
        k *= 2
    return sa


def bounded_prefixes(t: np.ndarray, sa: np.ndarray, least: int) -> np.ndarray:
    """Longest common prefixes of neighbours in suffix order by backward extension, in ascending order of value.

    -1 where the value is ``least`` or more, or where one of the two meets a separator first.
    """
    n = len(t)
    bwt = t[sa - 1]  # before the first place: the last separator
    lf = np.empty(n, np.int64)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n)
    lcp = np.full(n + 1, -1, np.int32)
    lcp[0] = lcp[n] = 0
    lo, hi = np.array([0]), np.array([n - 1])
    for value in range(least):
        one = lo == hi
        single = lo[one]
        single = single[bwt[single] > 0]
        a = b = lf[single]
        lo, hi = lo[~one], hi[~one]
        if len(lo):
            size = hi - lo + 1
            owner = np.repeat(np.arange(len(lo)), size)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + lo[owner]
            c = bwt[at]
            at, owner, c = at[c > 0], owner[c > 0], c[c > 0]
            to = lf[at]
            order = np.argsort(to)
            to, owner, c = to[order], owner[order], c[order]
            new = np.append(True, (owner[1:] != owner[:-1]) | (c[1:] != c[:-1])) if len(to) else np.empty(0, bool)
            a = np.concatenate([a, to[new]])
            b = np.concatenate([b, to[np.append(new[1:], True)] if len(to) else to])
        fresh = lcp[b + 1] < 0
        lo, hi = a[fresh], b[fresh]
        if not len(lo):
            break
        lcp[hi + 1] = value
    return lcp[:n]


def repeated(stretches: list[bytes], where: np.ndarray, twice: list[tuple[int, int, int]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the concatenated stretches (a separator after each) which places start a repeated window; the offsets of stretches.

    where: a number for each stretch, such that number + offset identifies a place of the corpus. twice: (stretch, first,
    last) starts of windows that are known to occur again.
    """
    sizes = np.array([len(c) for c in stretches], np.int64)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    t = np.zeros(int(ends[-1]), np.int16)
    body = np.ones(len(t), bool)
    body[ends - 1] = False
    t[body] = np.frombuffer(b"".join(stretches), np.uint8).astype(np.int16) + 1
    of = np.repeat(np.arange(len(stretches)), sizes + 1)
    rest = ends[of] - 1 - np.arange(len(t))
    again = np.zeros(len(t), bool)
    for i, first, last in twice:
        again[starts[i] + first : starts[i] + last + 1] = True
    sa = suffix_array(t, rest, least)
    lcp = bounded_prefixes(t, sa, least)
    long = rest[sa] >= least
    joined = (lcp < 0) & long & np.append(False, long[:-1])
    group = np.cumsum(~joined) - 1
    with np.errstate(over="ignore"):
        place = where[of[sa]] + (sa - starts[of[sa]])
    firsts = np.flatnonzero(~joined)
    differ = np.minimum.reduceat(place, firsts) != np.maximum.reduceat(place, firsts)
    differ |= np.logical_or.reduceat(again[sa], firsts)
    out = np.zeros(len(t), bool)
    out[sa] = differ[group] & long
    return out, starts


def _runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


MARKS = pa.list_(pa.struct([("pos", pa.int32()), ("mask", pa.int32()), ("twice", pa.bool_())]))
#: A window of a hot anchor: digest, text, start, whether it is known to be repeated.
WINDOW = np.dtype([("d", "<u8", 2), ("uid", "<u8", 2), ("at", "<i4"), ("sure", "?")])


def places(chosen: DataFrame) -> DataFrame:
    """h, spot, chunks: where the contexts of each anchor of ``chosen`` (h, uid, pos) meet."""
    size = materialize(chosen.groupBy("h").agg(F.count("*").alias("n"), F.min("pos").alias("first")), "sizes")
    held = materialize(chosen.select("h", "uid").distinct().join(size.select("h", "n"), "h"), "held")
    rarest = materialize(held.groupBy("uid").agg(F.min(F.struct("n", "h")).alias("lead")), "rarest")  # a row for each text
    homes = held.join(rarest, "uid").groupBy("h").agg(F.min("lead").alias("home"))
    homes = homes.join(size, "h").withColumn("region", F.floor(F.col("first") / REGION))
    rooms = F.ceil(F.sum("n").over(Window.partitionBy("home", "region")) / LIMIT)
    spot = F.xxhash64("home.h", "region", F.pmod(F.xxhash64("h"), rooms))
    return materialize(homes.select("h", spot.alias("spot"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "places")


def find(docs: DataFrame, least: int, text: str = "text") -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(copied, cut, made): uids of texts that occur more than once; uid, kept (what is left), sha (of its
    bytes), n_removed, n_spans of texts that occur once
    and lose something. uid is the MD5 of the
    text; made: tables to discard when copied and cut have been read."""
    spark = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q = max(8, 2 * least // 5)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.unhex(F.md5(body)).alias("uid"), body.alias("text")).where(F.octet_length("text") >= least)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                places, hashes, sums, counts = [], [], [], []
                for t in part.column("text").to_pylist():
                    raw = t.encode("utf-8", "surrogatepass")
                    p, h = winnow(raw, least, q)
                    lows = np.maximum(p + q - least, 0)
                    sums += [xxhash.xxh3_64_intdigest(raw[i:j], k) for i, j, k in zip(lows.tolist(), (p + least).tolist(), (p - lows).tolist())]
                    places.append(p), hashes.append(h), counts.append(len(p))
                who = pa.array(np.repeat(np.arange(part.num_rows), counts))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.array(sums, np.uint64).view(np.int64)), part.column("uid").take(who), pa.array(np.concatenate(places).astype(np.int32))], names=["h", "c", "uid", "pos"])

    found = materialize(rows.mapInArrow(anchors, "h long, c long, uid binary, pos int"), "anchors")
    contexts = found.groupBy("h", "c").agg(F.count("*").alias("n"))
    several = contexts.groupBy("h").agg(F.sum("n").alias("all"), F.count_if(F.col("n") == 1).alias("edges")).where("all > 1")
    several = materialize(several.select("h", (F.col("edges") > 0).alias("open")), "several")  # joins of tables: Spark splits a hot h
    kinds = materialize(found.join(several, "h"), "anchors")
    whole = materialize(kinds.groupBy("h", "c").agg((F.count("*") > 1).alias("whole")), "whole")
    known = materialize(kinds.join(whole, ["h", "c"]), "known")
    copied = materialize(rows.groupBy("uid").agg(F.count("*").alias("n")).where("n > 1").select("uid"), "copied")
    single = known.join(copied, "uid", "left_anti")
    # What is wanted of a text: whole contexts to remove (kind 0), contexts to compare (1), and one of each whole kind to compare with (2).
    wanted = single.select("uid", F.when(F.col("whole"), 0).otherwise(1).alias("kind"), "h", "pos")
    samples = known.where("whole and open").groupBy("h", "c").agg(F.min(F.struct("uid", "pos")).alias("s"))
    wanted = wanted.unionByName(samples.select("s.uid", F.lit(2).alias("kind"), "h", "s.pos"))
    by_text = wanted.groupBy("uid").agg(F.collect_list(F.struct("kind", "h", "pos")).alias("wanted"))
    texts = rows.groupBy("uid").agg(F.first("text").alias("text"))
    work = materialize(texts.join(by_text, "uid"), "work")
    discard(found)

    step = (least - q) // CORES
    reach = [(g * step, least - q - (g + 1) * step if g < CORES - 1 else 0) for g in range(CORES)]  # left and right of the anchor

    def core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, out = b.slice(at, 64), []
                for uid, t, wanted in zip(*(part.column(c).to_pylist() for c in ("uid", "text", "wanted"))):
                    raw = t.encode("utf-8", "surrogatepass")
                    for w in wanted:
                        p = w["pos"]
                        out += [(w["h"], g, xxhash.xxh3_64_intdigest(raw[p - i : p + q + j]) - (1 << 63), uid, p, w["kind"] == 2) for g, (i, j) in enumerate(reach) if p >= i and p + q + j <= len(raw)]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names=["h", "g", "core", "uid", "pos", "twice"])

    asked = work.select("uid", "text", F.filter("wanted", lambda w: w["kind"] > 0).alias("wanted")).where("size(wanted) > 0")
    cores = materialize(asked.mapInArrow(core, "h long, g int, core long, uid binary, pos int, twice boolean"), "cores")
    shared = materialize(cores.groupBy("h", "g", "core").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "shared")
    chosen = cores.join(shared, ["h", "g", "core"]).groupBy("h", "uid", "pos").agg(F.max("twice").alias("twice"), F.bit_or(F.pow(F.lit(2), F.col("g")).cast("int")).alias("mask"))
    chosen = materialize(chosen, "chosen")
    dealt = chosen.join(places(chosen), "h")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("uid", F.shiftright("pos", 16)), F.col("chunks")).cast("int")).withColumn("mask", F.when(F.col("chunks") > 1, F.col("mask")).otherwise(0))
    dealt = dealt.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("spot", "chunk", "pos", "mask", "twice"))).alias("wanted"))
    pieces = work.select("uid", "text").join(dealt, "uid")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, out = b.slice(at, 64), []
                for uid, t, wanted in zip(*(part.column(c).to_pylist() for c in ("uid", "text", "wanted"))):
                    raw = t.encode("utf-8", "surrogatepass")
                    now = None
                    for w in wanted:
                        pos, key = w["pos"], (w["spot"], w["chunk"])
                        low, high = max(pos + q - least, 0), min(pos + least, len(raw))
                        if key != now or low > end:
                            if now:
                                out.append((*now, uid, start, raw[start:end], marks))
                            now, start, marks = key, low, []
                        end = high
                        if w["mask"] or w["twice"]:
                            marks.append((pos, w["mask"], w["twice"]))
                    if now:
                        out.append((*now, uid, start, raw[start:end], marks))
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), MARKS)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names=["spot", "chunk", "uid", "low", "stretch", "marks"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        held, size, last = [], 0, None

        def done() -> pa.RecordBatch:
            uids = [r[2] for r in held]
            where = np.array([int.from_bytes(u[:8], "little", signed=True) for u in uids], np.int64)
            with np.errstate(over="ignore"):
                where = where + np.array([r[3] for r in held], np.int64)
            known = [(i, max(m["pos"] + q - least - r[3], 0), min(m["pos"] - r[3], len(r[4]) - least)) for i, r in enumerate(held) for m in r[5] if m["twice"]]
            on, starts = repeated([r[4] for r in held], where, known, least)
            out, windows, seen = [], [], set()
            for r, at in zip(held, starts.tolist()):
                mine = on[at : at + len(r[4])]
                for m in r[5]:
                    here = m["pos"] - r[3]
                    for i in range(max(here + q - least, 0), min(here, len(r[4]) - least) + 1) if m["mask"] else ():
                        if m["mask"] >> min((here - i) // step, CORES - 1) & 1:
                            d = xxhash.xxh3_128_digest(r[4][i : i + least])
                            if d not in seen:  # else another window of the chunk speaks for it, or it is the same one
                                seen.add(d)
                                windows.append((d, r[2], r[3] + i, bool(mine[i])))
                out += [(r[2], r[3] + i, r[3] + j - 1 + least, None, None) for i, j in zip(*(x.tolist() for x in _runs(mine)))]
            if windows:
                digests, owners, ats, sure = zip(*windows)
                packed = np.empty(len(windows), WINDOW)
                packed["d"], packed["uid"] = (np.frombuffer(b"".join(x), "<u8").reshape(-1, 2) for x in (digests, owners))
                packed["at"], packed["sure"] = ats, sure
                bucket = (packed["d"][:, 0] % np.uint64(shuffles)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                names, first = np.unique(bucket[order], return_index=True)
                out += [(None, None, None, int(k), x.tobytes()) for k, x in zip(names, np.split(packed[order], first[1:]))]
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names=["uid", "low", "high", "bucket", "windows"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("spot", "chunk", "uid", "low", "stretch", "marks"))):
                if row[:2] != last and size >= BATCH_BYTES:
                    yield done()
                    held, size = [], 0
                last = row[:2]
                held.append(row)
                size += len(row[4])
        if held:
            yield done()
        held.clear()
        claim()

    pieces = pieces.mapInArrow(cut_out, "spot long, chunk int, uid binary, low int, stretch binary, marks array<struct<pos int, mask int, twice boolean>>")
    met = pieces.repartition(shuffles, "spot", "chunk").sortWithinPartitions("spot", "chunk", "uid", "low")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def late() -> pa.RecordBatch:
            w = np.frombuffer(b"".join(held), WINDOW)
            w = w[np.lexsort((w["d"][:, 1], w["d"][:, 0]))]
            head = np.append(True, (w["d"][1:] != w["d"][:-1]).any(1))
            first, group = np.flatnonzero(head), np.cumsum(head) - 1
            other = (w["uid"] != w["uid"][first][group]).any(1) | (w["at"] != w["at"][first][group])
            again = np.logical_or.reduceat(other | w["sure"], first)[group] & ~w["sure"]
            uids, at = [u.tobytes() for u in w["uid"][again]], w["at"][again]
            return pa.RecordBatch.from_arrays([pa.array(uids, pa.binary()), pa.array(at, pa.int32()), pa.array(at + least, pa.int32())], names=["uid", "low", "high"])

        for b in batches:
            for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("windows").to_pylist()):
                if bucket != now and held:
                    yield late()
                    held.clear()
                now = bucket
                held.append(blob)
        if held:
            yield late()

    met = materialize(met.mapInArrow(compare, "uid binary, low int, high int, bucket long, windows binary"), "met")
    dealt = met.where("bucket is not null").select("bucket", "windows").repartition(shuffles, "bucket").sortWithinPartitions("bucket")
    spans = met.where("bucket is null").select("uid", "low", "high").unionByName(dealt.mapInArrow(count, "uid binary, low int, high int"))
    spans = spans.groupBy("uid").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    whole = work.withColumn("whole", F.transform(F.filter("wanted", lambda w: w["kind"] == 0), lambda w: w["pos"])).select("uid", "text", "whole").join(copied, "uid", "left_anti")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, out = b.slice(at, 64), []
                for uid, t, places, spans in zip(*(part.column(c).to_pylist() for c in ("uid", "text", "whole", "spans"))):
                    raw = t.encode("utf-8", "surrogatepass")
                    step = np.zeros(len(raw) + 1, np.int32)
                    p = np.array(places or [], np.int64)
                    np.add.at(step, np.maximum(p + q - least, 0), 1)
                    np.add.at(step, np.minimum(p + least, len(raw)), -1)
                    for s in spans or []:
                        step[s["low"]] += 1
                        step[s["high"]] -= 1
                    off = np.cumsum(step[:-1]) > 0
                    if off.any():
                        kept = np.frombuffer(raw, np.uint8)[~off].tobytes()
                        out.append((uid, kept.decode("utf-8", "ignore"), hashlib.sha256(kept).hexdigest(), int(off.sum()), len(_runs(off)[0])))
                kinds = (pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names=["uid", "kept", "sha", "n_removed", "n_spans"])

    cut = whole.join(spans, "uid", "left").where("size(whole) > 0 or spans is not null").mapInArrow(remove, "uid binary, kept string, sha string, n_removed long, n_spans long")
    return copied, cut, [work, copied, known, chosen, met]


def report(docs: DataFrame, least: int = 400, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text (what is left of it) of each row."""
    copied, cut, made = find(docs, least, text)
    none = hashlib.sha256(b"").hexdigest()
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.unhex(F.md5(body)).alias("uid"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("whole"), body.alias("body"))
    gone = copied.select("uid", F.lit("").alias("kept"), F.lit(none).alias("sha"), F.lit(-1).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"))
    found = materialize(cut.unionByName(gone), "found")
    discard(*made)
    out = rows.join(found, "uid", "left")
    return out.select(
        "doc_id", "n_bytes",
        F.when(F.col("n_removed") == -1, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"), F.coalesce("kept", "body").alias("text"),
    )


def strip(docs: DataFrame, least: int, text: str = "text") -> DataFrame:
    """docs with repeats removed from their texts; n_chars, if there, is brought up to date."""
    copied, cut, made = find(docs, least, text)
    found = materialize(cut.select("uid", "kept").unionByName(copied.select("uid", F.lit("").alias("kept"))), "found")
    discard(*made)
    rows = docs.select(F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))).alias("uid"), F.struct(*docs.columns).alias("row"))
    left = F.coalesce("kept", F.col("row").getField(text).cast("string"))
    length = F.coalesce(F.length(left), F.lit(0))
    new = {text: left} | ({"n_chars": length.cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.join(found, "uid", "left").select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
