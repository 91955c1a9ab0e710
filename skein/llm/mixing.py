"""Mixing sources to target weights, with DataFrame functions only.

Sizes are words. Targets: the mix takes ``share`` times all sizes, dealt to sources by weight; no target exceeds
``most`` times its source's size, and what is above is dealt again by weight until none is. Each source is cut into
blocks, dealt by a hash of the document, so that blocks in ascending number are already a random permutation. A source's quota is
the number of blocks that meet its target: all blocks as often as the target holds the whole source, then the first ones,
of which the last is taken in part, up to the target's last word.

A splitting tree divides the vector of quotas among the output shards: each node gives half of its blocks to the left, and
draws how many of these each source gives from the multivariate hypergeometric distribution (source by source, each draw
by inversion of the hypergeometric distribution function with a hashed uniform number), with exact totals; the right gets the rest. A
source's permuted blocks then go to the shards in order, as many as each one's quota says, so that they are disjoint. What the mix takes of a
document follows from the drawn blocks that hold it. A shard's documents are put in hashed order, in local parts.

The tree works on one row for each node: a number for each source, all sources in one array (as the targets' windows do).

Cases: null text has no words; the null source is one source, last in order; documents without words are taken never
(0 words); a copy cut after some words keeps all that stands before and between them; equal rows are separate documents; an empty table yields no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Documents in a block, about.
BLOCK = 256
#: Blocks that a prefix sum takes together.
SUPER = 256


def _long(text: Column) -> Column:
    """60 bits of the MD5 of text."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _key() -> Column:
    doc, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text"))
    return F.md5(F.concat(doc, F.lit(":"), F.md5(text)))


def targets(rows: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """skey, source_size, n_blocks, target of each source of rows (skey, size)."""
    by_name, before = Window.orderBy("skey"), Window.orderBy("level", "skey").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = rows.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("top", most * F.col("source_size")).withColumn("level", F.col("top") / F.col("w"))
    rest = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("top").over(before), F.lit(0.0))
    s = s.withColumn("rate", rest / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("full", F.col("level") <= F.col("rate"))
    rate = F.min_by(F.when(~F.col("full"), F.col("rate")), F.when(~F.col("full"), F.struct("level", "skey"))).over(everything)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("long")
    return s.select("skey", "source_size", blocks.alias("n_blocks"), F.when(F.col("full"), F.col("top")).otherwise(rate * F.col("w")).alias("target"))


#: ln k! of small k; above, a series of four terms is exact to 12 digits.
_LN_FACTORIALS = [math.lgamma(k + 1) for k in range(16)]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being computed once."""
    return F.transform(F.array(value), body)[0]


def _ln_factorial(x: Column) -> Column:
    d = x.cast("double")
    series = d * F.ln(d) - d + 0.5 * F.ln(2 * math.pi * d) + 1 / (12 * d) - 1 / (360 * d * d * d) + 1 / (1260 * d * d * d * d * d)
    return F.when(x < 16, F.get(F.array(*map(F.lit, _LN_FACTORIALS)), x.cast("int"))).otherwise(series)


def _hypergeometric(n_all: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``drawn`` blocks out of ``n_all`` are among the ``marked`` ones: inversion at ``uniform``, within 9 standard deviations."""

    def of(v: Column) -> Column:
        mean = v["n"] * (v["k"] / F.greatest(v["m"], F.lit(1)))
        sd = F.sqrt(F.greatest(F.lit(0.0), mean * (1 - v["k"] / F.greatest(v["m"], F.lit(1))) * ((v["m"] - v["n"]) / F.greatest(v["m"] - 1, F.lit(1)))))
        low = F.greatest(F.lit(0), v["n"] + v["k"] - v["m"], F.floor(mean - 9 * sd - 9)).cast("long")
        high = F.least(v["n"], v["k"], F.ceil(mean + 9 * sd + 9)).cast("long")
        cost = lambda x: _ln_factorial(x) + _ln_factorial(v["k"] - x) + _ln_factorial(v["n"] - x) + _ln_factorial(v["m"] - v["k"] - v["n"] + x)
        costs = F.transform(F.sequence(low, high), cost)
        weights = lambda c: _let(F.array_min(c), lambda least: F.transform(c, lambda x: F.exp(least - x)))

        def pick(w: Column) -> Column:
            start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("at"))
            add = lambda acc, x: acc["sum"] + x
            aim = v["u"] * F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x)
            at = _let(aim, lambda aim: F.aggregate(w, start, lambda acc, x: F.struct(add(acc, x).alias("sum"), (acc["at"] + (add(acc, x) <= aim).cast("long")).alias("at")), lambda acc: acc["at"]))
            return F.least(low + at, high)

        return _let(costs, lambda c: _let(weights(c), pick))

    return _let(F.struct(n_all.alias("m"), marked.alias("k"), drawn.alias("n"), uniform.alias("u")), of)


def split(quotas: DataFrame, shards: int) -> DataFrame:
    """skey, ends of rows (skey, quota): how many of a source's blocks the shards 0 to i take together, for each i; shards is a power of two."""
    tree = quotas.agg(F.array_sort(F.collect_list(F.struct("skey", "quota"))).alias("s")).select(F.lit(0).alias("node"), F.col("s.skey").alias("names"), F.col("s.quota").alias("q"))
    for level in range(shards.bit_length() - 1):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda acc, x: acc + x)
        start = F.struct(F.ceil(total / 2).cast("long").alias("left"), total.alias("all"), F.array().cast("array<bigint>").alias("out"))

        name = f"split {level}"

        def give(acc: Column, s: Column) -> Column:
            uniform = (_long(F.concat_ws("|", F.lit(name), F.col("node").cast("string"), s["names"])).cast("double") + 0.5) / float(1 << 60)
            return _let(_hypergeometric(acc["all"], s["q"], acc["left"], uniform), lambda x: F.struct((acc["left"] - x).alias("left"), (acc["all"] - s["q"]).alias("all"), F.concat(acc["out"], F.array(x)).alias("out")))

        lefts = F.aggregate(F.arrays_zip("names", "q"), start, give, lambda acc: acc["out"])
        tree = tree.withColumn("lefts", lefts)
        child = lambda right, q: F.struct((2 * F.col("node") + right).alias("node"), q.alias("q"))
        tree = tree.select("names", F.explode(F.array(child(0, F.col("lefts")), child(1, F.zip_with("q", "lefts", lambda a, b: a - b)))).alias("c")).select("c.node", "names", "c.q")
    leaves = tree.select("node", F.explode(F.arrays_zip("names", "q")).alias("s")).groupBy(F.col("s.names").alias("skey")).agg(F.array_sort(F.collect_list(F.struct("node", "s.q"))).alias("l"))
    return leaves.select("skey", F.transform(F.sequence(F.lit(1), F.size("l")), lambda i: F.aggregate(F.slice(F.col("l.q"), 1, i), F.lit(0).cast("long"), lambda acc, x: acc + x)).alias("ends"))


def mix(docs: DataFrame, shards: int = 8, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, keyed: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards of each document.

    taken: words that the mix takes, repeats counted: ``taken div size`` whole copies, then the first
    ``taken mod size`` words. shards: the shards of these copies, in order, joined by commas. keyed: with a key of
    doc_id and text, and the bytes of all texts that the mix has, about.
    """
    if shards & (shards - 1) or most < share:
        raise ValueError("shards must be a power of two, and most at least share")
    text = F.col("text").cast("string")
    rows = materialize(
        docs.select(
            F.col("doc_id"),
            F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source").cast("string"))).alias("skey"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            _key().alias("key"), F.octet_length(text).cast("long").alias("bytes"),
        ),
        "mix",
    )
    aims = materialize(targets(rows, share, most, weights), "targets")  # a row for each source
    block = F.conv(F.substring("key", 1, 15), 16, 10).cast("long") % F.col("n_blocks")
    sums = rows.join(aims.select("skey", "n_blocks"), "skey").groupBy("skey", block.alias("block")).agg(F.sum("size").alias("words"))
    sums = materialize(sums.withColumn("super", F.floor(F.col("block") / SUPER)), "sums")
    high = sums.groupBy("skey", "super").agg(F.sum("words").alias("w"))
    high = high.select("skey", "super", (F.sum("w").over(Window.partitionBy("skey").orderBy("super")) - F.col("w")).alias("below"))
    base = F.col("below") + F.sum("words").over(Window.partitionBy("skey", "super").orderBy("block")) - F.col("words")
    placed = materialize(sums.join(high, ["skey", "super"]).select("skey", "block", base.alias("base")), "blocks")
    want = F.floor(F.col("target") + 0.5)
    passes = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(want / F.greatest("source_size", F.lit(1)))).cast("int")
    aims = aims.withColumn("passes", passes).withColumn("rest", (want - F.col("passes") * F.col("source_size")).cast("long"))
    started = F.coalesce(F.max(F.when(F.col("base") < F.col("rest"), F.col("block") + 1)), F.lit(0))
    quotas = placed.join(aims, "skey").groupBy("skey").agg((F.first(F.col("passes") * F.col("n_blocks")) + started).cast("long").alias("quota"))
    aims = materialize(aims.join(split(materialize(quotas, "quotas"), shards), "skey"), "dealt")

    rows = rows.join(aims, "skey").withColumn("block", block)
    inside = F.sum("size").over(Window.partitionBy("skey", "block").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    out = rows.withColumn("inside", inside).join(placed, ["skey", "block"])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("base") - F.col("inside"))).cast("long")

    def slot(i: Column) -> Column:
        """The i-th time that the mix comes to the document's block: the shard that drew it, and the words it takes."""
        shard = F.size(F.filter("ends", lambda end: end <= i * F.col("n_blocks") + F.col("block")))
        return F.struct(shard.alias("shard"), F.when(i < F.col("passes"), F.col("size")).otherwise(F.col("part")).alias("words"))

    drawn = F.filter(F.transform(F.sequence(F.lit(0), F.col("passes")), slot), lambda d: (d["words"] > 0) & (d["shard"] < shards))
    out = out.withColumn("part", part).withColumn("drawn", drawn)
    return out.select(
        "doc_id", "size", "source_size", "target", *(["key", "bytes"] if keyed else []),
        F.aggregate("drawn", F.lit(0).cast("long"), lambda acc, d: acc + d["words"]).alias("taken"),
        F.array_join(F.col("drawn.shard"), ",").alias("shards"),
    )


def realize(docs: DataFrame, shards: int = 8, part_bytes: int = 64 << 20, **how) -> DataFrame:
    """The mix itself: docs' columns, a row for each copy, the last copy cut after the words taken, in hashed order within a local part of a shard.

    A shard has as many local parts as keep each at ``part_bytes``, about. n_chars, if there, is brought up to date.
    """
    got = materialize(mix(docs, shards, keyed=True, **how).where("taken > 0").select("key", "size", "taken", "shards", "bytes"), "taken")
    total = got.agg(F.sum(F.col("bytes") * F.col("taken") / F.col("size"))).first()[0] or 0
    parts = max(1, math.ceil(total / part_bytes / shards))
    rows = docs.select(_key().alias("key"), F.struct(*docs.columns).alias("row")).dropDuplicates(["key"])  # equal rows are copies of one
    whole, cut = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    got = got.withColumn("whole", whole).withColumn("cut", cut.cast("int")).withColumn("copy", F.explode(F.sequence(F.lit(1), (whole + (cut > 0).cast("int")).cast("int"))))
    copies = got.join(rows, "key")
    body = F.col("row.text").cast("string")
    spaced = F.zip_with(F.split(body, WORD, -1), F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), lambda gap, word: F.concat(gap, F.coalesce(word, F.lit(""))))  # each word after what stands before it
    text = F.when(F.col("copy") <= F.col("whole"), body).otherwise(F.array_join(F.slice(spaced, F.lit(1), F.col("cut")), ""))
    at = F.split("shards", ",")[F.col("copy") - 1].cast("int")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    out = copies.select(at.alias("shard"), F.xxhash64(F.lit("local"), "key", "copy").alias("at"), F.struct(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns)).alias("row"))
    place = F.col("shard") * parts + F.pmod("at", F.lit(parts)).cast("int")  # each local part a task of its own: hashed keys would meet in some
    return out.repartitionById(shards * parts, place).sortWithinPartitions("shard", "at").select("row.*")


def oracle(shards: int = 8) -> str:
    """DuckDB SQL for mix() over documents with the defaults."""
    bits = lambda x: f"CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)"
    d = lambda x: f"CAST({x} AS DOUBLE)"
    small = "[" + ", ".join(f"{x!r}::DOUBLE" for x in _LN_FACTORIALS) + "]"

    def fact(x: str) -> str:
        v = d(f"greatest({x}, 1)")
        return f"(CASE WHEN {x} < 16 THEN {small}[({x})::BIGINT + 1] ELSE {v} * ln({v}) - {v} + 0.5 * ln({2 * math.pi!r}::DOUBLE * {v}) + 1 / (12 * {v}) - 1 / (360 * {v} * {v} * {v}) + 1 / (1260 * {v} * {v} * {v} * {v} * {v}) END)"

    costs = f"list_transform(range(lo, hi + 1), lambda x: {fact('x')} + {fact('(k - x)')} + {fact('(n - x)')} + {fact('(m - k - n + x)')})"

    def level(i: int) -> str:
        mean = "(n * (k / greatest(m, 1)::DOUBLE))"
        sd = f"sqrt(greatest(0.0, {mean} * (1 - k / greatest(m, 1)::DOUBLE) * ((m - n) / greatest(m - 1, 1)::DOUBLE)))"
        return f"""g{i} AS (SELECT node, 0::BIGINT AS i, ((sum(q) + 1) // 2)::BIGINT AS lft, sum(q)::BIGINT AS whole, 0::BIGINT AS x FROM t{i} GROUP BY node UNION ALL
    SELECT node, i, n - x, m - k, x FROM (SELECT *, least(hi, lo + len(list_filter(range(1, len(w) + 1), lambda j: list_sum(w[1:j]) <= u * list_sum(w)))) AS x FROM (
    SELECT *, list_transform(c, lambda y: exp(list_min(c) - y)) AS w FROM (SELECT *, {costs} AS c FROM (
    SELECT *, greatest(0, n + k - m, floor({mean} - 9 * {sd} - 9)::BIGINT)::BIGINT AS lo, least(n, k, ceil({mean} + 9 * {sd} + 9)::BIGINT)::BIGINT AS hi FROM (
    SELECT g.node, t.i, g.lft AS n, g.whole AS m, t.q AS k, ({d(bits(f"'split {i}|' || g.node || '|' || t.skey"))} + 0.5::DOUBLE) / 1152921504606846976.0::DOUBLE AS u FROM g{i} g JOIN t{i} t ON t.node = g.node AND t.i = g.i + 1)))))),
t{i + 1} AS (SELECT 2 * t.node AS node, t.i, t.skey, g.x AS q FROM t{i} t JOIN g{i} g ON t.node = g.node AND t.i = g.i UNION ALL
    SELECT 2 * t.node + 1, t.i, t.skey, t.q - g.x FROM t{i} t JOIN g{i} g ON t.node = g.node AND t.i = g.i)"""

    levels = shards.bit_length() - 1
    return rf"""
WITH RECURSIVE r AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s0 AS (SELECT skey, sum(size)::BIGINT AS source_size, count(*) AS n,
    (CASE (row_number() OVER (ORDER BY skey) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS w FROM r GROUP BY skey),
s1 AS (SELECT *, 2.0::DOUBLE * source_size AS top, 2.0::DOUBLE * source_size / w AS level FROM s0),
s2 AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ()) - coalesce(sum(top) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS rate
    FROM s1 WINDOW b AS (ORDER BY level, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (SELECT skey, source_size, greatest(1, ceil(n / 256.0))::BIGINT AS n_blocks,
    CASE WHEN level <= rate THEN top ELSE (SELECT rate FROM s2 WHERE level > rate ORDER BY level, skey LIMIT 1) * w END AS target FROM s2),
a2 AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target + 0.5)::BIGINT // source_size END AS passes,
    CASE WHEN source_size = 0 THEN floor(target + 0.5)::BIGINT ELSE floor(target + 0.5)::BIGINT % source_size END AS rest FROM aims),
d AS (SELECT r.*, source_size, target, n_blocks, passes, rest, CAST('0x' || substr(key, 1, 15) AS BIGINT) % n_blocks AS block FROM r JOIN a2 USING (skey)),
sums AS (SELECT skey, block, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
placed AS (SELECT skey, block, (sum(words) OVER (PARTITION BY skey ORDER BY block) - words)::BIGINT AS base FROM sums),
t0 AS (SELECT 0 AS node, row_number() OVER (ORDER BY skey) AS i, skey, q FROM (
    SELECT skey, (first(passes * n_blocks) + coalesce(max(block + 1) FILTER (WHERE base < rest), 0))::BIGINT AS q FROM placed JOIN a2 USING (skey) GROUP BY skey)),
{", ".join(map(level, range(levels)))},
ends AS (SELECT skey, list(e ORDER BY node) AS ends FROM (SELECT skey, node, sum(q) OVER (PARTITION BY skey ORDER BY node) AS e FROM t{levels}) GROUP BY skey),
o AS (SELECT d.*, base, ends, (sum(size) OVER (PARTITION BY d.skey, d.block ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS inside
    FROM d JOIN placed p ON d.skey = p.skey AND d.block = p.block JOIN ends ON ends.skey = d.skey),
f AS (SELECT *, greatest(0, least(size, rest - base - inside)) AS part FROM o),
h AS (SELECT *, list_filter(list_transform(range(0, passes + 1), lambda i: {{'shard': len(list_filter(ends, lambda e: e <= i * n_blocks + block)), 'words': CASE WHEN i < passes THEN size ELSE part END}}), lambda s: s.words > 0 AND s.shard < {shards}) AS drawn FROM f)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target, coalesce(list_sum(list_transform(drawn, lambda s: s.words)), 0)::BIGINT AS taken,
    coalesce(array_to_string(list_transform(drawn, lambda s: s.shard), ','), '') AS shards
FROM h"""
