"""Document fingerprints of closed syncmers, with DataFrame functions only.

A text is read as tokens: runs of characters other than white space, and in runs of more than 16 characters (text without
spaces) each character, so that where a token ends depends on the text around it alone. A window of K tokens is an anchor
if the least hash among its runs of S tokens is that of its first or of its last run: this depends on the window alone,
so that an edit moves no anchor that it doesn't touch. The fingerprint is the anchors' 32-bit hashes in order of position,
in hexadecimal; texts of 1 to K-1 tokens have one anchor, all of them, and texts without tokens the empty fingerprint.
Some texts of K to 2K-S-2 tokens have no such window: their anchor is the window of least hash.
Likeness is the share of distinct anchors that two fingerprints have in common, 2 |A & B| / (|A| + |B|), and 1 for two
empty ones.

Cases: null text is empty text; equal rows are separate documents with equal fingerprints; documents without a doc_id come
last in descending order; equal doc_ids are ordered by a hash of the text; a single document is its own next one; an empty
table yields no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens in a window and in its inner runs.
K, S = 10, 2
#: Bytes of text in a bucket of consecutive documents, about, and buckets at most.
BUCKET_BYTES, BUCKETS = 1 << 20, 1 << 16
CUTS, NULLS = 32, 256
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,16}(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being computed once (a lambda's argument is; a plain expression inside a lambda isn't)."""
    return F.transform(F.array(value), body)[0]


def anchors(text: Column) -> Column:
    """Hashes of the anchors of text, in order of position: array<long>, 32 bits each."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    t = K - S + 1
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))

    def of(h: Column) -> Column:
        n = F.size(h)
        runs = F.transform(F.sequence(F.lit(0), n - S), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(S))))

        def chosen(s: Column) -> Column:
            edge = lambda i: F.array_min(F.slice(s, i + 1, t)).isin(F.get(s, i), F.get(s, i + t - 1))
            every = F.sequence(F.lit(0), n - K)
            hashes = lambda at: F.transform(at, lambda i: low(F.xxhash64(F.slice(h, i + 1, K))))
            return let(F.filter(every, edge), lambda at: F.when(F.size(at) > 0, hashes(at)).otherwise(F.array(F.array_min(hashes(every)))))

        return F.when(n >= K, let(runs, chosen)).when(n > 0, F.array(low(F.xxhash64(h)))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), of)


def fingerprint(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def with_next(docs: DataFrame, nexts: dict[str, str], add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id and text of docs, what ``add`` adds, and columns of the next document in descending order of doc_id (after
    the last: of the first); nexts: new name to column.

    Documents are dealt into buckets of consecutive doc_ids: cut points at quantiles, evenly spaced in between. Each bucket
    also gets a copy of the first document of the next one, so that the text is shuffled once and no window spans more.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    at = [i / CUTS for i in range(CUTS + 1)]
    seen = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.percentile_approx("doc_id", at, 10_000).alias("cuts"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    each = max(1, min((seen["bytes"] or 0) // BUCKET_BYTES, BUCKETS) // CUTS + 1)
    cuts = sorted({seen["low"], *(seen["cuts"] or []), seen["high"]} - {None}) or [0]
    step = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("doc_id")))  # 1 to len(cuts)
    low, high = (F.element_at(F.array(*map(F.lit, cuts)), k) for k in (step, F.least(step + 1, F.lit(len(cuts)))))
    inner = F.floor((F.col("doc_id") - low).cast("double") / F.greatest(high - low, F.lit(1)).cast("double") * each)
    hashed = F.xxhash64("text")
    null_bucket = -1 - F.shiftright(hashed.bitwiseXOR(F.lit(-(1 << 63))), 64 - NULLS.bit_length() + 1).bitwiseAND(F.lit(NULLS - 1))  # hashes ascend as buckets descend
    bucket = F.when(F.col("doc_id").isNull(), null_bucket).otherwise(step * each + F.least(inner, F.lit(each - 1))).cast("long")
    rows = rows.withColumn("bucket", bucket)
    firsts = rows.groupBy("bucket").agg(F.max("doc_id").alias("first_id"), F.min(F.when(F.col("doc_id").isNull(), hashed)).alias("first_hash"))  # a row for each bucket
    order = Window.orderBy(F.col("bucket").desc())
    above = F.coalesce(F.lag("bucket").over(order), F.min("bucket").over(Window.partitionBy()))
    guests = F.broadcast(firsts.select("first_id", "first_hash", above.alias("host")))  # 2 BUCKETS + NULLS rows of three numbers at most
    first = rows["doc_id"].eqNullSafe(guests["first_id"]) & F.when(rows["doc_id"].isNull(), hashed).eqNullSafe(guests["first_hash"])
    copies = rows.join(guests, first).select("doc_id", "text", F.col("host").alias("bucket"), F.lit(1).alias("guest"))
    dealt = rows.select("doc_id", "text", "bucket", F.lit(0).alias("guest")).unionByName(copies)
    dealt = add(dealt.repartition("bucket"))
    line = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    return dealt.withColumns({new: F.lead(old).over(line) for new, old in nexts.items()}).where("guest = 0").drop("bucket", "guest")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents and of their edited texts: the last half replaced by the first half of the next one."""
    rows = with_next(docs, {"next_text": "text", "next_anchors": "anchors"}, lambda d: d.withColumn("anchors", anchors(F.col("text"))))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.withColumn("edited_anchors", anchors(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("anchors")).alias("fingerprint"), fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"), likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )
