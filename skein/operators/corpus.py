"""The tables of a corpus, and how they derive from documents.

docs(id, slug, title, doc_type, source_dir, tags, content_hash, created_at, updated_at, synced_at, deleted_at, body)
aliases(doc_id, alias, alias_key)   chunks(id, doc_id, chunk_index, heading_path, text, embedding)
links(src_doc_id, dst_slug, dst_doc_id, edge_type, anchor_text)   postings(word, chunk_id, attr, pos)   words(word, n)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein import settings as S
from skein.functions import text as T

TITLE, HEADING, BODY = 0, 1, 2


@dataclass
class Corpus:
    docs: DataFrame
    aliases: DataFrame
    chunks: DataFrame
    links: DataFrame
    postings: DataFrame
    #: Vocabulary of live chunks, and how many searchable chunks hold each word; made from the other tables where it isn't stored.
    words: DataFrame | None = None
    #: Chunks with slug, title, source_dir and deleted_at of their documents, where these are at hand: no join has to find them, and postings
    #: are made of them as they are read.
    texts: DataFrame | None = None

    @property
    def live(self) -> DataFrame:
        return self.docs.where("deleted_at is null")

    @property
    def searchable(self) -> DataFrame:
        """Live documents outside excluded directories."""
        return self.live.where(is_open())


def is_open() -> Column:
    """Whether a document's directory is searched."""
    return ~F.col("source_dir").isin(*S.EXCLUDED_DIRS)


def postings(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row for each word of title, heading path and text of each chunk; positions start at 0 in each."""
    return posted(chunks.join(docs.select(F.col("id").alias("doc_id"), "title"), "doc_id"))


def posted(rows: DataFrame) -> DataFrame:
    """Postings of chunks with their titles: made as the rows are read, nothing is shuffled."""
    parts = F.array(*(F.struct(F.lit(a).alias("attr"), T.tokenize(c).alias("words")) for a, c in ((TITLE, "title"), (HEADING, "heading_path"), (BODY, "text"))))
    found = rows.select(F.col("id").alias("chunk_id"), F.explode(parts).alias("p"))
    return found.select("chunk_id", F.col("p.attr").alias("attr"), F.posexplode("p.words").alias("pos", "word")).select("word", "chunk_id", "attr", F.col("pos").cast("long").alias("pos"))


def alias_rows(docs: DataFrame) -> DataFrame:
    """One row for each alias of a document, the first spelling of those that differ in case only."""
    rows = docs.select(F.col("id").alias("doc_id"), F.posexplode("aliases").alias("at", "alias"))
    rows = rows.withColumn("alias_key", T.ascii_lower("alias"))
    return rows.groupBy("doc_id", "alias_key").agg(F.min_by("alias", "at").alias("alias")).select("doc_id", "alias", "alias_key")


def doc_by_slug(c: Corpus, slug: str) -> DataFrame:
    return c.live.where(F.col("slug") == slug)


def resolve_docs(c: Corpus, names: DataFrame) -> DataFrame:
    """(name, id) of names (name): by slug, else title, else alias; the least id of several."""
    live = c.live
    key = T.ascii_lower("name")
    found = [
        names.join(live.select("slug", "id"), names["name"] == F.col("slug")).select("name", F.lit(1).alias("step"), "id"),
        names.join(live.select(T.ascii_lower("title").alias("k"), "id"), key == F.col("k")).select("name", F.lit(2).alias("step"), "id"),
        names.join(c.aliases.join(live.select(F.col("id").alias("doc_id")), "doc_id").select("alias_key", F.col("doc_id").alias("id")), key == F.col("alias_key")).select("name", F.lit(3).alias("step"), "id"),
    ]
    union = found[0].unionByName(found[1]).unionByName(found[2])
    return union.groupBy("name").agg(F.min(F.struct("step", "id")).alias("first")).select("name", F.col("first.id").alias("id"))


def like_keys(targets: DataFrame) -> DataFrame:
    """targets (base, with _ or %) with like_key and pattern: equal keys are necessary for a tail to be like base."""
    first, last = F.regexp_extract("base", "^[^_%]{3}", 0), F.regexp_extract("base", "[^_%]{3}$", 0)
    size = F.when(F.contains("base", F.lit("%")), F.lit("")).otherwise(F.length("base").cast("string"))
    return targets.withColumn("like_key", F.concat_ws("/", size, F.lower(first), F.lower(last))).withColumn("pattern", F.replace("base", F.lit("\\"), F.lit("\\\\")))


def tails(docs: DataFrame) -> DataFrame:
    """(id, tail, like_key): what of docs' slugs stands after each slash, with each key that a basename like it could have."""
    rows = docs.withColumn("at", F.explode(F.filter(F.sequence(F.lit(1), F.length("slug")), lambda i: F.substring(F.col("slug"), i, F.lit(1)) == "/")))
    rows = rows.select("id", F.lower(F.substring(F.col("slug"), F.col("at") + 1, F.length("slug"))).alias("tail"))
    sizes, firsts, lasts = F.array(F.lit(""), F.length("tail").cast("string")), F.array(F.lit(""), F.substring("tail", 1, 3)), F.array(F.lit(""), F.substring("tail", -3, 3))
    for name, values in (("n", sizes), ("f", firsts), ("l", lasts)):
        rows = rows.withColumn(name, F.explode(values))
    return rows.select("id", "tail", F.concat_ws("/", "n", "f", "l").alias("like_key"))


def resolve_targets(c: Corpus, slugs: DataFrame) -> DataFrame:
    """(dst_slug, id) of link targets (dst_slug): the first step that exactly one live document meets.

    Steps: slug; slug/index; title = basename; alias = basename; slug = basename or ends in /basename. The last one is an
    equi-join on slugs' basenames, and for basenames with wildcards of LIKE on what of their ends, and of their length, holds no wildcard.
    """
    live = c.live.select("id", "slug", "title")
    t = slugs.select("dst_slug").distinct().withColumn("base", F.element_at(F.split("dst_slug", "/"), -1))
    keyed = t.withColumn("key", T.ascii_lower("base"))
    names = c.aliases.join(live.select(F.col("id").alias("doc_id")), "doc_id").select("alias_key", F.col("doc_id").alias("id"))
    wild = F.col("base").rlike("[_%]")
    ends = live.select("id", T.ascii_lower(F.element_at(F.split("slug", "/"), -1)).alias("end"), F.col("slug").alias("full"))
    same = (F.col("full") == F.col("base")) | F.col("full").contains("/")
    steps = [
        t.join(live, F.col("dst_slug") == F.col("slug")),
        t.join(live, F.concat("dst_slug", F.lit("/index")) == F.col("slug")),
        keyed.join(live.withColumn("k", T.ascii_lower("title")), F.col("key") == F.col("k")),
        keyed.join(names, F.col("key") == F.col("alias_key")),
        keyed.where(~wild).join(ends, (F.col("key") == F.col("end")) & same),
        t.where(wild).join(live, F.col("slug") == F.col("base")),
        like_keys(t.where(wild)).join(tails(live), "like_key").where(F.ilike("tail", "pattern")),
    ]
    rows = [s.select("dst_slug", F.lit(min(i, 4)).alias("step"), "id").distinct() for i, s in enumerate(steps)]
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r)
    one = union.groupBy("dst_slug", "step").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    return one.groupBy("dst_slug").agg(F.min(F.struct("step", "id")).alias("first")).select("dst_slug", F.col("first.id").alias("id"))


def resolve_dangling(c: Corpus) -> DataFrame:
    """links, with targets found for those that had none; others stay as they are."""
    open_ = c.links.where("dst_doc_id is null").select("dst_slug")
    found = resolve_targets(c, open_).withColumnRenamed("id", "found")
    return c.links.join(found, "dst_slug", "left").withColumn("dst_doc_id", F.coalesce("dst_doc_id", "found")).select(*c.links.columns)


def unique_links(rows: DataFrame, order: Column) -> DataFrame:
    """The first of links equal in source, target and type."""
    line = Window.partitionBy("src_doc_id", "dst_slug", "edge_type").orderBy(order)
    return rows.withColumn("_k", F.row_number().over(line)).where("_k = 1").drop("_k")


def rename_targets(links: DataFrame, docs: DataFrame, moves: DataFrame) -> DataFrame:
    """Links to old slugs of moves (old, new) lead to the new ones, unless the source has such a link already."""
    live = docs.where("deleted_at is null").select(F.col("slug").alias("new"), F.col("id").alias("new_id"))
    moved = links.join(moves.join(live, "new", "left"), links["dst_slug"] == moves["old"], "left")
    there = links.select("src_doc_id", F.col("dst_slug").alias("new"), "edge_type").withColumn("there", F.lit(True))
    moved = moved.join(there, ["src_doc_id", "new", "edge_type"], "left")
    go = F.col("new").isNotNull() & F.col("there").isNull()
    return moved.select("src_doc_id", F.when(go, F.col("new")).otherwise(F.col("dst_slug")).alias("dst_slug"), F.when(go, F.col("new_id")).otherwise(F.col("dst_doc_id")).alias("dst_doc_id"), "edge_type", "anchor_text")


#: Buckets that rows are numbered in.
BUCKETS = 1 << 16


def numbered(df: DataFrame, key: str, out: str, *then: str) -> DataFrame:
    """Adds ``out``: 1, 2, 3, ... in order of the MD5 of ``key`` (then of other columns). Rows are dealt into BUCKETS by that
    hash: only the buckets' counts meet in one place."""
    rows = df.withColumn("_md5", F.md5(F.col(key))).withColumn("_b", F.conv(F.substring("_md5", 1, 4), 16, 10).cast("int"))
    counts = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    base = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_base"))  # BUCKETS rows at most
    at = F.row_number().over(Window.partitionBy("_b").orderBy("_md5", *then))
    return rows.withColumn("_at", at).join(F.broadcast(base), "_b").withColumn(out, F.col("_base") + F.col("_at")).drop("_md5", "_b", "_at", "_base")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """docs by slug: new fields over old ones under the same id; slugs that are new take ids after the greatest, in order of
    their MD5; a slug that
    comes back is live again. created_at of old stays where the new one has none."""
    columns = [c for c in old.columns if c not in ("id", "slug")]
    o = old.select("slug", "id", F.lit(True).alias("_old"), *(F.col(c).alias(f"_o_{c}") for c in columns))
    n = new.select("slug", F.lit(True).alias("_new"), *(F.col(c).alias(f"_n_{c}") if c in new.columns else F.lit(None).alias(f"_n_{c}") for c in columns))
    both = o.join(n, "slug", "full_outer")
    keep = lambda c: F.coalesce(f"_n_{c}", f"_o_{c}") if c == "created_at" else F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}"))
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    fresh = numbered(both.where("_old is null").select("slug"), "slug", "_k")
    ids = fresh.join(F.broadcast(top)).select("slug", (F.col("_top") + F.col("_k")).alias("_id"))
    out = both.join(ids, "slug", "left")
    return out.select(F.coalesce("id", "_id").cast("long").alias("id"), "slug", *(keep(c).alias(c) for c in columns))


def soft_delete(docs: DataFrame, live_slugs: DataFrame, now: str) -> DataFrame:
    """Live documents whose slug isn't among live_slugs (slug), marked as deleted at ``now``."""
    seen = live_slugs.select("slug").distinct().withColumn("_seen", F.lit(True))
    gone = F.col("deleted_at").isNull() & F.col("_seen").isNull()
    return docs.join(seen, "slug", "left").withColumn("deleted_at", F.when(gone, now).otherwise(F.col("deleted_at"))).select(*docs.columns)


def first_chunks(c: Corpus, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, chunk_id, heading_path, text) of the first chunk of each document, or of each one of docs (doc_id)."""
    first = F.min(F.struct("chunk_index", F.col("id").alias("chunk_id"), "heading_path", "text")).alias("f")
    chunks = c.chunks if docs is None else c.chunks.join(docs, "doc_id", "left_semi")
    return chunks.groupBy("doc_id").agg(first).select("doc_id", "f.chunk_id", "f.heading_path", "f.text")


def live_chunks(c: Corpus) -> DataFrame:
    if c.texts is not None:
        return c.texts.where("deleted_at is null")
    return c.chunks.join(c.live.select(F.col("id").alias("doc_id"), "slug", "source_dir"), "doc_id")


def word_index(c: Corpus) -> DataFrame:
    """(word, n): words of live chunks, those in excluded directories too, and in how many chunks outside of these each occurs.

    A chunk gives each of its words once, and a task adds them up before they are shuffled: what is moved is a task's vocabulary, not
    its postings.
    """
    rows = c.texts if c.texts is not None else c.chunks.join(c.docs.select(F.col("id").alias("doc_id"), "title", "source_dir", "deleted_at"), "doc_id")
    words = F.array_distinct(F.concat(*(T.tokenize(x) for x in ("title", "heading_path", "text"))))
    return rows.where("deleted_at is null").select(F.explode(words).alias("word"), is_open().alias("open")).groupBy("word").agg(F.count_if("open").alias("n"))


def vocabulary(c: Corpus) -> DataFrame:
    """(word, n) as word_index gives it, stored or made."""
    return c.words if c.words is not None else word_index(c)


def search_postings(c: Corpus) -> DataFrame:
    """Postings of live chunks outside excluded directories."""
    if c.texts is not None:
        return posted(c.texts.where(F.col("deleted_at").isNull() & is_open()))
    ids = c.chunks.join(c.searchable.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(F.col("id").alias("chunk_id"))
    return c.postings.join(ids, "chunk_id", "left_semi").select("word", "chunk_id", "attr", "pos")


def word_chunks(postings: DataFrame) -> DataFrame:
    """(word, n): chunks that hold each word."""
    return postings.groupBy("word").agg(F.count_distinct("chunk_id").alias("n"))


def in_degree(links: DataFrame) -> DataFrame:
    """(doc_id, typed, mentions): links to each document, its own aside."""
    rows = links.where("dst_doc_id is not null and src_doc_id <> dst_doc_id")
    mention = F.col("edge_type") == "mentions"
    return rows.groupBy(F.col("dst_doc_id").alias("doc_id")).agg(F.count_if(~mention).alias("typed"), F.count_if(mention).alias("mentions"))


def dangling(c: Corpus, ids: DataFrame) -> DataFrame:
    """(slug, dst_slug) of links without a document, from documents ids (id)."""
    return c.links.where("dst_doc_id is null").join(c.docs.join(ids, "id", "left_semi").select(F.col("id").alias("src_doc_id"), "slug"), "src_doc_id").select("slug", "dst_slug")


def case_collisions(docs: DataFrame) -> DataFrame:
    """Slugs that differ in case only, joined."""
    groups = docs.groupBy(F.lower("slug").alias("key")).agg(F.array_sort(F.collect_list("slug")).alias("s"))
    return groups.where("size(s) > 1").select(F.array_join("s", " / ").alias("slugs"))


def stats(c: Corpus) -> DataFrame:
    """One row of counts."""
    one = [
        c.docs.agg(F.count_if(F.col("deleted_at").isNull()).alias("docs"), F.count_if(F.col("deleted_at").isNotNull()).alias("deleted_docs")),
        live_chunks(c).agg(F.count("*").alias("chunks")),
        c.postings.agg(F.count_distinct("word").alias("indexed_words")),
        c.links.agg(F.count("*").alias("links"), F.count_if(F.col("dst_doc_id").isNull()).alias("dangling_links")),
    ]
    out = one[0]
    for o in one[1:]:
        out = out.join(F.broadcast(o))  # single rows
    return out


def links_by_type(links: DataFrame) -> DataFrame:
    return links.groupBy("edge_type").agg(F.count("*").alias("n"))


def docs_by_source(c: Corpus) -> DataFrame:
    return c.live.groupBy("source_dir").agg(F.count("*").alias("n"))
