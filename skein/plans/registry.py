"""Queries by name, and the SQL that gives the same rows.

Each query applies one operator to whole test tables (see adapters). Those without SQL parse markdown or hash bytes; tests
hold them against examples.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from skein import settings as S
from skein.functions import embedding as E
from skein.functions import markdown as M
from skein.functions import text as T
from skein.operators import corpus as C
from skein.operators import search as R
from skein.operators import sync, think
from skein.plans import adapters as A
from skein.plans.adapters import AS_OF, QUERY, QUESTION, TITLE_SQL, TOKENS, sql, table
from skein.sources import vault

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its name; whole numbers come out as long."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({x.name: F.col(x.name).cast("long") for x in df.schema if isinstance(x.dataType, IntegerType)})

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _of(name: str):
    return lambda spark, d: table(spark, d, name)


documents, pages, conversations, customer = _of("documents"), _of("pages"), _of("conversations"), _of("customer")
#: Markdown made of the star schema, as text in both languages.
SENTENCE = "concat('# ', c_mktsegment, chr(10), c_name, CASE c_custkey % 6 WHEN 0 THEN ' works at ' WHEN 1 THEN ' has not invested in ' WHEN 2 THEN ' said no, then founded ' WHEN 3 THEN ' advises ' WHEN 4 THEN ' spoke at ' ELSE ' saw ' END, '[N', c_nationkey, '](../nation/n', c_nationkey, '.md) and ![i](i.png) [[place ', c_nationkey, CASE c_custkey % 2 WHEN 0 THEN '|there' ELSE '' END, ']]', chr(10), '## Sub ', c_custkey, chr(10), '> **Based_In:** in [N', c_nationkey, '](n', c_nationkey, '.md)')"
FRONT = "concat(CASE c_custkey % 4 WHEN 0 THEN '' ELSE concat('---', chr(10), 'title: ', c_name, chr(10), 'type: ', CASE c_custkey % 3 WHEN 0 THEN 'person' ELSE 'thing' END, CASE c_custkey % 5 WHEN 0 THEN concat(chr(10), 'description: d') ELSE '' END, chr(10), '---', chr(10)) END, 'Body ', c_custkey)"


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Dealt out as customers, which are narrow: Python parses notes, and a row group may hold a million."""
    return customer(spark, d).repartition(A.parts(spark), "c_custkey").select(F.col("c_custkey").alias("id"), F.concat(F.lit("people/"), F.col("c_custkey").cast("string")).alias("slug"), F.expr(SENTENCE.replace("c_custkey,", "cast(c_custkey as string),")).alias("body"), F.expr(FRONT).alias("content"), F.col("c_name").alias("title"))


# -- sources


def _vault(spark, d):
    """The notes as files of a folder (this test's own: the scan walks folders of the driver); every tenth one isn't UTF-8."""
    root = tempfile.mkdtemp(prefix="skein-notes-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    os.makedirs(f"{root}/people")
    for r in notes(spark, d).select("id", "content").toLocalIterator():
        with open(f"{root}/people/{r['id']}.md", "wb") as f:
            f.write(r["content"].encode() + (b"\xff" if r["id"] % 10 == 0 else b""))
    return vault.scan(spark, root)


@query(f"SELECT 'people/' || c_custkey AS slug, 'people/' || c_custkey || '.md' AS path, CASE WHEN c_custkey % 10 > 0 THEN strlen({FRONT}) END AS length FROM customer")
def scan_vault(spark, d):
    return _vault(spark, d).select("slug", "path", F.octet_length("content").cast("long").alias("length"))


@query("SELECT doc_id, strlen(text)::BIGINT AS length FROM documents WHERE strlen(text) * 1000 > 5242880")
def scan_oversize(spark, d):
    return vault.oversize(documents(spark, d).select("doc_id", F.octet_length("text").alias("length"), (F.octet_length("text").cast("long") * 1000).alias("scaled")), "scaled").drop("scaled")


@query("SELECT 'people/' || c_custkey AS slug FROM customer WHERE c_custkey % 10 = 0")
def scan_bad_utf8(spark, d):
    return _vault(spark, d).where("content is null and issue is not null").select("slug")


@query(r"SELECT page_id, regexp_replace(translate(url, '\', '/') || CASE page_id % 2 WHEN 0 THEN '.md' ELSE '.MD' END, '(?i)\.md$', '') AS slug FROM pages")
def slug_for(spark, d):
    return pages(spark, d).select("page_id", T.slug_for(F.concat("url", F.when(F.col("page_id") % 2 == 0, ".md").otherwise(".MD"))).alias("slug"))


@query("SELECT CAST(doc_id AS VARCHAR) AS slug, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    files = documents(spark, d).select(F.col("doc_id").cast("string").alias("slug"), F.col("text").alias("content"), F.lit(None).cast("string").alias("modified"))
    return sync.parse(files).select("slug", "content_hash")


_SANE = r"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace({}, '[\x00-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g'), ''), 'Captured note')"
_SLUG = r"coalesce(nullif(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'note')"


@query(f"SELECT conv_id, turn, title, 'inbox/2026-07-01-000000-' || {_SLUG.format('title')} AS slug FROM (SELECT conv_id, turn, {_SANE.format(TITLE_SQL.format('text'))} AS title FROM conversations)")
def capture_row(spark, d):
    title, slug = sync.capture_name(T.derive_title("text"), F.lit(AS_OF).cast("timestamp"))
    return conversations(spark, d).select("conv_id", "turn", title.alias("title"), slug.alias("slug"))


@query("SELECT * FROM (VALUES ('schema_version', '2'), ('embedder_id', 'hash-v1-d512'), ('dim', '512'), ('snapshot', '0')) t(key, value)")
def meta(spark, d):
    """What a new knowledge base stores of itself."""
    from skein.kb import KnowledgeBase

    root = tempfile.mkdtemp(prefix="skein-meta-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    kept = KnowledgeBase.init(spark, root).meta
    return spark.createDataFrame([(k, str(kept[k])) for k in ("schema_version", "embedder_id", "dim", "snapshot")], "key string, value string")


# -- parsing

NOTES = f"notes AS (SELECT c_custkey AS id, {SENTENCE} AS body, {FRONT} AS content, c_name AS title FROM customer)"


@query(rf"WITH {NOTES} SELECT id, nullif(regexp_extract(content, '(?s)^---\n(.*?)\n---\n', 1), '') AS yaml, CASE WHEN starts_with(content, '---' || chr(10)) THEN regexp_extract(content, '(?s)^---\n.*?\n---\n(.*)$', 1) ELSE content END AS body FROM notes")
def frontmatter_split(spark, d):
    split = F.pandas_udf(lambda s: __import__("pandas").DataFrame([M.split_front_matter(x) for x in s], columns=["yaml", "body"]), "yaml string, body string")
    return notes(spark, d).select("id", split("content").alias("f")).select("id", "f.yaml", "f.body")


@query(rf"WITH {NOTES} SELECT id, CASE WHEN id % 4 > 0 THEN title END AS title, CASE WHEN id % 4 > 0 THEN (CASE WHEN id % 3 = 0 THEN 'person' ELSE 'thing' END) END AS type, CASE WHEN id % 4 > 0 AND id % 5 = 0 THEN 'd' END AS description, 0::BIGINT AS n_aliases, 'Body ' || id AS body FROM notes")
def frontmatter_fields(spark, d):
    return notes(spark, d).select("id", M.front_matter_column(F.col("content")).alias("f")).where("f.error is null").select("id", "f.title", "f.type", "f.description", F.size("f.aliases").alias("n_aliases"), "f.body")


@query(rf"WITH {NOTES}, l AS (SELECT id, string_split(body, chr(10)) AS x FROM notes) SELECT id AS doc_id, k::BIGINT AS chunk_index, substr(x[1], 3) || CASE k WHEN 1 THEN ' > ' || substr(x[3], 4) ELSE '' END AS heading_path, x[2 + 2 * k] AS text FROM l, (VALUES (0), (1)) t(k)")
def chunk_docs(spark, d):
    return sync.chunks(notes(spark, d))


@query(rf"WITH {NOTES}, l AS (SELECT id, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10)))))::BIGINT AS place FROM notes) SELECT id, place, strlen(regexp_extract(line, '^(#+)', 1))::BIGINT AS level, trim(regexp_extract(line, '^#+ (.*)$', 1)) AS heading FROM l WHERE regexp_matches(line, '^#{{1,6}} .*\S')")
def headings(spark, d):
    lines = notes(spark, d).select("id", F.posexplode(F.split("body", "\n")).alias("place", "line"))
    return lines.select("id", "place", M.heading_column(F.col("line")).alias("h")).where("h.heading is not null").select("id", "place", "h.level", "h.heading")


@query()
def pack_paragraphs(spark, d):
    return M.pieces(documents(spark, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")))


@query(rf"""WITH {NOTES}, l AS (SELECT c_custkey AS id, c_nationkey AS n FROM customer)
SELECT id AS src_doc_id, 'nation/n' || n AS dst_slug, NULL::BIGINT AS dst_doc_id, CASE id % 6 WHEN 0 THEN 'works_at' WHEN 2 THEN 'founded' WHEN 3 THEN 'advises' WHEN 4 THEN 'attended' ELSE 'mentions' END AS edge_type, 'N' || n AS anchor_text FROM l
UNION ALL SELECT id, 'people/n' || n, NULL, 'based_in', 'N' || n FROM l
UNION ALL SELECT id, 'place ' || n, NULL, 'mentions', CASE id % 2 WHEN 0 THEN 'there' ELSE 'place ' || n END FROM l""")
def extract_links(spark, d):
    return sync.links(notes(spark, d))


@query("SELECT c_custkey AS id, 'based_in' AS edge_type, 'people/n' || c_nationkey AS target FROM customer")
def typed_blockquotes(spark, d):
    return sync.links(notes(spark, d)).where("edge_type = 'based_in'").select(F.col("src_doc_id").alias("id"), "edge_type", F.col("dst_slug").alias("target"))


@query("SELECT c_custkey AS id, 'nation/n' || c_nationkey AS target, 'N' || c_nationkey AS anchor FROM customer")
def md_links(spark, d):
    """The relative link of each note; the image beside it is none."""
    return sync.links(notes(spark, d)).where("edge_type <> 'based_in' and dst_slug not like 'place%'").select(F.col("src_doc_id").alias("id"), F.col("dst_slug").alias("target"), F.col("anchor_text").alias("anchor"))


@query("SELECT c_custkey AS id, 'place ' || c_nationkey AS target, CASE c_custkey % 2 WHEN 0 THEN 'there' ELSE 'place ' || c_nationkey END AS anchor FROM customer")
def wikilinks(spark, d):
    return sync.links(notes(spark, d)).where("dst_slug like 'place%'").select(F.col("src_doc_id").alias("id"), F.col("dst_slug").alias("target"), F.col("anchor_text").alias("anchor"))


@query("SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'works_at' WHEN 2 THEN 'founded' WHEN 3 THEN 'advises' WHEN 4 THEN 'attended' ELSE 'mentions' END AS edge_type FROM customer")
def infer_edges(spark, d):
    return sync.links(notes(spark, d)).where("dst_slug like 'nation/%'").select(F.col("src_doc_id").alias("id"), "edge_type")


@query()
def normalize_slug(spark, d):
    href = F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1)))
    return pages(spark, d).select("page_id", href.alias("href")).select("page_id", "href", M.slug_column(F.lit("a/b"), F.col("href"), True).alias("slug"))


@query(r"SELECT page_id, array_to_string(list_transform(string_split(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[-_]', ' ', 'g'), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS title FROM pages")
def title_from_slug(spark, d):
    return pages(spark, d).select("page_id", T.title_from_slug("url").alias("title"))


@query(sql("SELECT id, slug, title, doc_type, source_dir, content_hash, updated_at FROM docs"))
def docs_table(spark, d):
    return A.docs(spark, d).select("id", "slug", "title", "doc_type", "source_dir", "content_hash", "updated_at")


@query(sql("SELECT word, chunk_id, attr::BIGINT AS attr, pos FROM postings"))
def postings(spark, d):
    return A.corpus(spark, d)[0].postings


@query()
def embed_chunks(spark, d):
    return documents(spark, d).select("doc_id", E.embed_column(F.col("text")).alias("embedding"))


@query(f"SELECT conv_id, turn, {TITLE_SQL.format('text')} AS title FROM conversations")
def derive_title(spark, d):
    return conversations(spark, d).select("conv_id", "turn", T.derive_title("text").alias("title"))


@query(r"SELECT conv_id, turn, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g'), ''), 'Captured note') AS title FROM conversations")
def sanitize_title(spark, d):
    return conversations(spark, d).select("conv_id", "turn", T.sanitize_title("text").alias("title"))


@query(r"SELECT conv_id, turn, coalesce(nullif(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'note') AS slug FROM conversations")
def slugify(spark, d):
    return conversations(spark, d).select("conv_id", "turn", T.slugify("text").alias("slug"))


# -- relations


def _halves(spark, d):
    """Users' states before and after a moment of the event stream: slug, title, content_hash."""
    e = table(spark, d, "events")
    out = []
    for late in (False, True):
        rows = e if late else e.where("event_id % 10 < 7")
        s = rows.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
        s = s.where("user_id % 11 <> 0" if late else "user_id % 13 <> 0")
        out.append(s.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("slug"), F.col("m.event_type").alias("title"), F.md5(F.concat(F.col("m.event_type"), F.col("m.event_id").cast("string"))).alias("content_hash"), F.col("user_id")))
    return out


_STATE = "SELECT 'u' || user_id AS slug, arg_max(event_type, (ts, event_id)) AS title, md5(arg_max(event_type, (ts, event_id)) || max_by(event_id, (ts, event_id))) AS content_hash, user_id FROM events WHERE {} GROUP BY user_id"
HALVES = f"old AS ({_STATE.format('event_id % 10 < 7 AND user_id % 13 <> 0')}), new AS ({_STATE.format('user_id % 11 <> 0')})"


@query(f"WITH {HALVES}, b AS (SELECT o.slug AS o, o.user_id AS oid, o.title AS ot, n.slug AS n, n.title AS nt FROM old o FULL JOIN new n ON o.slug = n.slug), t AS (SELECT max(user_id) AS top FROM old), f AS (SELECT n AS slug, (SELECT top FROM t) + row_number() OVER (ORDER BY md5(n)) AS id FROM b WHERE o IS NULL) SELECT coalesce(b.oid, f.id)::BIGINT AS id, coalesce(o, n) AS slug, coalesce(nt, ot) AS title FROM b LEFT JOIN f ON f.slug = b.n")
def upsert_docs(spark, d):
    old, new = _halves(spark, d)
    return C.upsert(old.select(F.col("user_id").alias("id"), "slug", "title"), new.select("slug", "title"))


@query(sql("SELECT doc_id, alias, lower(alias) AS alias_key FROM aliases"))
def aliases(spark, d):
    return C.alias_rows(A.docs(spark, d))


@query(sql("SELECT id, slug, title FROM live WHERE slug = (SELECT slug FROM docs WHERE id = 23)"))
def doc_by_slug(spark, d):
    c, _ = A.corpus(spark, d)
    slug = c.docs.where("id = 23").first()["slug"]
    return C.doc_by_slug(c, slug).select("id", "slug", "title")


_NAMES = "names AS (SELECT slug AS name FROM docs WHERE id % 9 = 0 UNION SELECT upper(title) FROM docs WHERE id % 9 = 1 AND regexp_matches(title, '^[ -~]*$') UNION SELECT 'Alias ' || id FROM docs WHERE id % 9 = 2)"


def _names(c):
    d = c.docs
    ascii_ = F.col("title").rlike("^[ -~]*$")
    return d.where("id % 9 = 0").select(F.col("slug").alias("name")).unionByName(d.where((F.col("id") % 9 == 1) & ascii_).select(F.upper("title").alias("name"))).unionByName(d.where("id % 9 = 2").select(F.concat(F.lit("Alias "), F.col("id").cast("string")).alias("name"))).distinct()


@query(sql("SELECT name, (min(step * 1000000000::BIGINT + id) % 1000000000)::BIGINT AS id FROM (SELECT name, 1 AS step, id FROM names JOIN live ON slug = name UNION ALL SELECT name, 2, id FROM names JOIN live ON {0} = {1} UNION ALL SELECT name, 3, id FROM names JOIN aliases ON lower(alias) = {0} JOIN live ON id = doc_id) GROUP BY name".format(A.LOW.format("name"), A.LOW.format("title")), _NAMES))
def resolve_doc(spark, d):
    c, _ = A.corpus(spark, d)
    return C.resolve_docs(c, _names(c))


@query(f"WITH {HALVES} SELECT slug, CASE WHEN slug IN (SELECT slug FROM new) THEN NULL ELSE '2026-07-01' END AS deleted_at FROM old")
def soft_delete(spark, d):
    old, new = _halves(spark, d)
    return C.soft_delete(old.select("slug", F.lit(None).cast("string").alias("deleted_at")), new, "2026-07-01")


@query("SELECT conv_id AS doc_id, min(turn)::BIGINT AS chunk_index, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id")
def first_chunk(spark, d):
    c, _ = A.corpus(spark, d)
    c.chunks = conversations(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.col("role").alias("heading_path"), "text")
    return C.first_chunks(c).select("doc_id", (F.col("chunk_id") % 1000).alias("chunk_index"), "text")


@query(sql("SELECT count(*)::BIGINT AS n FROM live"))
def corpus_counts(spark, d):
    return C.live_chunks(A.corpus(spark, d)[0]).agg(F.count("*").alias("n"))


@query(sql("SELECT word FROM vocab"))
def vocabulary(spark, d):
    return C.vocabulary(A.corpus(spark, d)[0]).select("word")


@query(sql("SELECT word, n::BIGINT AS n FROM wdf"))
def word_df(spark, d):
    """Made from the tables, not read from the stored ones."""
    return C.word_index(A.corpus(spark, d)[0]).where("n > 0")


@query(sql("SELECT word, chunk_id, attr::BIGINT AS attr, pos FROM found_in WHERE word = 'the'"))
def word_postings(spark, d):
    return C.search_postings(A.corpus(spark, d)[0]).where("word = 'the'")


_TARGETS = "targets AS (SELECT slug AS t FROM docs WHERE id % 7 = 0 UNION SELECT 'doc-' || id FROM docs WHERE id % 7 = 1 UNION SELECT 'any/' || title FROM docs WHERE id % 7 = 2 AND regexp_matches(title, '^[^/\\\\_%]*$') UNION SELECT 'ALIAS ' || id FROM docs WHERE id % 7 = 3 UNION SELECT 'no/such')"


def _targets(c):
    d = c.docs
    parts = [
        d.where("id % 7 = 0").select(F.col("slug").alias("dst_slug")), d.where("id % 7 = 1").select(F.concat(F.lit("doc-"), F.col("id").cast("string"))),
        d.where((F.col("id") % 7 == 2) & F.col("title").rlike(r"^[^/\\_%]*$")).select(F.concat(F.lit("any/"), "title")), d.where("id % 7 = 3").select(F.concat(F.lit("ALIAS "), F.col("id").cast("string"))),
        d.limit(1).select(F.lit("no/such")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


_RESOLVED = """b AS (SELECT t, regexp_extract(t, '([^/]*)$', 1) AS base FROM targets),
steps AS (SELECT t, 0 AS step, id FROM b JOIN live ON slug = t UNION ALL SELECT t, 1, id FROM b JOIN live ON slug = t || '/index' UNION ALL SELECT t, 2, id FROM b JOIN live ON {low_title} = {low_base}
  UNION ALL SELECT t, 3, id FROM b JOIN aliases ON {low_alias} = {low_base} JOIN live ON id = doc_id UNION ALL SELECT t, 4, id FROM b JOIN live ON slug = base OR ends_with({low_slug}, '/' || {low_base})),
one AS (SELECT t, step, min(id) AS id FROM steps GROUP BY ALL HAVING count(*) = 1)""".format(**{f"low_{c}": A.LOW.format(c) for c in ("title", "base", "alias", "slug")})


@query(sql("SELECT t AS dst_slug, arg_min(id, step)::BIGINT AS id FROM one GROUP BY t", _TARGETS, _RESOLVED))
def resolve_links(spark, d):
    c, _ = A.corpus(spark, d)
    return C.resolve_targets(c, _targets(c))


@query(sql("SELECT src_doc_id, dst_slug, edge_type, (SELECT arg_min(id, step) FROM one WHERE one.t = l.dst_slug)::BIGINT AS dst_doc_id FROM links l", "targets AS (SELECT DISTINCT dst_slug AS t FROM links)", _RESOLVED))
def links_table(spark, d):
    """The links of all documents, resolved anew."""
    c, _ = A.corpus(spark, d)
    c.links = c.links.withColumn("dst_doc_id", F.lit(None).cast("long"))
    return C.resolve_dangling(c).select("src_doc_id", "dst_slug", "edge_type", "dst_doc_id")


@query(sql("SELECT node, other::BIGINT AS other, dst_slug, edge_type FROM both_ways"))
def neighbors(spark, d):
    c, _ = A.corpus(spark, d)
    return R.edges_both_ways(c.links, c.docs).select("node", "other", "dst_slug", "edge_type")


@query(sql("SELECT l.src_doc_id, CASE WHEN go THEN m.new ELSE dst_slug END AS dst_slug, (CASE WHEN go THEN m.new_id ELSE dst_doc_id END)::BIGINT AS dst_doc_id, l.edge_type FROM (SELECT l.*, m.new, m.new_id, m.old IS NOT NULL AND NOT EXISTS (SELECT 1 FROM links x WHERE x.src_doc_id = l.src_doc_id AND x.dst_slug = m.new AND x.edge_type = l.edge_type) AS go FROM links l LEFT JOIN moves m ON dst_slug = m.old) l LEFT JOIN moves m ON l.dst_slug = m.old", "moves AS (SELECT o.slug AS old, n.slug AS new, CASE WHEN n.deleted_at IS NULL THEN n.id END AS new_id FROM docs o JOIN docs n ON n.id = o.id + 1 WHERE o.id % 10 = 1)"))
def rename_links(spark, d):
    c, _ = A.corpus(spark, d)
    moves = c.docs.where("id % 10 = 1").select(F.col("slug").alias("old"), (F.col("id") + 1).alias("id")).join(c.docs.select("id", F.col("slug").alias("new")), "id").select("old", "new")
    return C.rename_targets(c.links, c.docs, moves).select("src_doc_id", "dst_slug", "dst_doc_id", "edge_type")


@query(sql("SELECT doc_id, typed::BIGINT AS typed, mentions::BIGINT AS mentions FROM indeg"))
def in_degree(spark, d):
    return C.in_degree(A.corpus(spark, d)[0].links)


@query(sql("SELECT slug, dst_slug FROM links JOIN docs ON id = src_doc_id WHERE dst_doc_id IS NULL"))
def dangling_links(spark, d):
    """Those of all documents."""
    c, _ = A.corpus(spark, d)
    return C.dangling(c, c.docs.select("id"))


@query(sql("SELECT (SELECT count(*) FROM live)::BIGINT AS docs, (SELECT count(*) FROM docs WHERE deleted_at IS NOT NULL)::BIGINT AS deleted_docs, (SELECT count(*) FROM live)::BIGINT AS chunks, (SELECT count(DISTINCT word) FROM postings)::BIGINT AS indexed_words, (SELECT count(*) FROM links)::BIGINT AS links, (SELECT count(*) FROM links WHERE dst_doc_id IS NULL)::BIGINT AS dangling_links"))
def stats_scalars(spark, d):
    return C.stats(A.corpus(spark, d)[0])


@query(sql("SELECT edge_type, count(*)::BIGINT AS n FROM links GROUP BY edge_type"))
def links_by_type(spark, d):
    return C.links_by_type(A.corpus(spark, d)[0].links)


@query(sql("SELECT source_dir, count(*)::BIGINT AS n FROM live GROUP BY source_dir"))
def docs_by_source(spark, d):
    return C.docs_by_source(A.corpus(spark, d)[0])


# -- text functions


@query(f"SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents".replace("AS tokens", "AS t").replace("SELECT doc_id,", "SELECT doc_id, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id,") + ")")
def tokenize(spark, d):
    return documents(spark, d).select("doc_id", F.array_join(T.tokenize("text"), " ").alias("tokens"))


_WORDS = r"words AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents)"


def _words(spark, d):
    return documents(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).distinct().select(F.lower("w").alias("word")).distinct()


@query(f"WITH {_WORDS} SELECT word, levenshtein(word, 'thereon')::BIGINT AS distance FROM words WHERE levenshtein(word, 'thereon') <= 3")
def levenshtein(spark, d):
    return _words(spark, d).select("word", T.bounded_levenshtein("word", F.lit("thereon"), 3).alias("distance")).where("distance is not null")


@query(f"WITH {_WORDS} SELECT word, (CASE WHEN length(word) <= 4 THEN 0 WHEN length(word) <= 8 THEN 1 ELSE 2 END)::BIGINT AS budget FROM words")
def typo_budget(spark, d):
    return _words(spark, d).select("word", T.allowed_typos("word").alias("budget"))


@query(f"WITH {_WORDS} SELECT word, {A.stem_sql('word')} AS stem FROM words")
def stem(spark, d):
    return _words(spark, d).select("word", T.stem("word").alias("stem"))


@query("SELECT doc_id, (strlen(text) // 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, d):
    return documents(spark, d).select("doc_id", T.token_estimate("text").alias("tokens"))


@query(sql("SELECT qi::BIGINT AS qi, word, cost::BIGINT AS cost, exact FROM deriv"))
def word_derivations(spark, d):
    return R.derivations(R.query_words(spark, QUERY), C.vocabulary(A.corpus(spark, d)[0])).drop("n")


@query(f"SELECT doc_id, {A.snippet_sql('text')} AS snippet FROM documents")
def snippets(spark, d):
    return documents(spark, d).select("doc_id", T.snippet("text").alias("snippet"))


@query(r"SELECT doc_id, regexp_replace(CASE WHEN regexp_matches(text, '(?s)^(?:[^.!?]*[.!?]){2}') THEN regexp_extract(text, '(?s)^((?:[^.!?]*[.!?]){2})', 1) ELSE text END, '^\s+|\s+$', '', 'g') AS lead FROM documents")
def lead_sentences(spark, d):
    return documents(spark, d).select("doc_id", T.lead_sentences("text", 2).alias("lead"))


@query("SELECT o_orderkey, greatest(floor(date_diff('second', CASE o_orderkey % 3 WHEN 0 THEN date_trunc('day', o_orderdate) ELSE o_orderdate + INTERVAL 5 HOUR END, TIMESTAMP '1998-01-01') / 3600) / 24.0::DOUBLE, 0) AS age FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 3 = 2")
def doc_age(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 == 0, day).when(F.col("o_orderkey") % 3 == 1, F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 7 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).otherwise(F.year("o_orderdate").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", T.age_days(text, F.lit("1998-01-01").cast("timestamp")).alias("age"))


@query()
def titlecase_spans(spark, d):
    return conversations(spark, d).select("conv_id", "turn", F.posexplode(T.titlecase_spans("text")).alias("at", "span"))


_B = r"(?:^|[^\p{L}\p{N}_])"
_ASK = "concat(CASE conv_id % 5 WHEN 0 THEN 'who is ' WHEN 1 THEN 'the last week of ' WHEN 2 THEN 'a funding round of ' ELSE '' END, substr(text, 1, 60))"


@query()
def classify_intent(spark, d):
    """Of whole texts."""
    return conversations(spark, d).select("conv_id", "turn", T.classify_intent("text", F.col("turn") == 0).alias("intent"))


@query(f"WITH {_WORDS}, h AS (SELECT word, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(word, ''), lambda c: ascii(c)::UHUGEINT)), lambda h, b: (xor(h::UBIGINT, b::UBIGINT)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM words) SELECT word, (CASE WHEN h >= 9223372036854775808::UHUGEINT THEN h::HUGEINT - 18446744073709551616::HUGEINT ELSE h::HUGEINT END)::BIGINT AS hash FROM h")
def fnv1a(spark, d):
    return _words(spark, d).select("word", E.fnv1a_column(F.col("word")).alias("hash"))


@query(f"WITH {_WORDS}, m AS (SELECT word, '^' || word || '$' AS w FROM words), g AS (SELECT word, substr(w, i::INT, n::INT) AS gram FROM m, (VALUES (3), (4)) t(n), range(1, 400) r(i) WHERE i + n - 1 <= length(w) UNION ALL SELECT word, word FROM words) SELECT word, gram, count(*)::BIGINT AS n FROM g GROUP BY ALL")
def char_ngrams(spark, d):
    return _words(spark, d).select("word", F.explode(E.features_column(F.col("word"))).alias("gram", "n"))


@query(r"SELECT doc_id, (CASE WHEN regexp_matches(text, '[\p{L}\p{N}]') THEN 1.0 ELSE 0.0 END)::DOUBLE AS norm FROM documents")
def embed_norms(spark, d):
    return documents(spark, d).select("doc_id", E.embed_column(F.col("text")).alias("v")).select("doc_id", F.round(F.sqrt(E.dot(F.col("v"), F.col("v"))), 5).alias("norm"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("other"))
    return e.select(F.col("vec_id").alias("a"), "embedding").join(b, "a").select("a", "b", F.round(E.cosine(F.col("embedding"), F.col("other")), 6).alias("sim"))


@query(sql("SELECT id, source_dir, (CASE source_dir WHEN 'concepts' THEN 1.3 WHEN 'chat' THEN 0.6 WHEN 'archive' THEN 0.5 ELSE 1.0 END)::DOUBLE AS factor, (CASE source_dir WHEN 'concepts' THEN 1.3 WHEN 'archive' THEN 0.5 ELSE 1.0 END)::DOUBLE AS temporal FROM docs"))
def tier_factor(spark, d):
    return A.docs(spark, d).select("id", "source_dir", T.tier_factor("source_dir", False).alias("factor"), T.tier_factor("source_dir", True).alias("temporal"))


@query("SELECT array_to_string(list_sort(list(w)), ' / ') AS slugs FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) GROUP BY lower(w) HAVING count(*) > 1")
def case_collisions(spark, d):
    words = documents(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("slug")).distinct()
    return C.case_collisions(words)


_ISSUE = "CASE WHEN {t} = '' OR {d} = '' OR {k} = '' THEN 'missing required field(s): ' || array_to_string(list_filter([CASE WHEN {t} = '' THEN 'title' END, CASE WHEN {d} = '' THEN 'description' END, CASE WHEN {k} = '' THEN 'type' END], lambda x: x IS NOT NULL), ', ') WHEN {k} NOT IN ('note', 'session', 'group', 'person', 'place', 'venue', 'event', 'organization', 'company', 'product', 'contact') THEN 'invalid type ''' || {k} || '''; must be one of: note, session, group, person, place, venue, event, organization, company, product, contact' END"


@query("SELECT c_custkey, " + _ISSUE.format(t="c_name", d="(CASE c_custkey % 2 WHEN 0 THEN 'd' ELSE '' END)", k="(CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'person' ELSE lower(c_mktsegment) END)") + " AS message FROM customer")
def validate_check(spark, d):
    kind = F.when(F.col("c_custkey") % 3 == 0, "  ").when(F.col("c_custkey") % 3 == 1, " person").otherwise(F.lower("c_mktsegment"))
    return customer(spark, d).select("c_custkey", T.front_matter_issue(F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, "d"), kind).alias("message"))


# -- lexical ranking


def _lexical(spark, d):
    return R.lookup(A.corpus(spark, d)[0], QUERY)


@query(sql("SELECT qi::BIGINT AS qi, df FROM weights"))
def query_df(spark, d):
    return _lexical(spark, d)[0].select("qi", "df")


@query(sql("SELECT DISTINCT chunk_id FROM occ"))
def df_gate(spark, d):
    return _lexical(spark, d)[1].select("chunk_id").distinct()


@query(sql("SELECT chunk_id, words_matched, typo_count, best_attr::BIGINT AS best_attr, best_pos::BIGINT AS best_pos, exact_count FROM ranked_stats"))
def lexical_stats(spark, d):
    return R.match_stats(_lexical(spark, d)[1]).select("chunk_id", "words_matched", "typo_count", "best_attr", "best_pos", "exact_count")


@query(sql("SELECT qi::BIGINT AS qi, round(idf, 6) AS idf FROM weights"))
def idf(spark, d):
    return _lexical(spark, d)[0].select("qi", F.round("idf", 6).alias("idf"))


@query(sql("SELECT chunk_id, proximity FROM prox"))
def proximity(spark, d):
    return R.proximity(_lexical(spark, d)[1])


@query(sql("SELECT chunk_id, words_matched, idf_weight, typo_count, proximity::BIGINT AS proximity, best_attr::BIGINT AS best_attr, best_pos::BIGINT AS best_pos, exact_count FROM lex"))
def lexical_topk(spark, d):
    return R.lexical_search(A.corpus(spark, d)[0], QUERY)


# -- vectors, fusion, graph


@query(f"SELECT vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {A.PROBE})), 6) AS sim FROM embeddings WHERE round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {A.PROBE})), 6) > 0 ORDER BY sim DESC, chunk_id LIMIT 40")
def vector_topk(spark, d):
    return R.vector_search(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), A.probe(spark, d))


def _search(spark, d):
    c, vectors = A.corpus(spark, d)
    live = vectors.join(c.live.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return c, R.lexical_search(c, QUERY), R.vector_search(live, A.probe(spark, d))


def _fused(lexical, similar):
    return R.fuse([R.ranked(lexical, [way(n) for way, n in R.RULES], 1.0), R.ranked(similar, [F.desc("sim"), F.col("chunk_id")], 1.1)])


@query(sql("SELECT chunk_id, score FROM fused"))
def rrf_fusion(spark, d):
    _, lexical, similar = _search(spark, d)
    return _fused(lexical, similar)


@query("SELECT label::BIGINT AS doc_id, max(round(embedding[1]::DOUBLE, 6)) AS score FROM embeddings GROUP BY label")
def doc_maxpool(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("label").alias("doc_id"), F.round(F.col("embedding")[0].cast("double"), 6).alias("score"))
    return R.best_of_docs(rows)


@query(sql("SELECT node, other::BIGINT AS other, dst_slug, edge_type FROM capped"))
def hub_cap(spark, d):
    c, _ = A.corpus(spark, d)
    return R.cap_hubs(R.edges_both_ways(c.links, c.docs)).select("node", "other", "dst_slug", "edge_type")


_SEEDS = "seeds AS (SELECT id FROM live WHERE id % 100 = 3)"
_HOPS = ", h1 AS (SELECT DISTINCT other AS id FROM {e} WHERE node IN (SELECT id FROM seeds) AND other IS NOT NULL AND other NOT IN (SELECT id FROM seeds)), h2 AS (SELECT DISTINCT other AS id FROM {e} WHERE node IN (SELECT id FROM h1) AND other IS NOT NULL AND other NOT IN (SELECT id FROM seeds) AND other NOT IN (SELECT id FROM h1)), dist AS (SELECT id, 0 AS dist FROM seeds UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2)"


def _seeded(select: str, edges: str) -> str:
    return f"WITH RECURSIVE {BASE_TRIMMED}, {_SEEDS}{_HOPS.format(e=edges)} {select}"


BASE_TRIMMED = A.BASE.strip()


def _seeds(c):
    return c.live.where("id % 100 = 3").select("id")


@query(_seeded("SELECT id, dist::BIGINT AS dist FROM dist", "capped"))
def bfs_dist(spark, d):
    c, _ = A.corpus(spark, d)
    return R.distances(_seeds(c), R.edges_both_ways(c.links, c.docs), 2)


@query(sql("SELECT node AS id FROM capped WHERE node IN (SELECT id FROM live WHERE id % 10 = 3) AND other IN (SELECT id FROM live WHERE id % 10 = 3) UNION SELECT other FROM capped WHERE node IN (SELECT id FROM live WHERE id % 10 = 3) AND other IN (SELECT id FROM live WHERE id % 10 = 3)"))
def seed_adjacent(spark, d):
    c, _ = A.corpus(spark, d)
    return R.adjacent_seeds(c.live.where("id % 10 = 3").select("id"), R.edges_both_ways(c.links, c.docs))


@query(_seeded("SELECT id AS doc_id, round(0.5::DOUBLE * (SELECT max(1.0::DOUBLE / (1 + id)) FROM seeds) * pow(0.6::DOUBLE, dist - 1), 9) AS score FROM dist JOIN searchable USING (id) WHERE dist > 0 ORDER BY dist, id LIMIT 32", "capped"))
def graph_inject(spark, d):
    c, _ = A.corpus(spark, d)
    seeds = _seeds(c).withColumn("score", 1.0 / (1 + F.col("id")))
    return R.inject(seeds, R.distances(seeds.select("id"), R.edges_both_ways(c.links, c.docs), 2), c).select("doc_id", F.round("score", 9).alias("score"))


def _khop(edges: str) -> str:
    return f"WITH RECURSIVE {BASE_TRIMMED}, ew AS (SELECT * FROM both_ways {edges}), s AS (SELECT id FROM live WHERE id = 3), h1 AS (SELECT DISTINCT other AS id FROM ew WHERE node IN (SELECT id FROM s) AND other IS NOT NULL AND other NOT IN (SELECT id FROM s)), ds AS (SELECT id, 0 AS dist FROM s UNION ALL SELECT id, 1 FROM h1) SELECT src_slug, dst_slug, edge_type, (min(dist) + 1)::BIGINT AS hop FROM ew JOIN ds ON node = id GROUP BY src_slug, dst_slug, edge_type"


@query(_khop(""))
def graph_khop(spark, d):
    c, _ = A.corpus(spark, d)
    return R.traverse(c, c.live.where("id = 3").select("id"), 2)


@query(_khop("WHERE edge_type = 'mentions'"))
def graph_khop_typed(spark, d):
    c, _ = A.corpus(spark, d)
    return R.traverse(c, c.live.where("id = 3").select("id"), 2, "mentions")


@query(sql("SELECT doc_id, round(1 + 0.08::DOUBLE * ln(1 + typed + 0.5::DOUBLE * mentions), 6) AS factor FROM indeg"))
def authority(spark, d):
    return C.in_degree(A.corpus(spark, d)[0].links).select("doc_id", F.round(R.authority(F.col("typed"), F.col("mentions")), 6).alias("factor"))


_AGE = f"(date_diff('hour', updated_at::TIMESTAMP, TIMESTAMP '{AS_OF}') / 24.0::DOUBLE)"


@query(sql(f"SELECT id, round(1 + 0.02::DOUBLE * exp(-{_AGE} / 90), 6) AS base, round(1 + 0.25::DOUBLE * exp(-{_AGE} / 30), 6) AS temporal FROM docs"))
def recency(spark, d):
    age = T.age_days("updated_at", F.lit(AS_OF).cast("timestamp"))
    return A.docs(spark, d).select("id", F.round(R.recency(age, False), 6).alias("base"), F.round(R.recency(age, True), 6).alias("temporal"))


@query(sql("SELECT id, (CASE WHEN id % 5 = 0 AND 'alias ' || id = 'alias 25' THEN 1.6 WHEN contains(lower(title), 'the ') THEN 1.4 ELSE 1 END)::DOUBLE AS boost FROM docs"))
def name_boost(spark, d):
    named = F.exists("aliases", lambda a: F.lower(a) == "alias 25")
    return A.docs(spark, d).select("id", R.name_boost(named, F.lower("title").contains("the ")).alias("boost"))


def _scored(spark, d):
    c, lexical, similar = _search(spark, d)
    lexical, similar = R.small(lexical), R.small(similar)  # STRATEGY_TOP_K rows each
    return c, R.score_candidates(c, R.candidates(c, lexical, similar, "general", 1), QUERY, "general", AS_OF)


@query(sql("SELECT doc_id, evidence FROM scored"))
def evidence(spark, d):
    return _scored(spark, d)[1].select("doc_id", "evidence")


@query(sql("SELECT slug, score FROM scored"))
def dedup_by_slug(spark, d):
    return R.best_by_slug(_scored(spark, d)[1]).select("slug", "score")


@query("WITH c AS (SELECT doc_id, strlen(text) // 4 AS cost FROM documents ORDER BY doc_id LIMIT 200), s AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS rank, sum(cost) OVER (ORDER BY doc_id) AS spent FROM c) SELECT rank::BIGINT AS rank, doc_id FROM s WHERE rank = 1 OR rank < coalesce((SELECT min(rank) FROM s WHERE spent > 16000 AND rank > 1), 1000)")
def token_budget(spark, d):
    return R.within_budget(documents(spark, d), [F.col("doc_id")], T.token_estimate("text"), 16000, 200).select("rank", "doc_id")


def _hits(spark, d):
    c, vectors = A.corpus(spark, d)
    c.chunks = c.chunks.join(vectors.select("id", "embedding"), "id", "left")
    return c, R.search(Corpus_with_vectors(c), QUERY, A.probe(spark, d), "balanced", AS_OF, intent="general")


def Corpus_with_vectors(c):
    """Chunks without a vector are like nothing."""
    c.chunks = c.chunks.withColumn("embedding", F.coalesce("embedding", F.array().cast("array<float>")))
    return c


@query(sql("SELECT rank::BIGINT AS rank, slug, title, lang AS heading_path, snippet, score, evidence, doc_type, source_dir, updated_at FROM hits"))
def hybrid_search(spark, d):
    return _hits(spark, d)[1]


# -- think, sync


@query(sql(r"SELECT rank::BIGINT AS rank, slug, regexp_replace(CASE WHEN regexp_matches(snippet, '(?s)^(?:[^.!?]*[.!?]){2}') THEN regexp_extract(snippet, '(?s)^((?:[^.!?]*[.!?]){2})', 1) ELSE snippet END, '^\s+|\s+$', '', 'g') AS lead, evidence FROM hits"))
def think_facts(spark, d):
    return think.facts(_hits(spark, d)[1]).select("rank", "slug", "lead", "evidence")


def _facts(spark, d):
    c, _ = A.corpus(spark, d)
    return c, c.live.select(F.col("id").alias("rank"), "slug", "title", "updated_at", F.lit("weak_semantic").alias("evidence"))


_DAYS = f"date_diff('day', updated_at::DATE, DATE '{AS_OF[:10]}')"


@query(sql(f"""SELECT slug, 'No updates on "' || title || '" (' || slug || ') since ' || updated_at || ' (' || {_DAYS} // 7 || ' weeks ago) — verify before relying on it.' AS message FROM live WHERE {_DAYS} > 45"""))
def gap_stale(spark, d):
    """Every live document is a fact."""
    return think.stale(_facts(spark, d)[1], AS_OF)


@query("""SELECT * FROM (VALUES (0::BIGINT, 'Acme Corp', 'No doc exists for "Acme Corp".'), (1::BIGINT, 'Zara Quinn', 'No doc exists for "Zara Quinn".')) t(place, span, message)""")
def gap_unknown(spark, d):
    return think.unknown(A.corpus(spark, d)[0], QUESTION).withColumnRenamed("at", "place")


@query(sql("""SELECT slug, dst_slug, '"' || slug || '" references missing doc "' || dst_slug || '" — a hole to fill.' AS message FROM links JOIN live ON id = src_doc_id WHERE dst_doc_id IS NULL"""))
def gap_dangling(spark, d):
    """Every live document is a fact."""
    return think.dangling(*_facts(spark, d))


@query("SELECT 'Little direct information is available about this query.' AS message")
def gap_low_conf(spark, d):
    return think.low_confidence(_facts(spark, d)[1])


@query(f"WITH {HALVES} SELECT coalesce(o.slug, n.slug) AS slug, CASE WHEN n.slug IS NULL THEN 'deleted' WHEN o.slug IS NULL THEN 'added' WHEN o.content_hash = n.content_hash THEN 'unchanged' ELSE 'updated' END AS state FROM old o FULL JOIN new n ON o.slug = n.slug")
def sync_diff(spark, d):
    return sync.diff(*_halves(spark, d))


_MOVED = "WITH o AS (SELECT 'o' || doc_id AS slug, sha256(text) AS h FROM documents WHERE doc_id % 2 = 0), n AS (SELECT 'n' || doc_id AS slug, sha256(text) AS h FROM documents WHERE doc_id % 2 = 1)"


@query(f"{_MOVED} SELECT o.slug AS old, n.slug AS new FROM (SELECT h, min(slug) AS slug FROM o GROUP BY h HAVING count(*) = 1) o JOIN (SELECT h, min(slug) AS slug FROM n GROUP BY h HAVING count(*) = 1) n USING (h)")
def rename_detect(spark, d):
    side = lambda k, name: documents(spark, d).where(F.col("doc_id") % 2 == k).select(F.concat(F.lit(name), F.col("doc_id").cast("string")).alias("slug"), F.sha2("text", 256).alias("content_hash"))
    return sync.renames(side(0, "o"), side(1, "n"))


@query("SELECT 'people/' || c_custkey || '.md' AS path, " + _ISSUE.format(t="(CASE c_custkey % 4 WHEN 0 THEN '' ELSE c_name END)", d="(CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 5 = 0 THEN 'd' ELSE '' END)", k="(CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN 'person' ELSE 'thing' END)") + " AS message FROM customer")
def validate_docs(spark, d):
    return sync.validate(notes(spark, d).select("slug", "content", F.lit("2026-06-01T00:00:00+00:00").alias("modified")), "2026-01-01T00:00:00Z")
