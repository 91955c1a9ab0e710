"""Incremental maintenance: what changed between two snapshots of a vault, renames, checks of front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import markdown as M
from skein.functions import text as T
from skein.operators import corpus as C


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(slug, state) of live documents old and files new (slug, content_hash): unchanged, updated, added or deleted."""
    both = old.select("slug", F.col("content_hash").alias("o")).join(new.select("slug", F.col("content_hash").alias("n")), "slug", "full_outer")
    state = F.when(F.col("n").isNull(), "deleted").when(F.col("o").isNull(), "added").when(F.col("o") == F.col("n"), "unchanged").otherwise("updated")
    return both.select("slug", state.alias("state"))


def renames(deleted: DataFrame, added: DataFrame) -> DataFrame:
    """(old, new): a content that exactly one deleted and one added document (slug, content_hash) have."""
    one = lambda df, name: df.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("slug").alias(name)).where("n = 1").drop("n")
    return one(deleted, "old").join(one(added, "new"), "content_hash").select("old", "new")


def parse(files: DataFrame) -> DataFrame:
    """Files (slug, content, modified) with the fields of their front matter; error where it can't be read."""
    rows = files.withColumn("fm", M.front_matter_column(F.col("content")))
    return rows.select(
        "slug", T.source_dir("slug").alias("source_dir"), F.sha2("content", 256).alias("content_hash"),
        F.coalesce("fm.title", T.title_from_slug("slug")).alias("title"), F.coalesce("fm.type", F.lit("note")).alias("doc_type"),
        F.col("fm.tags").alias("tags"), F.col("fm.aliases").alias("aliases"), F.col("fm.created").alias("created_at"),
        F.coalesce("fm.updated", "modified").alias("updated_at"), F.col("fm.body").alias("body"), F.col("fm.error").alias("error"),
    )


def capture_name(title: Column, now: Column) -> tuple[Column, Column]:
    """The title of a captured note, in one line, and its slug."""
    sane = T.sanitize_title(title)
    return sane, F.concat(F.lit("inbox/"), F.date_format(now, "yyyy-MM-dd-HHmmss"), F.lit("-"), T.slugify(sane))


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, heading_path, text) of docs (id, title, body); a body without text is one chunk, the title."""
    rows = docs.withColumn("c", M.chunks_column(F.col("body")))
    whole = F.array(F.struct(F.lit("").alias("heading_path"), F.col("title").alias("text")))
    rows = rows.withColumn("c", F.when(F.size("c") == 0, whole).otherwise(F.col("c")))
    return rows.select(F.col("id").alias("doc_id"), F.posexplode("c").alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.heading_path", "c.text")


def links(docs: DataFrame) -> DataFrame:
    """(src_doc_id, dst_slug, dst_doc_id, edge_type, anchor_text) of docs (id, slug, body), not resolved."""
    directory = F.regexp_replace("slug", "/?[^/]*$", "")
    rows = docs.select("id", F.posexplode(M.links_column(F.col("body"), directory)).alias("at", "l"))
    rows = rows.select(F.col("id").alias("src_doc_id"), "l.dst_slug", F.lit(None).cast("long").alias("dst_doc_id"), "l.edge_type", "l.anchor_text", "at")
    return C.unique_links(rows, F.col("at")).drop("at")


def validate(files: DataFrame, since: str | None = None) -> DataFrame:
    """(path, message) of files (slug, content, modified) outside inbox, modified at ``since`` or later; message is null if valid."""
    rows = files.where(~F.col("slug").rlike("^inbox(/|$)"))
    if since:
        rows = rows.where(F.coalesce(T.when_updated("modified") >= F.lit(since).cast("timestamp"), F.lit(False)))
    rows = rows.withColumn("fm", M.front_matter_column(F.col("content")))
    issue = F.when(F.col("content").isNull(), F.lit("cannot read file")).when(F.col("fm.error").isNotNull(), F.concat(F.lit("malformed frontmatter: "), "fm.error")).otherwise(T.front_matter_issue(F.col("fm.title"), F.col("fm.description"), F.col("fm.type")))
    return rows.select(F.concat("slug", F.lit(".md")).alias("path"), issue.alias("message"))
