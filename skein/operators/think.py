"""Synthesis: facts from a search, and what isn't known."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein import settings as S
from skein.functions import text as T
from skein.operators import corpus as C
from skein.operators.corpus import Corpus

STALE, UNKNOWN, DANGLING, LOW = "stale_doc", "unknown_entity", "dangling_link", "low_confidence"


def facts(hits: DataFrame) -> DataFrame:
    """rank, slug, title, heading_path, lead (two sentences), evidence, updated_at."""
    return hits.select("rank", "slug", "title", "heading_path", T.lead_sentences("snippet", 2).alias("lead"), "evidence", "updated_at")


def stale(found: DataFrame, as_of: str) -> DataFrame:
    """Facts whose document is older than STALE_DAYS, once each: slug, message."""
    when = T.when_updated("updated_at")
    days = F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(when)) / 86400)
    message = F.concat(F.lit('No updates on "'), "title", F.lit('" ('), "slug", F.lit(") since "), F.date_format(when, "yyyy-MM-dd"), F.lit(" ("), F.floor(days / 7).cast("string"), F.lit(" weeks ago) — verify before relying on it."))
    rows = found.where(days > S.STALE_DAYS)
    return rows.select(F.col("rank"), "slug", message.alias("message")).groupBy("slug").agg(F.min_by("message", "rank").alias("message"))


def unknown(c: Corpus, query: str) -> DataFrame:
    """Capitalised runs of two words or more that name no document, and don't open a sentence; MAX_UNKNOWN at most: at, span, message."""
    spans = c.docs.sparkSession.range(1).select(F.posexplode(T.titlecase_spans(F.lit(query))).alias("at", "name"))
    words = F.split("name", " ")
    spans = spans.where((F.size(words) >= 2) & ~words[0].isin(*S.SENTENCE_LEADERS))
    missing = spans.join(C.resolve_docs(c, spans.select("name").distinct()), "name", "left_anti")
    return missing.orderBy("at").limit(S.MAX_UNKNOWN).select("at", F.col("name").alias("span"), F.concat(F.lit('No doc exists for "'), "name", F.lit('".')).alias("message"))


def dangling(c: Corpus, found: DataFrame) -> DataFrame:
    ids = c.live.join(found.select("slug").distinct(), "slug", "left_semi").select("id")
    rows = C.dangling(c, ids)
    return rows.select("slug", "dst_slug", F.concat(F.lit('"'), "slug", F.lit('" references missing doc "'), "dst_slug", F.lit('" — a hole to fill.')).alias("message"))


def low_confidence(found: DataFrame) -> DataFrame:
    """One row if no fact rests on more than likeness or neighbourhood."""
    weak = F.coalesce(F.bool_and(F.col("evidence").isin("weak_semantic", "graph_adjacent")), F.lit(True))
    return found.agg(weak.alias("weak")).where("weak").select(F.lit("Little direct information is available about this query.").alias("message"))


def gaps(c: Corpus, found: DataFrame, query: str, as_of: str) -> DataFrame:
    """(kind, message) of all gaps, in order of kind."""
    parts = [(STALE, stale(found, as_of), "slug"), (UNKNOWN, unknown(c, query), "at"), (DANGLING, dangling(c, found), "message"), (LOW, low_confidence(found), "message")]
    rows = [g.select(F.lit(i).alias("i"), F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy(by)).alias("k"), "message") for i, (kind, g, by) in enumerate(parts)]
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r)
    return union.orderBy("i", "k").select("kind", "message")
