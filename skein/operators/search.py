"""Hybrid search: lexical ranking by rules, cosine top-k, rank fusion, graph augmentation, priors, evidence, budget.

Every stage takes and returns DataFrames, and each ``limit`` has a total order. Query words, and all that follows fusion,
are a few dozen rows by the settings' limits.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein import settings as S
from skein.functions import embedding as E
from skein.functions import text as T
from skein.operators import corpus as C
from skein.operators.corpus import Corpus

#: Edges as a table, or as what gives those at some nodes (node).
Edges = DataFrame | Callable[[DataFrame], DataFrame]
#: Derived words that are held as a local table; more of them stay distributed. Words that a scan is told by name.
LOOKUP, NAMED = 4096, 10


def small(df: DataFrame) -> DataFrame:
    """df computed and held as a local table, for results that a setting bounds to a few dozen rows and that several stages
    use: plans stay short, and nothing is computed twice."""
    return df.sparkSession.createDataFrame(df.toArrow())


def among(df: DataFrame, column: str, rows: DataFrame) -> DataFrame:
    """Rows of df whose ``column`` is among those of rows, a small local table: as these are named, df's scan gives no others, and
    nothing is made of them."""
    return df.where(F.col(column).isin([r[0] for r in rows.select(column).distinct().collect()]))


def query_words(spark: SparkSession, query: str) -> DataFrame:
    """(qi, qw, q_stem, is_last, budget) of the first MAX_QUERY_WORDS words; repeated words stay."""
    rows = spark.range(1).select(F.posexplode(F.slice(T.tokenize(F.lit(query)), 1, S.MAX_QUERY_WORDS)).alias("qi", "qw"), F.least(F.size(T.tokenize(F.lit(query))), F.lit(S.MAX_QUERY_WORDS)).alias("n"))
    return rows.select("qi", "qw", T.stem("qw").alias("q_stem"), (F.col("qi") == F.col("n") - 1).alias("is_last"), T.allowed_typos("qw").alias("budget"))


def derivations(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(qi, word, cost, exact): vocabulary words that a query word stands for. The query has 24 words at most: it is broadcast."""
    pairs = vocabulary.join(F.broadcast(words))
    distance = T.bounded_levenshtein("qw", "word", F.col("budget"))
    cost = (
        F.when(F.col("qw") == F.col("word"), 0)
        .when(F.col("is_last") & (F.length("qw") >= S.MIN_PREFIX) & F.col("word").startswith(F.col("qw")), 0)
        .when(F.col("q_stem") == T.stem("word"), S.COST_STEM)
        .when((F.col("budget") > 0) & (distance > 0), distance * S.COST_TYPO)
    )
    return pairs.select("qi", "word", cost.alias("cost"), (F.col("qw") == F.col("word")).alias("exact"), *(["n"] if "n" in vocabulary.columns else [])).where("cost is not null")


def word_weights(words: DataFrame, derived: DataFrame, total: DataFrame) -> DataFrame:
    """(qi, df, gated, any_open, idf): chunks of all derived words together, at most all chunks; gated above DF_GATE of them.

    derived: with n, the chunks that hold each word; total: one row (n), at least 1.
    """
    sums = derived.groupBy("qi").agg(F.sum("n").alias("c"))
    rows = words.select("qi").join(sums, "qi", "left").join(F.broadcast(total.select(F.col("n").cast("double").alias("total"))))
    rows = rows.withColumn("df", F.least(F.coalesce(F.col("c"), F.lit(0)).cast("double"), F.col("total")))
    rows = rows.withColumn("gated", F.col("df") > S.DF_GATE * F.col("total"))
    return rows.select("qi", "df", "gated", F.max(~F.col("gated")).over(Window.partitionBy()).alias("any_open"), F.log(1 + F.col("total") / (1 + F.col("df"))).alias("idf"))


def occurrences(derived: DataFrame, weights: DataFrame, postings: DataFrame) -> DataFrame:
    """(chunk_id, qi, cost, exact, attr, pos, idf) in candidate chunks: those of words that aren't gated, or of all if all are.

    The postings are read once. A few derived words are broadcast, so that no posting moves before it is found; stored postings are sorted by word:
    a few words are looked up by name, of more only the range is.
    """
    rows = derived.drop("n").join(F.broadcast(weights), "qi").withColumn("open", ~(F.col("gated") & F.col("any_open")))
    first = rows.limit(LOOKUP + 1).toArrow()
    if listed := first.num_rows <= LOOKUP:
        rows = F.broadcast(rows.sparkSession.createDataFrame(first))
        names = sorted(set(first["word"].to_pylist()))
        postings = postings.where(F.col("word").isin(names) if len(names) <= NAMED else F.col("word").between(names[0], names[-1]))
    found = postings.join(rows, "word")
    if not listed or not all(first["open"].to_pylist()):
        found = found.withColumn("open", F.max("open").over(Window.partitionBy("chunk_id"))).where("open")
    return found.select("chunk_id", "qi", "cost", "exact", "attr", "pos", "idf")


def by_chunk(found: DataFrame) -> DataFrame:
    """(chunk_id, w): what each chunk has of the query's words, an array in order of qi: qi, idf, cost, inexact, at, places (attr, pos)."""
    per_word = found.groupBy("chunk_id", "qi").agg(
        F.first("idf").alias("idf"), F.min(F.struct("cost", (~F.col("exact")).alias("inexact"))).alias("m"),
        F.min(F.struct("attr", "pos")).alias("at"), F.collect_set(F.struct("attr", "pos")).alias("places"),
    )
    return per_word.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("qi", "idf", "m.cost", "m.inexact", "at", "places"))).alias("w"))


def _nearness(w: Column) -> Column:
    """For each two neighbouring query words that both occur, the least cost of their places, FARTHEST at most."""
    near = lambda x, y: F.when(y >= x, y - x).otherwise(x - y + 1)
    far = F.lit(S.FARTHEST).cast("long")

    def best(a: Column, b: Column) -> Column:
        close = lambda x: F.filter(b["places"], lambda y: (y["attr"] == x["attr"]) & (F.abs(y["pos"] - x["pos"]) < S.FARTHEST))
        return F.aggregate(a["places"], far, lambda low, x: F.when(low == 0, low).otherwise(F.least(low, F.coalesce(F.array_min(F.transform(close(x), lambda y: near(x["pos"], y["pos"]))), low))))

    pairs = F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["b"]["qi"] == p["a"]["qi"] + 1)
    return F.transform(pairs, lambda p: best(p["a"], p["b"]))


def proximity(found: DataFrame) -> DataFrame:
    """(chunk_id, proximity): the sum over neighbouring query words that both occur, of chunks with such words. No pairs of
    places are made as rows."""
    rows = by_chunk(found).select("chunk_id", _nearness(F.col("w")).alias("n")).where("size(n) > 0")
    return rows.select("chunk_id", F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x).alias("proximity"))


def match_stats(found: DataFrame) -> DataFrame:
    """The ranking rules' values for each chunk; occurrences are read once."""
    total = lambda start, of: F.aggregate("w", start, lambda s, x: s + of(x))
    rows = by_chunk(found).withColumn("at", F.array_min(F.transform("w", lambda x: x["at"])))
    return rows.select(
        "chunk_id", F.size("w").cast("long").alias("words_matched"), F.round(total(F.lit(0.0), lambda x: x["idf"]), 6).alias("idf_weight"), total(F.lit(0).cast("long"), lambda x: x["cost"]).alias("typo_count"),
        F.aggregate(_nearness(F.col("w")), F.lit(0).cast("long"), lambda s, x: s + x).alias("proximity"),
        F.col("at.attr").cast("long").alias("best_attr"), F.col("at.pos").alias("best_pos"), F.size(F.filter("w", lambda x: ~x["inexact"])).cast("long").alias("exact_count"),
    )


RULES = (F.desc, "words_matched"), (F.desc, "idf_weight"), (F.asc, "typo_count"), (F.asc, "proximity"), (F.asc, "best_attr"), (F.asc, "best_pos"), (F.desc, "exact_count"), (F.asc, "chunk_id")


def lookup(c: Corpus, query: str) -> tuple[DataFrame, DataFrame]:
    """(weights, occurrences) of a query's words: the vocabulary is read once, and of the postings the derived words' only."""
    words = small(query_words(c.docs.sparkSession, query))  # MAX_QUERY_WORDS rows
    derived = derivations(words, C.vocabulary(c))
    total = C.live_chunks(c).agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    first = derived.limit(LOOKUP + 1).toArrow()
    derived = derived.sparkSession.createDataFrame(first) if first.num_rows <= LOOKUP else derived
    weights = small(word_weights(words, derived, total))
    return weights, occurrences(derived, weights, C.search_postings(c))


def lexical_search(c: Corpus, query: str, top_k: int = S.STRATEGY_TOP_K) -> DataFrame:
    """The best chunks by RULES, with their values."""
    weights, found = lookup(c, query)
    return match_stats(found).orderBy(*(way(name) for way, name in RULES)).limit(top_k)


def vector_search(chunks: DataFrame, vector: list[float], top_k: int = S.STRATEGY_TOP_K) -> DataFrame:
    """(chunk_id, sim) of the chunks (id, embedding) most like ``vector``; only positive ones. A task keeps top_k rows."""
    length = sum(float(x) ** 2 for x in vector) ** 0.5
    unit = F.from_json(F.lit(json.dumps([float(x) / length for x in vector] if length else [])), "array<double>")
    norm = F.sqrt(E.dot(F.col("embedding"), F.col("embedding")))
    sim = F.when(norm > 0, F.coalesce(E.dot(F.col("embedding"), unit), F.lit(0.0)) / norm).otherwise(0.0)
    return chunks.select(F.col("id").alias("chunk_id"), F.round(sim, 6).alias("sim")).where("sim > 0").orderBy(F.desc("sim"), "chunk_id").limit(top_k)


def ranked(rows: DataFrame, order: list[Column], weight: float) -> DataFrame:
    return rows.select("chunk_id", F.row_number().over(Window.orderBy(*order)).alias("rank"), F.lit(weight).alias("weight"))


def fuse(lists: list[DataFrame], k: float = S.RRF_K, top_k: int = S.FUSED_TOP_K) -> DataFrame:
    """(chunk_id, score) of ranked lists (chunk_id, rank, weight): sums of weight / (k + rank)."""
    union = lists[0]
    for other in lists[1:]:
        union = union.unionByName(other)
    fused = union.groupBy("chunk_id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("score"))
    return fused.orderBy(F.desc("score"), "chunk_id").limit(top_k)


def edges_both_ways(links: DataFrame, docs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, other, src_doc_id, dst_slug, edge_type) of links of live sources, seen from both ends; other is null if dangling.

    nodes (node): only edges at these.
    """
    at = lambda end: links if nodes is None else links.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    names = docs.where("deleted_at is null").select(F.col("id").alias("src_doc_id"), F.col("slug").alias("src_slug"))
    cols = ["src_doc_id", "src_slug", "dst_slug", "edge_type"]
    out = at("src_doc_id").join(names, "src_doc_id").select(F.col("src_doc_id").alias("node"), F.col("dst_doc_id").alias("other"), *cols)
    back = at("dst_doc_id").where("dst_doc_id is not null and dst_doc_id <> src_doc_id").join(names, "src_doc_id").select(F.col("dst_doc_id").alias("node"), F.col("src_doc_id").alias("other"), *cols)
    return out.unionByName(back)


def cap_hubs(edges: DataFrame) -> DataFrame:
    """At most HUB_EDGES edges of a node, typed ones first."""
    line = Window.partitionBy("node").orderBy(F.col("edge_type") == "mentions", "src_doc_id", "dst_slug", "edge_type")
    return edges.withColumn("k", F.row_number().over(line)).where(F.col("k") <= S.HUB_EDGES).drop("k")


def edges_at(edges: Edges, nodes: DataFrame) -> DataFrame:
    return edges(nodes) if callable(edges) else edges.join(nodes, "node", "left_semi")


def distances(seeds: DataFrame, edges: Edges, hops: int, capped: bool = True) -> DataFrame:
    """(id, dist) of documents within ``hops`` of seeds (id). Only edges of a frontier's nodes are capped and followed."""
    out = seeds.select("id", F.lit(0).alias("dist"))
    frontier = seeds.select("id")
    for hop in range(1, hops + 1):
        near = edges_at(edges, frontier.select(F.col("id").alias("node")))
        near = (cap_hubs(near) if capped else near).where("other is not null").select(F.col("other").alias("id")).distinct()
        frontier = near.join(out, "id", "left_anti")
        out = out.unionByName(frontier.withColumn("dist", F.lit(hop)))
    return out


def adjacent_seeds(seeds: DataFrame, edges: Edges) -> DataFrame:
    """(id) of seeds with a (capped) edge to a seed, itself included."""
    near = cap_hubs(edges_at(edges, seeds.select(F.col("id").alias("node"))))
    pairs = near.join(seeds.select(F.col("id").alias("other")), "other", "left_semi")
    return pairs.select(F.col("node").alias("id")).unionByName(pairs.select(F.col("other").alias("id"))).distinct()


def inject(seeds: DataFrame, dist: DataFrame, c: Corpus) -> DataFrame:
    """(doc_id, chunk_id, heading_path, text, score): neighbours of seeds (id, score), nearest first, MAX_INJECTED at most."""
    top = seeds.agg(F.max("score").alias("top"))
    near = dist.where("dist > 0").join(c.searchable.select("id"), "id", "left_semi").orderBy("dist", "id").limit(S.MAX_INJECTED)
    near = small(near).join(F.broadcast(top)).select(F.col("id").alias("doc_id"), (S.INJECT * F.col("top") * F.pow(F.lit(S.HOP_DECAY), F.col("dist") - 1)).alias("score"))
    return near.join(C.first_chunks(replace(c, chunks=among(c.chunks, "doc_id", near))), "doc_id").select("doc_id", "chunk_id", "heading_path", "text", "score")


def traverse(c: Corpus, start: DataFrame, hops: int, edge_type: str | None = None) -> DataFrame:
    """(src_slug, dst_slug, edge_type, hop) of edges within ``hops`` of start (id): the graph query.

    An edge's hop is one more than the nearer end's distance; no hubs are capped, dangling ends are shown, not followed.
    """
    links = c.links.where(F.col("edge_type") == edge_type) if edge_type else c.links
    edges = lambda nodes: edges_both_ways(links, c.docs, nodes)
    dist = distances(start, edges, hops - 1, capped=False) if hops > 1 else start.select("id", F.lit(0).alias("dist"))
    if hops < 1:
        dist = dist.where("false")
    near = edges(dist.select(F.col("id").alias("node"))).join(dist.withColumnRenamed("id", "node"), "node")
    return near.groupBy("src_doc_id", "src_slug", "dst_slug", "edge_type").agg((F.min("dist") + 1).cast("long").alias("hop")).drop("src_doc_id")


def authority(typed: Column, mentions: Column) -> Column:
    return 1 + S.AUTHORITY_WEIGHT * F.log(1 + F.coalesce(typed, F.lit(0)) + 0.5 * F.coalesce(mentions, F.lit(0)))


def recency(age: Column, temporal: bool) -> Column:
    amplitude, decay = S.RECENCY_TEMPORAL if temporal else S.RECENCY_BASE
    return F.coalesce(1 + amplitude * F.exp(-age / decay), F.lit(1.0))


def name_boost(alias: Column, title: Column) -> Column:
    return F.when(alias, S.ALIAS_BOOST).when(title, S.TITLE_BOOST).otherwise(1.0)


def evidence(alias: Column, title: Column, matched: Column, typos: Column, sim: Column, injected: Column, n_words: Column | int) -> Column:
    return (
        F.when(alias, "alias_hit").when(title, "exact_title_match").when((matched == n_words) & (typos == 0), "keyword_exact")
        .when(sim >= S.HIGH_VECTOR, "high_vector_match").when(injected, "graph_adjacent").otherwise("weak_semantic")
    )


def best_of_docs(rows: DataFrame) -> DataFrame:
    """(doc_id, score): the best of each document's chunks."""
    return rows.groupBy("doc_id").agg(F.max("score").alias("score"))


def candidates(c: Corpus, lexical: DataFrame, vector: DataFrame, intent: str, hops: int) -> DataFrame:
    """Fused chunks and injected neighbours: doc_id, chunk_id, heading_path, text, score, injected, sim, words_matched, typo_count."""
    w_lex, w_vec = S.STRATEGY_WEIGHTS[intent]
    fused = fuse([ranked(lexical, [way(n) for way, n in RULES], w_lex), ranked(vector, [F.desc("sim"), F.col("chunk_id")], w_vec)])
    docs = c.searchable.select(F.col("id").alias("doc_id"))
    chunks = c.chunks.select(F.col("id").alias("chunk_id"), "doc_id", "heading_path", "text")
    fused = small(fused)  # FUSED_TOP_K rows at most
    hydrated = small(fused.join(among(chunks, "chunk_id", fused), "chunk_id").join(docs, "doc_id", "left_semi"))
    seeds = best_of_docs(hydrated).withColumnRenamed("doc_id", "id")
    edges = lambda nodes: edges_both_ways(c.links, c.docs, nodes)
    boosted = adjacent_seeds(seeds, edges).select(F.col("id").alias("doc_id"), F.lit(True).alias("adjacent"))
    own = hydrated.join(boosted, "doc_id", "left").withColumn("score", F.col("score") * F.when(F.col("adjacent"), S.ADJACENT_BOOST).otherwise(1.0)).withColumn("injected", F.lit(False)).drop("adjacent")
    more = small(inject(seeds, distances(seeds, edges, hops), c)).withColumn("injected", F.lit(True))  # MAX_INJECTED rows at most
    own = own.join(vector, "chunk_id", "left").join(lexical.select("chunk_id", "words_matched", "typo_count"), "chunk_id", "left")
    more = more.withColumn("sim", F.lit(0.0)).withColumn("words_matched", F.lit(None).cast("long")).withColumn("typo_count", F.lit(None).cast("long"))
    return own.unionByName(more)


def score_candidates(c: Corpus, found: DataFrame, query: str, intent: str, as_of: str) -> DataFrame:
    """Candidates with all priors in score (rounded to 9 places), evidence, and their documents' columns."""
    q = query.strip().lower()
    temporal = intent == "temporal"
    found = small(found)  # FUSED_TOP_K and MAX_INJECTED rows
    names = among(c.aliases, "doc_id", found).groupBy("doc_id").agg(F.max(F.lower("alias") == q).alias("alias_hit"))
    rows = found.join(among(c.docs.select(F.col("id").alias("doc_id"), "slug", "title", "doc_type", "source_dir", "updated_at"), "doc_id", found), "doc_id")
    linked = among(c.links, "dst_doc_id", found.select(F.col("doc_id").alias("dst_doc_id")))
    rows = rows.join(C.in_degree(linked), "doc_id", "left").join(names, "doc_id", "left")
    alias = F.coalesce("alias_hit", F.lit(False))
    title = F.lower("title").contains(q) if q else F.lower("title") == q
    score = F.col("score") * T.tier_factor("source_dir", temporal) * authority(F.col("typed"), F.col("mentions")) * recency(T.age_days("updated_at", F.lit(as_of).cast("timestamp")), temporal) * name_boost(alias, title)
    n_words = F.size(T.tokenize(F.lit(query)))
    tag = evidence(alias, title, F.col("words_matched"), F.col("typo_count"), F.coalesce("sim", F.lit(0.0)), F.col("injected"), n_words)
    return rows.select("slug", "title", "doc_type", "source_dir", "updated_at", "doc_id", "chunk_id", "heading_path", "text", F.round(score, 9).alias("score"), tag.alias("evidence"))


def best_by_slug(rows: DataFrame) -> DataFrame:
    line = Window.partitionBy("slug").orderBy(F.desc("score"), "chunk_id")
    return rows.withColumn("_k", F.row_number().over(line)).where("_k = 1").drop("_k")


def within_budget(rows: DataFrame, order: list[Column], cost: Column, budget: int, most: int) -> DataFrame:
    """rank and the first rows whose costs fit the budget together; the first row always, ``most`` rows at most."""
    first = rows.orderBy(*order).limit(most)
    line = Window.orderBy(*order)
    spent = F.sum(cost).over(line.rowsBetween(Window.unboundedPreceding, 0))
    out = first.withColumn("rank", F.row_number().over(line).cast("long")).withColumn("_spent", spent)
    over = F.max((F.col("_spent") > budget) & (F.col("rank") > 1)).over(line.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("_over", over).where("not _over").drop("_over", "_spent")


def query_intent(c: Corpus, query: str) -> str:
    """One small query: whether a capitalised run of the question names a document decides in part."""
    spans = c.docs.sparkSession.range(1).select(F.explode(T.titlecase_spans(F.lit(query))).alias("name"))
    known = C.resolve_docs(c, spans.distinct()).agg(F.count("*").alias("n")).select((F.col("n") > 0).alias("known"))
    return known.select(T.classify_intent(F.lit(query), F.col("known")).alias("intent")).first()["intent"]


def search(c: Corpus, query: str, vector: list[float], mode: str = "balanced", as_of: str = "1970-01-01", intent: str | None = None, limit: int | None = None) -> DataFrame:
    """rank, slug, title, heading_path, snippet, score, evidence, doc_type, source_dir, updated_at: the whole pipeline, lazily."""
    intent = intent or query_intent(c, query)
    budget, hops, most = S.knobs(mode, intent)
    lexical = small(lexical_search(c, query))  # STRATEGY_TOP_K rows, as the next one
    similar = small(vector_search(c.chunks.join(c.live.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), vector))
    rows = best_by_slug(score_candidates(c, candidates(c, lexical, similar, intent, hops), query, intent, as_of))
    rows = rows.withColumn("snippet", T.snippet("text"))
    out = within_budget(rows, [F.desc("score"), F.col("slug")], T.token_estimate("snippet"), budget, most)
    out = out.where(F.col("rank") <= limit) if limit is not None else out
    return out.select("rank", "slug", "title", "heading_path", "snippet", "score", "evidence", "doc_type", "source_dir", "updated_at")
