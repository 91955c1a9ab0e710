"""What queries move between tasks as their tables grow, counted in rows, beside their results."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from skein.operators import corpus as C

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
#: Documents, and words of each.
DOCS, WORDS = 300, 400
SEARCHES = ["think_facts", "query_df", "vocabulary", "lexical_stats", "idf", "rrf_fusion", "hybrid_search", "proximity", "lexical_topk", "evidence", "word_df", "dedup_by_slug", "df_gate"]


def moved(spark, run) -> tuple[object, int]:
    """What run gives, and the rows that its tasks wrote for others to read."""
    sc = spark.sparkContext

    def written() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    out = run()
    return out, written() - before


@pytest.fixture(scope="module")
def same_words(spark, tmp_path_factory):
    """Documents of the same words: as many postings as words, a small vocabulary. Every other one has a word of the query, all have one that is gated."""
    root = str(tmp_path_factory.mktemp("scale"))
    filler = " ".join(f"w{i}x" for i in range(WORDS - 4))
    rows = [(i, f"Title {i} of it\nthe {filler} {'oredat shereinbel' if i % 2 else 'other words'} the", "en", f"src{i % 7}", 0) for i in range(DOCS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{root}/documents.parquet")
    vectors = [(i, [1.0, float(i % 5), 0.5], 0) for i in range(DOCS)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{root}/embeddings.parquet")
    return root


@pytest.mark.parametrize("name", SEARCHES)
def test_postings_stay_where_they_are_read(spark, same_words, tmp_path, name):
    (tmp_path / "own").symlink_to(same_words)  # nothing that another query keeps by path is used
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{same_words}/{t}.parquet/*.parquet'")
    cursor = con.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    got, rows = moved(spark, lambda: QUERIES[name](spark, str(tmp_path / "own")).collect())
    assert sorted(tuple(map(str, (r[c] for c in columns))) for r in got) == sorted(tuple(map(str, r)) for r in cursor.fetchall())
    assert len(got) > 0 and rows < DOCS * WORDS // 4


def test_words_are_counted_as_postings_have_them(spark):
    """Of several chunks, with the documents' titles; deleted ones give nothing, those in excluded directories words alone."""
    docs = spark.createDataFrame([(1, "n/1", "One title", "notes", None), (2, "t/2", "Two", "test", None), (3, "n/3", "Gone", "notes", "2026-01-01")], "id long, slug string, title string, source_dir string, deleted_at string")
    chunks = spark.createDataFrame([(10, 1, 0, "Head", "a b a"), (11, 1, 1, "Head", "B c"), (12, 2, 0, None, "c d"), (13, 3, 0, "", "e")], "id long, doc_id long, chunk_index int, heading_path string, text string")
    c = C.Corpus(docs, None, chunks, None, C.postings(docs, chunks))
    got = {r["word"]: r["n"] for r in C.word_index(c).collect()}
    live = c.postings.join(C.live_chunks(c).select(F.col("id").alias("chunk_id"), "source_dir"), "chunk_id").select("word", "chunk_id", "source_dir").distinct()
    assert got == {r["word"]: r["n"] for r in live.groupBy("word").agg(F.count_if(F.col("source_dir") != "test").alias("n")).collect()}
    assert got == {"one": 2, "title": 2, "head": 2, "a": 1, "b": 2, "c": 1, "two": 0, "d": 0}
    stored = C.search_postings(c).collect()
    texts = chunks.join(docs.withColumnRenamed("id", "doc_id"), "doc_id")
    c.texts = texts
    assert sorted(map(tuple, C.search_postings(c).collect())) == sorted(map(tuple, stored)) and {r["word"]: r["n"] for r in C.word_index(c).collect()} == got


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["frontmatter_fields", "validate_docs", "headings"])
def test_notes_are_parsed_once_on_all_cores(spark, tmp_path, name):
    """One file of one row group; a loader is made once, not for each text."""
    from skein.functions import markdown as M

    rows = [(i, f"Name {i}", i % 25, 1.0, "BUILDING") for i in range(400)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    assert plan(df).count("ArrowEvalPython") == 1
    assert len([n for n in df.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]) >= 4
    assert M._loader() is M._loader()


def test_pieces_of_few_texts_are_held_at_once(spark, tmp_path):
    """Pieces are those of each text, and go out as they are made, not with all others of a batch."""
    from skein.functions import markdown as M

    paragraph = "x" * 700
    texts = {i: None if i == 7 else "" if i == 8 else "\n".join(f"{i} {paragraph} {k}" for k in range(i % 5)) for i in range(1000)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["pack_paragraphs"](spark, str(tmp_path))
    got = sorted((r["doc_id"], r["piece"], r["text"]) for r in df.collect())
    assert got == [(i, k, p) for i, t in texts.items() for k, p in enumerate(M.pack_paragraphs((t or "").replace("\n", "\n\n")))]
    assert "MapInArrow" in plan(df) and "ArrowEvalPython" not in plan(df)
