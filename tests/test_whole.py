"""Queries over whole tables, where others of the registry take a part: against their SQL on tables of more than that part, and by example."""

from __future__ import annotations

import os
import re

import duckdb
import pytest

import __spark_entry__
from skein import settings as S

SF = "/root/testdata/sf0.01"
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def agreed(spark, name) -> list[dict]:
    """Rows of the query, which are those of its SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    cursor = con.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    got = [r.asDict() for r in QUERIES[name](spark, SF).collect()]
    assert sorted(tuple(map(str, (r[c] for c in columns))) for r in got) == sorted(tuple(map(str, r)) for r in cursor.fetchall())
    return got


def number(slug: str) -> int:
    return int(slug.rpartition("-")[2])


def test_links_of_all_documents(spark):
    got = agreed(spark, "links_table")
    assert {r["src_doc_id"] for r in got} == set(range(1000))
    assert any(r["dst_doc_id"] is not None and r["src_doc_id"] > 2 for r in got)


@pytest.mark.parametrize("name", ["gap_stale", "gap_dangling"])
def test_gaps_of_all_documents(spark, name):
    assert max(number(r["slug"]) for r in agreed(spark, name)) > 900


def test_low_confidence_reads_all_documents(spark, monkeypatch):
    from skein.plans import registry

    seen = []
    monkeypatch.setattr(registry.think, "low_confidence", lambda found: seen.append(found.count()) or found.limit(0))
    QUERIES["gap_low_conf"](spark, SF)
    assert seen == [sum(i % 17 != 0 for i in range(1000))]


def test_dangling_links_of_all_documents(spark):
    assert {number(r["slug"]) % 2 for r in agreed(spark, "dangling_links")} == {0, 1}


def intent(text: str, known: bool) -> str:
    found = lambda pattern: re.search(pattern, text, re.I)
    if found(S.ENTITY_LEAD) or len(text.split()) <= 6 and known:
        return "entity"
    return "temporal" if found(S.TEMPORAL) else "event" if found(S.EVENT) else "general"


def test_intent_of_whole_texts(spark, tmp_path):
    pad = "plain words that mean nothing at all to any of the rules here, so to say, "
    rows = [(1, 1, pad + "until yesterday"), (2, 1, pad + "at the keynote"), (3, 0, pad + "x"), (4, 0, "one two three four five " + "x" * 60 + " seven"), (5, 1, pad), (6, 0, "some name"), (7, 1, "who is " + pad)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r["intent"] for r in QUERIES["classify_intent"](spark, str(tmp_path)).collect()}
    assert got == {c: intent(t, k == 0) for c, k, t in rows} == {1: "temporal", 2: "event", 3: "general", 4: "general", 5: "general", 6: "entity", 7: "entity"}
    texts = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "text").collect()
    got = sorted((r["conv_id"], r["turn"], r["intent"]) for r in QUERIES["classify_intent"](spark, SF).collect())
    assert got == sorted((r["conv_id"], r["turn"], intent(r["text"], r["turn"] == 0)) for r in texts)


def test_bad_utf8_anywhere(spark, tmp_path):
    from skein.sources import vault

    texts = {"good": "é" * 200_000, "far": "é" * 200_000, "empty": ""}
    for name, text in texts.items():
        (tmp_path / f"{name}.md").write_bytes(text.encode() + (b"\xc3" if name == "far" else b""))
    got = {r["slug"]: (r["content"], r["issue"] is None) for r in vault.scan(spark, str(tmp_path)).collect()}
    assert got == {"good": (texts["good"], True), "far": (None, False), "empty": ("", True)}
