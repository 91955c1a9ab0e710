"""Functions on text and markdown, by example."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import embedding as E
from skein.functions import markdown as M
from skein.functions import text as T


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("word", "expected"), [("stories", "story"), ("classes", "class"), ("returns", "return"), ("returned", "return"), ("running", "runn"), ("is", "is"), ("ies", "ies"), ("gladly", "glad"), ("boxes", "box")])
def test_stem(spark, word, expected):
    assert one(spark, T.stem("w"), w=word) == expected


def test_words_and_distances(spark):
    assert one(spark, T.tokenize("t"), t="Don't STOP, été_x2!") == ["don", "t", "stop", "été", "x2"]
    assert one(spark, T.bounded_levenshtein("a", F.lit("kitten"), 3), a="sitting") == 3 and one(spark, T.bounded_levenshtein("a", F.lit("kitten"), 2), a="sitting") is None
    assert [one(spark, T.allowed_typos("w"), w="x" * n) for n in (4, 5, 8, 9)] == [0, 1, 1, 2]


def test_titles_and_slugs(spark):
    assert one(spark, T.title_from_slug("s"), s="a/my-first_noteX") == "My First NoteX"
    assert one(spark, T.slugify("s"), s="  Été: One & two! ") == "été-one-two" and one(spark, T.slugify("s"), s="!!") == "note"
    assert one(spark, T.derive_title("s"), s="\n  \n one two three four five six seven eight nine\nx") == "one two three four five six seven eight"
    assert one(spark, T.derive_title("s"), s=" \n") == "Captured note" and len(one(spark, T.derive_title("s"), s="é" * 90)) == 60
    assert one(spark, T.slug_for("s"), s="a\\b.MD") == "a/b"
    assert one(spark, T.snippet("s"), s=" " + "é" * 200) == "é" * 160 + "…"
    assert one(spark, T.lead_sentences("s", 2), s="One. Two! Three?") == "One. Two!" and one(spark, T.lead_sentences("s", 2), s="just this") == "just this"


def test_dates(spark):
    age = lambda s: one(spark, T.age_days("s", F.lit("2026-06-13 12:00:00").cast("timestamp")), s=s)
    assert age("2026-06-12") == 1.5 and age("2026-06-13T10:30:00+02:00") == 3 / 24 and age("2027-01-01") == 0.0
    assert age("2026") is None and age("June") is None and age("2026-13-45") is None


@pytest.mark.parametrize(
    ("query", "known", "expected"),
    [("who is Ann", False, "entity"), ("Acme Corp", True, "entity"), ("a b c d e f Acme", True, "general"), ("what changed last week", False, "temporal"), ("3 days ago", False, "temporal"), ("notes from the summit", False, "event"), ("retrieval quality", False, "general"), ("dismay", False, "general")],
)
def test_intent(spark, query, known, expected):
    assert one(spark, T.classify_intent("q", F.lit(known)), q=query) == expected


def test_titlecase_spans(spark):
    assert one(spark, T.titlecase_spans("s"), s="did Acme AI, meet (Garry Tan) today? Yes") == ["Acme AI", "Garry Tan", "Yes"]


SENTENCES = [("She founded it", "founded"), ("He has not invested in it", "mentions"), ("considered it, then invested in it", "invested_in"), ("led the big seed", "invested_in"), ("head of sales at", "works_at"), ("never works at, advises", "advises"), ("met him at", "attended"), ("saw", "mentions")]


@pytest.mark.parametrize(("sentence", "expected"), SENTENCES)
def test_edge_types_agree(spark, sentence, expected):
    assert M.infer_edge(sentence) == expected and one(spark, T.edge_type("s"), s=sentence) == expected


@pytest.mark.parametrize(
    ("directory", "target", "beside", "expected"),
    [
        ("people", "../companies/acme.md", True, "companies/acme"), ("people", "bob", True, "people/bob"), ("people", "bob", False, "bob"), ("people", "a/b.md#part", True, "a/b"),
        ("a", "../../x", True, None), ("a", "http://x.org", True, None), ("a", "mailto:x", True, None), ("a", "#top", True, None), ("a", "<my%20notes/x.md>", True, "my notes/x"),
        ("a", "/root.md", True, "root"), ("a", "b\\c.md", True, "b/c"), ("a", "50%zz", True, "a/50%zz"), ("a", "./", True, "a"), ("", "..", True, None),
    ],
)
def test_normalize_slug(directory, target, beside, expected):
    assert M.normalize_slug(directory, target, beside) == expected


def test_links_in_code_and_images_are_none():
    body = "`[a](b.md)` ![c](d.md)\n```\n[e](f.md)\n```\n[g](<h i.md>) and [[j|k]] and ![[l]]"
    assert M.extract_links(body, "") == [("h i", "mentions", "g"), ("j", "mentions", "k"), ("l", "mentions", "l")]
    assert M.extract_links("> **Rival_Of:** [x](y.md)\n> **owns:** [x](y.md)\nfounded [x](y.md)", "") == [("y", "rival_of", "x"), ("y", "owns", "x")]


def test_front_matter():
    assert M.split_front_matter("---\na: 1\n---\nx\n---\ny") == ("a: 1", "x\n---\ny") and M.split_front_matter("x\n---\n") == (None, "x\n---\n")
    assert M.split_front_matter("---\r\na: 1\r\n---\r\nx") == ("a: 1\r", "x") or M.split_front_matter("---\r\na: 1\r\n---\r\nx") == ("a: 1", "x")
    assert M.split_front_matter("---\na: 1\n---") == ("a: 1", "")
    got = M.parse_front_matter("---\ntitle: 123\naliases: [A, {b: 1}, true]\ntags:\ncreated: 2026-01-05\nupdated: null\n---\nbody")
    assert (got["title"], got["aliases"], got["tags"], got["created"], got["updated"], got["error"]) == ("123", ["A", "true"], [], "2026-01-05", None, None)
    assert M.parse_front_matter("---\ntitle: [open\n---\n")["error"] and M.parse_front_matter("---\n- a\n---\n")["error"]


def test_chunks():
    body = "intro\n# A\n```\n# no heading\n```\n## B\n \n# C\ntext"
    assert M.chunk(body) == [("", "intro"), ("A", "```\n# no heading\n```"), ("C", "text")]
    long = "\n\n".join("x" * 500 for _ in range(5))
    assert [len(t) for _, t in M.chunk(f"# H\n{long}")] == [1002, 1002, 500]
    assert M.chunk("# A\n## B\ntext") == [("A > B", "text")] and M.chunk("#no\n####### no") == [("", "#no\n####### no")]


def test_embedder(spark):
    assert E.fnv1a64(b"") == 0xCBF29CE484222325 and E.fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    e = E.HashEmbedder()
    a, b, c = e.embed_batch(["graph retrieval", "graphs retrieving", "unlike words here"])
    assert abs(np.linalg.norm(a) - 1) < 1e-9 and a @ b > 0.3 > abs(a @ c) and not e.embed("").any()
    assert E.features("ab") == {"ab": 1, "^ab": 1, "ab$": 1, "^ab$": 1}
    assert E.decode_vector(E.encode_vector(np.array([1.5, -2])) + b"\x00").tolist() == [1.5, -2.0]
    got = spark.createDataFrame([("graph retrieval",), (None,)], "t string").select(E.embed_column(F.col("t")).alias("v")).collect()
    assert np.allclose(got[0]["v"], a, atol=1e-6) and not any(got[1]["v"])


def test_front_matter_issue(spark):
    issue = lambda t, d, k: one(spark, T.front_matter_issue(F.lit(t), F.lit(d), F.lit(k)), x=1)
    assert issue("a", " ", None) == "missing required field(s): description, type" and issue("a", "b", " note ") is None and issue("a", "b", "x").startswith("invalid type 'x'")
