"""The pipeline's stages, each against its own rule on a small table, and with columns whose names the operators use inside."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from skein.llm import quality
from tests.llm.test_operators import ROWS, brute_repeats

SF = "/root/testdata/sf0.001"
WORDS = "score row body kept hash key uid size shard part at text_hash node digest sig bands bucket _hash _text _kept _uid x y spot chunk id label taken shards bytes whole cut copy skey sha found n wanted".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(d, t, "en", s, None if t is None else len(t)) for d, t, s in ROWS]
    plain = spark.createDataFrame(rows, DOCS)
    odd = spark.createDataFrame([(*r, *range(len(WORDS))) for r in rows], DOCS + "".join(f", `{w}` int" for w in WORDS))
    return plain, odd, spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_clashing_names(spark, tables, name):
    """Other columns, whatever their names, are kept and change nothing; nulls, repeated rows and empty tables pass."""
    stage = dict(corpus_pipeline.STAGES)[name]
    plain, odd, none = (stage(spark, t, SF) for t in tables)
    assert Counter(map(tuple, plain.collect())) == Counter(map(tuple, odd.select(*plain.columns).collect())) and not none.collect()
    if name != "best_fit_packing":
        assert odd.columns == tables[1].columns and all(r[w] == i for r in odd.collect() for i, w in enumerate(WORDS))


def shingles(text: str | None) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_rules_of_stages(spark, tables):
    """Quality: the classifier's own scores. Near copies: the least doc_id of each group by brute force. Repeats: byte by byte."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_classifier(spark, docs, SF).collect()
    scores = {r["doc_id"]: r["score"] for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in kept} == {d for d, s in scores.items() if s >= 0.5} and kept[0].asDict().keys() == set(docs.columns)
    good = spark.createDataFrame(kept, DOCS)
    texts = sorted((r["doc_id"], r["text"]) for r in kept)
    sets = [shingles(t) for _, t in texts]
    low = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((low[i], low[j]))
                low = [a if x == b else x for x in low]
    single = corpus_pipeline.minhash_near_dedup(spark, good, SF)
    assert {r["doc_id"] for r in single.collect()} == {texts[i][0] for i in range(len(texts)) if low[i] == i}
    stripped = {r["doc_id"]: r for r in corpus_pipeline.suffix_array_dedup(spark, single, SF).collect()}
    left = sorted((r["doc_id"], r["text"]) for r in single.collect())
    for (d, _), (_, _, raw) in zip(left, brute_repeats([t.encode() for _, t in left], corpus_pipeline.REPEAT)):
        assert stripped[d]["text"] == raw.decode("utf-8", "ignore") and stripped[d]["n_chars"] == len(stripped[d]["text"])


def test_run(spark):
    """The whole pipeline: pieces fill sequences without gaps or overlaps."""
    spans: dict = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for got in spans.values():
        got.sort()
        ends = np.cumsum([n for _, n in got])
        assert [o for o, _ in got] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024
    assert sum(1024 - sum(n for _, n in g) for g in spans.values()) <= 0.05 * 1024 * len(spans) + 1024
