"""The ten operators on small tables: against brute force, and on nulls, empty and long texts, ties, repeated rows, empty
tables and columns with clashing names."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skein.llm import embdup, fingerprints, mixing, neardup, packing, quality, sharding, suffixdup, tokenfiles, tokens, urlfilter
from skein.llm.shared import components
from skein.llm.tokens import encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, component string, uid string, size string, part int, bucket int, skey string, h int, v string, role int"
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def texts() -> list[tuple[int | None, str | None, str | None]]:
    rng = random.Random(3)
    base, passage = words(rng, 120), " ".join(words(rng, 100))
    near = [list(base) for _ in range(6)]
    for k, w in enumerate(near):
        for _ in range(k):
            w[rng.randrange(len(w))] = "zz"
    rows: list[tuple[int | None, str | None, str | None]] = [(10 + i, " ".join(w), f"s{i % 2}") for i, w in enumerate(near)]
    rows += [(1, None, "s0"), (2, "", None), (3, " \n\t ", "é"), (4, "One", "s0"), (5, "one TWO", "s1"), (5, "one TWO", "s1"), (5, "other text here", "s1"), (None, " ".join(base), None), (None, None, None)]
    rows += [(30 + i, f"{' '.join(words(rng, 30))} {passage} {' '.join(words(rng, 30))}", "long") for i in range(4)]
    rows += [(40, "é" * 900, "s1"), (41, " ".join(words(rng, 4000)), "big"), (42, "ab " * 700, "big"), (43, "日本語のテキスト" * 30, "s0"), (44, "x<|endoftext|>y it's\r\n\t 12,345!  ok ", "s0")]
    return rows


ROWS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", s, None if t is None else len(t), 7, "c", "u", "z", 1, 2, "k", 3, "v", 0) for d, t, s in ROWS]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df) -> list:
    return df.collect()


def test_sharding(docs, nothing):
    got = rows_of(sharding.assign(docs, [1.0] * 8, [1.0] * 9))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in ROWS)
    by = defaultdict(list)
    keys = defaultdict(set)
    for r in got:
        by[r["shard"]].append(r["slot"])
        keys[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["grown_shard"] in (r["shard"], 8) and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and all(len(k) == 1 for k in keys.values())
    assert not rows_of(sharding.assign(nothing, [1.0] * 8))


def test_shards_by_brute_force(spark):
    import math
    import struct

    import xxhash

    weights = [1.0, 2.5, 0.5, 1.0]

    def score(doc: int, k: int) -> float:
        h = xxhash.xxh64_intdigest(b"rendezvous", 42)
        for part in (struct.pack("<q", doc), struct.pack("<i", k)):
            h = xxhash.xxh64_intdigest(part, h)
        return weights[k] / -math.log(((h >> 11) + 0.5) / (1 << 53))

    ids = [0, 1, -5, 2**62, *range(100, 400)]
    got = {r["doc_id"]: r["shard"] for r in sharding.assign(spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string"), weights).collect()}
    assert got == {i: max(range(4), key=lambda k: score(i, k)) for i in ids}


def test_shares_follow_weights(spark):
    n = 40_000
    got = Counter(r[0] for r in spark.range(n).select(sharding.shard_of(F.col("id"), [1.0, 2.0, 5.0])).collect())
    assert [round(8 * got[k] / n, 1) for k in range(3)] == [1.0, 2.0, 5.0]


def naive_pack(sizes: list[int], window: int) -> list[int]:
    bins: list[int] = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b in bins if b >= s]
        bins.append((min(fits) if fits else window) - s)
        if fits:
            bins.remove(min(fits))
    return sorted(bins)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(100):
        window = rng.choice([8, 30])
        sizes = [rng.randint(1, window) for _ in range(rng.randint(0, 50))]
        made, n = packing.plan(dict(Counter(sizes)), window)
        fill = defaultdict(list)
        for s, c in Counter(sizes).items():
            for r in range(c):
                size, rank, first, each, at = [m for m in made if m[0] == s and m[1] <= r][-1]
                fill[first + (r - rank) // each].append((at + (r - rank) % each * s, s))
        assert len(fill) == n and sorted(window - sum(x for _, x in b) for b in fill.values()) == naive_pack(sizes, window)


def whole_ids(path: str, text: str | None) -> list[int]:
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_packing(docs, nothing):
    got = rows_of(packing.pack(docs, BYTE, 0, 64))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for at in sequences.values():
        at.sort()
        assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:])) and at[-1][0] + at[-1][1] <= 64
    expected = Counter()
    for d, t, _ in ROWS:
        ids = [*whole_ids(BYTE, t), 0]
        for i in range(0, len(ids), 64):
            part = np.array(ids[i : i + 64], "<u4")
            expected[d, i, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == expected
    assert not rows_of(packing.pack(nothing, BYTE))


@pytest.mark.parametrize("held", [1, 1 << 18])
def test_pieces_encode_as_the_whole(monkeypatch, held):
    monkeypatch.setattr(tokens, "HELD", held)
    odd = ["a\t\n b", "  x  \n\n y ", "it's 12 don't!!\n\n\n", "<|endoftext|> hi", "\n\n", "é ́x", "A b", "ΑΣ ΑΣ.", "x \x1c y", "🙂 ok　d", " 's 't'S", "a_b c_ _d", "ß ÿ÷×", *(t or "" for _, t, _ in ROWS)]
    for path in (BYTE, WORD):
        enc = encoder(path)
        enc.clear()
        assert enc.cuts and enc.batch(odd) == [enc.whole(t) if t else b"" for t in odd]


def test_token_files(spark, docs, nothing, tmp_path):
    path = str(tmp_path / "store")
    manifest = tokenfiles.write(docs, path, WORD, 2)
    got = sorted(rows_of(tokenfiles.read(spark, path)), key=lambda r: r["start"])
    assert manifest["dtype"] == "<u2" and [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
    ids = [r["doc_id"] for r in got]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, t, _ in ROWS for x in [[*whole_ids(WORD, t), 2]])
    assert {p.name.split("-")[0] for p in (tmp_path / "store").iterdir() if not p.name.startswith(".")} == {"tokens", "docs", "manifest.json"}
    assert tokenfiles.write(nothing, str(tmp_path / "none"), WORD, 2)["tokens"] == 0 and not rows_of(tokenfiles.read(spark, str(tmp_path / "none")))


def linked(pairs: set[tuple[int, int]], n: int) -> list[int]:
    to = list(range(n))

    def find(x: int) -> int:
        while to[x] != x:
            x = to[x]
        return x

    for a, b in pairs:
        to[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def least_ids(of: list[int], ids: list[int | None]) -> list[int | None]:
    low: dict[int, int] = {}
    for k, d in zip(of, ids):
        if d is not None:
            low[k] = min(d, low.get(k, d))
    return [low.get(k) for k in of]


def shingles(text: str | None, k: int) -> set:
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_groups(docs, nothing, k, percent):
    sets = [shingles(t, k) for _, t, _ in ROWS]
    pairs = {(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
    low = least_ids(linked(pairs, len(sets)), [d for d, _, _ in ROWS])
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows_of(neardup.near_groups(docs, k, percent)))
    assert got == Counter((d, len(s), c, d == c) for (d, _, _), s, c in zip(ROWS, sets, low))
    assert not rows_of(neardup.near_groups(nothing, k, percent))


def test_near_groups_in_small_blocks(spark, monkeypatch):
    """Groups without a centre, larger than a block: links only between some of their members."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "TRIES", 1)
    rng = random.Random(11)
    base = words(rng, 60)
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = rng.choice(["p", "q", "r"])
        rows.append((i, " ".join(w)))
    sets = [shingles(t, 3) for _, t in rows]
    pairs = {(i, j) for i in range(60) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    low = linked(pairs, 60)
    assert 1 < len(set(low)) < 60
    got = {r["doc_id"]: r["component_id"] for r in rows_of(neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85))}
    assert got == dict(enumerate(low))


def test_near_groups_make_no_rows_of_pairs(spark, monkeypatch):
    """A large group whose members are alike, but mostly no links: rows as many as its members, not as its pairs."""
    rng = random.Random(12)
    base, rows, made = words(rng, 100), [], {}
    for i in range(150):
        w = list(base) if i < 120 else rows[i - 120][1].split()
        for at in rng.sample(range(100), 2 if i < 120 else 1):
            w[at] = f"v{i}"
        rows.append((i, " ".join(w)))
    sets = [shingles(t, 3) for _, t in rows]
    pairs = {(i, j) for i in range(150) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    low = linked(pairs, 150)

    def counted(df, name, write=neardup.materialize):
        out = write(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(neardup, "materialize", counted)
    got = {r["doc_id"]: r["component_id"] for r in rows_of(neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85))}
    assert got == dict(enumerate(low)) and 50 < len(set(low)) < 140
    assert max(made["pairs"], made["links"], made.get("open", 0)) <= made["members"] <= neardup.HASHES // neardup.band_rows(85) * 150


def test_drop_near(docs):
    kept = rows_of(neardup.drop_near(docs, 5, 80))
    assert [r["doc_id"] for r in kept].count(10) == 1 and not {11, 12} & {r["doc_id"] for r in kept}
    assert {1, 2, 3, 4, 40, 41, 42, 43, 44, 30, 31, 32, 33} <= {r["doc_id"] for r in kept} and kept[0].asDict().keys() == set(docs.columns)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(500, i) for i in range(501, 540)] + [(600 + i, 601 + i) for i in range(20)]
    of = linked({(max(e), min(e)) for e in edges}, 700)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: of[x] for e in edges for x in e if e[0] != e[1] or any(x in f and f[0] != f[1] for f in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    vectors = [*base.tolist(), *(base[:10] + rng.normal(size=(10, 16)) * 0.15).tolist(), *(base[0] + rng.normal(size=(30, 16)) * 0.2).tolist(), *(3 * base[1:4]).tolist()]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, base[5].tolist()[:8], [1e-30] + [0.0] * 15, base[0].tolist()]
    rows = [(i, v, 1, 2) for i, v in enumerate([*vectors, *odd])]
    rows.append((None, base[0].tolist(), 1, 2))
    good = [i for i, (_, v, *_) in enumerate(rows) if v and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(np.float32(v))]
    x = {i: np.array(rows[i][1], np.float32).astype(float) for i in good}
    pairs = {(i, j) for i in good for j in good if j < i and len(x[i]) == len(x[j]) and x[i] @ x[j] >= 0.95 * np.linalg.norm(x[i]) * np.linalg.norm(x[j])}
    n = Counter(k for p in pairs for k in p)
    low = least_ids(linked(pairs, len(rows)), [r[0] for r in rows])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int, dim int")
    got = Counter(tuple(r) for r in rows_of(embdup.near_vectors(df)))
    assert got == Counter((r[0], n[i], low[i], r[0] == low[i]) for i, r in enumerate(rows)) and len(pairs) > 50
    assert not rows_of(embdup.near_vectors(df.limit(0)))


def test_visits_of_vectors(spark, monkeypatch):
    """Few cells are visited, and most links at the threshold itself are found, in random directions and along few components."""
    monkeypatch.setattr(embdup, "OCCUPANCY", 8)
    rng = np.random.default_rng(8)
    base = embdup.unit(rng.normal(size=(3000, 64)))
    bent = base[500:800].copy()
    bent[:, :2] += 0.22 * rng.choice([-1, 1], (300, 2))
    hot = base[0] + 0.002 * rng.normal(size=(700, 64))
    x = embdup.unit(np.concatenate([base, embdup.neighbours(base[:500], 0.9501), bent, hot]))
    df = spark.createDataFrame([(i, v.tolist(), 64) for i, v in enumerate(x)], "node long, v array<double>, dim int")
    grid = embdup._grids(df, 0.95)[64]
    _, _, k1, k2 = grid.keys(x)
    visited = np.mean([sum(len(s) for _, s in grid.visits(a, b)) for a, b in zip(k1[:3000], k2[:3000])])
    assert grid.k >= 20 and visited < 0.05 * grid.k**2
    true = (x @ x.T >= 0.95).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embdup.near_vectors(df.selectExpr("node AS vec_id", "v AS embedding"), 0.95).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= true).all()
    assert all(found[part].sum() >= 0.93 * true[part].sum() > 0 for part in (slice(3000, 3500), slice(3500, 3800), slice(3800, None)))


def brute_repeats(raws: list[bytes], least: int) -> list[tuple[int, int, bytes]]:
    seen = Counter(r[i : i + least] for r in raws for i in range(len(r) - least + 1))
    out = []
    for r in raws:
        off = np.zeros(len(r), bool)
        for i in range(len(r) - least + 1):
            if seen[r[i : i + least]] > 1:
                off[i : i + least] = True
        out.append((int(off.sum()), len(suffixdup._runs(off)[0]), np.frombuffer(r, np.uint8)[~off].tobytes()))
    return out


@pytest.mark.parametrize("chunk", [1024, 2])
def test_repeats(docs, nothing, monkeypatch, chunk):
    monkeypatch.setattr(suffixdup, "CHUNK", chunk)
    raws = [(t or "").encode() for _, t, _ in ROWS]
    for least in (400, 60):
        expected = Counter((d, len(r), n, s, hashlib.sha256(k).hexdigest(), k.decode("utf-8", "ignore")) for (d, _, _), r, (n, s, k) in zip(ROWS, raws, brute_repeats(raws, least)))
        assert Counter(tuple(r) for r in rows_of(suffixdup.report(docs, least))) == expected
    assert not rows_of(suffixdup.report(nothing, 400))


def test_repeats_of_random_texts():
    rng = random.Random(8)
    for _ in range(150):
        least, letters = rng.choice([3, 9, 20]), rng.choice([b"ab", b"abcd", bytes(range(256))])
        pool = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(4)]
        contexts = [b"".join(rng.choice(pool) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 10))]
        known = [(0, 0, len(contexts[0]) - least)] if rng.random() < 0.3 and len(contexts[0]) >= least else []
        on, starts = suffixdup.repeated(contexts, np.arange(len(contexts)) * 1000, known, least)
        seen = Counter(c[i : i + least] for c in [*contexts, *(contexts[0] for _ in known)] for i in range(len(c) - least + 1))
        for c, at in zip(contexts, starts):
            assert [bool(x) for x in on[at : at + len(c)]] == [i + least <= len(c) and seen[c[i : i + least]] > 1 for i in range(len(c))]


def test_anchors_of_long_texts(monkeypatch):
    rng = np.random.default_rng(5)
    raw = rng.integers(97, 101, 30_000).astype(np.uint8).tobytes() + b"a" * 3000
    whole = suffixdup.winnow(raw, 400, 160)
    monkeypatch.setattr(suffixdup, "_SEGMENT", 1000)
    parts = suffixdup.winnow(raw, 400, 160)
    assert all((a == b).all() for a, b in zip(whole, parts)) and (np.diff(whole[0]) <= 400 - 160 + 1).all()


def test_repeats_in_very_long_texts(spark):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage, once = noise(700), noise(300_000)
    rows = [(1, once[:262_000] + "<" + passage + ">" + once[262_000:]), (2, noise(50_000) + "(" + passage), (3, noise(1000))]
    got = {r["doc_id"]: r for r in suffixdup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3)] == [700, 700, 0] and got[1]["text"] == once[:262_000] + "<>" + once[262_000:]


def test_strip(docs):
    got = {r["doc_id"]: r for r in rows_of(suffixdup.strip(docs, 200)) if r["doc_id"]}
    passage = " ".join(ROWS[15][1].split()[40:50])
    assert passage not in got[30]["text"] and len(got[30]["text"]) > 200 and got[30]["n_chars"] == len(got[30]["text"]) and got[1]["text"] is None
    assert got[30].asDict().keys() == set(docs.columns)


def test_fingerprints(docs, nothing):
    got = rows_of(fingerprints.compare(docs))
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((d, len(t or "")) for d, t, _ in ROWS)
    order = sorted({d for d, _, _ in ROWS if d is not None and [x[0] for x in ROWS].count(d) == 1}, reverse=True)
    text = {d: t or "" for d, t, _ in ROWS}
    by = {r["doc_id"]: r for r in got}
    for d, e in zip(order, order[1:]):
        if e in (4, 3) or d in (6, 5):
            continue  # next to repeated ids
        if not any(e < x < d for x, _, _ in ROWS if x is not None):
            half = len(text[d]) // 2
            edited = text[d][: len(text[d]) - half] + text[e][:half]
            assert by[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    same = defaultdict(set)
    for d, t, _ in ROWS:
        if d is not None and d != 5:
            same[t or ""].add(by[d]["fingerprint"])
    assert all(len(v) == 1 for v in same.values()) and by[1]["fingerprint"] == "" and len(by[4]["fingerprint"]) == 8
    assert by[15]["near_next"] > 0.3 and by[41]["near_edited"] > 0.4 and by[41]["near_next"] < 0.01
    assert not rows_of(fingerprints.compare(nothing))
    one = rows_of(fingerprints.compare(docs.where("doc_id = 41")))
    assert one[0]["near_next"] == 1.0


def test_anchors_are_closed_syncmers(spark):
    rng = random.Random(4)
    a, b = words(rng, 80), words(rng, 40)
    rows = [(" ".join(a),), (" ".join(b[:20] + a[10:60] + b[20:]),), ("x " * 50,)]
    found = [set(r[0]) for r in spark.createDataFrame(rows, "t string").select(fingerprints.anchors(F.col("t"))).collect()]
    inner = [r[0] for r in spark.createDataFrame([(" ".join(a[10:60]),)], "t string").select(fingerprints.anchors(F.col("t"))).collect()][0]
    assert set(inner) <= found[0] & found[1] and 4 <= len(inner) <= 25 and len(found[2]) == 1


def test_text_without_spaces(spark):
    """One inserted character moves few anchors; likeness is that of the sets of anchors."""
    rng = random.Random(6)
    text = "".join(rng.choices("日本語のテキスト文章東京", k=3000))
    rows = [(3, text), (2, text[:1000] + "x" + text[1000:]), (1, text[::-1])]
    got = {r["doc_id"]: r for r in fingerprints.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {r["fingerprint"][k : k + 8] for k in range(0, len(r["fingerprint"]), 8)} for i, r in got.items()}
    like = lambda a, b: 2 * len(a & b) / (len(a) + len(b))
    assert abs(got[3]["near_next"] - like(sets[3], sets[2])) < 1e-9 and abs(got[2]["near_next"] - like(sets[2], sets[1])) < 1e-9
    assert got[3]["near_next"] > 0.95 and got[2]["near_next"] < 0.2


def test_next_of_null_ids(spark):
    """Documents without doc_id follow in order of a hash of their texts, in many buckets; the last one's next is the first."""
    rows = [(None, f"text number {i} " * 4) for i in range(40)] + [(7, "seven"), (9, "nine")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = [r["text"] for r in df.orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text")).collect()]
    edited = Counter()
    for a, b in zip(order, order[1:] + order[:1]):
        half = len(a) // 2
        edited[hashlib.sha256((a[: len(a) - half] + b[:half]).encode()).hexdigest()] += 1
    assert Counter(r["edited_sha256"] for r in fingerprints.compare(df).collect()) == edited


def test_short_texts_have_anchors(spark):
    rng = random.Random(5)
    k = fingerprints.K
    texts = [words(rng, n) for n in range(k, 2 * k) for _ in range(40)]
    rows = [(i, j, " ".join(w[j : j + k] if j >= 0 else w)) for i, w in enumerate(texts) for j in range(-1, len(w) - k + 1)]
    got = {(r["i"], r["j"]): r["a"] for r in spark.createDataFrame(rows, "i int, j int, t string").select("i", "j", fingerprints.anchors(F.col("t")).alias("a")).collect()}
    least = 0
    for i, w in enumerate(texts):
        windows = [got[i, j] for j in range(len(w) - k + 1)]
        assert all(len(x) == 1 for x in windows)
        each, found = [x[0] for x in windows], got[i, -1]
        assert found and found == [x for x in each if x in found]
        least += len(w) > k and found == [min(each)]
    assert least > 40
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert all(r["fingerprint"] and r["edited_fingerprint"] and r["near_next"] < 1 for r in fingerprints.compare(table).collect())


def test_flat_trees_are_the_trees():
    """The first split is the best one of all by brute force; the flattened walk gives what a walk from node to node gives."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (300, 5)).astype(float)
    y = ((x[:, 2] > 5) ^ (rng.random(300) < 0.1)).astype(float)
    trees = quality.fit(x, y)

    def walk(row: np.ndarray) -> float:
        total = trees.base
        for node in trees.roots:
            while trees.left[node] >= 0:
                node = trees.left[node] + (row[trees.feature[node]] > trees.threshold[node])
            total += trees.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.scores(x), [walk(r) for r in x]) and ((trees.scores(x) >= 0.5) == y).mean() > 0.85
    p = np.full(300, 1 / (1 + np.exp(-trees.base)))
    g, h = p - y, p * (1 - p)
    gain = lambda on: g[on].sum() ** 2 / (h[on].sum() + quality.RIDGE)
    best = max((gain(x[:, j] <= t) + gain(x[:, j] > t), -j, -t) for j in range(5) for t in np.unique(x[:, j]) if min((x[:, j] <= t).sum(), (x[:, j] > t).sum()) >= quality.LEAST)
    assert (trees.feature[trees.roots[0]], trees.threshold[trees.roots[0]]) == (-best[1], -best[2])


def test_quality(spark, docs, nothing):
    rng = random.Random(6)
    rows = [(i, " ".join(w.upper() + "!!" if i % 3 == 0 else w for w in words(rng, 50))) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(600)] + [(None, 1, 0), (3, None, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    got = rows_of(quality.classify(table, labels))
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["predicted"] == (r["doc_id"] % 3 != 0) for r in held) >= 0.98 * len(held)
    odd = rows_of(quality.classify(docs, labels))
    assert len(odd) == len(ROWS) and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["score"] for r in rows_of(quality.classify(docs, labels.limit(0)))} == {0.5}
    assert not rows_of(quality.classify(nothing, labels))


def test_mixing(spark, docs, nothing):
    got = rows_of(mixing.mix(docs))
    size = lambda t: len(__import__("re").findall("[^\x20\x09-\x0d]+", t or ""))
    sums = Counter()
    for _, t, s in ROWS:
        sums[s] += size(t)
    order = sorted((s for s in sums if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), 1.5 * sum(sums.values())
    while True:
        rate = rest / max(1e-9, sum(weight[s] for s in open_))
        full = {s for s in open_ if 2 * sums[s] <= rate * weight[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sums[s]
            rest -= target[s]
        open_ -= full
        if not open_:
            break
    target |= {s: rate * weight[s] for s in open_}
    taken = Counter()
    by_source = {(d, size(t)): s for d, t, s in ROWS}
    for r in got:
        s = by_source[r["doc_id"], r["size"]]
        taken[s] += r["taken"]
        assert r["source_size"] == sums[s] and abs(r["target"] - target[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        assert len([x for x in r["shards"].split(",") if x]) == (-(-r["taken"] // r["size"]) if r["size"] else 0)
    assert len(got) == len(ROWS) and all(abs(taken[s] - target[s]) <= 0.5 for s in sums)
    assert Counter(map(tuple, got)) == Counter(map(tuple, rows_of(mixing.mix(docs.repartition(5)))))
    assert not rows_of(mixing.mix(nothing))
    real = rows_of(mixing.realize(docs))
    assert sum(size(r["text"]) for r in real) == sum(taken.values()) and real[0].asDict().keys() == set(docs.columns)


def test_tree_draws_hypergeometric_numbers(spark):
    """Inversion against exact fractions; quotas add up at each node whatever the numbers' size."""
    from fractions import Fraction
    from math import comb

    draw = lambda m, k, n, df: [r[0] for r in df.select(mixing._hypergeometric(*(F.lit(x).cast("long") for x in (m, k, n)), F.col("u"))).collect()]
    steps = spark.range(400).selectExpr("(id + 0.5D) / 400 AS u").coalesce(1).orderBy("u")
    for m, k, n in ((30, 12, 15), (9, 9, 4), (40, 3, 20), (7, 0, 3), (50, 25, 50)):
        lowest = max(0, n + k - m)
        share = [Fraction(comb(k, x) * comb(m - k, n - x), comb(m, n)) for x in range(lowest, min(k, n) + 1)]
        sums = np.cumsum([float(p) for p in share])
        assert draw(m, k, n, steps) == [lowest + int((sums <= (i + 0.5) / 400 * sums[-1]).sum()) for i in range(400)]
    large = np.array(draw(10**9, 3 * 10**8, 5 * 10**8, spark.createDataFrame([(0.5,), (0.84134,), (0.00135,)], "u double").coalesce(1)))
    assert np.abs((large - 1.5e8) / np.sqrt(1.5e8 * 0.7 * 0.5) - [0, 1, -3]).max() < 0.01
    quotas = {"a": 10**9 + 7, "b": 3, "c": 0, "d": 12_345}
    ends = {r["skey"]: r["ends"] for r in mixing.split(spark.createDataFrame(list(quotas.items()), "skey string, quota long"), 8).collect()}
    leaves = np.array([np.diff([0, *ends[s]]) for s in quotas])
    assert (leaves >= 0).all() and [e[-1] for e in ends.values()] and all(ends[s][-1] == q for s, q in quotas.items()) and np.ptp(leaves.sum(0)) <= 3


def test_cut_copies_keep_spaces(spark):
    rows = [(i, f" {i} b\n\nc\td  e f ", "ab"[i % 2], 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    whole = {r[0]: r[1] for r in rows}
    real = rows_of(mixing.realize(docs, share=1.13, part_bytes=64))
    assert all(whole[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in real) and any(r["text"] not in whole.values() for r in real)


URLS = [None, "", "nourl", "http://example.net", "http://example.net/", "https://A.EXAMPLE.NET/en/x?q#f", "http://example.net/enx", "http://u@example.net:80/en/", "http://example.com/de/1", "http://xexample.com/de/1", "http://x.org/fr/", "http://org/fr/a", "http://x.org/FR/", "a://b://c.net/d", "http://x.net?/en/", "http://é.net/é", "http://x.net/a\nb"]


def judged(url: str | None) -> tuple:
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:at].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    path = rest[at:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), h + p, a) for h, p, a in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, "allow")))


@pytest.mark.parametrize("limit", [100_000, 0])
def test_url_filter(spark, monkeypatch, limit):
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", limit)
    pages = spark.createDataFrame([(i % 7, u, "html", 1) for i, u in enumerate(URLS)], "page_id long, url string, html string, digest int")
    got = Counter(tuple(r) for r in rows_of(urlfilter.judge(pages, urlfilter.rules_table(spark))))
    assert got == Counter((i % 7, *judged(u)) for i, u in enumerate(URLS))
    assert not rows_of(urlfilter.judge(pages.limit(0), urlfilter.rules_table(spark)))
