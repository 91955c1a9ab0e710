"""The offline embedder: features hashed to a fixed number of dimensions; and cosine similarity."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from skein import settings as S

#: Offset and factor of 64-bit FNV-1a.
FNV_OFFSET, FNV_FACTOR = 0xCBF29CE484222325, 0x100000001B3
_TOKEN = re.compile(r"[^\W_]+")


def fnv1a64(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = ((h ^ b) * FNV_FACTOR) & 0xFFFFFFFFFFFFFFFF
    return h


def features(text: str) -> dict[str, int]:
    """Words, and 3- and 4-grams of each word between ^ and $, with counts."""
    found: dict[str, int] = {}
    for word in _TOKEN.findall(text):
        marked = f"^{word.lower()}$"
        for gram in (marked[1:-1], *(marked[i : i + n] for n in (3, 4) for i in range(len(marked) - n + 1))):
            found[gram] = found.get(gram, 0) + 1
    return found


class Embedder(Protocol):
    """What turns texts into vectors; an index names the embedder that made it."""

    id: str
    dim: int

    def embed_batch(self, texts: list[str]) -> list[np.ndarray]: ...


def fnv1a64_all(grams: list[bytes]) -> np.ndarray:
    """fnv1a64 of each: one pass over all of them for each place of a byte."""
    sizes = np.fromiter(map(len, grams), np.int64, len(grams))
    order = np.argsort(-sizes, kind="stable")
    data, starts = np.frombuffer(b"".join(grams), np.uint8).astype(np.uint64), (np.cumsum(sizes) - sizes)[order]
    h = np.full(len(grams), FNV_OFFSET, np.uint64)
    ends = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), "left")  # how many are longer than each place
    for i, n in enumerate(ends):
        h[:n] = (h[:n] ^ data[starts[:n] + i]) * np.uint64(FNV_FACTOR)
    out = np.empty_like(h)
    out[order] = h
    return out


def feature_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """fnv1a64 of the features of lower-cased words, repeats counted: word i's lie at offsets[i] to offsets[i + 1]. One pass over all
    characters for each place of a byte."""
    points = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    starts, word = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(points))
    extra = (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)  # UTF-8 bytes after the first
    lead = np.array([0, 0xC0, 0xE0, 0xF0], np.uint64)[extra] | points >> (6 * extra).astype(np.uint64)
    factor = np.uint64(FNV_FACTOR)

    def add(h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """h with the UTF-8 bytes of the characters at ``at`` hashed in."""
        h = (h ^ lead[at]) * factor
        for k in range(int(extra[at].max(initial=0))):
            more = np.flatnonzero(extra[at] > k)
            shift = (6 * (extra[at[more]] - 1 - k)).astype(np.uint64)
            h[more] = (h[more] ^ (np.uint64(0x80) | points[at[more]] >> shift & np.uint64(0x3F))) * factor
        return h

    found, owner = [np.full(len(words), FNV_OFFSET, np.uint64)], [np.arange(len(words))]
    for i in range(int(sizes.max(initial=2)) - 2):
        longer = np.flatnonzero(sizes - 2 > i)
        found[0][longer] = add(found[0][longer], starts[longer] + 1 + i)
    for n in (3, 4):
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), FNV_OFFSET, np.uint64)
        for j in range(n):
            h = add(h, at + j)
        found.append(h), owner.append(word[at])
    of = np.concatenate(owner)
    return np.concatenate(found)[np.argsort(of, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words)))])


class HashEmbedder:
    """Weight 1 + ln(count) with the sign of the hash's last bit, at the place its other bits give; length 1."""

    id, dim = S.EMBEDDER_ID, S.EMBED_DIM
    def embed(self, text: str) -> np.ndarray:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: list[str]) -> list[np.ndarray]:
        return [v for at in range(0, len(texts), 256) for v in self._embed(texts[at : at + 256])]

    def _embed(self, texts: list[str]) -> Iterator[np.ndarray]:
        counted = [Counter(map(str.lower, _TOKEN.findall(t or ""))) for t in texts]
        at = {w: i for i, w in enumerate(dict.fromkeys(w for c in counted for w in c))}
        hashes, offsets = feature_hashes(list(at))
        sizes = np.diff(offsets)
        for counts in counted:
            if not counts:
                yield np.zeros(self.dim)
                continue
            words = np.fromiter((at[w] for w in counts), np.int64, len(counts))
            n = sizes[words]
            h = hashes[np.repeat(offsets[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            h, back = np.unique(h, return_inverse=True)
            weight = 1 + np.log(np.bincount(back, np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), n)))
            v = np.bincount(((h >> np.uint64(1)) % np.uint64(self.dim)).astype(np.int64), np.where(h & np.uint64(1), -weight, weight), self.dim)
            norm = np.sqrt((v * v).sum())
            yield v / norm if norm else v


def embed_column(text: Column, embedder: Embedder | None = None) -> Column:
    """Vectors of a text column, in Arrow batches."""
    embedder = embedder or HashEmbedder()

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([v.astype(np.float32) for v in embedder.embed_batch(texts.fillna("").tolist())], dtype=object)

    return embed(text)


def features_column(text: Column) -> Column:
    """features() of a text column: array of (gram, n)."""

    @F.pandas_udf("map<string,long>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t or "") for t in texts], dtype=object)

    return found(text)


def fnv1a_column(text: Column) -> Column:
    """64-bit FNV-1a of the text's bytes, as a signed number."""

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(fnv1a64_all([(t or "").encode() for t in texts]).view(np.int64))

    return hashed(text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 if one of them is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def encode_vector(v: np.ndarray) -> bytes:
    """Little-endian 32-bit floats."""
    return np.asarray(v, "<f4").tobytes()


def decode_vector(blob: bytes) -> np.ndarray:
    """A trailing part of a float is dropped."""
    return np.frombuffer(blob[: len(blob) // 4 * 4], "<f4")
