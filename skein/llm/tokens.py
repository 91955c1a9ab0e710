"""Token ids of whole texts, by the tokenizers library with a cache of pieces between white space."""

from __future__ import annotations

import os
import re

import numpy as np

from .shared import _CACHES

#: No piece of a text longer than this is kept in the cache.
LONGEST_CACHED = 48
#: Pieces in the cache at most; then it starts anew.
CACHE_LIMIT = 1_200_000
#: Pieces that one call of the library encodes.
LEARN = 1_000
#: Pieces of texts that wait for others to be encoded, at most (but for those of one text).
HELD = 1 << 18
_L, _P = "A-Za-zÀ-ÖØ-öø-ÿ", r"!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"
_PLAIN = rf" ?[{_L}]+| ?[0-9]+| ?[{_P}]+|[ \n]+(?![^ \n])|[ \n]+"
#: Letters, digits, signs and white space by themselves, as both patterns cut them; with other characters in the text, a run of white space and what follows it whole if it has some of these.
_PIECES = re.compile(_PLAIN)
_ANY_PIECES = re.compile(rf"[ \n]*[{_L}0-9{_P}]*[^ \n{_L}0-9{_P}][^ \n]*|{_PLAIN}")
_OTHER = re.compile(rf"[^ \n{_L}0-9{_P}]")
_LETTERS = re.compile(rf" ?[{_L}]+").fullmatch
#: White space other than space and newline, or what one of the libraries may take for it.
_ODD_SPACE = re.compile("[^\\S \n]|᠎|\u200b|\ufeff|\x00")
_LOADED: dict[str, Encoder] = {}


class Encoder(dict):
    """ids(text): little-endian unsigned 32-bit token ids as bytes, equal to tokenizers' on the whole text.

    These tokenizers' patterns never join white space to what stands before it, so that a text cut before each run of
    white space has the same ids. A text with other white space than space and newline, or with the string of an added
    token, is encoded whole. This is checked for the tokenizer's pre-tokenizer when it is loaded: one that isn't known to
    have the property encodes every text whole.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        pre = spec.get("pre_tokenizer") or {}
        parts = pre.get("pretokenizers", [pre])
        norm = (spec.get("normalizer") or {}).get("normalizers", [])
        byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
        split = parts[0].get("type") == "Split" and parts[0].get("invert") and {x["type"] for x in norm} <= {"NFC", "Replace", "Lowercase"}
        self.cuts = bool(byte_level or split)
        #: Stands between pieces of letters when many are encoded at once; its one id occurs in none of them.
        self.mark, self.mark_id = "", -1
        for mark in ("\n", " ! "):
            got = self.tokenizer.encode(f"ab{mark}ab{mark} ab", add_special_tokens=False).ids
            a, b = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("ab", " ab"))
            if self.cuts and len(got) == 2 * len(a) + len(b) + 2 and got == [*a, got[len(a)], *a, got[len(a)], *b]:
                self.mark, self.mark_id = mark, got[len(a)]
                break

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that the cache lacks, in few calls; the cache takes the short ones."""
        new: dict[str, bytes] = {}
        plain = list(filter(_LETTERS, pieces)) if self.mark else []
        for at in range(0, len(plain), LEARN):
            part = plain[at : at + LEARN]
            (got,) = self.tokenizer.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)
            self._put(new, part, got.ids, lambda ids: np.append(np.flatnonzero(ids == self.mark_id), len(ids)), 1)
        todo = list(pieces.difference(new)) if len(new) < len(pieces) else []
        for at in range(0, len(todo), LEARN):
            part = todo[at : at + LEARN]
            (got,) = self.tokenizer.encode_batch([part], is_pretokenized=True, add_special_tokens=False)
            self._put(new, part, got.ids, lambda _: np.searchsorted(np.asarray(got.word_ids, np.int64), np.arange(len(part)), "right"), 0)
        if len(self) + len(new) > CACHE_LIMIT:
            self.clear()
        if len(max(new, key=len, default="")) <= LONGEST_CACHED:
            self.update(new)
        else:
            self.update((k, v) for k, v in new.items() if len(k) <= LONGEST_CACHED)
        return new

    @staticmethod
    def _put(new: dict[str, bytes], part: list[str], ids: list[int], ends, gap: int) -> None:
        ids = np.asarray(ids, "<u4")
        to = ends(ids) * 4
        starts = np.append(0, to[:-1] + 4 * gap)
        new.update(zip(part, map(ids.tobytes().__getitem__, map(slice, starts.tolist(), to.tolist()))))

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        return self.batch([text])[0]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Of each text its ids, as little-endian unsigned 32-bit numbers; none for null and empty texts."""
        out: list[bytes] = []
        some: list[tuple[int, list[str], list[bytes | None]]] = []
        lacking: set[str] = set()
        get, held = self.get, 0

        def join() -> None:
            new = self.learn(lacking)
            for i, pieces, ids in some:
                out[i] = b"".join([new[p] if x is None else x for p, x in zip(pieces, ids)])
            some.clear()
            lacking.clear()

        for text in texts:
            out.append(b"")
            if not text:
                continue
            other = _OTHER.search(text)
            if not self.cuts or other and _ODD_SPACE.search(text) or any(a in text for a in self.added):
                out[-1] = self.whole(text)
                continue
            pieces = (_ANY_PIECES if other else _PIECES).findall(text)
            ids = list(map(get, pieces))
            if None in ids:
                some.append((len(out) - 1, pieces, ids))
                lacking.update([p for p, x in zip(pieces, ids) if x is None])
                held += len(pieces)
                if len(lacking) >= 4 * LEARN or held >= HELD:
                    join()
                    held = 0
            else:
                out[-1] = b"".join(ids)
        if some:
            join()
        return out


def encoder(path: str) -> Encoder:
    """One for each path and process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
        _CACHES.append(_LOADED[path])
    return _LOADED[path]
