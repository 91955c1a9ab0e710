"""Markdown parsing: front matter, chunks by heading, links. Plain functions, and columns that run them in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from urllib.parse import unquote_to_bytes

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein import settings as S

FRONT_MATTER = "title string, type string, description string, aliases array<string>, tags array<string>, created string, updated string, body string, error string"
CHUNKS = "array<struct<heading_path string, text string>>"
LINKS = "array<struct<dst_slug string, edge_type string, anchor_text string>>"
_CLOSERS = ("\n---\n", "\n---\r\n", "\r\n---\r\n", "\r\n---\n")
_HEADING = re.compile(r"(#{1,6}) (.*)", re.S)
_MD, _ANGLE, _WIKI = (re.compile(p) for p in (S.MD_LINK, S.MD_LINK_ANGLE, S.WIKILINK))
_QUOTE = re.compile(S.TYPED_QUOTE, re.M | re.I)
_RULES = [(name, re.compile(p, re.I)) for name, p in S.EDGE_RULES]
_HEDGES = re.compile(S.HEDGES, re.I)
_HEX = re.compile(r"%(?=[0-9A-Fa-f]{2})")


def split_front_matter(content: str) -> tuple[str | None, str]:
    """(YAML or None, body). It begins on the first line; of the closing forms the first in _CLOSERS that occurs ends it."""
    opening = next((o for o in ("---\r\n", "---\n") if content.startswith(o)), None)
    if opening is None:
        return None, content
    rest = content[len(opening) :]
    for closer in _CLOSERS:
        head, found, body = rest.partition(closer)
        if found:
            return head, body
    for closer in ("\n---", "\r\n---"):
        if rest.endswith(closer):
            return rest[: -len(closer)], ""
    return None, content


@cache
def _loader():
    """A YAML loader that knows null, booleans and numbers, and leaves dates as text; doubled keys are errors. Made once in a process."""
    import yaml

    class Loader(yaml.SafeLoader):
        yaml_implicit_resolvers: dict = {}

        def construct_mapping(self, node, deep=False):
            keys = [self.construct_object(k, deep=True) for k, _ in node.value]
            if len(set(map(repr, keys))) < len(keys):
                raise yaml.YAMLError("duplicate entry in mapping")
            return super().construct_mapping(node, deep)

    for tag, pattern, first in (
        ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
        ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
        ("int", r"^[-+]?[0-9]+$", list("-+0123456789")),
        ("float", r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$", list("-+0123456789.")),
    ):
        Loader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), first)
    Loader.add_constructor("tag:yaml.org,2002:int", lambda loader, node: int(node.value))
    return Loader


def _scalar(v: object) -> str | None:
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, (str, int, float)) else None


def parse_front_matter(content: str | None) -> dict:
    """The fields of FRONT_MATTER; error instead of fields if the YAML isn't a readable mapping."""
    head, body = split_front_matter(content or "")
    out: dict = dict.fromkeys(("title", "type", "description", "created", "updated", "error")) | {"aliases": [], "tags": [], "body": body}
    if head is None or not head.strip():
        return out
    import yaml

    try:
        fields = yaml.load(head, _loader())  # noqa: S506  a subclass of SafeLoader
    except (yaml.YAMLError, ValueError, TypeError) as e:
        return out | {"error": str(e)}
    if fields is None:
        return out
    if not isinstance(fields, dict):
        return out | {"error": "front matter is not a mapping"}
    for name in ("title", "type", "description", "created", "updated"):
        out[name] = _scalar(fields.get(name))
    for name in ("aliases", "tags"):
        v = fields.get(name)
        out[name] = [s for x in (v if isinstance(v, list) else [v]) if (s := _scalar(x)) is not None]
    return out


def _is_fence(line: str) -> bool:
    return line.lstrip().startswith(("```", "~~~"))


def _lines(text: str) -> list[str]:
    found = text.split("\n")
    return [x.removesuffix("\r") for x in (found[:-1] if found and not found[-1] else found)]


def parse_heading(line: str) -> tuple[int, str] | None:
    """(level, title) of a heading: 1 to 6 signs in the first column, a space, a title."""
    m = _HEADING.fullmatch(line)
    return (len(m[1]), m[2].strip()) if m and m[2].strip() else None


def pack_paragraphs(text: str) -> list[str]:
    """Paragraphs (no blank line within; fenced ones whole) packed in order into pieces of about CHUNK_TARGET bytes."""
    paragraphs, now, fenced = [], [], False
    for line in [*_lines(text), None]:
        if line is not None and _is_fence(line):
            fenced = not fenced
        if line is None or (not line.strip() and not fenced):
            if "".join(now).strip():
                paragraphs.append("\n".join(now).rstrip())
            now = []
        else:
            now.append(line)
    pieces: list[str] = []
    size = 0
    for p in paragraphs:
        n = len(p.encode())
        if pieces and size + n <= S.CHUNK_TARGET:
            pieces[-1] += f"\n\n{p}"
            size += n + 2
        else:
            pieces.append(p)
            size = n + 2
    return pieces


def chunk(body: str) -> list[tuple[str, str]]:
    """(heading path, text) of each section with text; long ones in pieces."""
    found: list[tuple[str, str]] = []
    path: list[tuple[int, str]] = []
    now: list[str] = []
    fenced = False

    def close() -> None:
        text = "\n".join(now).strip()
        if text:
            names = " > ".join(h for _, h in path)
            found.extend((names, p) for p in ([text] if len(text.encode()) <= S.CHUNK_MAX else pack_paragraphs(text)))
        now.clear()

    for line in _lines(body):
        heading = None if fenced or _is_fence(line) else parse_heading(line)
        if _is_fence(line):
            fenced = not fenced
        if heading is None:
            now.append(line)
            continue
        close()
        while path and path[-1][0] >= heading[0]:
            path.pop()
        path.append(heading)
    close()
    return found


def scrub_code(body: str) -> str:
    """Code blocks, fenced or between backticks of a line, as spaces."""
    out, fenced = [], False
    for line in re.findall(r"[^\n]*\n|[^\n]+", body):
        if _is_fence(line):
            fenced = not fenced
            out.append(re.sub(r"[^\n]", " ", line))
        elif fenced:
            out.append(re.sub(r"[^\n]", " ", line))
        else:
            out.append(re.sub(r"`[^`\n]*(?:`|(?=\n)|$)", lambda m: " " * len(m[0]), line))
    return "".join(out)


def percent_decode(s: str) -> str:
    """%XX as bytes; what isn't an escape stays, and bytes that aren't UTF-8 are replaced."""
    if not _HEX.search(s):
        return s
    return unquote_to_bytes(s).decode("utf-8", "replace")


def normalize_slug(directory: str, target: str, beside: bool) -> str | None:
    """The slug that a link's target means, or None if it's no document.

    beside: whether a bare name stands beside the linking document (markdown links) or anywhere (wiki links).
    """
    t = target.strip()
    if t.startswith("<") and t.endswith(">") and len(t) > 1:
        t = t[1:-1].strip()
    t = percent_decode(t).strip()
    if not t or t.startswith(("#", "mailto:")) or "://" in t:
        return None
    t = t.replace("\\", "/").split("#", 1)[0].removesuffix(".md")
    if not t:
        return None
    relative = t.startswith(("./", "../")) or ("/" not in t and beside)
    parts = [p for p in directory.split("/") if p] if relative else []
    for part in t.split("/"):
        if part == "..":
            if not parts:
                return None
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    return "/".join(parts) or None


def infer_edge(sentence: str) -> str:
    for name, pattern in _RULES:
        if m := pattern.search(sentence):
            before = sentence[: m.start()]
            if not _HEDGES.search(re.split(r"[,;:.]", before)[-1]):
                return name
    return "mentions"


def sentence_around(text: str, at: int) -> str:
    """The sentence that holds place ``at``, no more than 150 bytes to each side."""
    left = re.split(r"[.!?\n]", text[max(0, at - 150) : at])[-1]
    right = re.split(r"[.!?\n]", text[at : at + 150], maxsplit=1)[0]
    cut = left.encode()[-150:].decode("utf-8", "ignore") if len(left.encode()) > 150 else left
    if len(cut.encode()) < 150 and len(left.encode()) > 150:
        cut = left[-len(cut) - 1 :]  # a character that the limit would split is taken whole
    tail = right.encode()
    if len(tail) > 150:
        right = tail[:150].decode("utf-8", "ignore")
    return cut + right


def extract_links(body: str, directory: str) -> list[tuple[str, str, str]]:
    """(slug, edge type, anchor text) of each link, in order of finding: typed quotes, angle links, links, wiki links."""
    text = scrub_code(body)
    out: list[tuple[str, str, str]] = []
    typed: set[tuple[str, str]] = set()
    for m in _QUOTE.finditer(text):
        slug = normalize_slug(directory, m[3], True)
        if slug and (slug, kind := m[1].lower()) not in typed:
            typed.add((slug, kind))
            out.append((slug, kind, m[2]))
    seen = {slug for slug, _ in typed}

    def take(anchor: str, target: str, at: int, beside: bool) -> None:
        slug = normalize_slug(directory, target, beside)
        if slug and slug not in seen:
            seen.add(slug)
            out.append((slug, infer_edge(sentence_around(text, at)), anchor))

    for pattern in (_ANGLE, _MD):
        for m in pattern.finditer(text):
            if text[m.start() - 1 : m.start()] != "!":
                take(m[1], m[2], m.start(), True)
    for m in _WIKI.finditer(text):
        take(m[2] or m[1].strip(), m[1].strip(), m.start(), False)
    return out


def front_matter_column(content: Column) -> Column:
    """Fields of texts. Not deterministic for Spark, so that a condition on a field doesn't parse all texts once more."""

    @F.pandas_udf(FRONT_MATTER)
    def parsed(texts: pd.Series) -> pd.DataFrame:
        names = [f.split()[0] for f in FRONT_MATTER.split(", ")]
        return pd.DataFrame([parse_front_matter(t) for t in texts], columns=names)

    return parsed.asNondeterministic()(content)


def heading_column(line: Column) -> Column:
    """level and heading of a line; null if it is none. Not deterministic for Spark, as front_matter_column."""

    @F.pandas_udf("level long, heading string")
    def found(lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_heading(x or "") or (None, None) for x in lines], columns=["level", "heading"]).astype({"level": "Int64"})

    return found.asNondeterministic()(line)


def chunks_column(body: Column) -> Column:
    @F.pandas_udf(CHUNKS)
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"heading_path": h, "text": t} for h, t in chunk(x or "")] for x in texts], dtype=object)

    return cut(body)


def links_column(body: Column, directory: Column) -> Column:
    @F.pandas_udf(LINKS)
    def linked(texts: pd.Series, dirs: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("dst_slug", "edge_type", "anchor_text"), x)) for x in extract_links(t or "", d or "")] for t, d in zip(texts, dirs)], dtype=object)

    return linked(body, directory)


def slug_column(directory: Column, target: Column, beside: bool) -> Column:
    @F.pandas_udf("string")
    def slug(dirs: pd.Series, targets: pd.Series) -> pd.Series:
        return pd.Series([normalize_slug(d or "", t or "", beside) for d, t in zip(dirs, targets)], dtype=object)

    return slug(directory, target)


#: Texts whose pieces a task holds at once.
TEXTS_AT_ONCE = 128


def pieces(docs: DataFrame) -> DataFrame:
    """(doc_id, piece, text) of docs (doc_id, text): pieces from 0, none of empty texts. A task holds those of TEXTS_AT_ONCE texts, besides
    the batch that Spark sends, which its own limit of bytes bounds."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                found = [(i, k, p) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for k, p in enumerate(pack_paragraphs(t or ""))]
                yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], ["doc_id", "piece", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece long, text string")


def yaml_quote(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
