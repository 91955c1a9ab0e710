"""Scalar functions on text as Column expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein import settings as S

Text = Column | str


def _col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Text) -> Column:
    """Without white space (of any kind) at both ends."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def ascii_lower(c: Text) -> Column:
    """Case folding of A-Z alone, as keys of names are compared."""
    return F.translate(_col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokenize(c: Text) -> Column:
    """Lower-cased maximal runs of letters and digits; cut before lower-casing."""
    return F.transform(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"[\p{IsAlphabetic}\p{N}]+"), F.lit(0)), F.lower)


def allowed_typos(word: Text) -> Column:
    n = F.length(_col(word))
    return F.when(n <= 4, 0).when(n <= 8, 1).otherwise(2)


def bounded_levenshtein(a: Text, b: Text, most: Column | int) -> Column:
    """Edit distance, null above ``most``. Lengths alone rule most pairs out."""
    a, b, most = _col(a), _col(b), F.lit(most) if isinstance(most, int) else most
    d = F.levenshtein(a, b)
    return F.when((F.abs(F.length(a) - F.length(b)) <= most) & (d <= most), d)


def stem(word: Text) -> Column:
    """The first suffix rule whose base keeps three characters."""
    w = _col(word)

    def rule(rest: Column, pair: tuple[str, str]) -> Column:
        suffix, instead = pair
        base = F.substring(w, F.lit(1), F.length(w) - len(suffix))
        return F.when(w.endswith(suffix) & (F.length(w) - len(suffix) >= 3), F.concat(base, F.lit(instead))).otherwise(rest)

    return reduce(rule, reversed(S.STEM_RULES), w)


def token_estimate(c: Text) -> Column:
    return F.floor(F.octet_length(_col(c)) / 4).cast("long")


def snippet(c: Text) -> Column:
    """Trimmed; beyond SNIPPET_BYTES cut at a character and marked by an ellipsis."""
    t = trim(c)
    head = F.make_valid_utf8(F.substring(F.encode(t, "UTF-8"), 1, S.SNIPPET_BYTES).cast("string"))
    return F.when(F.octet_length(t) <= S.SNIPPET_BYTES, t).otherwise(F.concat(F.regexp_replace(head, "�+$", ""), F.lit("…")))


def lead_sentences(c: Text, n: int) -> Column:
    """The trimmed text through its n-th end of sentence; all of it if there are fewer."""
    t = _col(c)
    head = F.regexp_extract(t, rf"^(?s)(?:[^.!?]*[.!?]){{{n}}}", 0)
    return trim(F.when(head == "", t).otherwise(head))


def title_from_slug(c: Text) -> Column:
    """The last part of the slug in words, each with a capital first letter, the rest as it is."""
    words = F.split(F.regexp_replace(F.element_at(F.split(_col(c), "/"), -1), "[-_]", " "), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), " ")


def slug_for(path: Text) -> Column:
    """Of a path relative to the root: / for \\, without the extension md in any case."""
    return F.regexp_replace(F.translate(_col(path), "\\", "/"), r"(?i)\.md$", "")


def source_dir(slug: Text) -> Column:
    return F.split(_col(slug), "/")[0]


def derive_title(c: Text) -> Column:
    """Up to eight words, and 60 characters, of the first line that isn't blank."""
    line = F.try_element_at(F.filter(F.split(_col(c), "\n"), lambda x: x.rlike(r"(?U)\S")), F.lit(1))
    words = F.slice(F.split(trim(line), r"(?U)\s+"), 1, 8)
    title = F.substring(F.array_join(words, " "), 1, 60)
    return F.coalesce(F.nullif(title, F.lit("")), F.lit("Captured note"))


def sanitize_title(c: Text) -> Column:
    flat = trim(F.regexp_replace(F.regexp_replace(_col(c), r"\p{Cc}", " "), r"(?U)\s+", " "))
    return F.coalesce(F.nullif(flat, F.lit("")), F.lit("Captured note"))


def slugify(c: Text) -> Column:
    flat = F.regexp_replace(F.regexp_replace(F.lower(_col(c)), r"[^\p{IsAlphabetic}\p{N}]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(flat, F.lit("")), F.lit("note"))


def when_updated(c: Text) -> Column:
    """A timestamp of an RFC 3339 time or a plain date; null for all else."""
    t = _col(c)
    rfc = t.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    day = t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")
    return F.when(rfc, F.try_to_timestamp(F.upper(t))).when(day, F.try_to_timestamp(F.concat(t, F.lit(" +00:00")), F.lit("yyyy-M-d XXX")))


def age_days(updated: Text, as_of: Text) -> Column:
    """Whole hours between the two, in days, at least 0; null without a readable date."""
    seconds = F.unix_timestamp(_col(as_of)) - F.unix_timestamp(when_updated(updated))
    return F.when(seconds.isNotNull(), F.greatest(F.floor(seconds / 3600) / 24.0, F.lit(0.0)))


def titlecase_spans(c: Text) -> Column:
    """Runs of words with a capital first letter: array of strings."""
    words = F.filter(F.split(F.coalesce(_col(c), F.lit("")), r"(?U)\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", ""))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, w: Column) -> Column:
        grown = F.when(acc["now"] == "", w).otherwise(F.concat(acc["now"], F.lit(" "), w))
        closed = F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))
        up = w.rlike(r"^\p{IsUppercase}")
        return F.struct(F.when(up, acc["done"]).otherwise(closed).alias("done"), F.when(up, grown).otherwise("").alias("now"))

    return F.aggregate(bare, start, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def classify_intent(query: Text, known: Column) -> Column:
    """entity, temporal, event or general; known: whether a capitalised run of the query names a document."""
    q = _col(query)
    few = F.size(F.filter(F.split(q, r"(?U)\s+"), lambda w: w != "")) <= 6
    is_ = lambda pattern: q.rlike(f"(?iU){pattern}")
    return F.when(is_(S.ENTITY_LEAD) | (few & known), "entity").when(is_(S.TEMPORAL), "temporal").when(is_(S.EVENT), "event").otherwise("general")


def edge_type(sentence: Text) -> Column:
    """The first rule whose first match has no hedge before it in its clause; else mentions."""
    s = _col(sentence)
    out = F.lit("mentions")
    for name, pattern in reversed(S.EDGE_RULES):
        at = F.regexp_instr(s, F.lit(f"(?iU){pattern}"))
        clause = F.regexp_extract(F.substring(s, F.lit(1), at - 1), r"(?s)[^,;:.]*$", 0)
        out = F.when((at > 0) & ~clause.rlike(f"(?iU){S.HEDGES}"), name).otherwise(out)
    return out


def tier_factor(directory: Text, temporal: Column | bool) -> Column:
    d, temporal = _col(directory), F.lit(temporal) if isinstance(temporal, bool) else temporal
    out = F.when(d.isin(*S.BOOSTED_DIRS), S.BOOST).when(temporal & d.isin(*S.TEMPORAL_DIRS), 1.0)
    for name, factor in S.DEMOTED_DIRS.items():
        out = out.when(d == name, factor)
    return out.otherwise(1.0)


def front_matter_issue(title: Text, description: Text, kind: Text) -> Column:
    """What is wrong with a document's fields; null if nothing."""
    fields = (("title", title), ("description", description), ("type", kind))
    blank = lambda c: F.coalesce(trim(c), F.lit("")) == ""
    missing = F.array_join(F.filter(F.array(*(F.when(blank(c), n) for n, c in fields)), lambda x: x.isNotNull()), ", ")
    bad = F.concat(F.lit("invalid type '"), trim(kind), F.lit(f"'; must be one of: {', '.join(S.VALID_TYPES)}"))
    return F.when(missing != "", F.concat(F.lit("missing required field(s): "), missing)).when(~trim(kind).isin(*S.VALID_TYPES), bad)
