"""A vault from files to answers."""

from __future__ import annotations

import os
from datetime import UTC, datetime

import pytest

from skein.functions.embedding import HashEmbedder
from skein.kb import DocNotFound, EmbedderMismatch, KnowledgeBase, NotInitialized

AS_OF = "2026-06-13 00:00:00"
NOW = datetime(2026, 6, 13, tzinfo=UTC)


def page(title: str, body: str, kind: str | None = None, aliases: str | None = None, updated: str | None = None) -> str:
    fields = {"title": title, "type": kind, "aliases": aliases, "updated": updated}
    return "---\n" + "".join(f"{k}: {v}\n" for k, v in fields.items() if v) + f"---\n{body}\n"


VAULT = {
    "people/alice-chen": page("Alice Chen", "# Work\nAlice runs engineering at [Acme](../companies/acme-corp.md), which lends.\n\n# Past\nShe founded [Beta](../companies/beta-labs.md) earlier.", "person", "[Ali]", "2026-06-10"),
    "people/bob-roe": page("Bob Roe", "Bob invested in [Acme](../companies/acme-corp.md) early.\nHe attended [[events/demo-day|the demo]] too.", "person", None, "2026-01-02"),
    "people/carol-old": page("Carol Old", "Carol works at [Acme](../companies/acme-corp.md) as a lawyer.", "person", None, "2025-11-01"),
    "companies/acme-corp": page("Acme Corp", "Acme Corp builds payment rails. Talks about the 500-seat price go on.\n\n> **competitor_of:** as told in [Zenith](zenith-pay.md).", "company", "[Acme]", "2026-06-01"),
    "companies/beta-labs": page("Beta Labs", "Beta Labs makes tools to measure retrieval.", "company", None, "2026-05-20"),
    "events/demo-day": page("Demo Day", "Demos in spring; Bob spoke last.", "event", None, "2026-04-01"),
    "concepts/retrieval": page("Retrieval Quality", "On hybrid retrieval: lexical ranks, vectors, graphs, fusion.", "concept", None, "2026-06-12"),
    "chat/2026-06-12-log": page("Chat Log June 12", "Talked about price. Acme was named once.", None, None, "2026-06-12"),
    "test/scratch": page("Scratch", "Acme Acme Acme, never to be found."),
}


def put(root, slug: str, content: str | bytes) -> None:
    path = os.path.join(root, f"{slug}.md")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("vault"))
    for slug, content in VAULT.items():
        put(root, slug, content)
    base = KnowledgeBase.init(spark, root)
    base.first = base.sync(NOW)
    return base


def test_sync_counts_and_is_idempotent(kb):
    assert (kb.first.scanned, kb.first.added, kb.first.errors) == (9, 9, [])
    again = kb.sync(NOW)
    assert (again.unchanged, again.added, again.updated, again.deleted) == (9, 0, 0, 0)


def test_links_and_stats(kb):
    got = {(r["src"], r["edge_type"], r["dst_slug"], r["dst_doc_id"] is None) for r in kb.table("links").join(kb.table("docs").selectExpr("id as src_doc_id", "slug as src"), "src_doc_id").collect()}
    assert got == {
        ("people/alice-chen", "works_at", "companies/acme-corp", False), ("people/alice-chen", "founded", "companies/beta-labs", False),
        ("people/bob-roe", "invested_in", "companies/acme-corp", False), ("people/bob-roe", "attended", "events/demo-day", False),
        ("people/carol-old", "works_at", "companies/acme-corp", False), ("companies/acme-corp", "competitor_of", "companies/zenith-pay", True),
    }
    s = kb.stats()
    assert (s["docs"], s["deleted_docs"], s["chunks"], s["links"], s["dangling_links"]) == (9, 0, 10, 6, 1)
    assert s["links_by_type"][0] == ("works_at", 2) and s["docs_by_source"][:2] == [("people", 3), ("companies", 2)]


def test_search(kb):
    assert kb.intent("Acme Corp") == "entity"
    hits = kb.search("Acme Corp", as_of=AS_OF).collect()
    assert (hits[0]["slug"], hits[0]["evidence"]) == ("companies/acme-corp", "exact_title_match")
    top = kb.search("Acme", as_of=AS_OF).collect()
    assert (top[0]["slug"], top[0]["evidence"]) == ("companies/acme-corp", "alias_hit")
    assert "test/scratch" not in {h["slug"] for h in hits + top}
    assert [h["rank"] for h in hits] == list(range(1, len(hits) + 1))
    assert kb.search("retreival", as_of=AS_OF).first()["slug"] == "concepts/retrieval"  # one typo
    assert len(kb.search("Acme", limit=2, as_of=AS_OF).collect()) == 2
    with pytest.raises(ValueError):
        kb.search("Acme", mode="fast", as_of=AS_OF)


def test_graph(kb):
    edges = {(r["src_slug"], r["edge_type"], r["dst_slug"], r["hop"]) for r in kb.graph("Ali", hops=2).collect()}
    assert edges == {
        ("people/alice-chen", "works_at", "companies/acme-corp", 1), ("people/alice-chen", "founded", "companies/beta-labs", 1),
        ("people/bob-roe", "invested_in", "companies/acme-corp", 2), ("people/carol-old", "works_at", "companies/acme-corp", 2),
        ("companies/acme-corp", "competitor_of", "companies/zenith-pay", 2),
    }
    assert {r["edge_type"] for r in kb.graph("alice chen", "works_at", 3).collect()} == {"works_at"}
    with pytest.raises(DocNotFound):
        kb.graph("Nobody")


def test_think(kb):
    facts, gaps = kb.think("Acme Corp and Zara Quinn", as_of=AS_OF)
    assert facts.first()["slug"] == "companies/acme-corp"
    messages = {(r["kind"], r["message"]) for r in gaps.collect()}
    assert ("unknown_entity", 'No doc exists for "Zara Quinn".') in messages
    assert any(k == "dangling_link" and "zenith-pay" in m for k, m in messages)
    assert any(k == "stale_doc" and "(people/carol-old) since 2025-11-01 (32 weeks ago)" in m for k, m in messages)
    _, none = kb.think("Should We Acquire qqqqq", as_of=AS_OF)
    assert {r["kind"] for r in none.collect()} >= {"low_confidence"} and not none.where("kind = 'unknown_entity'").collect()


def test_open_errors(spark, kb, tmp_path):
    with pytest.raises(NotInitialized):
        KnowledgeBase.open(spark, str(tmp_path))
    other = HashEmbedder()
    other.id = "other"
    with pytest.raises(EmbedderMismatch):
        KnowledgeBase.open(spark, kb.root, other)


def test_changes(spark, tmp_path):
    root = str(tmp_path)
    for slug in ("people/alice-chen", "companies/acme-corp", "companies/beta-labs"):
        put(root, slug, VAULT[slug])
    put(root, "docs/api/index", page("API", "The interface."))
    put(root, "docs/guide", "See [[docs/api]] and [[Only Title]].")
    base = KnowledgeBase.init(spark, root)
    base.sync(NOW)
    to = {r["dst_slug"]: r["dst_doc_id"] for r in base.table("links").collect()}
    assert to["docs/api"] is not None and to["Only Title"] is None
    # a rename takes links along; bad files are reported and stay live; a new title resolves
    os.makedirs(os.path.join(root, "orgs"))
    os.rename(os.path.join(root, "companies/acme-corp.md"), os.path.join(root, "orgs/acme.md"))
    put(root, "companies/beta-labs", b"\xff\xfe broken")
    put(root, "bad", "---\ntitle: [open\n---\nx")
    put(root, "huge", b"x" * (5 * 1024 * 1024 + 1))
    put(root, "x/only", page("Only Title", ""))
    report = base.sync(NOW)
    assert report.renamed == 1 and report.deleted == 1 and len(report.errors) == 3
    rows = {r["slug"]: r for r in base.table("docs").collect()}
    assert rows["companies/beta-labs"]["deleted_at"] is None and "huge" not in rows and "bad" not in rows
    to = {r["dst_slug"]: r["dst_doc_id"] for r in base.table("links").collect()}
    assert to["orgs/acme"] == rows["orgs/acme"]["id"] and to["Only Title"] == rows["x/only"]["id"]
    assert base.search("only title", as_of=AS_OF).first()["slug"] == "x/only"
    # captures in one second have distinct slugs and titles without line breaks
    a, b = (base.capture('buy "milk"', title='a\n"quoted" title', now=NOW) for _ in range(2))
    assert b == f"{a}-2" and base.doc(a)["title"] == 'a "quoted" title'
    # a deleted file goes, and comes back under the same id
    os.remove(os.path.join(root, "people/alice-chen.md"))
    assert base.sync(NOW).deleted == 1
    with pytest.raises(DocNotFound):
        base.doc("people/alice-chen") if base.doc("people/alice-chen")["deleted_at"] is None else (_ for _ in ()).throw(DocNotFound())
    put(root, "people/alice-chen", VAULT["people/alice-chen"])
    assert base.sync(NOW).added == 1
    assert base.doc("Ali")["id"] == rows["people/alice-chen"]["id"]


def test_validate(spark, tmp_path):
    root = str(tmp_path)
    put(root, "a", "---\ntitle: A\ndescription: d\ntype: note\n---\n")
    put(root, "b", "---\ntitle: B\ndescription: d\n---\n")
    put(root, "c", "---\ntitle: C\ndescription: d\ntype: thing\n---\n")
    put(root, "inbox/d", "no fields")
    base = KnowledgeBase.init(spark, root)
    got = {r["path"]: r["message"] for r in base.validate().collect()}
    assert got["a.md"] is None and got["b.md"] == "missing required field(s): type" and got["c.md"].startswith("invalid type 'thing'; must be one of: note,")
    assert len(got) == 3
    assert base.validate(since="2999-01-01T00:00:00Z").count() == 0 and base.validate(since="1999-01-01T00:00:00Z").count() == 3
    assert base.validate(path="b.md").count() == 1
