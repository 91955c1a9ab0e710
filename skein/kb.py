"""A knowledge base: a folder of markdown files and its tables as Parquet snapshots.

``<root>/.skein/meta.json`` names the current snapshot ``v=N``; a sync writes all tables of the next one and then replaces
meta.json in one step, so that readers see one whole snapshot or the other.
"""

from __future__ import annotations

import json
import os
import shutil
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import settings as S
from skein.functions import embedding as E
from skein.functions import markdown as M
from skein.functions import text as T
from skein.operators import corpus as C
from skein.operators import search, sync, think
from skein.operators.corpus import Corpus
from skein.sources import vault

TABLES = {
    "docs": "id long, slug string, title string, doc_type string, source_dir string, tags array<string>, aliases array<string>, content_hash string, created_at string, updated_at string, synced_at string, deleted_at string, body string",
    "aliases": "doc_id long, alias string, alias_key string",
    "chunks": "id long, doc_id long, chunk_index int, heading_path string, text string, embedding array<float>",
    "links": "src_doc_id long, dst_slug string, dst_doc_id long, edge_type string, anchor_text string",
    "postings": "word string, chunk_id long, attr int, pos long",
    "words": "word string, n long",
}


SCHEMA_VERSION = 2


class KnowledgeError(Exception):
    """Base of the errors below."""


class NotInitialized(KnowledgeError):
    pass


class EmbedderMismatch(KnowledgeError):
    pass


class SchemaMismatch(KnowledgeError):
    pass


class DocNotFound(KnowledgeError):
    pass


@dataclass
class SyncReport:
    scanned: int = 0
    added: int = 0
    updated: int = 0
    unchanged: int = 0
    deleted: int = 0
    renamed: int = 0
    resolved_links: int = 0
    errors: list[tuple[str, str]] = field(default_factory=list)


class KnowledgeBase:
    def __init__(self, spark: SparkSession, root: str, meta: dict, embedder: E.Embedder):
        self.spark, self.root, self.meta, self.embedder = spark, root, meta, embedder
        self._cache: dict[tuple, object] = {}

    # -- storage

    @classmethod
    def init(cls, spark: SparkSession, root: str, embedder: E.Embedder | None = None) -> KnowledgeBase:
        """Makes the tables if there are none, and keeps them out of version control."""
        embedder = embedder or E.HashEmbedder()
        home = os.path.join(root, ".skein")
        if not os.path.exists(os.path.join(home, "meta.json")):
            os.makedirs(home, exist_ok=True)
            for name, schema in TABLES.items():
                spark.createDataFrame([], schema).write.parquet(f"{home}/v=0/{name}")
            cls._put_meta(home, {"schema_version": SCHEMA_VERSION, "embedder_id": embedder.id, "dim": embedder.dim, "snapshot": 0, "last_synced_at": None})
        ignore = os.path.join(root, ".gitignore")
        lines = open(ignore, encoding="utf-8").read().splitlines() if os.path.exists(ignore) else []
        if ".skein/" not in lines:
            with open(ignore, "a", encoding="utf-8") as f:
                f.write(".skein/\n")
        return cls.open(spark, root, embedder)

    @classmethod
    def open(cls, spark: SparkSession, root: str, embedder: E.Embedder | None = None) -> KnowledgeBase:
        embedder = embedder or E.HashEmbedder()
        path = os.path.join(root, ".skein", "meta.json")
        if not os.path.exists(path):
            raise NotInitialized(f"no knowledge base at {root}")
        with open(path, encoding="utf-8") as f:
            meta = json.load(f)
        if meta["schema_version"] != SCHEMA_VERSION:
            raise SchemaMismatch(f"tables of version {meta['schema_version']}, this engine reads {SCHEMA_VERSION}")
        if meta["embedder_id"] != embedder.id:
            raise EmbedderMismatch(f"index made by {meta['embedder_id']}, opened with {embedder.id}")
        return cls(spark, root, meta, embedder)

    @staticmethod
    def _put_meta(home: str, meta: dict) -> None:
        path = os.path.join(home, "meta.json")
        with open(f"{path}.new", "w", encoding="utf-8") as f:
            json.dump(meta, f)
        os.replace(f"{path}.new", path)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/.skein/v={self.meta['snapshot']}/{name}")

    @property
    def corpus(self) -> Corpus:
        return Corpus(*(self.table(n) for n in ("docs", "aliases", "chunks", "links", "postings", "words")))

    # -- ingest

    def sync(self, now: datetime | None = None) -> SyncReport:
        """Brings the tables up to date with the files; whole or not at all."""
        report = self._apply(vault.scan(self.spark, self.root), now or datetime.now(UTC), whole=True)
        return report

    def capture(self, text: str, title: str | None = None, now: datetime | None = None) -> str:
        """Writes a note to inbox/ and takes it in; gives its slug."""
        now = now or datetime.now(UTC)
        given = F.lit(title) if title is not None else T.derive_title(F.lit(text))
        named = sync.capture_name(given, F.lit(now.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp"))
        row = self.spark.range(1).select(named[0].alias("t"), named[1].alias("s")).first()
        base = slug = row["s"]
        n = 1
        while os.path.exists(os.path.join(self.root, f"{slug}.md")) and n < 100:
            n += 1
            slug = f"{base}-{n}"
        path = os.path.join(self.root, f"{slug}.md")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        content = f"---\ntitle: {M.yaml_quote(row['t'])}\ntype: note\ncreated: {now:%Y-%m-%dT%H:%M:%SZ}\ntags: [captured]\n---\n\n{text.strip()}\n"
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(content)
        file = self.spark.createDataFrame([(slug, f"{slug}.md", content, now.isoformat(timespec="seconds"), None)], vault.FILES)
        self._apply(file, now, whole=False)
        return slug

    def _apply(self, files: DataFrame, now: datetime, whole: bool) -> SyncReport:
        stamp, old = now.isoformat(timespec="seconds"), self.corpus
        home, nxt = f"{self.root}/.skein", self.meta["snapshot"] + 1
        stage = lambda df, name: (df.write.mode("overwrite").parquet(f"{home}/v={nxt}/{name}"), self.spark.read.schema(df.schema).parquet(f"{home}/v={nxt}/{name}"))[1]
        files = stage(files, "_files")
        hashed = files.where("content is not null").withColumn("content_hash", F.sha2("content", 256))
        live = old.live.select("slug", "content_hash")
        states = sync.diff(live.join(hashed.select("slug"), "slug", "left_semi"), hashed)
        changed = hashed.join(states.where("state <> 'unchanged'").select("slug"), "slug", "left_semi")
        parsed = stage(sync.parse(changed).join(states, "slug"), "_parsed")
        good = parsed.where("error is null").withColumn("synced_at", F.lit(stamp)).withColumn("deleted_at", F.lit(None).cast("string"))
        docs = C.upsert(old.docs, good.drop("state", "error"))
        before = old.live.select("slug", "content_hash")
        if whole:
            docs = C.soft_delete(docs, files.select("slug"), stamp)
        docs = stage(docs.select(*(F.col(c.split()[0]).cast(t) for c, t in ((f.strip(), f.strip().split(" ", 1)[1]) for f in TABLES["docs"].split(", ")))), "docs")
        gone = before.join(docs.where("deleted_at is null").select("slug"), "slug", "left_anti")
        fresh = docs.join(good.select("slug"), "slug", "left_semi")
        new_ids, dead = fresh.select(F.col("id").alias("doc_id")), docs.where("deleted_at is not null").select(F.col("id").alias("doc_id"))
        drop = new_ids.unionByName(dead)
        aliases = old.aliases.join(new_ids, "doc_id", "left_anti").unionByName(C.alias_rows(fresh).select("doc_id", "alias", "alias_key"))
        aliases = stage(aliases.select("doc_id", "alias", "alias_key"), "aliases")
        kept = old.chunks.join(drop, "doc_id", "left_anti")
        made = sync.chunks(fresh)
        made = made.withColumn("embedding", E.embed_column(F.col("text"), self.embedder))
        top = old.chunks.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
        slugs = fresh.select(F.col("id").alias("doc_id"), "slug")
        made = C.numbered(made.join(slugs, "doc_id"), "slug", "k", "chunk_index").join(F.broadcast(top)).withColumn("id", F.col("top") + F.col("k"))
        columns = [f.strip().split()[0] for f in TABLES["chunks"].split(", ")]
        made = stage(made.select(*columns), "_made")
        chunks = stage(kept.select(*columns).unionByName(made), "chunks")
        posts = old.postings.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").select("word", "chunk_id", "attr", "pos")
        posts = posts.unionByName(C.postings(docs, made))
        posts = stage(posts.repartition("word").sortWithinPartitions("word", "chunk_id"), "postings")
        stage(C.word_index(Corpus(docs, aliases, chunks, old.links, posts)).repartition("word").sortWithinPartitions("word"), "words")
        links = old.links.join(drop.withColumnRenamed("doc_id", "src_doc_id"), "src_doc_id", "left_anti").unionByName(sync.links(fresh))
        moves = sync.renames(gone, good.where("state = 'added'").select("slug", "content_hash"))
        moves = stage(moves, "_moves")
        links = C.rename_targets(links, docs, moves)
        links = stage(links, "_links")
        settled = stage(C.resolve_dangling(Corpus(docs, aliases, chunks, links, posts)), "links")
        issues = files.where("issue is not null").select("path", F.col("issue").alias("message")).unionByName(parsed.where("error is not null").select(F.concat("slug", F.lit(".md")).alias("path"), F.col("error").alias("message")))
        issues = issues.unionByName(C.case_collisions(files.select("slug")).select(F.col("slugs").alias("path"), F.lit("slugs differ in case only").alias("message")))
        count = {r["state"]: r["n"] for r in states.join(good.select("slug"), "slug", "left_semi").groupBy("state").agg(F.count("*").alias("n")).collect()}
        report = SyncReport(
            scanned=files.count(), added=count.get("added", 0), updated=count.get("updated", 0), unchanged=states.where("state = 'unchanged'").count(),
            deleted=gone.count() if whole else 0, renamed=moves.count(), errors=[(r["path"], r["message"]) for r in issues.orderBy("path").collect()],
            resolved_links=links.where("dst_doc_id is null").count() - settled.where("dst_doc_id is null").count(),
        )
        self.meta = self.meta | {"snapshot": nxt} | ({"last_synced_at": stamp} if whole else {})
        self._put_meta(home, self.meta)
        self._cache.clear()
        for name in os.listdir(home):  # the snapshot before this one stays for its readers
            if name.startswith("v=") and int(name[2:]) < nxt - 1:
                shutil.rmtree(f"{home}/{name}", ignore_errors=True)
        for name in os.listdir(f"{home}/v={nxt}"):
            if name.startswith("_"):
                shutil.rmtree(f"{home}/v={nxt}/{name}", ignore_errors=True)
        return report

    # -- questions; results are kept by arguments until the snapshot changes

    def _kept(self, key: tuple, make) -> object:
        key = (self.meta["snapshot"], *key)
        if key not in self._cache:
            if len(self._cache) >= 256:
                self._cache.pop(next(iter(self._cache)))
            self._cache[key] = make()
        return self._cache[key]

    def search(self, query: str, mode: str = "balanced", limit: int | None = None, as_of: str | None = None) -> DataFrame:
        as_of = as_of or datetime.now(UTC).strftime("%Y-%m-%d %H:00:00")
        vector = self.embedder.embed_batch([query])[0]
        return self._kept(("search", query, mode, limit, as_of), lambda: search.small(search.search(self.corpus, query, [float(x) for x in vector], mode, as_of, limit=limit)))  # a page of hits

    def think(self, query: str, mode: str = "balanced", as_of: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(facts, gaps)."""
        as_of = as_of or datetime.now(UTC).strftime("%Y-%m-%d %H:00:00")
        found = think.facts(self.search(query, mode, as_of=as_of))
        return found, think.gaps(self.corpus, found, query, as_of)

    def intent(self, query: str) -> str:
        return search.query_intent(self.corpus, query)

    def refresh(self) -> None:
        """Reads which snapshot is the current one: another process may have made it."""
        with open(os.path.join(self.root, ".skein", "meta.json"), encoding="utf-8") as f:
            self.meta = json.load(f)

    def doc(self, name: str) -> dict:
        """The document of a slug, title or alias."""
        ids = C.resolve_docs(self.corpus, self.spark.range(1).select(F.lit(name).alias("name")))
        row = self.corpus.docs.join(ids.select("id"), "id").first()
        if row is None:
            raise DocNotFound(name)
        return row.asDict(recursive=True)

    def graph(self, start: str, edge_type: str | None = None, hops: int = 2) -> DataFrame:
        found = self.doc(start)
        seed = self.spark.range(1).select(F.lit(found["id"]).alias("id"))
        return search.traverse(self.corpus, seed, hops, edge_type)

    def content(self, doc: dict) -> str:
        """A document's file, or its body where the file is gone."""
        return vault.read_file(os.path.join(self.root, f"{doc['slug']}.md"))[0] or doc["body"]

    # -- answers as the command line and the server give them, kept like all results

    def _answer(self, key: tuple, make) -> dict:
        cached = (self.meta["snapshot"], *key) in self._cache
        return self._kept(key, make) | ({"cached": True} if cached else {})

    def answer(self, kind: str, query: str, mode: str, limit: int | None = None) -> dict:
        """kind: search or think."""
        as_of = datetime.now(UTC).strftime("%Y-%m-%d %H:00:00")
        listed = lambda df, *drop: [r.asDict(recursive=True) for r in df.drop(*drop).collect()]  # noqa: E731  a page of rows

        def make() -> dict:
            head = {"query": query, "intent": self.intent(query), "mode": mode}
            if kind == "search":
                return head | {"hits": listed(self.search(query, mode, limit, as_of))}
            found, gaps = self.think(query, mode, as_of)
            return head | {"facts": listed(found, "rank"), "gaps": listed(gaps)}

        return self._answer((kind, "answer", query, mode, limit, as_of), make)

    def answer_graph(self, start: str, edge: str | None, hops: int, most: int) -> dict:
        """The first ``most`` edges."""
        make = lambda: {"start": start, "edges": [r.asDict() for r in self.graph(start, edge, hops).orderBy("hop", "src_slug", "dst_slug").limit(most).collect()]}
        return self._answer(("graph", start, edge, hops), make)

    def validate(self, path: str | None = None, since: str | None = None, everything: bool = False) -> DataFrame:
        """(path, message); message is null for valid files. By default what changed since the last sync."""
        if path is not None:  # any file, in the folder or not
            full = path if os.path.isabs(path) or os.path.exists(path) else os.path.join(self.root, path)
            file = self.spark.createDataFrame([("./file", path, *vault.read_file(full))], vault.FILES)
            return sync.validate(file).withColumn("path", F.lit(path))
        files = vault.scan(self.spark, self.root)
        return sync.validate(files, None if everything else since or self.meta["last_synced_at"])

    def stats(self) -> dict:
        c = self.corpus
        one = C.stats(c).first().asDict()
        pairs = lambda df: [tuple(r) for r in df.orderBy(F.desc("n"), df.columns[0]).collect()]
        return one | {"links_by_type": pairs(C.links_by_type(c.links)), "docs_by_source": pairs(C.docs_by_source(c)), "last_synced_at": self.meta["last_synced_at"]}
