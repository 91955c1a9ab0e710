"""Command line of a knowledge base: python -m skein.cli --knowledge DIR COMMAND."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.kb import KnowledgeBase, KnowledgeError
from skein.server import Client, RemoteError, serve


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skein")
    p.add_argument("--knowledge", default=os.environ.get("SKEIN_ROOT", "."), help="folder of markdown files; by default $SKEIN_ROOT, or the current one")
    p.add_argument("--server", default=os.environ.get("SKEIN_SERVER"), help="ask this server instead of the folder; by default $SKEIN_SERVER")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    sub.add_parser("sync")
    sub.add_parser("stats")
    for name in ("search", "think"):
        q = sub.add_parser(name)
        q.add_argument("query")
        q.add_argument("--mode", default="balanced", choices=["conservative", "balanced", "tokenmax"])
        if name == "search":
            q.add_argument("--limit", type=int)
    c = sub.add_parser("capture")
    c.add_argument("text")
    c.add_argument("--title")
    g = sub.add_parser("graph-query")
    g.add_argument("start")
    g.add_argument("--edge")
    g.add_argument("--hops", type=int, default=2)
    sub.add_parser("doc").add_argument("name")
    v = sub.add_parser("validate")
    v.add_argument("path", nargs="?")
    v.add_argument("--since")
    v.add_argument("--all", action="store_true")
    h = sub.add_parser("serve")
    h.add_argument("--host", default="127.0.0.1")
    h.add_argument("--port", type=int, default=7700)
    return p


#: Edges, and issues, that an answer lists at most.
PAGE = 10_000


def run(kb: KnowledgeBase, args: argparse.Namespace) -> dict:
    """The answer to a command, as --json prints it."""
    if args.command == "sync":
        return vars(kb.sync())
    if args.command == "stats":
        return kb.stats()
    if args.command in ("search", "think"):
        return kb.answer(args.command, args.query, args.mode, getattr(args, "limit", None))
    if args.command == "capture":
        slug = kb.capture(args.text, args.title)
        return {"slug": slug, "path": os.path.join(kb.root, f"{slug}.md")}
    if args.command == "graph-query":
        return kb.answer_graph(args.start, args.edge, args.hops, PAGE)
    if args.command == "doc":
        found = kb.doc(args.name)
        return {k: found[k] for k in ("slug", "title", "doc_type", "tags", "updated_at")} | {"content": kb.content(found)}
    checked = kb.validate(args.path, args.since, args.all).cache()
    count = checked.agg(F.count("*").alias("n"), F.count("message").alias("bad")).first()
    issues = rows(checked.where("message is not null").orderBy("path").limit(PAGE))
    checked.unpersist()
    return {"checked": count["n"], "valid": count["n"] - count["bad"], "invalid": count["bad"], "issues": issues}


def ask(client: Client, args: argparse.Namespace) -> dict:
    """The same of a server; the commands that have no route there are an error."""
    asked = {
        "sync": client.sync, "stats": client.stats, "capture": lambda: client.capture(args.text, args.title), "doc": lambda: client.doc(args.name),
        "search": lambda: client.search(args.query, args.mode, args.limit), "think": lambda: client.think(args.query, args.mode),
        "graph-query": lambda: client.graph(args.start, args.edge, args.hops),
    }
    if args.command not in asked:
        raise ValueError(f"{args.command} works on a folder, not on a server")
    return asked[args.command]()


def named(values: dict) -> str:
    heading = f" # {values['heading_path']}" if values.get("heading_path") else ""
    return f"{values['title']} ({values['slug']}{heading})"


def lines(command: str, found: dict) -> list[str]:
    """What a person reads of an answer."""
    again = ", from the cache" if found.get("cached") else ""
    match command:
        case "sync":
            counts = ", ".join(f"{found[k]} {k.replace('_', ' ')}" for k in ("scanned", "added", "updated", "unchanged", "deleted", "renamed", "resolved_links"))
            return [f"sync: {counts}", *(f"  skipped {path}: {message}" for path, message in found["errors"])]
        case "search":
            out = [f"{len(found['hits'])} hits, intent {found['intent']}, mode {found['mode']}{again}"]
            for h in found["hits"]:
                out += [f"{h['rank']:3d}  {named(h)}", f"     {h['score']:.4f} {h['evidence']} {h['doc_type']}", f"     {' '.join(h['snippet'].split())}"]
            return out
        case "think":
            facts = [f"  - {f['lead']} [{named(f)}, {f['evidence']}]" for f in found["facts"]] or ["  nothing is known"]
            gaps = [f"  - {g['kind']}: {g['message']}" for g in found["gaps"]]
            return [f"intent {found['intent']}, mode {found['mode']}{again}", "known:", *facts, *(["gaps:", *gaps] if gaps else [])]
        case "graph-query":
            edges = [f"  {e['hop']}: {e['src_slug']} --{e['edge_type']}--> {e['dst_slug']}" for e in found["edges"]]
            return [f"from {found['start']}{again}", *(edges or ["  no edges"])]
        case "stats":
            parts = [f"{found['docs']} documents ({found['deleted_docs']} deleted), {found['chunks']} chunks, {found['indexed_words']} words, {found['links']} links ({found['dangling_links']} dangling)"]
            for title, key in (("links by type", "links_by_type"), ("documents by folder", "docs_by_source")):
                parts += [f"{title}:", *(f"  {name or '(top)'}: {n}" for name, n in found[key])] if found[key] else []
            return [*parts, f"last sync: {found['last_synced_at'] or 'never'}"]
        case "validate":
            return [f"{found['checked']} files checked, {found['valid']} valid, {found['invalid']} not", *(f"  {i['path']}: {i['message']}" for i in found["issues"])]
        case "doc":
            return [f"{found['title']} ({found['slug']}), {found['doc_type']}, updated {found['updated_at']}", "", found["content"]]
    return [f"{k}: {v}" for k, v in found.items()]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.server and args.command != "serve":
            found = ask(Client(args.server), args)
        else:
            spark = SparkSession.builder.appName("skein").config("spark.sql.session.timeZone", "UTC").getOrCreate()
            if args.command == "init":
                KnowledgeBase.init(spark, args.knowledge)
                found = {"initialized": args.knowledge}
            elif args.command == "serve":
                with serve(spark, args.knowledge, args.host, args.port) as server:
                    server.serve_forever()
                return 0
            else:
                found = run(KnowledgeBase.open(spark, args.knowledge), args)
    except (KnowledgeError, RemoteError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(json.dumps(found, indent=2, ensure_ascii=False, default=str) if args.json else "\n".join(lines(args.command, found)))
    return 2 if args.command == "validate" and found["invalid"] else 0


if __name__ == "__main__":
    sys.exit(main())
