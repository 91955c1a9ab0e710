"""A knowledge base over HTTP, and a client of it. Answers are those of the command line with --json.

GET /health, /api/search?q&mode&limit, /api/think?q&mode, /api/graph?start&edge&hops, /api/stats, /api/docs/NAME;
POST /api/capture {text, title}, /api/sync. Errors are {"error": ...} with 404 (no such document), 409 (no knowledge base),
400 (bad request) or 500. Spark jobs run one request at a time; answers to search, think and graph stay in the knowledge base's
cache (256 of them) until it changes, and say so (cached).
"""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, quote, unquote, urlencode, urlsplit

from pyspark.sql import SparkSession

from skein import settings as S
from skein.kb import DocNotFound, KnowledgeBase, NotInitialized

PORT = 7700


def command(method: str, path: str, query: dict[str, str], body: dict) -> list[str] | None:
    """The command line that a request stands for; None if there is none."""
    mode = ["--mode", query["mode"]] if query.get("mode") in S.MODES else []  # an unknown mode is the default one
    match method, path:
        case "GET", "/api/search":
            return ["search", query["q"], *mode, *(["--limit", query["limit"]] if "limit" in query else [])]
        case "GET", "/api/think":
            return ["think", query["q"], *mode]
        case "GET", "/api/graph":
            return ["graph-query", query["start"], *(["--edge", query["edge"]] if "edge" in query else []), "--hops", query.get("hops", "2")]
        case "GET", "/api/stats":
            return ["stats"]
        case "POST", "/api/sync":
            return ["sync"]
        case "POST", "/api/capture":
            return ["capture", body["text"], *(["--title", body["title"]] if body.get("title") is not None else [])]
    return ["doc", unquote(path.removeprefix("/api/docs/"))] if method == "GET" and path.startswith("/api/docs/") else None


def serve(spark: SparkSession, root: str, host: str = "127.0.0.1", port: int = PORT) -> ThreadingHTTPServer:
    """A server, bound but not running: call serve_forever()."""
    from skein import cli  # which asks servers, too

    lock, held = threading.Lock(), []

    def knowledge() -> KnowledgeBase:
        """One for all requests, so that answers stay; it follows the snapshots that others make."""
        if not held:
            held.append(KnowledgeBase.open(spark, root))
        held[0].refresh()
        return held[0]

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, found: object) -> None:
            data = json.dumps(found, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def handle_request(self, method: str) -> None:
            url = urlsplit(self.path)
            try:
                if (method, url.path) == ("GET", "/health"):
                    return self.answer(200, {"status": "ok"})
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or "{}")
                words = command(method, url.path, {k: v[0] for k, v in parse_qs(url.query).items()}, body)
                if words is None:
                    return self.answer(404, {"error": f"no route {method} {url.path}"})
                with lock:
                    found = cli.run(knowledge(), cli.parser().parse_args(words))
                self.answer(200, found)
            except DocNotFound as e:
                self.answer(404, {"error": f"document not found: {e}"})
            except NotInitialized as e:
                self.answer(409, {"error": str(e)})
            except (KeyError, ValueError, SystemExit) as e:
                self.answer(400, {"error": f"bad request: {e}"})
            except Exception as e:  # whatever the engine raises is told to the client
                self.answer(500, {"error": str(e)})

        def do_GET(self) -> None:
            self.handle_request("GET")

        def do_POST(self) -> None:
            self.handle_request("POST")

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


class RemoteError(Exception):
    pass


class Client:
    """The same questions, asked of a server."""

    def __init__(self, base: str):
        self.base = base.rstrip("/")

    def _ask(self, path: str, query: dict | None = None, body: dict | None = None) -> dict:
        url = f"{self.base}{path}" + (f"?{urlencode({k: v for k, v in query.items() if v is not None})}" if query else "")
        request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request) as response:  # noqa: S310  the caller names the server
                return json.load(response)
        except urllib.error.HTTPError as e:
            raise RemoteError(json.load(e).get("error", str(e))) from e

    def search(self, query: str, mode: str | None = None, limit: int | None = None) -> dict:
        return self._ask("/api/search", {"q": query, "mode": mode, "limit": limit})

    def think(self, query: str, mode: str | None = None) -> dict:
        return self._ask("/api/think", {"q": query, "mode": mode})

    def graph(self, start: str, edge: str | None = None, hops: int | None = None) -> dict:
        return self._ask("/api/graph", {"start": start, "edge": edge, "hops": hops})

    def doc(self, name: str) -> dict:
        return self._ask(f"/api/docs/{quote(name)}")

    def stats(self) -> dict:
        return self._ask("/api/stats")

    def capture(self, text: str, title: str | None = None) -> dict:
        return self._ask("/api/capture", body={"text": text, "title": title})

    def sync(self) -> dict:
        return self._ask("/api/sync", body={})
