"""The command line, the server and its client, and streaming ingest, on one small vault."""

from __future__ import annotations

import json
import threading

import pytest
from pyspark.sql import functions as F

from skein import cli
from skein.kb import KnowledgeBase
from skein.server import Client, RemoteError, serve
from skein.streaming.ingest import ingest


def test_server_and_stream(spark, tmp_path, capsys):
    root, files = tmp_path / "vault", tmp_path / "incoming"
    root.mkdir(), files.mkdir()
    (root / "a.md").write_text("---\ntitle: First Page\n---\nSee [[Second]].")
    assert cli.main(["--knowledge", str(root), "stats"]) == 1
    assert cli.main(["--knowledge", str(root), "init"]) == 0
    assert cli.main(["--knowledge", str(root), "--json", "sync"]) == 0
    assert json.loads(capsys.readouterr().out.split("\n", 1)[1])["added"] == 1
    spark.createDataFrame([("b/second.md", "---\ntitle: Second\n---\nfounded [x](../a.md)"), ("b/bad.md", "---\n[\n---\n")], "path string, content string").coalesce(1).write.parquet(str(files / "p"))
    stream = spark.readStream.schema("path string, content string").parquet(str(files / "p")).withColumn("modified", F.lit("2026-06-01 00:00:00").cast("timestamp"))
    kb = KnowledgeBase.open(spark, str(root))
    ingest(stream, kb, str(tmp_path / "checkpoint")).awaitTermination()
    with serve(spark, str(root), port=0) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        client = Client(f"http://127.0.0.1:{server.server_port}")
        assert client._ask("/health") == {"status": "ok"}
        stats = client.stats()
        assert (stats["docs"], stats["links"], stats["dangling_links"]) == (2, 2, 0)
        assert client.doc("second")["slug"] == "b/second"
        assert "cached" not in client.search("first page") and client.search("first page")["cached"]
        where = ["--server", f"http://127.0.0.1:{server.server_port}"]
        got = client.capture("a thought\nand more")
        assert got["path"].endswith(f"{got['slug']}.md") and open(got["path"]).read().endswith("a thought\nand more\n")
        assert "cached" not in client.search("first page") and client.doc(got["slug"])["content"].startswith("---\ntitle:")
        capsys.readouterr()
        assert cli.main([*where, "stats"]) == 0 and "3 documents" in capsys.readouterr().out
        assert cli.main([*where, "search", "first page"]) == 0 and "from the cache" in capsys.readouterr().out
        assert cli.main([*where, "validate"]) == 1
        assert {(e["src_slug"], e["dst_slug"], e["edge_type"]) for e in client.graph("b/second", hops=1)["edges"]} == {("b/second", "a", "founded"), ("a", "Second", "mentions")}
        with pytest.raises(RemoteError, match="not found"):
            client.doc("nobody")
        with pytest.raises(RemoteError, match="bad request"):
            client._ask("/api/search")
        server.shutdown()
    other = tmp_path / "other.md"
    other.write_text("---\ntitle: T\n---\n")
    assert cli.main(["--knowledge", str(root), "validate", str(other)]) == 2 and "missing required" in capsys.readouterr().out
    assert cli.main(["--knowledge", str(root), "validate", str(tmp_path / "none.md")]) == 2 and "cannot read file" in capsys.readouterr().out
    for command in (["sync"], ["think", "Second"], ["graph-query", "a"]):
        assert cli.main(["--knowledge", str(root), *command]) == 0 and capsys.readouterr().out
