"""Token ids as flat files of unsigned integers with 64-bit document offsets.

A store is a folder: ``tokens-K.bin`` (16-bit ids if the vocabulary fits, else 32-bit, little-endian, nothing else),
``docs-K.bin`` (for each document its id, first token and end in the whole store, all signed 64-bit little-endian) and
``manifest.json`` (dtype, and by shard: documents, tokens, base). Shards follow one another in ascending doc_id order;
a shard's base is the prefix sum of the tokens before it. A shard is written under a name of its own attempt and then
renamed, so that a lost or repeated task leaves whole files only.

The folder is a path that all machines mount, as memory maps need one; other stores (hdfs://, s3://, ...) are written and
read as streams by pyarrow's file systems.

Cases: null text is empty text (the end id alone); documents without a doc_id come first, in order of text; equal rows
are separate documents; equal doc_ids are ordered by text; an empty table makes a store without shards; other columns are
ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import claim
from .tokens import encoder

#: Stands for a null doc_id in docs-K.bin.
NO_ID = -(1 << 63)


def _where(path: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), path.removeprefix("file://")) if path.startswith(("/", "file:/")) else fs.FileSystem.from_uri(path)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text", shards: int | None = None, shard_bytes: int = 256 << 20) -> dict:
    """Encodes doc_id and text of docs to a store at path and returns its manifest.

    shards: how many; by default one for each ``shard_bytes`` of docs as Spark estimates them, and as many as Spark has shuffle partitions at least.
    """
    spark = docs.sparkSession
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if shards is None and (many := -(-size // shard_bytes)) > int(spark.conf.get("spark.sql.shuffle.partitions")) and size < 1 << 60:  # beyond: no estimate
        shards = many
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = rows.repartitionByRange(shards, *by) if shards else rows.repartitionByRange(*by)
    wide = encoder(tokenizer).size > 1 << 16
    store, root = _where(path)
    store.create_dir(root, recursive=True)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, k, attempt = encoder(tokenizer), TaskContext.get().partitionId(), uuid.uuid4().hex
        claim(enc)
        out, here = _where(path)
        names = [f"{here}/{kind}-{k:06d}.bin" for kind in ("tokens", "local")]
        end, at, n = np.array([end_id], "<u4").tobytes(), 0, 0
        with out.open_output_stream(f"{names[0]}.{attempt}") as tokens, out.open_output_stream(f"{names[1]}.{attempt}") as local:
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), enc.batch(batch.column(1).to_pylist())):
                    got = np.frombuffer(ids + end, "<u4")
                    tokens.write(got.astype("<u4" if wide else "<u2").tobytes())
                    local.write(struct.pack("<qqq", NO_ID if doc_id is None else doc_id, at, at + len(got)))
                    at, n = at + len(got), n + 1
        for name in names:
            out.move(f"{name}.{attempt}", name)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([at], pa.int64())], names=["shard", "docs", "tokens"])

    got = dealt.sortWithinPartitions(*by, "text").mapInArrow(shard, "shard int, docs long, tokens long").collect()  # a row for each shard
    parts, base = [], 0
    for r in sorted(got):
        if r["docs"]:
            parts.append({"shard": r["shard"], "docs": r["docs"], "tokens": r["tokens"], "base": base})
        base += r["tokens"]

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, here = _where(path)
        for b in batches:
            for k, start in zip(b.column("shard").to_pylist(), b.column("base").to_pylist()):
                name = f"{here}/docs-{k:06d}.bin"
                with out.open_input_file(f"{here}/local-{k:06d}.bin") as f, out.open_output_stream(f"{name}.{(attempt := uuid.uuid4().hex)}") as g:
                    while part := f.read(24 << 16):
                        rows = np.frombuffer(part, "<i8").reshape(-1, 3).copy()
                        rows[:, 1:] += start
                        g.write(rows.tobytes())
                out.move(f"{name}.{attempt}", name)
            yield b.select(["shard"])

    if parts:
        _rows(spark, parts).mapInArrow(offsets, "shard int").count()
    for name in [x.path for x in store.get_file_info(fs.FileSelector(root)) if "local-" in x.base_name or not x.base_name.endswith((".bin", ".json"))]:
        store.delete_file(name)
    manifest = {"dtype": "<u4" if wide else "<u2", "tokens": base, "shards": parts}
    with store.open_output_stream(f"{root}/manifest.json.new") as f:
        f.write(json.dumps(manifest).encode())
    store.move(f"{root}/manifest.json.new", f"{root}/manifest.json")
    return manifest


def _rows(spark: SparkSession, parts: list[dict]) -> DataFrame:
    """A row for each shard, each in a task of its own."""
    rows = spark.createDataFrame([(p["shard"], p["docs"], p["base"]) for p in parts], "shard int, docs long, base long")
    return rows.repartition(max(1, len(parts)), "shard")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the store's files alone.

    ids_crc32 is that of the ids as little-endian unsigned 32-bit numbers.
    """
    store, root = _where(path)
    with store.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    dtype = np.dtype(manifest["dtype"])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, base in zip(b.column("shard").to_pylist(), b.column("base").to_pylist()):
                for tokens, rows in Shard.blocks(path, k, dtype, base):
                    crc = [zlib.crc32(np.asarray(tokens[i - rows[0, 1] : j - rows[0, 1]]).astype("<u4")) for _, i, j in rows.tolist()]
                    ids = pa.array(rows[:, 0], mask=rows[:, 0] == NO_ID)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(rows[:, 1]), pa.array(rows[:, 2] - rows[:, 1]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _rows(spark, manifest["shards"]).mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


class Shard:
    """Memory-mapped arrays of a shard: its tokens, and (doc_id, start, end) rows."""

    @staticmethod
    def open(path: str, k: int, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        store, root = _where(path)
        names = [f"{root}/tokens-{k:06d}.bin", f"{root}/docs-{k:06d}.bin"]
        if isinstance(store, fs.LocalFileSystem):
            if not all(map(os.path.exists, names)):
                raise FileNotFoundError(names[0])
            return np.memmap(names[0], dtype, "r"), np.memmap(names[1], "<i8", "r").reshape(-1, 3)
        tokens, docs = (store.open_input_file(n).read() for n in names)
        return np.frombuffer(tokens, dtype), np.frombuffer(docs, "<i8").reshape(-1, 3)

    @staticmethod
    def blocks(path: str, k: int, dtype: np.dtype, base: int, size: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Tokens and rows of ``size`` documents at a time: views of the memory maps, or ranges read from a remote store."""
        store, root = _where(path)
        if isinstance(store, fs.LocalFileSystem):
            tokens, docs = Shard.open(path, k, dtype)
            for at in range(0, len(docs), size):
                rows = np.asarray(docs[at : at + size])
                yield tokens[rows[0, 1] - base : rows[-1, 2] - base], rows
            return
        with store.open_input_file(f"{root}/tokens-{k:06d}.bin") as t, store.open_input_file(f"{root}/docs-{k:06d}.bin") as d:
            while part := d.read(24 * size):
                rows = np.frombuffer(part, "<i8").reshape(-1, 3)
                first, last = (int(x - base) * dtype.itemsize for x in (rows[0, 1], rows[-1, 2]))
                yield np.frombuffer(t.read_at(last - first, first), dtype), rows
