"""Scans of a folder of markdown files.

The walk is the driver's (names only, in slices of SLICE to a task); contents are read by the executors, from a path that
they share with the driver. Names that begin with a dot are pruned, links not followed; the extension is md in any case.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import settings as S
from skein.functions import text as T

SLICE = 500
FILES = "slug string, path string, content string, modified string, issue string"


def walk(root: str) -> Iterator[str]:
    """Paths relative to root of the markdown files below it."""
    for top, folders, names in os.walk(root, followlinks=False):
        folders[:] = sorted(d for d in folders if not d.startswith(".") and not os.path.islink(os.path.join(top, d)))
        for name in sorted(names):
            path = os.path.join(top, name)
            if not name.startswith(".") and name.lower().endswith(".md") and not os.path.islink(path):
                yield os.path.relpath(path, root)


def read_file(full: str) -> tuple[str | None, str | None, str | None]:
    """(content, modified, issue) of a file; issue says why content is null: too large, not UTF-8, unreadable."""
    content = modified = issue = None
    try:
        modified = datetime.fromtimestamp(os.stat(full).st_mtime, UTC).isoformat(timespec="seconds")
        if (n := os.path.getsize(full)) > S.MAX_FILE_BYTES:
            issue = f"file too large: {n} bytes"
        else:
            with open(full, encoding="utf-8", newline="") as f:
                content = f.read()
    except (OSError, UnicodeDecodeError) as e:
        issue = str(e)
    return content, modified, issue


def scan(spark: SparkSession, root: str) -> DataFrame:
    """FILES below root. issue says why content is null: too large, not UTF-8, unreadable."""
    paths = list(walk(root))
    names = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths) // SLICE))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, *read_file(os.path.join(root, p))) for p in batch["path"]], columns=["path", "content", "modified", "issue"])

    return names.mapInPandas(read, "path string, content string, modified string, issue string").select(T.slug_for("path").alias("slug"), "path", "content", "modified", "issue")


def oversize(files: DataFrame, length: str = "length") -> DataFrame:
    """Of a listing with lengths, what is too large to read."""
    return files.where(F.col(length) > S.MAX_FILE_BYTES)
