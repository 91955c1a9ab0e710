"""Continuous ingest: a stream of documents, batch by batch, into the same tables a sync makes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein import settings as S
from skein.functions import text as T
from skein.kb import KnowledgeBase
from skein.sources import vault


def files_of(stream: DataFrame) -> DataFrame:
    """vault.FILES of a stream of path, content (binary or text) and modified."""
    content = F.col("content").cast("binary")
    good = (F.length(content) <= S.MAX_FILE_BYTES) & F.is_valid_utf8(content.cast("string"))
    issue = F.when(F.length(content) > S.MAX_FILE_BYTES, "file too large").when(~F.is_valid_utf8(content.cast("string")), "not UTF-8")
    return stream.select(T.slug_for("path").alias("slug"), "path", F.when(good, content.cast("string")).alias("content"), F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("modified"), issue.alias("issue"))


def ingest(stream: DataFrame, kb: KnowledgeBase, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Takes documents in as they come; those that don't come stay. Of a path that comes twice in a batch the latest counts.

    A batch that is run again finds its documents unchanged, so that a restart changes nothing.
    """

    def take(batch: DataFrame, epoch: int) -> None:
        from datetime import UTC, datetime

        latest = batch.groupBy("path").agg(F.max_by(F.struct("content", "modified"), "modified").alias("f")).select("path", "f.content", "f.modified")
        kb._apply(files_of(latest).select(*(f.split()[0] for f in vault.FILES.split(", "))), datetime.now(UTC), whole=False)

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
