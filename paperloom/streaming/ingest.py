"""Structured Streaming: files as they arrive, each content once, and edit logs as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import edits as ed
from paperloom.sources import containers

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, path: str, delay: str = "1 day") -> DataFrame:
    """Files that appear below a path as (doc_id, path, kind, content, modificationTime), each content once within delay.

    Contents are told apart by their SHA-256; the watermark bounds what is remembered.
    """
    raw = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(path)
    seen = raw.withColumn("sha256", F.sha2("content", 256)).withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["sha256"])
    return containers.classified(seen)


def folded_edits(edits: DataFrame) -> DataFrame:
    """The state that a stream of edits (doc_id, node_id, seq, op, value) leaves each node in, for update or complete mode."""
    return ed.fold(edits, ["doc_id", "node_id"])
