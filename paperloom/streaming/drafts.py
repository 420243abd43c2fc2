"""Keyed drafts: the last saved document of each key, upserted from a stream.

A draft table is a folder of batches. A batch holds, for each key, the latest
draft it brought that differs from what the batches before it left. Its folder
is named after the stream and the batch and overwritten as a whole, so a batch
that is replayed changes nothing, and the folders are the ledger of batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PREFIX = "paperloom.draft.v1"
DRAFTS = "key string, saved_at timestamp, digest string, document string"
# Characters that URI components keep and form encoding doesn't, and the space.
KEPT = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def encoded(part: str | Column) -> Column:
    """A text as a component of a URI."""
    out = F.url_encode(F.col(part) if isinstance(part, str) else part)
    for a, b in KEPT.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def draft_key(source_type: str | Column, label: str | Column, prefix: str = PREFIX) -> Column:
    return F.concat(F.lit(prefix + ":"), encoded(source_type), F.lit(":"), encoded(label))


def with_digest(drafts: DataFrame) -> DataFrame:
    """drafts (key, saved_at, document) with the SHA-256 of the document, by which drafts are told apart."""
    return drafts.select("key", "saved_at", F.sha2(F.coalesce("document", F.lit("")), 256).alias("digest"), "document")


def latest(drafts: DataFrame) -> DataFrame:
    """The draft of each key that was saved last; of those saved at once the one with the greatest digest. Null keys and times are left out."""
    rows = drafts.where("key is not null and saved_at is not null")
    return rows.groupBy("key").agg(F.max(F.struct("saved_at", "digest", "document")).alias("d")).select("key", "d.*")


def changes(drafts: DataFrame) -> DataFrame:
    """The drafts that differ from the one saved before of their key: what a dirty check lets through."""
    before = F.lag("digest").over(Window.partitionBy("key").orderBy("saved_at", "digest"))
    return drafts.where("key is not null and saved_at is not null").withColumn("_before", before).where(~F.col("digest").eqNullSafe(F.col("_before"))).drop("_before")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches of a draft table with columns stream and batch; none where the table isn't there yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"{DRAFTS}, stream string, batch long")
    return spark.read.schema(f"{DRAFTS}, stream string, batch long").parquet(path)


def current_drafts(spark: SparkSession, path: str) -> DataFrame:
    """(key, saved_at, digest, document): the drafts that hold."""
    return latest(read_batches(spark, path).drop("stream", "batch"))


def upsert(drafts: DataFrame, path: str, stream: str, batch: int) -> None:
    """Writes a batch of drafts (key, saved_at, document) of a stream; doing so again changes nothing.

    Drafts that are as old as, or the same as, what other batches left are not
    written. Batches of this stream from this number on aren't looked at, so that a
    replay finds what the first run found. Only keys, times and digests of the table are read.
    """
    spark = drafts.sparkSession
    others = read_batches(spark, path).where((F.col("stream") != stream) | (F.col("batch") < batch))
    held = others.groupBy("key").agg(F.max(F.struct("saved_at", "digest")).alias("held"))
    new = latest(with_digest(drafts)).join(held, "key", "left")
    fresh = F.col("held").isNull() | ((F.col("saved_at") > F.col("held.saved_at")) & (F.col("digest") != F.col("held.digest")))
    new.where(fresh).select("key", "saved_at", "digest", "document").write.mode("overwrite").parquet(f"{path}/stream={stream}/batch={batch}")


def save_drafts(drafts: DataFrame, path: str, stream: str, checkpoint: str):
    """A writer of a stream of drafts (key, saved_at, document) into the table at path; start it to run."""
    return drafts.writeStream.queryName(stream).option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: upsert(df, path, stream, n))
