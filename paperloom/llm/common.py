"""What the operators share: inputs, work tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a bitmap that keeps most rows without a partner out of a shuffle.
BITMAP_BITS = 24
#: Rows of a key that one task takes at least, and keys that may be dealt out to several tasks at most.
LEAST_HOT = 1000
HOT_KEYS = 5000
#: Word characters are all but these, as a Java and RE2 class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors can reach.

    It lies in spark.checkpoint.dir. Only a local session may be without one;
    then a temporary folder of this machine serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{base.rstrip('/')}/paperloom-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written to a work table in the shared folder and read from there.

    What comes later starts from the table, also after executors are lost.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes work tables made by stored that nothing still to be run reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.work_path.rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_facts(rows: DataFrame, facts: DataFrame, keys: list[str], deal: str, how: str = "inner", n: str = "n") -> DataFrame:
    """rows joined to facts, which has one row per key and in n the rows of the key (n is dropped).

    A key with more than LEAST_HOT rows, and a HOT_KEYS-th of all at least, is dealt
    out to several tasks by the hash of column deal, and its fact is repeated for
    each. So at most HOT_KEYS keys, which are broadcast, are hot. facts is read
    three times: let it be a work table or cheap.
    """
    total = facts.agg(F.sum(n)).first()[0] or 0
    limit = max(LEAST_HOT, total // HOT_KEYS)
    parts = F.ceil(F.col(n) / limit).cast("int")
    hot = facts.where(F.col(n) > limit).select(*keys, parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(deal), F.col("_parts"))).cast("int")).drop("_parts")
    spread = facts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(n)
    return dealt.join(spread, [*keys, "_part"], how).drop("_part")


def bitmap_of(hashes: DataFrame):
    """A broadcast bitmap of the high bits of column hash (long, well mixed).

    Its size is fixed: with very many hashes it lets more through, and what it
    lets through is still joined exactly.
    """
    bit = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    parts = hashes.select(F.shiftrightunsigned(bit, 6).alias("at"), bit.bitwiseAND(F.lit(63)).alias("bit"))
    parts = parts.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("w"))
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    found = parts.toArrow()  # of 2 ** (BITMAP_BITS - 6) rows at most
    out[found["at"].to_numpy()] = found["w"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(out.tobytes())


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) the bitmap lets through."""
    bit = hashes >> np.uint64(64 - BITMAP_BITS)
    return ((bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long), as (node, root).

    root is the smallest node of the component; nodes without an edge to
    another node are absent. Alternates large-star and small-star steps
    (Kiveris et al., 2014). Minima by node are combined before they are
    shuffled, and the edges of a node with very many are dealt out to several
    tasks. Null ends, loops and repeated edges are ignored.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        both = now.union(now.select("b", "a"))
        nodes = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n")), "nodes")
        large = with_facts(both, nodes, ["a"], "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # From here on a node keeps only neighbours that are smaller, of which it has few.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        held, now = now, stored(small.select("e.*").where("a <> b").distinct(), "edges")
        discard(held, nodes)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
