"""Tagged records out of binary streams: inflate, split, decode.

Each is a short Arrow function over many streams or records at a time; what
ranks, groups and classifies their results is DataFrame code.
"""

from __future__ import annotations

import codecs
import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import text as tx
from paperloom.operators import windows as wn
from paperloom.sources.batches import batched

#: Bytes of a payload at which a text may begin.
MAX_OFFSET = 32
CANDIDATES = T.ArrayType(T.StructType([T.StructField("encoding", T.StringType()), T.StructField("offset", T.IntegerType()), T.StructField("decoded", T.StringType())]))
RECORDS = "doc_id string, stream string, idx int, offset long, tag_id int, level int, size long, header_size int, payload binary"


@F.pandas_udf(T.StructType([T.StructField("data", T.BinaryType()), T.StructField("error", T.StringType())]))
def opened(data: pd.Series) -> pd.DataFrame:
    """Raw deflate as data, or what is wrong with it as error; null is neither."""

    def one(x):
        try:
            return (None if x is None else zlib.decompress(x, -15)), None
        except zlib.error as e:
            return None, str(e)

    return pd.DataFrame([one(x) for x in data], columns=["data", "error"], dtype=object)


@F.pandas_udf(T.BinaryType())
def try_inflate(data: pd.Series) -> pd.Series:
    """Raw deflate; null for damaged data."""

    def one(x):
        try:
            return None if x is None else zlib.decompress(x, -15)
        except zlib.error:
            return None

    return data.map(one)


def walk(data: bytes):
    """(idx, offset, tag, level, size, header_size, payload) of each record that is whole."""
    at = idx = 0
    while at + 4 <= len(data):
        (head,) = struct.unpack_from("<I", data, at)
        size, width = head >> 20, 4
        if size == 0xFFF:
            if at + 8 > len(data):
                return
            (size,) = struct.unpack_from("<I", data, at + 4)
            width = 8
        if at + width + size > len(data):
            return
        yield idx, at, head & 1023, head >> 10 & 1023, size, width, data[at + width : at + width + size]
        idx, at = idx + 1, at + width + size


def split_records(streams: DataFrame) -> DataFrame:
    """Records of streams (doc_id, stream, payload), which are decoded.

    A header has the tag in 10 bits, the level in 10 and the size in 12; a size
    of 4095 stands for the word behind. What is cut short ends the stream, and
    the records before stay.
    """

    def run(frames):
        rows = ((doc, stream, *r) for frame in frames for doc, stream, data in frame.itertuples(index=False) for r in walk(bytes(data or b"")))
        yield from batched(rows, ["doc_id", "stream", "idx", "offset", "tag_id", "level", "size", "header_size", "payload"])

    return streams.select("doc_id", "stream", "payload").mapInPandas(run, RECORDS)


class StreamRecords:
    """The table function that register_records registers: the records of a payload, of one tag if it is given.

    Its analysis checks the arguments before a query runs. Records are handed on
    one by one, so a stream of any number of records needs memory for itself alone.
    Spark runs table functions of Arrow batches nowhere in lateral joins, so this takes rows.
    """

    @staticmethod
    def analyze(payload, tag=None):
        from pyspark.sql.udtf import AnalyzeResult

        if payload.dataType != T.BinaryType():
            raise ValueError(f"stream_records needs a binary payload, not {payload.dataType.simpleString()}")
        if tag is not None and not isinstance(tag.dataType, (T.IntegralType, T.NullType)):
            raise ValueError(f"stream_records needs a whole number as tag, not {tag.dataType.simpleString()}")
        number, long = T.IntegerType(), T.LongType()
        fields = (("idx", number), ("offset", long), ("tag_id", number), ("level", number), ("size", long), ("header_size", number), ("payload", T.BinaryType()))
        return AnalyzeResult(T.StructType([T.StructField(*f) for f in fields]))

    def eval(self, payload, tag=None):
        for r in walk(bytes(payload or b"")):
            if tag is None or r[2] == tag:
                yield r


def register_records(spark: SparkSession, name: str = "stream_records") -> None:
    """Makes a table function of SQL: SELECT ... FROM streams, LATERAL stream_records(payload [, tag])."""
    spark.udtf.register(name, F.udtf(StreamRecords))


def step(data: bytes, at: int, encoding: str) -> int:
    """Where a codec stands after it has read one character, or skipped bytes that are none, from at on."""
    if encoding != "utf-16le" and data[at] < 0x80:
        return at + 1
    decoder = codecs.getincrementaldecoder(encoding)("ignore")
    for k in range(at, len(data)):
        decoder.decode(data[k : k + 1])
        if not decoder.getstate()[0]:
            return k + 1
    return len(data)


def shared_decodings(data: bytes) -> list[tuple[str, int, str]]:
    """(encoding, offset, text) of each encoding and each offset that has two bytes.

    One step of a codec leads from an offset to a later one. So going back from
    MAX_OFFSET, an offset puts one character before a reading that is there already, and only the few
    readings that begin behind the last offset are decoded as a whole.
    """
    out, limit = [], min(len(data), MAX_OFFSET)
    for encoding, stride in (("utf-16le", 2), ("utf-8", 1), ("cp949", 1)):
        texts: dict[int, str] = {}
        for at in range((limit - 1) // stride * stride, -1, -stride):
            end = step(data, at, encoding)
            if end not in texts:
                texts[end] = data[end:].decode(encoding, errors="ignore")
            texts[at] = data[at:end].decode(encoding, errors="ignore") + texts[end]
        out += [(encoding, at, texts[at]) for at in range(0, limit, stride) if len(data) - at >= 2]
    return out


@F.pandas_udf(CANDIDATES)
def decodings(payload: pd.Series) -> pd.Series:
    """Each reading of a payload as UTF-16, UTF-8 or CP949 from each offset; null has none."""
    return payload.map(lambda x: [] if x is None else [dict(zip(("encoding", "offset", "decoded"), r)) for r in shared_decodings(x)])


@F.pandas_udf(T.StringType())
def direct_text(payload: pd.Series) -> pd.Series:
    return payload.map(lambda x: None if x is None else x.decode("utf-16le", errors="ignore"))


@F.pandas_udf(T.StringType())
def raw_hex(payload: pd.Series, offset: pd.Series, encoding: pd.Series, text: pd.Series) -> pd.Series:
    """Hex of the bytes that a candidate's text has in the payload, or as many from its offset on."""

    def one(data, at, name, said):
        if data is None or said is None:
            return None
        at = int(at)
        coded = (said.replace("\n", "\r\n") if name == "utf-16le" else said).encode(name, errors="ignore")
        found = data.find(coded, at) if coded else -1
        begin = found if found >= 0 else at
        return data[begin : begin + (len(coded) or 32)].hex()

    return pd.Series([one(*x) for x in zip(payload, offset, encoding, text)])


def candidates(payload: Column) -> Column:
    """The five best texts (priority, score, offset, size, encoding, text): UTF-16 first, then by score; scores are negative twentieths."""
    told = F.transform(decodings(payload), lambda c: F.struct(c["encoding"].alias("encoding"), c["offset"].alias("offset"), tx.meaningful_text(c["decoded"]).alias("text")))
    scored = F.transform(told, lambda c: F.struct(F.when(c["encoding"] == "utf-16le", 0).otherwise(1).alias("priority"), (-tx.text_score(c["text"])).alias("score"), c["offset"].alias("offset"), (-F.length(c["text"])).alias("size"), c["encoding"].alias("encoding"), c["text"].alias("text")))
    return F.slice(F.array_distinct(F.array_sort(F.filter(scored, lambda c: c["score"] < 0))), 1, 5)


def record_texts(records: DataFrame) -> DataFrame:
    """records with candidates, best (null unless accepted), direct and said, what a text record says."""
    df = records.withColumn("candidates", candidates(F.col("payload"))).withColumn("direct", tx.strip_control_codes(direct_text("payload")))
    best = F.get("candidates", 0)
    df = df.withColumn("best", F.when(-best["score"] >= tx.ACCEPTED, best))
    better = best.isNotNull() & (tx.has_artifacts(F.col("direct")) | (F.length(best["text"]) >= F.length("direct")))
    return df.withColumn("said", F.when(better, best["text"]).otherwise(F.col("direct")))


def paragraphs(records: DataFrame, by: tuple = ("doc_id", "stream")) -> DataFrame:
    """Paragraphs of records with texts, in groups that begin at level 0: index, type, record indices, text, its hex.

    by may name more columns, such as a segment; groups do not reach over it.
    """
    by = list(by)
    df = wn.islands(records, by, ["idx"], F.col("level") == 0, "para")
    group = [*by, "para"]
    # Only accepted records decide on, and are subject to, the rule on Hangul.
    told = df.where("best is not null").withColumn("hangul", tx.count_of(F.col("best.text"), tx.HANGUL))
    told = wn.exclusive_hangul(told, group, ["idx"], "hangul").where("accepted").select(*group, "idx", "best", raw_hex("payload", "best.offset", "best.encoding", "best.text").alias("raw_hex"))
    df = df.join(told.select(*group, "idx", F.col("best.text").alias("text"), "raw_hex"), [*group, "idx"], "left")
    kinds = wn.paragraph_types(df, group)
    said = F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("idx", F.trim("text").alias("t"), "raw_hex"))))
    texts = df.groupBy(*group).agg(F.array_sort(F.collect_list("idx")).alias("record_indices"), F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.col("idx")))).alias("text_record_indices"), said.alias("said"))
    first = F.filter("said", lambda s, i: ~F.exists(F.slice("said", 1, i), lambda t: t["t"] == s["t"]))
    joined = texts.select(*group, "record_indices", "text_record_indices", F.array_join(F.transform(first, lambda s: s["t"]), "\n").alias("text_decoded"), F.array_join(F.transform(first, lambda s: s["raw_hex"]), "").alias("text_raw_hex"))
    return joined.join(kinds, group)
