"""Little-endian words, style bits and images as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(data: Column, size: int) -> Column:
    """Whole unsigned little-endian words of size bytes, as longs."""
    n = F.floor(F.octet_length(data) / size).cast("int")
    word = lambda i: F.conv(F.concat(*[F.hex(F.substring(data, i * size + size - k, F.lit(1))) for k in range(size)]), 16, 10).cast("long")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), word)).otherwise(F.array().cast("array<bigint>"))


def u16_list(data: Column) -> Column:
    return words(data, 2)


def u32_list(data: Column) -> Column:
    return words(data, 4)


def u16_at(data: Column, at: int) -> Column:
    """The unsigned word of two bytes at a byte, null when data ends before; no other word is read."""
    return F.when(F.octet_length(data) >= at + 2, F.get(words(F.substring(data, at + 1, 2), 2), 0))


def u32_at(data: Column, at: int) -> Column:
    """The unsigned word at a byte, null when data ends before."""
    return F.when(F.octet_length(data) >= at + 4, F.get(words(F.substring(data, at + 1, 4), 4), 0))


def file_header(data: Column) -> Column:
    """(signature, version_raw, flags, is_compressed) of a file header; under 40 bytes is an error."""
    flags = u32_at(data, 36)
    found = F.struct(F.substring(data, 1, 32).alias("signature"), u32_at(data, 32).alias("version_raw"), flags.alias("flags"), (flags.bitwiseAND(F.lit(1)) == 1).alias("is_compressed"))
    return F.when(F.octet_length(data) >= 40, found).otherwise(F.raise_error(F.lit("file header under 40 bytes")).cast("struct<signature:binary,version_raw:bigint,flags:bigint,is_compressed:boolean>"))


def record_header(word: Column) -> Column:
    """(tag_id, level, size) of a record's first word."""
    return F.struct(word.bitwiseAND(F.lit(1023)).alias("tag_id"), F.shiftright(word, 10).bitwiseAND(F.lit(1023)).alias("level"), F.shiftright(word, 20).bitwiseAND(F.lit(4095)).alias("size"))


def alignment(shape: Column) -> Column:
    """Of a paragraph shape's first word."""
    bits = shape.bitwiseAND(F.lit(0x0C))
    return F.when(bits == 4, "left").when(bits == 8, "right").when(bits == 12, "center")


def char_shape(size: Column, flags: Column) -> Column:
    """(bold, font_size_pt) of the eleventh and twelfth words."""
    return F.struct((flags.bitwiseAND(F.lit(0x20000)) != 0).alias("bold"), F.bround(F.floor(size / 65536) / 100, 2).alias("font_size_pt"))


def list_bits(flags: Column) -> Column:
    """(numbering_ref, level) of a paragraph shape's eighth word, or null."""
    ref = F.shiftright(flags, 16).bitwiseAND(F.lit(0xFFFF))
    return F.when((flags > 0) & (ref > 0), F.struct(ref.alias("numbering_ref"), flags.bitwiseAND(F.lit(0xFFFF)).alias("level")))


def cell_place(u16: Column, order: Column) -> Column:
    """(row_index, column_index, colspan, rowspan) of a cell's words; order is the column where they lack."""
    at = lambda k, other: F.coalesce(F.get(u16, k), other)
    span = lambda k: F.coalesce(F.nullif(F.get(u16, k), F.lit(0)), F.lit(1))
    return F.struct(at(5, F.lit(0)).alias("row_index"), at(4, order).alias("column_index"), span(6).alias("colspan"), span(7).alias("rowspan"))


def control_kind(payload: Column) -> Column:
    """header, footer or page_number by a control's first bytes."""
    prefix = F.hex(F.substring(payload, 1, 4))
    return F.when(prefix == "64616568", "header").when(prefix == "746F6F66", "footer").when(prefix == "6F6E7461", "page_number")


def page_number(payload: Column) -> Column:
    number = u32_at(payload, 8)
    return F.when(number > 0, number.cast("string"))


def emu_to_px(emu: Column) -> Column:
    """Pixels, halves to even; null unless positive."""
    px = F.bround(emu / 9525, 0).cast("long")
    return F.when(px > 0, px)


def data_url_bytes(url: Column) -> Column:
    """What a base64 data URL holds, null when it is none or damaged."""
    return F.when(url.rlike("^data:[^,]*;base64,"), F.try_to_binary(F.regexp_replace(url, "^[^,]*,", ""), F.lit("base64")))


def data_url(name: Column, content: Column) -> Column:
    """A data URL with the MIME type that the file name's suffix says."""
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z]+)$", 1))
    mime = F.when(suffix.isin("jpg", "jpeg"), "image/jpeg").when(suffix == "gif", "image/gif").when(suffix == "bmp", "image/bmp").otherwise("image/png")
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def is_image(content: Column) -> Column:
    """Whether the first bytes are of PNG, JPEG, GIF or BMP."""
    head = F.hex(F.substring(content, 1, 8))
    return head.startswith("89504E470D0A1A0A") | head.startswith("FFD8FF") | head.startswith("474946383761") | head.startswith("474946383961") | head.startswith("424D")


def stream_metadata(payload: Column) -> Column:
    """(size, sha256, preview) of a stream; preview is hex of its first 64 bytes."""
    return F.struct(F.octet_length(payload).cast("long").alias("size"), F.sha2(payload, 256).alias("sha256"), F.lower(F.hex(F.substring(payload, 1, 64))).alias("preview"))
