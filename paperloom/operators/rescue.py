"""Documents of JSON without loss: what has another type than its field is kept beside the document and told.

JSON is read as VARIANT and taken apart by the schema of documents, so one
deviating value costs its own field only, never the struct, array or file
around it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, StringType, StructType

from paperloom.operators import editor as et

RESCUED = "array<struct<path:string,expected:string,found:string,value:string>>"
# Fields that hold JSON of any kind as text.
ANY = ("raw",)


def _let(value: str, name: str, then: str) -> str:
    """then, an expression of name, with value computed once."""
    return f"get(transform(array({value}), {name} -> {then}), 0)"


def _field(v: str, name: str) -> str:
    return f"try_variant_get({v}, '$.{name}', 'variant')"


def _as(v: str, kind: str) -> str:
    return f"try_variant_get({v}, '$', '{kind}')"


def _kind(v: str) -> str:
    return f"regexp_extract(schema_of_variant({v}), '^[A-Z]+', 0)"


def _fits(v: str, kind: DataType) -> str:
    if isinstance(kind, StringType):
        return f"{_kind(v)} = 'STRING'"
    if isinstance(kind, BooleanType):
        return f"{_kind(v)} = 'BOOLEAN'"
    if isinstance(kind, DoubleType):
        return f"{_kind(v)} IN ('BIGINT', 'DECIMAL', 'DOUBLE', 'FLOAT')"
    if isinstance(kind, IntegerType):
        return f"({_kind(v)} = 'BIGINT' AND {_as(v, 'int')} IS NOT NULL)"
    raise TypeError(f"no field of a document is {kind}")


def _typed(v: str, kind: DataType) -> str:
    """SQL for v by kind: null for fields that aren't given and for what has another type."""
    x = v + "_"
    if isinstance(kind, StructType):
        parts = ", ".join(f"'{f.name}', {_let(_field(v, f.name), x, _typed(x, f.dataType))}" for f in kind.fields)
        return f"CASE WHEN {_as(v, 'map<string,variant>')} IS NOT NULL THEN named_struct({parts}) END"
    if isinstance(kind, ArrayType):
        return f"transform({_as(v, 'array<variant>')}, {x} -> {_typed(x, kind.elementType)})"
    if isinstance(kind, StringType):
        return _as(v, "string")
    return f"CASE WHEN {_fits(v, kind)} THEN {_as(v, kind.simpleString())} END"


def _told(path: str, expected: str, v: str) -> str:
    return f"named_struct('path', {path}, 'expected', {expected}, 'found', {_kind(v)}, 'value', to_json({v}))"


def _deviating(v: str, kind: DataType, path: str, unknown: bool) -> str:
    """SQL for the array of what doesn't fit in v."""
    x, none = v + "_", f"CAST(array() AS {RESCUED})"
    if isinstance(kind, StructType):
        object_ = _as(v, "map<string,variant>")
        parts = [_let(_field(v, f.name), x, _deviating(x, f.dataType, f"{path} || '.{f.name}'", unknown)) for f in kind.fields if f.name not in ANY]
        if unknown:
            names = ", ".join(f"'{n}'" for n in kind.names)
            others = f"map_entries(map_filter({object_}, (k, _) -> k NOT IN ({names})))"
            parts.append(f"CAST(transform({others}, e -> {_told(f"{path} || '.' || e.key", 'NULL', 'e.value')}) AS {RESCUED})")
        fits, inner, expected = f"{object_} IS NOT NULL", f"concat({', '.join(parts)})", "OBJECT"
    elif isinstance(kind, ArrayType):
        array = _as(v, "array<variant>")
        inner = f"flatten(transform({array}, ({x}, {x}i) -> {_deviating(x, kind.elementType, f"{path} || '[' || {x}i || ']'", unknown)}))"
        fits, expected = f"{array} IS NOT NULL", "ARRAY"
    else:
        fits, inner, expected = _fits(v, kind), none, kind.simpleString().upper()
    told = _told(path, f"'{expected}'", v)
    return f"CASE WHEN {v} IS NULL OR is_variant_null({v}) THEN {none} WHEN {fits} THEN {inner} ELSE CAST(array({told}) AS {RESCUED}) END"


def documents_of_json(df: DataFrame, json: str = "json", unknown: bool = False, schema: str = et.DOCUMENT) -> DataFrame:
    """df with the fields of documents in place of the JSON, and rescued: (path, expected, found, value) of what doesn't fit.

    A value of another type is null in its field, or its text where a text is
    expected; an element of another type is null in its array, so that places stay. value is
    its JSON. With unknown, fields that documents don't have are told too, with null expected.
    Text that isn't JSON, names a field twice or is beyond what a VARIANT holds is one
    row of found MALFORMED and its own value. Null and empty arrays, objects and texts
    aren't deviations; null text has null fields and nothing to rescue.
    """
    kind = StructType.fromDDL(schema)
    rest = [F.col(f"`{c}`") for c in df.columns if c != json]
    held = df.select(*rest, F.col(f"`{json}`").alias("_json"), F.try_parse_json(F.col(f"`{json}`")).alias("_v"))
    malformed = F.array(F.struct(F.lit("$").alias("path"), F.lit("OBJECT").alias("expected"), F.lit("MALFORMED").alias("found"), F.col("_json").alias("value"))).cast(RESCUED)
    rescued = F.when(F.col("_json").isNotNull() & F.col("_v").isNull(), malformed).otherwise(F.expr(_deviating("_v", kind, "'$'", unknown)))
    fields = [F.expr(_let(_field("_v", f.name), "v", _typed("v", f.dataType))).alias(f.name) for f in kind.fields]
    return held.select(*rest, *fields, rescued.alias("rescued"))


def read_documents(spark: SparkSession, path: str, unknown: bool = False) -> DataFrame:
    """Documents in JSON files, one each, with rescued: editor.read_documents without loss."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("json"))
    return documents_of_json(files, unknown=unknown)
