"""A pipeline over ``documents``: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage works on all that its predecessor kept. All but the last return the
columns of documents: the first drops lines and documents, the next two drop
documents, the fourth replaces secrets within texts, the last one packs what is
left. Columns beside those of documents stay as they are, whatever their names,
and empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import packing, quality, secrets, simhash, templates
from paperloom.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without the lines that fail.

    Null, empty and short texts fail. Repeated rows stay repeated, however long a text is.
    """
    found = quality.clean_lines(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))).where("quality.kept")
    changed = F.col("quality.cleaned_text") != F.col("row.text")
    n_chars = F.when(changed, F.length("quality.cleaned_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    made = {"text": F.col("quality.cleaned_text"), "n_chars": n_chars}
    return found.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, as simhash.one_of_each chooses it."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of benchmark; rows with equal texts stay or go together, null texts stay, long ones are read whole."""
    return templates.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by their kinds, however long; null texts stay null, repeated rows come out alike."""
    return secrets.redact(docs, n_chars="n_chars")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, and their places in sequences; null texts are empty, repeated rows packed repeatedly, longer texts than a sequence cut."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: SimHash components and tokens can't be had from SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
