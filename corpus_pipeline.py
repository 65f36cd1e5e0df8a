"""The corpus pipeline: language, repeated lines, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) with the columns of documents, works on every row its predecessor kept and
returns a DataFrame, written as Parquet in the shared folder and read as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import langid, line_dedup, packing, pii, simhash
from tessel.llm.common import carried, materialize, read


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars anew, where the table has it."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: those whose text is null or has no letter go. lang becomes the predicted one.

    The network learns from the labelled rows of docs that are not held out. Where there is none no language is known, and
    lang becomes "und"; the rule of what stays is the same.
    """
    network = langid.fit(docs.where(~langid.held_out("doc_id")), "doc_id", "text", "lang")
    found = langid.identify(docs, network).where("lettered")
    return carried(docs, found, doc_id="id", text="text", lang="lang_pred")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more share, which stay in the largest doc_id only."""
    return _sized(carried(docs, line_dedup.dedup_lines(docs), doc_id="id", text="kept_text"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id; rows with a null id stay.

    Near copies have a Jaccard similarity of 0.8 or more in their sets of five-word shingles, or are linked by others that
    have. Of rows with the same doc_id all stay if that id does.
    """
    groups = simhash.near_copy_groups(docs).where("id != component_id").select(F.col("id").alias("gone")).distinct()
    held = docs.select(F.col("doc_id").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return held.join(materialize(groups, "gone"), F.col("id") == F.col("gone"), "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in pseudonyms."""
    return _sized(carried(docs, pii.pseudonymize(docs, pii.session_key(spark)), doc_id="id", text="safe_text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 ids; ids as little-endian unsigned 32-bit numbers."""
    return packing.pack(docs)


STAGES = [("language_id", languages), ("line_dedup", lines), ("simhash_near_dedup", near_copies), ("pii", private), ("packing", packed)]

#: Recurrent network and packing have no SQL form; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
