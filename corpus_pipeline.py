"""Documents to packed training sequences: each stage is one of the corpus operators.

run() writes each stage's rows to the shared folder and reads them again as the next stage's documents.
Any further columns of documents pass through all stages but the last, whatever their names. Null texts
count as empty: they score the prior, have no lines, are near duplicates of each other (those with a null
doc_id stay), hold no benchmark item and give no sequence. Repeated rows stay alike. Of an empty table
nothing is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontam, linededup, packing, simhash, toxicity
from textloom.llm.common import Scratch, table, without_ids


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that op5 calls toxic go."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more go, and documents of which nothing is left."""
    out = linededup.edited_rows(docs).where((F.col("n_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))

    def kept(c: str) -> Column:
        own = F.col("text") if c == "text" else F.col("row").getField(c)
        return (F.when(F.col("n_deleted") == 0, own).otherwise(F.length("text").cast(docs.schema[c].dataType)) if c == "n_chars" else own).alias(c)

    return out.select(*map(kept, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that word shingles link, the one with the smallest doc_id stays."""
    groups = simhash.near_duplicates(docs)
    return without_ids(docs, Scratch(spark, "near").save(groups.where("doc_id != first").select("doc_id").distinct(), "gone"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    hits = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without_ids(docs, Scratch(spark, "leaks").save(hits.where("doc_id is not null").select("doc_id").distinct(), "gone"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batches of sequences that are left."""
    return packing.pack(docs)


STAGES = [("toxicity", reject_toxic), ("line dedup", delete_repeated_lines), ("simhash near-dedup", drop_near_duplicates), ("benchmark decontamination", decontaminate), ("packing", pack_sequences)]

#: Training, components and repeated runs are beyond SQL; a test holds each stage against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
