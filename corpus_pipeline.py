"""The corpus pipeline: documents to packed training sequences, one stage after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, langid, packing, pii, simhash, similar
from larkspur.llm.common import materialise, numbered
from larkspur.llm.queries import tokenizer_files


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression can decide; null, empty and letterless texts can't be. Every row is judged alone, so repeated rows and null ids change nothing."""
    return langid.accepted(docs, langid.dictionaries(docs.where(~langid.held_out(F.col("doc_id")))))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: fingerprints at two bits or fewer, or a five-word similarity of 0.8 or more.

    Rows are told apart by their place, so rows of one doc_id and rows without one are compared like all others. The row with the smallest
    doc_id stays, null ids last, then the first row. Null and wordless texts form one group. An empty table stays empty.
    """
    rows = numbered(docs, "dedup-rows")
    texts = rows.select("row", F.col("doc.text").cast("string").alias("text"))
    close = simhash.row_links(texts.withColumnRenamed("row", "doc_id"))
    found = similar.components(texts.withColumnRenamed("row", "id"), close)
    members = materialise(rows.select("row", F.col("doc.doc_id").alias("doc_id")).join(found.withColumnRenamed("id", "row"), "row"), "dedup-members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))["row"].alias("first")
    stay = materialise(members.groupBy("component").agg(first), "dedup-stay")
    drop = materialise(members.join(stay, "component").where("row <> first").select("row"), "dedup-drop")
    return rows.join(drop, "row", "left_anti").select("doc.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items; repeated rows and rows without id go by their own text, and null texts stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data masked and n_chars counted anew; null texts stay null."""
    return pii.masked(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences and their places: every row at least one piece, null texts the end id alone."""
    return packing.pack(docs, **tokenizer_files())


STAGES = [("language", language), ("deduplicate", deduplicate), ("decontaminate", decontaminated), ("mask personal data", private), ("pack", packed)]

#: Compression, fingerprints and tokenizers are beyond SQL: the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
