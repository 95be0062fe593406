"""Documents to training sequences: quality, near duplicates, repeated passages, packing.

Each stage takes the documents that the stage before it kept. All but the last return the columns of
`documents`; n_chars follows the text where a stage changes it. `run` writes every stage's rows to the
shared folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetry_lake.llm import packing, quality, simhash, substring
from telemetry_lake.llm.common import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the quality classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judged(docs.select(*COLUMNS), labels).where("keep").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each component of near duplicates the document with the smallest doc_id stays.

    Rows that repeat that doc_id stay with it. Rows with a null doc_id cannot be told apart by it: they stay
    if one of them has a fingerprint that no row with an id has.
    """
    found = simhash.near_duplicates(docs.select("doc_id", "text"))
    kept = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: passages that an earlier document has are cut; documents that lose every word go."""
    cut = substring.deduplicated(docs.select(*COLUMNS))
    changed = cut.withColumn("n_chars", F.when(F.col("n_cut") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.where((F.col("n_cut") == 0) | (F.trim("text") != "")).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the kept documents' tokens in sequences of powers of two."""
    return packing.digest(packing.pieces(docs.select("doc_id", "text")))


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each_group),
    ("repeated_passages", without_repeated_passages),
    ("packing", sequences),
]

# No stage but the last can be written in SQL; tests compare each with a sequential version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
