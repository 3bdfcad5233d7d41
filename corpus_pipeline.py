"""A training-corpus pipeline: each stage applies one operator to what the stage before it kept.

Every stage but the last returns the columns of documents. Null and empty texts are no evidence of
anything: they pass all filters and are packed as an end id alone. Rows with a null id pass the filters
that go by id. Rows that repeat an id share its fate where a stage decides by id (line dedup,
near-dedup, decontamination); toxicity decides by each text. Ties go to the smaller id. Empty tables
give empty results; without labels of both classes no document is toxic, and without benchmark items
none is contaminated.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from meterlake.llm import decontaminate, linedup, neardup, packing, toxicity
from meterlake.llm.queries import table, tokenizer_path
from meterlake.llm.tasks import crc_mod
from meterlake.sources.folders import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; learned from the labels that are not held out."""
    model = toxicity.train_model(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2))
    return toxicity.keep_clean(docs, model, threshold=0.3)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand, equal or nearly so, earlier in the corpus; those that lose all text go."""
    return linedup.remove_lines(docs, drop_emptied=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with similar five-word shingles."""
    return neardup.drop_near_duplicates(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Hashed models, MinHash and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
