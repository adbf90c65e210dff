"""Training-data pipeline over ``documents``: filter, deduplicate, decontaminate, mix, tokenize.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's ``docs``. All but the last keep the columns of ``documents``. Each stage's module defines what it
does with nulls, empty texts, ties and repeated rows. The last stage writes the token files and returns their
documents. Its rows need a tokenizer and a learned model, which SQL cannot express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm.common import table, written
from ledgerlake.llm.decontaminate import contamination
from ledgerlake.llm.jaccard_join import one_of_each
from ledgerlake.llm.mixing import mixed_documents
from ledgerlake.llm.queries import tokenizer_path
from ledgerlake.llm.token_files import encode_documents, read_documents
from ledgerlake.llm.toxicity import labelled_sample, learn, scored
from ledgerlake.session import ship_package


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar does not predict to be toxic."""
    ship_package(spark)
    model = learn(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic"))
    return scored(docs, model).where("predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8."""
    ship_package(spark)
    return one_of_each(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    ship_package(spark)
    return contamination(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship_package(spark)
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; returns doc_id, start, n_tokens, ids_crc32 read back from them."""
    ship_package(spark)
    return read_documents(*encode_documents(docs, tokenizer_path()))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix),
          ("tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
