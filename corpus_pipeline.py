"""A pipeline over ``documents``: from raw texts to token ids of clean ones.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared
folder and reads it again for the next stage. All stages but the last return the columns of documents.

Null and empty texts, and texts without a letter, are in no language and go in the first stage, so later stages
meet texts that line dedup has emptied at most: of those near dedup keeps one, which has no words to match a
benchmark and is one end id to the last stage. Repeated rows are one group of near copies, of which one row stays.
Rows with a null doc_id lose no lines and stay in near dedup, as no document is before them. Empty tables give an
empty result. Extra columns of documents, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import langid, lineruns, sentencepieces, simhash, templates
from wardline.llm.common import ship, table
from wardline.llm.queries import TOKENIZERS


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: texts without a letter or in no known language go."""
    ship(spark)
    return langid.accepted(docs, langid.trained(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: lines of runs that occur before, and of single lines that are passages, go from the texts; all documents stay."""
    ship(spark)
    return lineruns.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each group of near copies, at a similarity of 0.8 or more, the document with the smallest doc_id stays."""
    ship(spark)
    return simhash.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a benchmark item, copied or with other values, go."""
    ship(spark)
    return templates.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: token counts and digests of the ids and of the text that they decode to."""
    ship(spark)
    return sentencepieces.sentencepiece_digest(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("tokens", tokens)]
#: The last stages have no SQL form; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs, "stage")
    return docs
