"""A corpus pipeline: documents in, token digests of the mixed clean corpus out.

Each stage takes (spark, docs, folder) and works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillgrain.llm.bytebpe import tokens
from tillgrain.llm.chosenpath import drop_near_duplicates
from tillgrain.llm.common import documents
from tillgrain.llm.digests import drop_exact_duplicates
from tillgrain.llm.mixing import mixed_documents
from tillgrain.llm.perplexity import passing
from tillgrain.session import Scratch


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that fail the base rules or their language's perplexity band go."""
    return passing(docs, Scratch(spark))


def exact(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of equal texts that with the largest doc_id stays."""
    return drop_exact_duplicates(docs, Scratch(spark))


def near(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of linked documents that with the smallest doc_id stays."""
    return drop_near_duplicates(docs, Scratch(spark))


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Whole documents, up to three times each, near the targets of their sources."""
    return mixed_documents(docs, Scratch(spark))


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of the mix."""
    return tokens(docs, Scratch(spark))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

# the language model and the similarity join have no counterpart in SQL
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages; what each returns is written and read again by the next."""
    scratch = Scratch(spark)
    docs = documents(spark, folder)
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
