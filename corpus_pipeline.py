"""A corpus from raw documents to packed sequences.

Language identification drops documents in no known language, near-duplicate search keeps one document of each group,
passages that repeat (over 50 words or 400 bytes) leave the texts, documents with benchmark passages go, and the rest is packed into sequences.
Every stage reads what its predecessor wrote; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heliospark.llm.frames import materialise, prepare, table
from heliospark.llm.language import recognised
from heliospark.llm.pack import PackOptions, pack
from heliospark.llm.queries import public_tokenizer
from heliospark.llm.repeats import without_repeats
from heliospark.llm.similar import without_similar
from heliospark.llm.winnow import without_contaminated


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return recognised(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_similar(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs, length=200, words=50, size=400)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, PackOptions(public_tokenizer()))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL states neither the learned language nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
