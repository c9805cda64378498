"""A training corpus from raw documents: five stages, each one operator of ``attrition.llm``.

1. language ID: documents whose language is rejected go;
2. line dedup: multi-line chunks that an earlier document holds go from texts;
3. SimHash near-dedup: of each group of near copies the first document stays;
4. PII: personal data in texts is masked;
5. packing: token sequences of at most 1,024 ids.

Each stage gets the rows its predecessor wrote.  All but the last return the
columns of ``documents``.  Nulls, empty tables, repeated rows and further columns
are handled as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attrition.llm.common import read, written
from attrition.llm.language_id import drop_rejected
from attrition.llm.line_dedup import dedup_lines
from attrition.llm.packing import pack_documents
from attrition.llm.pii_semicrf import mask_personal_data
from attrition.llm.simhash_golay import keep_one_of_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_rejected(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_personal_data(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, keep_ids=False)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The language model, the random field and the tokenizer aren't SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
