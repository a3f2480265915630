"""A corpus pipeline of the operators in galefold.llm.

STAGES: quality classifier, near-dedup (operator 2's index, by `keep_one`), benchmark decontamination,
secret scans, best-fit packing. Each function takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again for the next stage. All but the last return the
columns of documents:

* quality: rows that score under the threshold go (labels of sf_dir are learnt from).
* near_duplicates: of each group of equal or similar texts one row stays.
* decontaminate: rows that overlap with an item of sf_dir's benchmark go.
* secrets: every row stays; secrets in its text are redacted and n_chars follows.
* pack: a row a piece of a document, with its token ids and place in a sequence.

What each does with nulls, empty texts, repeated rows and empty tables stands with the
operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from galefold.llm import decontamination, packing, quality, secrets, simhash
from galefold.llm.common import saved, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("secrets", secret_stage),
    ("pack", packing_stage),
]

#: A fitted model, fingerprints and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
