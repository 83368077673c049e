"""The training corpus: documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gets what the one before kept, written as Parquet
and read again. All but the last return the columns of documents:

- language: documents without a known language go, and those whose language is not predicted
  with at least MIN_LANGUAGE_SCORE;
- near-duplicates: of each group of texts linked by a similarity of at least 0.8 on five-word
  shingles the document with the smallest doc_id stays;
- decontamination: documents that share a window of words with a benchmark item go;
- secrets: spans found by the secret scan are replaced in the text, and n_chars follows;
- packing: the documents' pieces with their places in sequences.

Nulls: a null text, or one without a letter, has no known language and goes in the first stage; a
null doc_id is kept like any other. Of repeated rows, which are copies, one stays. Empty tables give
empty ones in each stage. Texts of any length are read whole. Other columns, whatever their names,
are carried along to the last stage, which returns its own alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import common, decontaminate, language_id, near_copies, packing, secret_scan

#: The least score of a language: near that of a guess where the corpus has few languages; raise it to be stricter.
MIN_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs, language_id.train(docs), MIN_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.survivors(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, keep_ids=False)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packed),
]

#: Its first stage is a trained model, which SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.staged(docs, f"pipeline-{name}")
    return docs
