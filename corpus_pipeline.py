"""The corpus pipeline: quality rules, near duplicates, benchmark leaks, personal data, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents, whatever further
ones there are. A null or empty text fails the quality rules, so later stages see none of this
table's, but take them: they are kept, match nothing and have no spans and no pieces. Repeated rows
are copies, of which the second stage leaves one; an empty table stays empty in every stage; texts
are read whole, very long ones as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curvecast.llm import decontaminate, jaccard, pieces, pii, quality
from curvecast.llm.common import settle_last, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the compression bands, as they are; equal rows share their fate."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the least (doc_id, text hash), null ids
    first; documents without words stay."""
    return jaccard.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks; without items all stay."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced by their kind; a null text stays null."""
    return pii.redact_documents(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, pieces, n_pieces, lossless of all documents; a null id draws as 0, a null text has none."""
    return pieces.encode_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", piece_encoding),
]

#: Compression bands, sketches and sampled pieces have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table, and those it needed on the way, go once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = settle_last(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), *before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
