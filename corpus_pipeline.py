"""The corpus pipeline: toxicity, quality, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; ``run``
writes every stage's result as Parquet into the shared folder and reads it back.

For all stages: null texts are read as empty, repeated rows and keys are documents of their
own, an empty table gives no rows, and further columns are kept whatever their names, except
that toxicity, packing and quality raise on a column named like one of their results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmatch.llm import near_dup, packing, pii, quality, toxicity
from pairmatch.llm.bpe import tokenizer_path
from pairmatch.llm.common import fresh, publish, table

#: No SQL: the classifier, the samples, the trees and the packing have no short form in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold of their language.

    Null and empty texts are scored like any other; without labels of both classes no
    classifier can be trained and every document stays.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, "text", model)
    return scored.where(~F.col("rejected")).select(docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, and their host's verdict.

    A null or empty text has no words and fails; a null source is a host of its own.
    """
    return quality.judge(docs, "text", "source").where("kept").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates, the one with the smallest id.

    Equal texts, empty ones included, are one class; of rows equal in id and text one stays.
    """
    return near_dup.keep_one(docs, "doc_id", "text", near_dup.Plan(plain=False))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced by their kind, ``n_chars`` counted anew.

    A null text stays null and keeps its ``n_chars``.
    """
    spans = fresh(docs.columns, "_spans")
    clean = pii.redact(pii.detect(docs, "text", spans), "text", spans)
    count = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", F.coalesce(count, F.col("n_chars"))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids; an empty text is its end mark alone."""
    return packing.pack(docs, "doc_id", "text", tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the whole corpus of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = publish(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
