"""A training-corpus pipeline: each stage is one operator over all documents that its predecessor kept.

1. ``language``: language ID; documents without a recognisable language (``und``) go, and so do those whose
   score is below ``LEAST_SCORE``. ``lang`` becomes the predicted language.
2. ``near_duplicates``: n-gram Jaccard join on five words at 0.8; of each group the document with the
   smallest doc_id stays.
3. ``benchmark``: documents that overlap with a benchmark item go.
4. ``private``: detected entities are replaced by surrogates; ``n_chars`` follows the text.
5. ``tokens``: the documents as BPE ids, with digests of the ids and of the decoded text.

Edge cases are the operators' own: null or empty texts have no language and go in the first stage; an empty
table passes through as an empty table; extra columns are kept up to the last stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedplane.llm import bpe, decontaminate, jaccard, langid, pii
from seedplane.llm.common import shared_dir, table
from seedplane.llm.queries import KEY, vocabulary

LEAST_SCORE = 0.05
WORDS = 5
PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = langid.identify(docs)
    kept = judged.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    group = jaccard.groups(docs, words=WORDS, percent=PERCENT)
    first = group.filter("component_id = doc_id").select("doc_id").distinct()
    # rows without an id have no group and stay; of rows that repeat an id and a text one stays
    known = docs.filter("doc_id is not null").join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return known.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.pseudonymised(docs, KEY)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digested(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("private", private),
    ("tokens", tokens),
]

#: The first stage's classifier is trained, which SQL can't say; tests count what each stage keeps.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
