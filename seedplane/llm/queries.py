"""The registered queries of the training-data operators: name -> query, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_extract, jaccard, langid, license_scan, lm_score, pii, topk, url_filter
from .common import table


#: The key of the registered queries' surrogates; a real run brings its own secret.
KEY = "registered-query-key"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digested(table(spark, sf_dir, "documents"), vocabulary())


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.scores(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 4) for c in ("log_score", "mean_log_score")})


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), url_filter.CONTRACT_RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_lm": op2_lm,
    "op3_pii": op3_pii,
    "op4_html": op4_html,
    "op5_license": op5_license,
    "op6_topk": op6_topk,
    "op7_decontaminate": op7_decontaminate,
    "op8_langid": op8_langid,
    "op9_urls": op9_urls,
    "op10_jaccard": op10_jaccard,
}

ORACLE: dict[str, str] = {
    "op2_lm": lm_score.oracle(),
    "op6_topk": """
with x as (select vec_id, list_transform(embedding, lambda v: floor(64 * v::double)::bigint) as v from embeddings where embedding is not null),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score from x q, x c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 20
""",
    "op9_urls": url_filter.oracle(),
}
