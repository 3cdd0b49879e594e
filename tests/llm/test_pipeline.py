"""The corpus pipeline on a small folder, stage by stage."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seedplane.llm import langid

WORDS = {"en": "the of and that with for this under over house water", "de": "der und mit von ist nicht auch haus wasser unter"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    chance = random.Random(11)
    path = tmp_path_factory.mktemp("sf")
    make = lambda lang, n: " ".join(chance.choice(WORDS[lang].split()) for _ in range(n))
    texts = [(make(lang, 60), lang) for lang in ("en", "de") * 30]
    leak = make("en", 30)
    texts += [(texts[0][0], "en"), (texts[1][0] + " extra", "de"), ("12 34 !!", "en"), (None, "en"), (make("en", 40) + " " + leak, "en"), ("Mail jo.doe@corp.com and " + make("en", 30), "en")]
    rows = [(i, t, lang, "s", len(t or ""), i) for i, (t, lang) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    n = docs.count()
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "tokens":
            assert sorted(out.columns) == sorted(docs.columns) and out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        kept.append(out.select("doc_id").distinct().count())
    assert kept == [n - 2, n - 4, n - 5, n - 5, n - 5]
    assert docs.filter(F.col("text").contains("jo.doe")).count() == 0
    assert docs.filter(F.col("text").rlike(r"[a-z.]+@example\.(com|net|org)")).count() == 1


def test_run_equals_its_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert got.count() == 61
    assert all(re.fullmatch("[0-9a-f]{64}", r.ids_sha256) for r in got.collect())


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_families_are_disjoint():
    codes = [c for cs in langid.FAMILIES.values() for c in cs.split()]
    assert len(codes) == len(set(codes))
