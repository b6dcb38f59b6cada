"""The language stage lets the learnt languages decide."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string"


def test_unlike_texts_go(spark):
    docs = spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(3)
    junk = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(40)) for _ in range(20)]
    junk += ["xqzk " * 30, "жизнь хороша и прекрасна в этом мире " * 3, "日本語の文章です。" * 5]
    clean = ["The and of with that this is", "Der die das und nicht mit von", None, "12 34 !"]
    odd = spark.createDataFrame([(10**7 + i, t, None) for i, t in enumerate(junk + clean)], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs.unionByName(odd), SF).select("doc_id").collect()}
    letters = {r.doc_id for r in docs.where(F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}
    first = 10**7 + len(junk)
    assert kept == letters | {first, first + 1}


def test_nothing_learnt(spark):
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(["some text", "xq zk", None, "", "12"])], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.language_stage(spark, docs, SF).collect()) == [0, 1]
