"""Cleaning pipeline over `documents`: language, toxicity, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last give the columns of
`documents`; the last gives the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import decontaminate, jaccard_join, language_id, packing, toxicity
from newsloom.llm.common import fold, join_ids, materialize, number_rows, table


#: A text may fit its language so many times worse than the worst labelled text that was not learnt from.
FIT_SLACK = 1.1


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has no identifiable language go: null, no letters, or n-grams unlike the predicted language.

    The bound is the worst fit of the labelled texts outside the training fold, times FIT_SLACK. Where nothing was learnt
    or no labelled text is left out, every text with a letter stays.
    """
    held_out = fold(F.col("doc_id"), 4) == 2
    model = language_id.train_machines(docs, ~held_out, typical=True)
    worst = language_id.lowest_fit(docs, held_out, model) if model["families"] else None
    if worst is None:
        return docs.where(F.col("text").rlike(language_id.LETTER))
    found = language_id.predict(docs, model, "__").where(F.col("__lang_pred") != language_id.UNKNOWN)
    return found.where(F.col("__fit") >= min(0.0, worst) * FIT_SLACK).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. Learnt from the labels of these documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels, fold(F.col("doc_id"), 5) != 0)
    return toxicity.score(docs, model, "__").where(F.col("__predicted") == 0).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest doc_id stays; rows with a null doc_id stay. Rows that
    repeat a doc_id are documents of their own here, later than all others, so one of equal rows stays and other texts do."""
    repeated = materialize(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    keyed = docs.withColumn("__key", F.col("doc_id").cast("long"))
    if not repeated.isEmpty():
        rows = materialize(join_ids(docs, repeated, "doc_id", "left_semi").select(*docs.columns).withColumns(
            {"__all": F.lit(0), "__order": F.to_json(F.struct(*docs.columns))}))  # maps have no order of their own
        after = docs.agg(F.max("doc_id")).first()[0] + 1
        numbered = number_rows(rows, "__all", ["__order"], "__key", rows.count()).withColumn("__key", F.col("__key") + after).drop("__all", "__order")
        keyed = materialize(join_ids(keyed, repeated, "doc_id", "left_anti").select(*keyed.columns).unionByName(numbered))
    found = materialize(jaccard_join.jaccard_components(keyed.select(F.col("__key").alias("doc_id"), "text")))
    gone = materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__key")))
    return join_ids(keyed, gone, "__key", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1,024 ids."""
    return packing.pack_documents(docs, *packing.default_tokenizer())


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: No stage before packing has an SQL form (learnt models); the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
