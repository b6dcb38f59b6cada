"""Each stage of the pipeline against brute force over its own input."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from newsloom.llm.common import materialize
from tests.conftest import SF
from tests.llm.test_exact import brute_components, shingles


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 34 !", "en", "s", 7), (10**6 + 2, "", None, None, None), (5, "the repeated row of doc five", "en", "s", 3)], docs.schema)
    state = {"in": materialize(docs.unionByName(odd).unionByName(docs.where("doc_id = 7")))}
    for name, stage in corpus_pipeline.STAGES:
        before, state["in"] = state["in"], materialize(stage(spark, state["in"], SF))
        state[name] = (before, state["in"])
        if name != "packing":
            assert state["in"].columns == columns
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0], r[1] or ""))
    before, after = map(rows, state["language"])
    assert after == [r for r in before if r[1] and any(c.isalpha() for c in r[1])]
    before, after = map(rows, state["toxicity"])
    assert len(after) >= 0.85 * len(before) and set(after) <= set(before)
    before, after = map(rows, state["near_duplicates"])
    found = brute_components([t for _, t in before])
    members, ids, left = {}, Counter(d for d, _ in before), Counter(after)
    for i, row in enumerate(before):
        members.setdefault(found[i][1], []).append(row)
    for own in members.values():  # one row of each component: the smallest id, rows of repeated ids last
        first = [r for r in own if ids[r[0]] == 1]
        stay = [min(first, key=lambda r: r[0])] if first else [r for r in own if left[r]][:1]
        assert len(stay) == 1
        left[stay[0]] -= 1
    assert not any(left.values()) and {t for d, t in after if d == 5} == {t for d, t in before if d == 5}
    before, after = map(rows, state["decontamination"])
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {d for d, t in before if any(k and 100 * len(shingles(t) & k) >= 75 * len(k) for k in items)}
    assert {d for d, _ in after} == {d for d, _ in before} - dirty and dirty
    pieces = state["packing"][1].toPandas()
    assert set(pieces["doc_id"]) == {d for d, _ in after} and (pieces.groupby("sequence_id")["length"].sum() <= 1024).all()


def test_columns_of_the_corpus_stay(spark):
    """Columns that have the names of what the stages compute, and one that cannot be ordered."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    more = docs.unionByName(docs.limit(3)).withColumns(
        {c: F.lit(v) for c, v in (("score", 0.5), ("predicted", "p"), ("lang_pred", "z"), ("fit", "f"), ("root", 1), ("component_id", "c"))}).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    at = materialize(more)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = materialize(stage(spark, at, SF))
        assert at.columns == more.columns and at.dtypes == more.dtypes, name
        assert {(r.score, r.predicted, r.lang_pred, r.fit, r.m["a"]) for r in at.collect()} == {(0.5, "p", "z", "f", 1)}


def test_run_is_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(docs.collect())

    assert docs.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "decontamination", "packing"]
