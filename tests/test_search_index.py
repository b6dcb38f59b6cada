"""The kept index against scoring every document by hand."""

import math
import random
import re
from collections import Counter
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.operators import search_index
from newsloom.operators.search import B, K1
from newsloom.operators.search_index import SearchIndex
from newsloom.sources import store

FIELDS = {"title": 3.0, "body": 1.0}
ROW = "doc_id long, source string, published_at timestamp_ntz, title string, body string, extra string"


def table(spark, docs):
    rows = [(i, s, t, title, body, "x") for i, (s, t, title, body) in docs.items()]
    return spark.createDataFrame(rows, ROW.replace("timestamp_ntz", "string")).withColumn("published_at", F.col("published_at").cast("timestamp"))


def brute(docs, words, sources, limit, offset):
    read = {i: {f: re.findall(r"[^\W_]{2,}", (d[2 + k] or "").lower()) for k, f in enumerate(FIELDS)} for i, d in docs.items()}
    score = {}
    for f, weight in FIELDS.items():
        mean = sum(len(r[f]) for r in read.values()) / max(1, len(read))
        for w in set(words):
            df = sum(w in r[f] for r in read.values())
            for i, r in read.items():
                if tf := r[f].count(w):
                    idf = math.log(1 + (len(read) - df + 0.5) / (df + 0.5))
                    score[i] = score.get(i, 0) + weight * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(r[f]) / mean))
    hits = [(round(s, 6), i) for i, s in score.items() if sources is None or docs[i][0] in sources]
    hits.sort(key=lambda h: (-h[0], [-ord(c) for c in docs[h[1]][1]], h[1]))
    return [(i, s, len(hits)) for s, i in hits][offset : offset + limit]


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(4)
    words = ["alfa", "beta", "gamma", "delta", "eta", "teta", "iota", "kappa"]
    some = lambda k: " ".join(rng.choices(words, weights=range(8, 0, -1), k=k))
    one = lambda: (rng.choice("abc"), f"2024-0{rng.randint(1, 9)}-01", rng.choice([some(2), None, ""]), some(rng.randint(0, 12)))
    index = SearchIndex(spark, store.work_folder(spark, "test-search"), tuple(FIELDS), buckets=8)
    docs = {i * 700: one() for i in range(40)}
    index.replace(table(spark, docs))
    second = {i: one() for i in [*list(docs)[::3], 9, 11]}
    index.replace(table(spark, second))
    docs |= second
    gone = [0, 700, 11, 123456]  # the last one does not exist
    index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    docs = {i: d for i, d in docs.items() if i not in gone}
    return index, docs


def same(found, true):
    assert [(r[0], r[2]) for r in found] == [(i, n) for i, _, n in true]
    assert all(abs(r[1] - s) < 2e-6 for r, (_, s, _) in zip(found, true, strict=True))


ASKED = [("eta iota", None, 50, 0), ("ALFA kappa!", ["a", "c"], 7, 3), ("alfa alfa", ["b"], 5, 0), ("nothing", None, 5, 0)]


@pytest.mark.parametrize("asked", ASKED)
def test_updates_and_compaction(spark, made, asked):
    index, docs = made
    text, *how = asked
    true = brute(docs, re.findall(r"\w{2,}", text.lower()), *how)
    same(index.search(text, FIELDS, *how).collect(), true)
    assert [r[0] for r in index.search(text, FIELDS, *how, total=False).collect()] == [i for i, _, _ in true]


def test_compacted(spark, made):
    index, docs = made
    seg = index.compact()
    assert index.segments() == [seg]
    for _ in range(2):  # before and after the old files go
        for text, *how in ASKED:
            same(index.search(text, FIELDS, *how).collect(), brute(docs, re.findall(r"\w{2,}", text.lower()), *how))
        index.vacuum()
    assert store.children(spark, f"{index.root}/postings") == [f"seg={seg}"]


def test_failed_update_is_invisible(spark, made):
    index, docs = made
    seg = index._next()
    spark.createDataFrame([("title", "iota", 0, 5, 1, 1, "a", 1)], "field string, term string, chunk long, doc_id long, tf long, length long, source string, bucket int").write.partitionBy(
        "bucket").parquet(f"{index.root}/postings/seg={seg}")
    same(index.search("iota", FIELDS, None, 50, 0).collect(), brute(docs, ["iota"], None, 50, 0))
    index.vacuum()
    assert f"seg={seg}" not in store.children(spark, f"{index.root}/postings")


def test_blank_and_empty(spark, made):
    index, _ = made
    assert index.search(" .", FIELDS).count() == index.search("alfa", FIELDS, []).count() == 0
    empty = SearchIndex(spark, store.work_folder(spark, "test-search"), tuple(FIELDS))
    assert empty.search("alfa", FIELDS).count() == 0
    empty.replace(table(spark, {}))
    assert empty.search("alfa", FIELDS).count() == 0


def test_a_query_opens_only_its_buckets(spark, made):
    index, _ = made
    plan = index._of_terms("postings", ["kappa"])._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert re.search(r"bucket#\d+ (=|IN) ", filters) and "seg#" in filters
    assert "EqualTo(term,kappa)" in plan.split("PushedFilters: [")[1]


def test_an_update_deals_documents_once(spark):
    """Postings are counted and written by the task that has the chunk: no shuffle of terms, no table beside the postings."""
    index = SearchIndex(spark, store.work_folder(spark, "test-search"), tuple(FIELDS), buckets=8)
    plans, write = [], index._write_postings
    index._write_postings = lambda rows, seg: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), write(rows, seg))
    index.replace(table(spark, {i: ("a", "2024-01-01", "alfa", "beta") for i in (-1500, -1, 0, 63, 64, 1023, 1024)}))
    assert plans[0].count("Exchange ") == 1
    index.delete(spark.createDataFrame([(i,) for i in (-1, 63, 1024)], "doc_id long"))
    index.compact()
    assert plans[1].count("Exchange ") <= 3  # of the dead alone
    assert [r["doc_id"] for r in index.search("beta", FIELDS).orderBy("doc_id").collect()] == [-1500, 0, 64, 1023]
    assert "blocks" not in store.children(spark, index.root)


def test_words_are_counted_where_they_are(spark):
    """The words of a text never are rows of their own."""
    index = SearchIndex(spark, store.work_folder(spark, "test-search"), tuple(FIELDS), buckets=8)
    plans, write = [], index._write_postings
    index._write_postings = lambda rows, seg: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), write(rows, seg))
    index.replace(table(spark, {1: ("a", "2024-01-01", "alfa", "beta " * 5000)}))
    assert plans[0].count("MapInArrow") >= 1 and plans[0].count("Generate ") <= 1 and "collect_list" not in plans[0]
    assert [tuple(r) for r in index.search("beta", FIELDS).select("doc_id", "total").collect()] == [(1, 1)]


@pytest.mark.parametrize("counted", [1, 7, 1 << 20])
def test_counter_against_dictionaries(monkeypatch, counted):
    monkeypatch.setattr(search_index, "COUNTED", counted)
    rng, ids = random.Random(counted), sorted(random.Random(1).sample(range(-3000, 3000), 60))
    rows = [(i >> search_index.CHUNK, i, rng.choice(["s", None]), f, " ".join(rng.choices(["alfa", "beta", "bles", "ble"], k=rng.choice([0, 1, 9])))) for i in ids for f in FIELDS]
    batch = pa.RecordBatch.from_pylist([dict(zip(("chunk", "doc_id", "source", "field", "words"), r, strict=True)) | {"published_at": datetime(2024, 1, 1)} for r in rows],
                                       schema=pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("source", pa.string()), ("field", pa.string()), ("words", pa.string()), ("published_at", pa.timestamp("us", "UTC"))]))
    found, listed, keys = Counter(), [], []
    for r in (r for out in search_index._counter({"bles": "ble"})([batch, batch.slice(0, 0)]) for r in out.to_pylist()):
        posts = [((r["chunk"] << search_index.CHUNK) + (p & (1 << search_index.CHUNK) - 1), p >> search_index.CHUNK) for p in r["posts"]]
        keys.append((r["field"], r["term"], r["chunk"]))
        lengths = {i: len(w.split()) for _, i, _, f, w in rows if f == r["field"]}
        assert r["most_tf"] == max(n for _, n in posts) and r["least_length"] == min(lengths[i] for i, _ in posts)
        if r["term"]:
            found.update({(r["field"], r["term"], i): n for i, n in posts})
            assert r["docs"] is None
        else:
            assert [(d["doc_id"], 1) for d in r["docs"]] == posts
            listed += [(r["chunk"], d["doc_id"], d["source"], r["field"], d["length"]) for d in r["docs"]]
    assert found == Counter((f, {"bles": "ble"}.get(w, w), i) for _, i, _, f, words in rows for w in words.split())
    assert sorted(listed, key=str) == sorted([(*r[:4], len(r[4].split())) for r in rows], key=str)
    assert len(keys) == len(set(keys))  # one batch is cut between chunks


def test_stems_are_counted_as_words(spark):
    stem = lambda words, column, out: words.withColumn(out, F.substring(column, 1, 3))
    index = SearchIndex(spark, store.work_folder(spark, "test-search"), tuple(FIELDS), stem=stem, buckets=8)
    docs = {1: ("a", "2024-01-01", None, "alfa alfe beta"), 2: ("a", "2024-01-02", "alfi", ""), 3: ("a", "2024-01-02", "gamma", "beta")}
    index.replace(table(spark, docs))
    read = {i: (s, t, *[" ".join(w[:3] for w in (x or "").split()) for x in rest]) for i, (s, t, *rest) in docs.items()}
    same(index.search("alfo", FIELDS).collect(), brute(read, ["alf"], None, 20, 0))


@pytest.mark.parametrize("most", [0, 3])
def test_chunks_of_dead_documents_go_to_every_task(spark, monkeypatch, most):
    """Their chunks are counted, not the documents."""
    for name in ("BROADCAST_GONE", "BROADCAST_DEAD"):
        monkeypatch.setattr(search_index, name, most, raising=False)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    index = SearchIndex(spark, store.work_folder(spark, "test-search"), tuple(FIELDS), buckets=8)
    index.replace(table(spark, {i: ("a", "2024-01-01", "alfa", "beta") for i in range(-200, 200)}))
    index.delete(spark.range(-150, 190).withColumnRenamed("id", "doc_id"))
    spark.conf.set(threshold, "-1")
    try:
        plan = index._alive(index._read("postings"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    assert ("BroadcastHashJoin" in plan) == (most > 0)
    index.compact()
    assert sorted(r["doc_id"] for r in index._documents(index._read("postings").where("field = 'body'")).collect()) == [*range(-200, -150), *range(190, 200)]
