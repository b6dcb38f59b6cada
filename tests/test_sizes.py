"""Work that grows with the input, not with products of it: the rows that joins give, over tables where products are large."""

import io
import random
import re
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsloom import registry
from newsloom.operators import alerts as alert_operators
from newsloom.operators import extractors, maintenance, upkeep
from newsloom.operators.alerts import daily_digest, match_alerts
from newsloom.operators.classify import drop_subsumed, term_counts
from newsloom.operators.enrichment import best_candidates
from newsloom.operators.search import term_statistics
from newsloom.sources import archives, store
from tests.conftest import SF


def most_joined(df) -> int:
    """The most rows that a join of the executed plan gives."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    most, todo = 0, [plan]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(p.plan())
        else:
            if "Join" in name and p.metrics().contains("numOutputRows"):
                most = max(most, p.metrics().get("numOutputRows").get().value())
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """200 users and 300 sources of one category: 60,000 subscriptions."""
    top = tmp_path_factory.mktemp("wide")
    spark.range(200).select(F.col("id").alias("s_suppkey"), F.format_string("S%d", "id").alias("s_name"), F.lit(6).alias("s_nationkey"), F.lit(0.0).alias("s_acctbal")).write.parquet(f"{top}/supplier.parquet")
    spark.range(300).select(F.col("id").alias("c_custkey"), F.lit("C").alias("c_name"), F.lit(6).alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), F.lit("X").alias("c_mktsegment")).write.parquet(f"{top}/customer.parquet")
    for t in ("orders", "nation", "region", "events"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{top}/{t}.parquet")
    return str(top)


@pytest.mark.parametrize("name", ["timeline_public", "timeline_global", "timeline_user_category"])
def test_timelines_do_not_join_users_with_sources(spark, wide, name):
    page = registry.QUERIES[name](spark, wide)
    assert most_joined(page) < 10_000


def test_enrichment_scores_distinct_texts(spark):
    rows = spark.range(2000).select(
        F.col("id").alias("topic_id"), F.lit("k").alias("key"), F.concat(F.lit("red ring "), F.col("id") % 2).alias("name"), (F.col("id") % 3).alias("type"))
    found = rows.select(F.col("topic_id").alias("candidate_id"), "key", F.upper("name").alias("matched"), F.lit("label").alias("kind"), F.lit("it").alias("language"), F.col("name").alias("label"),
                        F.array(F.lit("x")).alias("aliases"), F.col("type").alias("c_type"))
    best = best_candidates(rows, found, F.col("type") == F.col("c_type"))
    # the three best of a name are its three least ids: 0, 2, 4 (types 0, 2, 1) and 1, 3, 5 (1, 0, 2)
    first = {(0, 0): 0, (0, 2): 2, (0, 1): 4, (1, 1): 1, (1, 0): 3, (1, 2): 5}
    assert {(r[0], r[1], r[2]) for r in best.collect()} == {(i, first[i % 2, i % 3], 1.0) for i in range(2000)}
    assert most_joined(best) <= 6000


def test_digest_counts_articles_of_a_source_once(spark):
    at = datetime(2024, 1, 1)
    users = spark.range(300).select(F.col("id").alias("user_id"))
    follows = users.crossJoin(spark.range(2).select(F.col("id").alias("source_id"))).unionByName(users.select("user_id", F.lit(0).cast("long").alias("source_id")))
    articles = spark.range(400).select(F.col("id").alias("article_id"), (F.col("id") % 3).alias("source_id"), F.lit(at).alias("published_at"))
    articles = articles.unionByName(spark.createDataFrame([(0, 1, at), (2, 0, at), (None, 0, at)], "article_id long, source_id long, published_at timestamp"))  # articles of two sources
    out = daily_digest(users, follows, articles, F.lit(at), F.lit(datetime(2024, 1, 2)))
    n = len({i for i in range(400) if i % 3 < 2} | {2})
    assert {(r["user_id"], r["n"]) for r in out.collect()} == {(i, n) for i in range(300)}
    assert most_joined(out) < 5000


def test_shared_members_equal_own(spark):
    """A user of two groups, one of a group twice, one of a group without rows and one without a group."""
    users = spark.createDataFrame([(i,) for i in range(6)], "user_id long")
    groups = spark.createDataFrame([(0, 1), (1, 1), (1, 2), (2, 2), (2, 2), (3, 9), (4, 1)], "user_id long, g int")
    rows = spark.createDataFrame([(1, "b"), (1, 'a"\n'), (1, "é"), (2, "c"), (None, "x")], "g int, v string")
    shared = archives.shared_members(users, groups, rows, "g", "m", store.work_folder(spark, "test-lines"))
    assert shared.where("file IS NOT NULL").count() == 2  # users 0 and 4
    own = archives.user_members(users, m=groups.join(rows, "g").select("user_id", "v"))
    read = []
    for members in (shared, own):
        path = store.work_folder(spark, "test-archives")
        archives.write_archives(members, path)
        read.append(sorted(map(tuple, archives.read_archives(spark, path).collect())))
    assert read[0] == read[1] and len(read[0]) == 6


def test_shared_members_are_stored_once(spark, tmp_path):
    """Disk grows with lines, not with archives times the lines they share; an archive put together is a plain ZIP file."""
    users = spark.range(60).select(F.col("id").alias("user_id"))
    groups, rows = users.withColumn("g", F.col("user_id") % 2), spark.range(4000).select((F.col("id") % 2).alias("g"), F.sha1(F.col("id").cast("string")).alias("v"))
    members = archives.user_members(users, own=users.withColumn("n", F.col("user_id") * 7)).unionByName(archives.shared_members(users, groups, rows, "g", "m", store.work_folder(spark, "test-lines")))
    path, whole = f"{tmp_path}/out", f"{tmp_path}/whole"
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "out").rglob("*.zip"))
    for _ in range(2):
        archives.write_archives(members, path)
    archives.write_archives(members, whole, whole=True)
    rows_of = [sorted(map(tuple, archives.read_archives(spark, p).collect())) for p in (path, whole)]
    assert rows_of[0] == rows_of[1] and len(rows_of[0]) == 120
    assert size() < 400_000  # 4,000 lines of 48 characters, and 60 small files
    for i in (0, 7, 59):
        for found in (b"".join(archives.archive_bytes(path, str(i))), (tmp_path / "whole" / f"{i}.zip").read_bytes()):
            with zipfile.ZipFile(io.BytesIO(found)) as z:
                assert z.testzip() is None
                assert [(str(i), n, z.read(n).decode()) for n in z.namelist()] == [r for r in rows_of[0] if r[0] == str(i)]
    before = size()
    fresh = archives.shared_members(users, groups, rows.where("g = 0"), "g", "m", store.work_folder(spark, "test-lines"))
    archives.write_archives(fresh, path)
    archives.drop_parts(spark, path)
    assert len(list((tmp_path / "out" / "shared").glob("*.zip"))) == 1 and size() < before
    assert {len(r["content"]) for r in archives.read_archives(spark, path).collect()} == {0, len(rows_of[0][0][2])}


def test_term_statistics_count_a_repeated_document_once(spark):
    docs = spark.createDataFrame([(1, "alfa beta alfa"), (1, "alfa"), (2, "beta"), (None, "beta"), (3, None)], "doc_id long, text string")
    out = term_statistics(docs, "doc_id", "text")
    assert {tuple(r) for r in out.collect()} == {("alfa", 1, 3), ("beta", 2, 3)}
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 2


def python_nodes(df) -> int:
    """How many times the plan sends rows to Python workers."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    return plan.count("ArrowEvalPython") + plan.count("MapInArrow") + plan.count("BatchEvalPython") + plan.count("ExistingRDD")


@pytest.mark.parametrize(("name", "most"), [("composite_rules", 1), ("subsumption", 1), ("dict_classify", 1), ("entity_review", 0), ("article_topics", 0), ("articles_processed", 0), ("articles_alerted", 0)])
def test_texts_are_read_once(spark, name, most):
    assert python_nodes(registry.QUERIES[name](spark, SF)) == most


def test_terms_of_a_text_are_counted_where_they_are_found(spark):
    docs = spark.createDataFrame([(1, "the The", "the " * 5000), (2, None, "x"), (3, "und", None), (None, "the", "")], "doc_id long, title string, body string")
    found = term_counts(docs, {False: ["the", "und"], True: ["The"]})
    assert {tuple(r) for r in found.collect()} == {(1, "the", False, 2, 5000), (1, "The", True, 1, 0), (3, "und", False, 1, 0), (None, "the", False, 1, 0)}


def test_subsumed_matches_of_one_document(spark):
    matches = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0), (1, 9, 1.0), (2, 1, 1.0), (None, 1, 1.0), (None, 2, 1.0)], "doc_id long, topic_id long, score double")
    names = spark.createDataFrame([(1, "The"), (2, "of the"), (3, None)], "topic_id long, name string")
    assert {tuple(r) for r in drop_subsumed(matches, names).collect()} == {(1, 2, 1.0), (1, 9, 1.0), (2, 1, 1.0), (None, 1, 1.0), (None, 2, 1.0)}


def test_alert_pairs_are_not_shuffled(spark):
    """Every article has one topic that all alerts ask for: as many pairs as alerts times articles, grouped nowhere."""
    alerts = spark.range(100).select(F.col("id").alias("alert_id"), F.explode(F.array(F.lit(1).cast("long"), F.col("id") + 10)).alias("topic_id"), F.when(F.col("id") % 2 == 0, "any").otherwise("all").alias("mode"))
    edges = spark.range(200).select(F.col("id").alias("article_id"), F.explode(F.array(F.lit(1).cast("long"), F.col("id") + 10)).alias("topic_id"))
    known = spark.range(100).select(F.col("id").alias("alert_id"), F.lit(7).cast("long").alias("article_id"))
    out = match_alerts(alerts, edges, known)
    true = {(a, b, 1 + (a == b)) for a in range(100) for b in range(200) if (a % 2 == 0 or a == b) and b != 7}
    assert {tuple(r) for r in out.collect()} == true and out.count() == len(true)
    nodes = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "SortMergeJoin [alert_id" not in nodes or "article_id" not in nodes.split("SortMergeJoin [alert_id")[1].split("\n")[0]
    assert not any("keys=[alert_id" in line and "article_id" in line for line in nodes.split("\n") if "Aggregate" in line)


def test_alerts_beyond_what_is_carried(spark, monkeypatch):
    monkeypatch.setattr(alert_operators, "CARRIED", 2)
    wanted = {1: ("any", {1, 2, 3}), 2: ("all", {1, 2}), 3: ("any", {4}), 4: ("all", {1, 2, 3}), 5: ("any", {2})}
    has = {1: {1}, 2: {1, 2}, 3: {1, 2, 3, 4}, 4: {5}, 5: {2, 4}}
    alerts = spark.createDataFrame([(a, t, m) for a, (m, ts) in wanted.items() for t in ts] + [(6, None, "any"), (None, 1, "any")], "alert_id long, topic_id long, mode string")
    edges = spark.createDataFrame([(a, t) for a, ts in has.items() for t in ts] + [(None, 1)], "article_id long, topic_id long")
    gone = {(5, 2), (5, 3), (5, 4), (3, 5)}  # more known articles than are carried, and few
    known = spark.createDataFrame(sorted(gone), "alert_id long, article_id long")
    for seen in (None, known):
        true = {(a, b, len(ts & own)) for a, (m, ts) in wanted.items() for b, own in has.items() if ts & own and (m == "any" or ts <= own) and (seen is None or (a, b) not in gone)}
        rows = [tuple(r) for r in match_alerts(alerts, edges, seen).collect()]
        assert set(rows) == true and len(rows) == len(true)


def test_words_are_those_that_rules_look_at():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choices(["a", "à", "B", "É", "Ñ", "7", "²", "_", " ", "\n", ".", "-", "’", "Abcd", "XY", "J.", "Papa", " Anna"], k=rng.randint(0, 25)))
        every = [(m[0], m.start(), m.end()) for m in re.finditer(r"\w+", text)]
        ends = {b: a for (_, _, a), (_, b, _) in zip(every, every[1:], strict=False)}  # where the word before each word ends
        kept = [(t, a, t[0] in extractors.UPPER and len(t) == 1 and text[b : b + 1] == ".", b) for t, a, b in every if t[0] in extractors.UPPER + "0123456789"]
        assert [(w.text, w.start, w.initial, w.end - w.initial) for w in extractors.words_of(text)] == kept
        for w in extractors.words_of(text):
            between = text[ends[w.start] : w.start] if w.start in ends else "x"
            before = [x for x in extractors.words_of(text) if x.end - x.initial == ends.get(w.start)]
            assert w.near == (bool(before) and (between[1:] if before and before[0].initial else between).isspace())


def test_sweep_sorts_no_table(spark):
    """Articles and edges meet the candidates hashed; the candidates are found once, by one sorted join with all that is kept."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        plans = [registry.QUERIES[q](spark, SF)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1] for q in ("retention_swept", "retention_candidates")]
    finally:
        spark.conf.set(threshold, before)
    assert plans[0].count("ShuffledHashJoin") == 2 and "events" not in plans[0] and plans[0].count("Sort [") <= 2
    assert len(re.findall(r"SortMergeJoin \[\S*\], \[\S*\], LeftAnti", plans[1])) == 1


def test_sweep_with_nulls_and_repeats(spark):
    articles = spark.createDataFrame([(i, datetime(2020, 1, 1)) for i in (1, 2, 2, 3, 4, None)], "article_id long, published_at timestamp_ntz")
    counters = spark.createDataFrame([(1, 2), (2, 0), (None, 5)], "article_id long, reads long")
    kept = spark.createDataFrame([(3,), (3,), (None,)], "article_id long")
    gone = maintenance.retention_candidates(articles, counters, [kept, kept.limit(0)], "2021-01-01")
    assert sorted(r[0] or 0 for r in gone.collect()) == [0, 2, 2, 4]
    edges = spark.createDataFrame([(1, 7), (2, 7), (2, 8), (None, 7)], "article_id long, topic_id long")
    left = upkeep.swept(gone, "article_id", articles=articles.select("article_id"), edges=edges)
    assert {k: sorted((r[0] or 0) for r in v.collect()) for k, v in left.items()} == {"articles": [0, 1, 3], "edges": [0, 1]}


def test_replacing_edges_sorts_none(spark):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        plan = registry.QUERIES["edges_replaced"](spark, SF)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    finally:
        spark.conf.set(threshold, before)
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan
