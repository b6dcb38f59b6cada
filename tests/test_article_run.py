"""The run of new articles by hand, alerts and mined entities against slow loops."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsloom.functions.text import normalize_term
from newsloom.operators import extractors as X
from newsloom.operators.alerts import match_alerts
from newsloom.operators.article_run import PARTS, process_articles
from newsloom.operators.classify import mine_entities
from tests.conftest import SF

PAGE = '<meta property="og:image" content="/i.png"><p>Testo della pagina</p><script>x()</script>'


def test_run(spark):
    t = datetime(2024, 1, 2)
    articles = spark.createDataFrame(
        [(1, 7, "Roma e Acme", "d", "<p onclick=x>" + "a" * 400 + "</p>", "own.png", "https://a.it/1", None, t, "new"), (2, 7, "Niente", None, None, None, "https://a.it/2", PAGE, t, "new"),
         (3, 99, "Roma", None, None, None, "https://b.it/3", None, t, "new"), (4, 7, "Roma", None, None, "old.png", "https://a.it/4", None, t, "indexed")],
        "article_id long, source_id long, title string, description string, content_html string, image_url string, url string, page_html string, published_at timestamp, status string")
    sources = spark.createDataFrame([(7, None, "https://a.it/feed", "rss")], "source_id long, url_site string, url_feed string, kind string")
    topics = spark.createDataFrame([(1, "roma", "Roma", "location", [], True, False), (2, "acme", "Acme", "brand", [], True, False)],
                                   "topic_id long, slug string, name string, type string, aliases array<string>, is_curated boolean, case_sensitive boolean")
    edges = spark.createDataFrame([(2, 1, 3.0, "title"), (4, 1, 3.0, "title"), (1, 1, 1.0, "body")], "article_id long, topic_id long, score double, position string")
    alerts = spark.createDataFrame([(1, 1, "all"), (1, 2, "all"), (2, 2, "any")], "alert_id int, topic_id long, mode string")
    out = process_articles(articles, sources, topics, edges, alerts, curated_only=True)
    assert set(out) == set(PARTS)
    assert {r.article_id: (r.status, r.image_url) for r in out["articles"].collect()} == {1: ("indexed", "own.png"), 2: ("indexed", "https://a.it/i.png"), 3: ("failed", None), 4: ("indexed", "old.png")}
    assert sorted((r.op, r.article_id, r.topic_id) for r in out["edge_changes"].collect()) == [("delete", 2, 1), ("insert", 1, 2), ("update", 1, 1)]
    assert sorted(tuple(r)[:3] for r in out["edges"].collect()) == [(1, 1, 3.0), (1, 2, 3.0), (4, 1, 3.0)]
    rows = {r.article_id: r for r in out["search_rows"].collect()}
    assert set(rows) == {1, 2} and rows[1].topic_ids == [1, 2] and rows[1].topic_slugs == "roma,acme" and rows[1].content_html == "<p>" + "a" * 400 + "</p>"
    assert (rows[2].content_text, rows[2].topic_ids, rows[2].description, rows[2].source_domain, rows[2].published_at) == ("Testo della pagina", [], "", "a.it", 1_704_153_600)
    assert sorted(map(tuple, out["alerts"].collect())) == [(1, 1, 2), (2, 1, 1)]
    again = process_articles(articles, sources, topics, out["edges"], alerts, curated_only=True)
    assert again["edge_changes"].count() == 0
    assert all(df.count() == 0 for name, df in process_articles(articles.limit(0), sources, topics, edges.limit(0), alerts, curated_only=True).items() if name != "topics")


@pytest.mark.parametrize("seed", [1, 2])
def test_alerts(spark, seed):
    rng = random.Random(seed)
    alerts = {a: (rng.choice(["all", "any", "odd", None]), {rng.randint(0, 12) for _ in range(rng.randint(1, 4))}) for a in range(40)}
    articles = {a: {min(12, int(rng.expovariate(0.3))) for _ in range(rng.randint(0, 6))} for a in range(60)}
    rows = [(a, t, m) for a, (m, ts) in alerts.items() for t in ts] * 2
    edges = [(a, t) for a, ts in articles.items() for t in ts] * 2
    found = match_alerts(spark.createDataFrame(rows, "alert_id int, topic_id int, mode string"), spark.createDataFrame(edges, "article_id int, topic_id int"))
    true = {(x, y, len(ts & own)) for x, (m, ts) in alerts.items() for y, own in articles.items() if ts & own and (m == "any" or ts <= own)}
    assert sorted(map(tuple, found.collect())) == sorted(true)


def test_mined_entities(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    more = [(10**6 + i, f"s{i % 3}", f"Ieri Mario Rossi e Papa Leone XIV hanno visto la nuova BMW, {x} una Fiat Panda 500 di Anna  Bianchi.") for i, x in enumerate(["oggi", "ora", "mai"])]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    brands, common = ("Fiat",), ("Ieri",)
    keys = {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        if not r.text:
            continue
        each = (("person", X.persons(r.text, frozenset(common))), ("pope", X.popes(r.text)), ("brand_alpha", X.alphanumeric_brands(r.text)), ("brand_single", X.single_brands(r.text, frozenset(common))),
                ("model", X.models(r.text, brands, frozenset(common))))
        for kind, found in each:
            for s in dict.fromkeys(found):
                own = keys.setdefault((" ".join(s.lower().split()), kind), [s, 0, set()])
                own[1] += 1
                own[2].add(r.source)
    found = {(r.normalized, r.kind): (r.surface, r.occurrences, r.sources) for r in mine_entities(docs, brands, common).collect()}
    assert found == {k: (s, n, len(o - {None})) for k, (s, n, o) in keys.items()} and ("mario rossi", "person") in found
    assert docs.select(normalize_term(F.lit(" A  b ")).alias("x")).first().x == "a b"
