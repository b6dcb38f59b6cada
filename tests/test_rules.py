"""Traffic rules, enrichment and discovery on hand-made cases, with nulls and empty tables."""

from pyspark.sql import functions as F

from newsloom.operators import enrichment as E
from newsloom.operators import security as S


def one(spark, column, row, schema):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


def test_locate(spark):
    nets = spark.createDataFrame([(0, 999, "A", 1), (2000, 2000, "B", 2)], "first long, last long, country string, asn long")
    ips = spark.createDataFrame([(0,), (999,), (1000,), (2000,), (None,)], "ip long")
    assert {r.ip: r.country for r in S.locate(ips, nets).collect()} == {0: "A", 999: "A", 1000: None, 2000: "B", None: None}
    assert S.locate(ips.limit(0), nets).collect() == []


def test_block_order(spark):
    requests = spark.createDataFrame([(1, "EVIL", "IT", 5, "/wp-login"), (2, "evil bot", "IT", 5, "/"), (3, None, "IT", 5, None), (4, "x", None, 5, "/"), (5, "x", "FR", 6, "/WP-login.php"), (6, None, None, None, None)],
                                     "ip long, ua string, country string, asn long, path string")
    bans = spark.createDataFrame([(1, None), (2, "2020-01-01 00:00:00")], "ip long, e string").select("ip", F.col("e").cast("timestamp_ntz").alias("expires_at"))
    countries, asns = spark.createDataFrame([("IT",)], "country string"), spark.createDataFrame([(5,)], "asn long")
    out = S.block_reason(requests, bans, ["evil"], countries, asns, "2024-01-01", ["wp-login"])
    assert {r.ip: r.reason for r in out.collect()} == {1: "ip", 2: "ua", 3: "country", 4: "asn", 5: "scanner", 6: None}
    assert one(spark, S.exempt(F.col("p"), ["/health"], ["/static"]), ("/static/x",), "p string") is True


def test_hit_score(spark):
    columns = ("n", "matched", "kind", "language", "label", "a")
    score = lambda *row: one(spark, E.hit_score(*map(F.col, columns)), row, "n string, matched string, kind string, language string, label string, a array<string>")
    assert score("Roma", "roma ", "label", "it", "Roma", None) == 1.0 and score("Roma", "Roma", "label", "en", "Roma", []) == 0.85
    assert score("Urbe", "URBE", "alias", "it", "Roma", ["URBE"]) == 0.8 and score("Urbe", "Urbe", "alias", "en", "Roma", None) == 0.7
    assert score("Urbe", "Urbe", "alias", "fr", "Roma", None) == 0.7  # other languages count as English
    assert score("Roma", "Rome", "label", "it", "Comune di Roma", None) == 0.8 and score("mario rossi", "x", "label", "it", "Mario Luigi Rossi", None) == 0.8
    assert score("Città Eterna", "x", "label", "it", "Roma", ["altro", "la Città Eterna"]) == 0.75
    assert score("a", "b", "label", "it", "b", []) is None and score(None, "b", "label", "it", "b", None) is None and score("", "b", "alias", "it", None, [""]) is None


def test_types_and_merges(spark):
    rules = [("person", ["Q5"]), ("place", ["Q515", "Q6256"])]
    assert one(spark, E.infer_type(F.col("c"), rules), (["Q6256", "Q5"],), "c array<string>") == "person"
    assert one(spark, E.infer_type(F.col("c"), rules), (["Q1"],), "c array<string>") is None
    assert one(spark, E.merge_aliases(F.col("a"), F.col("b")), (["A", "b"], ["B", "c", "C"]), "a array<string>, b array<string>") == ["A", "b", "c"]
    assert one(spark, E.merge_references(F.col("a"), F.col("b")), ({"x": "1", "y": "2"}, {"y": "3"}), "a map<string,string>, b map<string,string>") == {"x": "1", "y": "3"}


def test_discovery(spark):
    assert one(spark, E.normalize_url(F.col("u")), (" a.it ",), "u string") == "https://a.it"
    html = '<link rel="alternate" type="application/rss+xml" href="/f"><link rel="alternate" type="text/html" href="/g"><link rel="alternate" type="application/rss+xml" href="/f">'
    assert one(spark, E.feed_links(F.col("h")), (html,), "h string") == ["/f"]
    assert one(spark, E.wordpress_root(F.col("h")), ('<http://a/>; rel=next, <http://a/wp-json/>; rel="https://api.w.org/"',), "h string") == "http://a/wp-json/"
    assert one(spark, E.bot_challenge(F.col("t"), ["just a moment"]), ("Just a Moment...",), "t string") is True
    flags = spark.createDataFrame([(1, False, False, None, None, None), (2, False, False, None, ["/f"], None), (3, False, True, "r", None, None), (4, True, True, None, None, None), (5, False, False, "r", ["/f"], None)],
                                  "i int, is_challenge boolean, is_feed boolean, wp_root string, links array<string>, common_path string")
    assert {r.i: r.kind for r in E.discovery(flags).collect()} == {1: "invalid", 2: "rss", 3: "rss", 4: "challenge", 5: "wordpress"}


def test_robots(spark):
    rules = spark.createDataFrame([("o", "/", False), ("o", "/open", True)], "origin string, prefix string, allow boolean")
    asked = spark.createDataFrame([("o", "/x"), ("o", "/open/y"), ("p", "/x")], "origin string, path string")
    assert {(r.origin, r.path): r.allowed for r in E.allowed_by_robots(asked, rules).collect()} == {("o", "/x"): False, ("o", "/open/y"): True, ("p", "/x"): True}
