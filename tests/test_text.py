"""Text functions, extractors and classification on hand-made cases."""

from datetime import datetime

from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import accounts, alerts, articles, classify, curation, enrichment, events, extractors, feeds, maintenance, search, security
from newsloom.sources import domain


def value(spark, column, **row):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("v")).first()["v"]


def test_slugify(spark):
    assert value(spark, T.slugify("x"), x="  Perché  l'Università?! ") == "perche-l-universita"
    assert value(spark, T.slugify("x", 5), x="abcd efgh") == "abcd"
    assert value(spark, T.slugify("x"), x=None) == ""
    assert value(spark, T.slugify("x"), x="Škoda Café Ⅷ Łódź № 5") == "skoda-cafe-odz-5"


def test_parse_date(spark):
    assert value(spark, T.parse_date("x"), x="Tue, 05 Mar 2024 10:20:30 GMT") == datetime(2024, 3, 5, 10, 20, 30)
    assert value(spark, T.parse_date("x"), x="2024-03-05T10:20:30Z") == datetime(2024, 3, 5, 10, 20, 30)
    assert value(spark, T.parse_date("x"), x="soon") is None


def test_cursor_round_trip(spark):
    c = value(spark, T.encode_cursor(F.col("t").cast("timestamp_ntz"), F.lit(42)), t="2024-01-02 03:04:05.678901")
    assert "=" not in c
    t, i = T.decode_cursor("c")
    row = spark.createDataFrame([(c,), ("garbage!",)], "c string").select(t.alias("t"), i.alias("i")).collect()
    assert row[0] == (datetime(2024, 1, 2, 3, 4, 5, 678901), 42)
    assert row[1] == (None, None)


def test_html(spark):
    assert value(spark, T.html_to_text("x"), x="<p>a<script>no()</script> b &amp; c</p><style>z</style>") == "a b & c"
    assert value(spark, T.html_to_text("x"), x="&lt;b&gt;bold&lt;/b&gt;") == "bold"
    links = value(spark, T.internal_links("h", "u"), h='<a href="/a">one</a><a href="http://o.org/x">no</a><a href="/a">again</a><a class=x href="https://h.it/b">two</a>', u="https://h.it/p")
    assert [tuple(x) for x in links] == [("https://h.it/a", "one"), ("https://h.it/b", "two")]
    assert value(spark, T.og_image("h"), h='<meta property="og:image" content="http://i/x.png">') == "http://i/x.png"


def test_page_metadata(spark):
    page = """<head><title> A title </title><meta name="description" content=" said "><meta property='og:image' content='http://i/o.png'><link rel="icon" href="/i.ico"></head>"""
    assert tuple(value(spark, T.open_graph("h", "u"), h=page, u="https://s.it/a/b")) == ("A title", "said", "http://i/o.png", "/i.ico")
    other = '<meta content="better" property="og:title"><title>worse</title>'
    assert tuple(value(spark, T.open_graph("h", "u"), h=other, u="https://s.it/a")) == ("better", None, None, "https://s.it/favicon.ico")
    assert value(spark, T.title_and_description("a", "b"), a=" One ", b="two") == "One. two" and value(spark, T.title_and_description("a", "b"), a="One", b=" ") == "One"


def test_entity_workflow(spark):
    entities = spark.createDataFrame(
        [(1, "rete nova", "Rete Nova", "person", 9, None, False), (2, "acme", "ACME", "brand_alpha", 7, None, None), (3, "beta", "Beta", "model", 2, None, None), (4, "nova", "Nova", "brand_single", 8, None, True)],
        "entity_id long, normalized string, surface string, kind string, occurrences long, topic_id long, ignored boolean")
    terms = spark.createDataFrame([("nova", 70), ("nova", 71), ("rete", 50)], "term string, topic_id long")
    queue = curation.review_queue(entities, terms).collect()
    assert [(r.entity_id, r.hints) for r in queue] == [(1, [50, 71]), (2, [])]
    topics = spark.createDataFrame([(5, "acme", "Acme", "brand", ["A."], False), (6, "zeta", "Zeta", "brand", [], False)], "topic_id long, slug string, name string, type string, aliases array<string>, is_curated boolean")
    decisions = spark.createDataFrame([(1, "band"), (2, None), (3, None), (3, None)], "entity_id long, as_type string")
    after, resolved = curation.confirm_entities(entities, topics, decisions)
    assert sorted(tuple(r) for r in after.select("topic_id", "slug", "type", "aliases", "is_curated").collect()) == [
        (5, "acme", "brand", ["A.", "ACME"], True), (6, "zeta", "brand", [], False), (7, "rete-nova", "band", [], True), (8, "beta", "model", [], True)]
    assert {r.entity_id: r.topic_id for r in resolved.collect()} == {1: 7, 2: 5, 3: 8, 4: None}
    assert {r.entity_id for r in curation.reject_entities(entities, spark.createDataFrame([(1,)], "entity_id long")).where("ignored").collect()} == {1, 4}


def test_ancestors_with_cycle(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (8, 9), (9, 8), (5, 77)], "category_id int, parent_id int")
    found = {(r.category_id, r.ancestor_id, r.distance) for r in curation.ancestors(tree).collect()}
    assert found == {(2, 1, 1), (3, 2, 1), (3, 1, 2), (4, 3, 1), (4, 2, 2), (4, 1, 3), (8, 9, 1), (9, 8, 1)}


def test_export_and_erasure(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "user_id long, x string")
    accounts.export_user(str(tmp_path), 1, things=rows)
    assert [tuple(r) for r in spark.read.json(f"{tmp_path}/things").select("user_id", "x").collect()] == [(1, "a")]
    assert [r.user_id for r in accounts.erase_user(rows.where("user_id = 1"), things=rows)["things"].collect()] == [2]


def test_enrichment(spark):
    claim = lambda q: '{"mainsnak": {"datavalue": {"value": {"id": "%s"}}}}' % q
    entity = '{"sitelinks": {"itwiki": {"url": "http://w/it"}}, "claims": {"P31": [%s, %s, %s], "P18": [{"mainsnak": {"datavalue": {"value": "a b.jpg"}}}]}}' % (claim("Q5"), claim("Q7"), claim("Q5"))
    refs = value(spark, enrichment.build_references(F.col("e"), F.lit("Q1"), F.lit(0.8), F.lit("label")), e=entity)
    assert refs == {"wikidata_qid": "Q1", "match_confidence": "0.8", "match_method": "label", "wikipedia_url_it": "http://w/it", "instance_of": "Q5,Q7",
                    "image": "https://commons.wikimedia.org/wiki/Special:FilePath/a_b.jpg?width=512"}
    score = lambda **r: value(spark, enrichment.hit_score(*map(F.col, ("n", "m", "k", "g", "l", "a"))), **r)
    assert score(n="Nova", m="nova", k="label", g="it", l="x", a=[]) == 1.0 and score(n="Nova", m="nova", k="alias", g="fr", l="x", a=[]) == 0.7
    assert score(n="nova", m="no", k="label", g="it", l="Nova.com", a=[]) == 0.8 and score(n="nova", m="no", k="label", g="it", l="x", a=["the nova"]) == 0.75
    assert score(n="nova", m="no", k="label", g="it", l="x", a=["novae"]) is None
    rules = spark.createDataFrame([("o", "/a", False), ("o", "/a/b", True), ("o", "/c", True), ("o", "/c", False)], "origin string, prefix string, allow boolean")
    asked = spark.createDataFrame([("o", "/a/x"), ("o", "/a/b"), ("o", "/c"), ("o", "/z"), ("p", "/a"), ("p", "/a")], "origin string, path string")
    assert {(r.origin, r.path): r.allowed for r in enrichment.allowed_by_robots(asked, rules).collect()} == {("o", "/a/x"): False, ("o", "/a/b"): True, ("o", "/c"): True, ("o", "/z"): True, ("p", "/a"): True}


def test_narrowest_network(spark):
    import random

    rng = random.Random(4)
    nets = [(a := rng.randrange(2000), a + rng.choice([0, 1, 5, 60, 900]), f"c{i}", i) for i in range(60)] + [(0, 2**31, "world", 99), (5, 4, "none", 98)]
    ips = [rng.randrange(3200) for _ in range(300)] + [None, 2**31]
    rows = security.locate(spark.createDataFrame([(i, ip, "x") for i, ip in enumerate(ips)], "id long, ip long, country string"), spark.createDataFrame(nets, "first long, last long, country string, asn long"))
    found = {r.id: r.asn for r in rows.collect()}
    for i, ip in enumerate(ips):
        holding = [(last - first, first, c, asn) for first, last, c, asn in nets if ip is not None and first <= ip <= last]
        assert found[i] == (min(holding)[3] if holding else None)


def test_mojibake(spark):
    assert value(spark, T.fix_mojibake("x"), x="ForlÃ¬") == "Forlì"
    assert value(spark, T.fix_mojibake("x"), x="Forlì") == "Forlì"


def test_extractors(spark):
    people = lambda x, *common: value(spark, extractors.extract_persons(F.col("x"), common), x=x)
    assert people("il regista Carlo B. Neri parla") == ["Carlo B. Neri"]
    assert people("Domani Lucia Ferri Spiega tutto", "Domani", "Spiega") == ["Lucia Ferri"]
    assert people("Domani Lucia", "Domani") == [] and people(None) == []
    assert people("TG Regione apre; poi AC Torino, Piero Gatti e Piero Gatti") == ["TG Regione", "AC Torino", "Piero Gatti"]
    assert people("NEL Paese Grande") == [] and people("Anna I. Bruni canta") == []
    assert people("Uno Due Tre") == [] and people("Silvia,Marta Bianchi") == ["Marta Bianchi"]
    assert value(spark, extractors.extract_popes(F.col("x")), x="ieri Papa Clemente VIII e Papa Leo; Papa re") == ["Papa Clemente VIII", "Papa Leo"]
    assert value(spark, extractors.extract_popes(F.col("x")), x="Papa Leone XIV, Papa Sisto IIII, Papa Giovanni XXIII") == ["Papa Leone XIV", "Papa Sisto", "Papa Giovanni XXIII"]
    assert [extractors.roman(n) for n in (1, 4, 9, 14, 19, 28, 39)] == ["I", "IV", "IX", "XIV", "XIX", "XXVIII", "XXXIX"]
    assert value(spark, extractors.extract_alphanumeric_brands(F.col("x")), x="Una KTM, poi 3Com e G7 PER la a4 del DEL") == ["KTM", "3Com", "G7"]
    assert value(spark, extractors.extract_single_brands(F.col("x"), ("Forse",)), x="Compro Barilla: Mulino, Forse. Sempre") == ["Barilla", "Mulino"]
    found = lambda x, *brands: value(spark, extractors.extract_models(F.col("x"), brands, ("Oggi",)), x=x)
    assert found("una lancia Delta HF4 Turbo rossa, poi Lancia Thema", "Lancia", "Lancia Delta") == ["lancia Delta HF4 Turbo", "Lancia Thema"]
    assert found("Apple iPhone 15 e Sony RAI", "Apple", "Sony") == ["Apple iPhone 15"]
    assert found("Canon EOS-R5 e Canon Oggi", "Canon") == ["Canon EOS-R5"] and found("Canon") == [] and found(None, "Canon") == []
    every = value(spark, extractors.extract_all(F.col("x"), ("Fiat",), ()), x="la Fiat Uno di Marco Belli")
    assert [tuple(r) for r in every] == [("Marco Belli", "person"), ("Fiat", "brand_single"), ("Marco", "brand_single"), ("Belli", "brand_single"), ("Fiat Uno", "model")]


def test_scan(spark):
    terms = ["nord", "nord est", "acqua alta", "est", "c++"]
    found = lambda x: value(spark, classify.scan(F.col("x"), terms), x=x)
    assert found("Nord Est, nord e c++!") == ["nord est", "nord", "c++"]
    assert found("nord'ovest") == [] and found("nord’ovest") == [] and found("l'ACQUA ALTA cresce") == ["acqua alta"]
    assert found("nordico estremo") == [] and found(None) == [] and found("") == []
    assert value(spark, classify.scan(F.col("x"), ["IT"], False), x="IT it") == ["IT"]


def test_article_topics(spark):
    """Dictionary in both cases, ambiguous places, names, collisions, models of known brands, aliases, invalid slugs, composites."""
    topics = spark.createDataFrame(
        [(1, "lago", "Lago", "location", [], True, False), (2, "acme", "Acme", "brand", ["Acme Works"], True, False), (3, "us", "US", "location", [], True, True),
         (4, "energia", "Energia", "subject", [], True, False), (5, "sole", "Sole", "location", [], True, False), (6, "piero-bassi", "Piero Bassi", "invalid", [], False, False),
         (7, "energia-sole", "Energia del sole", "subject", [], True, False)],
        "topic_id bigint, slug string, name string, type string, aliases array<string>, is_curated boolean, case_sensitive boolean")
    docs = spark.createDataFrame(
        [(1, "la nuova Acme Turbo 500 sul lago", "Il lago e US, con us; dice Marta Neri", ["Energia"]), (2, "il signor Carlo Energia parla", "poi Piero Bassi saluta", None),
         (3, "Offerta sul lago", "lago", None), (4, None, None, None), (5, "energia del sole", "", None), (6, "x", "scrive Anna Verdi, e Verdi tace", None)],
        "doc_id long, title string, body string, taxonomy array<string>")
    edges, new = articles.article_topics(docs, topics, ambiguous_places=("sole",), common=("Turbo", "Carlo"))
    named = {r.topic_id: (r.slug, r.type) for r in new.collect()}
    assert sorted(named.values()) == [("acme-turbo-500", "model"), ("anna-verdi", "person"), ("marta-neri", "person")] and sorted(named) == [8, 9, 10]
    found = {(r.doc_id, named.get(r.topic_id, (r.topic_id,))[0]): (r.score, r.position) for r in edges.collect()}
    assert found == {
        (1, 1): (4.0, "both"), (1, 2): (3.0, "title"), (1, 3): (1.0, "body"), (1, 4): (1.0, "body"), (1, "acme-turbo-500"): (3.0, "title"), (1, "marta-neri"): (1.0, "body"),
        (2, 4): (3.0, "title"), (5, 7): (3.0, "title"), (6, "anna-verdi"): (1.0, "body")}
    only, none = articles.article_topics(docs, topics, [(7, [1, 4])], curated_only=True, title_only=True)
    assert none.isEmpty() and {(r.doc_id, r.topic_id, r.score) for r in only.collect()} == {(1, 1, 3.0), (1, 2, 3.0), (2, 4, 3.0), (5, 7, 3.0)}
    default = spark.createDataFrame([(1,)], "x int")
    assert articles.rules_or_default(default.limit(0), default).count() == 1


def test_classify_scores(spark):
    docs = spark.createDataFrame([(1, "Roma Roma", "a Roma"), (2, "Offerta Roma", "Roma"), (3, None, None)], "doc_id long, title string, body string")
    topics = spark.createDataFrame([(1, "location", "Roma")], "topic_id long, type string, term string")
    assert [(r.doc_id, r.score, r.position) for r in classify.classify(docs, topics).collect()] == [(1, 7.0, "both")]


def test_alerts(spark):
    edges = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "article_id long, topic_id long")
    wanted = spark.createDataFrame([(5, 10, "all"), (5, 11, "all"), (6, 11, "any"), (6, 12, "any"), (7, 12, "all")], "alert_id long, topic_id long, mode string")
    found = {(r.alert_id, r.article_id) for r in alerts.match_alerts(wanted, edges).collect()}
    assert found == {(5, 1), (6, 1)}
    assert value(spark, alerts.normalize_channels(F.col("x")), x=["Email", "sms", "email "]) == ["email"]
    assert value(spark, alerts.normalize_channels(F.col("x")), x=["sms"]) == ["inapp"]


def test_event_coercion(spark):
    raw = spark.createDataFrame([("bad", "nope", "", "")], "ts string, session_id string, event_type string, method string")
    row = events.coerce_events(raw, datetime(2024, 1, 1)).first()
    assert row.ts == datetime(2024, 1, 1) and row.session_id is None and row.event_type == "http_request" and row.method is None


def test_upsert_and_ingest(spark):
    old = spark.createDataFrame([("a", 2, "A")], "k string, n long, s string")
    new = spark.createDataFrame([("a", 1, "aa"), ("b", 4, "B")], "k string, n long, s string")
    assert {tuple(r) for r in maintenance.additive_upsert(old, new, ["k"], "n", "s").collect()} == {("a", 3, "A"), ("b", 4, "B")}
    fresh = spark.createDataFrame([("a", 1), ("c", 2), ("c", 1)], "k string, o long")
    assert [tuple(r) for r in maintenance.insert_absent(old, fresh, "k", ["o"]).collect()] == [("c", 1)]


def test_descendants_of_nothing(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (9, 8)], "category_id int, parent_id int")
    assert sorted(r[0] for r in feeds.descendants(tree, 1).collect()) == [1, 2, 3]
    assert feeds.descendants(tree, 77).collect() == []


def test_suggest_needs_two_letters(spark):
    t = spark.createDataFrame([(1, "Alpha", True), (2, "Al", True), (3, "Alba", False)], "topic_id long, name string, is_curated boolean")
    assert [r.name for r in search.suggest(t, "al").collect()] == ["Al", "Alpha"]
    assert search.suggest(t, "a").collect() == []


def test_feed_reader(spark, tmp_path):
    (tmp_path / "f.xml").write_text("""<rss><channel><item><title>Uno</title><link> http://a/1 </link><pubDate>Tue, 05 Mar 2024 10:20:30 GMT</pubDate>
<description>&lt;img src="http://i/1.png"&gt; ciao</description><category>x</category><category>y</category></item><item><title>Senza link</title></item></channel></rss>""")
    rows = domain.read_feed_entries(spark, str(tmp_path / "f.xml"), datetime(2020, 1, 1)).collect()
    assert len(rows) == 1 and rows[0].url == "http://a/1" and rows[0].image_url == "http://i/1.png" and rows[0].taxonomy == ["x", "y"]


def test_wordpress_reader(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"id": 1, "link": "http://a/1", "title": {"rendered": "<b>T</b>"}, "excerpt": {"rendered": "<p>e</p>"}, "content": {"rendered": "c"}, "date_gmt": "2024-01-01T00:00:00", "modified_gmt": "bad", "_embedded": {"author": [{"name": "N"}], "wp:term": [[{"name": "k"}], [{"name": "l"}]]}}]')
    row = domain.read_wordpress_posts(spark, str(tmp_path / "p.json")).first()
    assert (row.title, row.author, row.taxonomy, row.modified_at) == ("T", "N", ["k", "l"], None)


def test_places(spark, tmp_path):
    head = ";".join(f"c{i}" for i in range(16))
    line = lambda name, code: ";".join(name if i == 5 else code if i == 14 else "v" for i in range(16))
    (tmp_path / "m.csv").write_text("\n".join([head, line("Borgo", "AA"), line("Borgo", "BB"), line("Uno/Eins", "CC")]))
    rows = {r.slug: (r.name, r.aliases) for r in domain.read_places(spark, str(tmp_path / "m.csv")).collect()}
    assert rows == {"borgo-aa": ("Borgo (AA)", []), "borgo-bb": ("Borgo (BB)", []), "uno": ("Uno", ["Eins"])}
