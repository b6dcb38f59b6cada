"""Feeds of each format by hand, and RSS written and read back."""

from datetime import datetime

from pyspark.sql import functions as F

from newsloom.sources import feeds

FEEDS = {
    "rss": """﻿<?xml version="1.0"?><!-- x --><rss version="2.0" xmlns:content="c" xmlns:media="m" xmlns:dc="d"><channel><title> Il &amp; canale </title><link>https://a.it</link>
<item><title><![CDATA[Uno <b>]]></title><link> https://a.it/1 </link><guid isPermaLink="false">g1</guid><pubDate>Tue, 02 Jan 2024 10:00:00 +0100</pubDate><description>d1</description>
<content:encoded><![CDATA[<p><img class="x" src="../i.png">]]></content:encoded><category>A</category><category> </category><category>B</category><dc:creator>Chi</dc:creator></item>
<item><title>Due</title><link>https://a.it/2</link><media:thumbnail url="/t.jpg"/><enclosure url="e.mp3" type="audio/mpeg"/><enclosure url="e.jpg" type="image/jpeg"/></item>
<item><title>Senza</title></item><item><title>""" + "x" * 300 + """</title><link>https://a.it/4</link><enclosure url="e.jpg" type="image/jpeg"/><updated>2024-01-03T00:00:00Z</updated></item></channel></rss>""",
    "rdf": """<rdf:RDF xmlns:rdf="r"><channel><title>Vecchio</title></channel><item><title>R</title><link>https://r.it/1</link><dc:date xmlns:dc="d">2024-02-01T00:00:00Z</dc:date></item></rdf:RDF>""",
    "atom": """<feed xmlns="http://www.w3.org/2005/Atom"><title type="text">Atomo</title><entry><id>i1</id><title type="html">T &lt;i&gt;</title><link rel="self" href="https://b.it/self"/><link href="https://b.it/1"/>
<link rel="enclosure" type="image/png" href="p.png"/><author><name>Lei</name></author><updated>2024-01-05T00:00:00Z</updated><summary>s</summary><content type="html">&lt;p&gt;c</content>
<category term="X" label="no"/><category label="Y"/></entry></feed>""",
    "json": """ {"version": "https://jsonfeed.org/version/1", "title": "Gei", "items": [{"id": 7, "url": "https://c.it/1", "title": "J", "content_html": "<p>h", "date_published": "2024-01-06T00:00:00Z",
"tags": ["u", ""], "authors": [{"name": "Noi"}], "image": "//d.it/i.png"}, {"id": "8", "title": "no url"}]}""",
    "empty": "<rss><channel></channel></rss>", "other": "<html><title>no</title></html>", "not": '{"version": "1"}', "bad": '{"a', "none": "",
}


def parsed(spark):
    rows = spark.createDataFrame([(k, bytearray(v.encode())) for k, v in FEEDS.items()] + [("latin", bytearray('<?xml version="1.0" encoding="ISO-8859-1"?><rss><channel><title>Città</title></channel></rss>'.encode("latin-1")))],
                                 "name string, content binary")
    return feeds.parse_feeds(rows)


def test_formats(spark):
    found = {r.name: r for r in feeds.sniffed(parsed(spark)).collect()}
    assert {k: (r.format, r.title, len(r["items"])) for k, r in found.items()} == {
        "rss": ("rss", "Il & canale", 4), "rdf": ("rss", "Vecchio", 1), "atom": ("atom", "Atomo", 1), "json": ("json", "Gei", 2), "empty": ("rss", None, 0), "latin": ("rss", "Città", 0),
        "other": (None, None, 0), "not": (None, None, 0), "bad": (None, None, 0), "none": (None, None, 0)}
    assert [tuple(s) for s in found["rss"].sample] == [("Uno <b>", "https://a.it/1", "Tue, 02 Jan 2024 10:00:00 +0100"), ("Due", "https://a.it/2", ""), ("Senza", "", "")]
    atom, json = found["atom"]["items"][0], found["json"]["items"][0]
    assert (atom.url, atom.title, atom.author, atom.tags, atom.image, atom.content) == ("https://b.it/1", "T <i>", "Lei", ["X", "Y"], "p.png", "<p>c")
    assert (json.id, json.author, json.tags, json.content) == ("7", "Noi", ["u"], "<p>h")


def test_candidates(spark):
    now = datetime(2030, 1, 1)
    rows = {r.url: r for r in feeds.candidates(parsed(spark), F.lit("https://a.it/f/g/feed.xml"), now).collect()}
    assert len(rows) == 6
    assert {u: r.image_url for u, r in rows.items()} == {
        "https://a.it/1": "https://a.it/f/i.png", "https://a.it/2": "https://a.it/t.jpg", "https://a.it/4": "https://a.it/f/g/e.jpg", "https://r.it/1": None, "https://b.it/1": "https://a.it/f/g/p.png",
        "https://c.it/1": "https://d.it/i.png"}
    assert {u: r.published_at for u, r in rows.items() if u[-1] != "1"} == {"https://a.it/2": now, "https://a.it/4": datetime(2024, 1, 3)}
    assert rows["https://a.it/1"].taxonomy == ["A", "B"] and rows["https://a.it/1"].author == "Chi" and rows["https://a.it/1"].published_at == datetime(2024, 1, 2, 9)
    assert rows["https://a.it/1"].content_html.startswith("<p><img") and rows["https://b.it/1"].description == "s" and len(rows["https://a.it/4"].title) == 300


def test_rss_written_and_read(spark):
    rows = [("a & b", i, None if i == 3 else f'T<{i}> "q" \x01&amp;', f"https://a.it/?a={i}&b", None, datetime(2024, 1, 1 + i % 5), "S") for i in range(60)]
    table = spark.createDataFrame(rows, "feed string, item_id int, title string, url string, description string, published_at timestamp, source string")
    out = feeds.rss_feeds(table, 50).select(F.col("rss").cast("binary").alias("content"))
    read = feeds.parse_feeds(out).first()
    order = sorted(range(60), key=lambda i: (-(i % 5), -i))[:50]
    assert read.title == "a & b" and [i.url for i in read["items"]] == [f"https://a.it/?a={i}&b" for i in order]
    assert [i.title for i in read["items"]] == ["untitled" if i == 3 else f'T<{i}> "q" &amp;' for i in order]
    assert feeds.rss_feeds(table.limit(0)).count() == 0
