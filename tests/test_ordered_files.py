"""Files whose order matters, cut into several splits, against reading them line by line."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.sources import ordered_files as O

WORDS = """Root
# Sistema: rotte
admin
API
# Brand / copyright
Acme
admin

# just a note
globex
# Profanity and slurs
  foo
acme"""
TOPICS = """---
# topics
- slug: roma
  type: location
  display_name: "Roma \\"caput\\""
  aliases: [Urbe, 'Città ''Eterna''', ]
- type: brand   # a brand
  slug: acme
  display_name: 'Acme: the "one"'
  aliases:
    - ACME Inc
    - acme spa
  description: ~
  wikidata: Q1
- slug: roma
  display_name: Roma
  type: city
- display_name: no slug
"""
FEATURED = """- url_feed: https://a.it/feed/
  display_name: A
  category_hint: news
  position: 2
- wp_api_root: https://b.it/wp-json
  display_name: B
- url_feed: https://c.it/rss
  url_site: https://c.it
  display_name: C
  position: x
- url_feed: https://A.it/feed
  display_name: A again
  category_hint: sport
- display_name: nothing
"""


@pytest.fixture(params=["128m", "40b"])
def splits(spark, request):
    if request.param == "40b":
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield request.param
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


def test_lines(spark, splits, tmp_path):
    texts = {"a.txt": "\n".join(f"line {i}" for i in range(200)), "b.txt": "x\n\ny"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    rows = O.numbered_lines(spark, str(tmp_path)).collect()
    for name, text in texts.items():
        own = sorted((r.line, r.value) for r in rows if r.file.endswith(name))
        assert own == list(enumerate(text.split("\n"), 1))
    assert (max(r["split"] for r in rows) > 0) == (splits == "40b")


def test_reserved_words(spark, splits, tmp_path):
    path = tmp_path / "w.txt"
    path.write_text(WORDS)
    found = {r.word: r.reason for r in O.reserved_words(O.numbered_lines(spark, str(path))).collect()}
    assert found == {"root": "system", "admin": "brand", "api": "system", "acme": "profanity", "globex": "brand", "foo": "profanity"}
    rng = random.Random(3)
    lines = [rng.choice(["# brand", "# slur", "# rotte", "# other", "", "w%d" % rng.randint(0, 30), "W%d" % rng.randint(0, 30)]) for _ in range(300)]
    path.write_text("\n".join(lines))
    reason, true = "system", {}
    for line in lines:
        if line.startswith("#"):
            reason = {"# brand": "brand", "# slur": "profanity", "# rotte": "system"}.get(line, reason)
        elif line:
            true[line.lower()] = reason
    assert {r.word: r.reason for r in O.reserved_words(O.numbered_lines(spark, str(path))).collect()} == true
    path.write_text("")
    assert O.reserved_words(O.numbered_lines(spark, str(path))).count() == 0


def test_topics(spark, splits, tmp_path):
    path = tmp_path / "t.yaml"
    path.write_text(TOPICS)
    items = O.yaml_items(O.numbered_lines(spark, str(path)))
    assert items.count() == 4
    found = {r.slug: tuple(r)[1:] for r in O.seed_topics(items).collect()}
    assert found == {"roma": ("city", "Roma", [], None, None), "acme": ("brand", 'Acme: the "one"', ["ACME Inc", "acme spa"], None, "Q1")}
    first = items.orderBy("item").first().fields
    assert first["display_name"] == ['Roma "caput"'] and first["aliases"] == ["Urbe", "Città 'Eterna'"]


def test_featured(spark, splits, tmp_path):
    path = tmp_path / "f.yaml"
    path.write_text(FEATURED)
    sources = spark.createDataFrame([(5, "rss", "https://a.it", "https://a.it/feed", None, "Old", "active"), (9, "rss", None, "https://z.it/f", None, "Z", "active")],
                                    "source_id long, kind string, url_site string, url_feed string, wp_api_root string, title string, status string")
    featured = spark.createDataFrame([(5, "old", "Old", None, 0), (9, "z", "Z", None, 1)], "source_id long, hint string, name string, description string, position int")
    out, placed = O.seed_featured(O.yaml_items(O.numbered_lines(spark, str(path))), sources, featured)
    made = sorted((r.url_feed or r.wp_api_root, r.kind, r.title, r.status) for r in out.where("source_id > 9").collect())
    assert made == [("https://b.it/wp-json", "wordpress_api", "B", "pending"), ("https://c.it/rss", "rss", "C", "pending")] and out.count() == 4
    names = {r.source_id: r.url_feed or r.wp_api_root for r in out.collect()}
    assert {names[r.source_id]: (r.hint, r.name, r.position) for r in placed.collect()} == {
        "https://a.it/feed": ("sport", "A again", 0), "https://z.it/f": ("z", "Z", 1), "https://b.it/wp-json": (None, "B", 0), "https://c.it/rss": (None, "C", 0)}


def test_provinces(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text('Sigla,Provincia\nFC,ForlÃ¬-Cesena\nRM, Roma \nXX,\nAQ,L\'Aquila\nRX,ROMA\n"BZ","Bolzano, Bozen"\n')
    assert {r.slug: r.name for r in O.read_provinces(spark, str(path)).collect()} == {"forli-cesena": "Forlì-Cesena", "roma": "Roma", "l-aquila": "L'Aquila", "bolzano-bozen": "Bolzano, Bozen"}


def test_carried(spark, tmp_path):
    path = tmp_path / "c.txt"
    path.write_text("a\nb\n1\nc\n2\nd")
    rows = O.carried(O.numbered_lines(spark, str(path)), F.when(F.col("value").rlike("[0-9]"), F.col("value")), "n").orderBy("line").collect()
    assert [r.n for r in rows] == [None, None, "1", "1", "2", "2"]
