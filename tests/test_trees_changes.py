"""Trees against recursion, change logs against dictionaries, archives read back and aborted."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from newsloom.operators import changes as C
from newsloom.operators import trees as T
from newsloom.sources import archives as A


def test_five_levels_orphans_and_cycle(spark):
    rng = random.Random(8)
    nodes = [(i, None if i < 4 else rng.randrange(0, i) if i < 80 else rng.choice([500, 81, 80]), f'n"{i}', rng.choice([0, 1, None])) for i in range(90)]
    nodes += [(200, 201, "cycle", 0), (201, 200, "cycle", 0), (300, 300, "own parent", 0)]
    table = spark.createDataFrame(nodes, "id long, parent_id long, name string, position int")

    def tree(i):
        kids = sorted((n for n in nodes if n[1] == i), key=lambda n: (n[3] or 0, n[0]))
        own = next(n for n in nodes if n[0] == i)
        return {"id": i, "name": own[2], "children": [tree(k[0]) for k in kids]}

    found = {r.id: json.loads(r.tree) for r in T.nested(table, ["id", "name"]).collect()}
    assert found == {i: tree(i) for i in range(4)}
    depth = lambda t: 1 + max(map(depth, t["children"]), default=0)
    assert max(map(depth, found.values())) >= 5
    assert T.nested(table.limit(0), ["id"]).count() == 0 and T.nested(table.where("id >= 200"), ["id"]).count() == 0


def test_owned_descendants(spark):
    rows = spark.createDataFrame([(1, None, 7), (2, 1, 7), (3, 2, 7), (4, 2, 8), (5, None, 8), (6, 5, 7)], "category_id int, parent_id int, user_id int")
    ids = lambda root, user: sorted(r.category_id for r in T.owned_descendants(rows, root, user).collect())
    assert ids(1, 7) == [1, 2, 3] and ids(1, 8) == [] and ids(5, 8) == [5] and ids(99, 7) == []


def test_changes(spark):
    rng = random.Random(5)
    side = lambda: {(rng.randint(0, 20), rng.choice([1, 2, None])): (rng.choice([1.0, 2.0, None]), rng.choice(["a", None])) for _ in range(60)}
    old, new = side(), side()
    schema = "doc_id int, topic_id int, score double, position string"
    a, b = (spark.createDataFrame([(*k, *v) for k, v in x.items()], schema) for x in (old, new))
    keys, values = ["doc_id", "topic_id"], ["score", "position"]
    log = C.changes(a, b, keys, values)
    true = {k: ("insert", *v) for k, v in new.items() if k not in old} | {k: ("delete", None, None) for k in old if k not in new} | {
        k: ("update", *v) for k, v in new.items() if k in old and old[k] != v}
    assert {(r.doc_id, r.topic_id): (r.op, r.score, r.position) for r in log.collect()} == true
    out = C.apply_changes(a, log, keys)
    assert {(r.doc_id, r.topic_id): (r.score, r.position) for r in out.collect()} == new and out.count() == len(new)
    assert C.changes(out, b, keys, values).count() == 0
    assert C.apply_changes(out, log, keys).count() == len(new)


def test_reclassify_one_source(spark):
    topics = spark.createDataFrame([(1, "roma", "Roma", "location", [], True, False), (2, "acme", "Acme", "brand", ["ACME Inc"], True, False)],
                                   "topic_id long, slug string, name string, type string, aliases array<string>, is_curated boolean, case_sensitive boolean")
    articles = spark.createDataFrame([(10, "s", "A Roma oggi", "piove su acme", []), (11, "s", "Niente", "nulla", []), (12, "t", "Roma", "x", [])],
                                     "doc_id long, source string, title string, body string, taxonomy array<string>")
    edges = spark.createDataFrame([(10, 1, 3.0, "title"), (11, 2, 1.0, "body"), (12, 2, 1.0, "body")], "doc_id long, topic_id long, score double, position string")
    log, _ = C.reclassify(articles, edges, topics, "s", curated_only=True)
    assert sorted(map(tuple, log.collect())) == [("delete", 11, 2, None, None), ("insert", 10, 2, 1.0, "body")]
    after = C.apply_changes(edges, log, ["doc_id", "topic_id"])
    assert sorted(tuple(r)[:2] for r in after.collect()) == [(10, 1), (10, 2), (12, 2)]
    assert C.reclassify(articles, after, topics, "s", curated_only=True)[0].count() == 0
    titles, _ = C.reclassify(articles, after, topics, "s", curated_only=True, title_only=True)
    assert [tuple(r)[:3] for r in titles.collect()] == [("delete", 10, 2)]


def test_archives(spark, tmp_path):
    rows = [(f"u{i}", f"m{k}.json", f'{{"i":{i},"é":{k}}}' * k) for i in range(30) for k in range(3)] + [(None, "x", "y"), ("u1", None, "y")]
    table = spark.createDataFrame(rows, "archive string, member string, content string")
    path = str(tmp_path / "out")
    for _ in range(2):  # the second run replaces the first
        A.write_archives(table, path)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.name != "_temporary") == sorted(f"u{i}.zip" for i in range(30))
    assert sorted(map(tuple, A.read_archives(spark, path).collect())) == sorted(r for r in rows if r[0] and r[1])
    assert zipfile.ZipFile(tmp_path / "out" / "u3.zip").testzip() is None


def test_aborted_archives_leave_nothing(spark, tmp_path):
    bad = F.when(F.col("id") == 90, F.raise_error(F.lit("stop"))).otherwise("c").cast("string")
    table = spark.range(100).select(F.concat(F.lit("u"), F.col("id")).alias("archive"), F.lit("m").alias("member"), bad.alias("content"))
    with pytest.raises(Exception, match="stop"):
        A.write_archives(table, str(tmp_path))
    assert not list(tmp_path.rglob("*.zip"))
    A.write_archives(table.where("id <> 90"), str(tmp_path))
    assert len(list(tmp_path.glob("*.zip"))) == 99
