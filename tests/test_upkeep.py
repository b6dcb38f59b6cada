"""Sources, snapshots and statistics on hand-made cases."""

import pytest

from newsloom.operators import upkeep as U
from newsloom.sources import store


def test_sources(spark):
    schema = "source_id long, url_feed string, wp_api_root string, title string, status string"
    old = spark.createDataFrame([(4, "https://a.it/f/", None, "A", "active"), (7, None, "https://b.it/wp", "B", "broken"), (8, None, None, "C", "active")], schema)
    found = spark.createDataFrame([("HTTPS://A.it/f", None, "A2"), (None, "https://b.it/wp", None), (None, None, "nothing"), ("https://n.it", None, "N"), ("https://n.it/", None, "M"), ("https://o.it", None, None)],
                                  "url_feed string, wp_api_root string, title string")
    out = {r.source_id: (r.title, r.status) for r in U.upsert_sources(old, found).collect()}
    assert {k: out.pop(k) for k in (4, 7, 8)} == {4: ("A2", "active"), 7: ("B", "broken"), 8: ("C", "active")}
    assert sorted(out) == [9, 10] and {s for _, s in out.values()} == {"pending"}
    assert sorted(r.source_id for r in U.upsert_sources(old.limit(0), found).collect()) == [1, 2, 3, 4]
    assert U.upsert_sources(old, found.limit(0)).count() == 3


def test_snapshot_columns(spark):
    path = store.work_folder(spark, "test-snapshot")
    spark.createDataFrame([("a", "t", "A"), (None, "t", "B"), ("", "t", "C")], "slug string, type string, name string").write.parquet(path)
    assert [r.slug for r in U.import_snapshot(spark, path).collect()] == ["a"]
    with pytest.raises(ValueError, match="refs, size"):
        U.import_snapshot(spark, path, ("slug", "size", "refs"))


def test_statistics(spark):
    rows = spark.createDataFrame([("a", '{"q":"1","x":2}'), ("a", '{"x":null}'), ("a", None), ("b", '{"q":"","x":0}')], "type string, refs string")
    assert {r.type: (r.n, r.with_identity, r.lacking) for r in U.topic_statistics(rows, "refs", "q", ("q", "x")).collect()} == {"a": (3, 1, 2), "b": (1, 1, 0)}
