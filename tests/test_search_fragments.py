"""Fragments around the first match, wherever it is, against brute force."""

import re

from newsloom import registry
from tests.conftest import SF


def test_fragments(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        m = re.search("(?i)of the", r.text or "")
        if m:
            start = max(m.start() - 60, 0)
            want.setdefault(r.doc_id, []).append((m.start(), re.sub("(?i)(of the)", r"<mark>\1</mark>", r.text[start : start + 180])))
    rows = registry.QUERIES["search_fragments"](spark, SF).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r.snippet)
    assert any(at > 180 for found in want.values() for at, _ in found)
    assert all("<mark>" in r.snippet for r in rows)
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(t for _, t in x) for d, x in want.items()}
