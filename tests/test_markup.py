"""Attack strings, odd markup and the rules of normalising."""

import random
import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from newsloom.functions import markup as M

CASES = {
    "<img src=x onerror=alert(1)>": '<img src="x">',
    "<a href=javascript:alert(1)>x</a>": "<a>x</a>",
    "<a href='java&#10;script:alert(1)'>x</a>": "<a>x</a>",
    '<a href=" &#x6A;avascript:alert(1)">x</a>': "<a>x</a>",
    '<a href="&amp;#106;avascript:x">x</a>': "<a>x</a>",
    '<a href="JaVaScRiPt:x" title=\'a "b"\'>x</a>': '<a title="a &quot;b&quot;">x</a>',
    "<a href=data:text/html,x>x</a>": "<a>x</a>",
    '<a href="/p?a=1&amp;b=2#c:d" onclick="x" rel=nofollow>x</a>': '<a href="/p?a=1&amp;b=2#c:d" rel="nofollow">x</a>',
    "a<script>alert('<p>')</script>b<style>x": "ab",
    "a<script>alert(1)": "a",
    "a<SCRIPT src=x>b</ScRiPt >c": "ac",
    "<scr<script>ipt>alert(1)</script>x": "ipt&gt;alert(1)x",
    "<p>a<div>b</div><p>c": "<p>ab<p>c</p></p>",
    "<ul><li>a</ul>b</li>": "<ul><li>a</li></ul>b",
    "<!-- <p>x --><p>y</p><!-- z": "<p>y</p>",
    "1 < 2 > 3 <3 & &lt;b&gt;": "1 &lt; 2 &gt; 3 &lt;3 & &lt;b&gt;",
    "<p title=x": "", "<p/>x<br/>y</br>": "<p>x<br>y</p>", "<": "&lt;", "": "", "</p>x": "x",
    '<img src="a"src="javascript:b"alt=">">': '<img src="a" alt="&gt;">',
    "<img/src=x/onerror=alert(1)>": '<img src="x/onerror=alert(1)">',
    "<svg onload=alert(1)><p style='x:expression(1)'>t</p></svg>": "<p>t</p>",
    "<iframe src=x>y</iframe>z<?php <p> ?>w<!DOCTYPE html>": "z ?&gt;w",
    "<a href='https://x.it' href='javascript:1'>x": '<a href="https://x.it">x</a>',
}


def test_cases(spark):
    rows = spark.createDataFrame([(h,) for h in [*CASES, None]], "h string").select("h", M.sanitize("h").alias("s")).collect()
    assert {r.h: r.s for r in rows} == CASES | {None: None}


class Seen(HTMLParser):
    def __init__(self):
        super().__init__()
        self.bad = []

    def handle_starttag(self, tag, attrs):
        if tag not in M.TAGS:
            self.bad.append(tag)
        for k, v in attrs:
            if k not in M.ATTRIBUTES.get(tag, ()) or k in ("href", "src") and re.match(r"[\s\x00-\x20]*(javascript|data|vbscript)", v or "", re.I):
                self.bad.append((tag, k, v))

    def handle_comment(self, data):
        self.bad.append(data)


@pytest.mark.parametrize("seed", range(3))
def test_nothing_else_comes_out(seed):
    rng = random.Random(seed)
    parts = ["<", ">", "</", "<a ", "<img ", "<script>", "</script>", "<p", "<!--", "-->", "<!", "href=", "src=", "onload=", "javascript:x", '"', "'", " ", "/", "=", "&#58;", "x", "<style", "\n", "&lt;", "<svg/", "title=", "\x00"]
    for _ in range(3000):
        out = M.clean("".join(rng.choices(parts, k=rng.randint(1, 25))))
        seen = Seen()
        seen.feed(out)
        seen.close()
        assert not seen.bad, out
        assert M.clean(out) == out


@pytest.mark.parametrize("part", ["<", "<p ", "<p a", "<!--", "</script", "<script>", "<a href=\"", "a=b ", "<p/ =", "&", "<p>"])
def test_linear_time(part):
    times = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        M.clean(part * n)
        times.append(time.perf_counter() - began)
    assert times[1] < 12 * times[0] + 0.5


def test_normalising(spark):
    long = "<p>" + "x" * 500 + "</p>"
    page = '<html><meta property="og:image" content=" ../i.png "><body><p>page <a href="/l">L</a></p><script>s</script></body></html>'
    rows = [(1, long, "d", None, page), (2, "<b>short</b>", "d", "own.png", page), (3, None, "d", None, None), (4, "", None, "", page), (5, "<i>only</i>", "d", None, None), (6, None, None, None, None)]
    table = spark.createDataFrame([(i, c, d, im, "https://a.it/x/y/z", p) for i, c, d, im, p in rows], "id int, content_html string, description string, image_url string, url string, page_html string")
    found = {r.id: r for r in M.normalize_articles(table).collect()}
    assert {i: (r.content_text, r.content_html_safe, r.image, r.used_page) for i, r in found.items()} == {
        1: ("x" * 500, long, None, False), 2: ("page L", "short", "own.png", True), 3: ("d", None, None, False), 4: ("page L", '<p>page <a href="/l">L</a></p>', "https://a.it/x/i.png", True),
        5: ("only", "only", None, False), 6: ("", None, None, False)}
    assert [tuple(x) for x in found[4].links] == [("https://a.it/l", "L")]
    assert len(M.normalize_articles(table.limit(1).withColumn("content_html", F.lit("y " * 60_000))).first().content_text) == 50_000
