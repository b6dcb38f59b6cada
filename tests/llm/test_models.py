"""Operators with learnt models: brute force on small inputs, held-out accuracy, and odd inputs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsloom.llm import ctw, html_extract, language_id, toxicity
from newsloom.llm.common import fold
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, score string, predicted string, word string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "y", "z") for i, (t, lang) in enumerate(rows)], DOCS)


# --- context-tree weighting ---


def brute_ctw(train, texts, depth):
    """Recursive block probabilities and predictions over all contexts."""
    counts = {}
    pad = b"\xff" * depth

    def grams(text):
        line = pad + text.encode() + b"\xff"
        for i in range(depth, len(line)):
            yield line[i - depth : i][::-1], line[i]

    for text in train:
        for context, byte in grams(text):
            for bit in range(8):
                prefix = (byte | 256) >> (8 - bit)
                for d in range(depth + 1):
                    counts.setdefault((prefix, context[:d]), [0, 0])[(byte >> (7 - bit)) & 1] += 1
    children = {}
    for prefix, context in counts:
        if context:
            children.setdefault((prefix, context[:-1]), []).append((prefix, context))
    lg = math.lgamma
    memo = {}

    def own(node):
        a, b = counts[node]
        return lg(a + 0.5) + lg(b + 0.5) - lg(a + b + 1) - math.log(math.pi)

    def mixed(node):
        if node not in memo:
            if len(node[1]) == depth:
                memo[node] = own(node)
            else:
                x, y = own(node), sum(mixed(c) for c in children[node])
                m = max(x, y)
                memo[node] = m + math.log(math.exp(x - m) + math.exp(y - m)) - math.log(2)
        return memo[node]

    def predict(prefix, context, d):
        node = (prefix, context[:d])
        if node not in counts:
            return None
        a, b = counts[node]
        kt = (b + 0.5) / (a + b + 1)
        if d == depth:
            return kt
        stop = min(1.0, math.exp(own(node) - mixed(node) - math.log(2)))
        deeper = predict(prefix, context, d + 1)
        return stop * kt + (1 - stop) * (kt if deeper is None else deeper)

    out = []
    for text in texts:
        total = 0.0
        for context, byte in grams(text):
            for bit in range(8):
                p = predict((byte | 256) >> (8 - bit), context, 0)
                p = 0.5 if p is None else p
                total += math.log10(p if (byte >> (7 - bit)) & 1 else 1 - p)
        out.append(total)
    return out


@pytest.mark.parametrize("frequent", [10**6, 12])
def test_context_trees(spark, frequent):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["the", "cat", "sat", "é", "Mat", "zz"], k=rng.randint(0, 12))) for _ in range(25)] + [None, "", "unseen WORDS", "the cat sat"]
    held = lambda i: i % 4 == 1
    rows = ctw.score_documents(docs_of(spark, [(t, "en") for t in texts]), F.col("doc_id") % 4 == 1, 3, frequent, frequent // 4).orderBy("doc_id").collect()
    train = [t or "" for i, t in enumerate(texts) if not held(i)]
    words = Counter(w for t in train for w in [*t.lower().split(), None])
    n, v = sum(words.values()), len(words)
    for i, (row, score) in enumerate(zip(rows, brute_ctw(train, [t or "" for t in texts], 3), strict=True)):
        own = [*(texts[i] or "").lower().split(), None]
        assert (row.doc_id, row.held_out, row.n_tokens, row.train_tokens) == (i, held(i), len(own), n)
        assert row.n_known == sum(w in words for w in own)
        assert row.base_score == pytest.approx(sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
        assert row.score == pytest.approx(score, rel=1e-9)
        assert row.bits_per_byte == pytest.approx(-score * math.log2(10) / (len((texts[i] or "").encode()) + 1), rel=1e-9)


def test_context_trees_odd(spark):
    assert ctw.score_documents(docs_of(spark, []), F.lit(False)).collect() == []
    row = ctw.score_documents(docs_of(spark, [("ab", "en")]), F.lit(True)).first()  # nothing learnt
    assert row.score == pytest.approx(24 * math.log10(0.5)) and row.n_known == 0 and row.train_tokens == 0


# --- language identification ---


def test_languages_held_out(spark):
    docs = spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet")
    held_out = fold(F.col("doc_id"), 4) == 2
    rows = language_id.predict(docs, language_id.train_machines(docs, ~held_out, None)).where(held_out).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_odd(spark):
    docs = docs_of(spark, [("der die das und nicht mit von", "de")] * 6 + [("the and of with that this is", "en")] * 6 + [(None, "en"), ("", "de"), ("123 ... !", "en"), ("und nicht die", None)])
    model = language_id.train_machines(docs, F.lit(True))
    out = language_id.predict(docs, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in out[12:15]] == ["und"] * 3 and [r.score for r in out[12:15]] == [0.0] * 3
    assert out[15].lang_pred == "de" and {r.lang_pred for r in out[:6]} == {"de"} and {r.lang_pred for r in out[6:12]} == {"en"}
    assert language_id.predict(docs.limit(0), model).collect() == []
    clash = docs.withColumn("__text", F.lit("x")).withColumn("lang_pred", F.lit(1))
    assert [r.lang_pred for r in language_id.predict(clash, model).orderBy("doc_id").collect()] == [r.lang_pred for r in out]
    nothing = language_id.train_machines(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}


def test_language_decision_against_votes():
    """Most one-versus-one wins, then the larger sum of probabilities; the score is the winner's mean probability."""
    import numpy as np

    rng = random.Random(4)
    for _ in range(200):
        names = list("abcd")[: rng.randint(1, 4)]
        margin = {(x, y): np.array([rng.choice([-1.0, -0.2, 0.0, 0.3, 1.5])]) for i, x in enumerate(names) for y in names[i + 1 :]}
        best, score = language_id._decide(margin, names, "", 1)
        votes = {}
        for n in names:
            wins, chance = 0, 0.0
            for (x, y), m in margin.items():
                p = 1 / (1 + math.exp(-4 * m[0]))
                if n in (x, y):
                    wins += (m[0] > 0) == (n == y)
                    chance += p if n == y else 1 - p
            votes[n] = (wins, chance)
        top = max(votes.values())
        assert votes[names[best[0]]] == pytest.approx(top)
        assert score[0] == pytest.approx(top[1] / (len(names) - 1) if len(names) > 1 else 1.0)


def test_machine_reaches_the_optimum():
    """The dual solution's loss is near the best that plain subgradient descent finds."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 12)) + 1
    x -= x.mean(axis=0)
    y = np.where(x[:, 0] + rng.normal(size=80) > 0.3, 1, -1)
    constant = np.sqrt((x**2).sum(axis=1).mean())
    loss = lambda w, c: 0.005 * (w @ w + (c / constant) ** 2) + np.maximum(0, 1 - y * (x @ w + c)).mean()
    w, c = language_id.fit_machine(x.astype(np.float32), y, passes=3000)
    other, wide = np.zeros(13), np.hstack([x, np.full((80, 1), constant)])
    best = 1e9
    for step in range(1, 20_000):
        best = min(best, loss(other[:12], other[12] * constant))
        active = y * (wide @ other) < 1
        other -= (0.01 * other - (y[active, None] * wide[active]).sum(axis=0) / 80) / (20 + step) ** 0.6
    assert loss(w, c) <= best * 1.01


# --- toxicity ---


def test_channel_restores(spark):
    docs = spark.createDataFrame([("stupid idiot loser the clown said that the stupid idiot is a loser and the moron",)] * 20, "text string")
    channel = toxicity.Channel(toxicity.trigram_counts(docs))
    assert "stupid" in channel.restore("$tup1d") and "idiot" in channel.restore("1d10t") and "loser" in channel.restore("l.o.s.e.r")
    assert "loser" in channel.restore("looooser") and "moron" in channel.restore("m0r0n,")
    assert channel.restore("clown.") == ("clown",) and channel.restore("2024") == ("2024",) and channel.restore("") == ("",)
    assert "idiot" in toxicity.tokens("you i d i o t there")


def test_channel_against_all_paths():
    """Viterbi finds the most probable of all restorations of short tokens; segments likewise, with boundaries anywhere."""
    import itertools
    import re

    import numpy as np

    rng = random.Random(6)
    counts = np.random.default_rng(1).integers(0, 30, toxicity.SIZE**3) ** 2
    channel = toxicity.Channel(counts)
    k = toxicity._CODE

    def probability(word):
        line = [0, 0, *(k[c] for c in word), 0]
        return sum(channel.lm[a][b][c] for a, b, c in zip(line, line[1:], line[2:]))

    for _ in range(60):
        token = "".join(rng.choices("abi10$@!-*", k=rng.randint(1, 6)))
        options = [channel.options(m[1], len(m[0])) for m in re.finditer(r"(.)\1*", token)]
        best = max(sum(c for _, c in path) + probability("".join(x for x, _ in path)) for path in itertools.product(*options))
        made = channel.decode(token)
        reach = max(sum(c for _, c in path) for path in itertools.product(*options) if "".join(x for x, _ in path) == made)
        assert reach + probability(made) == pytest.approx(best)


def test_trigram_counts(spark):
    counts = toxicity.trigram_counts(spark.createDataFrame([("Ab é",), (None,), ("",)], "text string")).reshape([toxicity.SIZE] * 3)
    a, b, e = toxicity._CODE["a"], toxicity._CODE["b"], toxicity._CODE["é"]
    assert counts[0, 0, a] == 1 and counts[0, a, b] == 1 and counts[a, b, 0] == 1 and counts[0, 0, e] == 1 and counts[0, e, 0] == 1


def test_toxicity_held_out(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(sf + "/documents.parquet").select("doc_id", "text"), spark.read.parquet(sf + "/labels.parquet")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, labels, ~held_out)
    rows = toxicity.score(docs.where(held_out), model).join(labels, "doc_id").select("toxic", "predicted").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic], [r.predicted for r in rows if not r.toxic]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.01 * len(clean)
    hidden = spark.createDataFrame([(1, "an ordinary text about nothing at all, $tup1d m0r0n and l o s e r"), (2, "an ordinary text about nothing at all"), (3, None), (4, "")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score(hidden, model).collect()} == {1: 1, 2: 0, 3: 0, 4: 0}
    assert toxicity.score(hidden.limit(0), model).collect() == []


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (2, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    assert [r.predicted for r in toxicity.score(docs, model).collect()] == [0, 0]


# --- main text ---

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="home">
<header class="site-header"><h1>Site name</h1><nav><ul><li><a href="/">Home</a><li><a href="/b">About us</a></ul></nav></header>
<div class="cookie-notice"><p>We use cookies. Accept them.</p></div><script>var x = "<p>no</p>";</script>
<div class="ad">Buy now! Best prices.</div>
<article class="post"><h1>The  title &amp; more</h1><p>First <b>bold</b>
 paragraph with a <a href="/x">link</a> inside it, and more words to read.<p>Second &lt;i&gt; paragraph, left open, with quite some text in it as well.
<aside class="related"><ul><li><a href="/1">Other story</a></li><li><a href="/2">Another story</a></li></ul></aside>
<ul><li>item one of the list</li><li>item two of the list</li></ul></article>
<form class="search-form"><label>Search</label><input type="text"><button>Go</button></form>
<section class="comments"><div class="comment"><p>Reader comment, very angry.</p></div></section><!-- hidden -->
<footer>&copy; 2024 Site</footer></body></html>"""


def test_main_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "v", "", "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    out = html_extract.extract(pages).collect()
    want = ("The title & more\n\nFirst bold paragraph with a link inside it, and more words to read.\n\n"
            "Second <i> paragraph, left open, with quite some text in it as well.\n\nitem one of the list\n\nitem two of the list")  # fmt: skip
    by = {r.page_id: r for r in out}
    assert len(out) == 4 and by[1].text == want and by[1].n_chars == len(want)
    assert by[2].text == "" and by[3].n_chars == 0
    assert html_extract.extract(pages.limit(0)).collect() == []


def test_main_text_of_generated_pages(spark):
    """Words of main text begin with m: pages of another seed than the training's."""
    rng = random.Random(99)
    rows = [(i, "u", html_extract.training_page(rng)) for i in range(80)]
    right = wrong = missed = 0
    for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        words = r.text.split()
        nodes, blocks = html_extract.parse(rows[r.page_id][2])
        total = sum(w.startswith("m") for block in blocks for _, t in block for w in t.split())
        right += (kept := sum(w.startswith("m") for w in words))
        wrong += len(words) - kept
        missed += total - kept
    assert missed <= 0.05 * (right + missed) and wrong <= 0.05 * (right + wrong)


def test_decoding_is_the_best_closed_set():
    """Against all sets of nodes that are closed upwards."""
    import itertools

    import numpy as np

    nodes, _ = html_extract.parse("stray<div><p>a <span class=x>b</span></p><div><p>c</p>loose</div></div><nav><p>d</p></nav>")
    assert len(nodes) == 10
    rng = random.Random(0)
    sets = [s for s in itertools.product([False, True], repeat=len(nodes)) if s[0] and all(s[n.parent] for n, k in zip(nodes[1:], s[1:], strict=True) if k)]
    for _ in range(60):
        odds = np.array([rng.uniform(-3, 3) for _ in nodes])
        keep = html_extract.decode(nodes, odds)
        best = max(sets, key=lambda s: sum(o for o, k in zip(odds[1:], s[1:], strict=True) if k))
        assert tuple(keep) == best


def test_parser_survives_anything():
    rng = random.Random(1)
    parts = ["<p>", "</p>", "<div", ">", "<a href='", "'", "</div>", "<!--", "-->", "<script>", "x", "&am", "<li>", "</ul>", "<b/>", "<", "<span id=a>", "</span>", "<svg>", "<td>", '"', "</", "<!", "&#99999999999;"]
    for _ in range(600):
        nodes, blocks = html_extract.parse("".join(rng.choices(parts, k=40)))
        assert sorted(html_extract._top_down(nodes)) == list(range(len(nodes)))
        html_extract.features(nodes)
        assert all(0 <= i < len(nodes) for block in blocks for i, _ in block)


@pytest.mark.parametrize("part", ["<a ", "<div>", "<div><p>", "<svg>", '<a "', "<!--", "<b>", "<li>", "<p class='a'", "</div>", "<span class=x>", "<ul><li>", "&#1", "< ", "<a b='", "<td>x"])
def test_parser_takes_linear_time(part):
    import time

    began = time.process_time()
    nodes, _ = html_extract.parse(part * (1_000_000 // len(part)))
    html_extract.features(nodes)
    assert time.process_time() - began < 40
    html_extract.parse("<div " + "a" * 1_000_000 + ">x" + "&#" + "1" * 100_000 + ";")


# Pages by hand, none of whose classes, layouts or words the generator makes.
HAND = [
    ("""<body><a href="#c">Skip to content</a> Log in <article><h1>Rain</h1><p>It rained all day in the valley, and the river rose by two metres.</p></article></body>""",
     "Rain\n\nIt rained all day in the valley, and the river rose by two metres."),
    ("""<html><body><div id="navbar"><a href=/>Start</a> <a href=/n>News</a></div><div id="content"><h2>Bridge opens</h2>
<p>The new bridge opened on Monday. <span class="advert">Cheap flights here!</span> Thousands of people crossed it.</p>
<p>Traffic is expected to fall by a third, the <span class="term">city council</span> said in a statement.</p></div><div id="footer">Contact us. All rights reserved.</div>""",
     "Bridge opens\n\nThe new bridge opened on Monday. Thousands of people crossed it.\n\nTraffic is expected to fall by a third, the city council said in a statement."),
    ("""<div class="post-body entry-content">My grandmother baked this bread every week.<br>You need flour, water and a lot of time.
<div class="social-share"><a href="#">Tweet</a> <a href="#">Like</a></div>Let the dough rest for twelve hours before you bake it.</div>
<div id="comments"><p>Great recipe, thanks!</p><p>Mine burned.</p></div>""",
     "My grandmother baked this bread every week. You need flour, water and a lot of time.\n\nLet the dough rest for twelve hours before you bake it."),
    ("""<div class="c1"><div class="c2"><p>The valley was quiet when the rain began to fall on Monday.</p><p>Farmers looked at the sky and counted the days, as they do in autumn.</p></div></div>""",
     "The valley was quiet when the rain began to fall on Monday.\n\nFarmers looked at the sky and counted the days, as they do in autumn."),
    ("""<div class="texte"><p>Le chat dort sur la chaise, et la maison est calme ce soir.</p></div>""", "Le chat dort sur la chaise, et la maison est calme ce soir."),
    ("Just a text without any tags. It has two sentences.", "Just a text without any tags. It has two sentences."),
    ("""<article><h1>Harbour</h1><p>The harbour is closed this week, and ships wait outside the breakwater.</p>
<section id="respond"><h3>Leave a reply</h3><p>Nice post, thank you so much for it!</p><p>I do not agree at all.</p></section></article>""",
     "Harbour\n\nThe harbour is closed this week, and ships wait outside the breakwater."),
    ("""<html><body><nav><a href=/>Home</a></nav><footer>Copyright 2024</footer></body></html>""", ""),
    ("""<div><div><div><div><p>Deep text in many unnamed blocks, which is still the article of the page.</p></div></div></div></div><div class=footer>All rights</div>""",
     "Deep text in many unnamed blocks, which is still the article of the page."),
]


def test_rescue_takes_text_but_no_boilerplate():
    import numpy as np

    for page, text in (("<div><p>kept</p><p>dropped</p></div>", "kept"), ("<nav><p>a</p></nav><footer>b</footer>", ""), ("<div class=cookie>a</div>", ""), ("<div><a href=x>link</a></div>", "")):
        nodes, blocks = html_extract.parse(page)
        odds = np.array([-1.0 - (n.place if n.tag == "p" else 0) for n in nodes])
        own = {n for block in blocks for n, t in block if t.strip()}
        assert html_extract._text(blocks, html_extract.rescue(nodes, odds, html_extract.features(nodes), own)) == text


def test_pages_by_hand(spark):
    rows = [(i, "u", page) for i, (page, _) in enumerate(HAND)]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [out[i] for i in range(len(HAND))] == [text for _, text in HAND]
