"""Operators whose results are exact: against SQL, brute force or a round trip."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.llm import chat_format, decontaminate, jaccard_join, packing, registry, sharding, topk_search
from newsloom.llm.words import shingle_sets
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, digest string, row int"


def docs_of(spark, texts, ids=None):
    """Documents with extra columns of clashing names."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", 2) for i, t in zip(ids, texts, strict=True)], DOCS)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    ours = registry.queries()[name](spark, SF).toArrow()
    theirs = duck.execute(registry.oracle_sql()[name]).to_arrow_table()
    columns = ", ".join(f'"{c}"' for c in sorted(ours.column_names))
    duck.register("ours", ours)
    duck.register("theirs", theirs)
    assert ours.num_rows == theirs.num_rows > 0
    assert duck.execute(f"SELECT count(*) FROM (SELECT {columns} FROM ours EXCEPT ALL SELECT {columns} FROM theirs)").fetchall() == [(0,)]


def shingles(text):
    w = [x for x in re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def noisy_copies(rng, n_bases=12, copies=9):
    vocabulary = ["w%d" % i for i in range(300)]
    texts = []
    passage = " ".join(rng.choices(vocabulary, k=60))
    for b in range(n_bases):
        words = rng.choices(vocabulary, k=rng.choice([3, 5, 8, 40, 200]))
        texts.append(" ".join(words))
        for _ in range(copies):
            own = list(words)
            for _ in range(rng.randint(0, 1 + len(own) // 25)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n", " \t"]).join(own).upper() if rng.random() < 0.2 else " ".join(own))
            if b % 3 == 0:
                texts.append(" ".join(own) + " " + passage)
    return texts + ["", None, "  \n", "One", "one", "a b c d", "A b\tc d", "é è à ù ì", " x y z w"] + ["same hot text of seven whole words"] * 30


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    texts = noisy_copies(random.Random(seed))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs_of(spark, texts), frequent=50 * seed).collect()}
    assert found == brute_components(texts)


def test_jaccard_edges(spark):
    none = jaccard_join.jaccard_components(docs_of(spark, []))
    assert none.columns == ["doc_id", "n_shingles", "component_id"] and none.collect() == []
    rows = jaccard_join.jaccard_components(docs_of(spark, ["a b c d e f", "a b c d e f", "a b c d e f"], [4, 4, None])).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in rows) == [(False, 4), (False, 4), (True, None)]


def test_jaccard_blocks_and_hot_shingles(spark):
    """Small blocks, buckets and bounds of hot shingles: groups are cut everywhere and lose no link."""
    texts = noisy_copies(random.Random(3), 6, 25)
    found = jaccard_join.jaccard_components(docs_of(spark, texts), frequent=400, hot_shingle=9, block=600, entries=50, most=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(texts)


def test_jaccard_two_large_groups(spark):
    """Two groups of near copies a few words apart: most documents link within their group, some with none, one with both."""
    rng = random.Random(8)
    base = ["b%d" % i for i in range(90)]
    other = base[:74] + ["o%d" % i for i in range(16)]
    texts = []
    for words in (base, other):
        for _ in range(120):
            own = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
                own[rng.randrange(len(own))] = "e%d" % rng.randrange(10**6)
            texts.append(" ".join(own))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs_of(spark, texts), block=3000, most=1).collect()}
    want = brute_components(texts)
    assert found == want and len({c for _, c in want.values()}) > 4


def test_jaccard_repeated_ids(spark):
    """A doc_id with two texts joins the components of both; a copy of a smaller id's text does not hide its other text."""
    long = " ".join("w%d" % i for i in range(40))
    near = long.replace("w39", "z")
    rows = [(1, "one two three four five six"), (2, "one two three four five six"), (2, long), (3, near), (4, near), (5, "else"), (5, "else"), (6, None), (6, "else")]
    found = jaccard_join.jaccard_components(docs_of(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 1), (5, 5), (5, 5), (6, 5), (6, 5)]


def test_components(spark):
    """One task or several, a long path or random edges: the least node of each component."""
    rng = np.random.default_rng(2)
    for a, b in ((np.arange(60), np.arange(60) + 1), (rng.integers(0, 300, 200), rng.integers(0, 300, 200))):
        least = {n: n for n in {*a.tolist(), *b.tolist()}}
        for _ in range(60):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                least[x] = least[y] = min(least[x], least[y])
        edges = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a long, b long").repartition(8)
        for task_edges in (10**6, 30):
            found = {r.node: r.root for r in jaccard_join.components(edges, task_edges=task_edges).collect()}
            assert found == {n: r for n, r in least.items() if n != r}
    with pytest.raises(RuntimeError):
        jaccard_join.components(edges, 1, 30)
    assert jaccard_join.components(edges.limit(0)).collect() == []


def test_prefix_tree():
    """Every component that links is joined, each link is true, and the walk leaves subtrees early."""
    rng = np.random.default_rng(5)
    for trial in range(40):
        base = np.sort(rng.choice(200, 60, False)).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(1, 60), False), rng.integers(0, 200, rng.integers(0, 20)).astype(np.uint64)])) for _ in range(25)]
        sets += [base, base[:1], sets[0], np.empty(0, np.uint64)]
        labels = np.arange(len(sets)) if trial % 2 else rng.integers(0, 6, len(sets))
        sizes = np.array([len(x) for x in sets])
        got, _ = jaccard_join.walk_group(sets, sizes, labels, sets, sizes, labels, 75)
        root = {c: c for c in set(labels.tolist())}

        def find(c, root=root):
            while root[c] != c:
                c = root[c]
            return c

        links = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)) > 0
        for i, j in got:
            assert links(sets[i], sets[j]) and find(labels[i]) != find(labels[j])
            root[find(labels[i])] = find(labels[j])
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                assert not links(a, b) or find(labels[i]) == find(labels[j])
        # over prefixes: every pair of different components that links is a candidate
        cut = [x[: len(x) - -(-75 * len(x) // 100) + 1] if len(x) else x for x in sets]
        pairs, more = jaccard_join.walk_group(cut, sizes, labels, cut, sizes, labels, 75, 10**6)
        assert not more and {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if links(a, b) and labels[i] != labels[j]} <= set(pairs)
        fewer, more = jaccard_join.walk_group(cut, sizes, labels, cut, sizes, labels, 75, 1)
        assert set(fewer) <= set(pairs) and more == (len(fewer) < len(pairs))


def test_shingle_sets_match_words():
    texts = ["A b c d e f", "", None, "a  b\tc\nd e f", "x", "  é", "a b c d e f g", "f", "a b"]
    sets = list(shingle_sets(pa.array(texts)))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert np.array_equal(sets[0], sets[3]) and len(np.intersect1d(sets[0], sets[6])) == 2


@pytest.mark.parametrize("limit", [0, 10**6])
def test_contained_items(spark, limit):
    rng = random.Random(3)
    words = ["v%d" % i for i in range(400)]
    items = [" ".join(rng.choices(words, k=k)) for k in (3, 5, 9, 20, 60)] + ["", None]
    docs = ["", None] + [" ".join(rng.choices(words, k=150)) for _ in range(10)]
    for k, item in enumerate(items[:5] * 3):
        own = item.split()
        for _ in range(k % 4):
            own[rng.randrange(len(own))] = "zz"
        docs.append(" ".join(rng.choices(words, k=50)) + " " + " ".join(own) + " " + " ".join(rng.choices(words, k=2000)))
    found = decontaminate.contained_items(
        docs_of(spark, docs), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), broadcast_shingles=limit)
    ds, ks = [shingles(d) for d in docs], [shingles(i) for i in items]
    true = {(d, k) for d in range(len(docs)) for k in range(len(items)) if ks[k] and 100 * len(ds[d] & ks[k]) >= 75 * len(ks[k])}
    assert {(r.doc_id, r.item_id) for r in found.collect()} == true and len(true) >= 5
    kept = decontaminate.decontaminate(docs_of(spark, docs), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(range(len(docs))) - {d for d, _ in true} and kept.columns == docs_of(spark, docs).columns


def test_sketches_make_the_candidates():
    """Every contained item is a candidate; documents too small for a size class do not probe it; few others are met."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 5, 9, 30, 31, 100, 400)]
    rows = [(i, h, len(s), int(np.log2(len(s))), k < len(s) - -(-750_000 * len(s) // 1_000_000) + 1) for i, s in enumerate(sets) for k, h in enumerate(s.view(np.int64))]
    sketches = decontaminate.Sketches(*(np.array(c) for c in zip(*rows, strict=True)), 0.75)
    met = true = 0
    for _ in range(300):
        parts = [rng.choice(s, int(np.ceil(len(s) * rng.choice([0.1, 0.7, 0.75, 0.8, 1.0]))), False) for s in sets if rng.random() < 0.4]
        own = np.unique(np.concatenate([*parts, rng.integers(0, 2**63, rng.integers(1, 50)).astype(np.uint64)]))
        want = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, own)) >= 75 * len(s)}
        candidates = set(sketches.candidates(own).tolist())
        assert want <= candidates and {i for i, _, _ in sketches.contained(own)} == want
        assert all(len(own) >= 0.75 * 2 ** int(np.log2(len(sets[i]))) for i in candidates)
        met, true = met + len(candidates), true + len(want)
    assert true <= met <= 2.5 * true


def test_decontaminate_empty(spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained_items(docs_of(spark, ["a b c"]), nothing).collect() == []
    assert decontaminate.contained_items(docs_of(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []


def test_reply_trees(spark):
    rows = [  # tree 1: 1 -> 2 -> 4, 1 -> 3; tree 2: a cycle and a lone message; tree 3: an orphan
        (1, 1, None, "user", "hi", 0.0), (1, 2, 1, "assistant", "a<|im_end|>\n", 1.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 2, "user", None, 2.0),
        (2, 1, 2, "user", "x", 0.0), (2, 2, 1, "user", "y", 0.0), (2, 3, None, "system", "z", None), (3, 8, 7, "user\n%", "<\\|", 0.0)]
    messages = spark.createDataFrame(rows, "tree long, msg long, parent long, role string, text string, score double")
    paths = {(r.tree, r.leaf): r.path for r in chat_format.root_to_leaf_paths(messages).collect()}
    assert paths == {(1, 4): [1, 2, 4], (1, 3): [1, 3], (2, 3): [3], (3, 8): [8]}
    chain = spark.createDataFrame([(7, i, i - 1 if i else None, 1.0) for i in range(37)], "tree long, msg long, parent long, score double")
    assert [(r.leaf, r.path, r.path_score) for r in chat_format.root_to_leaf_paths(chain).collect()] == [(36, list(range(37)), 37.0)]
    assert chat_format.path_steps(chain.limit(0)).collect() == []
    out = {(r.tree, r.rank): r for r in chat_format.read_back(chat_format.format_paths(messages)).collect()}
    assert out[1, 1].leaf == 3 and out[1, 2].leaf == 4
    assert [tuple(t) for t in out[1, 2].turns] == [("user", "hi"), ("assistant", "a<|im_end|>\n"), ("user", "")]
    assert out[1, 2].loss == "a<|im_end|>\n" and out[1, 1].loss == "b"
    assert [tuple(t) for t in out[3, 1].turns] == [("user\n%", "<\\|")]
    assert {r.rank for r in chat_format.format_paths(messages, 1).where("tree = 1").collect()} == {1}


def test_escape_round_trip(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("<|\\>a%\n", k=rng.randint(0, 12))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    e = chat_format.escape_text(F.col("t"))
    for r in rows.select("t", e.alias("e"), chat_format.unescape_text(e).alias("b"), chat_format.unescape_role(chat_format.escape_role(F.col("t"))).alias("c")).collect():
        assert r.b == r.t == r.c and "<|" not in r.e


def test_sharding_against_recursion(spark):
    rng = random.Random(2)
    texts = ["x" * rng.randint(0, 400) for _ in range(600)] + [None, "", "é"] + ["hot"] * 300
    docs = docs_of(spark, texts).withColumn("lang", F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit(None)), (F.col("doc_id") % 3 + 1).cast("int")))
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(texts)
    sizes = [sum(r["size"] for r in rows if r.shard == s) for s in range(24)]
    assert max(sizes) - min(sizes) <= 5 * 408 and sum(sizes) == sum(len((t or "").encode()) + 8 for t in texts)
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    one = {r.doc_id: r for r in rows}
    assert one[0].text_crc32 == zlib.crc32(texts[0].encode()) and one[600]["size"] == 8 and one[602]["size"] == 10
    # the split itself, against a recursion over sorted rows
    keyed = spark.createDataFrame([(i, rng.getrandbits(63), rng.getrandbits(40), rng.randint(1, 50)) for i in range(500)], "i long, a long, b long, w long")
    got = {r.i: r.leaf for r in sharding.kd_split(keyed, ["a", "b"], "w", 7, "leaf").collect()}
    want = {}

    def split(part, first, k):
        if k == 1:
            want.update(dict.fromkeys((r.i for r in part), first))
            return
        axis = "a" if max(r.a for r in part) - min(r.a for r in part) >= max(r.b for r in part) - min(r.b for r in part) else "b"
        part = sorted(part, key=lambda r: r[axis])
        goal, seen, cut = sum(r.w for r in part) * (k // 2) / k, 0, 0
        for cut, r in enumerate(part):
            if seen + r.w >= goal:
                cut += not goal - seen < r.w / 2
                break
            seen += r.w
        split(part[:cut], first, k // 2)
        split(part[cut:], first + k // 2, k - k // 2)

    split(keyed.collect(), 0, 7)
    assert got == want


def test_sharding_keeps_equal_texts(spark):
    """Groups that fit a shard's slack stay whole, whatever their ids, languages and sources; a hot text fills several."""
    rng = random.Random(5)
    texts = ["t%d " % i * rng.randint(20, 60) for i in range(400)]
    texts += [t for t in texts[:60] for _ in range(rng.randint(1, 2))] + ["", None, ""] + ["the hot text " * 10] * 400
    docs = docs_of(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "de")).withColumn("source", (F.col("doc_id") % 5).cast("string"))
    rows = sharding.shard_documents(docs).collect()
    at, size = {}, {}
    for r in rows:
        at.setdefault(r.text_crc32, set()).add(r.shard)
        size.setdefault(r.text_crc32, []).append(r["size"])
    whole = max(max(x) for x in size.values())
    assert all(len(at[c]) == 1 for c in at if sum(size[c]) <= whole) and sum(len(x) > 1 for x in size.values()) > 30
    assert len(at[zlib.crc32(b"the hot text " * 10)]) > 4
    sizes = [sum(r["size"] for r in rows if r.shard == k) for k in range(24)]
    assert max(sizes) - min(sizes) <= 5 * whole


def test_sharding_empty(spark):
    assert sharding.shard_documents(docs_of(spark, [])).collect() == []
    assert [(r["size"], r.slot) for r in sharding.shard_documents(docs_of(spark, [None], [None])).collect()] == [(8, 0)]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdeéßz", k=rng.randint(1, 9))) for _ in range(rng.choice([1, 20, 300, 3000]))) for _ in range(40)]
    texts += [None, "", "  two  spaces ", "tab\tand\nline", "don't I'll 12x ² 東京", "<|endoftext|> inside", "a b\n c", texts[0], "x" * 5000]
    path, ranks = packing.default_tokenizer()
    encode = Tokenizer.from_file(path).encode
    rows = packing.pack_documents(docs_of(spark, texts), path, ranks).collect()
    for doc, text in enumerate(texts):
        ids = [*encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        assert [r.start for r in own] == list(range(0, len(ids), 1024)) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    assert sorted(by) == list(range(len(by)))
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= 1024
    assert packing.pack_documents(docs_of(spark, []), path, ranks).collect() == []


def test_shortest_pack_first():
    """The same packs as placing every length by itself, longest first, into the pack with the most room left."""
    rng = random.Random(9)
    assert packing.shortest_pack_first({}, 8) == []
    for capacity in (16, 128, 1024):
        histogram = {n: rng.randint(1, 60) for n in rng.sample(range(1, capacity + 1), capacity // 2)}
        patterns = packing.shortest_pack_first(dict(histogram), capacity)
        placed = {}
        for count, lengths in patterns:
            assert sum(lengths) <= capacity
            for n in lengths:
                placed[n] = placed.get(n, 0) + count
        assert placed == histogram
        room = []
        for n in sorted(histogram, reverse=True):
            for _ in range(histogram[n]):
                most = max(room, default=0)
                if most >= n:
                    room.remove(most)
                    room.append(most - n)
                else:
                    room.append(capacity - n)
        assert sorted(room) == sorted(capacity - sum(lengths) for count, lengths in patterns for _ in range(count))


def test_packing_joined_slots(spark):
    """Slots that are joined by blocks of ranks give a packing as good as slots that are broadcast."""
    docs = docs_of(spark, ["word " * (k % 7) for k in range(300)])
    one, two = (packing.pack_documents(docs, *packing.default_tokenizer(), capacity=16, broadcast_slots=n).collect() for n in (0, 10**6))
    assert sorted(one) == sorted(two) and len(one) == 300


def test_token_ids_of_random_texts():
    """The cut at spaces and the rank file give the tokenizer's ids for any text."""
    from tokenizers import Tokenizer

    path, ranks = packing.default_tokenizer()
    ours, theirs = packing.TokenBytes(path, ranks), Tokenizer.from_file(path)
    rng = random.Random(12)
    alphabets = ["ab cd e", "aZ09 .,'!", "don't we'll I'm ", " \n\t\r x", "éàü ßœ Ÿ€", "a1² ½ ٣ 東京", "<|endoftext|> ", "\u00a0\u2003\u200b \x1c\x85a", "_-#@ a_b", "🙂 e\u0301 a"]
    for _ in range(20_000):
        text = "".join(rng.choices("".join(rng.sample(alphabets, rng.randint(1, 3))), k=rng.randint(0, 24)))
        assert ours(text) == np.array(theirs.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_top_k_prunes_and_ties(spark):
    rng = np.random.default_rng(0)
    centres = rng.integers(-40, 40, (12, 16))
    points = np.concatenate([centres[i % 12] * 4 + rng.integers(-2, 3, (250, 16)) for i in range(12)] + [np.tile(centres[0], (300, 1))])
    ids = rng.permutation(len(points))
    frame = spark.createDataFrame([(int(i), p.tolist()) for i, p in zip(ids, points, strict=True)], "vec_id long, v array<long>")
    got = topk_search.top_k(frame, frame.where("vec_id % 20 = 0"), 20, block_rows=1000, query_rows=60).collect()
    by_id = np.empty_like(points)
    by_id[ids] = points
    scores = by_id @ by_id.T
    for q in range(0, len(points), 20):
        order = sorted((i for i in range(len(points)) if i != q), key=lambda i: (-scores[q, i], i))[:20]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [(i, scores[q, i]) for i in order]
    shifted = frame.select("vec_id", F.transform("v", lambda x: x * 1_000_000).alias("v"))  # scores beyond 2^53
    far = {(r.query_id, r["rank"]): (r.vec_id, r.score // 1_000_000**2) for r in topk_search.top_k(shifted, shifted.where("vec_id % 20 = 0"), 20, 1000, 60).collect()}
    assert max(abs(int(scores.max()) * 1_000_000**2), 0) > 2**53 and far == {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got}
    with pytest.raises(ValueError):
        topk_search.top_k(shifted.select("vec_id", F.transform("v", lambda x: x * 100).alias("v")), frame)
    search = topk_search._Search(by_id[::20].astype(float), np.arange(0, len(points), 20), by_id.astype(float), np.arange(len(points)), 20)
    search.run(topk_search.cover_tree(search.queries, np.arange(len(search.queries)), 16), topk_search.cover_tree(search.points, np.arange(len(points)), 64))
    assert search.pruned > 0


def test_cover_tree_invariants():
    rng = np.random.default_rng(6)
    for scale, n in ((1, 40), (8, 700), (300, 1500)):
        points = np.concatenate([rng.normal(size=(n, 3)) * scale, rng.normal(size=(n // 4, 3)) * 0.1, np.ones((20, 3))]).round(2)
        root = topk_search.cover_tree(points, np.arange(len(points)), 10)
        todo, seen = [root], 0
        while todo:
            node = todo.pop()
            away = np.sqrt(((points[node.rows] - node.point) ** 2).sum(axis=1))
            assert away.max() == pytest.approx(node.radius, abs=1e-4) and node.radius <= 2.0**node.level
            if node.children:
                heads = np.array([c.point for c in node.children])
                gaps = np.sqrt(((heads[:, None] - heads[None]) ** 2).sum(axis=2)) + np.eye(len(heads)) * 1e9
                assert gaps.min() > 2.0 ** (node.level - 1) and (heads[0] == node.point).all()
                assert all(c.radius <= 2.0 ** (node.level - 1) and c.level < node.level for c in node.children)
                assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
                todo += node.children
            else:
                seen += len(node.rows)
        assert seen == len(points) and root.children


def test_top_k_repeated_query(spark):
    frame = spark.createDataFrame([(0, [3, 1]), (0, [1, 3]), (1, [1, 0]), (2, [0, 1])], "vec_id long, v array<long>")
    got = topk_search.top_k(frame, frame.where("vec_id = 0"), 1).collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 3)]  # [1, 3] is the least


def test_top_k_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, None, 1), (2, [nan, 1.0], 1), (3, [inf, 0.0], 1), (4, [None, 1.0], 1), (5, [-0.01, 0.999], 1), (5, [-0.01, 0.999], 2), (None, [1.0, 1.0], 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    vectors = topk_search.whole_vectors(frame)
    assert sorted((r.vec_id, r.v) for r in vectors.collect()) == [(0, [64, 32]), (5, [-1, 63]), (5, [-1, 63])]
    assert [tuple(r) for r in topk_search.top_k(vectors, vectors.where("vec_id % 20 = 0")).orderBy("rank").collect()] == [(0, 1, 5, 1952), (0, 2, 5, 1952)]
    assert topk_search.top_k(vectors.limit(0), vectors.limit(0)).collect() == []
