"""Hashes of words: no collisions by form, the same in any company and at any length."""

import random

import numpy as np
import pyarrow as pa

from newsloom.llm import jaccard_join, words


def hashes(texts):
    return np.concatenate([h for *_, h, _ in words.word_hashes(pa.array(texts))])


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_thue_morse_words_differ(spark):
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    assert len(set(hashes([word, other]).tolist())) == 2
    docs = spark.createDataFrame([(1, " ".join([word] * 9)), (2, " ".join([other] * 9))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()} == {1: 1, 2: 2}


def test_distinct_words_have_distinct_hashes():
    rng = random.Random(1)
    some = {"".join(rng.choices("abcdefgh", k=rng.randint(1, 40))) for _ in range(30_000)}
    some |= {"a" * n for n in range(1, 300)} | {"a" * 8 + "b" * n for n in range(1, 30)} | {"b" * n + "a" * 8 for n in range(1, 30)} | {"\0" * n for n in range(1, 30)}
    assert len(set(hashes([" ".join(some)]).tolist())) == len(some)


def test_a_word_is_the_same_anywhere():
    rng = random.Random(2)
    vocabulary = ["x", "Abc", "eight888", "nine99999", "é" * 9, "w" * 100]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(50)] + [None, "", " ", "last"]
    own = [hashes([t]).tolist() if t and t.strip() else [] for t in texts]
    assert hashes(texts).tolist() == [h for x in own for h in x]
    assert hashes(["Abc"]).tolist() == hashes(["aBC"]).tolist() == hashes(["\tabc\n"]).tolist()


def test_long_texts_in_slices(monkeypatch):
    text = " ".join(f"w{i % 5000}" for i in range(200_000))
    whole = hashes([text])
    monkeypatch.setattr(words, "SLICE_WORDS", 777)
    assert (hashes([text]) == whole).all() and len(np.unique(whole)) == 5000
