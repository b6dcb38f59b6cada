"""Words written apart or with doubled letters."""

import pytest

from newsloom.llm import toxicity

WEIGHTS = {"idiot": 9.0, "idio-": 9.0, "stupid": 8.0, "loser": 7.0}


@pytest.fixture(scope="module")
def lexicon(spark):
    docs = spark.createDataFrame([("you are an idiot and the stupid loser said that the clown is a nice one in the tall hall",)] * 20, "text string")
    return toxicity.Lexicon(toxicity.Channel(toxicity.trigram_counts(docs)), WEIGHTS)


@pytest.mark.parametrize(
    "text, found",
    [
        ("y o u a r e a n i d i o t", {9.0}), ("s t u p i d i d i o t", {9.0, 8.0}), ("y o u a r e a n 1 d i 0 t s a i d t h e c l o w n", {9.0}), ("t h e i d i o t s s a i d", {9.0}),
        (" ".join("thecl0wnsaidthatheisnice" * 4 + "stupid" + "thetallhallisnice" * 4), {8.0}), ("a " * 500 + "i d i o t", {9.0}),
        ("iiddiioott", {9.0}), ("the stuupid one", {8.0}), ("looser", {7.0}), ("s" * 80 + "tupid", {8.0}),
        ("t h e t a l l h a l l i s n i c e", set()), ("the tall hall", set()), ("a " * 500, set()),
    ],
)
def test_runs_and_doubles(lexicon, text, found):
    assert {x for x in lexicon.features(text)[:3] if x} == found


def test_segments(lexicon):
    assert lexicon.channel.segment("theclownisanidiot") == ["the", "clown", "is", "an", "idiot"]
    assert lexicon.channel.segment("") == [] and lexicon.channel.segment("...") == []
