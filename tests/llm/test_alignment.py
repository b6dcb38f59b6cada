"""Groups and links of two tokenizers against both run over whole texts, byte by byte."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from newsloom.llm import alignment
from newsloom.llm.common import table
from tests.conftest import SF

ODD = ["", None, " ", "  two  spaces ", "a", "tab\there", "line\nbreak\n\nmore", " lead", "trail ", "<s>hi</s> <|endoftext|> x", "▁odd ▁", "naïve café … ﬁn", "日本語 と emoji 🙂🙂",
       "null\0byte", "aaaa" * 300, "the the the the", "it's don't 1234 5,000.50", " nbsp  em", "<unk> <0x41>", "é combining"]


def whole(texts):
    """Of each text n_a, n_b, n_groups, n_links, n_best, count_sum, digest, with tokenizers run over all of it."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    level = {c: x for c, x in alignment.byte_level_bytes().items()}

    def of(text):
        if not text:
            return None
        told = (" " + text).encode()
        ids = {"a": a.encode(" " + text, add_special_tokens=False).ids, "b": b.encode(text)}
        raw = {"a": [bytes(level[c] for c in a.id_to_token(i)) for i in ids["a"]],
               "b": [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids["b"]]}
        if any(b"".join(r) != told for r in raw.values()):
            return None
        ends = {}
        for side in raw:
            at, ends[side] = 0, {}
            for i, t in zip(ids[side], raw[side], strict=True):
                at += len(t)
                ends[side][at] = i
        groups, own, pairs = [], {"a": [], "b": []}, []
        for at in range(1, len(told) + 1):
            for side in ("a", "b"):
                if at in ends[side]:
                    own[side].append(str(ends[side][at]))
            if at in ends["a"] and at in ends["b"]:
                pairs.append((ends["a"][at], ends["b"][at]))
                groups.append(",".join(own["a"]) + "|" + ",".join(own["b"]))
                own = {"a": [], "b": []}
        return len(ids["a"]), len(ids["b"]), groups, pairs

    found = [of(t) for t in texts]
    count, best = Counter(p for f in found if f for p in f[3]), defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(0,) * 6 + ("",) if f is None else
            (f[0], f[1], len(f[2]), len(f[3]), sum(count[p] == best[p[1]] for p in f[3]), sum(count[p] for p in f[3]),
             hashlib.sha256(";".join(f[2]).encode()).hexdigest()) for f in found]


@pytest.mark.parametrize("most", [alignment.BROADCAST_GROUPS, 40])
def test_against_whole_texts(spark, most):
    texts = [r.text for r in table(spark, SF, "documents").select("text").limit(60).collect()] + ODD + ["same text twice"] * 2
    docs = spark.createDataFrame([(i, t, 5, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, row int, grp string, n int")
    found, links = alignment.align(docs, *alignment.default_tokenizers(), broadcast_groups=most)
    rows = sorted(found.collect())
    assert [tuple(r[1:]) for r in rows] == whole(texts)
    assert links.agg({"count": "sum"}).first()[0] == sum(r["n_links"] for r in rows)


def test_empty_table(spark):
    found, links = alignment.align(spark.createDataFrame([], "doc_id long, text string"), *alignment.default_tokenizers())
    assert found.count() == links.count() == 0


def test_words_give_the_ids_of_whole_texts():
    aligner = alignment.Aligner(*alignment.default_tokenizers())
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "e", "th", "ing", " ", " ", "\n", ".", ",", "'s", "7", "é", "ß", "-", "_", "<", "„"]) for _ in range(rng.randint(1, 40)))
        by_word, whole = aligner([text])[0], aligner._whole(text)
        assert by_word[:3] == whole[:3] and dict(zip(*by_word[3:], strict=True)) == dict(zip(*whole[3:], strict=True))
