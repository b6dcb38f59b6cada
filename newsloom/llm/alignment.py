"""Alignment of two tokenizers' ids over a corpus, by a dictionary of token groups.

A text is cut where tokens of both tokenizers end at one byte. Such a group, its A ids and its B ids, is written
`a1,a2|b1`; inside it only the last A token and the last B token end together, so each group holds one link. The distinct
groups of the corpus are interned with their frequencies, each one's link is expanded once and weighted by the frequency,
and what the corpus says of a link is joined back to the documents by the group.

Word by word where that gives the tokenizers' own ids: A begins a piece at every single space between two other characters
(see packing.TokenBytes), and no piece of B has a space after another character, so B merges nothing across it. Texts with
other spacing or characters go to both tokenizers whole.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import packing
from newsloom.llm.common import give_back, materialize, most_frequent, small, table

#: Words whose groups a task keeps; where it has more, it begins anew.
CACHE_WORDS = 250_000
#: The most frequent groups go to every task, so many at most and only such as take no more bytes than this; the other
#: groups are joined by a shuffle.
BROADCAST_GROUPS, BROADCAST_BYTES = 400_000, 64
SPACE = "▁"
PARTS = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups array<string>, counts array<long>"


#: A text's tokens of A, of B, digest, groups and their occurrences.
Told = tuple[int, int, str, list[str], list[int]]
NONE: Told = (0, 0, "", [], [])


def _runs(texts: list[str | None], size: int = 1 << 19) -> Iterator[list[str | None]]:
    """Texts in runs of about `size` characters; a longer one is a run of its own."""
    first = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t or "") > size:
            yield texts[first:i]
            first, held = i, 0
        held += len(t or "")
    yield texts[first:]


def byte_level_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(0x100 + n): b for n, b in enumerate(sorted(set(range(256)) - set(own)))}


class Words:
    """What is known of words, by a number each: tokens of A and of B (-1: the tokens' bytes are not the word's), the groups
    by their numbers, one word after another, and the groups as text."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.told: list[str] = []
        self.groups: dict[str, int] = {}
        self.names: list[str] = []
        self.n_a = self.n_b = self.first = self.held = np.empty(0, np.int64)
        self.of = np.empty(0, np.int64)

    def number(self, group: str) -> int:
        n = self.groups.setdefault(group, len(self.names))
        if n == len(self.names):
            self.names.append(group)
        return n

    def add(self, words: list[str], n_a: np.ndarray, n_b: np.ndarray, held: np.ndarray, groups: np.ndarray) -> None:
        """held: how many of groups each word has."""
        ends = held.cumsum()
        names = list(map(self.names.__getitem__, groups.tolist()))
        self.told += [";".join(names[i:j]) for i, j in zip((ends - held).tolist(), ends.tolist(), strict=True)]
        self.numbers.update(zip(words, range(len(self.numbers), len(self.numbers) + len(words)), strict=True))
        more = (n_a, n_b, len(self.of) + ends - held, held, groups)
        self.n_a, self.n_b, self.first, self.held, self.of = (np.concatenate(x) for x in zip((self.n_a, self.n_b, self.first, self.held, self.of), more, strict=True))


class Aligner:
    """The groups of texts. a: JSON file of a byte-level tokenizer; ranks: the same vocabulary as ranks; b: piece model."""

    def __init__(self, a: str, ranks: str, b: str):
        import sentencepiece

        pieces_of_a = packing.TokenBytes(a, ranks)
        self.a, self.merge, self.b = pieces_of_a.tokenizer, pieces_of_a.merge, sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        as_byte, size = byte_level_bytes(), self.a.get_vocab_size(with_added_tokens=True)
        special = {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        self.a_bytes = [t.encode() if i in special else bytes(as_byte[c] for c in t) for i, t in enumerate(map(self.a.id_to_token, range(size)))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x]) for x in (self.a_bytes, self.b_bytes))
        self.by_word = all(SPACE not in p.lstrip(SPACE) for p in pieces)
        self.words = Words()

    def _cut(self, into: Words, texts: list[str], a: list[list[int]], b: list[list[int]]) -> None:
        """Add texts by their ids. They are cut as one long text, for tokens of both end where each of them ends."""
        told = [(" " + t).encode() for t in texts]
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        n_a, n_b = (np.array([len(x) for x in y]) for y in (a, b))
        ends, ends_a, ends_b = np.cumsum([len(t) for t in told]), self.a_sizes[flat_a].cumsum(), self.b_sizes[flat_b].cumsum()
        same = b"".join(map(self.a_bytes.__getitem__, flat_a.tolist())) == b"".join(map(self.b_bytes.__getitem__, flat_b.tolist())) == b"".join(told)
        if not same or (ends_a[n_a.cumsum() - 1] != ends).any() or (ends_b[n_b.cumsum() - 1] != ends).any():
            if len(texts) == 1:
                into.add(texts, *(np.array([x]) for x in (-1, -1, 0)), np.empty(0, np.int64))
            for x in zip(texts, a, b, strict=True) if len(texts) > 1 else ():
                self._cut(into, *([y] for y in x))
            return
        at_b = np.searchsorted(ends_b, ends_a)
        common = ends_b[np.minimum(at_b, len(ends_b) - 1)] == ends_a
        last_a = common.nonzero()[0]
        last_b = at_b[last_a]
        first_a, first_b = np.append(0, last_a[:-1] + 1), np.append(0, last_b[:-1] + 1)
        groups = np.empty(len(last_a), np.int64)
        # most groups are one token each, and few pairs make most of these
        single = (first_a == last_a) & (first_b == last_b)
        pairs, where = np.unique(flat_a[last_a[single]] << 32 | flat_b[last_b[single]], return_inverse=True)
        groups[single] = np.array([into.number(f"{x >> 32}|{x & 0xFFFFFFFF}") for x in pairs.tolist()], np.int64)[where]
        names_a, names_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        rest = (x[~single].tolist() for x in (first_a, last_a + 1, first_b, last_b + 1))
        groups[~single] = [into.number(",".join(names_a[i:j]) + "|" + ",".join(names_b[k:m])) for i, j, k, m in zip(*rest, strict=True)]
        upto = np.searchsorted(ends_a[last_a], ends) + 1
        into.add(texts, n_a, n_b, np.diff(upto, prepend=0), groups)

    def _ids(self, word: str) -> list[int]:
        """A's ids of a plain word and the space before it."""
        merge = self.merge
        if word.isalpha():
            return merge(f" {word}".encode())
        if word[-1] in ".,;:" and word[:-1].isalpha():
            return merge(f" {word[:-1]}".encode()) + merge(word[-1:].encode())
        return [i for piece in packing._PIECES.findall(" " + word) for i in merge(piece.encode())]

    def _told(self, of: Words, numbers: list[int], sizes: list[int]) -> list[Told]:
        """Of texts by the numbers of their words, `sizes` words each."""
        at = np.array(numbers)
        ends = np.cumsum(sizes)
        text = np.repeat(np.arange(len(sizes)), sizes)
        good = np.minimum.reduceat(of.n_b[at], ends - sizes) >= 0
        n_a, n_b = (np.add.reduceat(x[at], ends - sizes).tolist() for x in (of.n_a, of.n_b))
        held = of.held[at]
        place = np.repeat(of.first[at] - (held.cumsum() - held), held) + np.arange(held.sum())
        keys, counts = np.unique(np.repeat(text, held) * len(of.names) + of.of[place], return_counts=True)
        upto = np.searchsorted(keys, np.arange(1, len(sizes) + 1) * len(of.names)).tolist()
        names, counts = list(map(of.names.__getitem__, (keys % max(1, len(of.names))).tolist())), counts.tolist()
        out, first, begin = [], 0, 0
        for i, (end, last) in enumerate(zip(ends.tolist(), upto, strict=True)):
            if good[i]:
                digest = hashlib.sha256()
                for k in range(begin, end, 10_000):
                    digest.update((";" if k > begin else "").encode() + ";".join([of.told[n] for n in numbers[k : min(end, k + 10_000)]]).encode())
                out.append((n_a[i], n_b[i], digest.hexdigest(), names[first:last], counts[first:last]))
            else:
                out.append(NONE)
            first, begin = last, end
        return out

    def _whole(self, text: str) -> Told:
        own = Words()
        self._cut(own, [text], [self.a.encode(" " + text, add_special_tokens=False).ids], [self.b.encode(text)])
        return self._told(own, [0], [1])[0]

    def __call__(self, texts: list[str | None]) -> list[Told]:
        """Of every text: tokens of A, of B, digest of the groups, groups and occurrences of each."""
        out: list[Told] = [NONE] * len(texts)
        at, sizes, words = [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            plain = self.by_word and packing._PLAIN.fullmatch(text) and text[0] != " " and text[-1] != " "
            if not plain or any(x in text for x in packing._ODD_SPACE):
                out[i] = self._whole(text)
            else:
                own = text.split(" ")
                at.append(i)
                sizes.append(len(own))
                words += own
        if at:
            if len(self.words.numbers) > CACHE_WORDS:
                self.words = Words()
            numbers = list(map(self.words.numbers.get, words))
            missing = list({w for w, n in zip(words, numbers, strict=True) if n is None})
            if missing:
                self._cut(self.words, missing, list(map(self._ids, missing)), self.b.encode(missing, num_threads=1))
                numbers = list(map(self.words.numbers.__getitem__, words))
            for i, told in zip(at, self._told(self.words, numbers, sizes), strict=True):
                out[i] = told
        return out


def align(docs: DataFrame, a: str, ranks: str, b: str, broadcast_groups: int = BROADCAST_GROUPS) -> tuple[DataFrame, DataFrame]:
    """Of every document doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; and the corpus's links:
    a, b, count, best (whether no A id is linked more often with this B id).

    Texts null, empty, or whose tokens' bytes differ from a space and the text have no tokens: zeros and ''. Rows that
    repeat are documents each; a null doc_id stays null. An empty table gives no rows and no links; other columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner = Aligner(a, ranks, b)
        for batch in batches:
            found = [f for texts in _runs(batch.column(1).to_pylist()) for f in aligner(texts)]
            longs = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), longs([f[0] for f in found]), longs([f[1] for f in found]), longs([sum(f[4]) for f in found]),
                 pa.array([f[2] for f in found], pa.string()), pa.array([f[3] for f in found], pa.list_(pa.string())),
                 pa.array([f[4] for f in found], pa.list_(pa.int64()))],
                ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "counts"])
        del aligner
        give_back()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = materialize(slim.mapInArrow(cut, PARTS).withColumn("row", F.monotonically_increasing_id()))
    held = parts.select("row", F.inline(F.arrays_zip("groups", "counts")).alias("grp", "n"))
    last = lambda side: F.substring_index(F.substring_index("grp", "|", side), ",", -1).cast("int")
    interned = materialize(held.groupBy("grp").agg(F.sum("n").alias("freq")).select("grp", "freq", last(1).alias("a"), last(-1).alias("b")))
    links = interned.groupBy("a", "b").agg(F.sum("freq").alias("count"))
    most = links.groupBy("b").agg(F.max("count").alias("most"))  # no more rows than B has ids
    links = materialize(links.join(F.broadcast(most), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")))
    told = materialize(interned.join(small(links), ["a", "b"]).select("grp", "freq", "count", F.col("best").cast("long").alias("best")))
    short = told.where(F.octet_length("grp") <= BROADCAST_BYTES)
    top, every = most_frequent(short, "grp", "freq", broadcast_groups)
    met = held.join(F.broadcast(top.drop("freq")), "grp", "left")
    sums = lambda df: df.groupBy("row").agg(F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    if every and told.where(F.octet_length("grp") > BROADCAST_BYTES).isEmpty():
        found = sums(met)
    else:
        rare = met.where("count IS NULL").select("row", "grp", "n").join(told, "grp")
        both = sums(met.where("count IS NOT NULL")).unionByName(sums(rare))
        found = both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    found = parts.drop("groups", "counts").join(found, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
    return found, links


def default_tokenizers() -> tuple[str, str, str]:
    """A's file, the rank file of the same vocabulary, B's model."""
    import public_tokenizers

    return *packing.default_tokenizer(), public_tokenizers.path("piece_bpe_32k.model")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), *default_tokenizers())[0]


QUERIES = {"op13_token_alignment": op13_token_alignment}
ORACLE_SQL: dict[str, str] = {}
