"""Shortest-pack-first packing over the length histogram.

Every document is tokenized once; its ids are cut into pieces of at most `capacity`. Only the histogram of piece
lengths (at most `capacity` bins) reaches the driver, which places lengths longest first into the shortest open packing
pattern (the one with the most room left), updating the patterns' counts. The patterns then become ranges of ranks within
a length, and each piece finds its sequence by its own rank.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import give_back, materialize, number_rows, table

CAPACITY = 1024
CACHE_WORDS = 60_000
#: Slots of packing patterns go to every task up to this number (40 bytes each); beyond it they are joined by blocks of
#: 2^RANK_BLOCK ranks. There are a few thousand for each power of ten of the input, since lengths are at most `capacity`.
BROADCAST_SLOTS, RANK_BLOCK = 200_000, 12
#: Characters for which Python's word classes and the tokenizer's letter and number classes agree.
_PLAIN = re.compile(r"[\t\n\r -~¡-©«-±´¶-¸»¿-ſ‘-„…]*")
#: The byte-level pre-tokenizer's own pattern, written for such characters.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


#: In a text with one of these a space may not stand alone between two other characters: it is not cut at spaces.
_ODD_SPACE = ("  ", "\n ", " \n", "\t", "\r")


class TokenBytes:
    """Texts to ids as little-endian unsigned 32-bit integers.

    A space between two other characters always begins a piece of the tokenizer's own pre-tokenization, so plain texts
    are cut there and each distinct word is merged once, from the same vocabulary's rank file; any other text (unusual
    characters, odd spacing, special tokens) goes to the tokenizer whole. Both give the tokenizer's ids.
    """

    def __init__(self, path: str, ranks_path: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.merge = tiktoken.Encoding("ranks", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.cache: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _pieces(self, text: str) -> bytes:
        return array("I", [i for piece in _PIECES.findall(text) for i in self.merge(piece.encode())]).tobytes()

    def _word(self, word: str) -> bytes:
        """A word and the space before it."""
        if word.isalpha():
            return array("I", self.merge(b" " + word.encode())).tobytes()
        if word[-1] in ".,;:" and word[:-1].isalpha():
            return array("I", self.merge(b" " + word[:-1].encode()) + self.merge(word[-1:].encode())).tobytes()
        return self._pieces(" " + word)

    def __call__(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self._whole(text)
        if text[:1] == " " or text[-1:] == " " or any(s in text for s in _ODD_SPACE):
            return self._pieces(text)
        first, *rest = text.split(" ")
        cache = self.cache
        try:
            return self._pieces(first) + b"".join(map(cache.__getitem__, rest))
        except KeyError:
            if len(cache) > CACHE_WORDS:
                cache.clear()
            for word in rest:
                if word not in cache:
                    cache[word] = self._word(word)
            return self._pieces(first) + b"".join(map(cache.__getitem__, rest))


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of each packing pattern: longest lengths first, each into the shortest open pattern; a new one is
    opened where even that has too little room. histogram: {length: count}, lengths from 1 to capacity; an empty one gives
    no pattern. The same as placing single items, since equal packs are filled one after another."""
    room: list[int] = []  # of open patterns, ascending
    patterns: dict[int, list[list]] = {}

    def put(count: int, lengths: tuple[int, ...], free: int) -> None:
        if free not in patterns:
            patterns[free] = []
            insort(room, free)
        patterns[free].append([count, lengths])

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo:
            if not room or room[-1] < length:  # new packs, each filled before the next, for none has more room
                each = capacity // length
                if todo >= each:
                    put(todo // each, (length,) * each, capacity - each * length)
                if todo % each:
                    put(1, (length,) * (todo % each), capacity - todo % each * length)
                break
            free = room[-1]
            last = patterns[free][-1]
            count, lengths = last
            placed = min(todo, count)
            if placed == count:
                patterns[free].pop()
                if not patterns[free]:
                    del patterns[free]
                    room.pop()
            else:
                last[0] -= placed
            put(placed, (*lengths, length), free - length)
            todo -= placed
    return [(count, lengths) for free in sorted(patterns) for count, lengths in patterns[free]]


def _slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset) of each slot of each pattern."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            first = used.get(length, 0)
            rows.append((length, first, first + count, sequence, offset))
            used[length] = first + count
            offset += length
        sequence += count
    return rows


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str, capacity: int = CAPACITY, broadcast_slots: int = BROADCAST_SLOTS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece.

    Null text counts as empty; every document ends with id 0, so an empty one is one piece of one id. Rows that repeat
    are packed as often as they occur. Other columns are ignored; an empty table gives no rows.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = TokenBytes(tokenizer, ranks)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                data = encode(text or "") + b"\0\0\0\0"
                total = len(data) // 4
                rows += [(doc_id, s, min(capacity, total - s), zlib.crc32(data[4 * s : 4 * (s + capacity)]), total) for s in range(0, total, capacity)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        del encode
        give_back()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = materialize(slim.mapInPandas(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    slots = _slots(shortest_pack_first(histogram, capacity))
    spark = docs.sparkSession
    ranges = spark.createDataFrame(slots, "length long, first long, after long, base long, offset long")
    ranked = number_rows(cut, "length", ["doc_id", "start", "ids_crc32"], "rank", sum(histogram.values()))
    keys = ["length"]
    if len(slots) <= broadcast_slots:
        ranges = F.broadcast(ranges)
    else:  # a length may hold a third of all pieces, so blocks of its ranks meet the ranges that touch them
        block = lambda c: F.shiftright(c, RANK_BLOCK)
        ranges = ranges.withColumn("block", F.explode(F.sequence(block("first"), block(F.col("after") - 1))))
        ranked, keys = ranked.withColumn("block", block("rank")), ["length", "block"]
    return (
        ranked.join(ranges, keys).where("rank >= first AND rank < after")
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                (F.col("base") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
    )


def default_tokenizer() -> tuple[str, str]:
    """The tokenizer's file and the rank file of the same vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), *default_tokenizer())


QUERIES = {"op9_packing": op9_packing}
ORACLE_SQL: dict[str, str] = {}
