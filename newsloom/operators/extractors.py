"""Names in running text: people, popes, brands and models, found by classes of words and windows over them.

The words of a text that begin with a capital or a digit have a class (full word, initial, acronym, ...) and know whether only
white space lies between them and the word before. The extractors then grow windows of such neighbours. Per text this is a small loop
over its words, so it runs in Arrow batches; what follows (counts, filters, joins) is Spark's.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from newsloom.sources.store import bound_batches, slices

# The letters of names, acronyms that name nobody, products written in lower case.
LOWER = "abcdefghijklmnopqrstuvwxyzàèéìòù"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÈÉÌÒÙ"
NO_ACRONYMS = (
    "DI", "DEL", "DEI", "DELLA", "DELLE", "DA", "DAL", "DAI", "DALLE", "AL", "ALLA", "ALLE", "AI", "SU", "SUL", "SUI", "SULLA",
    "SULLE", "NEL", "NEI", "NELLA", "NELLE", "PER", "CON", "TRA", "FRA", "IL", "LO", "LA", "LE", "I", "GLI", "UN", "UNO", "UNA",
    "ED", "OD", "MA", "SE", "CHE", "CHI", "CUI", "NON", "GENNAIO", "FEBBRAIO", "MARZO", "APRILE", "MAGGIO", "GIUGNO", "LUGLIO",
    "AGOSTO", "SETTEMBRE", "OTTOBRE", "NOVEMBRE", "DICEMBRE", "LUNEDI", "MARTEDI", "MERCOLEDI", "GIOVEDI", "VENERDI", "SABATO", "DOMENICA",
)
PRODUCTS = ("iPhone", "iPad", "iMac", "iPod", "iCloud", "iOS", "iPadOS", "iQOO", "iQoo", "reMarkable")

FOUND = "array<struct<surface: string, kind: string>>"
#: Words that begin with a capital or a digit: no rule looks at others.
_WORDS = re.compile(rf"(?<!\w)[{UPPER}0-9]\w*")
_CAPITAL, _ACRONYM = re.compile(f"[{UPPER}][{LOWER}]*"), re.compile(f"[{UPPER}]{{2,5}}")
_CHUNKS = re.compile(r"[\w-]+")


@dataclass(slots=True)
class Word:
    text: str
    start: int
    end: int
    near: bool  #: only white space between it and the word before
    initial: bool = False

    def capital(self, least: int) -> bool:
        """A capital and then small letters only, `least` letters or more."""
        return len(self.text) >= least and _CAPITAL.fullmatch(self.text) is not None

    def acronym(self) -> bool:
        return _ACRONYM.fullmatch(self.text) is not None


@lru_cache(maxsize=1)
def words_of(text: str) -> list[Word]:
    """The words that begin with a capital or a digit, in order; the full stop of an initial belongs to it. Kept for the next rule
    that reads the same text."""
    out: list[Word] = []
    last = 0
    for m in _WORDS.finditer(text):
        w = Word(m[0], m.start(), m.end(), bool(out) and text[last : m.start()].isspace())
        if len(w.text) == 1 and w.text in UPPER and text[w.end : w.end + 1] == ".":
            w.initial, w.end = True, w.end + 1
        out.append(w)
        last = w.end
    return out


def _run(words: list[Word], first: int, most: int, fits) -> int:
    """How many words from `first` on are neighbours that fit, `most` at most."""
    n = 0
    while n < most and first + n < len(words) and (n == 0 or words[first + n].near) and fits(words[first + n]):
        n += 1
    return n


def trim(parts: list[str], common: frozenset[str]) -> list[str]:
    """Without the words at both ends that are in `common`."""
    a, b = 0, len(parts)
    while a < b and parts[a] in common:
        a += 1
    while b > a and parts[b - 1] in common:
        b -= 1
    return parts[a:b]


def persons(text: str, common: frozenset[str]) -> list[str]:
    """Two to four neighbours: a full word or acronym, then these or initials, a full word last."""
    words, found, at = words_of(text), [], 0
    full = lambda w: not w.initial and w.capital(4)
    while at < len(words):
        size = 0
        if full(words[at]) or words[at].acronym():
            size = _run(words, at, 4, lambda w: full(w) or w.initial or w.acronym())
            while size > 1 and not full(words[at + size - 1]):
                size -= 1
        if size < 2:
            at += 1
            continue
        own = words[at : at + size]
        at += size
        if any(w.acronym() and w.text in NO_ACRONYMS or w.initial and w.text in NO_ACRONYMS for w in own):
            continue
        kept = trim([w.text + "." * w.initial for w in own], common)
        if len(kept) >= 2 and not kept[0].endswith(".") and Word(kept[-1], 0, 0, False).capital(4):
            found.append(" ".join(kept))
    return found


def roman(n: int) -> str:
    """A number below 40 in roman numerals."""
    tens, ones = divmod(n, 10)
    fives, rest = divmod(ones, 5)
    return "X" * tens + ("I" + "VX"[fives] if rest == 4 else "V" * fives + "I" * rest)


NUMERALS = frozenset(map(roman, range(1, 40)))


def popes(text: str) -> list[str]:
    """The word Papa, one to three names of three letters or more, and a numeral."""
    words, found = words_of(text), []
    for i, w in enumerate(words):
        if w.text == "Papa" and i + 1 < len(words) and words[i + 1].near:
            n = _run(words, i + 1, 3, lambda x: x.capital(3))
            if n:
                after = i + 1 + n
                n += after < len(words) and words[after].near and words[after].text in NUMERALS
                found.append(" ".join(x.text for x in words[i : i + 1 + n]))
    return found


def _mixed(t: str) -> bool:
    """Digits before or after capitals: 7Up, O2, K2."""
    digits = "0123456789"
    head = t.lstrip(digits)
    if head != t:
        return bool(head) and head[0] in UPPER and all(c in LOWER for c in head[1:])
    tail = t.rstrip(digits)
    return tail not in ("", t) and tail[0] in UPPER and (all(c in LOWER for c in tail[1:]) or all(c in UPPER for c in tail))


def alphanumeric_brands(text: str) -> list[str]:
    return [w.text for w in words_of(text) if (_mixed(w.text) or w.acronym()) and w.text.upper() not in NO_ACRONYMS]


def single_brands(text: str, common: frozenset[str]) -> list[str]:
    """Full words in the middle of a sentence: after a small letter or one of , ; : and a space."""
    inside = lambda s: s > 1 and text[s - 1] == " " and (text[s - 2] in LOWER or text[s - 2] in ",;:")
    return [w.text for w in words_of(text) if w.capital(4) and inside(w.start) and w.text not in common]


def _model_part(t: str) -> bool:
    if t in PRODUCTS or t.isdecimal() and len(t) <= 4:
        return True
    if t[0] in UPPER:
        pieces = t.split("-")
        if len(pieces) <= 2 and all(p and p[0] in UPPER and all(c in LOWER for c in p[1:]) for p in pieces):
            return len(pieces[-1]) > 1
        return any(c.isdecimal() for c in t)
    rest = t.lstrip("0123456789")
    return rest not in ("", t) and rest[0] in UPPER


def models(text: str, brands: tuple[str, ...], common: frozenset[str]) -> list[str]:
    """A known brand in any case, the longest that fits, and one to four neighbours that can be parts of a product's name."""
    low, found, at = text.lower(), [], 0
    chunks = [(m[0], m.start(), m.end()) for m in _CHUNKS.finditer(text)]
    starts = {s: i for i, (_, s, _) in enumerate(chunks)}
    by_length = sorted({b.strip().lower() for b in brands if b.strip()}, key=lambda b: (-len(b), b))
    for i, (_, start, _) in enumerate(chunks):
        if start < at:
            continue
        for brand in by_length:
            end = start + len(brand)
            if not low.startswith(brand, start) or not text[end : end + 1].isspace():
                continue
            after = end + len(text[end:]) - len(text[end:].lstrip())
            parts, k = [], starts.get(after, len(chunks))
            while k < len(chunks) and len(parts) < 4 and _model_part(chunks[k][0]) and (not parts or text[chunks[k - 1][2] : chunks[k][1]].isspace()):
                parts.append(chunks[k][0])
                k += 1
            if parts:
                kept = trim(text[start:end].split() + parts, common)
                if len(kept) >= 2:
                    found.append(" ".join(kept))
                at = chunks[k - 1][2]
                break
    return found


def _column(text: Column, find) -> Column:
    """array<string> of what `find` gives for each text, each surface once."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(dict.fromkeys(find(t))) if t else [])

    return run(text)


def extract_persons(text: Column, common: tuple[str, ...] = ()) -> Column:
    """People; `common` are words that titles capitalise (adverbs, verbs), cut off both ends. Null text: none."""
    kept = frozenset(common)
    return _column(text, lambda t: persons(t, kept))


def extract_popes(text: Column) -> Column:
    return _column(text, popes)


def extract_alphanumeric_brands(text: Column) -> Column:
    return _column(text, alphanumeric_brands)


def extract_single_brands(text: Column, common: tuple[str, ...] = ()) -> Column:
    kept = frozenset(common)
    return _column(text, lambda t: single_brands(t, kept))


def extract_models(text: Column, brands: tuple[str, ...], common: tuple[str, ...] = ()) -> Column:
    kept, names = frozenset(common), tuple(brands)
    return _column(text, lambda t: models(t, names, kept))


def extract_all(text: Column, brands: tuple[str, ...] = (), common: tuple[str, ...] = ()) -> Column:
    """array<struct<surface, kind>> of all extractors, each surface once for its kind. Null text: empty."""
    kept, names = frozenset(common), tuple(brands)

    @F.pandas_udf(FOUND)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"surface": s, "kind": kind} for s, kind in all_names(t, names, kept)])

    return run(text)


def all_names(text: str | None, brands: tuple[str, ...], common: frozenset[str]) -> list[tuple[str, str]]:
    """(surface, kind) of all rules, each surface once for its kind."""
    if not text:
        return []
    each = (("person", persons(text, common)), ("pope", popes(text)), ("brand_alpha", alphanumeric_brands(text)), ("brand_single", single_brands(text, common)),
            ("model", models(text, brands, common) if brands else []))
    return [(s, kind) for kind, found in each for s in dict.fromkeys(found)]


def found_names(texts: DataFrame, keys: tuple[str, ...], schema: str, start: Callable[[], Callable[[dict], list[tuple]]]) -> DataFrame:
    """What the function that `start` makes for each task gives for a row of texts: rows of the schema, after the row's keys. One pass in Python, a few texts at
    a time, so that a worker holds the names of a few texts only."""
    bound_batches(texts.sparkSession)
    own = StructType.fromDDL(schema)
    kinds = list(to_arrow_schema(own).types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = start()
        for part, rows in slices(batches):
            at, found = [], []
            for i, row in enumerate(rows):
                names = find(row)
                at += [i] * len(names)
                found += names
            at = pa.array(at, pa.int32())
            columns = zip(*found, strict=True) if found else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [*[part.column(k).take(at) for k in keys], *[pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]], [*keys, *own.names])

    return texts.mapInArrow(run, StructType([*[texts.schema[k] for k in keys], *own.fields]))
