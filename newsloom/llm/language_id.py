"""Hierarchical language identification: family first, then one-versus-one linear SVMs inside the family.

Features are relative frequencies of hashed byte bigrams and trigrams of the lower-cased text, a space at either end.
Linear support vector machines are trained for every pair of families and for every pair of languages of one family, on
a bounded sample of labelled documents: each pair is one group, so Spark fits the pairs side by side. Scoring needs no
feature vectors: a document's margin is the mean of the machine's weights over the document's n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import fold, give_back, materialize, table
from newsloom.llm.words import chunks, text_buffer

#: Language families; a language without an entry is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic",
}
BUCKETS = 4096
#: About so many documents of each language are learnt from.
SAMPLE = 600
UNKNOWN = "und"
#: So many n-grams of a typical text are added to a text when its fit is judged, since a short text says little.
PRIOR_GRAMS = 50
LETTER = r"\p{L}"


#: Documents whose feature vectors are made at once.
VECTORS = 256
#: Of the machines: weight of |w|^2 / 2 against the mean hinge loss, and passes over the sample at most.
PENALTY, PASSES = 0.01, 30


def _grams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, gram buckets, row of each): bigrams in the lower half, trigrams in the upper."""
    raw, at = text_buffer(pc.utf8_lower(column))
    half = BUCKETS // 2
    for a, b in chunks(at):
        sizes = at[a + 1 : b + 1] - at[a:b]
        line = np.full(int(sizes.sum()) + 2 * (b - a), 32, np.uint32)
        starts = np.concatenate(([0], np.cumsum(sizes + 2)))
        line[np.repeat(starts[:-1] + 1 - (at[a:b] - at[a]), sizes) + np.arange(at[b] - at[a])] = raw[at[a] : at[b]]
        owner = np.repeat(np.arange(b - a), sizes + 2)
        two = (line[:-1] << 8) | line[1:]
        three = (two[:-1] << 8) | line[2:]
        spread = lambda x: ((x * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(half)
        in_two, in_three = owner[:-1] == owner[1:], owner[:-2] == owner[2:]
        yield (a, b, np.concatenate([spread(two)[in_two], spread(three)[in_three] + np.uint32(half)]).astype(np.int32),
               np.concatenate([owner[:-1][in_two], owner[:-2][in_three]]))


def sample_features(docs: DataFrame, label: str) -> DataFrame:
    """label, at, share (n-gram buckets and their relative frequencies times BUCKETS, packed) of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part.slice(i, VECTORS) for part in batches for i in range(0, part.num_rows, VECTORS)):
            for a, b, grams, owner in _grams(batch.column(1)):
                key, n = np.unique(owner * BUCKETS + grams, return_counts=True)
                cut = np.searchsorted(key, np.arange(b - a + 1) * BUCKETS)
                at, sizes = (key % BUCKETS).astype(np.uint16), np.bincount(owner, minlength=b - a)
                rows = [(at[i:j], (n[i:j] * (BUCKETS / size)).astype(np.float32)) for i, j, size in zip(cut, cut[1:], sizes)]
                packed = [pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *packed], ["label", "at", "share"])

    rows = docs.select(F.col(label).alias("label"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(count, "label string, at binary, share binary"))


def fit_machine(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """(weights, intercept) of the linear support vector machine that minimises the mean hinge loss plus penalty / 2 |w|^2,
    by dual coordinate descent over centred features in a fixed order. y: 1 or -1. x is changed."""
    centre = x.mean(axis=0, dtype=float)
    x -= centre.astype(np.float32)
    norm = np.maximum(np.einsum("ij,ij->i", x, x), 1e-12)
    constant = float(np.sqrt(norm.mean()))  # the intercept is the weight of one more feature of this size
    norm += constant**2
    upper = 1 / (penalty * len(y))
    alpha, w, bias = np.zeros(len(y)), np.zeros(x.shape[1], np.float32), 0.0
    rng = np.random.default_rng(1)
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(y)):
            gradient = y[i] * (float(x[i] @ w) + constant * bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), upper)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += np.float32(step) * x[i]
                bias += step * constant
                worst = max(worst, abs(step) * norm[i])
                alpha[i] = new
        if worst < 0.01:
            break
    return w.astype(float), bias * constant - float(w @ centre)


def learnable(docs: DataFrame, train: Column, sample: int = SAMPLE) -> DataFrame:
    """About `sample` documents of each language by a hash of the id; fewer where there are fewer."""
    known = docs.where(train & F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return known
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, sample / n) * (1 << 30)))])
    return known.where(part < F.element_at(share, F.col("lang")))


def train_machines(docs: DataFrame, train: Column, families: dict[str, str] | None = None, typical: bool = False) -> dict:
    """{"families": {family: [languages]}, (a, b): (weights, intercept)}: a machine's margin is positive for b.

    With typical, also {"typical": {language: (ln of its n-grams' shares, their mean over its own n-grams)}}. Rows without
    text, letter or language are not learnt; without any other rows there are no families. A pair's group holds about
    SAMPLE rows of each of its languages, so it is bounded whatever the table; ties between machines are _decide's.
    """
    families = FAMILIES if families is None else families
    data = sample_features(learnable(docs, train), "lang")
    found = sorted(r["label"] for r in data.select("label").distinct().collect())  # one row a language
    groups: dict[str, list[str]] = {}
    for lang in found:
        groups.setdefault(families.get(lang, lang), []).append(lang)
    model: dict = {"families": groups}
    pairs = [(f"family {a}", f"family {b}", groups[a], groups[b]) for a, b in combinations(sorted(groups), 2)]
    pairs += [(a, b, [a], [b]) for langs in groups.values() for a, b in combinations(langs, 2)]
    parts: dict[str, list] = {lang: [] for lang in found}  # which pairs a language takes part in, and on which side
    for k, (_, _, left, right) in enumerate(pairs):
        for lang in left + right:
            parts[lang].append((k, lang in right))
    if typical:
        for k, lang in enumerate(found):
            parts[lang].append((len(pairs) + k, True))
    if not found:
        return model | ({"typical": {}} if typical else {})

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        k = int(rows["pair"].iloc[0])
        rows = rows.sort_values(["y", "at", "share"])  # the same order whenever the task runs again
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for i, (at, share) in enumerate(zip(rows["at"], rows["share"], strict=True)):
            x[i, np.frombuffer(at, np.uint16)] = np.frombuffer(share, np.float32)
        w, c = fit_machine(x, np.where(rows["y"], 1, -1)) if k < len(pairs) else (x.mean(axis=0, dtype=float), 0.0)
        return pd.DataFrame({"pair": [k], "w": [w.tobytes()], "c": [c]})

    of = F.create_map(*[x for lang, sides in parts.items() for x in (
        F.lit(lang), F.array(*[F.struct(F.lit(k).alias("pair"), F.lit(y).alias("y")) for k, y in sides]) if sides
        else F.array().cast("array<struct<pair: int, y: boolean>>"))])
    rows = data.withColumn("side", F.explode(F.element_at(of, F.col("label")))).select("side.pair", "side.y", "at", "share")
    made = rows.groupBy("pair").applyInPandas(fit, "pair int, w binary, c double").collect()  # BUCKETS numbers a pair
    weights = {r["pair"]: (np.frombuffer(r["w"]), r["c"]) for r in made}
    for k, (a, b, _, _) in enumerate(pairs):
        model[a, b] = (weights[k][0] * BUCKETS, weights[k][1])
    if typical:
        shares = {lang: (weights[len(pairs) + k][0] + 0.01) for k, lang in enumerate(found)}
        shares = {lang: x / x.sum() for lang, x in shares.items()}
        model["typical"] = {lang: (np.log(x), float((x * np.log(x)).sum())) for lang, x in shares.items()}
    return model


def lowest_fit(docs: DataFrame, held_out: Column, model: dict) -> float | None:
    """The worst fit among the held-out texts that have a label and a letter; None without any. model has typical."""
    rows = docs.where(held_out & F.col("lang").isNotNull() & F.col("text").rlike(LETTER)).select("text")
    return predict(rows, model).agg(F.min("fit")).first()[0]


def _decide(margin: dict, names: list[str], prefix: str, shape: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the name with most one-versus-one wins (ties: larger sum of probabilities), and its mean probability."""
    if len(names) == 1:
        return np.zeros(shape, np.int64), np.ones(shape)
    wins, chance = np.zeros((shape, len(names))), np.zeros((shape, len(names)))
    for i, j in combinations(range(len(names)), 2):
        m = margin[prefix + names[i], prefix + names[j]]
        p = 1 / (1 + np.exp(-np.clip(4 * m, -50, 50)))
        wins[:, i] += m <= 0
        wins[:, j] += m > 0
        chance[:, i] += 1 - p
        chance[:, j] += p
    best = (wins + chance / (len(names) + 1)).argmax(axis=1)
    return best, chance[np.arange(shape), best] / (len(names) - 1)


def predict(docs: DataFrame, model: dict, prefix: str = "") -> DataFrame:
    """All columns of docs, lang_pred and score (0 to 1), whose names begin with `prefix`; columns of docs that have these names
    are replaced.

    If the model has typical, also fit: the mean ln share of the text's n-grams in the predicted language, less that of
    a typical text (0: as typical texts; below: n-grams rare in it), PRIOR_GRAMS typical n-grams added; null for `und`.
    `und` with score 0 where text is null or has no letter, or where nothing was learnt. Empty tables give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made = [f"{prefix}lang_pred string", f"{prefix}score double"] + ([f"{prefix}fit double"] if "typical" in model else [])
    kept = [c for c in docs.columns if c not in {m.split()[0] for m in made}]
    extra = docs.schema["text"].dataType.simpleString() != "string"  # else the texts need not go to the workers twice
    place = kept.index("text")

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        groups = m["families"]
        families = sorted(groups)
        typical = m.get("typical")
        machines = {k: v for k, v in m.items() if k not in ("families", "typical")}
        for batch in batches:
            text = batch.column(batch.num_columns - 1 if extra else place)
            lang, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            fit = np.zeros(batch.num_rows)
            if groups:
                for a, b, grams, owner in _grams(text):
                    size = np.maximum(1, np.bincount(owner, minlength=b - a))
                    margin = {k: np.bincount(owner, w[grams], b - a) / size + c for k, (w, c) in machines.items()}
                    family, p = _decide(margin, families, "family ", b - a)
                    for f, name in enumerate(families):
                        best, q = _decide(margin, groups[name], "", b - a)
                        own = np.flatnonzero(family == f)
                        lang[a + own] = np.array(groups[name], object)[best[own]]
                        score[a + own] = p[own] * q[own]
                    for name in typical or ():
                        log_share, mean = typical[name]
                        own = np.flatnonzero(lang[a:b] == name)
                        if len(own):
                            fit[a + own] = ((np.bincount(owner, log_share[grams], b - a) - mean * size) / (size + PRIOR_GRAMS))[own]
            letters = pc.fill_null(pc.match_substring_regex(text, LETTER), False).to_numpy(zero_copy_only=False)
            lang[~letters], score[~letters] = UNKNOWN, 0.0
            columns = batch.columns[: len(kept)]
            columns += [pa.array(lang, pa.string()), pa.array(score)] + ([pa.array(fit, mask=lang == UNKNOWN)] if typical is not None else [])
            yield pa.RecordBatch.from_arrays(columns, [*kept, *(x.split()[0] for x in made)])
        give_back()

    rows = docs.select(*kept, *([F.col("text").cast("string").alias("__text")] if extra else []))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept] + made)
    return rows.mapInArrow(guess, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = train_machines(docs.select("doc_id", "text", "lang"), ~held_out)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
ORACLE_SQL: dict[str, str] = {}
