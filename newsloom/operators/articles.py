"""The whole way of an article to its topics: dictionary in both cases, names by pattern, caps, composites, subsumption,
topics made on the way, and edges.

topics: topic_id, slug, name, type, aliases, is_curated, case_sensitive. articles: doc_id, title, body, taxonomy (array).
Null texts and lists are empty. Ties go to the smaller id or the surface that comes first by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.text import normalize_term, slugify
from newsloom.operators.classify import cap_topics, composite_rules, drop_subsumed, term_counts
from newsloom.operators.extractors import found_names, models, persons, single_brands
from newsloom.sources import store
from newsloom.sources.domain import Domain

# How many names of each kind an article gives, and the titles that get no topics.
NAME_CAPS = {"person": 5, "brand": 2, "model": 3}
SKIPPED_TITLE = r"(?iu)\b(offerta|offerte)\b"
SHORTEST_COLLISION = 4


def rules_or_default(stored: DataFrame, default: DataFrame) -> DataFrame:
    """The stored rules; where there are none, the default ones."""
    return stored if not stored.isEmpty() else default


def term_index(topics: DataFrame, ambiguous_places: tuple[str, ...] = ()) -> DataFrame:
    """term, topic_id, type, cs: names and aliases of curated valid topics, two characters or more; case-sensitive topics keep
    theirs as written, others are normalised. Ambiguous terms are left out for places only."""
    rows = topics.where("is_curated AND type <> 'invalid'").select(
        "topic_id", "type", F.coalesce("case_sensitive", F.lit(False)).alias("cs"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("raw"))
    rows = rows.withColumn("term", F.when(F.col("cs"), F.trim("raw")).otherwise(normalize_term("raw")))
    kept = rows.where((F.length("term") >= 2) & ~((F.col("type") == "location") & F.lower("term").isin(*ambiguous_places)))
    return kept.select("term", "topic_id", "type", "cs").distinct()


def dictionary_matches(articles: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, topic_id, type, t, b: how often a topic's terms stand in the title, and in the body or taxonomy."""
    words = {cs: [r["term"] for r in terms.where(F.col("cs") == cs).select("term").distinct().collect()] for cs in (False, True)}  # curated rules
    counts = term_counts(articles.select("doc_id", "title", F.concat_ws(" . ", "body", "taxonomy").alias("body")), words)
    return counts.join(F.broadcast(terms), ["term", "cs"]).groupBy("doc_id", "topic_id", "type").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))


def named_matches(articles: DataFrame, matches: DataFrame, topics: DataFrame, terms: DataFrame, common: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kind, surface, t, b: names by pattern. Models need a brand that the article already has; people that hold a word
    of another kind of curated topic go; brands that are part of a person's name go; each kind keeps its NAME_CAPS best."""
    brands = matches.join(topics.where("type = 'brand' AND is_curated").select("topic_id", "name"), "topic_id").groupBy("doc_id").agg(F.sort_array(F.collect_set("name")).alias("brands"))
    rows = articles.select("doc_id", "title", "body").join(brands, "doc_id", "left")
    kept = frozenset(common)

    def find(row: dict) -> list[tuple]:
        own = tuple(row["brands"] or ())
        out = []
        for text, t in ((row["title"], 1), (row["body"], 0)):
            if text:
                each = (("person", persons(text, kept)), ("brand", single_brands(text, kept)), ("model", models(text, own, kept) if own else []))
                out += [(s, kind, t, 1 - t) for kind, found in each for s in dict.fromkeys(found)]
        return out

    each = found_names(rows, ("doc_id",), "surface string, kind string, t long, b long", lambda: find)
    each = store.once(each, f"{store.work_folder(articles.sparkSession, 'names')}/names")  # read several times; texts are not
    tokens = each.where("kind = 'person'").select("doc_id", "surface", F.explode(F.split(F.lower("surface"), " ")).alias("token")).withColumn("token", F.rtrim("token", F.lit(".,;:")))
    other = terms.where("type <> 'person' AND NOT cs").select(F.col("term").alias("token")).distinct()
    colliding = tokens.where(F.length("token") >= SHORTEST_COLLISION).join(other, "token", "left_semi").select("doc_id", "surface").distinct().withColumn("kind", F.lit("person"))
    each = each.join(colliding, ["doc_id", "surface", "kind"], "left_anti")
    inside = tokens.join(colliding, ["doc_id", "surface"], "left_anti").select("doc_id", F.col("token").alias("low")).distinct().withColumn("kind", F.lit("brand"))
    each = each.withColumn("low", F.lower("surface")).join(inside, ["doc_id", "low", "kind"], "left_anti")
    counts = each.groupBy("doc_id", "kind", normalize_term("surface").alias("normalized")).agg(F.min("surface").alias("surface"), F.sum("t").alias("t"), F.sum("b").alias("b"))
    ranked = counts.select("doc_id", F.col("kind").alias("type"), (3.0 * F.col("t") + F.col("b")).alias("score"), F.col("normalized").alias("topic_id"), "surface", "t", "b")
    return cap_topics(ranked, NAME_CAPS).select("doc_id", F.col("type").alias("kind"), "surface", "t", "b")


def resolve_names(named: DataFrame, topics: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, new topics). A name that is a term of a curated topic is that topic (the least id); else the topic of its slug,
    and none if that one is invalid; else a new topic, not curated, numbered after the last. Names without a slug go."""
    alias = terms.groupBy("term").agg(F.min("topic_id").alias("by_term"))
    rows = named.withColumns({"term": normalize_term("surface"), "slug": slugify("surface")}).join(alias, "term", "left")
    rows = rows.join(topics.select("slug", F.col("topic_id").alias("by_slug"), F.col("type").alias("slug_type")), "slug", "left")
    fresh = rows.where("by_term IS NULL AND by_slug IS NULL AND slug <> ''").groupBy("slug").agg(F.min(F.struct("surface", "kind")).alias("f"))
    # numbers without one task for all: the hash of the slug deals them to parts, whose sizes are summed before
    parts = 64
    fresh = fresh.withColumn("part", F.pmod(F.xxhash64("slug"), F.lit(parts)).cast("int"))
    before = fresh.groupBy("part").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # 64 rows
    numbered = fresh.join(F.broadcast(before), "part").withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("slug")) + F.col("before"))
    last = topics.agg(F.coalesce(F.max("topic_id"), F.lit(0)).alias("last"))
    new = numbered.crossJoin(F.broadcast(last)).select(
        (F.col("last") + F.col("place")).cast("bigint").alias("topic_id"), "slug", F.col("f.surface").alias("name"), F.col("f.kind").alias("type"), F.array().cast("array<string>").alias("aliases"),
        F.lit(False).alias("is_curated"), F.lit(False).alias("case_sensitive"))
    out = rows.where("by_term IS NOT NULL OR slug_type IS NULL OR slug_type <> 'invalid'").join(new.select("slug", F.col("topic_id").alias("by_new")), "slug", "left")
    out = out.select("doc_id", F.coalesce("by_term", "by_slug", "by_new").alias("topic_id"), F.col("kind").alias("type"), "t", "b").where("topic_id IS NOT NULL")
    return out, new


def article_topics(articles: DataFrame, topics: DataFrame, composites: list[tuple[int, list[int]]] = (), ambiguous_places: tuple[str, ...] = (), common: tuple[str, ...] = (),
                   curated_only: bool = False, title_only: bool = False, least: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(edges, new topics). edges: doc_id, topic_id, score (3 for a title match, 1 for another), position (both, title, body;
    null for a composite). Of a topic found in several ways the best score counts. Articles whose title is skipped have none."""
    rows = articles.where(~F.coalesce("title", F.lit("")).rlike(SKIPPED_TITLE))
    if title_only:
        rows = rows.withColumns({"body": F.lit(""), "taxonomy": F.array().cast("array<string>")})
    terms = term_index(topics, ambiguous_places)
    folder = store.work_folder(articles.sparkSession, "matches")
    found = store.once(dictionary_matches(rows, terms), f"{folder}/dictionary")  # what follows reads matches several times, texts once
    new = topics.limit(0)
    if not curated_only:
        named, new = resolve_names(store.once(named_matches(rows, found, topics, terms, common), f"{folder}/named"), topics, terms)
        new = store.once(new, f"{folder}/new")
        found = found.unionByName(named)
    position = F.when((F.col("t") > 0) & (F.col("b") > 0), "both").when(F.col("t") > 0, "title").otherwise("body")
    scored = found.withColumns({"score": 3.0 * F.col("t") + F.col("b"), "position": position}).where(F.col("score") >= least)
    best = scored.groupBy("doc_id", "topic_id").agg(F.max(F.struct("score", "position")).alias("m")).select("doc_id", "topic_id", "m.score", "m.position")
    if composites:
        best = composite_rules(best, list(composites)).join(best.select("doc_id", "topic_id", "position"), ["doc_id", "topic_id"], "left")
    curated = topics.where("is_curated").select("topic_id", "name")
    return drop_subsumed(best.select("doc_id", "topic_id", "score", "position"), curated), new


def _topics(spark: SparkSession) -> DataFrame:
    rows = [(1, "the", "The", "function", [], True, False), (2, "of-the", "Of the", "phrase", ["with the"], True, False), (3, "und", "Und", "brand", [], True, False), (4, "thand", "Thand", "invalid", [], False, False)]
    return store.listed(spark, rows, "topic_id bigint, slug string, name string, type string, aliases array<string>, is_curated boolean, case_sensitive boolean")


def _edges(spark, sf):
    rows = Domain(spark, sf).texts().select("doc_id", "title", "body", F.array("source").alias("taxonomy"))
    edges, new = article_topics(rows, _topics(spark), [(9, [1, 3])])
    return edges.join(new.select("topic_id", "slug"), "topic_id", "left").select("doc_id", F.coalesce("slug", F.col("topic_id").cast("string")).alias("topic"), "score", "position")


QUERIES = {"article_topics": _edges}
ORACLE_SQL: dict[str, str] = {}
