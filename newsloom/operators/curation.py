"""Curation of topics, sources and entities: list filters with totals, bulk changes, seeds, upserts, hierarchy, review.

Changes give new tables; nothing is updated in place. Unless a function says otherwise, nulls never match a filter,
ties are broken by id, and empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import slugify
from newsloom.sources import store
from newsloom.sources.domain import Domain, with_domain

# Markup that a text should not hold, titles of pages that keep robots out, types by kind of entity.
SUSPICIOUS = ("<style", "<script", "<noscript", "&lt;strong&gt;", "&lt;b&gt;", "&lt;em&gt;", "&lt;p&gt;")
ENTITY_TYPES = {"person": "person", "pope": "person", "brand_alpha": "brand", "brand_single": "brand", "model": "model"}


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether the text holds one of the parts, in any case; false for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*[F.lit(p.lower()) for p in parts]), lambda p: F.contains(low, p))


def page_with_total(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of rows in order, with the number of all rows in `total`."""
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def filter_topics(topics: DataFrame, text: str = "", kind: str | None = None, curated: bool | None = None) -> DataFrame:
    """Topics whose name or slug holds the text (any case, taken literally), of a type, curated or not; `invalid` ones only
    when asked for."""
    rows = topics.where(F.col("type") == kind) if kind else topics.where("type <> 'invalid'")
    if curated is not None:
        rows = rows.where(F.col("is_curated") == curated)
    low = F.lit(text.strip().lower())
    return rows.where(F.contains(F.lower("name"), low) | F.contains(F.lower("slug"), low)) if text.strip() else rows


def set_validity(topics: DataFrame, edges: DataFrame, ids: DataFrame, valid: bool) -> tuple[DataFrame, DataFrame]:
    """(topics, edges) after the named topics are made curated, or made `invalid`, not curated, and stripped of edges."""
    hit = topics.join(ids.select("topic_id").distinct().withColumn("__hit", F.lit(True)), "topic_id", "left")
    kind = F.when(F.col("__hit"), "invalid").otherwise(F.col("type"))
    out = hit.withColumns({"is_curated": F.when(F.col("__hit"), valid).otherwise(F.col("is_curated"))} | ({} if valid else {"type": kind})).select(*topics.columns)
    return out, edges if valid else edges.join(ids.select("topic_id").distinct(), "topic_id", "left_anti").select(*edges.columns)


def missing_reference(topics: DataFrame, key: str) -> DataFrame:
    """Curated, valid topics whose references (a JSON object) are null or lack the key."""
    has = F.array_contains(F.json_object_keys("refs"), key)
    return topics.where(F.col("is_curated") & (F.col("type") != "invalid") & ~F.coalesce(has, F.lit(False)))


def list_events(events: DataFrame, since=None, limit: int = 100, **equal) -> DataFrame:
    """The newest events since a time, with columns equal to the given values (None: any)."""
    for column, wanted in equal.items():
        events = events if wanted is None else events.where(F.col(column) == F.lit(wanted))
    rows = events if since is None else events.where(F.col("ts") >= F.lit(since))
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def replace_edges(edges: DataFrame, fresh: DataFrame, articles: DataFrame) -> DataFrame:
    """Edges of the given articles replaced by fresh ones: what is not among these is gone. Fresh edges of other articles are
    ignored; of equal (article, topic) the highest score counts. A task hashes its articles' ids (each once) and sorts no edges."""
    ids = articles.select("article_id").distinct().hint("shuffle_hash")
    best = fresh.groupBy("article_id", "topic_id").agg(F.max("score").alias("score"))
    return edges.select("article_id", "topic_id", "score").join(ids, "article_id", "left_anti").unionByName(best.join(ids, "article_id", "left_semi"))


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows that share a key the one with the greatest `order`."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of old with the same key, column by column: a null in new keeps the old value."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    take = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if c in new.columns else F.col(f"a.{c}")
    return joined.select(*[take(c).alias(c) for c in old.columns])


def source_key(feed: Column, wordpress: Column) -> Column:
    """The natural key of a source: its feed, else its WordPress root, without a slash at the end, in lower case."""
    key = F.coalesce(F.nullif(F.trim(feed), F.lit("")), F.nullif(F.trim(wordpress), F.lit("")))
    return F.lower(F.regexp_replace(key, "/+$", ""))


def next_positions(placed: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """For each group the position after its last row: 0 where it has none."""
    last = placed.groupBy(group).agg((F.max("position") + 1).alias("next"))
    return groups.select(group).distinct().join(last, group, "left").select(group, F.coalesce("next", F.lit(0)).alias("next"))


def ancestors(tree: DataFrame, most: int = 64) -> DataFrame:
    """category_id, ancestor_id, distance for every ancestor: one join for each level. A cycle ends where a node would meet
    one of its ancestors again; missing parents end the walk."""
    up = tree.where("parent_id IS NOT NULL").select(F.col("category_id").alias("ancestor_id"), F.col("parent_id").alias("above"))
    known = tree.select(F.col("category_id").alias("above"))
    up = up.join(known, "above", "left_semi")
    level = tree.select("category_id", F.col("category_id").alias("ancestor_id"), F.array("category_id").alias("path"))
    out = None
    for distance in range(1, most + 1):
        level = level.join(up, "ancestor_id").where(~F.array_contains("path", F.col("above"))).select(
            "category_id", F.col("above").alias("ancestor_id"), F.concat("path", F.array("above")).alias("path"))
        rows = level.select("category_id", "ancestor_id", F.lit(distance).alias("distance"))
        if distance > 1 and rows.isEmpty():
            break
        out = rows if out is None else out.unionByName(rows)
    return out


def empty_to_null(rows: DataFrame) -> DataFrame:
    """Detail views: empty and blank strings are null."""
    text = {f.name for f in rows.schema if f.dataType.simpleString() == "string"}
    return rows.select(*[F.when(F.trim(c) != "", F.col(c)).alias(c) if c in text else F.col(c) for c in rows.columns])


def flatten_references(topics: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Topic detail: the named references of a topic as columns; null where a topic has none."""
    return topics.select("topic_id", "name", "type", *[F.get_json_object("refs", f"$.{k}").alias(k) for k in keys])


def retype(topics: DataFrame, kind: Column) -> DataFrame:
    """topic_id, type, new_type where the inferred type is known and another: the diff of a dry run."""
    return topics.select("topic_id", "type", kind.alias("new_type")).where("new_type IS NOT NULL AND new_type <> type")


# --- entities ---


def per_source_totals(mentions: DataFrame) -> DataFrame:
    """mentions: normalized, kind, source, surface, in_title, in_body. Counts for each entity and source."""
    return mentions.groupBy("normalized", "kind", "source").agg(
        F.sum(F.col("in_title").cast("long")).alias("title_count"), F.sum(F.col("in_body").cast("long")).alias("body_count"), F.count("*").alias("articles"))


def review_queue(entities: DataFrame, terms: DataFrame, least: int = 5, n: int = 50) -> DataFrame:
    """Entities that are neither resolved nor ignored and occur often enough, most frequent first, with the topics that their
    words (four letters or more) name; terms: term, topic_id (of several topics of a term the last)."""
    queue = entities.where(F.col("topic_id").isNull() & ~F.coalesce("ignored", F.lit(False)) & (F.col("occurrences") >= least))
    queue = queue.orderBy(F.desc("occurrences"), "normalized", "kind").limit(n)
    queue = store.once(queue, f"{store.work_folder(entities.sparkSession, 'queue')}/queue")  # read twice; what it is made from once
    words = queue.select("normalized", "kind", F.explode(F.array_distinct(F.split("normalized", " "))).alias("term")).where(F.length("term") >= 4)
    last = terms.groupBy("term").agg(F.max("topic_id").alias("hint"))
    hints = words.join(last, "term").groupBy("normalized", "kind").agg(F.sort_array(F.collect_set("hint")).alias("hints"))
    return queue.join(hints, ["normalized", "kind"], "left").withColumn("hints", F.coalesce("hints", F.array().cast("array<bigint>"))).orderBy(
        F.desc("occurrences"), "normalized", "kind")


def confirm_entities(entities: DataFrame, topics: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topics, entities) after decisions (entity_id, as_type; null: by the entity's kind). A topic with the name's slug becomes
    curated and gets the surface as an alias; else a new one is made, numbered after the last. Rows without a slug and
    repeated decisions count once or not at all; of several new names with one slug the least entity makes the topic."""
    kinds = F.create_map(*[F.lit(x) for kv in ENTITY_TYPES.items() for x in kv])
    made = decisions.dropDuplicates(["entity_id"]).join(entities, "entity_id").withColumn("slug", slugify("surface")).where("slug <> ''")
    made = made.withColumn("as_type", F.coalesce("as_type", F.element_at(kinds, F.col("kind")), F.lit("subject")))
    extra = made.groupBy("slug").agg(F.sort_array(F.collect_set("surface")).alias("surfaces"), F.min(F.struct("entity_id", "surface", "as_type")).alias("first"))
    old = topics.join(extra, "slug", "left")
    added = F.filter("surfaces", lambda s: (s != F.col("name")) & ~F.array_contains("aliases", s))
    kept = old.select(
        "topic_id", "slug", "name", "type", F.when(F.col("surfaces").isNotNull(), F.concat("aliases", added)).otherwise(F.col("aliases")).alias("aliases"),
        (F.col("is_curated") | F.col("surfaces").isNotNull()).alias("is_curated"))
    new = extra.join(topics.select("slug"), "slug", "left_anti").crossJoin(F.broadcast(topics.agg(F.coalesce(F.max("topic_id"), F.lit(0)).alias("last"))))
    number = F.row_number().over(Window.orderBy("first.entity_id"))  # as many as a curator confirms
    new = new.select((F.col("last") + number).alias("topic_id"), "slug", F.col("first.surface").alias("name"), F.col("first.as_type").alias("type"),
                     F.array().cast("array<string>").alias("aliases"), F.lit(True).alias("is_curated"))
    out = kept.unionByName(new)
    resolved = made.select("entity_id", "slug").join(out.select("slug", F.col("topic_id").alias("to")), "slug").select("entity_id", "to")
    after = entities.join(resolved, "entity_id", "left").withColumn("topic_id", F.coalesce("to", "topic_id")).select(*entities.columns)
    return out, after


def reject_entities(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """Entities of the ids become ignored."""
    hit = ids.select("entity_id").distinct().withColumn("__hit", F.lit(True))
    return entities.join(hit, "entity_id", "left").withColumn("ignored", F.coalesce("__hit", "ignored", F.lit(False))).select(*entities.columns)


# --- queries ---


def _topics(d: Domain) -> DataFrame:
    refs = F.when(F.col("topic_id") % 5 != 0, F.to_json(F.struct(F.when(F.col("topic_id") % 3 != 0, F.col("brand")).alias("brand"), F.col("size").alias("size"))))
    return d.topics().select(
        "topic_id", "name", F.concat_ws("-", slugify("name"), "topic_id").alias("slug"), F.when(F.col("size") == 7, "invalid").otherwise(F.col("type")).alias("type"), "is_curated", refs.alias("refs"))


def _admin(spark, sf):
    rows = filter_topics(_topics(Domain(spark, sf)), "AL", curated=True)
    return page_with_total(rows.select("topic_id", "name", "type"), ["name", "topic_id"], 25, 10)


def _invalid_ids(d: Domain) -> DataFrame:
    return d.topics().where("size = 3").select("topic_id")


def _invalidated(spark, sf):
    d = Domain(spark, sf)
    topics, _ = set_validity(_topics(d), d.edges(), _invalid_ids(d), False)
    return topics.groupBy("type", "is_curated").agg(F.count("*").alias("n"))


def _stripped(spark, sf):
    d = Domain(spark, sf)
    _, edges = set_validity(_topics(d), d.edges().select("article_id", "topic_id", "score"), _invalid_ids(d), False)
    return edges.groupBy("article_id").agg(F.count("*").alias("topics"), F.sum("score").alias("score"))


def _replaced(spark, sf):
    d = Domain(spark, sf)
    fresh = d.articles().select("article_id", (F.col("article_id") % 17).alias("topic_id"), F.lit(3).cast("decimal(25,2)").alias("score"))
    return replace_edges(d.edges(), fresh, d.articles().where("status = 'failed'").select("article_id")).select("article_id", "topic_id", F.col("score").cast("double").alias("score"))


def _seeded(spark, sf):
    d = Domain(spark, sf)
    old = d.topics().select(slugify("brand").alias("slug"), "topic_id", "name", "type")
    seeds = d.topics().select(slugify(F.concat("brand", F.col("topic_id") % 3)).alias("slug"), "topic_id", F.upper("name").alias("name"), F.when(F.col("topic_id") % 2 == 0, F.col("type")).alias("type"))
    return upsert(last_of_each(old, "slug", "topic_id"), last_of_each(seeds, "slug", "topic_id"), "slug")


def _sources_by_status(spark, sf):
    status = F.when(F.col("balance") < 0, "broken").when(F.col("balance") < 1000, "paused").otherwise("active")
    return Domain(spark, sf).sources().groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def _lineage(spark, sf):
    return ancestors(Domain(spark, sf).categories())


def _retyped(spark, sf):
    from newsloom.operators.enrichment import infer_type

    d = Domain(spark, sf)
    classes = F.array(F.substring_index("type", " ", 1), F.substring_index("type", " ", -1))
    return retype(d.topics(), infer_type(classes, [("economy", ["ECONOMY", "BRASS"]), ("metal", ["STEEL", "TIN"])]))


def _detail(spark, sf):
    return flatten_references(_topics(Domain(spark, sf)), ("brand", "size"))


def _articles_detail(spark, sf):
    rows = Domain(spark, sf).texts().select("doc_id", "source", F.trim("title").alias("title"), F.when(F.length("body") > 40, F.sha2("body", 256)).otherwise("").alias("body"))
    return empty_to_null(rows)


_TOPICS_SQL = """
, t AS (SELECT topic_id, name, trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', '-', 'g'), '-') || '-' || topic_id AS slug, CASE WHEN size = 7 THEN 'invalid' ELSE type END AS type, is_curated, size,
  CASE WHEN topic_id % 5 <> 0 THEN CASE WHEN topic_id % 3 <> 0 THEN brand END END AS brand, CASE WHEN topic_id % 5 <> 0 THEN size END AS ref_size FROM topics)"""
QUERIES = {
    "admin_topics": _admin,
    "topics_invalidated": _invalidated,
    "edges_stripped": _stripped,
    "edges_replaced": _replaced,
    "topics_seeded": _seeded,
    "sources_by_status": _sources_by_status,
    "missing_enrichment": lambda spark, sf: missing_reference(_topics(Domain(spark, sf)), "brand").select("topic_id"),
    "events_newest": lambda spark, sf: list_events(Domain(spark, sf).activity(), "2024-01-10 00:00:00", 100, event_type="impression", status=200).select("event_id", "ts", "user_id"),
    "last_published": lambda spark, sf: Domain(spark, sf).articles().where("status = 'indexed'").agg(F.max("published_at").alias("lastmod"), F.count("*").alias("n")),
    "category_ancestors": _lineage,
    "next_position": lambda spark, sf: next_positions(
        (d := Domain(spark, sf)).sources().where("balance > 0").select("category_id", (F.col("source_id") % 40).alias("position")), d.categories().select("category_id"), "category_id"),
    "topics_retyped": _retyped,
    "topic_detail": _detail,
    "article_detail": _articles_detail,
    "suspicious_pages": lambda spark, sf: Domain(spark, sf).table("pages").where(contains_any(F.col("html"), SUSPICIOUS)).select("page_id"),
}
ORACLE_SQL = {
    "admin_topics": with_domain("topics", _TOPICS_SQL + """, f AS (SELECT topic_id, name, type FROM t WHERE type <> 'invalid' AND is_curated AND (contains(lower(name), 'al') OR contains(slug, 'al')))
SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY name, topic_id LIMIT 25 OFFSET 10"""),
    "topics_invalidated": with_domain("topics", _TOPICS_SQL + " SELECT CASE WHEN size = 3 THEN 'invalid' ELSE type END AS type, CASE WHEN size = 3 THEN false ELSE is_curated END AS is_curated, count(*) AS n FROM t GROUP BY 1, 2"),
    "edges_stripped": with_domain("edges topics", " SELECT article_id, count(*) AS topics, sum(score) AS score FROM edges WHERE topic_id NOT IN (SELECT topic_id FROM topics WHERE size = 3) GROUP BY 1"),
    "edges_replaced": with_domain("edges articles", """ SELECT article_id, topic_id, score::DOUBLE AS score FROM edges WHERE article_id NOT IN (SELECT article_id FROM articles WHERE status = 'failed')
UNION ALL SELECT article_id, article_id % 17, 3.0::DOUBLE FROM articles WHERE status = 'failed'"""),
    "topics_seeded": with_domain("topics", """
, o AS (SELECT regexp_replace(lower(brand), '[^a-z0-9]+', '-', 'g') AS slug, topic_id, name, type FROM topics QUALIFY row_number() OVER (PARTITION BY lower(brand) ORDER BY topic_id DESC) = 1),
n AS (SELECT regexp_replace(lower(brand || (topic_id % 3)), '[^a-z0-9]+', '-', 'g') AS slug, topic_id, upper(name) AS name, CASE WHEN topic_id % 2 = 0 THEN type END AS type FROM topics
  QUALIFY row_number() OVER (PARTITION BY lower(brand || (topic_id % 3)) ORDER BY topic_id DESC) = 1)
SELECT coalesce(n.slug, o.slug) AS slug, coalesce(n.topic_id, o.topic_id) AS topic_id, coalesce(n.name, o.name) AS name, coalesce(n.type, o.type) AS type FROM o FULL JOIN n ON o.slug = n.slug"""),
    "sources_by_status": with_domain("sources", " SELECT CASE WHEN balance < 0 THEN 'broken' WHEN balance < 1000 THEN 'paused' ELSE 'active' END AS status, count(*) AS n FROM sources GROUP BY 1"),
    "missing_enrichment": with_domain("topics", _TOPICS_SQL + " SELECT topic_id FROM t WHERE is_curated AND type <> 'invalid' AND brand IS NULL"),
    "events_newest": with_domain("activity", " SELECT event_id, ts, user_id FROM activity WHERE event_type = 'impression' AND status = 200 AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 100"),
    "last_published": with_domain("articles", " SELECT max(published_at) AS lastmod, count(*) AS n FROM articles WHERE status = 'indexed'"),
    "category_ancestors": with_domain("categories", " SELECT category_id, parent_id AS ancestor_id, 1 AS distance FROM categories WHERE parent_id IS NOT NULL"),
    "next_position": with_domain("sources categories", """ SELECT c.category_id, coalesce(max(s.source_id % 40) + 1, 0) AS next FROM (SELECT DISTINCT category_id FROM categories) c
LEFT JOIN (SELECT * FROM sources WHERE balance > 0) s ON s.category_id = c.category_id GROUP BY 1"""),
    "topics_retyped": with_domain("topics", """
, x AS (SELECT topic_id, type, string_split(type, ' ')[1] AS a, string_split(type, ' ')[-1] AS b FROM topics)
SELECT topic_id, type, CASE WHEN a IN ('ECONOMY', 'BRASS') OR b IN ('ECONOMY', 'BRASS') THEN 'economy' ELSE 'metal' END AS new_type FROM x WHERE a IN ('ECONOMY', 'BRASS', 'STEEL', 'TIN') OR b IN ('ECONOMY', 'BRASS', 'STEEL', 'TIN')"""),
    "topic_detail": with_domain("topics", _TOPICS_SQL + " SELECT topic_id, name, type, brand, ref_size::VARCHAR AS size FROM t"),
    "article_detail": with_domain("texts", " SELECT doc_id, nullif(trim(source), '') AS source, nullif(trim(title, ' '), '') AS title, CASE WHEN length(body) > 40 THEN sha256(body) END AS body FROM texts"),
    "suspicious_pages": "SELECT page_id FROM pages WHERE " + " OR ".join(f"contains(lower(html), '{p}')" for p in SUSPICIOUS),
}
