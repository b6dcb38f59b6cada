"""Upkeep of the catalogue: sources by natural key, snapshots read back, digests that are due, statistics of topics and mentions.

Null keys match nothing, repeated keys count once (the least values), and empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.text import normalize_term, slugify
from newsloom.operators import maintenance
from newsloom.operators.accounts import SESSION_DAYS, _sessions, active_sessions
from newsloom.operators.alerts import daily_digest
from newsloom.operators.curation import per_source_totals, reject_entities, source_key, upsert
from newsloom.operators.enrichment import build_references
from newsloom.sources import store
from newsloom.sources.domain import Domain, with_domain

#: Parts that new rows are numbered in, so that no task numbers all.
PARTS = 64


def numbered_after(rows: DataFrame, key: str, last: DataFrame, out: str) -> DataFrame:
    """rows with numbers after the one value of `last`, gapless, by the key's hash part and then the key."""
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int"))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows
    before = dealt.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(key)) + F.col("__before")
    top = last.columns[0]
    numbered = dealt.join(F.broadcast(before), "__part").withColumn("__place", place).crossJoin(F.broadcast(last))
    return numbered.withColumn(out, (F.col(top) + F.col("__place")).cast("long")).drop("__part", "__before", "__place", top)


def upsert_sources(sources: DataFrame, found: DataFrame) -> DataFrame:
    """sources (source_id, url_feed, wp_api_root, title, status) with those found (the same without source_id and status): a
    source of the same natural key takes the title found, unless that is null; others come as pending, numbered after the last.
    Rows without a key are left out."""
    key = source_key(F.col("url_feed"), F.col("wp_api_root"))
    new = found.withColumn("key", key).where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("url_feed", "wp_api_root", "title")).alias("s"))
    known = sources.withColumn("key", key).where("key IS NOT NULL").groupBy("key").agg(F.min("source_id").alias("source_id"))
    new = new.join(known, "key", "left")
    titles = new.where("source_id IS NOT NULL").select("source_id", F.col("s.title").alias("title"))
    last = sources.agg(F.coalesce(F.max("source_id"), F.lit(0)).alias("__last"))
    fresh = numbered_after(new.where("source_id IS NULL").drop("source_id"), "key", last, "source_id")
    return upsert(sources, titles, "source_id").unionByName(fresh.select("source_id", "s.url_feed", "s.wp_api_root", "s.title", F.lit("pending").alias("status")).select(*sources.columns))


def import_snapshot(spark: SparkSession, path: str, required: tuple[str, ...] = ("slug", "type", "name")) -> DataFrame:
    """A snapshot of topics (Parquet); an error where required columns are missing. Rows without a slug are left out."""
    rows = spark.read.parquet(path)
    missing = sorted(set(required) - set(rows.columns))
    if missing:
        raise ValueError(f"the snapshot has no {', '.join(missing)}")
    return rows.where("slug IS NOT NULL AND slug <> ''")


def due_digests(users: DataFrame, subscriptions: DataFrame, articles: DataFrame, sessions: DataFrame, sent: DataFrame, since, until, now, days: int = SESSION_DAYS, by: str = "source_id") -> DataFrame:
    """user_id, n, body: users with new articles between the times, who were active within `days` before now and have had no
    digest on the day of now. sent: user_id, sent_at; by as in daily_digest."""
    active = active_sessions(sessions, now, days).select("user_id")
    today = F.to_date(F.lit(now).cast("timestamp_ntz"))
    had = sent.where(F.to_date("sent_at") == today).select("user_id")
    return daily_digest(users.join(active, "user_id", "left_semi").join(had, "user_id", "left_anti"), subscriptions, articles, since, until, by)


def topic_statistics(topics: DataFrame, refs: str, identity: str, wanted: tuple[str, ...]) -> DataFrame:
    """By type: topics, those whose references (JSON) have the identity, those that lack any of the wanted ones."""
    has = lambda k: F.get_json_object(refs, f"$.{k}").isNotNull()
    lacks = F.lit(False)
    for k in wanted:
        lacks = lacks | ~F.coalesce(has(k), F.lit(False))
    return topics.groupBy("type").agg(F.count("*").alias("n"), F.count_if(has(identity)).alias("with_identity"), F.count_if(lacks).alias("lacking"))


def swept(candidates: DataFrame, key: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of the candidates: what a retention sweep leaves, of articles and of all that hangs on them.
    The candidates are found once, for all tables; a task hashes its own (each once) and sorts no table."""
    gone = candidates.select(key).distinct()
    gone = store.once(gone, f"{store.work_folder(gone.sparkSession, 'swept')}/gone").hint("shuffle_hash")
    return {name: rows.join(gone, key, "left_anti").select(*rows.columns) for name, rows in tables.items()}


def alias_targets(topics: DataFrame) -> DataFrame:
    """term, target_id: every name and alias of a curated valid topic, normalised; of several topics with a term the first."""
    rows = topics.where("is_curated AND type <> 'invalid'").select("topic_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("raw"))
    return rows.select(normalize_term("raw").alias("term"), "topic_id").where("term <> ''").groupBy("term").agg(F.min("topic_id").alias("target_id"))


def merge_by_alias(topics: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topics, edges) after each topic that is not curated and whose name is a term of a curated one has given its edges to it
    and is deleted. An article that has the curated topic keeps that edge; else the best of those moved stays."""
    named = topics.where("NOT is_curated").select("topic_id", normalize_term("name").alias("term"))
    moves = named.join(alias_targets(topics), "term").select("topic_id", "target_id")
    moved = edges.join(moves, "topic_id", "left").select("article_id", F.coalesce("target_id", "topic_id").alias("topic_id"), "score", F.col("target_id").isNull().alias("own"))
    best = moved.groupBy("article_id", "topic_id").agg(F.max(F.struct("own", "score")).alias("b")).select("article_id", "topic_id", "b.score")
    return topics.join(moves, "topic_id", "left_anti").select(*topics.columns), best


def slugs_within(rows: DataFrame, name: str, key: str, groups: list[str]) -> DataFrame:
    """The groups, key and slug of each row: the name's slug, numbered from 2 in the order of the key where it repeats within the
    groups (nulls are one group)."""
    made = rows.select(*groups, key, slugify(name).alias("__base"))
    n = F.row_number().over(Window.partitionBy(*groups, "__base").orderBy(key))
    return made.withColumn("slug", F.when(n > 1, F.concat_ws("-", "__base", n)).otherwise(F.col("__base"))).drop("__base")


def _swept(spark, sf):
    d = Domain(spark, sf)
    left = swept(maintenance.QUERIES["retention_candidates"](spark, sf), "article_id", articles=d.articles(), edges=d.edges())
    edges = left["edges"].groupBy("article_id").agg(F.count("*").alias("edges"))
    return left["articles"].join(edges, "article_id", "left").groupBy("source_id").agg(F.count("*").alias("articles"), F.sum("edges").alias("edges"))


def _merged(spark, sf):
    d = Domain(spark, sf)
    aliases = F.array(F.concat(F.substring_index("name", " ", 2), F.lit(" "), F.substring_index("name", " ", -1)))
    topics, edges = merge_by_alias(d.topics().withColumn("aliases", aliases), d.edges())
    per = edges.groupBy("topic_id").agg(F.count("*").alias("n"), F.sum("score").cast("double").alias("score"))
    return topics.select("topic_id", "is_curated").join(per, "topic_id", "left")


def _slugs(spark, sf):
    d = Domain(spark, sf)
    rows = d.table("customer").select("c_custkey", F.col("c_nationkey").alias("user_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("parent"), F.concat(F.lit("Cat "), F.col("c_custkey") % 4).alias("name"))
    return slugs_within(rows, "name", "c_custkey", ["user_id", "parent"])


def _upserted(spark, sf):
    d = Domain(spark, sf)
    url = F.concat(F.lit("https://s"), F.col("source_id"), F.lit(".example/feed"))
    sources = d.sources().select(F.col("source_id").cast("long").alias("source_id"), F.when(F.col("source_id") % 3 != 0, url).alias("url_feed"),
                                 F.when(F.col("source_id") % 3 == 0, F.concat(url, F.lit("/wp"))).alias("wp_api_root"), "title", F.lit("active").alias("status"))
    found = sources.where("source_id % 2 = 0").select(F.concat(F.upper("url_feed"), F.lit("/")).alias("url_feed"), "wp_api_root", F.concat(F.lit("New "), "title").alias("title"))
    new = d.topics().select(F.concat(F.lit("https://t"), F.col("topic_id"), F.lit(".example/")).alias("url_feed"), F.lit(None).cast("string").alias("wp_api_root"), F.col("name").alias("title"))
    out = upsert_sources(sources, found.unionByName(new).unionByName(new))
    return out.select(F.when(F.col("status") == "active", F.col("source_id")).alias("known_id"), "title", "status", F.lower("url_feed").alias("feed"), F.count("*").over(Window.partitionBy("source_id")).alias("same_id"))


def _snapshot(spark, sf):
    from newsloom.operators.enrichment import export_snapshot

    path = store.work_folder(spark, "snapshot")
    export_snapshot(Domain(spark, sf).topics().withColumn("slug", F.concat(F.lit("t-"), "topic_id"))).write.parquet(path)
    return import_snapshot(spark, path).groupBy("type").agg(F.count("*").alias("n"), F.min("slug").alias("first_slug"))


def _due(spark, sf):
    d, t = Domain(spark, sf), lambda x: F.lit(x).cast("timestamp_ntz")
    users = d.user_categories()
    sent = d.activity().where("event_type = 'preview_open'").select("user_id", F.col("ts").alias("sent_at"))
    return due_digests(users.select("user_id"), users, d.categorised_articles(), _sessions(d), sent, t("1998-05-01"), t("1998-05-02"), "2024-01-29 12:00:00", by="category_id")


def _rejected(spark, sf):
    entities = Domain(spark, sf).table("part").select(F.col("p_partkey").alias("entity_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") % 4 == 0).alias("ignored"))
    return reject_entities(entities, entities.where("entity_id % 5 = 1").select("entity_id")).groupBy("ignored").agg(F.count("*").alias("n"), F.sum("entity_id").alias("ids"))


def _mentions(spark, sf):
    rows = Domain(spark, sf).table("lineitem").select(
        F.concat(F.lit("e"), F.col("l_partkey") % 50).alias("normalized"), F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("source"), (F.col("l_linenumber") == 1).alias("in_title"),
        (F.col("l_quantity") > 25).alias("in_body"))
    return per_source_totals(rows)


def _gaps(spark, sf):
    from newsloom.operators.curation import _topics

    return topic_statistics(_topics(Domain(spark, sf)), "refs", "brand", ("brand", "size"))


def _references(spark, sf):
    """References of an entity made for each topic."""
    k = F.col("topic_id")
    entity = F.format_string('{"claims": {"P31": [%s], "P18": [{"mainsnak": {"datavalue": {"value": "Pic %d.jpg"}}}]}, "sitelinks": {"itwiki": {"url": "%s"}}}', F.concat_ws(
        ",", F.transform(F.sequence(F.lit(1), k % 4 + 1), lambda i: F.format_string('{"mainsnak": {"datavalue": {"value": {"id": "Q%d"}}}}', F.floor(i / 2)))), k, F.when(k % 2 == 0, "https://it.example/x").otherwise(""))
    refs = build_references(entity, F.concat(F.lit("Q"), k), (k % 10) / 10, F.lit("label"))
    return Domain(spark, sf).topics().select("topic_id", refs.alias("r")).select(
        "topic_id", F.size("r").alias("n_keys"), *[F.try_element_at("r", F.lit(c)).alias(c) for c in ("wikidata_qid", "instance_of", "image", "wikipedia_url_it")])


QUERIES = {
    "sources_upserted": _upserted, "snapshot_imported": _snapshot, "digests_due": _due, "entities_rejected": _rejected, "mention_totals": _mentions, "topic_gaps": _gaps, "topic_references": _references,
    "retention_swept": _swept, "topics_merged": _merged, "category_slugs": _slugs,
}
ORACLE_SQL = {
    "sources_upserted": with_domain("sources topics", """
, s AS (SELECT source_id, title, 'https://s' || source_id || '.example/feed' AS url FROM sources)
SELECT source_id AS known_id, CASE WHEN source_id % 2 = 0 THEN 'New ' || title ELSE title END AS title, 'active' AS status, CASE WHEN source_id % 3 <> 0 THEN url END AS feed, 1::BIGINT AS same_id FROM s
UNION ALL SELECT NULL, name, 'pending', 'https://t' || topic_id || '.example/', 1::BIGINT FROM topics"""),
    "snapshot_imported": with_domain("topics", "SELECT type, count(*) AS n, min('t-' || topic_id) AS first_slug FROM topics WHERE is_curated GROUP BY 1"),
    "digests_due": with_domain("articles subscriptions activity", """
, s AS (SELECT user_id, event_id % 5 AS session_id, max(ts) AS seen, min(event_id) AS e FROM activity GROUP BY 1, 2),
a AS (SELECT DISTINCT user_id FROM s WHERE e % 4 <> 0 AND seen >= TIMESTAMP '2024-01-29 12:00:00' - INTERVAL 30 DAY),
had AS (SELECT user_id FROM activity WHERE event_type = 'preview_open' AND ts::DATE = DATE '2024-01-29'),
c AS (SELECT user_id, count(DISTINCT article_id) AS n FROM subscriptions JOIN articles USING (source_id) WHERE published_at >= '1998-05-01' AND published_at < '1998-05-02' GROUP BY 1)
SELECT user_id, n, CASE WHEN n = 1 THEN '1 new article' ELSE n || ' new articles' END AS body FROM c SEMI JOIN a USING (user_id) ANTI JOIN had USING (user_id)"""),
    "entities_rejected": "SELECT CASE WHEN p_partkey % 5 = 1 THEN true WHEN p_size % 2 = 0 THEN p_size % 4 = 0 ELSE false END AS ignored, count(*) AS n, sum(p_partkey)::BIGINT AS ids FROM part GROUP BY 1",
    "mention_totals": "SELECT 'e' || l_partkey % 50 AS normalized, l_returnflag AS kind, l_suppkey AS source, count_if(l_linenumber = 1)::BIGINT AS title_count, count_if(l_quantity > 25)::BIGINT AS body_count, count(*) AS articles FROM lineitem GROUP BY 1, 2, 3",
    "topic_gaps": with_domain("topics", "SELECT CASE WHEN size = 7 THEN 'invalid' ELSE type END AS type, count(*) AS n, count_if(topic_id % 5 <> 0 AND topic_id % 3 <> 0)::BIGINT AS with_identity, count_if(topic_id % 5 = 0 OR topic_id % 3 = 0)::BIGINT AS lacking FROM topics GROUP BY 1"),
    "topic_references": with_domain("topics", """
SELECT topic_id, (5 + (topic_id % 2 = 0)::INT)::INT AS n_keys, 'Q' || topic_id AS wikidata_qid, CASE topic_id % 4 WHEN 0 THEN 'Q0' WHEN 1 THEN 'Q0,Q1' WHEN 2 THEN 'Q0,Q1' ELSE 'Q0,Q1,Q2' END AS instance_of,
  'https://commons.wikimedia.org/wiki/Special:FilePath/Pic_' || topic_id || '.jpg?width=512' AS image, CASE WHEN topic_id % 2 = 0 THEN 'https://it.example/x' END AS wikipedia_url_it FROM topics"""),
    "retention_swept": f"""
WITH g AS ({maintenance.ORACLE_SQL["retention_candidates"]}), e AS (SELECT l_orderkey AS article_id, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1)
SELECT o_custkey AS source_id, count(*) AS articles, sum(n)::BIGINT AS edges FROM orders LEFT JOIN e ON e.article_id = o_orderkey WHERE o_orderkey NOT IN (SELECT article_id FROM g) GROUP BY 1""",
    "topics_merged": with_domain("topics edges", """
, x AS (SELECT *, lower(trim(name)) AS term, lower(string_split(name, ' ')[1] || ' ' || string_split(name, ' ')[2] || ' ' || string_split(name, ' ')[-1]) AS alias FROM topics),
a AS (SELECT term, min(topic_id) AS target FROM (SELECT term, topic_id FROM x WHERE is_curated AND type <> 'invalid' UNION ALL SELECT alias, topic_id FROM x WHERE is_curated AND type <> 'invalid') GROUP BY 1),
m AS (SELECT topic_id, target FROM x JOIN a USING (term) WHERE NOT is_curated),
v AS (SELECT article_id, coalesce(target, e.topic_id) AS topic_id, score, target IS NULL AS own FROM edges e LEFT JOIN m USING (topic_id)),
b AS (SELECT article_id, topic_id, coalesce(max(score) FILTER (own), max(score)) AS score FROM v GROUP BY 1, 2),
p AS (SELECT topic_id, count(*) AS n, sum(score)::DOUBLE AS score FROM b GROUP BY 1)
SELECT topic_id, is_curated, n, score FROM topics LEFT JOIN p USING (topic_id) WHERE topic_id NOT IN (SELECT topic_id FROM m)"""),
    "category_slugs": """
WITH c AS (SELECT c_custkey, c_nationkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS parent, 'cat-' || c_custkey % 4 AS base FROM customer),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, parent, base ORDER BY c_custkey) AS n FROM c)
SELECT user_id, parent, c_custkey, CASE WHEN n > 1 THEN base || '-' || n ELSE base END AS slug FROM n""",
}
