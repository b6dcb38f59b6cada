"""Knowledge enrichment of topics: scoring of candidate entries, type inference, alias and reference merges; source discovery.

Null names and labels match nothing, ties go to the smaller id, and empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import normalize_term
from newsloom.sources.domain import Domain, with_domain


#: The confidence of an exact match by what matched and in which language; aliases of other languages count as English.
EXACT_SCORES = {("label", "it"): 1.00, ("label", "en"): 0.85, ("alias", "it"): 0.80, ("alias", "en"): 0.70}
LABEL_WORDS, ALIAS_WORDS = 0.80, 0.75


def hit_score(name: Column, matched: Column, kind: Column, language: Column, label: Column, aliases: Column) -> Column:
    """How well a candidate fits a name: exact (the matched text, its kind label or alias and its language) by EXACT_SCORES, else
    LABEL_WORDS where all the name's words are in the label, else ALIAS_WORDS where they are in one alias; else null."""
    a = normalize_term(name)
    exact = F.lit(None).cast("double")
    for (k, lang), score in EXACT_SCORES.items():
        exact = F.coalesce(exact, F.when((kind == k) & (language == lang), score))
    exact = F.coalesce(exact, F.when(kind == "alias", EXACT_SCORES["alias", "en"]))
    words = F.filter(F.split(a, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    inside = lambda t: (F.size(words) > 0) & (F.size(F.array_except(words, F.split(F.lower(F.coalesce(t, F.lit(""))), r"[^\p{L}\p{N}]+"))) == 0)
    some = F.exists(F.coalesce(aliases, F.array().cast("array<string>")), inside)
    return F.coalesce(F.when(F.lower(F.trim(matched)) == a, exact), F.when(inside(label), LABEL_WORDS), F.when(some, ALIAS_WORDS))


def best_candidates(topics: DataFrame, candidates: DataFrame, compatible: Column, least: float = 0.7, n: int = 3) -> DataFrame:
    """topics: topic_id, key, name; candidates: key, candidate_id, matched, kind, language, label, aliases. Of each topic's n best
    candidates (score, then id) the first that is compatible; topics without any are left out."""
    texts = ["matched", "kind", "language", "label", "aliases"]
    # the score is the texts' alone: each distinct name meets the n least ids of each distinct candidate text
    w = Window.partitionBy("key", *texts).orderBy("candidate_id")
    some = candidates.where("key IS NOT NULL").withColumn("__same", F.row_number().over(w)).where(F.col("__same") <= n).drop("__same")
    names = topics.select("key", "name").distinct()
    scored = names.join(some, "key").withColumn("score", hit_score(F.col("name"), *map(F.col, texts))).where(F.col("score") >= least)
    w = Window.partitionBy("key", "name").orderBy(F.desc("score"), "candidate_id")
    top = scored.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)
    fitting = topics.join(top, ["key", "name"]).where(compatible)
    return fitting.withColumn("m", F.row_number().over(Window.partitionBy("topic_id").orderBy("n"))).where("m = 1").select("topic_id", "candidate_id", "score")


def infer_type(classes: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The first type whose classes overlap; null where none does."""
    out = F.lit(None).cast("string")
    for kind, wanted in reversed(rules):
        out = F.when(F.arrays_overlap(classes, F.array(*map(F.lit, wanted))), kind).otherwise(out)
    return out


def merge_aliases(old: Column, new: Column) -> Column:
    """Both lists in order, each alias once whatever its case."""
    both = F.concat(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>")))
    low = F.transform(both, F.lower)
    return F.filter(both, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def merge_references(old: Column, new: Column) -> Column:
    """Maps joined; new values win."""
    rest = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(rest, new)


def normalize_url(url: Column) -> Column:
    """Trimmed, https where no scheme is given."""
    t = F.trim(url)
    return F.when(t.rlike(r"(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))


def bot_challenge(title: Column, markers: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(m.lower()) for m in markers]), lambda m: F.contains(F.lower(F.coalesce(title, F.lit(""))), m))


def feed_links(html: Column) -> Column:
    """href of alternate links to feeds, each once, in order."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)(<link\s[^>]*>)"), F.lit(1)), lambda t: t.rlike(r"(?i)rel=[\"']alternate") & t.rlike(r"(?i)type=[\"']application/(rss|atom|feed)\+?(xml|json)"))
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.regexp_extract(t, r"(?i)href=[\"']([^\"']+)", 1)), lambda h: h != ""))


def wordpress_root(link_header: Column) -> Column:
    """The target of the Link header part whose relation is the WordPress API; null without one."""
    part = F.filter(F.split(link_header, ","), lambda p: F.contains(p, F.lit("https://api.w.org/")) & F.contains(p, F.lit("rel=")))
    return F.nullif(F.regexp_extract(F.get(part, F.lit(0)), r"<([^>]+)>", 1), F.lit(""))


def discovery(flags: DataFrame) -> DataFrame:
    """kind of each source from what its first answer shows: feed, wordpress, linked feed, common path, invalid; a bot
    challenge comes before all."""
    kind = (
        F.when(F.col("is_challenge"), "challenge").when(F.col("is_feed"), "rss").when(F.col("wp_root").isNotNull(), "wordpress")
        .when(F.size(F.coalesce(F.col("links"), F.array().cast("array<string>"))) > 0, "rss").when(F.col("common_path").isNotNull(), "rss").otherwise("invalid")
    )
    return flags.withColumn("kind", kind)


def allowed_by_robots(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """requests: origin, path; rules: origin, prefix, allow. Each distinct request with allowed: by the longest prefix that
    matches, allow before disallow of one length; without one it is allowed."""
    asked = requests.select("origin", "path").distinct()
    hit = (asked["origin"] == rules["origin"]) & F.col("path").startswith(F.col("prefix"))
    joined = asked.join(rules, hit, "left").select(asked["origin"], "path", "prefix", "allow")
    decided = F.max_by("allow", F.struct(F.length("prefix"), "allow"))
    return joined.groupBy("origin", "path").agg(F.coalesce(decided, F.lit(True)).alias("allowed"))


def claim_ids(claims: Column, prop: str) -> Column:
    """The distinct ids (Q...) that a property of an entity's claims (JSON) points to, in order; empty without any."""
    schema = "array<struct<mainsnak: struct<datavalue: struct<value: struct<id: string>>>>>"
    ids = F.transform(F.from_json(F.get_json_object(claims, f"$.{prop}"), schema), lambda c: c["mainsnak"]["datavalue"]["value"]["id"])
    return F.array_distinct(F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda q: q.startswith("Q")))


def build_references(entity: Column, qid: Column, confidence: Column, method: Column) -> Column:
    """map of references from an entity (JSON): its id, confidence and method, Wikipedia pages, image, classes, countries and
    owners (ids joined by commas); keys without a value are left out."""
    get = lambda path: F.nullif(F.get_json_object(entity, path), F.lit(""))
    claims = F.get_json_object(entity, "$.claims")
    joined = lambda prop: F.nullif(F.array_join(claim_ids(claims, prop), ","), F.lit(""))
    image = get("$.claims.P18[0].mainsnak.datavalue.value")
    values = {
        "wikidata_qid": qid, "match_confidence": confidence.cast("string"), "match_method": method, "wikipedia_url_it": get("$.sitelinks.itwiki.url"),
        "wikipedia_url_en": get("$.sitelinks.enwiki.url"),
        "image": F.concat(F.lit("https://commons.wikimedia.org/wiki/Special:FilePath/"), F.replace(image, F.lit(" "), F.lit("_")), F.lit("?width=512")),
        "instance_of": joined("P31"), "country": joined("P17"), "owned_by": joined("P127"),
    }
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())


def export_snapshot(topics: DataFrame, curated_only: bool = True) -> DataFrame:
    """type, slug, name and references as JSON with sorted keys, ordered by type and slug."""
    rows = topics.where("is_curated") if curated_only else topics
    return rows.select("type", "slug", "name", F.to_json(F.struct(F.col("brand").alias("brand"), F.col("size").alias("size"))).alias("refs")).orderBy("type", "slug")


def _enrich(spark, sf):
    """Every topic against all topics with its first two words."""
    d = Domain(spark, sf)
    topics = d.topics().withColumn("key", F.substring_index("name", " ", 2))
    kind, language = F.when(F.col("topic_id") % 3 == 0, "alias").otherwise("label"), F.when(F.col("topic_id") % 2 == 0, "it").otherwise("en")
    candidates = d.topics().select(
        F.col("topic_id").alias("candidate_id"), F.substring_index("name", " ", 2).alias("key"), F.upper("name").alias("matched"), kind.alias("kind"), language.alias("language"),
        F.concat("name", F.lit(".com")).alias("label"), F.array(F.col("brand")).alias("aliases"), F.col("type").alias("c_type"))
    return best_candidates(topics, candidates, F.substring_index("type", " ", 1) == F.substring_index("c_type", " ", 1))


def _snapshot(spark, sf):
    from newsloom.functions.text import slugify

    return export_snapshot(Domain(spark, sf).topics().withColumn("slug", F.concat_ws("-", slugify("name"), "topic_id")))


def _aliases(spark, sf):
    d = Domain(spark, sf)
    rows = d.topics().withColumn("m", merge_aliases(F.array("name", "brand"), F.array(F.upper("name"), F.col("type"))))
    return rows.select("topic_id", F.array_join("m", "|").alias("aliases"))


QUERIES = {"topic_enrichment": _enrich, "topics_snapshot": _snapshot, "alias_merge": _aliases}
ORACLE_SQL = {
    "topic_enrichment": with_domain("topics", """
, t AS (SELECT topic_id, name, type, string_split(name, ' ')[1] || ' ' || string_split(name, ' ')[2] AS key FROM topics),
s AS (SELECT t.topic_id, c.topic_id AS candidate_id, split_part(t.type, ' ', 1) = split_part(c.type, ' ', 1) AS fits,
  CASE WHEN lower(t.name) = lower(c.name) THEN CASE WHEN c.topic_id % 3 = 0 THEN CASE WHEN c.topic_id % 2 = 0 THEN 0.8 ELSE 0.7 END WHEN c.topic_id % 2 = 0 THEN 1.0 ELSE 0.85 END
    WHEN list_has_all(regexp_split_to_array(lower(c.name) || '.com', '[^a-z0-9]+'), regexp_split_to_array(lower(t.name), '[^a-z0-9]+')) THEN 0.8 END::DOUBLE AS score FROM t JOIN t c USING (key)),
r AS (SELECT * FROM s WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, candidate_id) <= 3)
SELECT topic_id, candidate_id, score FROM r WHERE fits QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, candidate_id) = 1"""),
    "topics_snapshot": with_domain("topics", "SELECT type, trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', '-', 'g'), '-') || '-' || topic_id AS slug, name, '{\"brand\":\"' || brand || '\",\"size\":' || size || '}' AS refs FROM topics WHERE is_curated"),
    "alias_merge": with_domain("topics", "SELECT topic_id, name || CASE WHEN lower(brand) <> lower(name) THEN '|' || brand ELSE '' END || CASE WHEN lower(type) NOT IN (lower(name), lower(brand)) THEN '|' || type ELSE '' END AS aliases FROM topics"),
}
