"""Files whose order matters: numbered lines, reserved words under section comments, lists of topics, provinces.

Lines are numbered across the splits of a file: the place within a split, which is that of the split's rows, and the counts of
the splits before it. What is carried from line to line (a section, an item's number) is carried within a split by a window
and between splits by a window over one row each, so no task holds more than a split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.text import fix_mojibake, slugify
from newsloom.operators.curation import source_key
from newsloom.sources import store
from newsloom.sources.domain import Domain

#: Section labels: the first whose words a comment holds. Words before any section count as system.
SECTIONS = (("profanity", ("profanity", "slur")), ("brand", ("brand", "copyright")), ("system", ("sistema", "rotte", "system")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, split, line (from 1 within the file), value."""
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("__id"))
    raw = store.once(raw, f"{store.work_folder(spark, 'lines')}/lines")  # ids and rows must not be made twice
    w = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = raw.groupBy("file", "split").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("file", "split").orderBy("__id"))
    return raw.withColumn("__own", own).join(before, ["file", "split"]).select("file", "split", (F.col("__own") + F.col("__before")).cast("long").alias("line"), "value")


def carried(lines: DataFrame, value: Column, out: str) -> DataFrame:
    """lines with the last non-null value up to each line, null before the first."""
    df = lines.withColumn("__v", value)
    w = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    last = df.groupBy("file", "split").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("line"))).alias("__last"))
    last = last.withColumn("__from", F.last("__last", True).over(w)).drop("__last")
    inside = F.last("__v", True).over(Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__in", inside).join(last, ["file", "split"]).withColumn(out, F.coalesce("__in", "__from")).drop("__v", "__in", "__from")


def reserved_words(lines: DataFrame) -> DataFrame:
    """word (lower case), reason: the section of each word's last line. Comments begin with #; those that name no section leave
    it as it is; blank lines count for nothing."""
    text = F.trim("value")
    label = F.lit(None).cast("string")
    for name, words in reversed(SECTIONS):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(F.lower(text), F.lit(word))
        label = F.when(hit, name).otherwise(label)
    df = carried(lines, F.when(text.startswith("#"), label), "reason")
    kept = df.where((text != "") & ~text.startswith("#")).select(F.lower(text).alias("word"), F.coalesce("reason", F.lit("system")).alias("reason"), "file", "line")
    return kept.groupBy("word").agg(F.max_by("reason", F.struct("file", "line")).alias("reason"))


def _plain(c: Column) -> Column:
    """A scalar without quotes and comment."""
    bare = F.trim(F.regexp_replace(F.trim(c), r"\s+#.*$", ""))
    double = F.replace(F.replace(F.regexp_extract(bare, r'^"(.*)"$', 1), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    single = F.replace(F.regexp_extract(bare, r"^'(.*)'$", 1), F.lit("''"), F.lit("'"))
    return F.when(bare.rlike(r'^".*"$'), double).when(bare.rlike(r"^'.*'$"), single).when(bare.isin("", "~", "null"), None).otherwise(bare)


def yaml_items(lines: DataFrame) -> DataFrame:
    """file, item (the line where it begins), fields (map<string, array<string>>) of a YAML list of flat mappings: `- key: value`
    begins an item, deeper `key: value` go on with it; a value is a scalar, `[a, b]`, or lines `- a` deeper still. Other YAML
    (anchors, blocks of text, nested mappings) is not read."""
    rows = lines.where(~F.trim("value").rlike("^(#.*|---)?$"))
    df = carried(rows, F.when(F.col("value").rlike("^- "), F.col("line")), "item").where("item IS NOT NULL")
    body = F.regexp_replace("value", "^- ", "  ")
    key = F.regexp_extract(body, r"^\s+([A-Za-z_][\w-]*):(?:\s|$)", 1)
    df = df.withColumns({"__body": body, "__key": F.when(~body.rlike(r"^\s+- "), F.nullif(key, F.lit("")))})
    df = carried(df, F.col("__key"), "key").where("key IS NOT NULL")
    given = F.regexp_replace("__body", r"^\s+(?:- |[A-Za-z_][\w-]*:\s*)", "")
    listed = F.transform(F.split(F.regexp_replace(given, r"^\[|\]\s*$", ""), r",\s*"), _plain)
    values = F.when(given.rlike(r"^\[.*\]\s*$"), listed).otherwise(F.array(_plain(given)))
    each = df.select("file", "item", "key", "line", F.filter(values, lambda v: v.isNotNull()).alias("v"))
    merged = each.groupBy("file", "item", "key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line", "v"))), lambda s: s["v"])).alias("v"))
    return merged.groupBy("file", "item").agg(F.map_from_entries(F.collect_list(F.struct("key", "v"))).alias("fields"))


def _get(name: str) -> Column:
    return F.get(F.try_element_at("fields", F.lit(name)), F.lit(0))


def seed_topics(items: DataFrame) -> DataFrame:
    """slug, type, name, aliases, description, wikidata: of the items of a slug the last in the file."""
    rows = items.select("file", "item", _get("slug").alias("slug"), _get("type").alias("type"), _get("display_name").alias("name"),
                        F.coalesce(F.try_element_at("fields", F.lit("aliases")), F.array().cast("array<string>")).alias("aliases"), _get("description").alias("description"), _get("wikidata").alias("wikidata"))
    rest = ["type", "name", "aliases", "description", "wikidata"]
    return rows.where("slug IS NOT NULL").groupBy("slug").agg(F.max_by(F.struct(*rest), F.struct("file", "item")).alias("r")).select("slug", "r.*")


def seed_featured(items: DataFrame, sources: DataFrame, featured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, featured) with the items of a list: sources that are not there come as pending, of the kind that their URLs
    tell, numbered after the last; placements of a source are replaced. sources: source_id, kind, url_site, url_feed,
    wp_api_root, title, status; featured: source_id, hint, name, description, position. A source is found by its feed, else by
    its WordPress root; of several placements of one source the last in the file counts."""
    rows = items.select("file", "item", *[_get(k).alias(k) for k in ("url_site", "url_feed", "wp_api_root", "display_name", "category_hint", "description")], F.coalesce(_get("position").try_cast("int"), F.lit(0)).alias("position"))
    rows = rows.withColumn("key", source_key(F.col("url_feed"), F.col("wp_api_root"))).where("key IS NOT NULL")
    known = sources.withColumn("key", source_key(F.col("url_feed"), F.col("wp_api_root"))).where("key IS NOT NULL").groupBy("key").agg(F.min("source_id").alias("source_id"))
    last = rows.groupBy("key").agg(F.max_by(F.struct("display_name", "category_hint", "description", "position"), F.struct("file", "item")).alias("p"), F.min_by(F.struct("url_site", "url_feed", "wp_api_root", "display_name"), F.struct("file", "item")).alias("s"))
    last = last.join(known, "key", "left")
    top = sources.agg(F.coalesce(F.max("source_id"), F.lit(0)).alias("top"))
    fresh = last.where("source_id IS NULL").withColumn("n", F.row_number().over(Window.orderBy("key"))).crossJoin(F.broadcast(top))  # a seed list is short
    fresh = fresh.withColumn("source_id", (F.col("top") + F.col("n")).cast("long"))
    kind = F.when(F.col("s.url_feed").isNotNull(), "rss").otherwise("wordpress_api")
    made = fresh.select("source_id", kind.alias("kind"), "s.url_site", "s.url_feed", "s.wp_api_root", F.col("s.display_name").alias("title"), F.lit("pending").alias("status"))
    placed = last.where("source_id IS NOT NULL").select("source_id", "p").unionByName(fresh.select("source_id", "p")).select(
        "source_id", F.col("p.category_hint").alias("hint"), F.col("p.display_name").alias("name"), "p.description", "p.position")
    return sources.unionByName(made.select(*sources.columns)), featured.join(placed, "source_id", "left_anti").select(*placed.columns).unionByName(placed)


def read_provinces(spark: SparkSession, path: str) -> DataFrame:
    """slug, name of a CSV with a column Provincia: mojibake mended, of equal slugs the first in the file."""
    rows = spark.read.option("header", True).csv(path).select(
        "Provincia", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    rows = rows.where(F.trim("Provincia") != "").withColumn("name", fix_mojibake(F.trim("Provincia")))
    rows = rows.withColumn("slug", slugify("name")).where("slug <> ''")
    return rows.groupBy("slug").agg(F.min_by("name", F.struct("file", "split", "id")).alias("name"))


def _reserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of words with section comments, made of the parts in order, read back."""
    k, folder = F.col("p_partkey"), store.work_folder(spark, "reserved")
    line = F.when(k % 9 == 0, "# Brand names").when(k % 9 == 4, "#  slurs and such").when(k % 9 == 7, "# a note").when(k % 9 == 8, "").otherwise(F.initcap(F.split("p_name", " ")[0]))
    rows = Domain(spark, sf_dir).table("part").select(line.alias("value"), k.alias("k"))
    rows.repartitionByRange(1, "k").sortWithinPartitions("k").select("value").write.text(folder)
    return reserved_words(numbered_lines(spark, folder))


QUERIES = {"reserved_words": _reserved}
ORACLE_SQL = {
    "reserved_words": """
WITH l AS (SELECT p_partkey AS k, lower(split_part(p_name, ' ', 1)) AS word, CASE p_partkey % 9 WHEN 0 THEN 'brand' WHEN 4 THEN 'profanity' END AS label FROM part),
s AS (SELECT *, last_value(label IGNORE NULLS) OVER (ORDER BY k) AS reason FROM l)
SELECT word, arg_max(coalesce(reason, 'system'), k) AS reason FROM s WHERE k % 9 NOT IN (0, 4, 7, 8) GROUP BY 1"""
}
