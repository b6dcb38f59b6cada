"""Feeds written to files and read back: RSS of the newest items of a source, and the three formats told apart.

Sources without articles have no feed; nulls in texts are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.sources import feeds, store
from newsloom.sources.domain import Domain, with_domain


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items of their source's feed."""
    rows = Domain(spark, sf_dir).texts().where("source IS NOT NULL")
    return rows.select(
        F.col("source").alias("feed"), F.col("doc_id").alias("item_id"), "title", F.format_string("https://%s.example/a?id=%d&x=1", "source", "doc_id").alias("url"),
        F.substring("body", 1, 300).alias("description"), F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("doc_id") % 97) * 3600).alias("published_at"), "source")


def _json_feeds(rows: DataFrame) -> DataFrame:
    """feed, text: JSON Feed documents of all items, oldest id first."""
    item = F.struct(F.col("item_id").cast("string").alias("id"), "url", "title", F.col("description").alias("content_text"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date_published"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("item_id", item.alias("x")))), lambda s: s["x"])
    return rows.groupBy("feed").agg(items.alias("items")).select("feed", F.to_json(F.struct(F.lit(feeds.JSON_FEED + "version/1.1").alias("version"), F.col("feed").alias("title"), "items")).alias("text"))


def _atom_feeds(rows: DataFrame) -> DataFrame:
    """feed, text: Atom documents of all items, oldest id first."""
    x = feeds.xml_text
    entry = F.concat(F.lit("<entry><title>"), x("title"), F.lit('</title><link href="'), x("url"), F.lit('"/><updated>'), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated><summary>"), x("description"), F.lit("</summary></entry>"))
    entries = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", entry.alias("x")))), lambda s: s["x"]), "\n")
    whole = F.concat(F.lit('<?xml version="1.0"?>\n<!-- a feed --><feed xmlns="http://www.w3.org/2005/Atom"><title>'), x("feed"), F.lit("</title>"), "entries", F.lit("</feed>"))
    return rows.groupBy("feed").agg(entries.alias("entries")).select("feed", whole.alias("text"))


def written(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file for every source: RSS, Atom or JSON Feed by the source's hash."""
    rows, path = _articles(spark, sf_dir), store.work_folder(spark, "feeds")
    kind = F.pmod(F.crc32(F.col("feed").cast("binary")), F.lit(3))
    files = feeds.rss_feeds(rows.where(kind == 0)).withColumnRenamed("rss", "text").unionByName(_atom_feeds(rows.where(kind == 1))).unionByName(_json_feeds(rows.where(kind == 2)))
    files.write.partitionBy("feed").text(path)
    return path


def _sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = feeds.sniffed(feeds.read_feeds(spark, written(spark, sf_dir)))
    return read.select("title", "format", F.size("items").cast("long").alias("n_items"), F.array_join(F.transform("sample", lambda s: F.concat_ws(" ", s["url"], s["title"])), "\n").alias("sample"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = feeds.read_feeds(spark, written(spark, sf_dir))
    found = feeds.candidates(read, F.concat(F.lit("https://"), F.col("title"), F.lit(".example/feed")), "2024-01-01 00:00:00")
    return found.select("url", "url_hash", "title", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


_ITEMS = """
, a AS (SELECT source AS feed, doc_id, 'https://' || source || '.example/a?id=' || doc_id || '&x=1' AS url, CASE WHEN trim(title) = '' THEN NULL ELSE trim(title) END AS title,
  make_timestamp((1700000000 + (doc_id % 97) * 3600) * 1000000) AS published_at FROM texts WHERE source IS NOT NULL),
k AS (SELECT *, CASE {kind} ELSE 'json' END AS format FROM a),
o AS (SELECT *, CASE format WHEN 'rss' THEN row_number() OVER (PARTITION BY feed ORDER BY published_at DESC, doc_id DESC) ELSE row_number() OVER (PARTITION BY feed ORDER BY doc_id) END AS n FROM k),
i AS (SELECT * REPLACE (CASE WHEN format = 'rss' THEN coalesce(title, 'untitled') ELSE title END AS title) FROM o WHERE format <> 'rss' OR n <= 50)"""


def _kinds() -> str:
    """DuckDB has no crc32: the kinds of the sources src0 to src99 by name."""
    import zlib

    kinds = {k: [f"'src{i}'" for i in range(1000) if zlib.crc32(f"src{i}".encode()) % 3 == k] for k in (0, 1)}
    return " ".join(f"WHEN feed IN ({', '.join(names)}) THEN '{('rss', 'atom')[k]}'" for k, names in kinds.items())


QUERIES = {"feeds_sniffed": _sniffed, "feed_items": _candidates}
ORACLE_SQL = {
    "feeds_sniffed": with_domain("texts", _ITEMS.format(kind=_kinds()) + """
SELECT feed AS title, format, count(*) AS n_items, string_agg(url || ' ' || left(coalesce(title, ''), 200), chr(10) ORDER BY n) FILTER (n <= 3) AS sample FROM i GROUP BY 1, 2"""),
    "feed_items": with_domain("texts", _ITEMS.format(kind=_kinds()) + " SELECT url, sha256(url) AS url_hash, left(title, 1000) AS title, published_at FROM i WHERE title IS NOT NULL"),
}
