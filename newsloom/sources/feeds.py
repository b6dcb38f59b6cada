"""Feeds of three formats as one shape: RSS (and RDF), Atom and JSON Feed, told apart by their bytes; and feeds written as RSS.

Whole files are read, one row each, so a feed file has to fit a task. Files that are no feed have a null format and no items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.addresses import resolve_url
from newsloom.functions.text import parse_date, url_hash

ITEM = "struct<id: string, url: string, title: string, author: string, published: string, updated: string, summary: string, content: string, image: string, tags: array<string>>"
_RSS_ITEM = (
    "struct<guid: string, link: string, title: string, author: string, `dc:creator`: string, pubDate: string, `dc:date`: string, updated: string, description: string, `content:encoded`: string, "
    "category: array<string>, `media:thumbnail`: array<struct<_url: string>>, `media:content`: array<struct<_url: string>>, enclosure: array<struct<_url: string, _type: string>>>"
)
RSS = f"channel struct<title: string, item: array<{_RSS_ITEM}>>, item array<{_RSS_ITEM}>"
ATOM = (
    "title string, entry array<struct<id: string, title: string, link: array<struct<_href: string, _rel: string, _type: string>>, author: array<struct<name: string>>, published: string, updated: string, "
    "summary: string, content: string, category: array<struct<_term: string, _label: string>>>>"
)
JSON_FEED = "https://jsonfeed.org/"
MOST_ITEMS = 50


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _first(c: Column, field: str) -> Column:
    return F.get(c, F.lit(0))[field]


def _item(**parts: Column) -> Column:
    fields = ("id", "url", "title", "author", "published", "updated", "summary", "content", "image", "tags")
    tags = F.filter(F.transform(parts["tags"], _filled), lambda t: t.isNotNull())
    values = parts | {"tags": F.when(F.size(tags) > 0, tags)}
    return F.struct(*[(values[f] if f == "tags" else _filled(values[f])).alias(f) for f in fields])


def _of_rss(i: Column) -> Column:
    picture = F.filter(i["enclosure"], lambda e: F.lower(e["_type"]).startswith("image/"))
    return _item(id=i["guid"], url=i["link"], title=i["title"], author=F.coalesce(_filled(i["author"]), i["dc:creator"]), published=F.coalesce(_filled(i["pubDate"]), i["dc:date"]), updated=i["updated"],
                 summary=i["description"], content=i["content:encoded"], tags=i["category"],
                 image=F.coalesce(_filled(_first(i["media:thumbnail"], "_url")), _filled(_first(i["media:content"], "_url")), _first(picture, "_url")))


def _of_atom(e: Column) -> Column:
    page = F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    picture = F.filter(e["link"], lambda x: (x["_rel"] == "enclosure") & F.lower(x["_type"]).startswith("image/"))
    return _item(id=e["id"], url=F.coalesce(_first(page, "_href"), _first(e["link"], "_href")), title=e["title"], author=_first(e["author"], "name"), published=e["published"], updated=e["updated"],
                 summary=e["summary"], content=e["content"], image=_first(picture, "_href"), tags=F.transform(e["category"], lambda c: F.coalesce(_filled(c["_term"]), c["_label"])))


def _of_json(v: Column) -> Column:
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    return _item(id=get("$.id"), url=F.coalesce(_filled(get("$.url")), get("$.external_url")), title=get("$.title"), author=F.coalesce(_filled(get("$.authors[0].name")), get("$.author.name")),
                 published=get("$.date_published"), updated=get("$.date_modified"), summary=get("$.summary"), content=F.coalesce(_filled(get("$.content_html")), get("$.content_text")),
                 image=F.coalesce(_filled(get("$.image")), get("$.banner_image")), tags=get("$.tags", "array<string>"))


def parse_feeds(files: DataFrame, content: str = "content") -> DataFrame:
    """files (content: bytes of a feed) with format (rss, atom, json or null), title and items (array of ITEM) in their order.

    XML is read in the charset that it names, where that is Latin-1, else as UTF-8. Blank fields are null."""
    raw = F.col(content)
    head = F.decode(F.substring(raw, 1, 200), "ISO-8859-1")
    latin = head.rlike(r"(?i)encoding\s*=\s*[\"'](iso-8859-1|windows-1252|latin-?1)[\"']")
    text = F.when(latin, F.decode(raw, "ISO-8859-1")).otherwise(F.regexp_replace(raw.cast("string"), "^﻿", ""))
    df = files.withColumn("__text", F.regexp_replace(text, r"^\s+", ""))
    root = F.lower(F.regexp_extract("__text", r"(?s)^(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|\s)*<([A-Za-z:]+)", 1))
    json = F.when(F.col("__text").startswith("{"), F.try_parse_json("__text"))
    df = df.withColumns({"__root": root, "__json": json})
    df = df.withColumn("format", F.when(F.col("__root").isin("rss", "rdf:rdf"), "rss").when(F.col("__root") == "feed", "atom")
                       .when(F.startswith(F.try_variant_get("__json", "$.version", "string"), F.lit(JSON_FEED)), "json"))
    own = lambda kind: F.when(F.col("format") == kind, F.col("__text"))
    df = df.withColumns({"__rss": F.from_xml(own("rss"), RSS), "__atom": F.from_xml(own("atom"), ATOM)})
    none = F.array().cast(f"array<{ITEM}>")
    items = (
        F.when(F.col("format") == "rss", F.transform(F.coalesce("__rss.channel.item", "__rss.item"), _of_rss))
        .when(F.col("format") == "atom", F.transform("__atom.entry", _of_atom))
        .when(F.col("format") == "json", F.transform(F.try_variant_get("__json", "$.items", "array<variant>"), _of_json))
    )
    title = F.coalesce(_filled(F.col("__rss.channel.title")), _filled(F.col("__atom.title")), F.when(F.col("format") == "json", _filled(F.try_variant_get("__json", "$.title", "string"))))
    return df.withColumns({"title": title, "items": F.coalesce(items, none)}).drop("__text", "__root", "__json", "__rss", "__atom")


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """path, format, title, items of every file."""
    return parse_feeds(spark.read.format("binaryFile").load(path).select("path", "content")).drop("content")


def sniffed(feeds: DataFrame) -> DataFrame:
    """feeds with their first three items as sample: title of 200 characters at most, url and date ('' without)."""
    text = lambda c: F.coalesce(c, F.lit(""))
    sample = F.transform(F.slice("items", 1, 3), lambda i: F.struct(
        F.substring(text(i["title"]), 1, 200).alias("title"), text(i["url"]).alias("url"), text(F.coalesce(i["published"], i["updated"])).alias("published_at")))
    return feeds.withColumn("sample", sample)


def candidates(feeds: DataFrame, base_url: Column, now) -> DataFrame:
    """Items as candidates. Those without link or title are left out; the date is that published, else updated, else `now`;
    titles have 1,000 characters at most, descriptions 2,000; the image is the item's, else the first of its body, resolved
    against the feed's URL."""
    rows = feeds.select(base_url.alias("__base"), F.explode("items").alias("i")).where("i.url IS NOT NULL AND i.title IS NOT NULL")
    body = F.coalesce("i.content", "i.summary")
    embedded = F.nullif(F.regexp_extract(F.coalesce(body, F.lit("")), r"(?i)<img\b[^>]*?\ssrc\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit(""))
    rows = rows.withColumns({"__body": body, "__image": F.coalesce("i.image", embedded)})
    return rows.select(
        F.col("i.id").alias("external_id"), url_hash("i.url").alias("url_hash"), F.col("i.url").alias("url"), F.substring("i.title", 1, 1000).alias("title"),
        F.substring("i.summary", 1, 2000).alias("description"), F.col("__body").alias("content_html"), F.col("i.author").alias("author"),
        F.coalesce(parse_date("i.published"), parse_date("i.updated"), F.lit(now).cast("timestamp")).alias("published_at"),
        resolve_url("__image", "__base").alias("image_url"), F.col("i.tags").alias("taxonomy"))


def xml_text(c: Column | str) -> Column:
    """Text for XML: reserved characters escaped, characters that XML forbids left out, null as empty."""
    out = F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def rss_feeds(rows: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """rows: feed, item_id, title, url, description, published_at, source. feed, rss: an RSS 2.0 document of each feed's `most`
    newest items (ties: the greater item_id first), without a title 'untitled'."""
    w = Window.partitionBy("feed").orderBy(F.desc("published_at"), F.desc("item_id"))
    newest = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most)
    element = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    title = F.coalesce(_filled(F.col("title")), F.lit("untitled"))
    item = F.concat(
        F.lit("<item>"), element("title", xml_text(title)), element("link", xml_text("url")), F.lit('<guid isPermaLink="true">'), xml_text("url"), F.lit("</guid>"),
        element("pubDate", F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss '+0000'")), element("description", xml_text("description")), element("source", xml_text("source")), F.lit("</item>"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", item.alias("x")))), lambda s: s["x"]), "\n")
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0"><channel>'), element("title", xml_text(F.col("feed").cast("string"))), F.lit("\n"))
    return newest.groupBy("feed").agg(items.alias("__items")).select("feed", F.concat(head, "__items", F.lit("\n</channel></rss>\n")).alias("rss"))
