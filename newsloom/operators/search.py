"""Full-text search over documents: postings, BM25, highlight, suggestions; and text queries over pages.

Null texts hold no words, ties are ordered by id, and empty tables give no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.markup import TAGS, normalize_articles
from newsloom.functions.text import html_to_text, internal_links, mark_matches, source_domain, url_hash
from newsloom.sources.domain import Domain, with_domain

K1, B = 1.2, 0.75


def search_tokens(text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Lower-case words of two characters and more, without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]{2,})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*stopwords)) if stopwords else words


def postings(docs: DataFrame, key: str, text: Column, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """term, key, tf, length: an index of the documents."""
    tokens = docs.select(key, search_tokens(text, stopwords).alias("w")).withColumn("length", F.size("w"))
    return tokens.select(key, "length", F.explode("w").alias("term")).groupBy("term", key, "length").agg(F.count("*").alias("tf"))


def term_statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, df, tf. Texts are dealt by key once, so that a document's terms are counted where it is."""
    terms = docs.select(key, text).repartition(key).select(key, F.explode(search_tokens(F.col(text))).alias("term"))
    each = terms.groupBy(key, "term").agg(F.count("*").alias("tf"))
    return each.groupBy("term").agg(F.count(key).alias("df"), F.sum("tf").alias("tf"))


def bm25(index: DataFrame, key: str, query: list[str], stats: DataFrame, limit: int | None = 20, offset: int = 0) -> DataFrame:
    """The best documents by BM25, ties by key (all, in no order, if limit is None). stats: one row with n documents and their average length."""
    hits = index.where(F.col("term").isin(*query))  # pushed to the index
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    if limit is None:
        return scored.groupBy(key).agg(F.sum(part).alias("score"))
    return scored.groupBy(key).agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), key).offset(offset).limit(limit)


def search_documents(docs: DataFrame, fields: dict[str, float], query: str, sources: list[str] | None = None, stopwords: tuple[str, ...] = (),
                     wordforms: dict[str, str] | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """docs: doc_id, source, published_at and the text fields. doc_id, score, total: a page of the documents that hold a word of
    the query in a field, by weighted BM25 of the fields (ties: newest, then doc_id), and how many there are in all.

    A blank query finds nothing, nor does an empty list of sources; None asks all. wordforms: words read as others, in query and
    text. Limits are bounded to 1 to 50, offsets to 1,000. Null fields hold no words.
    """
    forms = wordforms or {}
    words = [forms.get(w, w) for w in re.findall(r"[^\W_]{2,}", query.lower()) if w not in stopwords]
    rows = docs if sources is None else docs.where(F.col("source").isin(sources)) if sources else docs.limit(0)
    empty = docs.limit(0).select("doc_id", F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("total"))
    if not words:
        return empty
    table = F.create_map(*[F.lit(x) for kv in forms.items() for x in kv]) if forms else None
    read = lambda c: F.transform(search_tokens(F.col(c), stopwords), lambda w: F.coalesce(F.try_element_at(table, w), w)) if forms else search_tokens(F.col(c), stopwords)
    parts = None
    for field, weight in fields.items():
        tokens = docs.select("doc_id", read(field).alias("w")).withColumn("length", F.size("w"))
        stats = tokens.agg(F.count("*").alias("n"), F.avg("length").alias("avg_length"))
        index = tokens.select("doc_id", "length", F.explode(F.filter("w", lambda w: w.isin(words))).alias("term")).groupBy("term", "doc_id", "length").agg(F.count("*").alias("tf"))
        scored = bm25(index, "doc_id", words, stats, limit=None).withColumn("score", F.col("score") * weight)
        parts = scored if parts is None else parts.unionByName(scored)
    hits = parts.groupBy("doc_id").agg(F.round(F.sum("score"), 6).alias("score")).join(rows.select("doc_id", "published_at"), "doc_id")
    page = hits.orderBy(F.desc("score"), F.desc("published_at"), "doc_id").offset(min(max(offset, 0), 1000)).limit(min(max(limit, 1), 50))
    return page.crossJoin(F.broadcast(hits.agg(F.count("*").alias("total")))).select("doc_id", "score", "total")


def hydrate(ranked: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of the ranked ids in their order; ids without a row are skipped."""
    return ranked.join(rows, key).orderBy(order)


def search_rows(docs: DataFrame) -> DataFrame:
    """Documents as a full-text index takes them: null texts empty, null lists empty, times as epoch seconds (null: 0)."""
    out = {f.name: f.dataType.simpleString() for f in docs.schema}
    fill = lambda c, t: (
        F.coalesce(c, F.lit("")) if t == "string" else F.coalesce(c, F.array().cast(t)) if t.startswith("array")
        else F.coalesce(F.unix_seconds(F.col(c).cast("timestamp")), F.lit(0)) if t.startswith("timestamp") else F.col(c))
    return docs.select(*[fill(c, t).alias(c) for c, t in out.items()])


def replace_documents(index: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The index with documents of fresh in place of those of the same key."""
    return delete_documents(index, fresh, key).unionByName(search_rows(fresh))


def delete_documents(index: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return index.join(ids.select(key).distinct(), key, "left_anti").select(*index.columns)


def suggest_all(topics: DataFrame, sources: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """kind, id, name: curated valid topics and active sources whose names hold the text (taken literally), shortest first."""
    low = F.lit(text.strip().lower())
    if len(text.strip()) < 2:
        topics, sources = topics.limit(0), sources.limit(0)
    t = topics.where("is_curated AND type <> 'invalid'").select(F.lit("topic").alias("kind"), F.col("topic_id").alias("id"), "name")
    s = sources.where("is_active").select(F.lit("source").alias("kind"), F.col("source_id").alias("id"), F.col("title").alias("name"))
    both = t.unionByName(s).where(F.contains(F.lower("name"), low))
    return both.orderBy(F.length("name"), "name", "kind", "id").limit(limit)


def suggest(topics: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """Curated topics whose name contains the text, shortest first; texts under two characters suggest nothing."""
    if len(text) < 2:
        return topics.limit(0).select("topic_id", "name")
    return topics.where("is_curated").where(F.contains(F.lower("name"), F.lit(text.lower()))).orderBy(F.length("name"), "name", "topic_id").limit(limit).select("topic_id", "name")


#: What `search_page` asks for: weights of fields, query, words read as others.
FIELDS, ASKED, FORMS = {"title": 3.0, "body": 1.0}, "The with, edges! bles", {"bles": "ble"}
QUERY = ["edges", "threth", "whorha", "tionand", "anouth", "stance", "onthe", "withe"]


def _bm25(spark, sf):
    docs = Domain(spark, sf).table("documents")
    lengths = docs.select(F.size(search_tokens(F.col("text"))).alias("l"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("l").alias("avg_length"))
    return bm25(postings(docs, "doc_id", F.col("text")), "doc_id", QUERY, stats)


def _fragments(spark, sf):
    docs = Domain(spark, sf).table("documents").where(F.col("text").rlike("(?i)of the"))
    return docs.select("doc_id", mark_matches("text", "of the").alias("snippet"))


def _normalized(spark, sf):
    """Pages as articles: every second one comes as its feed's markup, the others were fetched."""
    fetched = F.col("page_id") % 2 == 0
    rows = Domain(spark, sf).table("pages").select(
        "page_id", "url", F.when(~fetched, F.col("html")).alias("content_html"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("image_url"), F.when(fetched, F.col("html")).alias("page_html"))
    safe = F.col("content_html_safe")
    return normalize_articles(rows).select(
        "page_id", "used_page", F.sha2("content_text", 256).alias("text_sha256"), F.regexp_count(safe, F.lit("<[a-z]")).cast("long").alias("n_elements"),
        F.rlike(safe, F.lit(f"<(?!/?(?:{'|'.join(TAGS)})[ >])")).alias("has_others"))


def _articles(d: Domain) -> DataFrame:
    return d.texts().withColumn("published_at", F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("doc_id") % 97) * 3600))


def _search(spark, sf):
    d = Domain(spark, sf)
    rows = d.table("documents").select("source").distinct().orderBy("source").limit(3).collect()  # three sources that a user follows
    return search_documents(_articles(d), FIELDS, ASKED, [r["source"] for r in rows], ("the",), FORMS, 40, 5)


def _hydrated(spark, sf):
    d = Domain(spark, sf)
    newest = d.articles().orderBy(F.desc("published_at"), "article_id").limit(60)
    ranked = newest.select((F.col("article_id") + 2).alias("article_id"), (-F.unix_seconds(F.col("published_at").cast("timestamp"))).alias("place"))
    return hydrate(ranked, d.articles(), "article_id", "place").select("article_id", "status", "published_at")


_PAGE_TEXT = "trim(regexp_replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\\s+', ' ', 'g'))"
_CUT = "regexp_replace(regexp_replace(regexp_replace({}, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')"
QUERIES = {
    "search_bm25": _bm25,
    "search_page": _search,
    "search_hydrated": _hydrated,
    "search_rows": lambda spark, sf: search_rows(Domain(spark, sf).articles().select("article_id", F.when(F.col("status") != "new", F.col("status")).alias("status"), "published_at")),
    "search_replaced": lambda spark, sf: replace_documents((d := Domain(spark, sf)).articles().select("article_id", "status"), d.articles().where("status = 'failed'").select("article_id", F.lit(None).cast("string").alias("status")), "article_id"),
    "suggest_all": lambda spark, sf: suggest_all((d := Domain(spark, sf)).topics(), d.sources().withColumn("is_active", F.col("balance") > 0), "an"),
    "search_fragments": _fragments,
    "pages_normalized": _normalized,
    "search_suggest": lambda spark, sf: suggest(Domain(spark, sf).topics(), "al"),
    "term_statistics": lambda spark, sf: term_statistics(Domain(spark, sf).table("documents"), "doc_id", "text").orderBy(F.desc("tf"), "term").limit(200),
    "url_hash": lambda spark, sf: Domain(spark, sf).table("pages").select("page_id", url_hash("url").alias("url_hash")),
    "source_domain": lambda spark, sf: Domain(spark, sf).table("pages").groupBy(source_domain("url").alias("domain")).agg(F.count("*").alias("n")),
    "html_text": lambda spark, sf: Domain(spark, sf).table("pages").select("page_id", F.sha2(html_to_text("html"), 256).alias("text_sha256"), F.length(html_to_text("html")).cast("bigint").alias("n")),
    "internal_links": lambda spark, sf: Domain(spark, sf).table("pages").select("page_id", F.inline(internal_links("html", "url"))),
}
ORACLE_SQL = {
    "search_bm25": f"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}]{{2,}})', 1) AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS avg_length FROM t), e AS (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM t),
p AS (SELECT doc_id, length, term, count(*) AS tf FROM e WHERE term IN ({", ".join(f"'{q}'" for q in QUERY)}) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * {K1 + 1}::DOUBLE / (tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * length / avg_length))), 6) AS score
FROM p JOIN f USING (term), s GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20""",
    "search_page": with_domain("texts", f"""
, q AS (SELECT unnest(['with', 'edges', 'ble']) AS term),
a AS (SELECT doc_id, source, to_timestamp(1700000000 + (doc_id % 97) * 3600) AS t, title, body FROM texts),
f AS (SELECT doc_id, 3.0::DOUBLE AS weight, 1 AS field, list_filter(regexp_extract_all(lower(title), '([\\p{{L}}\\p{{N}}]{{2,}})', 1), lambda w: w <> 'the') AS w FROM a
  UNION ALL SELECT doc_id, 1.0, 2, list_filter(regexp_extract_all(lower(body), '([\\p{{L}}\\p{{N}}]{{2,}})', 1), lambda w: w <> 'the') FROM a),
s AS (SELECT field, count(*) AS n, avg(len(w)) AS avg_length FROM f GROUP BY 1),
e AS (SELECT doc_id, field, weight, len(w) AS length, CASE WHEN x = 'bles' THEN 'ble' ELSE x END AS term FROM (SELECT *, unnest(w) AS x FROM f)),
p AS (SELECT doc_id, field, weight, length, term, count(*) AS tf FROM e SEMI JOIN q USING (term) GROUP BY ALL), g AS (SELECT field, term, count(*) AS df FROM p GROUP BY 1, 2),
h AS (SELECT doc_id, round(sum(weight * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * {K1 + 1}::DOUBLE / (tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * length / avg_length))), 6) AS score
  FROM p JOIN g USING (field, term) JOIN s USING (field) GROUP BY 1),
r AS (SELECT doc_id, score, t FROM h JOIN a USING (doc_id) WHERE source IN (SELECT DISTINCT source FROM documents ORDER BY source LIMIT 3))
SELECT doc_id, score, (SELECT count(*) FROM r) AS total FROM r ORDER BY score DESC, t DESC, doc_id LIMIT 40 OFFSET 5"""),
    "search_hydrated": with_domain("articles", ", r AS (SELECT article_id + 2 AS article_id FROM articles ORDER BY published_at DESC, article_id LIMIT 60) SELECT article_id, status, published_at FROM r JOIN articles USING (article_id)"),
    "search_rows": with_domain("articles", " SELECT article_id, CASE WHEN status <> 'new' THEN status ELSE '' END AS status, coalesce(epoch(published_at)::BIGINT, 0) AS published_at FROM articles"),
    "search_replaced": with_domain("articles", " SELECT article_id, CASE WHEN status = 'failed' THEN '' ELSE status END AS status FROM articles"),
    "suggest_all": with_domain("topics sources", """
, b AS (SELECT 'topic' AS kind, topic_id AS id, name FROM topics WHERE is_curated AND type <> 'invalid' UNION ALL SELECT 'source', source_id, title FROM sources WHERE balance > 0)
SELECT kind, id, name FROM b WHERE contains(lower(name), 'an') ORDER BY length(name), name, kind, id LIMIT 8"""),
    "search_suggest": with_domain("topics", "SELECT topic_id, name FROM topics WHERE is_curated AND contains(lower(name), 'al') ORDER BY length(name), name, topic_id LIMIT 8"),
    "term_statistics": "WITH e AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]{2,})', 1)) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM e GROUP BY 1 ORDER BY tf DESC, term LIMIT 200",
    "url_hash": "SELECT page_id, sha256(trim(url)) AS url_hash FROM pages",
    "source_domain": "SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS domain, count(*) AS n FROM pages GROUP BY 1",
    "html_text": f"WITH a AS (SELECT page_id, {_PAGE_TEXT.format(_CUT.format('html'))} AS x FROM pages), b AS (SELECT page_id, {_PAGE_TEXT.format(_CUT.format('x'))} AS x FROM a) SELECT page_id, sha256(x) AS text_sha256, length(x) AS n FROM b",
    "search_fragments": "SELECT doc_id, regexp_replace(substr(text, greatest(instr(lower(text), 'of the') - 60, 1), 180), '(?i)(of the)', '<mark>\\1</mark>', 'g') AS snippet FROM documents WHERE contains(lower(text), 'of the')",
    "pages_normalized": f"""
WITH a AS (SELECT page_id, url, html, {_PAGE_TEXT.format(_CUT.format('html'))} AS x, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS m FROM pages),
b AS (SELECT *, {_PAGE_TEXT.format(_CUT.format('x'))} AS y FROM a)
SELECT page_id, page_id % 2 = 0 AS used_page, sha256(left(y, 50000)) AS text_sha256, len(regexp_extract_all(m, '(?i)<(?:p|br|ul|li|a|h1)(?:\\s[^>]*)?>')) AS n_elements, false AS has_others FROM b""",
    "internal_links": """
WITH p AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"#]+)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"#]+)">([^<]*)</a>', 2) AS t FROM pages),
u AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || unnest(h) AS url, trim(unnest(t)) AS text, unnest(range(len(h))) AS i FROM p),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY i) = 1)
SELECT page_id, url, text FROM f WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i) <= 20""",
}
