"""Users: names, sessions, bookmarks, notifications, counts, export and erasure of all that belongs to one.

Nulls never match; ties are broken by id; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.sources.domain import Domain, with_domain

#: Days after which an unused session counts as ended.
SESSION_DAYS = 30


def username_problem(name: Column, reserved: Column, own_prefix: str = "system_") -> Column:
    """invalid, prefix, reserved or null for a usable name: 3 to 30 of a-z, 0-9 and _, not beginning with the site's own
    prefix, not in the array of reserved words."""
    low = F.lower(F.trim(name))
    return (
        F.when(low.isNull() | ~low.rlike("^[a-z0-9_]{3,30}$"), "invalid").when(low.startswith(own_prefix), "prefix")
        .when(F.array_contains(F.transform(reserved, F.lower), low), "reserved")
    )


def username_from_email(email: Column) -> Column:
    """The part before the @ with everything but a-z, 0-9 and _ turned into _, 28 characters at most."""
    return F.substring(F.regexp_replace(F.lower(F.substring_index(email, "@", 1)), "[^a-z0-9_]", "_"), 1, 28)


def active_sessions(sessions: DataFrame, now, days: int = SESSION_DAYS) -> DataFrame:
    """Sessions that are not revoked and were seen within `days` before now."""
    since = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return sessions.where(F.col("revoked_at").isNull() & (F.col("last_seen") >= since))


def bookmarked_articles(bookmarks: DataFrame, articles: DataFrame, edges: DataFrame) -> DataFrame:
    """Bookmarks with their articles and topic ids (empty without), newest saved first within a user; those whose article is
    gone are left out; an article saved twice counts once, at the later time."""
    saved = bookmarks.groupBy("user_id", "article_id").agg(F.max("saved_at").alias("saved_at"))
    wanted = saved.select("article_id").distinct()
    topics = edges.join(wanted, "article_id", "left_semi").groupBy("article_id").agg(F.sort_array(F.collect_set("topic_id")).alias("topics"))
    return saved.join(articles, "article_id").join(topics, "article_id", "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<bigint>")))


def which_bookmarked(asked: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """asked: user_id, article_id; those pairs that are bookmarked, each once."""
    return asked.select("user_id", "article_id").distinct().join(bookmarks.select("user_id", "article_id").distinct(), ["user_id", "article_id"], "left_semi")


def unread(notifications: DataFrame) -> DataFrame:
    """Unread notifications of each user."""
    return notifications.where("read_at IS NULL").groupBy("user_id").agg(F.count("*").alias("unread"))


def newest_of_each(rows: DataFrame, group: str, order: str, key: str, n: int) -> DataFrame:
    """The n newest rows of each group, then by key; a group's rows need not fit one task, since only n of each task's go on."""
    w = Window.partitionBy(group).orderBy(F.desc(order), F.desc(key))
    return rows.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= n).drop("__place")


def user_counts(users: DataFrame, **tables: DataFrame) -> DataFrame:
    """For each user the number of its rows in each table; 0 without any."""
    out = users.select("user_id").distinct()
    for name, rows in tables.items():
        out = out.join(rows.groupBy("user_id").agg(F.count("*").alias(name)), "user_id", "left")
    return out.select("user_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in tables])


def export_user(path: str, user_id: int, **tables: DataFrame) -> None:
    """All that a user has, as JSON lines, one folder for each table: the members of an export archive."""
    for name, rows in tables.items():
        rows.where(F.col("user_id") == user_id).write.mode("overwrite").json(f"{path}/{name}")


def erase_user(ids: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of these users."""
    gone = ids.select("user_id").distinct()
    return {name: rows.join(gone, "user_id", "left_anti").select(*rows.columns) for name, rows in tables.items()}


def _bookmarks(d: Domain) -> DataFrame:
    return d.activity().where("event_type = 'bookmark' AND target_id IS NOT NULL").select("user_id", F.col("target_id").alias("article_id"), F.col("ts").alias("saved_at"))


def _sessions(d: Domain) -> DataFrame:
    """A session for each user and fifth event id; some revoked."""
    rows = d.activity().groupBy("user_id", (F.col("event_id") % 5).alias("session_id")).agg(F.max("ts").alias("last_seen"), F.min("event_id").alias("e"))
    return rows.select("user_id", "session_id", "last_seen", F.when(F.col("e") % 4 == 0, F.col("last_seen")).alias("revoked_at"))


def _notifications(d: Domain) -> DataFrame:
    return d.activity().where("event_type = 'impression'").select("event_id", "user_id", "ts", F.when(F.col("target_id") % 3 == 0, F.col("ts")).alias("read_at"))


def _saved(spark, sf):
    d = Domain(spark, sf)
    rows = bookmarked_articles(_bookmarks(d), d.articles(), d.edges())
    return rows.select("user_id", "article_id", "saved_at", "status", F.size("topics").alias("n_topics"), F.aggregate("topics", F.lit(0).cast("bigint"), lambda a, t: a + t).alias("topic_sum"))


def _which(spark, sf):
    d = Domain(spark, sf)
    asked = d.activity().where("event_type = 'preview_open'").select("user_id", F.col("target_id").alias("article_id"))
    return which_bookmarked(asked, _bookmarks(d))


def _active(spark, sf):
    return active_sessions(_sessions(Domain(spark, sf)), "2024-02-25 00:00:00").select("user_id", "session_id")


def _counts(spark, sf):
    d = Domain(spark, sf)
    return user_counts(d.activity().select("user_id"), bookmarks=_bookmarks(d), sessions=_sessions(d), notifications=_notifications(d))


def _names(spark, sf):
    d = Domain(spark, sf)
    names = d.sources().select("source_id", F.concat(F.substring("title", 1, 3), F.when(F.col("source_id") % 2 == 0, "_").otherwise("#"), F.col("source_id") % 50).alias("name"))
    made = names.withColumn("username", username_from_email(F.concat("name", F.lit("@x.org"))))
    reserved = F.array(*[F.lit(w) for w in ("cus_2", "CUS_4", "admin")])
    return made.select("source_id", "username", username_problem(F.when(F.col("source_id") % 7 == 0, F.concat(F.lit("sys_"), "username")).otherwise(F.col("name")), reserved, "sys_").alias("problem"))


_USERS_SQL = """
, b AS (SELECT user_id, target_id AS article_id, ts AS saved_at FROM activity WHERE event_type = 'bookmark' AND target_id IS NOT NULL),
s AS (SELECT user_id, event_id % 5 AS session_id, max(ts) AS last_seen, min(event_id) % 4 = 0 AS revoked FROM activity GROUP BY 1, 2),
f AS (SELECT event_id, user_id, ts, target_id % 3 = 0 AS is_read FROM activity WHERE event_type = 'impression')"""
QUERIES = {
    "bookmarks": _saved,
    "bookmark_membership": _which,
    "active_sessions": _active,
    "unread_notifications": lambda spark, sf: unread(_notifications(Domain(spark, sf))),
    "newest_notifications": lambda spark, sf: newest_of_each(_notifications(Domain(spark, sf)), "user_id", "ts", "event_id", 3).select("user_id", "event_id", "ts"),
    "user_counts": _counts,
    "usernames": _names,
}
ORACLE_SQL = {
    "bookmarks": with_domain("activity articles edges", _USERS_SQL + """
SELECT x.user_id, x.article_id, x.saved_at, a.status, coalesce(t.n, 0)::INT AS n_topics, coalesce(t.s, 0)::BIGINT AS topic_sum
FROM (SELECT user_id, article_id, max(saved_at) AS saved_at FROM b GROUP BY 1, 2) x JOIN articles a USING (article_id)
LEFT JOIN (SELECT article_id, count(*) AS n, sum(topic_id) AS s FROM edges GROUP BY 1) t USING (article_id)"""),
    "bookmark_membership": with_domain("activity", _USERS_SQL + " SELECT DISTINCT user_id, target_id AS article_id FROM activity WHERE event_type = 'preview_open' AND (user_id, target_id) IN (SELECT user_id, article_id FROM b)"),
    "active_sessions": with_domain("activity", _USERS_SQL + " SELECT user_id, session_id FROM s WHERE NOT revoked AND last_seen >= TIMESTAMP '2024-02-25' - INTERVAL 30 DAY"),
    "unread_notifications": with_domain("activity", _USERS_SQL + " SELECT user_id, count(*) AS unread FROM f WHERE is_read IS NOT TRUE GROUP BY 1"),
    "newest_notifications": with_domain("activity", _USERS_SQL + " SELECT user_id, event_id, ts FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3"),
    "user_counts": with_domain("activity", _USERS_SQL + """
SELECT u.user_id, coalesce(x.n, 0) AS bookmarks, coalesce(y.n, 0) AS sessions, coalesce(z.n, 0) AS notifications FROM (SELECT DISTINCT user_id FROM activity) u
LEFT JOIN (SELECT user_id, count(*) AS n FROM b GROUP BY 1) x USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS n FROM s GROUP BY 1) y USING (user_id)
LEFT JOIN (SELECT user_id, count(*) AS n FROM f GROUP BY 1) z USING (user_id)"""),
    "usernames": with_domain("sources", """
, n AS (SELECT source_id, substr(title, 1, 3) || CASE WHEN source_id % 2 = 0 THEN '_' ELSE '#' END || (source_id % 50) AS name FROM sources),
m AS (SELECT source_id, regexp_replace(lower(name), '[^a-z0-9_]', '_', 'g') AS username, lower(CASE WHEN source_id % 7 = 0 THEN 'sys_' || regexp_replace(lower(name), '[^a-z0-9_]', '_', 'g') ELSE name END) AS x FROM n)
SELECT source_id, username, CASE WHEN NOT regexp_full_match(x, '[a-z0-9_]{3,30}') THEN 'invalid' WHEN starts_with(x, 'sys_') THEN 'prefix' WHEN x IN ('cus_2', 'cus_4', 'admin') THEN 'reserved' END AS problem FROM m"""),
}
