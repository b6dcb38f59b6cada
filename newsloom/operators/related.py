"""Related articles by IDF-weighted topic overlap, for all source articles at once.

Null ids and times relate to nothing, repeated edges count as often as they occur, ties end with the id, and empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.sources.domain import Domain, with_domain

FORMULAS = ("coverage", "source", "max", "jaccard")


def topic_idf(edges: DataFrame) -> DataFrame:
    """topic_id, df, idf = max(0, ln(N / df)); N counts articles that have any topic."""
    total = edges.agg(F.count_distinct("article_id").alias("total"))
    df = edges.groupBy("topic_id").agg(F.count_distinct("article_id").alias("df"))
    return df.crossJoin(F.broadcast(total)).select("topic_id", "df", F.greatest(F.lit(0.0), F.log(F.col("total") / F.greatest(F.lit(1), F.col("df")))).alias("idf"))


def _overlap(formula: str) -> Column:
    i, a, b = F.col("inter"), F.col("a_weight"), F.col("b_weight")
    by = {
        "coverage": F.greatest(i / a, F.when(b == 0, 1.0).otherwise(i / F.nullif(b, F.lit(0.0)))),
        "source": i / a,
        "max": i / F.greatest(a, b),
        "jaccard": i / (a + b - i),
    }
    return by[formula]


def related_articles(articles: DataFrame, edges: DataFrame, formula: str = "coverage", days: int = 15, min_overlap: float = 0.4,
                     strong_single: float = 4.0, min_inter: float = 3.0, limit: int = 20) -> DataFrame:
    """article_id, other_id, n_shared, overlap, rank: the related articles of every dated article with weighted topics.

    Candidates are indexed, within `days` of the article and share a topic; one shared topic must weigh strong_single,
    several min_inter together. Ranked by shared topics, overlap, time distance, then id. Articles meet by topic and by
    span of `days`, each candidate in its own span and both next to it, so a topic's articles of other times never meet;
    within a span AQE splits a frequent topic. Articles without date or weight have no related ones.
    """
    weighted = edges.join(topic_idf(edges).select("topic_id", "idf"), "topic_id").select("article_id", "topic_id", "idf")
    sums = weighted.groupBy("article_id").agg(F.sum("idf").alias("weight"))
    dated = articles.where("published_at IS NOT NULL").join(sums, "article_id")
    span = F.floor(F.unix_seconds(F.col("published_at").cast("timestamp")) / (days * 86_400))
    left = dated.where("weight > 0").select("article_id", F.col("published_at").alias("a_time"), F.col("weight").alias("a_weight"), span.alias("span"))
    right = dated.where("status = 'indexed'").select(
        F.col("article_id").alias("other_id"), F.col("published_at").alias("b_time"), F.col("weight").alias("b_weight"), span.alias("own"))
    a = weighted.join(left, "article_id")
    b = weighted.withColumnRenamed("article_id", "other_id").drop("idf").join(right, "other_id").withColumn(
        "span", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1))).drop("own")
    near = F.col("b_time").between(F.col("a_time") - F.make_dt_interval(F.lit(days)), F.col("a_time") + F.make_dt_interval(F.lit(days)))
    pairs = a.join(b, ["topic_id", "span"]).where((F.col("article_id") != F.col("other_id")) & near)
    both = pairs.groupBy("article_id", "other_id", "a_time", "b_time", "a_weight", "b_weight").agg(F.count("*").alias("n_shared"), F.sum("idf").alias("inter"))
    gate = F.when(F.col("n_shared") == 1, F.col("inter") >= strong_single).otherwise(F.col("inter") >= min_inter)
    kept = both.where(gate).withColumn("overlap", F.round(_overlap(formula), 6)).where(F.col("overlap") >= min_overlap)
    gap = F.abs(F.timestamp_diff("SECOND", F.col("a_time"), F.col("b_time")))
    w = Window.partitionBy("article_id").orderBy(F.desc("n_shared"), F.desc("overlap"), gap, "other_id")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("article_id", "other_id", "n_shared", "overlap", "rank")


_OVERLAP_SQL = {
    "coverage": "greatest(inter / a.weight, CASE WHEN b.weight = 0 THEN 1.0 ELSE inter / b.weight END)",
    "source": "inter / a.weight",
    "max": "inter / greatest(a.weight, b.weight)",
    "jaccard": "inter / (a.weight + b.weight - inter)",
}


#: Overlaps are smaller by these formulas.
_LEAST = {"jaccard": 0.1, "max": 0.2}


def _related_sql(formula: str, strong: float) -> str:
    return with_domain("articles edges", f"""
, n AS (SELECT count(DISTINCT article_id) AS total FROM edges),
i AS (SELECT topic_id, greatest(0.0::DOUBLE, ln(total / greatest(1, count(DISTINCT article_id)))) AS idf FROM edges, n GROUP BY topic_id, total),
w AS (SELECT e.article_id, e.topic_id, idf FROM edges e JOIN i USING (topic_id)),
s AS (SELECT article_id, sum(idf) AS weight, any_value(published_at) AS t, any_value(status) AS status FROM w JOIN articles USING (article_id) GROUP BY 1),
p AS (SELECT x.article_id AS a_id, y.article_id AS b_id, count(*) AS n_shared, sum(x.idf) AS inter FROM w x JOIN w y USING (topic_id) WHERE x.article_id <> y.article_id GROUP BY 1, 2),
o AS (SELECT a_id, b_id, n_shared, round({_OVERLAP_SQL[formula]}, 6) AS overlap, abs(date_diff('second', a.t, b.t)) AS gap
  FROM p JOIN s a ON a.article_id = a_id JOIN s b ON b.article_id = b_id
  WHERE a.weight > 0 AND b.status = 'indexed' AND b.t BETWEEN a.t - INTERVAL 15 DAY AND a.t + INTERVAL 15 DAY
    AND CASE WHEN n_shared = 1 THEN inter >= {strong} ELSE inter >= 3.0 END)
SELECT a_id AS article_id, b_id AS other_id, n_shared, overlap, CAST(row_number() OVER (PARTITION BY a_id ORDER BY n_shared DESC, overlap DESC, gap, b_id) AS INT) AS "rank"
FROM o WHERE overlap >= {_LEAST.get(formula, 0.4)} QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY n_shared DESC, overlap DESC, gap, b_id) <= 20""")


def _query(formula: str, strong: float = 4.0):
    return lambda spark, sf: related_articles((d := Domain(spark, sf)).articles(), d.edges(), formula, min_overlap=_LEAST.get(formula, 0.4), strong_single=strong)


def _idf(spark, sf):
    return topic_idf(Domain(spark, sf).edges()).withColumn("idf", F.round("idf", 6))


def _idf_median(spark, sf):
    return topic_idf(Domain(spark, sf).edges()).agg(F.round(F.median("idf"), 6).alias("median_idf"), F.count("*").alias("topics"))


_IDF_SQL = with_domain("edges", """
, n AS (SELECT count(DISTINCT article_id) AS total FROM edges),
i AS (SELECT topic_id, count(DISTINCT article_id) AS df, greatest(0.0::DOUBLE, ln(total / greatest(1, count(DISTINCT article_id)))) AS idf FROM edges, n GROUP BY topic_id, total)""")
QUERIES = {f"related_{f}": _query(f) for f in FORMULAS} | {"related_articles": _query("coverage", 6.2), "topic_idf": _idf, "idf_median": _idf_median}
ORACLE_SQL = {f"related_{f}": _related_sql(f, 4.0) for f in FORMULAS} | {
    "related_articles": _related_sql("coverage", 6.2),
    "topic_idf": _IDF_SQL + " SELECT topic_id, df, round(idf, 6) AS idf FROM i",
    "idf_median": _IDF_SQL + " SELECT round(median(idf), 6) AS median_idf, count(*) AS topics FROM i",
}
