"""Traffic rules over request logs: address ranges, block decisions in order, scanner paths, exempt routes.

Null addresses, agents and paths match no rule, and empty rule tables block nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.sources.domain import Domain, with_domain


def locate(requests: DataFrame, networks: DataFrame) -> DataFrame:
    """requests: ip (long); networks: first, last, country, asn. Adds country and asn of the narrowest network that holds the
    ip, by first address and country where several are as narrow; null where none does, or for a null ip. Columns of these
    names in requests are replaced.

    A network is a few prefixes of addresses: it is cut into blocks of 2^k addresses that begin at multiples of 2^k, at
    most two for each k. Distinct ips meet blocks by (k, ip >> k), an equi-join with one row for each width in use."""
    kept = [c for c in requests.columns if c not in ("country", "asn")]
    wide = networks.where("first <= last").select(F.col("first").alias("lo"), F.col("last").alias("hi"), F.col("country").alias("to_country"), F.col("asn").alias("to_asn"))
    ks = F.explode(F.expr("sequence(0, 32)"))
    # of width k: the block at the lower edge, if the next wider one would begin below lo, and likewise at the upper edge
    at = wide.withColumn("k", ks).withColumns({"a": F.expr("shiftright(lo + shiftleft(1L, k) - 1, k)"), "b": F.expr("shiftright(hi + 1, k)")}).where("a < b")
    edges = F.array(F.when(F.expr("a % 2 = 1 OR 2 * shiftright(a + 1, 1) + 2 > b AND a < b"), F.col("a")), F.when(F.expr("b % 2 = 1 OR 2 * shiftright(a + 1, 1) + 2 > b"), F.col("b") - 1))
    blocks = at.select("lo", "hi", "to_country", "to_asn", "k", F.explode(F.array_distinct(F.filter(edges, lambda x: x.isNotNull()))).alias("block"))
    widths = F.broadcast(blocks.select("k").distinct())  # 33 at most
    asked = requests.where("ip IS NOT NULL").select("ip").distinct().crossJoin(widths).withColumn("block", F.expr("shiftright(ip, k)"))
    hit = asked.join(blocks, ["k", "block"]).groupBy("ip").agg(F.min_by(F.struct("to_country", "to_asn"), F.struct(F.col("hi") - F.col("lo"), "lo", "to_country")).alias("n"))
    return requests.select(*kept).join(hit, "ip", "left").select(*kept, F.col("n.to_country").alias("country"), F.col("n.to_asn").alias("asn"))


def scanner_path(path: Column, parts: list[str]) -> Column:
    """Whether a path holds one of the parts, in any case."""
    low = F.lower(F.coalesce(path, F.lit("")))
    return F.exists(F.array(*[F.lit(p.lower()) for p in parts]), lambda p: F.contains(low, p)) if parts else F.lit(False)


def exempt(path: Column, exact: list[str], prefixes: list[str]) -> Column:
    out = path.isin(*exact)
    for p in prefixes:
        out = out | path.startswith(p)
    return F.coalesce(out, F.lit(False))


def block_reason(requests: DataFrame, ips: DataFrame, agents: list[str], countries: DataFrame, asns: DataFrame, now, parts: list[str]) -> DataFrame:
    """requests (ip, ua, country, asn, path) with reason: ip, ua, country, asn, scanner or null, the first that holds.
    Bans (ips: ip, expires_at) hold without an expiry or until it."""
    active = ips.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))).select("ip").distinct().withColumn("by_ip", F.lit(True))
    marked = (
        requests.join(active, "ip", "left").join(countries.select("country").distinct().withColumn("by_country", F.lit(True)), "country", "left")
        .join(asns.select("asn").distinct().withColumn("by_asn", F.lit(True)), "asn", "left")
    )
    reason = (
        F.when(F.col("by_ip"), "ip").when(scanner_path(F.col("ua"), agents), "ua").when(F.col("by_country"), "country")
        .when(F.col("by_asn"), "asn").when(scanner_path(F.col("path"), parts), "scanner")
    )
    return marked.withColumn("reason", reason).drop("by_ip", "by_country", "by_asn")


def _networks(d: Domain) -> DataFrame:
    """A network of 60 addresses for each nation, 100 apart."""
    return d.table("nation").select(
        (F.col("n_nationkey").cast("long") * 100).alias("first"), (F.col("n_nationkey").cast("long") * 100 + 59).alias("last"), F.col("n_name").alias("country"),
        (F.col("n_nationkey").cast("long") % 7).alias("asn"))


def _requests(d: Domain) -> DataFrame:
    return d.activity().select(
        "event_id", "ts", (F.col("user_id") * 37 % 2500).alias("ip"),
        F.when(F.col("target_id") % 11 == 0, "EvilBot/1.0").otherwise("Mozilla").alias("ua"),
        F.when(F.col("target_id") % 13 == 0, "/x/WP-Login.php").otherwise("/feed").alias("path"))


def _located(spark, sf):
    d = Domain(spark, sf)
    return locate(_requests(d), _networks(d)).select("event_id", "country", "asn")


def _blocked(spark, sf):
    d = Domain(spark, sf)
    nets = _networks(d)
    bans = d.activity().where("status = 500 AND target_id < 30").select((F.col("user_id") * 37 % 2500).alias("ip"), (F.col("ts") + F.expr("INTERVAL '24' HOUR")).alias("expires_at"))
    out = block_reason(
        locate(_requests(d), nets), bans, ["evilbot"], nets.where("first % 400 = 0").select("country"), nets.where("asn = 3").select("asn"), "2024-01-29 00:00:00", ["wp-login"])
    return out.select("event_id", "reason")


_SQL = """
, n AS (SELECT n_nationkey::BIGINT * 100 AS f, n_nationkey::BIGINT * 100 + 59 AS l, n_name AS country, n_nationkey::BIGINT % 7 AS asn FROM nation),
r AS (SELECT event_id, ts, target_id, user_id * 37 % 2500 AS ip FROM activity),
g AS (SELECT r.*, country, asn FROM r LEFT JOIN n ON ip BETWEEN f AND l)"""
QUERIES = {"geo_lookup": _located, "block_decisions": _blocked}
ORACLE_SQL = {
    "geo_lookup": with_domain("activity", _SQL + " SELECT event_id, country, asn FROM g"),
    "block_decisions": with_domain("activity", _SQL + """
, b AS (SELECT DISTINCT user_id * 37 % 2500 AS ip FROM activity WHERE status = 500 AND target_id < 30 AND ts + INTERVAL 24 HOUR > TIMESTAMP '2024-01-29')
SELECT event_id, CASE WHEN ip IN (SELECT ip FROM b) THEN 'ip' WHEN target_id % 11 = 0 THEN 'ua' WHEN country IN (SELECT country FROM n WHERE f % 400 = 0) THEN 'country'
  WHEN asn = 3 THEN 'asn' WHEN target_id % 13 = 0 THEN 'scanner' END AS reason FROM g"""),
}
