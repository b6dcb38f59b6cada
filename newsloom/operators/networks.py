"""The longest network that holds an address, IPv4 and IPv6 alike.

Addresses and networks that are none match nothing; of equal networks the one with the least values counts; empty tables
locate nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.addresses import address, masks, network
from newsloom.sources.domain import Domain, with_domain


def locate_longest(requests: DataFrame, networks: DataFrame, ip: str = "ip") -> DataFrame:
    """requests with the other columns of the longest of networks (hi, lo, length and those columns) that holds their address;
    null where none does. Columns of these names in requests are replaced.

    Each distinct address meets the networks by an equi-join for every length in use (129 at most), so a lookup costs the same
    however many networks there are and nothing is broadcast but the lengths.
    """
    values = [c for c in networks.columns if c not in ("hi", "lo", "length")]
    kept = [c for c in requests.columns if c not in values]
    nets = networks.where("length IS NOT NULL").groupBy("hi", "lo", "length").agg(F.min(F.struct(*values)).alias("__net"))
    mask_hi, mask_lo = masks(F.col("length"))
    lengths = F.broadcast(nets.select("length").distinct().withColumns({"__mask_hi": mask_hi, "__mask_lo": mask_lo}))
    asked = requests.select(F.col(ip).alias("__ip")).where("__ip IS NOT NULL").distinct().withColumn("__at", address("__ip"))
    masked = asked.crossJoin(lengths).select(
        "__ip", "length", F.col("__at.hi").bitwiseAND(F.col("__mask_hi")).alias("hi"), F.col("__at.lo").bitwiseAND(F.col("__mask_lo")).alias("lo"))
    found = masked.join(nets, ["hi", "lo", "length"]).groupBy("__ip").agg(F.max_by("__net", "length").alias("__net"))
    out = requests.select(*kept).join(found, requests[ip] == found["__ip"], "left")
    return out.select(*[F.col(c) for c in kept], *[F.col(f"__net.{c}").alias(c) for c in values])


def networks_of(rows: DataFrame, text: str = "network") -> DataFrame:
    """hi, lo, length in place of networks written `address/length`; rows that are none are left out."""
    cut = rows.withColumn("__n", network(text)).where("__n IS NOT NULL")
    return cut.select("__n.*", *[c for c in rows.columns if c != text])


def _prefixes(spark, sf):
    """Events located in nested networks of the customers: IPv4 ones of 8 to 24 bits, IPv6 ones of 32 to 80."""
    d = Domain(spark, sf)
    k = F.col("c_custkey")
    part = lambda n, by: F.pmod(F.floor(n / by), F.lit(256))
    v4 = F.concat_ws("", F.format_string("10.%d.%d.%d/%d", F.pmod(k, F.lit(7)), part(k, 7), part(k, 11), 8 + F.pmod(k, F.lit(17))))
    v6 = F.format_string("2001:db8:%x::%x:0/%d", F.pmod(k, F.lit(13)), F.pmod(k, F.lit(65536)), 32 + 16 * F.pmod(k, F.lit(4)))
    nets = d.table("customer").select(F.when(k % 2 == 0, v4).otherwise(v6).alias("network"), k.alias("asn"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("country"))
    e = F.col("event_id")
    ip = F.when(e % 3 == 0, F.format_string("2001:DB8:%x::%x", F.pmod(e, F.lit(17)), F.pmod(e, F.lit(65536)))).when(
        e % 3 == 1, F.format_string("10.%d.%d.%d", F.pmod(e, F.lit(9)), part(e, 9), part(e, 5))).otherwise(F.format_string("::ffff:10.%d.%d.9", F.pmod(e, F.lit(8)), part(e, 3)))
    return locate_longest(d.table("events").select("event_id", ip.alias("ip")), networks_of(nets)).select("event_id", "country", "asn")


QUERIES = {"geo_prefixes": _prefixes}
ORACLE_SQL = {
    "geo_prefixes": with_domain("", """
n AS (SELECT c_custkey AS asn, 'N' || c_nationkey AS country, CASE WHEN k % 2 = 0 THEN 104 + k % 17 ELSE 32 + 16 * (k % 4) END AS len,
  CASE WHEN k % 2 = 0 THEN ((10 * 256 + k % 7) * 256 + (k // 7) % 256) * 256 + (k // 11) % 256
    ELSE ((((8193::HUGEINT * 65536 + 3512) * 65536 + k % 13) * 65536) * 18446744073709551616::HUGEINT) + (k % 65536)::HUGEINT * 65536 END AS a FROM (SELECT *, c_custkey::HUGEINT AS k FROM customer)),
p AS (SELECT len, a // (2::HUGEINT ** (128 - len))::HUGEINT AS prefix, min({'asn': asn, 'country': country}) AS v FROM (SELECT len::INT AS len, a, country, asn FROM n) GROUP BY 1, 2),
e AS (SELECT event_id, CASE WHEN k % 3 = 0 THEN ((((8193::HUGEINT * 65536 + 3512) * 65536 + k % 17) * 65536) * 18446744073709551616::HUGEINT) + k % 65536
  WHEN k % 3 = 1 THEN ((10 * 256 + k % 9) * 256 + (k // 9) % 256) * 256 + (k // 5) % 256
  ELSE ((10 * 256 + k % 8) * 256 + (k // 3) % 256) * 256 + 9 END AS a FROM (SELECT event_id, event_id::HUGEINT AS k FROM events)),
m AS (SELECT event_id, max({'len': p.len, 'v': p.v}) AS m FROM (SELECT e.*, l.len, e.a // (2::HUGEINT ** (128 - l.len))::HUGEINT AS prefix FROM e, (SELECT DISTINCT len FROM p) l) x
  JOIN p ON p.len = x.len AND p.prefix = x.prefix GROUP BY 1)
SELECT event_id, m.v.country AS country, m.v.asn AS asn FROM e LEFT JOIN m USING (event_id)""").replace("WITH  \n", "WITH "),
}
