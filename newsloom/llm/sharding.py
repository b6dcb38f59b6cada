"""K-d tree sharding: leaves of near equal bytes, split at distributed weighted medians of the widest dimension.

DataFrame functions only. Each level of the tree takes one aggregate (the widest dimension of every open node) and
four histograms: the 63-bit key of that dimension is refined 16 bits at a time, so the cut is an exact weighted
quantile although no task ever sorts the rows. Only the tree itself (one cut for each shard but one) reaches the
driver; rows find their side by an expression, without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import materialize, number_rows, small, table

SHARDS = 24
#: Equal texts of such a part of a shard at most stay together.
WHOLE = 32
_DIGITS = ((48, 0x7FFF), (32, 0xFFFF), (16, 0xFFFF), (0, 0xFFFF))


def dimension_key(value: Column, low: Column, high: Column, tie: Column) -> Column:
    """31 bits of the value's place between low and high (null: 0), then 32 bits that break ties evenly."""
    place = F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))
    place = F.coalesce(F.when(F.isnan(place), F.lit(0.0)).otherwise(place), F.lit(0.0))
    return F.shiftleft((place * (2**31 - 1)).cast("long"), 32).bitwiseOR(tie.bitwiseAND(F.lit(0xFFFFFFFF)))


def _of_node(values: dict[int, float], shards: int, kind: str) -> Column:
    """values[__node], from an array literal of one entry for each shard."""
    return F.element_at(F.array(*[F.lit(values.get(i, 0)).cast(kind) for i in range(shards)]), F.col("__node") + 1)


def kd_split(keyed: DataFrame, axes: list[str], weight: str, shards: int, out: str) -> DataFrame:
    """keyed, with 63-bit keys in `axes` and a positive `weight`, plus the leaf (0 to shards - 1) in `out`.

    A node is named by its first shard. Every cut gives its sides weights in proportion to their shards, up to the
    weight of one row. One slim table is written for each level, log2(shards) in all.
    """
    open_nodes = {0: shards} if shards > 1 else {}
    at = keyed.withColumn("__node", F.lit(0))
    while open_nodes:
        live = at.where(F.col("__node").isin(list(open_nodes)))
        spans = live.groupBy("__node").agg(
            F.sum(weight).alias("w"), *[(F.max(a) - F.min(a)).alias(f"span{i}") for i, a in enumerate(axes)]).collect()  # one row a node
        axis = {r["__node"]: max(range(len(axes)), key=lambda i, r=r: r[f"span{i}"]) + 1 for r in spans}
        goal = {r["__node"]: r["w"] * (open_nodes[r["__node"]] // 2) / open_nodes[r["__node"]] for r in spans}
        key = F.element_at(F.array(*axes), F.greatest(_of_node(axis, shards, "int"), F.lit(1)))
        prefix, below, cut = dict.fromkeys(axis, 0), dict.fromkeys(axis, 0), {}
        for shift, mask in _DIGITS:
            part = live.withColumn("__key", key)
            if shift != _DIGITS[0][0]:
                part = part.where(F.shiftright("__key", shift + 16) == _of_node(prefix, shards, "long"))
            bins = part.groupBy("__node", F.shiftright("__key", shift).bitwiseAND(F.lit(mask)).alias("digit")).agg(F.sum(weight).alias("w"))
            running = F.sum("w").over(Window.partitionBy("__node").orderBy("digit"))  # at most 65,536 bins a node
            rest = _of_node({n: goal[n] - below[n] for n in axis}, shards, "double")
            crossing = bins.withColumn("cum", running).groupBy("__node").agg(
                F.min(F.when(F.col("cum") >= rest, F.struct("digit", "cum", "w"))).alias("hit"),
                F.max(F.struct("digit", "cum", "w")).alias("last")).collect()  # one row a node
            for r in crossing:
                n, hit = r["__node"], r["hit"] or r["last"]
                prefix[n] = (prefix[n] << 16) | hit["digit"]
                below[n] += hit["cum"] - hit["w"]
                cut[n] = prefix[n] - (goal[n] - below[n] < hit["w"] / 2)  # the crossing key goes to the nearer side
        step = _of_node({n: k // 2 for n, k in open_nodes.items()}, shards, "int")
        right = F.col("__node").isin(list(open_nodes)) & (key > _of_node(cut, shards, "long"))
        at = materialize(at.withColumn("__node", F.col("__node") + F.when(right, step).otherwise(0)))
        halves = [h for n, k in open_nodes.items() for h in ((n, k // 2), (n + k // 2, k - k // 2))]
        open_nodes = {n: k for n, k in halves if k > 1}
    return at.withColumnRenamed("__node", out)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) for every row of docs.

    Size is the text's UTF-8 bytes plus 8 (null text: 8). The dimensions are log size, language, source and doc_id;
    a null language or source is a value of its own, a null doc_id counts as the least. Equal texts (null and empty are
    equal) stay in one shard where they take no more bytes than the largest row or a WHOLE-th of a shard: they all have the
    place of their first row. Larger groups, which would make shards unequal, part by doc_id. Rows that repeat a doc_id
    and a text share a shard. An empty table gives no rows; other columns are ignored.
    """
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("words"),
        *[(F.crc32(F.coalesce(F.col(c), F.lit("")).cast("binary")) / F.lit(2.0**32)).alias(c) for c in ("lang", "source")],
    )
    slim = materialize(slim)
    ends = slim.agg(
        F.count("*").alias("rows"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max("size").alias("s"), F.sum("size").alias("w")).first()
    rows = ends["rows"]
    whole = max(ends["s"] or 0, (ends["w"] or 0) // shards // WHOLE)
    groups = slim.groupBy("words", "text_crc32", "size").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "lang", "source")).alias("first"))
    groups = materialize(groups.where((F.col("c") > 1) & (F.col("c") * F.col("size") <= whole)).drop("c"))
    at = slim.join(small(groups), ["words", "text_crc32", "size"], "left")
    own = lambda c: F.when(F.col("first").isNotNull(), F.col(f"first.{c}")).otherwise(F.col(c)).alias(f"p_{c}")
    at = materialize(at.select("doc_id", "size", "text_crc32", "words", own("doc_id"), own("lang"), own("source")))
    lit = lambda x: F.lit(float(x or 0))
    dims = {
        "k_size": (F.log(F.col("size").cast("double")), lit(2.0794415), F.log(F.lit(float(max(ends["s"] or 9, 9))))),
        "k_lang": (F.col("p_lang"), lit(0), lit(1)),
        "k_source": (F.col("p_source"), lit(0), lit(1)),
        "k_id": (F.col("p_doc_id").cast("double"), lit(ends["a"]), lit(ends["b"])),
    }
    keys = {a: dimension_key(v, lo, hi, F.xxhash64("words", "p_doc_id", F.lit(a))) for a, (v, lo, hi) in dims.items()}
    keyed = at.withColumns(keys)
    placed = kd_split(keyed, list(keys), "size", shards, "shard").select("doc_id", "size", "text_crc32", "shard")
    return number_rows(placed, "shard", ["doc_id", "text_crc32", "size"], "slot", rows).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op8_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op8_kd_sharding": op8_kd_sharding}
ORACLE_SQL: dict[str, str] = {}
