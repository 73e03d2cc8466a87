"""Mixing sources to target weights by Sainte-Laguë apportionment (operator 10).

Every source has a target number of words. Whole passes over a source are taken
outright; what is left is cut into equal blocks, apportioned to (source, shard)
by highest quotients, and the blocks of a shard are chosen by a seeded
permutation. Only sizes are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, stash

WEIGHTS = (1.0, 2.0, 3.0)
#: Most passes over one source, and so over one document.
CAP = 3
#: Words in a block.
BLOCK = 32
#: Words in a shard, and most shards of one source.
SHARD, MOST_SHARDS = 1 << 20, 4096
#: Odd prime over any number of blocks in a shard: steps through the blocks of a shard in a scattered order.
STRIDE = 2147483647


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, source and the number of words of every document (null text: 0)."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), count_words(F.col("text")).alias("size"))


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target: all words shared by weight, at most ``cap`` times a source, the rest reshared.

    Sources stand in code point order, null last, and the weights repeat along it. The shares are found at once:
    sources sorted by the level at which they meet their cap; the first level that holds is everyone's.
    The table has a row a source, so its windows are small.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weigh = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weigh).withColumn("limit", (F.col("source_size") * cap).cast("double"))
    ranked = ranked.withColumn("meets", F.col("limit") / F.col("weight"))
    order = Window.orderBy("meets", "rank")
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", level)
    held = F.min(F.when(F.col("level") <= F.col("meets"), F.struct("meets", "rank", "level"))).over(Window.partitionBy())["level"]
    ranked = ranked.withColumn("share", F.coalesce(held, F.lit(0.0)) * F.col("weight"))
    return ranked.select("source", "source_size", F.least("share", "limit").alias("target"))


def quotas(shards: DataFrame, block: int = BLOCK) -> DataFrame:
    """Sainte-Laguë: ``quota`` blocks for every row of (source, shard, shard_size, claim), claim in words.

    The quotients of row i are claim / (2k + 1). Rounding claim / divisor misses the number of seats by at most half
    the rows, so each row's last seats are uncertain only within a band around its rounded share; the quotients in
    the bands are ranked, the rest is certain. Ties go to the smaller source, then shard.
    """
    every = Window.partitionBy()
    rows = shards.withColumn("n", F.count(F.lit(1)).over(every)).withColumn("all", F.sum("claim").over(every))
    rows = rows.withColumn("seats", F.floor(F.col("all") / block + 0.5)).filter("seats > 0")
    rows = rows.withColumn("near", F.col("claim") / F.col("all") * F.col("seats"))
    band = F.ceil(2.0 * F.col("near") * F.col("n") / F.col("seats")) + 2
    rows = rows.withColumn("sure", F.greatest(F.lit(0), F.floor("near") - band)).withColumn("top", F.floor("near") + band)
    rows = rows.withColumn("open", F.col("seats") - F.sum("sure").over(every))
    ranked = rows.withColumn("k", F.explode(F.sequence("sure", "top"))).withColumn("quotient", F.col("claim") / (2 * F.col("k") + 1))
    place = F.row_number().over(Window.orderBy(F.col("quotient").desc(), F.col("source").asc_nulls_last(), "shard", "k"))
    won = ranked.withColumn("won", (place <= F.col("open")) & (F.col("quotient") > 0))
    return won.groupBy("source", "shard").agg((F.first("sure") + F.sum(F.col("won").cast("long"))).alias("quota"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, block: int = BLOCK, shard: int = SHARD, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs`` (doc_id, source, text).

    taken counts words with repeats, at most ``cap`` times the size. Null and empty texts have size 0 and nothing is
    taken from them; a null source is a source of its own. Repeated rows are rows of their own; ties in the order of a
    shard fall to rows that are equal in all that matters. An empty table gives an empty result; other columns are
    ignored. Reruns give the same rows: order and choice hang on hashes of ids with ``seed``.
    """
    sizes = stash(sizes_of(docs), "mix-sizes")
    goal = stash(targets(sizes, weights, cap), "mix-targets")
    goal = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.col("source_size") + 1e-12))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
    goal = goal.withColumn("rest", F.when(F.col("passes") >= cap, 0.0).otherwise(F.col("rest")))
    goal = goal.withColumn("shards", F.greatest(F.lit(1), F.least(F.lit(MOST_SHARDS), F.ceil(F.col("source_size") / shard))).cast("long")).withColumnRenamed("source", "of")
    rows = sizes.join(goal, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("shards")))
    each = rows.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("rest").alias("rest"), F.first("source_size").alias("total"))
    each = each.withColumn("claim", F.when(F.col("total") > 0, F.col("rest") * F.col("shard_size") / F.col("total")).otherwise(0.0))
    quota = stash(quotas(each.select("source", "shard", "shard_size", "claim"), block), "mix-quotas").toDF("q_source", "q_shard", "quota")

    dealt = Window.partitionBy("source", "shard")
    rows = rows.withColumn("mixed", F.xxhash64(F.lit(seed + 1), "doc_id"))
    rows = rows.withColumn("end", F.sum("size").over(dealt.orderBy("mixed", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("blocks", F.ceil(F.sum("size").over(dealt) / block))
    rows = rows.join(quota, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")), "left")
    rows = rows.withColumn("quota", F.coalesce("quota", F.lit(0))).withColumn("begin", F.col("end") - F.col("size"))
    rows = rows.withColumn("turn", F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.col("blocks"))).otherwise(0))

    def chosen(j):
        return F.pmod(j * F.lit(STRIDE) + F.col("turn"), F.col("blocks")) < F.col("quota")

    def overlap(j):
        return F.least((j + 1) * block, F.col("end")) - F.greatest(j * block, F.col("begin"))

    covered = F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))
    part = F.when((F.col("size") > 0) & (F.col("quota") > 0), F.aggregate(covered, F.lit(0).cast("long"), lambda s, j: s + F.when(chosen(j), overlap(j)).otherwise(0).cast("long"))).otherwise(0)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + part).cast("long").alias("taken"))
