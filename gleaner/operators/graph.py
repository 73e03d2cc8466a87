"""Frontier loops: reachability over links, and the sitemap worklist. Each round is one join against what was seen."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: where shops keep the map of their products.
WELL_KNOWN = "/product-sitemap.xml"


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in the folder that ``spark.checkpoint.dir`` names; a local session without one gets its own."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="gleaner-"))
    return df.checkpoint()


def closure(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(seed, id, hops): all that each seed reaches over ``edges`` (src, dst), itself at 0; cycles end at what was seen."""
    links = settle(edges.select("src", "dst").distinct())
    seen = front = settle(seeds.select(F.col("id").alias("seed"), F.col("id"), F.lit(0).alias("hops")).distinct())
    hops = 0
    while most is None or hops < most:
        hops += 1
        step = front.join(links, front["id"] == links["src"]).select("seed", F.col("dst").alias("id")).distinct()
        front = settle(step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("hops", F.lit(hops)))
        if front.isEmpty():
            return seen
        seen = settle(seen.unionByName(front))
    return seen


def crawl(roots: DataFrame, fetched: DataFrame, limit: int | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Product URLs that sitemaps lead to (url), and the pages that were blocked (url).

    ``roots``: url of each store's sitemap; ``fetched``: the snapshot (url, body). Beside its root every store is asked
    for its direct product map (:data:`WELL_KNOWN`). Where a store's root names maps for products, only these are
    followed from there, else all; deeper maps are all followed, once each. Challenge pages give no entries and are
    reported. ``limit`` is a number of URLs a store, in order of round, map and place; a store that has as many is not
    followed further. With ``strict``, stores with blocked pages and no products raise RuntimeError.
    """
    from ..functions import markup, urls

    pages = fetched.withColumn("blocked", markup.is_challenge(F.col("body"), sitemap=True))
    store = lambda c: urls.canonical_domain(F.col(c))
    asked = roots.select("url", store("url").alias("store"), F.lit(True).alias("root"))
    direct = F.concat(F.regexp_extract("url", "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit(WELL_KNOWN))
    front = asked.unionByName(asked.select(direct.alias("url"), "store", F.lit(False).alias("root")))
    front = settle(front.groupBy("url", "store").agg(F.max("root").alias("root")))
    seen, step = front.select("url", "store"), 0
    found = blocked = None
    while True:
        held = settle(front.join(pages, "url"))
        shut = held.filter("blocked").select("url", "store")
        blocked = shut if blocked is None else blocked.unionByName(shut)
        locs = held.filter("NOT blocked").select("url", "store", "root", F.lower("body").contains("<sitemapindex").alias("index"), F.posexplode(markup.locations(F.col("body"))).alias("at", "loc"))
        locs = locs.withColumn("loc", urls.resolve(F.col("url"), F.col("loc"))).filter(store("loc") == F.col("store"))
        place = F.struct(F.lit(step).alias("step"), F.col("url").alias("map"), "at")
        items = locs.filter(~F.col("index") & urls.is_product(F.col("loc"))).select("store", urls.clean(F.col("loc")).alias("url"), place.alias("place"))
        found = settle((items if found is None else found.unionByName(items)).groupBy("store", "url").agg(F.min("place").alias("place")))
        nested = locs.filter("index").select("store", "root", F.col("loc").alias("url"), F.lower("loc").contains("product").alias("named"))
        # a store's own root decides, and for that store alone
        choosy = nested.filter("root AND named").select("store").distinct()
        ahead = nested.filter("NOT root OR named").unionByName(nested.filter("root AND NOT named").join(choosy, "store", "left_anti"))
        if limit is not None:
            ahead = ahead.join(found.groupBy("store").count().filter(F.col("count") >= limit).select("store"), "store", "left_anti")
        front = settle(ahead.select("url", "store").distinct().join(seen, ["url", "store"], "left_anti").withColumn("root", F.lit(False)))
        if front.isEmpty():
            break
        seen, step = settle(seen.unionByName(front.select("url", "store"))), step + 1
    if strict:
        silent = blocked.join(found, "store", "left_anti").select("store").distinct().limit(5).collect()
        if silent:
            raise RuntimeError(f"protection pages instead of sitemaps: {sorted(r['store'] for r in silent)}")
    if limit is not None:
        found = found.withColumn("_n", F.row_number().over(Window.partitionBy("store").orderBy("place"))).filter(F.col("_n") <= limit)
    return found.select("url").distinct(), blocked.select("url").distinct()
