"""Relational operators: order-preserving dedupe, argmax, folds, frontiers, bridges, lateral arrays, scored orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """First row of each key in ``order``: one shuffle, rows of a key reduce before it."""
    packed = df.select(F.struct(*df.columns).alias("row"), F.struct(*[F.expr(o) if isinstance(o, str) else o for o in order]).alias("at"), F.struct(*[F.col(k) if isinstance(k, str) else k for k in keys]).alias("key"))
    return packed.groupBy("key").agg(F.min_by("row", "at").alias("row")).select("row.*")


def best_by(df: DataFrame, keys: list[str], score: Column, seq: str) -> DataFrame:
    """Row of highest score of each key; the first of equals."""
    return keep_first(df.withColumn("_s", -score), keys, [F.col("_s"), F.col(seq)]).drop("_s")


def buckets(results: DataFrame) -> DataFrame:
    """Search results (seq, domain, homepage, title, url, description, query) by domain: homepage of the first, all results in order, sorted queries."""
    rows = results.groupBy("domain").agg(F.min_by("homepage", "seq").alias("homepage"), F.array_sort(F.collect_list(F.struct("seq", "title", "url", "description", "query"))).alias("results"), F.array_sort(F.collect_set("query")).alias("queries"))
    return rows


def fold_metadata(pages: DataFrame, key: str, seq: str, fields: list[str], text: str, links: str) -> DataFrame:
    """First non-empty value of each field in order, texts joined, links united in order."""
    first = [F.min_by(F.nullif(F.col(f), F.lit("")), F.when(F.col(f) != "", F.col(seq))).alias(f) for f in fields]
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(text).alias("text"), F.col(links).alias("links"))))
    out = pages.groupBy(key).agg(*first, ordered.alias("_o"))
    joined = F.array_join(F.filter(F.transform("_o", lambda x: x["text"]), lambda t: t != ""), " ")
    return out.select(key, *(F.coalesce(f, F.lit("")).alias(f) for f in fields), joined.alias(text), F.array_distinct(F.flatten(F.transform("_o", lambda x: F.coalesce(x["links"], F.array().cast("array<string>"))))).alias(links))


def not_blocked(df: DataFrame, domain: str, blocked: DataFrame) -> DataFrame:
    """Rows whose domain neither is nor lies under one of ``blocked`` (domain).

    Each domain is cut into its own suffixes, so that the test is an equi-join and not a nested loop.
    """
    parts = F.split(F.col(domain), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    names = df.select(domain).distinct()
    hit = names.select(domain, F.explode(suffixes).alias("_b")).join(blocked.select(F.col("domain").alias("_b")), "_b", "left_semi").select(domain).distinct()
    return df.join(hit, domain, "left_anti").filter(F.col(domain) != "")


def frontier(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates (store_id, source_url, ...) that are not stored yet; a null store is a store."""
    old = existing.select(F.col("store_id").alias("_s"), F.col("source_url").alias("_u"))
    return candidates.join(old, F.col("store_id").eqNullSafe(F.col("_s")) & (F.col("source_url") == F.col("_u")), "left_anti")


def lateral_names(parents: DataFrame, bridge: DataFrame, names: DataFrame, key: str, ref: str, out: str) -> DataFrame:
    """``parents`` with the sorted names that the bridge (key, ref) leads to; an empty array without any."""
    found = bridge.join(names, ref).groupBy(key).agg(F.array_sort(F.collect_list("name")).alias(out))
    return parents.join(found, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def missing(items: DataFrame, embedded: DataFrame, key: str, mode: str = "missing") -> DataFrame:
    if mode not in ("missing", "full"):
        raise ValueError("mode must be missing or full")
    return items.join(embedded.select(key), key, "left_anti") if mode == "missing" else items


def active_items(items: DataFrame, listings: DataFrame, relations: DataFrame) -> DataFrame:
    """Items with a confirmed listing, whether one is approved, and whether the item extends another."""
    # one row an item, so that the joins are existence tests; rows of a hot item reduce before the shuffle
    listed = listings.groupBy(F.col("item_id").alias("_i")).agg(F.max(F.col("confirmed")).alias("_c"), F.coalesce(F.max(F.col("status") == "APPROVED"), F.lit(False)).alias("_a")).filter("_c").drop("_c")
    extends = relations.filter("link_type = 'extension'").select(F.col("item_a_id").alias("_e")).distinct()
    held = items.join(listed, F.col("item_id") == F.col("_i")).join(extends, F.col("item_id") == F.col("_e"), "left")
    return held.select(*(items[c] for c in items.columns), F.col("_a").alias("has_approved_listing"), F.col("_e").isNotNull().alias("is_expansion"))


def nearby_rows(rows: DataFrame, group: str, pos: str, is_link: str, text: str, before: int = 3, after: int = 7) -> DataFrame:
    """(group, pos, context) of each link row: text rows around it, not past another link. Windows only, no join."""
    w = Window.partitionBy(group).orderBy(pos)
    ahead, behind = F.collect_list(F.struct(pos, is_link, text)).over(w.rowsBetween(-before, -1)), F.collect_list(F.struct(pos, is_link, text)).over(w.rowsBetween(1, after))
    held = rows.withColumn("_b", ahead).withColumn("_a", behind).filter(F.col(is_link))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("done"))

    def step(front: bool):
        def take(s: Column, e: Column) -> Column:
            kept = F.concat(F.array(e[text]), s["kept"]) if front else F.concat(s["kept"], F.array(e[text]))
            return F.when(s["done"] | e[is_link], F.struct(s["kept"].alias("kept"), F.lit(True).alias("done"))).otherwise(F.struct(kept.alias("kept"), F.lit(False).alias("done")))

        return take

    return held.select(group, pos, F.array_join(F.concat(F.aggregate(F.reverse("_b"), start, step(True), lambda s: s["kept"]), F.aggregate("_a", start, step(False), lambda s: s["kept"])), " ").alias("context"))


def query_strings(core: DataFrame, places: DataFrame, templates: list[str]) -> DataFrame:
    """Core queries (seq, query) and each template (with %s) for each place (seq, place), first of equals by case-folded text."""
    filled = places.select((F.col("seq") + 1_000_000).alias("seq"), F.posexplode(F.array(*(F.replace(F.lit(t), F.lit("%s"), F.col("place")) for t in templates))).alias("k", "query"))
    every = core.select("seq", F.lit(0).alias("k"), "query").unionByName(filled)
    return keep_first(every, [F.lower("query")], ["seq", "k"]).select("seq", "k", "query")
