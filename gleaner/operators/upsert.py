"""Keyed upserts as functions of snapshots: (target, source) -> new target. The caller writes the result as a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settle
from .relate import keep_first


def _match(keys: list[str]) -> Column:
    test = F.lit(True)
    for k in keys:
        test = test & F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
    return test


def upsert(target: DataFrame, source: DataFrame, keys: list[str], kept: tuple[str, ...] = (), filled: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``source`` replace those of equal (null-safe) ``keys`` or are added.

    ``kept`` columns stay as they are in a row that exists; ``filled`` ones take the source's value only where it has one.
    Columns that the source lacks stay, and are null in new rows. Keys must be unique on either side; where the source
    may repeat one, :func:`last_written` goes first.
    """
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), source.withColumn("_s", F.lit(True)).alias("s")
    old, new = F.col("t._t").isNotNull(), F.col("s._s").isNotNull()

    def value(c: str) -> Column:
        if c in keys:
            return F.when(new, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}"))
        if c not in source.columns:
            return F.col(f"t.{c}")
        if c in kept:
            return F.when(old, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}"))
        if c in filled:
            return F.coalesce(f"s.{c}", f"t.{c}")
        return F.when(new, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}"))

    return t.join(s, _match(keys), "full").select(*(value(c).alias(c) for c in target.columns))


def last_written(source: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row a key, the last in order of ``seq``: what writing row after row leaves."""
    return keep_first(source.withColumn("_n", -F.col(seq)), keys, [F.col("_n")]).drop("_n")


#: Slices of new keys when they are numbered. A constant: ids must not depend on how many partitions a session has.
SLICES = 256


def with_ids(target: DataFrame, source: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """``source`` with ids: those of its rows in ``target``, new ones above the largest.

    New keys are dealt to :data:`SLICES` slices by their hash and numbered in order within each, so that no single task
    sees them all and the same rows get the same ids in every session.
    """
    known = settle(source.alias("s").join(target.select(id_col, *keys).alias("t"), _match(keys), "left").select("s.*", F.col(f"t.{id_col}").alias(id_col)))
    top = target.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    fresh = known.filter(F.col(id_col).isNull()).drop(id_col).withColumn("_p", F.pmod(F.xxhash64(*keys), F.lit(SLICES)))
    numbered = fresh.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*(F.col(k).asc_nulls_first() for k in keys))))
    counts = fresh.groupBy("_p").count()
    offsets = counts.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    numbered = numbered.join(offsets, "_p").withColumn(id_col, F.lit(top) + F.col("_o") + F.col("_r")).select(*known.columns)
    return known.filter(F.col(id_col).isNotNull()).unionByName(numbered)


def upsert_items(target: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Item candidates by (store_id, source_url), null-safe: (new target, one result for each source row).

    An existing row keeps its status, item, match columns and processing time; a result says whether to process it:
    if it is new, or has neither item nor match source nor processing time.
    """
    keys, kept = ["store_id", "source_url"], ("id", "listing_status", "item_id", "match_source", "match_payload", "processed_at", "processing_error")
    held = with_ids(target, source, keys, "id")
    after = upsert(target, held, keys, kept=tuple(k for k in kept if k in target.columns))
    pending = F.col("t.item_id").isNull() & (F.coalesce(F.trim("t.match_source"), F.lit("")) == "") & F.col("t.processed_at").isNull()
    result = held.alias("s").join(target.alias("t"), _match(keys), "left")
    status = F.coalesce(F.col("t.listing_status"), F.col("s.listing_status") if "listing_status" in source.columns else F.lit("PENDING"))
    return after, result.select(F.col("s.id").alias("candidate_id"), status.alias("listing_status"), F.col("t.item_id").alias("item_id"), (F.col("t.id").isNull() | pending).alias("should_process"))


def mark_not_matched(target: DataFrame, marks: DataFrame, source_name: str = "none") -> DataFrame:
    """Rows of ``marks`` (id, reasons) are processed without a match."""
    held = target.join(marks.select(F.col("id"), F.col("reasons").alias("_r")), "id", "left")
    hit = F.col("_r").isNotNull()
    return held.withColumns({"match_source": F.when(hit, source_name).otherwise(F.col("match_source")), "match_reasons": F.when(hit, F.col("_r")).otherwise(F.col("match_reasons")), "processed_at": F.when(hit, F.current_timestamp()).otherwise(F.col("processed_at"))}).select(*target.columns)


def mark_errors(target: DataFrame, errors: DataFrame) -> DataFrame:
    """Rows of ``errors`` (id, error) carry the error; what was matched stays."""
    held = target.join(errors.select("id", F.col("error").alias("_e")), "id", "left")
    return held.withColumn("processing_error", F.coalesce("_e", "processing_error")).select(*target.columns)


def import_row(things: DataFrame) -> DataFrame:
    """Item columns of imported things: play times and the image fall back; a zero counts as missing."""
    or_else = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit(0)), F.col(b))
    kind = F.when(F.col("item_type") == "boardgameexpansion", "expansion").otherwise("base_game")
    return things.withColumns({"min_minutes": or_else("min_playtime", "playing_time"), "max_minutes": or_else("max_playtime", "playing_time"), "image_url": F.coalesce(F.nullif(F.col("image"), F.lit("")), F.col("thumbnail")), "item_type": kind})


def insert_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``source`` whose key is not there yet, once each; existing rows stay."""
    fresh = source.select(*target.columns).dropDuplicates(keys)
    return target.unionByName(fresh.alias("s").join(target.alias("t"), _match(keys), "left_anti"))


def resolve_publishers(links: DataFrame, publishers: DataFrame) -> DataFrame:
    """``links`` (bgg_id, name, ...) with publisher_id: by number first, then by name, then null."""
    by_id = publishers.filter("bgg_id IS NOT NULL").select(F.col("bgg_id").alias("_b"), F.col("id").alias("_i"))
    by_name = publishers.groupBy(F.col("name").alias("_m")).agg(F.min("id").alias("_j"))
    held = links.join(by_id, F.col("bgg_id") == F.col("_b"), "left").join(by_name, F.col("name") == F.col("_m"), "left")
    return held.select(*links.columns, F.coalesce("_i", "_j").alias("publisher_id"))


def relate_items(target: DataFrame, source: DataFrame, directional: tuple[str, ...] = ("extension", "implementation")) -> DataFrame:
    """Edges (item_a_id, link_type, item_b_id, ...): an incoming edge first removes its inverse of a directional type."""
    back = source.filter(F.col("link_type").isin(*directional)).select(F.col("item_b_id").alias("_a"), F.col("link_type").alias("_t"), F.col("item_a_id").alias("_b")).distinct()
    left = target.join(back, (F.col("item_a_id") == F.col("_a")) & (F.col("link_type") == F.col("_t")) & (F.col("item_b_id") == F.col("_b")), "left_anti")
    return upsert(left, source, ["item_a_id", "link_type", "item_b_id"])


def set_parents(items: DataFrame, links: DataFrame) -> DataFrame:
    """``parent_item_id`` of items from ``links`` (item_id, parent_id, seq); the last link of an item holds."""
    last = links.groupBy("item_id").agg(F.max_by("parent_id", "seq").alias("_p"))
    return items.join(last, "item_id", "left").withColumn("parent_item_id", F.coalesce("_p", "parent_item_id")).drop("_p")


def keep_confirmed(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """Refreshed rows of confirmed items take keys, status and reasons from the existing row, and stay confirmed."""
    carried = ["store_id", "source_url", "item_id", "listing_status", "category_confidence", "classification_reasons"]
    held = fresh.drop(*carried, "is_boardgame", "is_boardgame_confirmed").join(existing.select("id", *carried), "id")
    return held.withColumns({"is_boardgame": F.lit(True), "is_boardgame_confirmed": F.lit(True)})


def with_listing(details: DataFrame, listings: DataFrame) -> DataFrame:
    """Price and availability of the listing where the detail page lacks them (source_listing_url, url)."""
    names = {c: f"_{c}" for c in ("raw_price", "price", "price_source", "availability", "availability_source")}
    held = details.join(listings.select(F.col("source_url").alias("source_listing_url"), *(F.col(c).alias(n) for c, n in names.items())), "source_listing_url", "left")
    no_price, no_stock = F.coalesce(F.col("price"), F.lit("")) == "", F.coalesce(F.col("availability"), F.lit("unknown")) == "unknown"
    pick = lambda c, test: F.when(test & F.col(names[c]).isNotNull(), F.col(names[c])).otherwise(F.col(c))
    return held.withColumns({c: pick(c, no_price if "price" in c else no_stock) for c in names}).drop(*names.values())


def choose_detail(static: DataFrame, rendered: DataFrame, listings: DataFrame) -> DataFrame:
    """For each listing (source_url, title): the static record, the rendered one if that won't do, else the listing.

    A record won't do without a title, with a cookie notice for a title, or if it shares no telling word with the listing.
    """
    from ..functions import text, urls, vocab

    slug = F.element_at(F.split(F.regexp_replace(urls.path_of(F.col("source_url")), "/+$", ""), "/"), -1)
    own = text.tokens(F.concat_ws(" ", "title", slug), 3, vocab.TEXT_STOPS)

    def usable(title: Column) -> Column:
        theirs = text.tokens(title, 3, vocab.TEXT_STOPS)
        apart = (F.size(own) > 0) & (F.size(theirs) > 0) & ~F.arrays_overlap(own, theirs)
        return title.isNotNull() & (F.trim(title) != "") & ~F.lower(title).contains("website uses cookies") & ~apart

    packed = lambda df, name: df.select(F.col("source_listing_url").alias("source_url"), F.struct(*df.columns).alias(name))
    held = listings.join(packed(static, "_s"), "source_url", "left").join(packed(rendered, "_r"), "source_url", "left")
    origin = F.when(usable(F.col("_s.title")), "static").when(usable(F.col("_r.title")), "rendered").otherwise("listing")
    return held.withColumn("origin", origin).withColumn("detail", F.when(F.col("origin") == "static", F.col("_s")).when(F.col("origin") == "rendered", F.col("_r"))).drop("_s", "_r")
