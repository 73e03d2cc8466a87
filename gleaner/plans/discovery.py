"""The three jobs end to end: store discovery, item discovery and refresh, embedding refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup, rules, text, urls
from ..operators import graph, relate, upsert
from ..sources import records, tables


def discover_stores(results: DataFrame, pages: DataFrame, blocked: DataFrame, include_low: bool = False, most_pages: int = 3, **vocabularies) -> tuple[DataFrame, DataFrame]:
    """(stores, audit) from search results (seq, title, url, description, query) and pages (url, html).

    Every domain that is not blocked gives an audit row; accepted ones, or all with ``include_low``, give a store. The
    store's metadata folds its home page and up to ``most_pages`` pages that the home page links to.
    """
    held = results.withColumn("domain", urls.canonical_domain(F.col("url"))).withColumn("homepage", urls.homepage(F.col("url")))
    # the longest description, the first of equals; no bucket holds all, as a description may be a whole page
    best = F.max_by(F.struct("title", "description", "url"), F.struct(F.coalesce(F.length("description"), F.lit(-1)), -F.col("seq"))).alias("best")
    held = held.groupBy("domain").agg(F.min_by("homepage", "seq").alias("homepage"), F.array_sort(F.collect_set("query")).alias("queries"), best)
    held = relate.not_blocked(held, "domain", blocked)
    meta = markup.site_metadata(pages)
    home = held.select("domain", "homepage").join(meta.withColumnRenamed("url", "homepage"), "homepage").withColumn("seq", F.lit(0))
    linked = home.select("domain", F.posexplode(F.slice("internal_links", 1, most_pages)).alias("at", "url")).join(meta, "url").withColumn("seq", F.col("at") + 1)
    fields = ["store_name", "instagram_url", "facebook_url", "city", "state", "store_logo"]
    columns = ["domain", "seq", *fields, "page_text", "internal_links"]
    folded = relate.fold_metadata(home.select(*columns).unionByName(linked.select(*columns)), "domain", "seq", fields, "page_text", "internal_links")
    rows = held.join(folded, "domain", "left")
    evidence = F.concat_ws(" ", "best.title", "best.description", "best.url", F.coalesce("page_text", F.lit("")))
    rows = rows.withColumn("d", rules.store_decision(F.col("domain"), evidence, **vocabularies))
    name = text.first_text(F.coalesce("store_name", F.lit("")), text.title_fallback(F.col("best.title"), F.col("domain")))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    common = [F.col("domain").alias("canonical_domain"), F.col("homepage").alias("website_url"), name.alias("store_name"), F.col("d.confidence").alias("confidence"), F.col("queries").alias("source_queries")]
    audit = rows.select(*common, "d.accepted", "d.reasons", "best.title", "best.description")
    stores = rows.filter(F.col("d.accepted") | F.lit(include_low)).select(*common, *(blank(f) for f in fields if f != "store_name"), F.lit("Mexico").alias("country"), F.when(F.col("d.accepted"), "ACCEPTED").otherwise("REJECTED").alias("status"), F.col("d.reasons").alias("evidence"))
    return stores, audit


def counters(stores: DataFrame, audit: DataFrame, results: DataFrame) -> DataFrame:
    """One row: queries, domains and accepted domains."""
    return results.agg(F.countDistinct("query").alias("queries")).crossJoin(audit.agg(F.count(F.lit(1)).alias("domains"), F.count_if("accepted").alias("accepted")))


def discover_items(store_id: int | None, roots: DataFrame, sitemaps: DataFrame, pages: DataFrame, existing: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """New classified item candidates of a store: sitemap frontier, else listings of ``pages``; then details, then rules.

    Known URLs drop out before any page is parsed.
    """
    found, _ = graph.crawl(roots, sitemaps)
    listed = markup.listing_candidates(pages)
    from_maps = found.select(F.col("url").alias("source_url"), urls.slug_title(F.col("url")).alias("title"), *(F.lit(v).alias(c) for c, v in (("raw_price", ""), ("price", ""), ("price_source", "none"), ("availability", "unknown"), ("availability_source", "none"))))
    listings = from_maps if not found.isEmpty() else listed.select(*from_maps.columns)
    listings = relate.frontier(listings.withColumn("store_id", F.lit(store_id).cast("int")), existing)
    return classify(details(listings, pages, rendered))


def details(listings: DataFrame, pages: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """The record of each listing (store_id, source_url, title, price and availability): its page's, with what the listing adds.

    Protection pages give no record. Listings whose page gives none keep what they say themselves.
    """
    wanted = listings.select(F.col("source_url").alias("url"))
    open_ = lambda df: df.filter(~F.coalesce(markup.is_challenge(F.col("html")), F.lit(False)))
    detail = lambda df: markup.product_details(open_(df).join(wanted, "url", "left_semi")).withColumn("source_listing_url", F.col("url"))
    static = detail(pages)
    chosen = upsert.choose_detail(static, detail(rendered) if rendered is not None else static.limit(0), listings)
    columns = [c for c in static.columns if c not in ("url", "source_listing_url")]
    simple = {"title", "raw_price", "price", "price_source", "availability", "availability_source"}
    rows = chosen.select("store_id", F.coalesce("detail.url", "source_url").alias("source_url"), F.col("source_url").alias("source_listing_url"), *(F.when(F.col("origin") == "listing", F.col(c) if c in simple else F.lit(None)).otherwise(F.col(f"detail.{c}")).alias(c) for c in columns))
    return upsert.with_listing(rows, listings)


def classify(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("structured", markup.json_values(F.get_json_object("raw_payload", "$.json_ld")))
    return rules.apply_item_decision(rows, rules.item_decision(*(F.col(c) for c in ("title", "publisher", "description", "item_type", "structured")), *(F.col(c) for c in ("min_players", "max_players", "min_minutes", "max_minutes", "min_age")))).drop("structured")


def refresh_confirmed(stored: DataFrame, pages: DataFrame, rendered: DataFrame | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(new snapshot of ``stored``, refreshed rows): confirmed games read again, their classification and links kept.

    ``limit`` takes those updated longest ago. Nothing is classified anew, nothing handed to the matcher.
    """
    due = graph.settle(records.confirmed(stored, limit))
    fresh = details(due, pages, rendered)
    held = upsert.keep_confirmed(fresh.join(due.select("id", F.col("source_url").alias("_u")), F.col("source_listing_url") == F.col("_u")).drop("_u", "source_listing_url"), due)
    # the place where a listing was found stays with it
    held = graph.settle(held.join(due.select("id", "source_listing_url"), "id").withColumn("last_updated", F.current_timestamp()))
    if stored.schema["raw_payload"].dataType.typeName() == "map":
        held = held.withColumn("raw_payload", records.json_object(F.col("raw_payload")))
    columns = [c for c in stored.columns if c in held.columns]
    return upsert.upsert(stored, held.select(*columns), ["id"], kept=("listing_status", "item_id", "store_id", "source_url")), held


def match_requests(items: DataFrame, results: DataFrame) -> DataFrame:
    """Candidates to hand to the matcher: games that a result says to process."""
    return items.join(results.filter("should_process"), items["id"] == results["candidate_id"]).filter("is_boardgame").select("id", "title", "publisher", "source_url")


def embedding_text(columns: dict[str, str] | None = None):
    """Seven labelled lines; terms are joined by commas."""
    term = lambda c: text.join_terms(F.col(c))
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit("")))
    return F.concat_ws("\n", line("Name", F.col("canonical_name")), line("Spanish name", F.col("canonical_name_es")), line("Description", F.col("description")), line("Description_es", F.col("description_es")), line("Categories", term("categories")), line("Mechanics", term("mechanics")), line("Families", term("families")))


def refresh_embeddings(items: DataFrame, bridges: dict[str, tuple[DataFrame, DataFrame]], embedded: DataFrame, client, model: str, mode: str = "missing") -> DataFrame:
    """New snapshot of the embeddings. ``bridges``: categories, mechanics, families -> (bridge item_id/ref, names ref/name)."""
    rows = relate.missing(items, embedded, "item_id", mode)
    for name, (bridge, names) in bridges.items():
        rows = relate.lateral_names(rows, bridge, names, "item_id", "ref", name)
    rows = rows.select("item_id", embedding_text().alias("source_text"))
    rows = rows.withColumn("source_hash", text.source_hash(F.col("source_text")))
    made = tables.embed(rows, "source_text", client).withColumn("model", F.lit(model)).withColumn("dims", F.size("embedding"))
    return upsert.upsert(embedded, made.select(*embedded.columns), ["item_id"])
