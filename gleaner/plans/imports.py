"""Import of things by their external number: items, aliases, lookups, bridges, contributors, publishers and relations.

Each step is a set-based upsert of one table from all things at once. Tables come in as snapshots and go out as new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import graph, relate, upsert

#: Kinds of links that lead to a lookup of (id, bgg_id, name), and the table of each.
LOOKUPS = {"category": "categories", "mechanic": "mechanics", "family": "families"}
ROLES = ("designer", "artist")


def links_of(things: DataFrame, kind: str) -> DataFrame:
    """(owner, seq, bgg_id, name, inbound) of the links of one kind; ``parent`` are inbound expansions."""
    held = things.select(F.col("bgg_id").alias("owner"), F.posexplode("links").alias("seq", "link")).select("owner", "seq", "link.*")
    test = (F.col("link_type") == "boardgameexpansion") & F.col("inbound") if kind == "parent" else F.col("link_type") == f"boardgame{kind}"
    return held.filter(test).drop("link_type")


def reached(things: DataFrame, seeds: DataFrame) -> DataFrame:
    """(bgg_id, hops) of the things that importing ``seeds`` (bgg_id) reaches over parents and implementations.

    What has no thing is not reached: an unknown seed gives nothing, a link to an unknown thing ends there.
    """
    known = things.select(F.col("bgg_id").alias("dst"))
    steps = links_of(things, "parent").unionByName(links_of(things, "implementation")).select(F.col("owner").alias("src"), F.col("bgg_id").alias("dst"))
    start = seeds.select(F.col("bgg_id").alias("dst")).join(known, "dst", "left_semi").distinct()
    found = graph.closure(steps.join(known, "dst", "left_semi"), start.select(F.col("dst").alias("id")))
    return found.groupBy(F.col("id").alias("bgg_id")).agg(F.min("hops").alias("hops"))


def _kind(c: Column) -> Column:
    return F.when(c == "boardgameexpansion", "expansion").otherwise("base_game")


def item_columns(things: DataFrame) -> DataFrame:
    """Item rows of things, as they are written; play times and the image fall back."""
    made = upsert.import_row(things.withColumn("_kind", F.col("item_type"))).withColumn("item_type", _kind(F.col("_kind")))
    return made.select(
        "bgg_id", F.col("name").alias("canonical_name"), text.normalize_title(F.col("name")).alias("normalized_name"), "item_type", urls.item_url(F.col("_kind"), F.col("bgg_id")).alias("bgg_url"),
        "year_published", "description", "min_players", "max_players", "min_minutes", "max_minutes", "min_age", "image_url", F.lit("active").alias("status"),
    )


def upsert_lookup(lookup: DataFrame, links: DataFrame) -> DataFrame:
    """``lookup`` (id, bgg_id, name) with the names of ``links`` (owner, seq, bgg_id, name); the last name of a number holds."""
    last = links.groupBy("bgg_id").agg(F.max_by("name", F.struct("owner", "seq")).alias("name"))
    return upsert.upsert(lookup, upsert.with_ids(lookup, last, ["bgg_id"], "id"), ["bgg_id"])


def upsert_publishers(publishers: DataFrame, links: DataFrame) -> DataFrame:
    """``publishers`` (id, name, normalized_name, bgg_id): found by number, then by name, else added; a number stays."""
    last = links.groupBy("bgg_id").agg(F.max_by("name", F.struct("owner", "seq")).alias("name"))
    # of several numbers under one name only one can be that publisher
    told = upsert.resolve_publishers(last, publishers)
    first = relate.keep_first(told.filter("publisher_id IS NOT NULL"), ["publisher_id"], ["bgg_id"])
    fresh = told.filter("publisher_id IS NULL").groupBy("name").agg(F.min("bgg_id").alias("bgg_id"))
    held = publishers.join(first.select(F.col("publisher_id").alias("id"), F.col("name").alias("_n"), F.col("bgg_id").alias("_b")), "id", "left")
    renamed = held.select("id", F.coalesce("_n", "name").alias("name"), F.coalesce(text.normalize_title(F.col("_n")), "normalized_name").alias("normalized_name"), F.coalesce("bgg_id", "_b").alias("bgg_id"))
    added = upsert.with_ids(publishers, fresh, ["name"], "id").withColumn("normalized_name", text.normalize_title(F.col("name")))
    return renamed.unionByName(added.select(*renamed.columns))


def import_things(seeds: DataFrame, things: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """New snapshots of ``tables`` after importing ``seeds`` (bgg_id) from ``things`` (rows of :func:`markup.thing`).

    ``tables``: items, aliases, categories, mechanics, families, contributors, publishers, the bridges item_categories,
    item_mechanics, item_families, item_contributors, item_publishers, and relations. Of two relations that are each
    other's inverse, that of the thing nearer to a seed holds. A parent that is known stays where no link names one.
    """
    hops = graph.settle(reached(things, seeds))
    taken = graph.settle(things.join(hops.select("bgg_id"), "bgg_id", "left_semi").dropDuplicates(["bgg_id"]))
    out = dict(tables)
    numbered = upsert.with_ids(tables["items"], item_columns(taken), ["bgg_id"], "id")
    items = graph.settle(upsert.upsert(tables["items"], numbered, ["bgg_id"], kept=("id",)))
    number = items.filter("bgg_id IS NOT NULL").select(F.col("bgg_id").alias("_n"), F.col("id").alias("item_id"))
    of = lambda rows: rows.join(number, F.col("owner") == F.col("_n")).drop("_n")

    said = of(taken.select(F.col("bgg_id").alias("owner"), F.posexplode("alternate_names").alias("seq", "alias")))
    said = said.withColumn("normalized_alias", text.normalize_title(F.col("alias"))).filter("normalized_alias <> ''")
    first = relate.keep_first(said.select("item_id", "alias", "normalized_alias", "seq"), ["item_id", "normalized_alias"], ["seq"])
    out["aliases"] = upsert.upsert(tables["aliases"], first.select("item_id", "alias", "normalized_alias", F.lit("BGG").alias("source")), ["item_id", "normalized_alias"])

    for kind, name in LOOKUPS.items():
        links = links_of(taken, kind)
        out[name] = graph.settle(upsert_lookup(tables[name], links))
        pairs = of(links).join(out[name].select("bgg_id", F.col("id").alias("ref")), "bgg_id").select("item_id", "ref").distinct()
        out[f"item_{name}"] = upsert.insert_missing(tables[f"item_{name}"], pairs, ["item_id", "ref"])

    people = None
    for role in ROLES:
        links = links_of(taken, role).withColumn("role", F.lit(role))
        people = links if people is None else people.unionByName(links)
    out["contributors"] = graph.settle(upsert_lookup(tables["contributors"], people))
    pairs = of(people).join(out["contributors"].select("bgg_id", F.col("id").alias("ref")), "bgg_id").select("item_id", "ref", "role").distinct()
    out["item_contributors"] = upsert.insert_missing(tables["item_contributors"], pairs, ["item_id", "ref", "role"])

    links = links_of(taken, "publisher")
    out["publishers"] = graph.settle(upsert_publishers(tables["publishers"], links))
    pairs = upsert.resolve_publishers(of(links), out["publishers"]).select("item_id", F.col("publisher_id").alias("ref")).distinct()
    out["item_publishers"] = upsert.insert_missing(tables["item_publishers"], pairs, ["item_id", "ref"])

    other = number.select(F.col("_n").alias("bgg_id"), F.col("item_id").alias("other_id"))
    parents = of(links_of(taken, "parent")).join(other, "bgg_id").join(hops.withColumnRenamed("bgg_id", "owner"), "owner")
    pointed = upsert.set_parents(items.withColumnRenamed("id", "item_id"), parents.select("item_id", F.col("other_id").alias("parent_id"), "seq"))
    out["items"] = pointed.withColumnRenamed("item_id", "id").select(*items.columns)
    made = of(links_of(taken, "implementation")).join(other, "bgg_id").join(hops.withColumnRenamed("bgg_id", "owner"), "owner")
    a, b = F.when(F.col("inbound"), F.col("item_id")).otherwise(F.col("other_id")), F.when(F.col("inbound"), F.col("other_id")).otherwise(F.col("item_id"))
    edges = parents.select(F.col("item_id").alias("item_a_id"), F.lit("extension").alias("link_type"), F.col("other_id").alias("item_b_id"), "hops", "owner", F.col("bgg_id").alias("number"))
    edges = edges.unionByName(made.select(a.alias("item_a_id"), F.lit("implementation").alias("link_type"), b.alias("item_b_id"), "hops", "owner", F.col("bgg_id").alias("number")))
    pair = [F.least("item_a_id", "item_b_id"), F.greatest("item_a_id", "item_b_id"), "link_type"]
    nearest = relate.keep_first(edges, pair, ["hops", "owner", "number"])
    new = nearest.select("item_a_id", "link_type", "item_b_id", F.lit("BGG").alias("source"), F.col("number").cast("string").alias("source_ref"))
    out["relations"] = upsert.relate_items(tables["relations"], new)
    return out
