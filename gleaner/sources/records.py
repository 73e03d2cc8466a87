"""Stored item candidates as rows: the columns of the table in reading order, decoded with their defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import optional_int
from .exports import ITEM_COLUMNS

#: Columns of the matcher, which only readers see.
MATCH_COLUMNS = ["match_source", "matched_bgg_id", "matched_name", "match_score", "match_reasons", "match_payload", "matched_at", "processed_at", "processing_error"]
READ_COLUMNS = [*ITEM_COLUMNS, *MATCH_COLUMNS]
#: What an empty text stands for.
DEFAULTS = {"item_type": "unknown", "listing_status": "PENDING", "price_source": "none", "currency": "MXN", "availability": "unknown", "availability_source": "none"}
_INTEGERS = {"store_id", "item_id", "min_players", "max_players", "min_minutes", "max_minutes", "min_age", "matched_bgg_id"}
_DOUBLES, _FLAGS = {"category_confidence", "match_score"}, {"is_boardgame", "is_boardgame_confirmed"}
_LISTS, _OBJECTS, _TIMES = {"classification_reasons", "match_reasons"}, {"raw_payload", "match_payload"}, {"matched_at", "processed_at"}


def plain_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def optional_float(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast("double")


def string_list(c: Column) -> Column:
    """Trimmed entries that are not blank; a null list is empty."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def json_list(c: Column) -> Column:
    """Entries of a JSON array as text; anything else is an empty list."""
    return F.coalesce(F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>")), F.array().cast("array<string>"))


def json_object(c: Column) -> Column:
    """Fields of a JSON object as texts; anything else is an empty map."""
    return F.coalesce(F.when(F.trim(c).startswith("{"), F.from_json(c, "map<string,string>")), F.create_map().cast("map<string,string>"))


def decode_items(rows: DataFrame) -> DataFrame:
    """The 39 read columns (and ``id``, ``last_updated`` where they are there) from a table of texts; absent columns count as null."""

    def value(name: str) -> Column:
        held = F.col(name).cast("string") if name in rows.columns else F.lit(None).cast("string")
        if name in _INTEGERS:
            return optional_int(held)
        if name in _DOUBLES:
            return optional_float(held)
        if name in _FLAGS:
            return F.coalesce(held.try_cast("boolean"), F.lit(False))
        if name in _LISTS:
            return json_list(held)
        if name in _OBJECTS:
            return json_object(held)
        if name in _TIMES:
            return F.nullif(held, F.lit(""))
        return F.coalesce(F.nullif(plain_text(held), F.lit("")), F.lit(DEFAULTS[name])) if name in DEFAULTS else plain_text(held)

    return rows.select(*(c for c in ("id", "last_updated") if c in rows.columns), *(value(c).alias(c) for c in READ_COLUMNS))


def database_rows(items: DataFrame) -> DataFrame:
    """All 39 columns as they are stored: an empty price is null, lists and objects are JSON; absent columns are null."""
    made = {"price": F.nullif(F.trim("price"), F.lit("")).try_cast("decimal(12,2)")} | {c: F.to_json(c) for c in (*_LISTS, *_OBJECTS) if c in items.columns and items.schema[c].dataType.simpleString() != "string"}
    return items.select(*((made.get(c, F.col(c)) if c in items.columns else F.lit(None).cast("string")).alias(c) for c in READ_COLUMNS))


def confirmed(stored: DataFrame, limit: int | None = None) -> DataFrame:
    """Stored rows that are confirmed games with an item and an address, those updated longest ago first."""
    held = stored.filter("is_boardgame AND is_boardgame_confirmed AND item_id IS NOT NULL AND source_url <> ''").orderBy(F.col("last_updated").asc_nulls_last(), "id")
    return held if limit is None else held.limit(limit)


def stored_matches(keys: DataFrame, stored: DataFrame) -> DataFrame:
    """``keys`` (store_id, source_url) that are stored; a null store is a store."""
    old = stored.select(F.col("store_id").alias("_s"), F.col("source_url").alias("_u"))
    return keys.join(old, F.col("store_id").eqNullSafe(F.col("_s")) & (F.col("source_url") == F.col("_u")), "left_semi")


def read_database(spark: SparkSession, url: str, name: str, key: str | None = None, parts: int = 32, **options) -> DataFrame:
    """A table of a database through JDBC. With ``key``, a numeric column, it is read in ``parts`` ranges of that column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key:
        least, most = spark.read.format("jdbc").option("url", url).option("query", f"SELECT min({key}), max({key}) FROM {name}").options(**options).load().first()
        if least is not None:
            reader = reader.option("partitionColumn", key).option("lowerBound", int(least)).option("upperBound", int(most) + 1).option("numPartitions", parts)
    return reader.load()
