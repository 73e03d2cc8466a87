"""Sinks: text projections in fixed column order, as CSV with a header and as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import AUDIT_COLUMNS, STORE_COLUMNS


def _joined(name: str, sort: bool):
    held = F.coalesce(F.col(name), F.array().cast("array<string>"))
    return F.array_join(F.array_sort(F.array_distinct(held)) if sort else held, " | ")


def store_rows(stores: DataFrame) -> DataFrame:
    """All columns as text: two decimals of confidence, distinct sorted queries, evidence in order."""
    made = {"confidence": F.format_string("%.2f", F.col("confidence")), "source_queries": _joined("source_queries", True), "evidence": _joined("evidence", False)}
    return stores.select(*(made.get(c, F.col(c).cast("string")).alias(c) for c in STORE_COLUMNS))


def audit_rows(audit: DataFrame) -> DataFrame:
    made = {"accepted": F.initcap(F.col("accepted").cast("string")), "confidence": F.format_string("%.2f", F.col("confidence")), "reasons": _joined("reasons", False), "source_queries": _joined("source_queries", True)}
    return audit.select(*(made.get(c, F.col(c).cast("string")).alias(c) for c in AUDIT_COLUMNS))


def store_order(stores: DataFrame) -> DataFrame:
    return stores.orderBy(F.col("confidence").desc(), F.lower("store_name"), "canonical_domain")


def audit_order(audit: DataFrame) -> DataFrame:
    return audit.orderBy(~F.col("accepted"), F.col("confidence").desc(), "canonical_domain")


def write(rows: DataFrame, folder: str, name: str) -> tuple[str, str]:
    """Overwrite ``folder``/name_csv and name_json."""
    csv, text = f"{folder}/{name}_csv", f"{folder}/{name}_json"
    rows.write.mode("overwrite").option("header", True).csv(csv)
    rows.write.mode("overwrite").json(text)
    return csv, text


#: Columns that an item write sets, in order; match columns are never among them.
ITEM_COLUMNS = [
    "store_id", "source_url", "source_listing_url", "title", "publisher", "description", "item_id", "item_type", "min_players", "max_players",
    "min_minutes", "max_minutes", "min_age", "language", "language_source", "language_evidence", "image_url", "listing_status", "raw_price", "price",
    "price_source", "currency", "availability", "availability_source", "store_sku", "raw_payload", "is_boardgame", "is_boardgame_confirmed",
    "category_confidence", "classification_reasons",
]


def item_rows(items: DataFrame) -> DataFrame:
    """Item candidates as they are written: prices as decimals, an empty one null, reasons as JSON; absent columns are null."""
    made = {"price": F.nullif(F.trim("price"), F.lit("")).try_cast("decimal(12,2)"), "classification_reasons": F.to_json("classification_reasons")}
    return items.select(*((made.get(c, F.col(c)) if c in items.columns else F.lit(None).cast("string")).alias(c) for c in ITEM_COLUMNS))
