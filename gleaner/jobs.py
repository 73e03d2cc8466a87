"""The jobs as commands: ``python -m gleaner.jobs JOB ...`` or ``spark-submit``. Tables come from and go to Parquet folders.

Each job resolves its settings, reads its tables, runs its plan, writes the new snapshots beside the old ones, and prints
one JSON line: what the run was and what it counted.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .functions import vocab
from .operators import upsert
from .plans import discovery
from .plans.runs import Runs
from .sources import exports, tables

SCOPES = {"core": 0, "expanded": 1, "full": 2}


def _plain(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))


def search_strings(spark: SparkSession, scope: str, most: int | None = None) -> list[str]:
    """The distinct search strings of a scope, in order: the core, then for cities, then for states."""
    from .operators import relate

    rows = lambda values, name: spark.createDataFrame(list(enumerate(values)), f"seq long, {name} string")
    core = rows(vocab.CORE_QUERIES, "query")
    asked = relate.query_strings(core, rows(vocab.QUERY_CITIES if SCOPES[scope] else [], "place"), vocab.CITY_QUERIES)
    if SCOPES[scope] == 2:
        states = relate.query_strings(core, rows([_plain(s) for s in vocab.STATES], "place"), vocab.STATE_QUERIES).withColumn("seq", F.col("seq") + 1_000_000)
        asked = relate.keep_first(asked.unionByName(states), [F.lower("query")], ["seq", "k"])
    found = [r["query"] for r in asked.orderBy("seq", "k").collect()]
    return found if most is None else found[:most]


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def stores(spark: SparkSession, a: argparse.Namespace) -> dict:
    """results, pages -> stores, audit; by request also as CSV and JSON."""
    blocked = spark.createDataFrame([(d,) for d in vocab.BLOCKED_DOMAINS], "domain string")
    if a.endpoint:
        spark.dataSource.register(tables.SearchSource)
        asked = {"queries": json.dumps(search_strings(spark, a.query_scope, a.max_queries)), "pages": a.pages, "count": a.count, "endpoint": a.endpoint, "key": config.setting("SEARCH_API_KEY", a.api_key, os.environ, a.env_file) or ""}
        results = spark.read.format("catalog_search").options(**asked).load().withColumn("seq", F.monotonically_increasing_id())
        results.write.mode("overwrite").parquet(f"{a.out}/results")
        results = _read(spark, a.out, "results")
    else:
        results = _read(spark, a.tables, "results")
    found, audit = discovery.discover_stores(results, _read(spark, a.tables, "pages"), blocked, a.include_low_confidence, a.max_enrichment_pages)
    found.write.mode("overwrite").parquet(f"{a.out}/stores")
    audit.write.mode("overwrite").parquet(f"{a.out}/audit")
    found, audit = _read(spark, a.out, "stores"), _read(spark, a.out, "audit")
    told = discovery.counters(found, audit, results).first().asDict() | {"stores": found.count()}
    if a.export_files:
        told["files"] = [*exports.write(exports.store_rows(exports.store_order(found)), a.out, "stores"), *exports.write(exports.audit_rows(exports.audit_order(audit)), a.out, "audit")]
    return told


def items(spark: SparkSession, a: argparse.Namespace) -> dict:
    """sitemaps, pages, items -> items with the store's new candidates."""
    stored = _read(spark, a.tables, "items")
    root = spark.createDataFrame([(a.website.rstrip("/") + "/sitemap.xml",)], "url string")
    found = discovery.discover_items(a.store_id, root, _read(spark, a.tables, "sitemaps"), _read(spark, a.tables, "pages"), stored)
    found.write.mode("overwrite").parquet(f"{a.out}/candidates")
    found = _read(spark, a.out, "candidates")
    # two listings may lead to one page: the last in order of their addresses holds
    last = found.groupBy("store_id", "source_url").agg(F.max_by(F.struct(*found.columns), "source_listing_url").alias("r")).select("r.*")
    after, results = upsert.upsert_items(stored, last)
    after.write.mode("overwrite").parquet(f"{a.out}/items")
    return {"candidates": found.count(), "to_process": results.filter("should_process").count()}


def refresh(spark: SparkSession, a: argparse.Namespace) -> dict:
    """items, pages -> items with confirmed games read again."""
    after, held = discovery.refresh_confirmed(_read(spark, a.tables, "items"), _read(spark, a.tables, "pages"), limit=a.limit)
    after.write.mode("overwrite").parquet(f"{a.out}/items")
    return {"refreshed": held.count()}


JOBS = {"stores": stores, "items": items, "refresh": refresh}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gleaner.jobs", description="Runs a catalog job over Parquet tables.")
    p.add_argument("job", choices=[*JOBS, "queries"])
    p.add_argument("--tables", default="data", help="folder with one folder a table")
    p.add_argument("--out", default="out", help="folder for the new snapshots")
    p.add_argument("--env-file", default=".env")
    p.add_argument("--api-key")
    p.add_argument("--endpoint", help="search service; without it the table results is read")
    p.add_argument("--query-scope", choices=list(SCOPES), default="expanded")
    p.add_argument("--max-queries", type=int)
    p.add_argument("--count", type=int, default=20, help="results a search")
    p.add_argument("--pages", type=int, default=1, help="pages of results a search")
    p.add_argument("--max-enrichment-pages", type=int, default=3)
    p.add_argument("--include-low-confidence", action="store_true")
    p.add_argument("--export-files", action="store_true", help="also CSV and JSON")
    p.add_argument("--store-id", type=int)
    p.add_argument("--website", default="", help="address of the store whose items are sought")
    p.add_argument("--limit", type=int)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"gleaner {a.job}").getOrCreate()
    if a.job == "queries":
        print("\n".join(search_strings(spark, a.query_scope, a.max_queries)))
        return 0
    if a.job == "stores" and a.endpoint and not config.setting("SEARCH_API_KEY", a.api_key, os.environ, a.env_file):
        print("no key of the search service: --api-key, SEARCH_API_KEY or the env file", file=sys.stderr)
        return 2
    runs = Runs(background=False)
    run = runs.start(a.job, lambda: JOBS[a.job](spark, a))
    print(json.dumps(run.__dict__ | {"result": json.loads(run.result) if run.result else None}, ensure_ascii=False))
    return 0 if run.status == "completed" else 1


if __name__ == "__main__":
    sys.exit(main())
