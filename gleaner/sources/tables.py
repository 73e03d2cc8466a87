"""Sources: snapshots of tables, search responses, fetched pages and sitemaps, and a live search as a Python data source."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SEARCH = "web struct<results: array<struct<title: string, name: string, url: string, description: string, extra_snippets: array<string>>>>"
RESULT = "title string, url string, description string, query string, rank long"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parse_search(payload: Column) -> Column:
    """Results (rank, title, url, description) of a search response in JSON; those without a URL are dropped."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    rows = F.filter(F.from_json(payload, SEARCH)["web"]["results"], lambda r: blank(r["url"]) != "")

    def result(r: Column, i: Column) -> Column:
        parts = F.filter(F.concat(F.array(blank(r["description"])), F.coalesce(r["extra_snippets"], F.array().cast("array<string>"))), lambda x: x != "")
        return F.struct((i + 1).alias("rank"), F.coalesce(F.nullif(r["title"], F.lit("")), r["name"], F.lit("")).alias("title"), r["url"].alias("url"), F.array_join(parts, " ").alias("description"))

    return F.transform(rows, result)


def first_snapshot(primary: DataFrame, fallback: DataFrame, bad: Column) -> DataFrame:
    """Pages (url, body) of ``primary``; where missing or ``bad`` (over body), of ``fallback``, and flagged as blocked."""
    a, b = primary.select("url", F.when(~bad, F.col("body")).alias("_a"), bad.alias("blocked")), fallback.select("url", F.col("body").alias("_b"))
    return a.join(b, "url", "full").select("url", F.coalesce("_a", "_b").alias("body"), F.coalesce("blocked", F.lit(False)).alias("blocked"))


class _Page(InputPartition):
    def __init__(self, query: str, page: int):
        self.query, self.page = query, page


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.queries, self.pages, self.count = json.loads(options["queries"]), int(options.get("pages", 1)), int(options.get("count", 20))
        self.endpoint, self.key = options["endpoint"], options.get("key", "")

    def partitions(self):
        return [_Page(q, p) for q in self.queries for p in range(self.pages)]

    def read(self, part):
        from urllib.parse import urlencode
        from urllib.request import Request, urlopen

        query = urlencode({"q": part.query, "count": self.count, "offset": part.page})
        with urlopen(Request(f"{self.endpoint}?{query}", headers={"Accept": "application/json", "X-Subscription-Token": self.key}), timeout=30) as response:
            rows = json.load(response).get("web", {}).get("results", [])
        for i, r in enumerate((r for r in rows if r.get("url")), part.page * self.count + 1):
            yield (r.get("title") or r.get("name") or "", r["url"], " ".join(x for x in [r.get("description", ""), *r.get("extra_snippets", [])] if x), part.query, i)


class SearchSource(DataSource):
    """``spark.read.format("catalog_search")``: one partition for each query and page of results."""

    @classmethod
    def name(cls):
        return "catalog_search"

    def schema(self):
        return RESULT

    def reader(self, schema):
        return _Reader(self.options)


class _XmlReader(DataSourceReader):
    def __init__(self, options):
        self.asked, self.kind = json.loads(options["asked"]), options.get("kind", "thing")
        self.endpoint, self.key, self.types = options["endpoint"].rstrip("/"), options.get("key", ""), options.get("types", "boardgame,boardgameexpansion")

    def partitions(self):
        return [_Page(str(a), 0) for a in self.asked]

    def read(self, part):
        from urllib.parse import urlencode
        from urllib.request import Request, urlopen

        query = urlencode({"query" if self.kind == "search" else "id": part.query, "type": self.types})
        headers = {"Accept": "application/xml,text/xml", "Authorization": f"Bearer {self.key}"}
        with urlopen(Request(f"{self.endpoint}/{self.kind}?{query}", headers=headers), timeout=30) as response:
            yield part.query, response.read().decode(response.headers.get_content_charset() or "utf-8", errors="replace")


class XmlSource(DataSource):
    """``spark.read.format("catalog_xml")``: (asked, body) of a metadata service, one partition for each number or search."""

    @classmethod
    def name(cls):
        return "catalog_xml"

    def schema(self):
        return "asked string, body string"

    def reader(self, schema):
        return _XmlReader(self.options)


def embed(rows: DataFrame, text: str, client, batch: int = 32) -> DataFrame:
    """``rows`` with an ``embedding`` by ``client`` (list of texts -> list of vectors), called in each partition."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            vectors = [v for i in range(0, len(frame), batch) for v in client(frame[text].iloc[i : i + batch].tolist())]
            yield frame.assign(embedding=pd.Series(vectors, index=frame.index, dtype=object))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, embedding array<float>")
