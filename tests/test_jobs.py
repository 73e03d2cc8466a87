import json

import pytest
from pyspark.sql import functions as F

from gleaner import config, jobs
from gleaner.functions import markup, urls
from gleaner.plans import imports
from gleaner.plans.runs import AlreadyRunning, Runs
from gleaner.sources import exports, tables


def test_settings(tmp_path):
    file = tmp_path / ".env"
    file.write_text("# c\nexport A='x y'\nB = 2 \nnothing\n=z\n")
    assert config.read_dotenv(file) == {"A": "x y", "B": "2"} and config.read_dotenv(tmp_path / "no") == {}
    assert config.setting("A", " given ", {}, file) == "given"
    assert config.setting("A", " ", {"A": "e"}, file) == "e"
    assert config.setting("A", None, {"A": " "}, file) == "x y"
    assert config.setting("C", None, {}, file, "d") == "d"
    assert config.is_on(" Yes ") and not config.is_on("0")


def test_one_run_at_a_time(spark):
    runs = Runs(background=False)

    def nested():
        with pytest.raises(AlreadyRunning):
            runs.start("second", dict)
        return {"stores": 3}

    assert runs.start("first", nested).status == "completed"
    assert runs.start("bad", lambda: 1 / 0).error == "division by zero"
    assert [(r.run_type, r.status) for r in runs.table(spark).collect()] == [("first", "completed"), ("bad", "failed")]
    assert runs.latest().run_type == "bad" and runs.get("none") is None


def test_url_extras(spark):
    row = spark.createDataFrame([("https://s.mx/producto/juego-azul-de-mesa/", "Azul $ 100", "Ñu & Co")], "u string, b string, n string").select(
        urls.url_tokens(F.col("u")).alias("t"), urls.is_rendered(F.col("u"), F.col("b")).alias("r"), urls.asset_key(F.col("n"), "/covers/").alias("k"), urls.public_url("https://c.org/", F.lit("/a b/c.webp")).alias("p")
    ).first()
    assert row.t == ["juego", "azul", "mesa"] and row.r and row.k == "covers/nu-co.webp" and row.p == "https://c.org/a%20b/c.webp"


def test_item_rows(spark):
    got = exports.item_rows(spark.createDataFrame([("", ["a"])], "price string, classification_reasons array<string>")).first()
    assert len(got) == 30 and got.price is None and got.classification_reasons == '["a"]'


@pytest.fixture
def service():
    """A stub of the search and metadata services; says what it was asked."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlsplit

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            parts = urlsplit(self.path)
            asked = {k: v[0] for k, v in parse_qs(parts.query).items()}
            if parts.path == "/find":
                body = json.dumps({"web": {"results": [{"url": f"https://www.t{asked['offset']}.mx/", "name": asked["q"], "description": "juegos de mesa carrito mexico", "extra_snippets": [self.headers["X-Subscription-Token"]]}, {"title": "no url"}]}})
            else:
                body = f'<items><item type="boardgame" id="{asked.get("id", 1)}"><name type="primary" value="{asked.get("query", self.headers["Authorization"])}"/></item></items>'
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_sources_by_request(spark, service):
    spark.dataSource.register(tables.SearchSource)
    got = spark.read.format("catalog_search").options(queries='["q1","q2"]', pages=2, endpoint=f"{service}/find", key="k").load().orderBy("query", "rank").collect()
    assert [(r.title, r.url, r.description, r.query, r["rank"]) for r in got[:2]] == [("q1", "https://www.t0.mx/", "juegos de mesa carrito mexico k", "q1", 1), ("q1", "https://www.t1.mx/", "juegos de mesa carrito mexico k", "q1", 21)]
    spark.dataSource.register(tables.XmlSource)
    things = spark.read.format("catalog_xml").options(asked="[5, 6]", endpoint=service, key="token").load()
    assert sorted((r.asked, r.t.bgg_id, r.t.name) for r in things.select("asked", markup.thing(F.col("body")).alias("t")).collect()) == [("5", 5, "Bearer token"), ("6", 6, "Bearer token")]
    found = spark.read.format("catalog_xml").options(asked='["azul"]', kind="search", endpoint=service).load()
    assert found.select(F.explode(markup.search_items(F.col("body"))).alias("i")).first().i.name == "azul"


def test_store_and_item_jobs(spark, service, tmp_path, capsys):
    pages = [("https://www.t0.mx/", "<title>Tienda</title>"), ("https://t0.mx/producto/a", "<h1>Azul</h1><p>$ 500</p><p>2 a 4 jugadores</p><p>juego de mesa</p>")]
    spark.createDataFrame(pages, "url string, html string").write.parquet(f"{tmp_path}/t/pages")
    spark.createDataFrame([("https://t0.mx/sitemap.xml", "<urlset><loc>https://t0.mx/producto/a</loc><loc>https://t0.mx/producto/b</loc></urlset>")], "url string, body string").write.parquet(f"{tmp_path}/t/sitemaps")
    folders = ["--tables", f"{tmp_path}/t", "--out", f"{tmp_path}/o", "--env-file", f"{tmp_path}/none"]
    assert jobs.main(["stores", *folders, "--endpoint", f"{service}/find"], spark) == 2
    assert jobs.main(["stores", *folders, "--endpoint", f"{service}/find", "--api-key", "k", "--max-queries", "2", "--export-files"], spark) == 0
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert told["status"] == "completed" and (told["result"]["queries"], told["result"]["domains"], told["result"]["accepted"]) == (2, 1, 1)
    assert spark.read.option("header", True).csv(f"{tmp_path}/o/stores_csv").first().store_name == "Tienda"
    stored = "id long, store_id int, source_url string, title string, price string, listing_status string, item_id int, match_source string, processed_at timestamp, is_boardgame boolean"
    spark.createDataFrame([(9, 3, "https://t0.mx/producto/b", "old", "1", "SEEN", None, "", None, True)], stored).write.parquet(f"{tmp_path}/t/items")
    assert jobs.main(["items", *folders, "--store-id", "3", "--website", "https://t0.mx/"], spark) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["result"] == {"candidates": 1, "to_process": 1}
    after = {r.source_url: r for r in spark.read.parquet(f"{tmp_path}/o/items").collect()}
    assert (after["https://t0.mx/producto/a"].title, after["https://t0.mx/producto/a"].price, after["https://t0.mx/producto/a"].id, after["https://t0.mx/producto/b"].title) == ("Azul", "500.00", 10, "old")
    assert jobs.main(["items", *folders[:1], f"{tmp_path}/absent"], spark) == 1
    assert jobs.main(["queries", "--query-scope", "core"], spark) == 0 and len(capsys.readouterr().out.strip().splitlines()) == 24


def test_scopes(spark):
    assert [len(jobs.search_strings(spark, s)) for s in jobs.SCOPES] == [23, 47, 107]


def test_import_reaches_what_links_lead_to(spark):
    assert {f"item_{n}" for n in imports.LOOKUPS.values()} == {"item_categories", "item_mechanics", "item_families"}
    link = "bgg_id long, link_type string, name string, inbound boolean"
    rows = [(1, [(2, "boardgameimplementation", "b", False)]), (2, [(1, "boardgameimplementation", "a", False), (3, "boardgameexpansion", "p", True)]), (3, []), (4, [])]
    things = spark.createDataFrame(rows, f"bgg_id long, links array<struct<{link.replace(' long', ': long').replace(' string', ': string').replace(' boolean', ': boolean')}>>")
    seeds = spark.createDataFrame([(1,), (99,)], "bgg_id long")
    assert sorted(map(tuple, imports.reached(things, seeds).collect())) == [(1, 0), (2, 1), (3, 2)]
    assert imports.reached(things, seeds.filter("bgg_id = 99")).count() == 0
