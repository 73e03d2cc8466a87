import pytest
from pyspark.sql import functions as F

from gleaner.functions import vocab
from gleaner.operators import graph, relate, upsert
from gleaner.plans import discovery
from gleaner.sources import exports, tables


def test_upsert_is_null_safe_and_keeps(spark):
    target = spark.createDataFrame([(1, None, "a", "old"), (2, 5, "b", "old")], "id int, store int, url string, status string")
    source = spark.createDataFrame([(9, None, "a", "new"), (10, 7, "c", "new")], "id int, store int, url string, status string")
    got = {(r.store, r.url): (r.id, r.status) for r in upsert.upsert(target, source, ["store", "url"], kept=("id",)).collect()}
    assert got == {(None, "a"): (1, "new"), (5, "b"): (2, "old"), (7, "c"): (10, "new")}


def test_item_upsert_tells_what_to_process(spark):
    schema = "id long, store_id int, source_url string, title string, listing_status string, item_id long, match_source string, processed_at timestamp"
    target = spark.createDataFrame([(1, None, "a", "x", "LINKED", 7, "m", None), (2, 1, "b", "x", "PENDING", None, " ", None)], schema)
    source = spark.createDataFrame([(None, "a", "y", "PENDING"), (1, "b", "y", "PENDING"), (1, "c", "y", "PENDING")], "store_id int, source_url string, title string, listing_status string")
    after, result = upsert.upsert_items(target, source)
    assert {r.source_url: (r.title, r.listing_status) for r in after.collect()} == {"a": ("y", "LINKED"), "b": ("y", "PENDING"), "c": ("y", "PENDING")}
    assert sorted((r.candidate_id, r.should_process) for r in result.collect()) == [(1, False), (2, True), (3, True)]


def test_relations_drop_their_inverse(spark):
    schema = "item_a_id int, link_type string, item_b_id int"
    got = upsert.relate_items(spark.createDataFrame([(1, "extension", 2), (1, "other", 3)], schema), spark.createDataFrame([(2, "extension", 1), (3, "other", 1)], schema))
    assert sorted(map(tuple, got.collect())) == [(1, "other", 3), (2, "extension", 1), (3, "other", 1)]


def test_closure_survives_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    got = graph.closure(edges, spark.createDataFrame([(1,)], "id int")).collect()
    assert sorted((r.id, r.hops) for r in got) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_crawl_reports_blocked(spark):
    fetched = spark.createDataFrame([("https://s.mx/sitemap.xml", "<script>location.reload()</script><title>Just a moment</title>")], "url string, body string")
    found, blocked = graph.crawl(fetched.select("url"), fetched)
    assert found.count() == 0 and blocked.count() == 1


def test_crawl_decides_for_each_store(spark):
    index = lambda *maps: "<sitemapindex>" + "".join(f"<loc>{m}</loc>" for m in maps) + "</sitemapindex>"
    urls = lambda *found: "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in found) + "</urlset>"
    fetched = spark.createDataFrame(
        [
            ("https://a.mx/sitemap.xml", index("/products.xml", "/pages.xml")), ("https://a.mx/products.xml", urls("/product/1?v=1", "/product/1?v=2", "/product/2")), ("https://a.mx/pages.xml", urls("/product/no")),
            ("https://b.mx/sitemap.xml", index("/one.xml")), ("https://b.mx/one.xml", index("/two.xml")), ("https://b.mx/two.xml", urls("/product/1", "https://a.mx/product/far")),
            ("https://c.mx/product-sitemap.xml", urls("/product/1")), ("https://d.mx/sitemap.xml", "<script>location.reload()</script><title>Just a moment</title>"),
        ],
        "url string, body string",
    )
    roots = spark.createDataFrame([(f"https://{s}.mx/sitemap.xml",) for s in "abcd"], "url string")
    found, blocked = graph.crawl(roots, fetched)
    assert sorted(r.url for r in found.collect()) == ["https://a.mx/product/1", "https://a.mx/product/2", "https://b.mx/product/1", "https://c.mx/product/1"]
    assert [r.url for r in blocked.collect()] == ["https://d.mx/sitemap.xml"]
    assert sorted(r.url for r in graph.crawl(roots, fetched, limit=1)[0].collect()) == ["https://a.mx/product/1", "https://b.mx/product/1", "https://c.mx/product/1"]
    with pytest.raises(RuntimeError, match="d.mx"):
        graph.crawl(roots, fetched, strict=True)
    assert graph.crawl(roots.limit(0), fetched.limit(0))[0].count() == 0


def test_ids_do_not_depend_on_partitions(spark):
    target = spark.createDataFrame([(7, "a")], "id long, k string")
    source = spark.createDataFrame([(x,) for x in "abcdefgh"] + [(None,)], "k string")
    got = []
    for parts in ("2", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got.append({r.k: r.id for r in upsert.with_ids(target, source, ["k"], "id").collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] and got[0]["a"] == 7 and sorted(got[0].values()) == list(range(7, 16))


def test_first_of_equals_wins(spark):
    rows = spark.createDataFrame([(1, 1, "aa"), (1, 2, "bb"), (1, 3, "c")], "k int, seq int, t string")
    assert relate.best_by(rows, ["k"], F.length("t"), "seq").first().t == "aa"


def test_query_strings(spark):
    core = spark.createDataFrame(list(enumerate(vocab.CORE_QUERIES)), "seq long, query string")
    cities = spark.createDataFrame(list(enumerate(vocab.QUERY_CITIES)), "seq long, place string")
    assert relate.query_strings(core, cities, vocab.CITY_QUERIES).count() == 47


def test_search_payload(spark):
    body = '{"web":{"results":[{"url":"","title":"x"},{"url":"u","name":"n","description":"d","extra_snippets":["s"]}]}}'
    got = spark.createDataFrame([(body,)], "b string").select(F.explode(tables.parse_search(F.col("b"))).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [(1, "n", "u", "d s")]


def test_store_discovery(spark, tmp_path):
    results = spark.createDataFrame([(1, "Mi Tienda | x", "https://www.tienda.mx/a", "juegos de mesa", "q2"), (2, "t", "https://tienda.mx/b", "juegos de mesa carrito mexico", "q1"), (3, "f", "https://facebook.com/x", "d", "q1"), (4, "blog", "https://blog.com/", "nada", "q1")], "seq long, title string, url string, description string, query string")
    pages = spark.createDataFrame([("https://www.tienda.mx/", "<title>Tienda</title><p>Puebla</p>")], "url string, html string")
    blocked = spark.createDataFrame([(b,) for b in vocab.BLOCKED_DOMAINS], "domain string")
    stores, audit = discovery.discover_stores(results, pages, blocked)
    assert [(r.canonical_domain, r.city, r.status, r.store_name) for r in stores.collect()] == [("tienda.mx", "Puebla", "ACCEPTED", "Tienda")]
    assert {r.canonical_domain: r.accepted for r in audit.collect()} == {"tienda.mx": True, "blog.com": False}
    out = exports.store_rows(exports.store_order(stores))
    csv, _ = exports.write(out, str(tmp_path), "stores")
    assert out.first().source_queries == "q1 | q2" and spark.read.option("header", True).csv(csv).count() == 1


def test_item_discovery(spark):
    html = "<h1>Juego Azul</h1><p>juego de mesa</p><p>2 a 4 jugadores</p><p>$ 500 en stock</p>"
    pages = spark.createDataFrame([("https://s.mx/producto/juego-azul", html), ("https://s.mx/tienda", '<a href="/producto/juego-azul">Juego Azul</a><a href="/producto/otro">Otro</a><i>$ 9</i>')], "url string, html string")
    roots = spark.createDataFrame([("https://s.mx/sitemap.xml",)], "url string")
    existing = spark.createDataFrame([], "store_id int, source_url string")
    got = {r.source_url: r for r in discovery.discover_items(4, roots, pages.selectExpr("url", "html AS body").limit(0), pages, existing).collect()}
    assert got["https://s.mx/producto/juego-azul"].is_boardgame and got["https://s.mx/producto/juego-azul"].price == "500.00"
    assert got["https://s.mx/producto/otro"].price == "9.00"
    known = spark.createDataFrame([(4, "https://s.mx/producto/otro")], "store_id int, source_url string")
    assert discovery.discover_items(4, roots, pages.selectExpr("url", "html AS body").limit(0), pages, known).count() == 1


def test_observations_stream(spark, tmp_path):
    from gleaner.streaming import observations

    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "k int, v string, seq int").coalesce(1).write.parquet(source)
    spark.createDataFrame([(1, "old"), (3, "kept")], "k int, v string").write.parquet(f"{state}/0")
    newest = [0]

    def write(df, number):
        newest[0] = number + 1
        df.write.mode("overwrite").parquet(f"{state}/{newest[0]}")

    stream = spark.readStream.schema("k int, v string, seq int").parquet(source)
    observations.maintain(stream, lambda: spark.read.parquet(f"{state}/{newest[0]}"), write, ["k"], "seq", str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{state}/{newest[0]}").collect())) == [(1, "b"), (2, "c"), (3, "kept")]
