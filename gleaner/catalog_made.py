"""Registered queries over pages, payloads and tables that are made of the standard tables, so that SQL knows every fact.

Each query runs the operator over what its maker writes (HTML, XML, JSON, stored rows); its SQL says the facts directly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import markup, rules, text, urls
from .operators import upsert
from .plans import discovery, imports
from .sources import exports, records
from .sources.tables import first_snapshot, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def _said(*parts):
    """Text of literals and columns; a part that names a column in braces is that column."""
    return F.concat(*(F.col(p[1:-1]).cast("string") if isinstance(p, str) and p.startswith("{") and p.endswith("}") else F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# --- product, listing and site pages --------------------------------------------------------------------


def product_html(parts):
    """key, url, html: four kinds of product pages, and one without a title."""
    rows = parts.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), (F.col("p_size") + 100).alias("n"))
    kind = F.col("key") % 4
    title = _said("{name}", " ", "{key}")
    json_ld = _said('<script type="application/ld+json">{"@graph":[{"@type":["Thing","Product"],"name":"', title, '","sku":"S', "{key}", '","brand":{"name":"', "{brand}", '"},"description":"un juego de mesa","image":["/i/', "{key}", '.jpg"],"offers":[{"price":"1,', "{n}", '","priceCurrency":"mxn","availability":"https://schema.org/InStock"}]}]}</script>')
    head = F.when(kind == 0, json_ld).when(kind == 2, _said('<meta property="og:title" content="', title, ' - Tienda"><meta property="og:image" content="//cdn.mx/', "{key}", '.png"><meta name="description" content="meta text">')).otherwise("")
    body = (
        F.when(kind == 0, "<h1>other</h1><p>2 a 4 jugadores</p><p>30-45 min</p><p>Edad: 8+</p>")
        .when(kind == 1, _said("<h1>", title, '</h1><div class="woocommerce-product-gallery"><a href="/g/', "{key}", '.webp"></a></div><p class="price">$ ', "{n}", '</p><p class="stock out-of-stock">sin</p><p>Editorial: ', "{brand}", "</p><p>Idioma: Español</p><p>Texto largo de la caja.</p>"))
        .when(kind == 2, _said("<p>Expansión</p><span>Precio 3", "{n}", '.50 MXN</span><span>Disponible</span><img src="data:x" srcset="/a.png 1w, /b', "{key}", '.png 2w" alt="', title, '"><p>Jugadores: 3 - 5</p><p>60 min</p><p>English</p>'))
        .when(F.col("key") % 8 == 3, _said("<h2>", title, "</h2><p>Solo $ 900 hoy</p><p>Nada más</p>"))
        .otherwise("<p>x</p>")
    )
    named = F.when(kind == 3, "").otherwise(_said("<title>", title, " | Tienda</title>"))
    html = _said('<html lang="es"><head>', named, head, '</head><body><div class="elementor-menu-cart"><span>$5.00 Agotado</span></div>', body, "</body></html>")
    url = _said("https://s.mx/producto/", F.when(kind == 2, "expansion-").otherwise(""), "{key}")
    return rows.select("key", url.alias("url"), html.alias("html"))


_PRODUCTS = """p AS (SELECT p_partkey AS key, p_partkey % 4 AS k, p_name || ' ' || p_partkey AS title, p_brand AS brand, CAST(p_size + 100 AS VARCHAR) AS n FROM part WHERE p_partkey % 8 <> 7)"""


@query(f"""WITH {_PRODUCTS} SELECT key, title, CASE k WHEN 0 THEN brand WHEN 1 THEN brand ELSE '' END AS publisher, CASE k WHEN 0 THEN 'un juego de mesa' WHEN 1 THEN 'Texto largo de la caja.' WHEN 2 THEN 'meta text' ELSE 'Nada más' END AS description,
CASE k WHEN 2 THEN 'expansion' ELSE 'unknown' END AS item_type, CASE k WHEN 0 THEN 2 WHEN 2 THEN 3 END AS min_players, CASE k WHEN 0 THEN 4 WHEN 2 THEN 5 END AS max_players, CASE k WHEN 0 THEN 30 WHEN 2 THEN 60 END AS min_minutes, CASE k WHEN 0 THEN 45 WHEN 2 THEN 60 END AS max_minutes, CASE k WHEN 0 THEN 8 END AS min_age,
CASE k WHEN 1 THEN 'es' WHEN 2 THEN 'en' ELSE '' END AS language, CASE k WHEN 1 THEN 'product_language_label' WHEN 2 THEN 'page_text' ELSE '' END AS language_source, CASE k WHEN 1 THEN 'Idioma: Español Texto largo de la caja.' ELSE '' END AS label_evidence,
CASE k WHEN 0 THEN '1,' || n WHEN 1 THEN '$' || n WHEN 2 THEN '3' || n || '.50 MXN' ELSE '$900' END AS raw_price, CASE k WHEN 0 THEN '1' || n WHEN 1 THEN n || '.00' WHEN 2 THEN '3' || n || '.50' ELSE '900.00' END AS price, CASE k WHEN 0 THEN 'json_ld_offer' WHEN 1 THEN 'woocommerce_product_price' ELSE 'generic_text' END AS price_source, 'MXN' AS currency,
CASE k WHEN 0 THEN 'available' WHEN 1 THEN 'out_of_stock' WHEN 2 THEN 'available' ELSE 'unknown' END AS availability, CASE k WHEN 0 THEN 'json_ld_offer' WHEN 1 THEN 'woocommerce_stock' WHEN 2 THEN 'generic_text' ELSE 'none' END AS availability_source,
CASE k WHEN 0 THEN 'https://s.mx/i/' || key || '.jpg' WHEN 1 THEN 'https://s.mx/g/' || key || '.webp' WHEN 2 THEN 'https://s.mx/b' || key || '.png' ELSE '' END AS image_url, CASE k WHEN 0 THEN 'S' || key ELSE '' END AS store_sku,
CASE k WHEN 0 THEN 0.93 WHEN 2 THEN 0.96 ELSE 0.5 END::DOUBLE AS category_confidence, k IN (0, 2) AS is_boardgame, false AS is_boardgame_confirmed,
CASE k WHEN 0 THEN 'player count found|play time found|minimum age found|boardgame terms found: juego de mesa' WHEN 2 THEN 'player count found|play time found|expansion terms found: expansion' ELSE 'insufficient classification evidence' END AS reasons FROM p""")
def product_records(spark, d):
    """Detail records of product pages with their classification: every field from each of its sources."""
    rows = discovery.classify(markup.product_details(product_html(table(spark, d, "part"))))
    evidence = F.when(F.col("language_source") == "product_language_label", F.col("language_evidence")).otherwise("")
    picked = ["key", "title", "publisher", "description", "item_type", "min_players", "max_players", "min_minutes", "max_minutes", "min_age", "language", "language_source", "raw_price", "price", "price_source", "currency", "availability", "availability_source", "store_sku", "is_boardgame", "is_boardgame_confirmed"]
    return rows.select(*picked, evidence.alias("label_evidence"), F.coalesce("image_url", F.lit("")).alias("image_url"), "category_confidence", F.array_join("classification_reasons", "|").alias("reasons"))


@query("""SELECT s_suppkey AS key, 'https://s' || s_suppkey || '.mx/producto/' || s_suppkey AS source_url, 'Juego ' || s_suppkey AS title, '$ ' || s_nationkey AS raw_price, s_nationkey || '.00' AS price, 'listing_context' AS price_source, 'out_of_stock' AS availability, 'listing_context' AS availability_source FROM supplier
UNION ALL SELECT s_suppkey, 'https://s' || s_suppkey || '.mx/tienda/producto/b' || s_suppkey, 'Otro', 'MXN ' || s_nationkey || '.5', s_nationkey || '.5', 'listing_context', 'unknown', 'none' FROM supplier""")
def listing_records(spark, d):
    """Product links of listing pages, with price and stock from the text around them."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("n"))
    html = _said('<p>Oferta</p><a href="/producto/', "{key}", '?x=1">Juego ', "{key}", "</a><span>$ ", "{n}", '</span><span>Agotado</span><a href="/blog">no</a><a href="/producto/', "{key}", '">JUEGO ', "{key}", '</a><a href="https://o.org/producto/1">far</a><a href="producto/b', "{key}", '#f">Otro</a><span>MXN ', "{n}", ".5</span>")
    pages = rows.select("key", _said("https://s", "{key}", ".mx/tienda/").alias("url"), html.alias("html"))
    found = markup.listing_candidates(pages.select("url", "html"))
    return found.join(pages.select("key", "url"), "url").select("key", "source_url", "title", "raw_price", "price", "price_source", "availability", "availability_source")


@query("""SELECT s_suppkey AS key, CASE s_suppkey % 3 WHEN 0 THEN 'Tienda ' || s_suppkey WHEN 1 THEN 'App ' || s_suppkey ELSE 'Pagina ' || s_suppkey END AS store_name, CASE WHEN s_suppkey % 2 = 0 THEN 'https://instagram.com/t' || s_suppkey ELSE '' END AS instagram_url, 'https://facebook.com/f' || s_suppkey AS facebook_url,
CASE WHEN s_suppkey % 2 = 0 THEN 'Guadalajara' ELSE '' END AS city, CASE WHEN s_suppkey % 2 = 0 THEN 'Jalisco' ELSE 'Sonora' END AS state, 'Mexico' AS country, CASE WHEN s_suppkey % 3 = 0 THEN 'https://s.mx/logo.png' ELSE 'https://s.mx/f.ico' END AS store_logo,
'Pagina ' || s_suppkey || ' | x i f c n o ' || CASE WHEN s_suppkey % 2 = 0 THEN 'Guadalajara' ELSE 'Sonora' END AS page_text, 'https://s.mx/contacto,https://s.mx/nosotros' AS internal_links FROM supplier""")
def site_records(spark, d):
    """Store metadata of home pages."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"))
    kind, even = F.col("key") % 3, F.col("key") % 2 == 0
    meta = F.when(kind == 0, _said('<meta property="og:site_name" content=" Tienda ', "{key}", ' - MX "><meta property="og:image" content="/logo.png">')).when(kind == 1, _said('<meta name="application-name" content="App ', "{key}", '">')).otherwise("")
    html = _said("<title>Pagina ", "{key}", " | x</title>", meta, '<link rel="shortcut icon" href="/f.ico"><a href="', F.when(even, _said("https://www.instagram.com/t", "{key}", "/?hl=es")).otherwise("https://instagram.com/p/1"), '">i</a><a href="https://facebook.com/f', "{key}", '">f</a><a href="/contacto?x">c</a><a href="nosotros#a">n</a><a href="https://o.org/contacto">o</a><p>', F.when(even, "Guadalajara").otherwise("Sonora"), "</p>")
    return markup.site_metadata(rows.select("key", F.lit("https://s.mx/").alias("url"), html.alias("html"))).select("key", "store_name", "instagram_url", "facebook_url", "city", "state", "country", "store_logo", "page_text", F.array_join("internal_links", ",").alias("internal_links"))


# --- helpers of text, URLs and pages ---------------------------------------------------------------------


@query("""SELECT p_partkey AS key, replace(p_name, ' ', '-') || '-co' AS slug, 'covers/' || replace(p_name, ' ', '-') || '-co.webp' AS asset, 'https://c.org/covers/' || replace(p_name, ' ', '%20') || '.webp' AS public, 'https://boardgamegeek.com/' || CASE WHEN p_partkey % 2 = 0 THEN 'boardgameexpansion' ELSE 'boardgame' END || '/' || p_partkey AS item_url,
p_partkey % 2 = 0 AS is_image, CASE WHEN p_size >= 1 THEN 'juego,' || p_size || 'mil' END AS url_tokens, p_partkey % 3 <> 2 AS rendered, p_partkey % 4 = 1 AS challenge, CASE WHEN p_partkey % 2 = 0 THEN 'https://s.mx/a/contacto' ELSE '' END AS links FROM part""")
def url_helpers(spark, d):
    """Slugs, keys, public and item URLs, image and rendered-page tests, telling URL tokens, protection pages."""
    rows = table(spark, d, "part").withColumnRenamed("p_partkey", "key")
    even = F.col("key") % 2 == 0
    url = _said("https://s.mx/producto/juego-de-", "{p_size}", "mil/")
    body = F.when(F.col("key") % 3 == 0, "un Juego $ 10").when(F.col("key") % 3 == 1, "juego AGOTADO").otherwise("juego")
    page = F.when(F.col("key") % 4 == 1, "<title>Just a Moment</title><script>window.location.reload()</script>").when(F.col("key") % 4 == 2, "<title>moment</title>").otherwise("location.reload()")
    links = F.when(even, F.array(F.lit("https://s.mx/a/contacto?x=1"), F.lit("https://o.org/contacto"), F.lit("https://s.mx/a/contacto#y"))).otherwise(F.array(F.lit("https://s.mx/blog")))
    return rows.select(
        "key", urls.slugify(_said("{p_name}", " & Có")).alias("slug"), urls.asset_key(_said("{p_name}", "--co"), "/covers/").alias("asset"), urls.public_url("https://c.org/", _said("covers/", "{p_name}", ".webp")).alias("public"),
        urls.item_url(F.when(even, "boardgameexpansion").otherwise("boardgame"), F.col("key")).alias("item_url"), urls.is_image(F.when(even, _said("https://s.mx/x", "{key}", ".JPG?v=1")).otherwise("data:image.png")).alias("is_image"),
        F.array_join(urls.url_tokens(url), ",").alias("url_tokens"), urls.is_rendered(url, body).alias("rendered"), markup.is_challenge(page).alias("challenge"), F.array_join(urls.enrichment_links(links, F.lit("https://s.mx/")), ",").alias("links"),
    )


@query("""SELECT o_orderkey AS key, 'orden,' || o_orderkey AS tokens, CASE o_orderkey % 3 WHEN 0 THEN 'Tienda' WHEN 1 THEN 'solo' ELSE 's.mx' END AS fallback, CASE WHEN o_orderkey % 2 = 0 THEN 'b ' || o_orderkey ELSE 'c' END AS first, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 0.5 END AS number, 'a,b c' AS strings,
CASE WHEN o_orderkey % 2 = 0 THEN 'x,' || o_orderkey ELSE '' END AS entries, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS field, '$' || o_custkey AS tidy, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS stamp,
CASE WHEN o_totalprice / 1e6 >= 0.70 THEN 'accepted' WHEN o_totalprice / 1e6 >= 0.35 THEN 'review' ELSE 'failed' END AS band, '[1.5,' || CAST(o_orderkey AS VARCHAR) || '.0]' AS vector FROM orders""")
def text_helpers(spark, d):
    """Tokens, title and text fallbacks, coercers, raw prices, timestamps and confidence bands."""
    rows = table(spark, d, "orders").withColumnRenamed("o_orderkey", "key")
    k, even = F.col("key"), F.col("key") % 2 == 0
    title = F.when(k % 3 == 0, " Tienda | Uno - Dos").when(k % 3 == 1, " solo ").otherwise("  ")
    return rows.select(
        "key", F.array_join(text.tokens(_said("Órden la x ", "{key}", " órden"), 1, ["la", "x"]), ",").alias("tokens"),
        text.title_fallback(title, F.lit("s.mx")).alias("fallback"), text.first_text(F.lit(" "), F.when(even, _said(" b \n ", "{key}")).otherwise(""), F.lit("c")).alias("first"),
        records.optional_float(F.when(even, _said(" ", "{key}", ".5 ")).otherwise(" ")).alias("number"), F.array_join(records.string_list(F.array(F.lit(" a"), F.lit(" "), F.lit("b c "))), ",").alias("strings"),
        F.array_join(records.json_list(F.when(even, _said('["x",', "{key}", "]")).otherwise('{"x":1}')), ",").alias("entries"), F.coalesce(records.json_object(F.when(even, _said('{"x":', "{key}", "}")).otherwise("[1]"))["x"], F.lit("")).alias("field"),
        rules.tidy_raw_price(_said("$  ", "{o_custkey}")).alias("tidy"), text.iso_timestamp(F.col("o_orderdate")).alias("stamp"), rules.band(F.col("o_totalprice") / 1e6).alias("band"), text.vector_literal(F.array(F.lit(1.5), k.cast("double"))).alias("vector"),
    )


# --- stored items ----------------------------------------------------------------------------------------


def stored_texts(rows):
    """Item rows of ``part`` as texts, some of them missing."""
    k = F.col("p_partkey")
    return rows.select(
        k.alias("id"), (k % 7).alias("last_updated"), F.when(k % 5 != 0, (k % 3).cast("string")).alias("store_id"), _said("https://s.mx/producto/", "{p_partkey}").alias("source_url"), F.col("p_name").alias("title"), F.when(k % 2 == 0, k.cast("string")).otherwise("").alias("item_id"),
        F.when(k % 3 == 0, "base_game").alias("item_type"), F.when(k % 4 == 0, "APPROVED").otherwise("").alias("listing_status"), F.when(k % 3 == 1, "10.50").otherwise("").alias("price"), F.when(k % 3 == 2, "USD").alias("currency"), F.when(k % 4 < 3, "true").otherwise("false").alias("is_boardgame"),
        F.when(k % 8 < 5, "true").alias("is_boardgame_confirmed"), F.lit("0.75").alias("category_confidence"), F.when(k % 2 == 0, '["a","b"]').otherwise('{"a":1}').alias("classification_reasons"), F.lit('{"m":1}').alias("raw_payload"), F.when(k % 6 == 0, "boom").alias("processing_error"),
    )


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 3 AS INTEGER) END AS store_id, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS INTEGER) END AS item_id, CASE WHEN p_partkey % 3 = 0 THEN 'base_game' ELSE 'unknown' END AS item_type, CASE WHEN p_partkey % 4 = 0 THEN 'APPROVED' ELSE 'PENDING' END AS listing_status,
CASE WHEN p_partkey % 3 = 1 THEN '10.50' END AS price, 'none' AS price_source, CASE WHEN p_partkey % 3 = 2 THEN 'USD' ELSE 'MXN' END AS currency, 'unknown' AS availability, p_partkey % 4 < 3 AS is_boardgame, p_partkey % 8 < 5 AS is_boardgame_confirmed, 0.75 AS category_confidence,
CASE WHEN p_partkey % 2 = 0 THEN '["a","b"]' ELSE '[]' END AS classification_reasons, '{"m":"1"}' AS raw_payload, CASE WHEN p_partkey % 6 = 0 THEN 'boom' ELSE '' END AS processing_error, '' AS publisher, 39 AS n_columns FROM part""")
def decoded_items(spark, d):
    """Stored rows decoded with their defaults, and the same as they are written again: 39 columns."""
    held = records.decode_items(stored_texts(table(spark, d, "part")))
    rows = records.database_rows(held.select(*records.READ_COLUMNS))
    ids = F.regexp_extract("source_url", "([0-9]+)$", 1).cast("long").alias("id")
    picked = ["store_id", "item_id", "item_type", "listing_status", "price_source", "currency", "availability", "is_boardgame", "is_boardgame_confirmed", "category_confidence", "classification_reasons", "raw_payload", "processing_error", "publisher"]
    return rows.select(ids, *picked, F.col("price").cast("string").alias("price"), F.lit(len(rows.columns)).alias("n_columns"))


@query("""SELECT p_partkey AS id, p_partkey % 7 AS last_updated FROM part WHERE p_partkey % 4 < 3 AND p_partkey % 8 < 5 AND p_partkey % 2 = 0 ORDER BY p_partkey % 7, p_partkey LIMIT 50""")
def confirmed_scan(spark, d):
    """The first 50 confirmed games, those updated longest ago first: a limit that is the feature."""
    return records.confirmed(records.decode_items(stored_texts(table(spark, d, "part"))), 50).select("id", "last_updated")


@query("""SELECT p_partkey AS key FROM part WHERE p_partkey % 2 = 0""")
def stored_exists(spark, d):
    """Which candidates are stored; a missing store is a store of its own."""
    rows = table(spark, d, "part")
    stored = records.decode_items(stored_texts(rows))
    keys = rows.select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 5 != 0, (F.col("p_partkey") % 3).cast("int")).alias("store_id"), F.when(F.col("p_partkey") % 2 == 0, _said("https://s.mx/producto/", "{p_partkey}")).otherwise(_said("https://s.mx/producto/x", "{p_partkey}")).alias("source_url"))
    return records.stored_matches(keys, stored).select("key")


@query(f"""WITH {_PRODUCTS}, s AS (SELECT p_partkey AS id, p_partkey % 4 AS k, p_partkey % 8 <> 7 AS paged, p_partkey % 8 < 5 AND p_partkey % 4 < 3 AND p_partkey % 2 = 0 AS due, p_name AS old FROM part)
SELECT id, CASE WHEN due THEN coalesce(p.title, old) ELSE old END AS title, CASE WHEN due AND s.k = 0 THEN '1' || n WHEN due AND s.k = 2 THEN '3' || n || '.50' WHEN id % 3 = 1 THEN '10.50' ELSE '' END AS price, CASE WHEN id % 4 = 0 THEN 'APPROVED' ELSE 'PENDING' END AS listing_status, CASE WHEN id % 2 = 0 THEN CAST(id AS INTEGER) END AS item_id, id % 4 < 3 AS is_boardgame, id % 8 < 5 AS is_boardgame_confirmed, 0.75 AS category_confidence, s.due AS refreshed
FROM s LEFT JOIN p ON p.key = s.id""")
def confirmed_refresh(spark, d):
    """Confirmed games read again from their pages: facts are new; keys, status, links and classification stay."""
    parts = table(spark, d, "part")
    pages = product_html(parts)
    stored = records.decode_items(stored_texts(parts)).drop("source_url").join(pages.select(F.col("key").alias("id"), F.col("url").alias("source_url")), "id")
    stored = stored.withColumn("source_listing_url", F.lit("https://s.mx/tienda")).withColumn("last_updated", F.lit("2020-01-01").cast("timestamp"))
    after, _ = discovery.refresh_confirmed(stored, pages.select("url", "html"))
    return after.select("id", "title", "price", "listing_status", "item_id", "is_boardgame", "is_boardgame_confirmed", "category_confidence", (F.year("last_updated") > 2020).alias("refreshed"))


@query("""SELECT p_partkey AS key, CASE WHEN p_partkey % 5 = 0 THEN 'listing' WHEN p_partkey % 5 = 1 THEN 'rendered' WHEN p_partkey % 5 = 2 THEN 'listing' WHEN p_partkey % 5 = 3 THEN 'static' ELSE 'rendered' END AS origin,
CASE p_partkey % 5 WHEN 3 THEN '5.00' WHEN 0 THEN '1.00' WHEN 2 THEN '1.00' ELSE '7.00' END AS price, CASE p_partkey % 5 WHEN 3 THEN 'available' ELSE 'out_of_stock' END AS availability FROM part""")
def detail_choice(spark, d):
    """For each listing its static record, else its rendered one, else itself; price and stock fall back on the listing."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("key"), _said("https://s.mx/producto/caja-", "{p_partkey}").alias("url"))
    k = F.col("key") % 5
    listing = rows.select("key", F.col("url").alias("source_url"), F.lit("Caja grande").alias("title"), F.lit("$1").alias("raw_price"), F.lit("1.00").alias("price"), F.lit("listing_context").alias("price_source"), F.lit("out_of_stock").alias("availability"), F.lit("listing_context").alias("availability_source"))
    record = lambda title, price, stock: rows.select("key", F.col("url").alias("source_listing_url"), title.alias("title"), price.alias("raw_price"), price.alias("price"), F.lit("x").alias("price_source"), stock.alias("availability"), F.lit("x").alias("availability_source"))
    static = record(F.when(k == 3, "La Caja").when(k == 4, "This website uses cookies").when(k == 1, "Otra cosa").otherwise(" "), F.lit("5.00"), F.lit("available")).filter("key % 5 <> 0")
    rendered = record(F.when(k == 2, "Nada que ver").otherwise("Caja"), F.lit("7.00"), F.lit("unknown")).filter("key % 5 IN (1, 2, 4)")
    chosen = upsert.choose_detail(static.drop("key"), rendered.drop("key"), listing)
    flat = chosen.select("key", "origin", F.col("source_url").alias("source_listing_url"), *(F.col(f"detail.{c}").alias(c) for c in ("raw_price", "price", "price_source", "availability", "availability_source")))
    return upsert.with_listing(flat, listing.drop("key")).select("key", "origin", "price", "availability")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE 'human' END AS match_source, CASE WHEN o_orderkey % 3 = 0 THEN 'no title' ELSE 'old' END AS reasons, o_orderkey % 3 = 0 AS processed, o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AS handed_on FROM orders""")
def no_matches(spark, d):
    """Candidates marked as processed without a match, and those of the others that are handed to the matcher."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("human").alias("match_source"), F.lit("old").alias("match_reasons"), F.lit(None).cast("timestamp").alias("processed_at"), (F.col("o_orderkey") % 2 == 0).alias("is_boardgame"), F.lit("t").alias("title"), F.lit("p").alias("publisher"), F.lit("u").alias("source_url"))
    after = upsert.mark_not_matched(rows, rows.filter("id % 3 = 0").select("id", F.lit("no title").alias("reasons")))
    handed = discovery.match_requests(after, after.select(F.col("id").alias("candidate_id"), F.col("processed_at").isNull().alias("should_process"))).select("id", F.lit(True).alias("handed_on"))
    return after.join(handed, "id", "left").select("id", "match_source", F.col("match_reasons").alias("reasons"), F.col("processed_at").isNotNull().alias("processed"), F.coalesce("handed_on", F.lit(False)).alias("handed_on"))


@query("""SELECT page_id AS key, CASE WHEN page_id % 3 = 0 THEN 'static' WHEN page_id % 3 = 1 THEN 'rendered' END AS body, page_id % 3 = 1 OR page_id % 3 = 2 AS blocked FROM pages""")
def fallback_snapshots(spark, d):
    """The static snapshot of each page, or the rendered one where that is a protection page."""
    rows = table(spark, d, "pages").select(F.col("page_id").alias("key"), _said("https://s.mx/", "{page_id}").alias("url"))
    wall = "<title>Un momento</title><script>location.reload()</script>"
    static = rows.select("url", F.when(F.col("key") % 3 == 0, "static").otherwise(wall).alias("body"))
    rendered = rows.filter("key % 3 = 1").select("url", F.lit("rendered").alias("body"))
    return first_snapshot(static, rendered, markup.is_challenge(F.col("body"))).join(rows, "url").select("key", "body", "blocked")


@query("""SELECT s_name, CAST(s_acctbal AS DOUBLE) AS s_acctbal FROM supplier ORDER BY s_acctbal DESC, lower(s_name), s_suppkey LIMIT 20""")
def store_ranking(spark, d):
    """The twenty best stores in the order of the export: a limit that is the feature."""
    rows = table(spark, d, "supplier").select(F.col("s_name").alias("store_name"), F.col("s_acctbal").alias("confidence"), F.col("s_suppkey").alias("canonical_domain"))
    return exports.store_order(rows).limit(20).select(F.col("store_name").alias("s_name"), F.col("confidence").alias("s_acctbal"))


@query("""SELECT s_suppkey, s_nationkey < 10 AS accepted FROM supplier ORDER BY s_nationkey >= 10, s_acctbal DESC, s_suppkey LIMIT 20""")
def audit_ranking(spark, d):
    rows = table(spark, d, "supplier").select((F.col("s_nationkey") < 10).alias("accepted"), F.col("s_acctbal").alias("confidence"), F.col("s_suppkey").alias("canonical_domain"))
    return exports.audit_order(rows).limit(20).select(F.col("canonical_domain").alias("s_suppkey"), "accepted")


# --- imports and store jobs -------------------------------------------------------------------------------


def thing_rows(parts):
    """Things as their detail responses in XML say: links to lookups, people, publishers, and to the next things."""
    k = F.col("p_partkey")
    link = lambda kind, number, name, inbound="": _said('<link type="', kind, '" id="', number, '" value="', name, '"', inbound, "/>")
    body = _said(
        '<items><item type="', F.when(k % 3 == 0, "boardgameexpansion").otherwise("boardgame"), '" id="', "{p_partkey}", '"><thumbnail>t.jpg</thumbnail><image>', F.when(k % 2 == 0, "i.jpg").otherwise(""), "</image>",
        '<name type="primary" value="', "{p_name}", '"/><name type="alternate" value="Álias ', "{p_partkey}", '"/><name type="alternate" value="alias ', "{p_partkey}", '!"/><playingtime value="60"/><minplaytime value="', (k % 2 * 30).cast("string"), '"/>',
        link("boardgamecategory", (F.col("p_size") % 10 + 1).cast("string"), "cat"), link("boardgamemechanic", (F.col("p_size") % 4 + 1).cast("string"), "mec"), link("boardgamefamily", "5", "fam"), link("boardgamedesigner", (k % 7 + 1).cast("string"), "per"), link("boardgameartist", (k % 7 + 1).cast("string"), "per"),
        link("boardgamepublisher", (k % 9 + 100).cast("string"), F.concat(F.lit("Pub "), (k % 9).cast("string"))), F.when(k % 3 == 0, link("boardgameexpansion", (k + 1).cast("string"), "base", ' inbound="true"')).otherwise(""), F.when(k % 3 == 1, link("boardgameimplementation", (k + 1).cast("string"), "next")).otherwise(""), "</item></items>",
    )
    return parts.select(markup.thing(body).alias("t")).select("t.*").filter("bgg_id > 0")


_IMPORT = """n AS (SELECT p_partkey AS k, p_name, p_size FROM part WHERE p_partkey > 0), seeds AS (SELECT k FROM n WHERE k % 6 = 0),
e AS (SELECT n.k AS a, m.k AS b FROM n JOIN n m ON m.k = n.k + 1 WHERE n.k % 3 IN (0, 1)),
r1 AS (SELECT k FROM seeds UNION SELECT b FROM e JOIN seeds ON a = k), taken AS (SELECT k FROM r1 UNION SELECT b FROM e JOIN r1 ON a = k)"""


def _imported(spark, d):
    """The tables before: some items, a publisher known by number, one by name, and an edge that is the inverse of a new one."""
    parts = table(spark, d, "part")
    things = thing_rows(parts)
    k = F.col("p_partkey")
    old = parts.filter("p_partkey % 4 = 0 AND p_partkey > 0")
    made = imports.item_columns(things)
    items = old.select((k * 10).alias("id"), k.alias("bgg_id"), F.lit("old name").alias("canonical_name"), F.lit(-1).cast("long").alias("parent_item_id")).join(made.drop("canonical_name").limit(0), "bgg_id", "left").select("id", *made.columns, "parent_item_id")
    empty = lambda schema: spark.createDataFrame([], schema)
    lookup = "id long, bgg_id long, name string"
    tables = {
        "items": items, "aliases": empty("item_id long, alias string, normalized_alias string, source string"), "categories": spark.createDataFrame([(50, 3, "old")], lookup), "mechanics": empty(lookup), "families": empty(lookup), "contributors": empty(lookup),
        "publishers": spark.createDataFrame([(70, "other", "other", 100), (71, "Pub 1", "pub 1", None)], "id long, name string, normalized_name string, bgg_id long"),
        "item_categories": spark.createDataFrame([(40, 50)], "item_id long, ref long"), "item_mechanics": empty("item_id long, ref long"), "item_families": empty("item_id long, ref long"), "item_contributors": empty("item_id long, ref long, role string"), "item_publishers": empty("item_id long, ref long"),
        "relations": spark.createDataFrame([(40, "extension", 999_990, "HAND", "")], "item_a_id long, link_type string, item_b_id long, source string, source_ref string"),
    }
    return imports.import_things(things.filter("bgg_id % 6 = 0").select("bgg_id"), things, tables)


@query(f"""WITH {_IMPORT} SELECT k AS bgg_id, k % 4 = 0 AS was_there, coalesce(CASE WHEN t.k IS NOT NULL THEN p_name END, 'old name') AS canonical_name, CASE WHEN t.k IS NOT NULL THEN CASE WHEN k % 3 = 0 THEN 'expansion' ELSE 'base_game' END END AS item_type,
CASE WHEN t.k IS NOT NULL THEN CASE WHEN k % 2 = 1 THEN 30 ELSE 60 END END AS min_minutes, CASE WHEN t.k IS NOT NULL THEN CASE WHEN k % 2 = 0 THEN 'i.jpg' ELSE 't.jpg' END END AS image_url,
CASE WHEN t.k IS NOT NULL AND k % 3 = 0 AND k + 1 IN (SELECT k FROM n) THEN k + 1 WHEN k % 4 = 0 THEN -1 END AS parent FROM n LEFT JOIN taken t USING (k) WHERE t.k IS NOT NULL OR k % 4 = 0""")
def import_items(spark, d):
    """Items after an import by number: updated or added, parents set; parents named by their numbers."""
    items = _imported(spark, d)["items"]
    number = items.select(F.col("id").alias("_i"), F.col("bgg_id").alias("_n"))
    held = items.join(number, F.col("parent_item_id") == F.col("_i"), "left")
    return held.select("bgg_id", (F.col("id") == F.col("bgg_id") * 10).alias("was_there"), "canonical_name", "item_type", "min_minutes", "image_url", F.coalesce("_n", F.when(F.col("parent_item_id") < 0, -1)).alias("parent"))


@query(f"""WITH {_IMPORT}, t AS (SELECT n.* FROM n JOIN taken USING (k)) SELECT 'alias' AS kind, k AS bgg_id, 'alias ' || k AS ref, 'Álias ' || k AS said FROM t UNION ALL SELECT 'category', k, CAST(p_size % 10 + 1 AS VARCHAR), 'cat' FROM t UNION ALL SELECT 'mechanic', k, CAST(p_size % 4 + 1 AS VARCHAR), 'mec' FROM t UNION ALL SELECT 'family', k, '5', 'fam' FROM t
UNION ALL SELECT r, k, CAST(k % 7 + 1 AS VARCHAR), 'per' FROM t, (VALUES ('designer'), ('artist')) v(r) UNION ALL SELECT 'publisher', k, CAST(k % 9 + 100 AS VARCHAR), 'Pub ' || (k % 9) FROM t UNION ALL SELECT 'extension', k, CAST(k + 1 AS VARCHAR), 'BGG' FROM t WHERE k % 3 = 0 AND k + 1 IN (SELECT k FROM n) UNION ALL SELECT 'implementation', k + 1, CAST(k AS VARCHAR), 'BGG' FROM t WHERE k % 3 = 1 AND k + 1 IN (SELECT k FROM n)
UNION ALL SELECT 'category', 4, '3', 'cat' WHERE NOT EXISTS (SELECT 1 FROM t WHERE k = 4 AND p_size % 10 + 1 = 3)""")
def import_links(spark, d):
    """Aliases, lookups, people, publishers and relations after the import, by the numbers of both ends."""
    out = _imported(spark, d)
    number = out["items"].select(F.col("id").alias("item_id"), "bgg_id")
    of = lambda rows: rows.join(number, "item_id")
    row = lambda kind, ref, said: [kind.alias("kind"), "bgg_id", ref.cast("string").alias("ref"), said.alias("said")]
    found = of(out["aliases"]).select(*row(F.lit("alias"), F.col("normalized_alias"), F.col("alias")))
    for kind, name in imports.LOOKUPS.items():
        names = out[name].select(F.col("id").alias("ref"), F.col("bgg_id").alias("number"), "name")
        found = found.unionByName(of(out[f"item_{name}"]).join(names, "ref").select(*row(F.lit(kind), F.col("number"), F.col("name"))))
    people = out["contributors"].select(F.col("id").alias("ref"), F.col("bgg_id").alias("number"), "name")
    found = found.unionByName(of(out["item_contributors"]).join(people, "ref").select(*row(F.col("role"), F.col("number"), F.col("name"))))
    makers = out["publishers"].select(F.col("id").alias("ref"), F.col("bgg_id").alias("number"), "name")
    found = found.unionByName(of(out["item_publishers"]).join(makers, "ref").select(*row(F.lit("publisher"), F.col("number"), F.col("name"))))
    other = number.select(F.col("item_id").alias("item_b_id"), F.col("bgg_id").alias("number"))
    edges = of(out["relations"].withColumnRenamed("item_a_id", "item_id")).join(other, "item_b_id")
    return found.unionByName(edges.select(*row(F.col("link_type"), F.col("number"), F.col("source"))))


@query("""WITH s AS (SELECT s_suppkey AS k, s_nationkey % 4 AS t FROM supplier WHERE s_suppkey % 10 <> 9)
SELECT 't' || k || '.mx' AS canonical_domain, 'https://t' || k || '.mx/' AS website_url, CASE WHEN t = 3 THEN 'Uno ' || k ELSE 'Tienda ' || k END AS store_name, t IN (0, 1) AS accepted, 'q' || (k % 3) || ',z' AS queries, CASE t WHEN 0 THEN 'boardgame,online_store,mexico' WHEN 1 THEN 'boardgame,online_store,mexico' WHEN 2 THEN 'boardgame,missing_online_store,mexico' ELSE 'missing_boardgame,missing_online_store,mexico' END AS reasons,
CASE t WHEN 0 THEN 0.97 WHEN 1 THEN 0.75 WHEN 2 THEN 0.44 ELSE 0.10 END::DOUBLE AS confidence, CASE WHEN t = 0 THEN 'Jalisco' ELSE '' END AS state FROM s""")
def store_job(spark, d):
    """The whole first job on made results and pages: buckets, anti-joins, metadata of pages, classification, stores and audit."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_nationkey") % 4).alias("t"))
    k, t = F.col("k"), F.col("t")
    first = rows.select((k * 2).alias("seq"), _said("Uno ", "{k}", " | x").alias("title"), _said("https://www.t", "{k}", ".mx/a?b").alias("url"), F.when(t < 3, "juegos de mesa").otherwise("nada").alias("description"), _said("q", (k % 3).cast("string")).alias("query"))
    second = rows.select((k * 2 + 1).alias("seq"), F.lit("Dos").alias("title"), _said("http://t", "{k}", ".mx/").alias("url"), F.lit("").alias("description"), F.lit("z").alias("query"))
    blocked = rows.filter("k % 10 = 9").select(_said("t", "{k}", ".mx").alias("domain"))
    pages = rows.filter("t < 3").select(_said("https://www.t", "{k}", ".mx/").alias("url"), _said("<title>Tienda ", "{k}", "</title><p>", F.when(t == 0, "carrito Jalisco").when(t == 1, "carrito").otherwise("x"), "</p>").alias("html"))
    stores, audit = discovery.discover_stores(first.unionByName(second), pages.unionByName(pages.withColumn("url", F.replace("url", F.lit("www."), F.lit("")))), blocked, include_low=True)
    held = audit.join(stores.select("canonical_domain", "state"), "canonical_domain")
    return held.select("canonical_domain", F.replace("website_url", F.lit("www."), F.lit("")).alias("website_url"), "store_name", "accepted", F.array_join("source_queries", ",").alias("queries"), F.array_join("reasons", ",").alias("reasons"), F.round("confidence", 2).alias("confidence"), "state")
