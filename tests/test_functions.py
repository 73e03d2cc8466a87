import unicodedata

import pytest
from pyspark.sql import functions as F

from gleaner.functions import markup, rules, text, urls, vocab


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names or "x string").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("url", "domain"),
    [("https://WWW.Shop.mx:8080/a", "shop.mx"), ("shop.com/x", "shop.com"), ("//m.shop.com.", "shop.com"), ("http://u:p@www.m.amp.shop.com/", "shop.com"), ("", ""), ("  https://amp.www.x.org ", "www.x.org")],
)
def test_canonical_domain(spark, url, domain):
    assert one(spark, urls.canonical_domain(F.col("u")), u=url) == domain


@pytest.mark.parametrize(
    ("value", "full"),
    [("/a/b", "https://h.org/a/b"), ("c", "https://h.org/p/c"), ("../c?x=1", "https://h.org/c?x=1"), ("//o.org/z", "https://o.org/z"), ("http://o.org/", "http://o.org/"), ("?q=2", "https://h.org/p/q?q=2"), ("#f", "https://h.org/p/q?k=1#f"), ("", "")],
)
def test_resolve(spark, value, full):
    assert one(spark, urls.resolve(F.lit("https://h.org/p/q?k=1"), F.col("v")), v=value) == full


@pytest.mark.parametrize(
    ("url", "platform", "profile"),
    [("https://www.instagram.com/Shop/?x", "instagram", "https://instagram.com/Shop"), ("https://instagram.com/p/1", "instagram", ""), ("https://facebook.com/", "facebook", ""), ("https://m.facebook.com/me", "facebook", "https://facebook.com/me")],
)
def test_social(spark, url, platform, profile):
    assert one(spark, urls.social(F.col("u"), platform), u=url) == profile


def test_text_variants(spark):
    said = "Straße  CAFÉ ☕ Ñandú"
    assert one(spark, text.normalize_text(F.col("t")), t=said) == "strasse cafe ☕ nandu"
    assert one(spark, text.normalize_ascii(F.col("t")), t=said) == "strae cafe nandu"
    assert one(spark, text.normalize_match(F.col("t")), t=said) == "strasse cafe nandu"
    assert one(spark, text.normalize_title(F.col("t")), t="Água & Fuego: \"II\"") == "agua and fuego ii"
    assert one(spark, text.collapse(F.col("t")), t=" a \n b ") == "a b"
    assert one(spark, text.first_text(F.col("a"), F.col("b")), a=" ", b=" x  y ") == "x y"


def test_store_rules(spark):
    judge = lambda domain, said: one(spark, rules.store_decision(F.lit(domain), F.col("t")), t=said)
    good = judge("shop.mx", "Juegos de mesa, agregar al carrito, envíos a todo México")
    assert good["accepted"] and good["reasons"] == ["boardgame", "online_store", "mexico"] and abs(good["confidence"] - 0.98) < 1e-9
    assert judge("blog.com", "juegos de mesa mexico")["confidence"] == pytest.approx(0.49)
    assert judge("listado.mercadolibre.com.mx", "x")["reasons"] == ["blocked_domain"]


def test_item_rules(spark):
    none = F.lit(None).cast("int")
    judge = lambda title, players=none, publisher="": one(spark, rules.item_decision(F.col("t"), F.col("p"), F.lit(""), F.lit(""), F.lit(""), players, none, none, none, none), t=title, p=publisher)
    assert judge("Catan", F.lit(3), "Devir")["category"] == "LIKELY_BOARDGAME"
    assert judge("Expansión de Catan")["category"] == "LIKELY_EXPANSION"
    other = judge("Pintura acrílica warhammer")
    assert other["category"] == "LIKELY_NON_BOARDGAME" and other["confidence"] == pytest.approx(0.9)
    assert judge("Mesa")["category"] == "UNCERTAIN"


@pytest.mark.parametrize("value", [0.625, 0.825, 0.975, 0.55, 0.9833, 0.7375, 0.12, 1.2])
def test_confidence_rounds_as_decimal_text(spark, value):
    got = spark.range(1).select(rules.round_confidence(F.lit(value)).alias("r")).first()["r"]
    assert got == round(max(0.0, min(0.99, value)), 2)


def test_location(spark):
    place = lambda said: tuple(one(spark, rules.location(F.col("t")), t=said))
    assert place("Tienda en Nuevo León") == ("", "Nuevo León")
    assert place("León, Gto") == ("León", "Guanajuato")
    assert place("baja california sur") == ("", "Baja California")
    assert place("nowhere") == ("", "")


@pytest.mark.parametrize(("said", "raw", "price"), [("cuesta $ 1,299 hoy", "$ 1,299", "1299.00"), ("350.5 MXN", "350.5 MXN", "350.5"), ("mxn 20", "mxn 20", "20.00"), ("gratis", "", "")])
def test_price(spark, said, raw, price):
    assert tuple(one(spark, rules.price(F.col("t")), t=said)) == (raw, price)


def test_facts_and_language(spark):
    assert tuple(one(spark, rules.players(F.col("t")), t="de 2 a 4 jugadores")) == (2, 4)
    assert tuple(one(spark, rules.minutes(F.col("t")), t="45 min")) == (45, 45)
    assert one(spark, rules.min_age(F.col("t")), t="Edad: 10+") == 10
    assert one(spark, rules.min_age(F.col("t")), t="10 años") is None
    assert one(spark, rules.language_of(F.col("t")), t="edición en Español") == "es"
    assert one(spark, rules.language_of(F.col("t")), t="english / español") == ""
    found = one(spark, rules.item_language(F.lit("Catan"), F.lit("https://x.org/p"), F.lit(""), F.col("t")), t="menu English. Idioma: español Entrega rápida")
    assert tuple(found)[:2] == ("es", "product_language_label")


PRODUCT = """<html><head><title>Azul | Shop</title><meta property="og:title" content="Azul - Shop"><meta name="og:image" content="/og.png">
<script type="application/ld+json">{"@graph":[{"@type":["Thing","Product"],"name":"Azul","sku":"A1","brand":{"name":"Plan B"},"image":["/a.jpg"],"offers":[{"price":"1,099","priceCurrency":"mxn","availability":"https://schema.org/InStock"}]}]}</script></head>
<body><div class="elementor-menu-cart"><span>$5.00</span></div><h1>Azul</h1><p>Un juego de mesa abstracto.</p><p>2 a 4 jugadores</p><p>30-45 min</p><p>Copyright x</p></body></html>"""


def test_product_details(spark):
    pages = spark.createDataFrame([("https://s.mx/producto/azul", PRODUCT), ("https://s.mx/x", "<p>no title</p>")], "url string, html string")
    got = markup.product_details(pages).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.title, r.publisher, r.price, r.price_source, r.currency, r.availability, r.availability_source) == ("Azul", "Plan B", "1099", "json_ld_offer", "MXN", "available", "json_ld_offer")
    assert (r.min_players, r.max_players, r.min_minutes, r.max_minutes, r.image_url, r.store_sku) == (2, 4, 30, 45, "https://s.mx/a.jpg", "A1")
    assert r.description == "Un juego de mesa abstracto. 2 a 4 jugadores 30-45 min"


def test_price_falls_back_to_the_product_block(spark):
    html = '<h1>Ark</h1><p class="price">$ 900</p><p class="stock out-of-stock">x</p>'
    r = markup.product_details(spark.createDataFrame([("https://s.mx/p", html)], "url string, html string")).first()
    assert (r.raw_price, r.price, r.price_source, r.availability, r.availability_source) == ("$900", "900.00", "woocommerce_product_price", "out_of_stock", "woocommerce_stock")


def test_listing_candidates(spark):
    html = '<a href="/producto/a?x=1">Juego A</a><span>$ 100</span><span>Agotado</span><a href="/blog">no</a><a href="/producto/a">juego a</a><a href="https://o.org/producto/b">far</a>'
    got = markup.listing_candidates(spark.createDataFrame([("https://s.mx/tienda", html)], "url string, html string")).collect()
    assert [(r.source_url, r.title, r.price, r.availability) for r in got] == [("https://s.mx/producto/a", "Juego A", "100.00", "out_of_stock")]


def test_site_metadata(spark):
    html = '<title>Shop | x</title><meta property="og:site_name" content="Mi Tienda - MX"><link rel="icon" href="/f.ico"><a href="https://instagram.com/mi">i</a><a href="/contacto?x">c</a><a href="/contacto">c</a><p>Guadalajara</p>'
    r = markup.site_metadata(spark.createDataFrame([("https://s.mx/", html)], "url string, html string")).first()
    assert (r.store_name, r.instagram_url, r.city, r.state, r.store_logo, r.internal_links) == ("Mi Tienda", "https://instagram.com/mi", "Guadalajara", "Jalisco", "https://s.mx/f.ico", ["https://s.mx/contacto"])


def test_xml(spark):
    body = '<items><item type="boardgame" id="3"><name type="primary" value="P"/></item><item id="4"/></items>'
    assert [tuple(x) for x in one(spark, markup.search_items(F.col("x")), x=body)] == [(3, "boardgame", "P", None)]


def test_sitemap_locations(spark):
    body = "<urlset><loc><![CDATA[ https://s.mx/a ]]></loc><LOC>https://s.mx/b?x=1&amp;y=2</LOC><loc> </loc></urlset>"
    assert one(spark, markup.locations(F.col("b")), b=body) == ["https://s.mx/a", "https://s.mx/b?x=1&y=2"]


def test_vocabulary_sizes():
    assert [len(x) for x in (vocab.BLOCKED_DOMAINS, vocab.STORE_GAME_TERMS, vocab.STORE_ONLINE_TERMS, vocab.STORE_COUNTRY_TERMS, vocab.CORE_QUERIES)] == [26, 28, 35, 42, 23]


def test_folding_of_all_characters(spark):
    """Every character but Hangul syllables, which stay whole, between two letters."""
    points = [p for p in range(0x80, 0x30000) if not 0xAC00 <= p < 0xE000 and unicodedata.category(chr(p)) != "Cn"]
    said = ["".join(f"a{chr(p)}B" for p in points[i : i + 40]) for i in range(0, len(points), 40)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    plain = lambda s, form: unicodedata.normalize(form, s).encode("ascii", "ignore").decode()
    for r in rows.select("i", text.fold(F.col("s")).alias("folded"), text.to_ascii(F.col("s")).alias("wide"), text.to_ascii(F.col("s"), "NFD").alias("narrow")).collect():
        want = "".join(x for x in unicodedata.normalize("NFKD", said[r.i].casefold()) if not unicodedata.combining(x))
        assert (r.folded, r.wide, r.narrow) == (want, plain(said[r.i], "NFKD"), plain(said[r.i], "NFD"))


def test_pages_with_loose_markup(spark):
    html = (
        '<html lang="es"><body><noscript><h1>no</h1></noscript><h1>Catan <b>Junior</b></h1><div class="woocommerce-product-gallery"><img src="data:x" data-src="/big.png" alt="Catan"><br>'
        '<a href="/full.webp?x=1"><img srcset="/s.jpg 200w, /l.jpg 800w"></a></div><p>after</p><p class="price">$ 1,200<span class="stock">no</span></p>'
        '<div class="Stock in-stock">Hay <i>3</i></div><p class="price">MXN 5</p><style>.x{}</style><script>var p = "$ 9";</script><a href="/l">open <a href="/m">shut</a> rest</body>'
    )
    r = spark.createDataFrame([(html,)], "html string").select(markup.product("html").alias("p"), markup.events("html").alias("e")).first()
    assert (r.p.h1, r.p.language, r.p.prices, [tuple(x) for x in r.p.stock]) == ("Catan Junior", "es", ["$ 1,200 no", "MXN 5"], [("Stock in-stock", "Hay 3")])
    assert (r.p.gallery, [x.url for x in r.p.images]) == (["/big.png", "/full.webp?x=1", "/l.jpg"], ["/big.png", "/l.jpg"])
    assert r.p.nodes == ["Catan", "Junior", "after", "open", "shut", "rest"]
    assert [(x.kind, x.href, x.text) for x in r.e if x.href] == [("link", "/m", "shut")]
    assert "rest" in [x.text for x in r.e] and "open" not in [x.text for x in r.e]
