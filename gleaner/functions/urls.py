"""URL functions as column expressions. None throws on odd URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def path_of(url: Column) -> Column:
    """Path, without the ;parameters of its last segment."""
    rest = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*", "")
    return F.regexp_replace(F.regexp_replace(rest, _SCHEME, ""), r";[^/]*$", "")


def canonical_domain(url: Column) -> Column:
    """Host in lower case without port, user, outer dots, and one each of www., m. and amp. in this order."""
    value = F.trim(url)
    value = F.when(value.contains("://") | value.startswith("//"), value).otherwise(F.concat(F.lit("//"), value))
    authority = F.regexp_extract(value, r"^(?:[^:/?#]+:)?//([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[^:\]]*$", "")
    host = F.btrim(F.lower(host), F.lit("."))
    for prefix in ("www", "m", "amp"):
        host = F.regexp_replace(host, rf"^{prefix}\.", "")
    return host


def homepage(url: Column) -> Column:
    found = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]+)", 1)
    return F.when(found != "", F.concat(found, F.lit("/"))).otherwise(url)


def clean(url: Column) -> Column:
    """Without query, fragment and the ;parameters of the last segment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r";[^/]*$", "")


def resolve(base: Column, value: Column) -> Column:
    """Absolute form of a link on a page: full URLs, //host, /path, ?query, #fragment and names; dot segments are removed."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"[^/]*$", "")
    path = F.regexp_extract(value, r"^([^?#]*)", 1)
    tail = F.substr(value, F.length(path) + 1)
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    start = F.struct(F.array().cast("array<string>").alias("kept"))

    def step(state: Column, part: Column) -> Column:
        kept = state["kept"]
        up = F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
        return F.struct(F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part))).alias("kept"))

    dots = F.aggregate(F.split(joined, "/"), start, step, lambda s: F.array_join(s["kept"], "/"))
    dots = F.when(joined.rlike(r"/\.{1,2}$"), F.concat(dots, F.lit("/"))).otherwise(dots)
    settled = F.when(joined.rlike(r"(^|/)\.{1,2}(/|$)"), dots).otherwise(joined)
    return (
        F.when(F.coalesce(value, F.lit("")) == "", F.lit(""))
        .when(value.rlike(_SCHEME) | (root == ""), value)
        .when(value.startswith("//"), F.concat(F.regexp_extract(base, f"({_SCHEME[1:]})", 1), value))
        .when(value.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), value))
        .when(value.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), value))
        .otherwise(F.concat(root, settled, tail))
    )


def has_path(url: Column, markers: list[str]) -> Column:
    path = F.lower(path_of(url))
    return F.exists(F.array(*(F.lit(m) for m in markers)), lambda m: F.contains(path, m))


def is_product(url: Column) -> Column:
    return has_path(url, vocab.PRODUCT_PATHS)


def is_image(url: Column) -> Column:
    ending = F.lower(path_of(url)).rlike(r"\.(" + "|".join(vocab.IMAGE_ENDINGS) + ")$")
    return F.coalesce((url != "") & ~url.startswith("#") & ~url.startswith("data:") & ending, F.lit(False))


def social(url: Column, platform: str) -> Column:
    """Profile URL on the platform, or the empty text."""
    first = F.get(F.filter(F.split(path_of(url), "/"), lambda x: x != ""), F.lit(0))
    fits = (canonical_domain(url) == f"{platform}.com") & first.isNotNull() & ~F.lower(first).isin(vocab.SOCIAL_RESERVED[platform])
    return F.when(fits, F.concat(F.lit(f"https://{platform}.com/"), first)).otherwise("")


def first_social(links: Column, platform: str) -> Column:
    return F.coalesce(F.get(F.filter(F.transform(links, lambda x: social(x, platform)), lambda x: x != ""), F.lit(0)), F.lit(""))


def enrichment_links(links: Column, base: Column) -> Column:
    """Links of the same domain that may tell who and where a store is: cleaned, first occurrences in order."""
    own = F.filter(links, lambda x: (canonical_domain(x) == canonical_domain(base)) & has_path(x, vocab.ENRICHMENT_PATHS))
    return F.array_distinct(F.transform(own, clean))


def slug_title(url: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(path_of(url), "/+$", ""), "/"), -1)
    return F.trim(F.regexp_replace(F.replace(last, F.lit("-"), F.lit(" ")), r"\s+", " "))


def slugify(c: Column, fallback: str = "cover") -> Column:
    from .text import fold

    plain = F.btrim(F.regexp_replace(F.regexp_replace(fold(c), r"[^\x00-\x7F]", ""), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(plain == "", fallback).otherwise(plain)


def widest(srcset: Column) -> Column:
    """URL of the widest candidate of a srcset; the first of equals; width 0 where none is given."""
    parts = F.filter(F.transform(F.split(srcset, ","), lambda p: F.split(F.trim(p), r"\s+")), lambda p: p[0] != "")
    sized = F.transform(parts, lambda p: F.struct(p[0].alias("url"), F.coalesce(F.regexp_extract(F.coalesce(F.get(p, F.lit(1)), F.lit("")), r"^(\d+)w$", 1).try_cast("int"), F.lit(0)).alias("width")))
    start = F.struct(F.lit("").alias("url"), F.lit(-1).alias("width"))
    return F.aggregate(sized, start, lambda best, x: F.when(x["width"] > best["width"], x).otherwise(best), lambda best: best["url"])


def item_url(kind: Column, number: Column) -> Column:
    path = F.when(kind == "boardgameexpansion", "boardgameexpansion").otherwise("boardgame")
    return F.concat(F.lit("https://boardgamegeek.com/"), path, F.lit("/"), number.cast("string"))


def url_tokens(url: Column) -> Column:
    """Telling tokens of a URL's last part, in order and with repeats."""
    from .text import fold

    last = F.element_at(F.split(F.regexp_replace(path_of(url), "/+$", ""), "/"), -1)
    plain = F.regexp_replace(fold(last), r"[^\x00-\x7F]", "")
    return F.filter(F.split(plain, "[^a-z0-9]+"), lambda t: (F.length(t) >= 4) & ~t.isin(vocab.URL_STOPS))


def is_rendered(url: Column, body: Column) -> Column:
    """Does a rendered page show a price or cart, and a telling token of its URL (if that has any)?"""
    from .text import fold

    words = F.split(fold(body), "[^a-z0-9]+")
    marked = body.rlike(r"\$\s*[0-9]") | F.arrays_overlap(words, F.array(F.lit("cart"), F.lit("carrito"), F.lit("agotado"))) | (F.array_contains(words, "sold") & F.array_contains(words, "out"))
    asked = url_tokens(url)
    return marked & ((F.size(asked) == 0) | F.arrays_overlap(words, asked))


def asset_key(slug: Column, prefix: str = "") -> Column:
    folder = prefix.strip().strip("/")
    return F.concat(F.lit(f"{folder}/" if folder else ""), slugify(slug), F.lit(".webp"))


def public_url(base: str, key: Column) -> Column:
    """URL of a key, percent-encoded part by part (a blank is %20)."""
    parts = F.transform(F.split(F.btrim(key, F.lit("/")), "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")))
    return F.concat(F.lit(base.rstrip("/") + "/"), F.array_join(parts, "/")) if base.rstrip("/") else F.lit("")
