"""Classification and extraction rules: explainable scores, patterns and cascades as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import collapse, fold, normalize_ascii, normalize_match, normalize_text
from .urls import canonical_domain


def _array(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it occurs."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def substring_hits(text: Column, terms: list[str]) -> Column:
    """Sorted terms that the normalised text contains anywhere. ``terms`` are in normalised form."""
    return F.filter(_array(sorted(terms)), lambda t: F.contains(text, t))


def word_hits(text: Column, terms: list[str]) -> Column:
    """Terms in their order that stand between non-word characters."""
    if not terms:
        return _array([])
    # a pattern that is a literal is compiled once
    return F.array_compact(F.array(*(F.when(text.rlike(rf"(^|\W)\Q{t}\E($|\W)"), t) for t in terms)))


def is_blocked(domain: Column, blocked: list[str] = vocab.BLOCKED_DOMAINS) -> Column:
    return F.exists(_array(blocked), lambda b: (domain == b) | F.endswith(domain, F.concat(F.lit("."), b)))


def store_decision(domain: Column, evidence: Column, games=vocab.STORE_GAME_TERMS, online=vocab.STORE_ONLINE_TERMS, country=vocab.STORE_COUNTRY_TERMS, blocked=vocab.BLOCKED_DOMAINS) -> Column:
    """STRUCT(accepted, confidence, reasons). Three kinds of evidence must meet; a refused store stays under one half."""
    local = F.endswith(domain, F.lit(".mx"))

    def judge(n: Column) -> Column:
        a, b, c = n["a"], n["b"], n["c"]
        score = F.lit(0.0)
        for test, worth in ((a > 0, 0.34), (b > 0, 0.31), (c > 0, 0.22), (local, 0.10), (a >= 2, 0.02), (b >= 2, 0.01)):
            score = score + F.when(test, worth).otherwise(0.0)
        score = F.least(score, F.lit(1.0))
        accepted = (a > 0) & (b > 0) & ((c > 0) | local)
        reasons = F.array(*(F.when(test, name).otherwise(f"missing_{name}") for test, name in ((a > 0, "boardgame"), (b > 0, "online_store"), ((c > 0) | local, "mexico"))))
        return F.struct(accepted.alias("accepted"), F.when(accepted, score).otherwise(F.least(score, F.lit(0.49))).alias("confidence"), reasons.alias("reasons"))

    count = lambda text: F.struct(*(F.size(substring_hits(text, terms)).alias(name) for name, terms in (("a", games), ("b", online), ("c", country))))
    refused = F.struct(F.lit(False).alias("accepted"), F.lit(0.0).alias("confidence"), F.array(F.lit("blocked_domain")).alias("reasons"))
    return F.when(is_blocked(domain, blocked), refused).otherwise(let(let(normalize_text(evidence), count), judge))


def round_confidence(value: Column) -> Column:
    """Clamp to 0 ... 0.99, two places. Half-even on the decimal text, but for .975, whose double lies above."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(0.99), value))
    return F.when(F.abs(held - 0.975) < 1e-9, 0.97).otherwise(F.bround(held, 2))


def item_decision(title: Column, publisher: Column, description: Column, item_type: Column, structured: Column, min_players: Column, max_players: Column, min_minutes: Column, max_minutes: Column, min_age: Column, games=vocab.ITEM_GAME_TERMS, expansions=vocab.ITEM_EXPANSION_TERMS, others=vocab.ITEM_OTHER_TERMS, publishers=vocab.ITEM_PUBLISHERS) -> Column:
    """STRUCT(category, confidence, reasons). The order of the rules is their meaning."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    text = normalize_ascii(F.concat_ws(" ", *(blank(c) for c in (title, publisher, description, item_type, structured))))
    some = lambda *cs: F.greatest(*(F.coalesce(c, F.lit(0)) for c in (*cs, F.lit(0)))) > 0
    known = let(normalize_ascii(blank(publisher)), lambda maker: (maker != "") & F.exists(_array(publishers), lambda p: F.contains(maker, p)))
    hits = let(text, lambda t: F.struct(*(word_hits(t, terms).alias(name) for name, terms in (("games", games), ("expansions", expansions), ("others", others)))))
    facts = {"players": some(min_players, max_players), "minutes": some(min_minutes, max_minutes), "age": some(min_age), "known": known, "hits": hits}

    def scored(e: Column) -> Column:
        score = F.lit(0.0)
        n = F.size(e["hits"]["games"])
        for worth in (F.when(e["players"], 0.35), F.when(e["minutes"], 0.2), F.when(e["age"], 0.15), F.when(n > 0, F.least(F.lit(0.45), 0.15 * n)), F.when(e["known"], 0.3), F.when(F.size(e["hits"]["expansions"]) > 0, 0.3)):
            score = score + F.coalesce(worth, F.lit(0.0))
        return F.struct(e.alias("e"), score.alias("score"), F.least(F.lit(0.85), 0.25 * F.size(e["hits"]["others"])).alias("against"))

    def judge(s: Column) -> Column:
        e, score, against = s["e"], s["score"], s["against"]
        told = lambda name, found: F.when(F.size(found) > 0, F.concat(F.lit(f"{name} terms found: "), F.array_join(F.slice(found, 1, 3), ", ")))
        listed = lambda parts: F.filter(F.array(*parts), lambda x: x.isNotNull())
        first = [F.when(e["players"], "player count found"), F.when(e["minutes"], "play time found"), F.when(e["age"], "minimum age found"), told("boardgame", e["hits"]["games"]), F.when(e["known"], "known boardgame publisher found"), told("expansion", e["hits"]["expansions"])]
        rest = listed([*first, told("non-boardgame", e["hits"]["others"])])

        def result(category: str, confidence: Column, reasons: Column) -> Column:
            return F.struct(F.lit(category).alias("category"), confidence.alias("confidence"), reasons.alias("reasons"))

        unsure = F.when(F.size(rest) > 0, rest).otherwise(_array(["insufficient classification evidence"]))
        return (
            F.when(F.size(e["hits"]["expansions"]) > 0, result("LIKELY_EXPANSION", round_confidence(0.75 + score / 4), listed(first)))
            .when(score >= 0.5, result("LIKELY_BOARDGAME", round_confidence(0.65 + score / 3), rest))
            .when(against >= 0.5, result("LIKELY_NON_BOARDGAME", round_confidence(0.65 + against / 3), rest))
            .when(score > 0, result("LIKELY_BOARDGAME", round_confidence(0.55 + score / 4), rest))
            .otherwise(result("UNCERTAIN", F.lit(0.5), unsure))
        )

    return let(let(F.struct(*(v.alias(k) for k, v in facts.items())), scored), judge)


def apply_item_decision(df, decision: Column):
    """The flags that follow from a decision; a fresh decision is never confirmed."""
    held = df.withColumn("_d", decision)
    return held.withColumns({"is_boardgame": F.col("_d.category").isin("LIKELY_BOARDGAME", "LIKELY_EXPANSION"), "is_boardgame_confirmed": F.lit(False), "category_confidence": F.col("_d.confidence"), "classification_reasons": F.col("_d.reasons")}).drop("_d")


def location(text: Column, cities=vocab.CITIES, states=vocab.STATES, aliases=vocab.STATE_ALIASES) -> Column:
    """STRUCT(city, state): the first rule that holds, cities before states. 'leon' does not stand in 'nuevo leon'."""
    return let(normalize_text(text), lambda plain: _place(plain, cities, states, aliases))


def _place(plain: Column, cities, states, aliases) -> Column:
    def stands(alias: str) -> Column:
        held = F.replace(plain, F.lit("nuevo leon"), F.lit("")) if alias == "leon" else plain
        return held.rlike(rf"(?U)\b\Q{alias}\E\b")

    def rule(names: list[str]) -> Column:
        test = F.lit(False)
        for name in names:
            test = test | stands(name)
        return test

    out = None
    for city, state, names in cities:
        value = F.struct(F.lit(city).alias("city"), F.lit(state).alias("state"))
        out = F.when(rule(names), value) if out is None else out.when(rule(names), value)
    for state in states:
        plain_name = "".join({"á": "a", "é": "e", "í": "i", "ó": "o", "ú": "u"}.get(c, c) for c in state.lower())
        value = F.struct(F.lit("").alias("city"), F.lit(state).alias("state"))
        test = rule([plain_name, *aliases.get(state, [])])
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.struct(F.lit("").alias("city"), F.lit("").alias("state")))


def price(text: Column) -> Column:
    """STRUCT(raw, price): the first price in a text, without thousands separators and with cents."""

    def cents(raw: Column) -> Column:
        groups = [F.nullif(F.regexp_extract(raw, vocab.PRICE, i), F.lit("")) for i in (1, 2, 3)]
        value = F.trim(F.replace(F.coalesce(*groups, F.lit("")), F.lit(","), F.lit("")))
        return F.struct(raw.alias("raw"), F.when((raw != "") & ~value.contains("."), F.concat(value, F.lit(".00"))).otherwise(value).alias("price"))

    return let(F.trim(F.regexp_extract(text, vocab.PRICE, 0)), cents)


def tidy_raw_price(raw: Column) -> Column:
    return F.regexp_replace(raw, r"\$\s+", r"\$")


def availability(text: Column) -> Column:
    lowered = F.lower(text)
    has = lambda terms: F.exists(_array(terms), lambda t: F.contains(lowered, t))
    return F.when(has(vocab.OUT_OF_STOCK), "out_of_stock").when(has(vocab.IN_STOCK), "available").otherwise("unknown")


def schema_availability(value: Column) -> Column:
    lowered = F.lower(F.coalesce(value, F.lit("")))
    return F.when(lowered.rlike("instock|in_stock"), "available").when(lowered.rlike("outofstock|soldout|out_of_stock"), "out_of_stock").otherwise("unknown")


def stock_availability(blocks: Column) -> Column:
    """Availability of the first stock block (classes, text) that decides; null if none does."""

    def judge(b: Column) -> Column:
        classes = F.split(F.lower(b["classes"]), r"\s+")
        text = availability(b["text"])
        return F.when(F.arrays_overlap(classes, _array(["out-of-stock", "outofstock"])), "out_of_stock").when(F.arrays_overlap(classes, _array(["in-stock", "instock"])), "available").when(text != "unknown", text)

    return F.get(F.filter(F.transform(blocks, judge), lambda x: x.isNotNull()), F.lit(0))


def _pair(text: Column, pattern: str) -> Column:
    held = text.rlike(pattern)
    return F.when(held, F.struct(F.regexp_extract(text, pattern, 1).try_cast("int").alias("least"), F.regexp_extract(text, pattern, 2).try_cast("int").alias("most")))


def players(text: Column) -> Column:
    return F.coalesce(*(_pair(text, p) for p in vocab.PLAYERS))


def minutes(text: Column) -> Column:
    one = F.regexp_extract(text, vocab.MINUTES, 1).try_cast("int")
    return F.coalesce(_pair(text, vocab.MINUTES_RANGE), F.when(text.rlike(vocab.MINUTES), F.struct(one.alias("least"), one.alias("most"))))


def min_age(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, vocab.AGE, 1), F.lit("")).try_cast("int")


def language_of(text: Column, english: str = vocab.ENGLISH, spanish: str = vocab.SPANISH) -> Column:
    """en or es if just one of them is named, else empty."""
    def told(plain: Column) -> Column:
        en, es = plain.rlike(english), plain.rlike(spanish)
        return F.when(en == es, "").when(en, "en").otherwise("es")

    return let(fold(text), told)


def snippet(text: Column, label: str) -> Column:
    """From the first label on at most 220 characters, cut before any stop phrase."""
    at = F.regexp_instr(text, F.lit(label))
    piece = F.substr(text, at, F.lit(220))
    cuts = [F.nullif(F.locate(stop, piece, 2), F.lit(0)) for stop in vocab.SNIPPET_STOPS]
    end = F.least(*cuts, F.lit(221))
    return F.when(at > 0, collapse(F.substr(piece, F.lit(1), end - 1)))


def language_evidence(text: Column) -> Column:
    """The neighbourhood of the first language name, else the beginning."""

    def around(x: Column) -> Column:
        at = F.coalesce(*(F.nullif(F.locate(t, x["plain"]), F.lit(0)) for t in ("english", "ingles", "spanish", "espanol", "castellano")))
        start = F.greatest(F.lit(1), at - 80)
        return F.when(at.isNotNull(), collapse(F.substr(x["text"], start, at + 120 - start))).otherwise(F.substr(x["text"], F.lit(1), F.lit(200)))

    return let(let(collapse(text), lambda t: F.struct(t.alias("text"), fold(t).alias("plain"))), around)


def item_language(title: Column, url: Column, description: Column, page: Column) -> Column:
    """STRUCT(language, source, evidence) of the first source that names just one language."""

    def told(source: str, value: Column, evidence) -> Column:
        return let(language_of(value), lambda found: F.when(found != "", F.struct(found.alias("language"), F.lit(source).alias("source"), evidence(value).alias("evidence"))))

    text = collapse(page)

    def labelled(source: str, label: str) -> Column:
        return let(F.coalesce(snippet(text, label), F.lit("")), lambda x: told(source, x, lambda v: v))

    scoped = [labelled(*x) for x in vocab.LANGUAGE_LABELS.items()]
    none = F.struct(F.lit("").alias("language"), F.lit("").alias("source"), F.lit("").alias("evidence"))
    return F.coalesce(told("title", title, collapse), told("source_url", url, collapse), *scoped, told("description", description, language_evidence), told("page_text", page, language_evidence), none)


def item_type(title: Column, url: Column) -> Column:
    return F.when(F.lower(F.concat_ws(" ", title, url)).rlike("expansion|expansión|expansiones"), "expansion").otherwise("unknown")


def publisher_of(nodes: Column) -> Column:
    found = F.filter(F.transform(nodes, lambda t: F.trim(F.regexp_extract(t, vocab.PUBLISHER, 1))), lambda x: x != "")
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def matched_image(candidates: Column, title: Column) -> Column:
    """URL of the first image (alt, url) whose alternative text is, holds or lies in the title."""
    plain = F.transform(candidates, lambda c: F.struct(normalize_match(c["alt"]).alias("alt"), c["url"].alias("url")))

    def pick(own: Column) -> Column:
        fits = F.filter(plain, lambda c: (c["alt"] != "") & (F.contains(own, c["alt"]) | F.contains(c["alt"], own)))
        return F.when(own == "", "").otherwise(F.coalesce(F.get(fits, F.lit(0))["url"], F.lit("")))

    return let(normalize_match(title), pick)


def visible_description(title: Column, nodes: Column, most: int = 900) -> Column:
    """Text after the node that is the title: up to a stop, without noise, until ``most`` characters are reached."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("done"))

    def starts(text: Column, prefixes: list[str], after: str = "") -> Column:
        return F.exists(_array(prefixes), lambda p: F.startswith(text, F.concat(p, F.lit(after))))

    def step(state: Column, x: Column) -> Column:
        node, plain = x["node"], x["plain"]
        known = availability(node)
        noise = (plain == "") | plain.isin(vocab.DESCRIPTION_NOISE) | starts(plain, vocab.DESCRIPTION_FACTS, " ") | node.rlike(vocab.PRICE) | ((F.size(F.split(plain, " ")) <= 5) & (known != "unknown"))
        on = let(F.concat_ws(" ", F.nullif(state["text"], F.lit("")), node), lambda longer: F.struct(longer.alias("text"), (F.length(longer) >= most).alias("done")))
        return F.when(state["done"], state).when(starts(plain, vocab.DESCRIPTION_STOPS), F.struct(state["text"].alias("text"), F.lit(True).alias("done"))).when(noise, state).otherwise(on)

    def read(h: Column) -> Column:
        place = F.array_position(F.transform(h["nodes"], lambda x: x["plain"]), h["own"])
        after = F.slice(h["nodes"], (place + 1).cast("int"), F.size(h["nodes"]))
        return F.when((h["own"] == "") | (place == 0), "").otherwise(collapse(F.aggregate(after, start, step, lambda s: s["text"])))

    held = F.transform(nodes, lambda n: F.struct(n.alias("node"), normalize_match(n).alias("plain")))
    return let(F.struct(normalize_match(title).alias("own"), held.alias("nodes")), read)


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.70, "accepted").when(confidence >= 0.35, "review").otherwise("failed")
