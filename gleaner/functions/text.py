"""Text normalisation as column expressions. The variants differ on purpose; none replaces another."""

from __future__ import annotations

import unicodedata
from functools import cache
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class _Table(NamedTuple):
    """What single characters become: another by place in two strings (nothing, past the shorter), or several, as lines of both."""

    old: str
    new: str
    several: str


def _table(plain, nothing: bool) -> _Table:
    """The characters beyond ASCII that ``plain`` changes; into nothing only if asked. Hangul syllables stay whole."""
    one, several, gone = {}, {}, ""
    for point in range(0x80, 0x30000):
        if 0xAC00 <= point < 0xE000 or (became := plain(c := chr(point))) == c:
            continue
        if len(became) == 1:
            one[c] = became
        elif became:
            several[c] = became
        elif nothing:
            gone += c
    return _Table("".join(one) + gone, "".join(one.values()), "\n".join(k + v for k, v in several.items()))


@cache
def _folded() -> _Table:
    """Case folded, in compatibility form, marks dropped."""
    return _table(lambda c: "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x)), True)


@cache
def _to_ascii(form: str) -> _Table:
    """The ASCII of a decomposition, NFKD or NFD."""
    return _table(lambda c: "".join(x for x in unicodedata.normalize(form, c) if x.isascii()), False)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed, and written into the plan, once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _replaced(c: Column, table: _Table) -> Column:
    """Each character as the table has it. Of those that become several, Latin letters are replaced one by one; others are
    rare: where one stands, all that occur are."""
    pairs = table.several.split("\n") if table.several else []
    out = F.translate(c, table.old, table.new) if table.old else c
    for pair in pairs:
        if pair < "\u0180":
            out = F.replace(out, F.lit(pair[0]), F.lit(pair[1:]))
    rare = [pair for pair in pairs if pair >= "\u0180"]
    if not rare:
        return out

    def spelled(plain: Column) -> Column:
        held = F.filter(F.split(F.lit("\n".join(rare)), "\n"), lambda pair: F.contains(plain, F.substring(pair, 1, 1)))
        full = F.aggregate(held, plain, lambda text, pair: F.replace(text, F.substring(pair, 1, 1), F.substring(pair, 2, 99)))
        # table lookups, for a class of so many characters is slow as a pattern
        return F.when(F.length(F.translate(plain, "".join(pair[0] for pair in rare), "")) < F.length(plain), full).otherwise(plain)

    return _bound(out, spelled)


def _if_ascii(c: Column, plain, otherwise) -> Column:
    return _bound(c, lambda x: F.when(F.length(x) == F.octet_length(x), plain(x)).otherwise(otherwise(x)))


#: White space as Unicode has it, which Java's \s alone does not.
SPACE = r"(?U)\s+"


def collapse(c: Column) -> Column:
    """White space of any kind to single blanks, trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def fold(c: Column) -> Column:
    """Case folded, in compatibility form, accents dropped; white space stays."""
    return _if_ascii(c, F.lower, lambda x: _replaced(F.lower(x), _folded()))


def to_ascii(c: Column, form: str = "NFKD") -> Column:
    """The ASCII of the decomposed text; everything else vanishes (ß and emoji too)."""
    return _if_ascii(c, lambda x: x, lambda x: F.regexp_replace(_replaced(x, _to_ascii(form)), r"[^\x00-\x7F]", ""))


def normalize_text(c: Column) -> Column:
    """Folded, white space collapsed: what store evidence is compared in."""
    return collapse(fold(c))


def normalize_ascii(c: Column) -> Column:
    """Accents dropped, everything else beyond ASCII too, then case and white space."""
    return collapse(F.lower(to_ascii(c)))


def normalize_match(c: Column) -> Column:
    """Folded letters and digits, anything between them one blank."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def normalize_title(c: Column) -> Column:
    """Key of a title: accents dropped, & spelled out, quotes and punctuation to blanks. Compatibility forms vanish."""
    spelled = F.translate(F.replace(to_ascii(c, "NFD"), F.lit("&"), F.lit(" and ")), "'\":;,.!?/\\|()[]{}+-_", " " * 21)
    return collapse(F.lower(spelled))


def tokens(c: Column, least: int, stops: list[str]) -> Column:
    """Distinct folded tokens of at least ``least`` letters or digits, without ``stops``."""
    plain = F.regexp_replace(fold(c), r"[^\x00-\x7F]", "")
    found = F.filter(F.split(plain, "[^a-z0-9]+"), lambda x: F.length(x) >= least)
    return F.array_except(F.array_distinct(found), F.array(*(F.lit(s) for s in stops)) if stops else F.array().cast("array<string>"))


def first_text(*values: Column) -> Column:
    """First value that is not blank, collapsed; else the empty text."""
    return F.coalesce(*(F.nullif(collapse(v), F.lit("")) for v in values), F.lit(""))


def clean_title(c: Column) -> Column:
    """Left of each separator in turn."""
    out = collapse(c)
    for separator in (" | ", " - ", " – ", " — "):
        out = F.substring_index(out, separator, 1)
    return F.trim(out)


def strip_suffix(c: Column) -> Column:
    """Left of the first kind of separator that occurs; empty without any."""
    text = collapse(c)
    out = F.lit("")
    for separator in (" - ", " | "):
        out = F.when(text.contains(separator), F.trim(F.substring_index(text, separator, 1))).otherwise(out)
    return out


def title_fallback(title: Column, domain: Column) -> Column:
    out = F.nullif(F.trim(title), F.lit(""))
    for separator in (" | ", " - ", " – ", " — ")[::-1]:
        out = F.when(title.contains(separator), F.nullif(F.trim(F.substring_index(title, separator, 1)), F.lit(""))).otherwise(out)
    return F.coalesce(out, domain)


def join_terms(terms: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), ", ")


def source_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def optional_int(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit("")).try_cast("int")


def optional_price(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit("")).try_cast("decimal(12,2)")


def vector_literal(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("]"))


def iso_timestamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
