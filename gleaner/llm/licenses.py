"""License scans: exact set-similarity join of text blocks with license templates (operator 3).

A block is a line of a text or, where a notice may be wrapped over lines, as many words in a row as the template has,
whatever line ends lie between. Template tokens are ordered by their frequency over all documents, rarest first. A block
can only hold the share ``threshold`` of a template if it has one of the template's first few tokens (prefix), enough
distinct words (length), and enough template words from there on (position); what passes is counted exactly.
DataFrame functions only; templates are a small parameter and stand in the plan as literals.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Phrases that count by themselves, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices as authors write them, with the label of the method. A parameter: any (label, text) will do.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("reserved", "All rights reserved"),
)
THRESHOLD = 0.8
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(lowered: Column) -> Column:
    return F.array_remove(F.split(lowered, _SPLIT), "")


def _tokens(text: str) -> list[str]:
    return list(dict.fromkeys(w for w in re.split(_SPLIT, text.lower()) if w))


def token_order(texts: DataFrame, templates) -> list[str]:
    """All template tokens, rarest over all documents first (``texts``: words); ties by the token.

    The counts of these few tokens alone reach the driver.
    """
    vocabulary = sorted({t for _, text in templates for t in _tokens(text)})
    found = texts.select(F.explode(F.filter("words", lambda w: w.isin(vocabulary))).alias("token")).groupBy("token").count().collect()
    n = dict.fromkeys(vocabulary, 0) | {r["token"]: r["count"] for r in found}
    return sorted(vocabulary, key=lambda t: (n[t], t))


def plan_templates(templates, order: list[str], threshold: float) -> list[tuple[str, list[str], int]]:
    """(label, tokens in the global order, tokens that a block must hold) of each template."""
    place = {t: i for i, t in enumerate(order)}
    plans = ((label, sorted(_tokens(text), key=place.__getitem__)) for label, text in templates)
    return [(label, tokens, max(1, math.ceil(threshold * len(tokens) - 1e-9))) for label, tokens in plans if tokens]


def block_matches(blocks: Column, plans, order: list[str]) -> Column:
    """Array of (label, containment) of all templates that the blocks, arrays of distinct words, hold."""
    ranks = F.create_map(*(F.lit(x) for pair in ((t, i) for i, t in enumerate(order)) for x in pair))

    def in_block(block: Column) -> Column:
        # the block's template tokens, as ranks in the global order
        held = F.array_sort(F.filter(F.transform(block, lambda w: ranks[w]), lambda r: r.isNotNull()))
        tests = []
        for label, tokens, need in plans:
            own = [order.index(t) for t in tokens]
            prefix = own[: len(own) - need + 1]
            # position: from the first shared token on, both sides must still have enough tokens
            shared = F.array_intersect(held, F.array(*(F.lit(r) for r in prefix)))
            start = F.array_position(held, F.get(shared, F.lit(0)))
            enough = (F.size(shared) > 0) & (F.size(block) >= need) & (F.size(held) - start + 1 >= need)
            overlap = F.size(F.array_intersect(held, F.array(*(F.lit(r) for r in own))))
            tests.append(F.when(enough, F.when(overlap >= need, F.struct(F.lit(label).alias("label"), (overlap / len(own)).alias("containment")))))
        return F.filter(F.array(*tests), lambda m: m.isNotNull())

    return F.flatten(F.transform(blocks, in_block))


def window_matches(words: Column, templates, plans) -> Column:
    """Array of (label, best containment) of the templates that windows of their own number of words hold.

    A window that begins with a template's word holds no less than one that begins before it; windows are only cut where
    the whole text has enough of the template.
    """

    def test(label: str, tokens: list[str], need: int, size: int) -> Column:
        own = F.array(*(F.lit(t) for t in tokens))
        places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(tokens), i + 1)), lambda p: p.isNotNull())
        held = F.transform(places, lambda p: F.size(F.array_intersect(F.slice(words, p, F.lit(size)), own)))
        best = F.when(F.size(F.array_intersect(words, own)) >= need, F.array_max(held))
        return F.when(best >= need, F.struct(F.lit(label).alias("label"), (best / len(tokens)).alias("containment")))

    tests = [test(*plan, len([w for w in re.split(_SPLIT, text.lower()) if w])) for (_, text), plan in zip(templates, plans)]
    return F.filter(F.array(*tests), lambda m: m.isNotNull())


def starts_of(words: Column, joined: Column, phrase: str) -> Column:
    """Words at which the phrase begins; the search by place runs only where the joined words hold the phrase."""
    parts = phrase.split()
    places = F.sequence(F.lit(0), F.size(words) - len(parts))

    def stands(i: Column) -> Column:
        test = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            test = test & (F.get(words, i + k) == part)
        return test

    return F.when(joined.contains(f" {phrase} "), F.filter(places, stands)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """License evidence for every row of ``docs`` (doc_id, text).

    Columns: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (label, containment).
    A null text is empty; an empty one has no words, no labels and score 0. Labels are distinct, sorted and joined by
    commas; score is 1 with a base phrase, else the best containment that met the threshold, else 0. Rows are judged
    one by one, so repeated rows and ids make no difference; other columns are ignored; no rows give no rows.
    """
    lowered = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("lowered"))
    texts = lowered.select("doc_id", "lowered", words_of(F.col("lowered")).alias("words"))
    order = token_order(texts, templates)
    plans = plan_templates(templates, order, threshold)
    prefixes = sorted({t for _, tokens, need in plans for t in tokens[: len(tokens) - need + 1]})
    joined = texts.withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    words, line = F.col("words"), F.col("joined")
    found = joined
    names = []
    for k, phrase in enumerate(phrases):
        found = found.withColumn(f"at_{k}", starts_of(words, line, phrase))
        names.append(f"at_{k}")
    lines = F.transform(F.split("lowered", "\n"), lambda x: F.array_distinct(words_of(x)))
    candidate = F.arrays_overlap("words", F.array(*(F.lit(t) for t in prefixes)))
    none = F.array().cast("array<struct<label:string,containment:double>>")
    found = found.withColumn("blocks", F.when(candidate, lines))
    found = found.withColumn("matches", F.when(F.col("blocks").isNotNull(), block_matches(F.col("blocks"), plans, order)).otherwise(none))
    # of wrapped notices, those that no line holds as well
    wrapped = F.when(F.size("blocks") > 1, window_matches(words, [t for t in templates if _tokens(t[1])], plans)).otherwise(none)
    found = found.withColumn("wrapped", wrapped)
    found = found.withColumn("matches", F.concat("matches", F.filter("wrapped", lambda w: ~F.exists("matches", lambda m: (m["label"] == w["label"]) & (m["containment"] >= w["containment"])))))
    base = F.filter(F.array(*(F.when(F.size(n) > 0, F.lit(label)) for n, label in zip(names, phrases.values()))), lambda x: x.isNotNull())
    found = found.withColumn("base", F.array_sort(F.array_distinct(base))).withColumn("starts", F.array_sort(F.concat(*names)))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("matches", lambda m: m["label"]))))
    best = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)))
    return found.select("doc_id", F.size("words").cast("long").alias("n_words"), F.size("starts").cast("long").alias("n_base"), F.get("starts", F.lit(0)).cast("long").alias("first_word"), F.when(F.size("starts") > 0, F.element_at("starts", -1)).cast("long").alias("last_word"), F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), best.alias("score"), "matches")


def oracle(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for the contract's columns: the same containment without any filter."""
    tests = ", ".join(f"CASE WHEN len(list_intersect(b, [{', '.join(repr(t) for t in tokens)}])) >= {need} THEN {{'label': '{label}', 'containment': len(list_intersect(b, [{', '.join(repr(t) for t in tokens)}])) / {len(tokens)}.0}} END" for label, tokens, need in plan_templates(templates, sorted({t for _, x in templates for t in _tokens(x)}), threshold))
    places = " UNION ALL ".join(f"SELECT doc_id, unnest(range(0, len(words))) AS i, words, {[*p.split()]!r} AS p, '{label}' AS label FROM w WHERE contains(' ' || array_to_string(words, ' ') || ' ', ' {p} ')" for p, label in PHRASES.items())
    pattern = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""WITH l AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{pattern}'), lambda x: x <> '') AS words FROM l),
p AS ({places}),
h AS (SELECT doc_id, i, label FROM p WHERE list_slice(words, i + 1, i + len(p)) = p),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM h GROUP BY doc_id),
k AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
m AS (SELECT doc_id, unnest(list_filter([{tests}], lambda x: x IS NOT NULL)) AS m FROM (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(line, '{pattern}'), lambda x: x <> '')) AS b FROM k)),
g AS (SELECT doc_id, list(DISTINCT m.label) AS found, max(m.containment) AS best FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ',') AS labels,
CAST(CASE WHEN base IS NOT NULL THEN 1.0 ELSE coalesce(best, 0.0) END AS DOUBLE) AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN g USING (doc_id)"""
