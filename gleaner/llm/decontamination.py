"""Benchmark decontamination with a distributed positional inverted index (operator 1).

The index holds postings (term, row of a document, position) of training tokens. Only terms that a query needs are stored: for
each window of a test item its rarest terms, by counts over all documents. Lists of one window, each shifted by the
term's offset, are intersected on (row, item, shift); what survives is compared word by word, so matches are exact.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import alnum_words, stash

#: Words in a window of a test item.
WINDOW = 10
#: Rarest terms of a window whose lists are intersected.
RAREST = 3


def item_words(items: DataFrame) -> DataFrame:
    """Write (item, item_id, words) to the shared folder: ``item`` numbers the rows, for ids may repeat with other texts.

    Items without words or with a null id are left out; equal rows count once.
    """
    kept = items.select("item_id", alnum_words(F.col("text")).alias("words")).filter((F.size("words") > 0) & F.col("item_id").isNotNull()).distinct()
    return stash(kept.select(F.monotonically_increasing_id().alias("item"), "item_id", "words"), "items")


def tokenise(docs: DataFrame) -> DataFrame:
    """Write (row, doc_id, words) of every whole text to the shared folder: texts are split once, read by each later step.

    ``row`` numbers the rows, for doc_ids may repeat or be null.
    """
    return stash(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", alnum_words(F.col("text")).alias("words")), "words")


def tokens(tokenised: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows (row, pos, term) of the training words that are in ``terms``.

    ``terms`` is a written table: its size is known to the planner, which broadcasts it only below Spark's threshold.
    """
    return tokenised.select("row", F.posexplode("words").alias("pos", "term")).join(terms.select("term"), "term")


def term_counts(tokenised: DataFrame, items: DataFrame) -> DataFrame:
    """term, n: how often each word of the items (item_id, words) stands in all documents (0 if never)."""
    vocabulary = stash(items.select(F.explode("words").alias("term")).distinct(), "terms")
    found = tokens(tokenised, vocabulary).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """(item, at, offset, term): for each window of an item, starting at word ``at``, where its rarest terms stand in it.

    An item of fewer words than ``window`` is one window.
    """
    long = items.withColumn("length", F.least(F.lit(window), F.size("words")))
    spread = long.select("item", "words", "length", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("length"))).alias("at"))
    spread = spread.select("item", "at", F.posexplode(F.slice("words", F.col("at") + 1, F.col("length"))).alias("offset", "term"))
    order = Window.partitionBy("item", "at").orderBy("n", "term", "offset")
    picked = spread.join(counts, "term").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rarest)
    return picked.select("item", "at", "offset", "term")


def build_index(tokenised: DataFrame, terms: DataFrame) -> DataFrame:
    """Store the postings (term, row, pos) of ``terms`` in the shared folder."""
    return stash(tokens(tokenised, terms), "postings")


def candidates(index: DataFrame, picked: DataFrame) -> DataFrame:
    """(row, item, shift) at which all chosen terms of some window stand: shift = word of document - word of item."""
    places = picked.select("item", "term", (F.col("at") + F.col("offset")).alias("place")).distinct()
    hits = index.join(places, "term").select("row", "item", (F.col("pos") - F.col("place")).alias("shift"), "place")
    # a place of an item has one term, so that no hit stands twice
    met = hits.groupBy("row", "item", "shift").agg(F.collect_set("place").alias("met"))
    needs = picked.groupBy("item", "at").agg(F.array_sort(F.collect_set(F.col("at") + F.col("offset"))).alias("need"))
    needs = needs.groupBy("item").agg(F.array_distinct(F.collect_list("need")).alias("needs"))
    # written: a join that reads an aggregate in place cannot split a hot item's rows
    needs = stash(needs, "needs")
    whole = met.join(needs, "item").filter(F.exists("needs", lambda need: F.size(F.array_except(need, "met")) == 0))
    return whole.select("row", "item", "shift")


_RUNS = "array<struct<begin:int,end:int>>"


def aligned_runs(words, item, shift, window: int):
    """Runs (begin, end) of words of the document that are equal to the item's under ``shift``, long enough for a window."""
    first = F.greatest(F.lit(0), -shift)
    last = F.least(F.size(item), F.size(words) - shift) - 1
    length = F.least(F.lit(window), F.size(item))
    start = F.struct(F.array().cast(_RUNS).alias("runs"), F.lit(-1).alias("open"))

    def step(state, i):
        same = F.get(words, i + shift) == F.get(item, i)
        opened = F.when(state["open"] < 0, i + shift).otherwise(state["open"])
        long = (state["open"] >= 0) & (i + shift - state["open"] >= length)
        closed = F.when(long, F.concat(state["runs"], F.array(F.struct(state["open"].alias("begin"), (i + shift).alias("end"))))).otherwise(state["runs"])
        return F.when(same, F.struct(state["runs"].alias("runs"), opened.alias("open"))).otherwise(F.struct(closed.alias("runs"), F.lit(-1).alias("open")))

    # one place past the end closes a run that reaches it: there get() is null on one side
    return F.when(last >= first, F.aggregate(F.sequence(first, last + 1), start, step, lambda state: state["runs"])).otherwise(F.array().cast(_RUNS))


def phrase_matches(tokenised: DataFrame, items: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """(row, doc_id, n_words, matches) of every row of ``tokenised`` (from :func:`tokenise`); ``items``: item_id, text.

    matches: (item_id, runs) for each item with an occurring window; runs: the words of the document that windows cover
    at one shift of the item, as [begin, end). Null where no list of the index met. The words of the candidate items,
    not the document's, are brought to the row, once for all their shifts: memory is a text and its candidates.
    """
    wanted = item_words(items)
    counts = stash(term_counts(tokenised, wanted), "counts")
    picked = stash(anchors(wanted, counts, window, rarest), "anchors")
    index = build_index(tokenised, stash(picked.select("term").distinct(), "anchor-terms"))
    found = candidates(index, picked).groupBy("row", "item").agg(F.collect_list("shift").alias("shifts"))
    spots = found.join(wanted, "item").groupBy("row").agg(F.collect_list(F.struct("item_id", F.col("words").alias("said"), "shifts")).alias("spots"))
    both = tokenised.join(stash(spots, "candidates"), "row", "left")
    judge = lambda spot: F.struct(spot["item_id"].alias("item_id"), F.flatten(F.transform(spot["shifts"], lambda shift: aligned_runs(F.col("words"), spot["said"], shift, window))).alias("runs"))
    matches = F.filter(F.transform("spots", judge), lambda m: F.size(m["runs"]) > 0)
    return both.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), matches.alias("matches"))


def covered(runs):
    """Number of places that the sorted, possibly overlapping [begin, end) runs cover."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    step = lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["begin"], s["upto"]))).alias("n"), F.greatest(s["upto"], r["end"]).alias("upto"))
    return F.aggregate(F.array_sort(runs), start, step, lambda s: s["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs`` (doc_id, text).

    A word is hit if it lies in any occurrence of a window of any item. A null or empty text has no words and is clean;
    so is everything if there are no items. Items without words or with a null id match nothing. Rows are judged one by
    one, also those that repeat a doc_id; items that repeat an item_id with another text are items of their own under
    one id. Other columns are ignored; an empty table gives none.
    """
    found = phrase_matches(tokenise(docs), items, window, rarest)
    n_hit = F.coalesce(covered(F.flatten(F.transform("matches", lambda m: m["runs"]))), F.lit(0)).cast("long")
    ids = F.array_sort(F.array_distinct(F.coalesce(F.transform("matches", lambda m: m["item_id"].cast("string")), F.array().cast("array<string>"))))
    told = found.select("doc_id", "n_words", n_hit.alias("n_hit"), ids.alias("ids"))
    return told.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def proximity_matches(index: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """(row, query_id): rows in which all terms of a query stand within ``slop`` consecutive words, in any order.

    ``queries``: query_id, terms (array of distinct words, all of them in the index). Each posting of the query's terms
    opens a span that begins there; a span is met when every term has a posting in it. Spans are counted by window
    frames over positions, so no pairs of postings are formed.
    """
    asked = queries.withColumn("n_terms", F.size(F.array_distinct("terms"))).select("query_id", "n_terms", F.explode(F.array_distinct("terms")).alias("term"))
    hits = index.join(asked, "term")
    ahead = Window.partitionBy("row", "query_id").orderBy("pos").rangeBetween(0, slop - 1)
    met = hits.withColumn("near", F.size(F.collect_set("term").over(ahead))).filter(F.col("near") == F.col("n_terms"))
    return met.select("row", "query_id").distinct()


def oracle(window: int = WINDOW) -> str:
    """DuckDB SQL for :func:`contamination`: all windows of documents joined to all windows of items."""
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents),
i AS (SELECT item_id, w, least({window}, len(w)) AS k FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0 AND item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, k, list_slice(w, a, a + k - 1) AS g FROM (SELECT item_id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS a FROM i)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, a, list_slice(w, a, a + k - 1) AS g FROM (SELECT doc_id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS a FROM d, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, item_id, a, dw.k AS k FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(a, CAST(a + k AS BIGINT))) AS p FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)"""
