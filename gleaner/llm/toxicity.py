"""Toxicity by nearest labelled examples: exact TF-IDF cosine with block-max inverted indexes (operator 5).

A bounded set of labelled examples is indexed. The index keeps, for each term, its postings in blocks of examples and
the largest weight in each block; a query visits blocks by falling upper bound and stops when none can still enter its
nearest. The nearest vote with their similarity, votes are calibrated on examples left out one by one, and the neighbours
are the evidence. Terms are those that the labels make telling, for either label; as many as the examples hold, so their
number is bounded by the examples alone. Their document frequencies cover all documents.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import split_words, stash, text_chunks

#: Most labelled examples of either label (expected numbers, drawn by a hash of the id).
TOXIC, CLEAN = 2000, 4000
#: What makes a term telling: chi-square (the level of one in a hundred) and the number of examples that hold it.
TELLING, LEAST = 6.63, 4
#: Characters of a stem.
STEMS = range(4, 9)
NEIGHBOURS, BLOCK = 15, 64
#: Share of examples from which on a term's weights stand in a row.
DENSE = 1 / 32
#: Blocks read before any is left out by its bound.
FIRST_BLOCKS = 3
#: Weight of the base rate against votes.
PRIOR = 0.25
#: Most distinct vectors whose votes a worker remembers.
REMEMBERED = 50_000


@dataclass
class Index:
    terms: list[bytes]
    idf: np.ndarray
    ids: list  # of the examples
    toxic: np.ndarray  # their labels
    weigh: np.ndarray  # what one example stands for, so that the drawn labels count as often as they occur
    postings: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # by term: examples, weights
    steps: tuple[np.ndarray, np.ndarray] | None = None  # calibration: raw vote, probability
    rate: float = 0.0
    _held: dict = field(default_factory=dict)
    _laid: tuple | None = None

    def __post_init__(self):
        self.number = {t: i for i, t in enumerate(self.terms)}

    def vector(self, terms: tuple, tf: tuple) -> tuple[tuple, np.ndarray]:
        w = (1 + np.log(np.array(tf, float))) * self.idf[list(terms)] if terms else np.zeros(0)
        norm = np.sqrt((w * w).sum())
        return terms, w / norm if norm else w

    def fill(self, vectors: list[tuple[tuple, np.ndarray]]) -> None:
        lists: list[tuple[list, list]] = [([], []) for _ in self.terms]
        for i, (terms, w) in enumerate(vectors):
            for t, x in zip(terms, w):
                lists[t][0].append(i)
                lists[t][1].append(x)
        self.postings = [(np.array(a, np.int64), np.array(b, np.float32)) for a, b in lists]

    def _blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(terms x blocks largest weights, row of each term or -1, rows x blocks x examples weights), made once a worker.

        Terms that DENSE of all examples hold have a row; so rows take at most 1 / DENSE times the room of postings.
        """
        if self._laid is None:
            n = -(-max(1, len(self.ids)) // BLOCK)
            peaks, row = np.zeros((len(self.terms), n), np.float32), np.full(len(self.terms), -1)
            often = [t for t, (at, _) in enumerate(self.postings) if len(at) >= DENSE * len(self.ids)]
            row[often] = np.arange(len(often))
            rows = np.zeros((len(often), n * BLOCK), np.float32)
            for t, (at, w) in enumerate(self.postings):
                np.maximum.at(peaks[t], at // BLOCK, w)
                if row[t] >= 0:
                    rows[row[t], at] = w
            self._laid = peaks, row, rows.reshape(len(often), n, BLOCK)
        return self._laid

    def __getstate__(self):
        return self.__dict__ | {"_laid": None, "_held": {}}

    def nearest(self, terms: tuple, w: np.ndarray, skip: int = -1, k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """The k most similar examples (similarity, number), exactly; equal ones by number. Dissimilar ones never count.

        The blocks of highest bound are read first; of the others only those whose bound reaches the k-th similarity.
        """
        if not terms:
            return []
        peaks, row, rows = self._blocks()
        at, w = np.array(terms), w.astype(np.float32)
        bound = w @ peaks[at]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        rare = row[at] < 0
        # postings of rare terms are few: they are added up over all blocks at once
        apart = np.zeros(peaks.shape[1] * BLOCK, np.float32)
        for t, x in zip(at[rare].tolist(), w[rare].tolist()):
            examples, weights = self.postings[t]
            apart[examples] += x * weights
        apart = apart.reshape(-1, BLOCK)
        w, often = w[~rare], row[at[~rare]]
        numbers, sims = np.zeros(0, np.int64), np.zeros(0, np.float32)
        for blocks in (order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]):
            if len(sims) >= k:
                blocks = blocks[bound[blocks] >= np.partition(sims, -k)[-k] - 1e-6]
            if not len(blocks):
                continue
            own = apart[blocks].ravel()
            if len(often):
                own += w @ rows[often[:, None], blocks].reshape(len(often), -1)
            of = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            hit = (own > 0) & (of != skip)
            numbers, sims = np.concatenate((numbers, of[hit])), np.concatenate((sims, own[hit]))
        if len(sims) > k:
            near = sims >= np.partition(sims, -k)[-k] - 1e-6
            numbers, sims = numbers[near], sims[near]
        sims = np.round(sims.astype(float), 6)
        return [(float(sims[i]), int(numbers[i])) for i in np.lexsort((numbers, -sims))[:k]]

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of toxic among the neighbours, weighted by similarity squared over distance; the base rate fills up."""
        if not near:
            return -1.0
        s = np.array([x[0] for x in near])
        at = [x[1] for x in near]
        w = s * s / (1.05 - np.minimum(s, 1.0)) * self.weigh[at]
        return float(((w * self.toxic[at]).sum() + PRIOR * self.rate) / (w.sum() + PRIOR))

    def calibrate(self, vectors: list[tuple[tuple, np.ndarray]]) -> None:
        """Isotonic regression of the labels on votes without oneself; texts without a term get their own rate."""
        raw = np.array([self.vote(self.nearest(t, w, skip=i)) for i, (t, w) in enumerate(vectors)])
        # one toxic and one clean example of a base rate share keep probabilities off 0 and 1
        order = np.argsort(raw, kind="stable")
        pools: list[list[float]] = []
        for r in np.unique(raw):
            mine = order[raw[order] == r]
            pools.append([float(r), float(self.weigh[mine].sum()), float((self.weigh * self.toxic)[mine].sum())])
            while len(pools) > 1 and r >= 0 and pools[-2][0] >= 0 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
                top = pools.pop()
                pools[-1] = [pools[-1][0], pools[-1][1] + top[1], pools[-1][2] + top[2]]
        self.steps = (np.array([p[0] for p in pools]), np.array([(p[2] + self.rate) / (p[1] + 1) for p in pools]))

    def probability(self, raw: float) -> float:
        at = np.searchsorted(self.steps[0], raw, side="right") - 1
        return float(self.steps[1][max(at, 0)])

    def judge(self, terms: tuple, tf: tuple) -> tuple[float, list[tuple[float, int]]]:
        key = (terms, tf)
        if key not in self._held:
            if len(self._held) >= REMEMBERED:
                self._held.clear()
            near = self.nearest(*self.vector(terms, tf))
            self._held[key] = (self.probability(self.vote(near)), near)
        return self._held[key]


def terms_of(word: bytes) -> list[bytes]:
    """The word (closed by a blank) and its beginnings of STEMS characters: stems take many endings."""
    text = word.decode("utf-8", "replace")
    return [word + b" ", *(text[:k].encode() for k in STEMS if k < len(text))]


def frequencies(texts: pa.Array, number: dict[bytes, int], held: dict[bytes, list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, known term, how often it stands there), by text and term, over whole texts.

    held: the terms of words met before, some REMEMBERED of them.
    """
    counts, words = split_words(texts, alnum=True)
    coded = words.dictionary_encode()
    found = []
    if len(held) > 4 * REMEMBERED:
        held.clear()
    for w in coded.dictionary.to_pylist():
        if (terms := held.get(w)) is None:
            terms = held[w] = [number[t] for t in terms_of(w) if t in number]
        found.append(terms)
    if not (flat := np.array([t for terms in found for t in terms], np.int64)).size:
        return (np.zeros(0, np.int64),) * 3
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    codes = coded.indices.to_numpy()
    told = np.flatnonzero(sizes[codes])
    of, codes = np.repeat(np.arange(len(counts)), counts)[told], codes[told]
    each = sizes[codes]
    place = np.arange(each.sum()) + np.repeat((np.cumsum(sizes) - sizes)[codes] - np.cumsum(each) + each, each)
    pairs, times = np.unique(np.repeat(of, each) * len(number) + flat[place], return_counts=True)
    return pairs // len(number), pairs % len(number), times


def _by_text(n: int, of: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """The columns of each of n texts, as tuples."""
    cuts = np.searchsorted(of, np.arange(n + 1)).tolist()
    listed = [c.tolist() for c in columns]
    return [tuple(tuple(c[i:j]) for c in listed) for i, j in zip(cuts, cuts[1:])]


def _telling(examples: DataFrame) -> list[bytes]:
    """Terms whose chi-square with the label, whichever way they lean, reaches TELLING, highest first."""

    def run(batches):
        seen: dict[bytes, list[int]] = {}
        for chunk in text_chunks(batches):
            counts, words = split_words(chunk.column(1), alnum=True)
            coded = words.dictionary_encode()
            known: dict[bytes, int] = {}
            each = [[known.setdefault(t, len(known)) for t in terms_of(w)] for w in coded.dictionary.to_pylist()]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            flat, ends = np.array([t for ts in each for t in ts], np.int64), np.cumsum(sizes)
            width = max(1, len(each))
            pairs = np.unique(np.repeat(np.arange(len(counts)), counts) * width + coded.indices.to_numpy())
            doc, word = pairs // width, pairs % width
            take = np.repeat(ends[word] - sizes[word], sizes[word]) + np.arange(sizes[word].sum()) - np.repeat(np.cumsum(sizes[word]) - sizes[word], sizes[word]) if len(pairs) else np.zeros(0, np.int64)
            total = max(1, len(known))
            held = np.unique(np.repeat(doc, sizes[word]) * total + flat[take]) if len(pairs) else np.zeros(0, np.int64)
            toxic = chunk.column(2).to_numpy(zero_copy_only=False)[held // total]
            times = [np.bincount((held % total)[toxic == label], minlength=total) for label in (0, 1)]
            for t, i in known.items():
                own = seen.setdefault(t, [0, 0])
                own[0] += int(times[0][i])
                own[1] += int(times[1][i])
        kept = seen
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array([x[0] for x in kept.values()], pa.int64()), pa.array([x[1] for x in kept.values()], pa.int64())], ["term", "clean", "toxic"])

    n = {r["toxic"]: r["count"] for r in examples.groupBy("toxic").count().collect()}
    n0, n1 = float(n.get(0, 0)), float(n.get(1, 0))
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    total = examples.mapInArrow(run, "term binary, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    chi = (n0 + n1) * F.pow(a * (n0 - b) - b * (n1 - a), 2) / F.greatest(F.lit(1e-9), (a + b) * (n0 + n1 - a - b) * n1 * n0)
    told = total.filter(a + b >= LEAST).withColumn("chi", chi).filter(F.col("chi") >= TELLING)
    return [bytes(r["term"]) for r in told.orderBy(F.col("chi").desc(), "term").collect()]


def _document_frequency(docs: DataFrame, terms: list[bytes]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term stands, and the number of documents."""
    number = {t: i for i, t in enumerate(terms)}

    def run(batches):
        df, rows, held = np.zeros(len(terms), np.int64), 0, {}
        for chunk in text_chunks(batches):
            rows += chunk.num_rows
            df += np.bincount(frequencies(chunk.column(0), number, held)[1], minlength=len(terms))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(terms))], pa.int32()), pa.array([rows, *df.tolist()], pa.int64())], ["term", "n"])

    got = {r["term"]: r["n"] for r in docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return np.array([got.get(i, 0) for i in range(len(terms))], float), int(got.get(-1, 0))


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Index | None:
    """Index the documents that ``labels`` (doc_id, toxic) names; ``docs``: doc_id, text. None without both labels.

    About ``toxic`` and ``clean`` examples of each label are drawn by a hash of the id, before their texts are looked
    up: the written draw is small, so the planner need not move the texts. Rows with a null label or text are left out.
    Document frequencies are those of all ``docs``. The driver gets the examples' term counts, never all documents'.
    """
    marked = labels.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).filter(F.col("toxic").isNotNull())
    n = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn_rows = stash(marked.filter(draw < F.when(F.col("toxic") == 1, toxic / n[1]).otherwise(clean / n[0])), "toxic-draw")
    rows = stash(docs.select("doc_id", "text").filter("text IS NOT NULL").join(drawn_rows, "doc_id").select("doc_id", "text", "toxic"), "toxic-examples")
    told = _telling(rows)
    df, total = _document_frequency(docs, told)
    number = {t: i for i, t in enumerate(told)}

    def run(batches):
        held: dict[bytes, list[int]] = {}
        for chunk in text_chunks(batches):
            got = _by_text(chunk.num_rows, *frequencies(chunk.column(1), number, held))
            yield pa.RecordBatch.from_arrays([chunk.column(0), chunk.column(2), *(pa.array([x[i] for x in got], pa.list_(pa.int32())) for i in (0, 1))], ["doc_id", "toxic", "terms", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, toxic int, terms array<int>, tf array<int>").collect()
    # like examples stand in one block: its bounds are tight then
    found.sort(key=lambda r: (r["terms"], r["tf"], r["toxic"], str(r["doc_id"])))
    labels = np.array([r["toxic"] for r in found], float)
    if not len(labels):
        return None
    drawn = Counter(r["toxic"] for r in found)
    weigh = np.where(labels > 0, n[1] / max(1, drawn[1]), n[0] / max(1, drawn[0]))
    index = Index(told, np.log((1 + total) / (1 + df)) + 1, [r["doc_id"] for r in found], labels, weigh / weigh.mean())
    index.rate = n[1] / (n[0] + n[1])
    vectors = [index.vector(tuple(r["terms"]), tuple(r["tf"])) for r in found]
    index.fill(vectors)
    index.calibrate(vectors)
    return index


def score(docs: DataFrame, index: Index | None) -> DataFrame:
    """doc_id, score, neighbours (doc_id, similarity, toxic) for every row of ``docs`` (doc_id, text).

    A text without a telling word, an empty or null one too, gets the rate of such examples and no neighbours. Without
    an index the score is 0. Rows are judged one by one over their whole text; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        held: dict[bytes, list[int]] = {}
        for chunk in text_chunks(batches):
            ids = chunk.column(0)
            if index is None:
                judged = [(0.0, [])] * chunk.num_rows
            else:
                judged = [index.judge(*x) for x in _by_text(chunk.num_rows, *frequencies(chunk.column(1), index.number, held))]
            flat = [x for _, near in judged for x in near]
            at = np.array([i for _, i in flat], np.int64)
            of = pa.array(index.ids if index else [], ids.type).take(pa.array(at))
            toxic = pa.array((index.toxic if index else np.zeros(0))[at], pa.int32(), safe=False)
            near = pa.StructArray.from_arrays([of, pa.array([s for s, _ in flat], pa.float64()), toxic], ["doc_id", "similarity", "toxic"])
            cuts = pa.array(np.concatenate(([0], np.cumsum([len(x) for _, x in judged]))), pa.int32())
            yield pa.RecordBatch.from_arrays([ids, pa.array([s for s, _ in judged], pa.float64()), pa.ListArray.from_arrays(cuts, near)], ["doc_id", "score", "neighbours"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, neighbours array<struct<doc_id: {kind}, similarity: double, toxic: int>>")
