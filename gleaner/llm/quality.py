"""Quality classifier: document evidence and hierarchical empirical Bayes over sites (operator 9).

A logistic model of a dozen figures of a text gives each document's own evidence. Sites (host) and their sections (path)
then get posteriors by grouped aggregation: a section is shrunk toward its site, a site toward the global rate, the more
so the fewer documents it has; how much follows from how far sites really differ (method of moments).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, offsets_of, split_words, stash, text_chunks

#: Most labelled documents that the document model is fitted on (expected number, drawn by a hash of the id).
FIT = 20_000
#: Documents whose posterior of good quality is lower are rejected.
KEEP = 0.5
#: Least and most prior weight, in documents, of a level over the level below.
WEIGHT = (2.0, 1e4)
FEATURES = ("symbols", "upper", "digits", "punctuated", "blank", "non_ascii", "word_length", "repeats", "distinct", "lines", "words", "marked", "shouted")

_CLASS = np.zeros((6, 256), np.float32)
for _row, _bytes in enumerate((b"%#&*$|<>{}[]=+~^\\@_", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?", b" \t\r", bytes(range(128, 256)))):
    _CLASS[_row, np.frombuffer(_bytes, np.uint8)] = 1


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; a null text is empty, and an empty text has zeros."""
    offsets, data = offsets_of(texts)
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    out = np.zeros((len(texts), len(FEATURES)))
    for k in range(len(_CLASS)):
        sums = np.concatenate(([0], np.cumsum(_CLASS[k].astype(np.uint8)[data], dtype=np.int64)))
        out[:, k] = np.diff(sums[offsets]) / size
    counts, words = split_words(texts)
    n = np.maximum(counts, 1).astype(np.float64)
    of = np.repeat(np.arange(len(counts)), counts)
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    lengths = np.diff(np.frombuffer(words.buffers()[1], np.int64)) if len(words) else np.zeros(0, np.int64)
    out[:, 6] = np.log1p(np.bincount(of, lengths, len(counts)) / n)
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (of[1:] == of[:-1])
    out[:, 7] = np.bincount(of, again, len(counts)) / n
    kinds = np.unique(of * (codes.max(initial=0) + 1) + codes) // (codes.max(initial=0) + 1)
    # distinct words against what Heaps' law lets expect
    out[:, 8] = np.where(counts > 0, np.log(np.maximum(np.bincount(kinds, minlength=len(counts)), 1) / n**0.8), 0.0)
    newlines = np.concatenate(([0], np.cumsum(data == 10, dtype=np.int64)))
    out[:, 9] = np.diff(newlines[offsets]) / n
    out[:, 10] = np.log1p(counts)
    # words that hold a symbol; words without a lower-case letter
    if len(words):
        cuts = np.frombuffer(words.buffers()[1], np.int64)
        chars = np.frombuffer(words.buffers()[2], np.uint8)
        marks = np.concatenate(([0], np.cumsum(_CLASS[0].astype(np.uint8)[chars], dtype=np.int64)))
        out[:, 11] = np.bincount(of, np.diff(marks[cuts]) > 0, len(counts)) / n
        bangs = np.concatenate(([0], np.cumsum(chars == 33, dtype=np.int64)))
        out[:, 12] = np.bincount(of, np.diff(bangs[cuts]) > 0, len(counts)) / n
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the constant
    rate: float  # share of good documents among the labelled

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        # squares let a figure be bad on either side
        return np.clip(np.hstack((z, z * z, np.ones((len(z), 1)))) @ self.weights, -12, 12)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Model:
    """Logistic regression by Newton's method."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    z = np.hstack((z, z * z, np.ones((len(z), 1))))
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -12, 12)))
        gradient = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, w, float(y.mean()))


def train(docs: DataFrame, labels: DataFrame, most: int = FIT) -> Model | None:
    """Fit on the documents (doc_id, text) that ``labels`` (doc_id, quality) names; None unless both labels occur.

    About ``most`` labels are drawn by a hash of the id before the texts are looked up; their figures reach the driver.
    """
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality IS NOT NULL")
    total = marked.count()
    if total > most:
        marked = marked.filter(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) < int(most / total * (1 << 30)))
    rows = docs.select("doc_id", "text").join(stash(marked, "quality-draw"), "doc_id").select("doc_id", "text", "quality")

    @lean
    def run(batches):
        for chunk in text_chunks(batches):
            x = features(chunk.column(1))
            yield pa.RecordBatch.from_arrays([chunk.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["quality", "x"])

    got = rows.mapInArrow(run, "quality int, x array<double>").collect()
    y = np.array([1.0 if r["quality"] > 0 else 0.0 for r in got])
    if not len(y) or y.min() == y.max():
        return None
    return fit(np.array([r["x"] for r in got]), y)


def evidence(docs: DataFrame, model: Model | None, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path, logit of every row of ``docs`` (doc_id, text)."""

    @lean
    def run(batches):
        for chunk in text_chunks(batches):
            logit = model.logits(np.clip(features(chunk.column(1)), model.mean - 8 * model.scale, model.mean + 8 * model.scale)) if model else np.zeros(chunk.num_rows)
            yield pa.RecordBatch.from_arrays([chunk.column(0), chunk.column(2), chunk.column(3), pa.array(logit, pa.float64())], ["doc_id", "host", "path", "logit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", host.cast("string").alias("host"), path.cast("string").alias("path")).mapInArrow(run, f"doc_id {kind}, host string, path string, logit double")


def _weight(groups: DataFrame, rate: Column) -> Column:
    """Prior weight in documents, by moments over ``groups`` (n, good, square): within-group over between-group variance."""
    within = F.sum(F.col("square") - F.col("good") * F.col("good") / F.col("n")) / F.greatest(F.sum("n") - F.count(F.lit(1)), F.lit(1))
    spread = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - rate, 2)) / F.greatest(F.sum("n"), F.lit(1))
    sampling = within * F.count(F.lit(1)) / F.greatest(F.sum("n"), F.lit(1))
    return F.least(F.lit(WEIGHT[1]), F.greatest(F.lit(WEIGHT[0]), within / F.greatest(spread - sampling, F.lit(1e-9))))


def classify(docs: DataFrame, model: Model | None, host: Column | None = None, path: Column | None = None, keep: float = KEEP, labels: DataFrame | None = None) -> DataFrame:
    """Posterior quality of every row of ``docs`` (doc_id, text and what ``host`` and ``path`` name).

    Columns: doc_id, doc_quality (text alone), host_rate, path_rate, quality, keep. By default the host is ``source``
    and the path below it ``lang``. A site's rate counts each of its documents by its label (``labels``: doc_id, quality)
    where it has one, else by its evidence; a document's own part is left out of the rates that it is judged by. Null
    hosts or paths are groups of their own. Empty and null texts have zero figures. Without a model all evidence is
    even, and everything is kept. Repeated rows count as often as they stand; labels that disagree count by their mean;
    other columns are ignored; an empty table gives none.
    """
    host, path = F.col("source") if host is None else host, F.col("lang") if path is None else path
    rows = evidence(docs, model, host, path)
    p = 1 / (1 + F.exp(-F.col("logit")))
    if labels is not None:
        told = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(F.avg((F.col("quality") > 0).cast("double")).alias("told"))
        # written: a join that reads an aggregate in place cannot split the rows of a hot id
        rows = rows.join(stash(told, "quality-labels"), F.col("doc_id") == F.col("of"), "left").drop("of")
    else:
        rows = rows.withColumn("told", F.lit(None).cast("double"))
    rows = stash(rows.withColumn("own", F.coalesce("told", p)).drop("told"), "evidence")
    paths = stash(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("good"), F.sum(F.col("own") * F.col("own")).alias("square")), "sections")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("square").alias("square"))
    top = hosts.agg((F.sum("good") / F.sum("n")).alias("rate")).first()["rate"]
    top = 0.5 if top is None else min(max(top, 1e-6), 1 - 1e-6)
    host_weight = hosts.agg(_weight(hosts, F.lit(top)).alias("w")).first()["w"] or WEIGHT[0]
    hosts = hosts.select(F.col("host").alias("of"), F.col("n").alias("host_n"), F.col("good").alias("host_good"))
    sections = stash(paths.join(hosts, F.col("host").eqNullSafe(F.col("of"))).drop("of"), "site-counts")
    shrunk = lambda good, n, weight, toward: (good + weight * toward) / (n + weight)
    whole = shrunk(F.col("host_good"), F.col("host_n"), host_weight, top)
    path_weight = sections.agg(_weight(sections, whole).alias("w")).first()["w"] or WEIGHT[0]
    sections = sections.select(F.col("host").alias("in_host"), F.col("path").alias("in_path"), "n", "good", "host_n", "host_good")
    known = rows.join(sections, F.col("host").eqNullSafe(F.col("in_host")) & F.col("path").eqNullSafe(F.col("in_path")), "left")
    known = known.withColumn("host_rate", shrunk(F.col("host_good") - F.col("own"), F.col("host_n") - 1, host_weight, top))
    known = known.withColumn("path_rate", shrunk(F.col("good") - F.col("own"), F.col("n") - 1, path_weight, F.col("host_rate")))
    odds = lambda c: F.log(F.greatest(c, F.lit(1e-6)) / F.greatest(1 - c, F.lit(1e-6)))
    prior = odds(F.col("path_rate")) - F.lit(float(np.log(top / (1 - top))))
    known = known.withColumn("quality", 1 / (1 + F.exp(-(F.col("logit") + prior))))
    good = F.col("quality") >= keep if model else F.lit(True)
    return known.select("doc_id", p.alias("doc_quality"), "host_rate", "path_rate", "quality", good.alias("keep"))
