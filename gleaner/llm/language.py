"""Language identification with character language models (operator 7).

One interpolated Kneser-Ney model a language, over the characters of single words between blanks. The n-grams of all
languages stand in one sorted array of 64-bit keys for each order, with a column of log-probabilities and of back-off
weights for each language. A text gets the language of lowest cross-entropy a character; a limit calibrated on labelled
texts rejects what no learned language explains.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mix64, split_words, text_chunks

ORDER = 4
#: Labelled documents a language that the models are fitted on, and a part of them that calibrates the limit (expected numbers).
FIT, CALIBRATE = 1500, 400
#: Share of calibrating texts over the limit before its margin for short texts.
TAIL = 0.001
UNDETERMINED = "und"
#: Scored words that a worker remembers.
REMEMBERED = 250_000
#: Bytes of text and words scored at once: they bound what a worker holds beside its Arrow batch.
CHUNK, WORDS = 1 << 20, 8192
_NOT_LETTER = re.compile(r"[\W\d_]+")
#: Odd multiplier of n-gram keys: a key is the polynomial of its characters' mixed code points, modulo 2 ** 64.
_STEP = 0x9E3779B97F4A7C15


def letters_of(words: list[bytes]) -> list[str]:
    """Lower-cased letters of each word."""
    return [_NOT_LETTER.sub("", w.decode("utf-8", "replace").lower()) for w in words]


@dataclass
class Model:
    languages: list[str]
    keys: list[np.ndarray]  # of each order, sorted
    logp: list[np.ndarray]  # n-grams x languages, natural logs, nan where a language lacks the n-gram
    back: list[np.ndarray]  # log weight of the lower order after this context, 0 where there is none
    floor: float  # log-probability of a character that a language has never seen
    limit: dict | None = None  # language: (entropy, margin)

    def score_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words x languages sums of log-probability, characters scored: letters and the closing blank)."""
        done = [self._score_some(words[i : i + WORDS]) for i in range(0, len(words), WORDS)]
        if not done:
            return np.zeros((0, len(self.languages))), np.zeros(0, np.int64)
        return np.concatenate([sums for sums, _ in done]), np.concatenate([sizes for _, sizes in done])

    def _score_some(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        flat = np.frombuffer(("".join(f"{w} " for w in words)).encode("utf-32-le", "surrogatepass"), np.uint32)
        ids = mix64(np.concatenate(([32], flat)))  # a blank goes before the first word
        ends = np.cumsum(sizes)
        depth = np.arange(len(ids)) - np.repeat(np.concatenate(([0], ends[:-1])), sizes + (np.arange(len(sizes)) == 0))
        total = None
        key, before = ids, None
        for k in range(len(self.keys)):
            if k:
                key = key.copy()
                key[k:] += ids[:-k] * np.uint64(pow(_STEP, k, 1 << 64))
            place = np.minimum(np.searchsorted(self.keys[k], key), len(self.keys[k]) - 1)
            hit = (self.keys[k][place] == key) & (depth >= k)
            if total is None:
                total = np.where(hit[:, None], self.logp[0][place], self.floor)
                total = np.where(np.isnan(total), self.floor, total)
            else:
                backed = total.copy()
                backed[1:] += np.where(before[1][:-1, None], self.back[k - 1][before[0][:-1]], 0.0)
                own = np.where(hit[:, None], self.logp[k][place], np.nan)
                total = np.where((depth >= k)[:, None], np.where(np.isnan(own), backed, own), total)
            before = (place, hit)
        return np.add.reduceat(total[1:], ends - sizes, axis=0), sizes

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages cross-entropy in bits a character, characters): nan for a text without letters."""
        counts, words = split_words(texts, alnum=True)
        coded = words.dictionary_encode()
        sums, sizes = self._scored(coded.dictionary.to_pylist())
        codes, of = coded.indices.to_numpy(), np.repeat(np.arange(len(counts)), counts)
        # each text is summed by itself, a language at a time: no figure depends on the texts beside it
        n = np.bincount(of, sizes[codes], len(counts)).astype(np.int64)
        loss = np.empty((len(counts), len(self.languages)))
        for j in range(loss.shape[1]):
            loss[:, j] = np.bincount(of, sums[codes, j], len(counts))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(n[:, None] > 0, -loss / np.log(2) / n[:, None], np.nan), n

    def _scored(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sums and sizes of distinct words; those met in earlier chunks are remembered, up to REMEMBERED of them."""
        held = self.__dict__.setdefault("_held", {})
        if "_sums" not in self.__dict__ or len(held) + len(words) > REMEMBERED:
            held.clear()
            room = REMEMBERED + len(words)
            self._sums, self._sizes = np.zeros((room, len(self.languages))), np.zeros(room, np.int64)
        new = [w for w in words if w not in held]
        if new:
            at = len(held)
            letters = letters_of(new)
            sums, sizes = self.score_words(letters)
            empty = np.fromiter((not x for x in letters), bool, len(letters))
            sums[empty], sizes = 0.0, np.where(empty, 0, sizes)
            self._sums[at : at + len(new)], self._sizes[at : at + len(new)] = sums, sizes
            held.update(zip(new, range(at, at + len(new))))
        places = np.fromiter(map(held.__getitem__, words), np.int64, len(words))
        return self._sums[places], self._sizes[places]

    def forget(self) -> None:
        """Drop the words remembered."""
        for name in ("_held", "_sums", "_sizes"):
            self.__dict__.pop(name, None)

    def over_limit(self, best: np.ndarray, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        if not self.limit:
            return np.zeros(len(best), bool)
        level = np.array([self.limit[x][0] for x in self.languages])[best]
        margin = np.array([self.limit[x][1] for x in self.languages])[best]
        return entropy > level + margin / np.sqrt(np.maximum(n, 1))


def _count(labelled: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n): n-grams of 1 to ``order`` characters, with blanks around each word; combined in each task."""

    @lean
    def run(batches):
        held: dict[str, dict[str, int]] = {}
        for batch in batches:
            for chunk in text_chunks([batch]):
                langs = np.array(chunk.column(0).to_pylist(), object)
                counts, words = split_words(chunk.column(1), alnum=True)
                coded, of = words.dictionary_encode(), np.repeat(np.arange(len(counts)), counts)
                distinct, codes = letters_of(coded.dictionary.to_pylist()), coded.indices.to_numpy()
                for lang in set(langs):
                    times = np.bincount(codes[langs[of] == lang], minlength=len(distinct))
                    own = held.setdefault(lang, {})
                    for i in np.flatnonzero(times).tolist():
                        if distinct[i]:
                            own[distinct[i]] = own.get(distinct[i], 0) + int(times[i])
        for lang, words_ in held.items():
            grams: dict[str, int] = {}
            for word, n in words_.items():
                padded = f" {word} "
                for i in range(1, len(padded)):
                    for k in range(1, min(order, i + 1) + 1):
                        gram = padded[i + 1 - k : i + 1]
                        grams[gram] = grams.get(gram, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])

    return labelled.select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _kneser_ney(counts: dict[str, int], order: int) -> tuple[list[dict], list[dict], float]:
    """Log-probabilities and log back-off weights of the n-grams of each order, interpolated Kneser-Ney."""
    of = [{} for _ in range(order)]
    for gram, n in counts.items():
        of[len(gram) - 1][gram] = n
    # below the top order a count is the number of different characters before the n-gram; n-grams that begin with the
    # blank have nothing before them and keep their counts
    for k in range(order - 2, -1, -1):
        seen: dict[str, int] = {}
        for gram in of[k + 1]:
            seen[gram[1:]] = seen.get(gram[1:], 0) + 1
        of[k] = {g: (n if g[0] == " " and k else seen.get(g, 0)) for g, n in of[k].items()}
        of[k] = {g: n for g, n in of[k].items() if n}
    logp, back, lower = [], [], {}
    uniform = 1.0 / (len(of[0]) + 1)
    for k in range(order):
        values = list(of[k].values())
        once, twice = values.count(1), values.count(2)
        discount = min(0.9, once / (once + 2 * twice)) if once else 0.0
        total: dict[str, float] = {}
        kinds: dict[str, int] = {}
        for gram, n in of[k].items():
            total[gram[:-1]] = total.get(gram[:-1], 0) + n
            kinds[gram[:-1]] = kinds.get(gram[:-1], 0) + 1
        left = {c: max(discount * kinds[c] / total[c], 1e-9) for c in total}
        probs = {g: max(n - discount, 0) / total[g[:-1]] + left[g[:-1]] * (lower.get(g[1:], uniform) if k else uniform) for g, n in of[k].items()}
        logp.append({g: float(np.log(p)) for g, p in probs.items()})
        back.append({c: float(np.log(x)) for c, x in left.items()})
        lower = probs
        if not k:
            floor = float(np.log(max(left.get("", 1e-9) * uniform, 1e-12)))
    return logp, back, floor


def build(counts: dict[str, dict[str, int]], order: int = ORDER) -> Model:
    """Model of the counted n-grams of each language."""
    languages = sorted(counts)
    mixed: dict[str, int] = {}

    def key(gram: str) -> int:
        x = 0
        for c in gram:
            if c not in mixed:
                mixed[c] = int(mix64(np.array([ord(c)]))[0])
            x = x * _STEP + mixed[c] & (1 << 64) - 1
        return x

    fitted = [_kneser_ney(counts[x], order) for x in languages]
    keys, logs, backs = [], [], []
    for k in range(order):
        coded: list[dict[int, float]] = [{} for _ in languages]
        behind: list[dict[int, float]] = [{} for _ in languages]
        for j, (logp, back, _) in enumerate(fitted):
            for gram, x in logp[k].items():
                coded[j][key(gram)] = x
            if k + 1 < order:
                for gram, x in back[k + 1].items():
                    behind[j].setdefault(key(gram), x)
        every = np.array(sorted(set().union(*coded, *behind)), np.uint64)
        if len(every) < len(set().union(*(logp[k] for logp, _, _ in fitted), *(back[k + 1] for _, back, _ in fitted if k + 1 < order))):
            raise ValueError("two n-grams have one key")
        table, weights = np.full((len(every), len(languages)), np.nan), np.zeros((len(every), len(languages)))
        for j in range(len(languages)):
            for out, source in ((table, coded[j]), (weights, behind[j])):
                if source:
                    out[np.searchsorted(every, np.fromiter(source, np.uint64, len(source))), j] = list(source.values())
        keys.append(every)
        logs.append(table)
        backs.append(weights)
    return Model(languages, keys, logs, backs, min((f for _, _, f in fitted), default=-20.0))


def train(labelled: DataFrame, order: int = ORDER, fit: int = FIT, calibrate: int = CALIBRATE) -> Model | None:
    """Fit on ``labelled`` (doc_id, text, lang); rows without text or lang are left out. None if nothing is left.

    About ``fit`` documents a language, chosen by a hash of the id, are counted on the executors; about ``calibrate``
    more set the limit of each language. Only n-gram counts and entropies of these reach the driver.
    """
    rows = labelled.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    draw = (F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)).alias("draw")
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, (fit + calibrate) / n)))[F.col("lang")]
    cut = fit / (fit + calibrate)
    rows = rows.withColumn("draw", draw / F.least(share, F.lit(1.0)))
    counts: dict[str, dict[str, int]] = {}
    for r in _count(rows.filter(F.col("draw") < cut), order).toLocalIterator():
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    if not counts:  # so few rows that the draw left none: take them all
        for r in _count(rows, order).toLocalIterator():
            counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    if not counts:
        return None
    model = build(counts, order)
    told: dict[str, list[tuple[float, int]]] = {x: [] for x in model.languages}
    for r in predict(rows.filter((F.col("draw") >= cut) & (F.col("draw") < 1)), model).filter("entropy IS NOT NULL").select("lang_pred", "entropy", "n_letters").collect():
        told[r["lang_pred"]].append((r["entropy"], r["n_letters"]))
    model.limit = {}
    every = [x for own in told.values() for x in own]
    for lang, own in told.items():
        own = own if len(own) >= 20 else every
        if not own:
            model.limit = None
            break
        entropy, n = np.array([x[0] for x in own]), np.array([x[1] for x in own])
        level = float(np.quantile(entropy, 1 - TAIL, method="higher"))
        spread = float(np.std(entropy * np.sqrt(n))) if len(own) > 1 else 0.0
        model.limit[lang] = (level + 0.05 * level, max(4.0, spread))
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, entropy, n_letters, rejected for every row of ``docs`` (doc_id, text).

    A text that is null or has no letter is ``und`` with score 0, and rejected; so is every text without a model. Equal
    entropies fall to the language that sorts first. score is the share of the best language among all, likelihoods
    flattened as for a text of at most 40 characters. Whole texts are read, in bounded pieces of many texts at once.
    Other columns are ignored; repeated rows give repeated results; no rows give none.
    """

    @lean
    def run(batches):
        names = ["doc_id", "lang_pred", "score", "entropy", "n_letters", "rejected"]
        for chunk in text_chunks(batches, limit=CHUNK):
            rows = chunk.num_rows
            if model is None:
                best, sure, entropy, n, bad = np.zeros(rows, int), np.zeros(rows), np.full(rows, np.nan), np.zeros(rows, np.int64), np.ones(rows, bool)
                names_of = [UNDETERMINED]
            else:
                cross, n = model.score(chunk.column(1))
                none = n == 0
                cross[none] = 0.0
                best = np.argmin(cross, axis=1)
                entropy = cross[np.arange(rows), best]
                odds = np.exp2(-(cross - entropy[:, None]) * np.minimum(n, 40)[:, None])
                sure = np.where(none, 0.0, 1.0 / odds.sum(axis=1))
                bad = none | model.over_limit(best, entropy, n)
                best, entropy = np.where(none, len(model.languages), best), np.where(none, np.nan, entropy)
                names_of = [*model.languages, UNDETERMINED]
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array([names_of[i] for i in best], pa.string()), pa.array(sure), pa.array(entropy, from_pandas=True), pa.array(n), pa.array(bad)], names)
        if model is not None:
            model.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, entropy double, n_letters long, rejected boolean")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` (text and any other columns, all kept) that the model does not reject. Nothing is moved."""

    @lean
    def run(batches):
        for chunk in text_chunks(batches, limit=CHUNK):
            if model is not None:
                cross, n = model.score(chunk.column(chunk.schema.get_field_index("text")))
                cross[n == 0] = 0.0
                best = np.argmin(cross, axis=1)
                bad = (n == 0) | model.over_limit(best, cross[np.arange(len(best)), best], n)
                yield chunk.filter(pa.array(~bad))
        if model is not None:
            model.forget()

    return docs.mapInArrow(run, docs.schema)
