"""Language-model scoring with an Elias-Fano n-gram trie (operator 8).

The probability of a text is the mean of two models': one of word pairs, one of word triples, both smoothed toward exact
unigrams with a Dirichlet weight. Every training word has its own unigram probability, an unknown word that of one more
token; text starts are contexts like others. In both models a token's probability is a share of its word (its count in
the context, and its own) over a share of the words before (the context's count), and the context's count is the count of
the token before in its own, shorter context. All are known where all tokens of a word meet, so tokens are dealt by word,
each with the two before: a part builds its part of the trie from the training tokens (words with exact counts, words
before them, and words before those, as monotone sequences in Elias-Fano form with quantised probabilities), maps it into
memory and seeks each distinct word, pair and triple of all tokens of that part, once and in order. Sums travel back to the documents. The driver holds totals and the hot words,
fewer than 1 / HOT; the part of each word is as many as the session's partitions, and no score depends on them.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_words, mix64, shuffle_width, split_words, stash, text_chunks
from .near_duplicates import _join, _part, _small

#: Weight of the unigram model, in tokens, in every context of one word, and of two.
MU, MU_PAIR = 300.0, 2.0
#: A word with more than this share of all tokens is dealt by itself and the word before.
HOT = 1 / 2000
#: Tokens that a worker packs at once.
PACKED = 3_000_000
#: Hash of the end of a text. A fixed value, any odd number would do.
END = np.uint64(0xD1B54A32D192ED03)
#: Log10 probabilities are kept in 65535 steps down to this.
LOWEST = -14.0
_K = np.uint64(0x9E3779B97F4A7C15)
_LN = np.log(10.0)
#: Words before a word are known by 40 bits, and those before a known pair by 24.
_SHORT, _SHORTER = np.uint64(24), np.uint64(40)
_TO_WORD, _TO_PAIR = np.uint64(40), np.uint64(24)
_OF_PAIR, _OF_TRIPLE = np.uint64((1 << 40) - 1), np.uint64((1 << 24) - 1)
#: Stands before the first word of a text; fixed like END.
START = np.uint64(0x8CB92BA72F3D8DD7)


#: Bytes of high bits that are unpacked at once.
_BLOCK = 1 << 13


class EliasFano:
    """A non-decreasing sequence of 64-bit numbers: whole low bytes side by side, high parts as a unary bit vector.

    Numbers are sought in order: a block of high bits is unpacked once for all that may lie in it, others are passed over.
    """

    def __init__(self, n: int, low_bytes: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bytes, self.low, self.high = n, low_bytes, low, high
        # numbers, and ended high parts, before each block: the bits themselves stay packed
        ones = np.add.reduceat(np.bitwise_count(high), np.arange(0, len(high), _BLOCK), dtype=np.int64)
        self.before = np.minimum(np.concatenate(([0], np.cumsum(ones))), n)
        self.zeros = np.minimum(np.arange(len(self.before)) * _BLOCK, len(high)) * 8 - self.before

    @staticmethod
    def pack(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        """(n, bytes of a low part, low parts, bits) of sorted values."""
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, top.bit_length() - max(1, n).bit_length() + 1)
        low_bytes = min(7, -(-bits // 8))
        low = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :low_bytes]).ravel()
        high = (values >> np.uint64(8 * low_bytes)).astype(np.int64)
        flags = np.zeros(n + (top >> 8 * low_bytes) + 2, np.uint8)
        flags[high + np.arange(n)] = 1
        # every bit past the last is a zero that ends a high part; pad with ones, which end none
        fill = -len(flags) % 8
        return n, low_bytes, low, np.packbits(np.concatenate((flags, np.ones(fill, np.uint8))), bitorder="little")

    def _block(self, k: int) -> np.ndarray:
        """The numbers whose bits stand in block ``k``."""
        a, b = int(self.before[k]), int(self.before[k + 1])
        at = np.flatnonzero(np.unpackbits(self.high[k * _BLOCK : (k + 1) * _BLOCK], bitorder="little"))[: b - a]
        low = np.zeros((b - a, 8), np.uint8)
        low[:, : self.low_bytes] = self.low[a * self.low_bytes : b * self.low_bytes].reshape(b - a, self.low_bytes)
        high = at - np.arange(b - a) + int(self.zeros[k])
        return (high.astype(np.uint64) << np.uint64(8 * self.low_bytes)) | low.view("<u8")[:, 0]

    def locate(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first number that is at least x, whether it is x) for each x; quickest where these are sorted."""
        if (x[1:] < x[:-1]).any():
            order = np.argsort(x)
            place, held = np.empty(len(x), np.int64), np.empty(len(x), bool)
            place[order], held[order] = self.locate(x[order])
            return place, held
        place, held = np.full(len(x), self.n, np.int64), np.zeros(len(x), bool)
        done = k = 0
        while done < len(x):
            # all numbers before a block have high parts up to the zeros before it
            k = max(k, int(np.searchsorted(self.zeros, int(x[done]) >> 8 * self.low_bytes)) - 1)
            if k >= len(self.before) - 1:
                break
            values = self._block(k)
            if len(values) and x[done] <= values[-1]:
                upto = done + int(np.searchsorted(x[done:], values[-1], side="right"))
                at = np.searchsorted(values, x[done:upto])
                place[done:upto] = at + self.before[k]
                held[done:upto] = values[at] == x[done:upto]
                done = upto
            k += 1
        return place, held

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of the first number that is at least x, for each x."""
        return self.locate(x)[0]


def quantise(log10: np.ndarray) -> np.ndarray:
    """Codes of log10 probabilities; rounded down, so that sums of probabilities don't grow."""
    return np.clip(np.ceil(np.asarray(log10) / LOWEST * 65535 - 1e-9), 0, 65535).astype(np.uint16)


def restore(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) * (LOWEST / 65535)


class Grams:
    """The distinct words, pairs and triples of a part's tokens, each in order, and how often they stand in training.

    ``words`` are hashes; of the tokens, ``pair`` is the number of the word and 40 bits of the word before, ``first`` 24 bits
    of the one before that, ``training`` whether the text is of those learned from. A triple is the number of its pair and these.
    """

    def __init__(self, words: np.ndarray, pair: np.ndarray, first: np.ndarray, training: np.ndarray):
        self.words = words
        order = np.argsort(pair)
        pair = pair[order]
        at_pair = _starts(pair)
        self.pairs, self.pair_tokens = pair[at_pair], np.diff(np.append(at_pair, len(pair))).astype(np.uint32)
        del pair
        triple = (np.repeat(np.arange(len(at_pair), dtype=np.uint64), self.pair_tokens) << _TO_PAIR) | first[order]
        # moves tokens within their pairs alone
        again = np.argsort(triple)
        order, triple = order[again], triple[again]
        del again
        at_triple = _starts(triple)
        self.triples, self.triple_tokens = triple[at_triple], np.diff(np.append(at_triple, len(triple))).astype(np.uint32)
        del triple
        training, self.order = training[order], order.astype(np.uint32)
        del order
        at_word = np.searchsorted(self.pairs >> _TO_WORD, np.arange(len(words), dtype=np.uint64))
        of_pair = np.add.reduceat(training, at_pair, dtype=np.uint32)
        self.training = np.add.reduceat(of_pair, at_word, dtype=np.int64), of_pair, np.add.reduceat(training, at_triple, dtype=np.uint32)

    def spread(self, values: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The value of each token, from those of the grams that have as many ``tokens``."""
        out = np.empty(len(self.order), values.dtype)
        out[self.order] = np.repeat(values, tokens)
        return out


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))


class Trie:
    """Three levels: words (hash, training count), the words before each, and the words before those pairs.

    A pair holds its count and its probability with the context of one word; a triple its probability with that of two.
    """

    def __init__(self, data: bytes):
        head, *rest = _part(data)
        self.counts, self.pair_counts, self.pair_codes, self.triple_codes = rest[6:]
        levels = [EliasFano(int(head[2 * k]), int(head[2 * k + 1]), rest[2 * k], rest[2 * k + 1]) for k in range(3)]
        self.words, self.pairs, self.triples = levels

    @staticmethod
    def build(grams: Grams, known: Unigrams, mu: float, mu_pair: float) -> bytes:
        """From the grams that stand in training."""
        held = [t > 0 for t in grams.training]
        number = [np.cumsum(h).astype(np.uint64) - np.uint64(1) for h in held]
        words, pairs, triples = (g[h] for g, h in zip((grams.words, grams.pairs, grams.triples), held))
        times = [t[h] for t, h in zip(grams.training, held)]
        of_pair, of_triple = number[0][pairs >> _TO_WORD], number[1][triples >> _TO_PAIR]
        total = known.fix_hot(words, times[0])
        single = total / (known.n + 1)
        # the share of the context is left open; over all tokens these are at most 1
        pair_codes = quantise(np.log10((times[1] + mu * single[of_pair]) / (known.n + mu)))
        triple_codes = quantise(np.log10((times[2] + mu_pair * single[of_pair][of_triple]) / (known.n + mu_pair)))
        levels = (words, (of_pair << _TO_WORD) | (pairs & _OF_PAIR), (of_triple << _TO_PAIR) | (triples & _OF_TRIPLE))
        del held, number, pairs, triples, of_pair, of_triple
        packed = [EliasFano.pack(x) for x in levels]
        head = np.array([x for p in packed for x in p[:2]], np.int64)
        return _join(head, *(a for p in packed for a in p[2:]), total.astype(np.int64), _small(times[1]), pair_codes, triple_codes)

    def lookup(self, grams: Grams, known: Unigrams, mu: float, mu_pair: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 share of each pair after one word, of each triple after two, training count of each word).

        The share is the token's in its context, times the back-off that the token gives to the next one as its context:
        over a text they multiply to its probability. Each gram is sought once, in order.
        """
        words = grams.words
        place, held = self.words.locate(words)
        count = np.zeros(len(words), np.int64)
        count[held] = self.counts[place[held]]
        # a hot word may have no training token in this part
        count = known.fix_hot(words, count)
        single = np.log10(np.maximum(count, 1) / (known.n + 1))
        of, before = (grams.pairs >> _TO_WORD).astype(np.int64), grams.pairs & _OF_PAIR
        after_one = single[of] + np.log10(mu)
        pair_count, pair = np.zeros(len(of), np.int64), np.full(len(of), -1)
        at = np.flatnonzero(held[of])
        found, hit = self.pairs.locate((place[of[at]].astype(np.uint64) << _TO_WORD) | before[at])
        at, found = at[hit], found[hit]
        after_one[at] = restore(self.pair_codes[found]) + np.log10(known.n + mu)
        pair_count[at], pair[at] = self.pair_counts[found], found
        of_triple = (grams.triples >> _TO_PAIR).astype(np.int64)
        after_two = (single + np.log10(mu_pair))[of][of_triple]
        at = np.flatnonzero((pair >= 0)[of_triple])
        found, hit = self.triples.locate((pair[of_triple[at]].astype(np.uint64) << _TO_PAIR) | (grams.triples[at] & _OF_TRIPLE))
        after_two[at[hit]] = restore(self.triple_codes[found[hit]]) + np.log10(known.n + mu_pair)
        del at, found, hit
        inner = words != END
        opens = before == START >> _SHORT
        texts = known.texts()
        after_one -= np.where(inner, np.log10(count + mu), 0.0)[of] + np.where(opens, np.log10(texts + mu), 0.0)
        after_two -= (np.where(inner[of], np.log10(pair_count + mu_pair), 0.0) + np.where(opens, np.log10(texts + mu_pair), 0.0))[of_triple]
        return after_one, after_two, count


def mapped(data: bytes) -> np.memmap:
    """The bytes in a file without a name, mapped into memory: pages come and go as they are asked for."""
    with tempfile.TemporaryFile() as f:
        f.write(data)
        f.flush()
        return np.memmap(f, np.uint8, "r")


def _part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


class Unigrams:
    """Totals, and counts of the hot words and of the end: all that the driver holds of the corpus."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n: int, v: int):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.n, self.v = hashes[order], counts[order], n, v
        # mean probability of the words not held here, an unknown word (one token of n + 1) among them
        self.share = (n - int(self.counts.sum()) + 1) / (n + 1) / (v - len(self.hashes) + 1)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def texts(self) -> int:
        """Number of training texts: each has one end."""
        at, hot = self._find(np.array([END]))
        return int(self.counts[at[0]]) if hot[0] else 0

    def is_hot(self, hashes: np.ndarray) -> np.ndarray:
        return self._find(hashes)[1]

    def fix_hot(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Counts over the whole corpus of the words that are dealt to many parts; others have theirs."""
        at, hot = self._find(hashes)
        out = counts.copy()
        out[hot] = self.counts[at[hot]]
        return out


def count_unigrams(training: DataFrame) -> Unigrams:
    """Count all tokens of ``training`` (text): exact numbers of tokens and of distinct tokens, and the hot words."""
    parts = shuffle_width(training.sparkSession)

    def count(batches):
        hashes, times, pending, texts = [], [], 0, 0

        def merge():
            h, at = np.unique(np.concatenate(hashes), return_inverse=True)
            n = np.bincount(at, np.concatenate(times)).astype(np.int64)
            hashes[:], times[:] = [h], [n]

        for chunk in text_chunks(batches):
            texts += chunk.num_rows
            _, words = split_words(chunk.column(0))
            if len(words):
                hashed, _ = hash_words(words)
                h, n = np.unique(hashed, return_counts=True)
                hashes.append(h)
                times.append(n)
                pending += len(h)
                if pending > PACKED:
                    merge()
                    pending = len(hashes[0])
        hashes.append(np.array([END]))
        times.append(np.array([texts]))
        merge()
        h, n = hashes[0][times[0] > 0], times[0][times[0] > 0]
        cuts = np.searchsorted(_part_of(h, parts), np.arange(parts + 1)).tolist()
        rows = [(p, _join(h[a:b], _small(n[a:b]))) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], ["part", "payload"])

    def add(batches):
        held = [_part(p) for b in batches for p in b.column(1).to_pylist()]
        if not held:
            return
        h, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        n = np.bincount(at, np.concatenate([x[1] for x in held])).astype(np.int64)
        # hot in the corpus is hot in its part, which holds fewer tokens
        top = np.flatnonzero((n > HOT * n.sum()) | (h == END))
        yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())]), pa.array([len(h)]), pa.array([h[top].view(np.int64)], pa.list_(pa.int64())), pa.array([n[top]], pa.list_(pa.int64()))], ["n", "v", "hashes", "counts"])

    got = training.select("text").mapInArrow(count, "part int, payload binary").repartitionById(parts, "part").mapInArrow(add, "n long, v long, hashes array<long>, counts array<long>")
    got = stash(got, "words")
    total = got.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    end = int(np.array([END]).view(np.int64)[0])
    hot = got.select(F.inline(F.arrays_zip("hashes", "counts"))).filter((F.col("counts") > max(1.0, HOT * total["n"])) | (F.col("hashes") == end)).collect()
    return Unigrams(np.array([r["hashes"] for r in hot], np.int64).view(np.uint64), np.array([r["counts"] for r in hot], np.int64), total["n"], total["v"])


def score(docs: DataFrame, training: Column, mu: float = MU, mu_pair: float = MU_PAIR) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) by a model of those where ``training`` holds (null: not).

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Tokens are the words between ASCII
    white space with A-Z lower-cased, and one end. base_score is the add-one unigram log10 probability with exact counts;
    score is the model's, equal for any number of partitions but for rounding. A null, empty or blank text is its end alone. Without training texts all counts are 0.
    Repeated rows each count and get a row each; other columns are ignored; an empty table gives none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = shuffle_width(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("training"))
    words = count_unigrams(rows.filter("training"))
    schema = f"part int, batch long, doc_ids array<{kind}>, payload binary"
    names = ["part", "batch", "doc_ids", "payload"]

    def deal(batches):
        """Tokens packed for the parts of their words, and for each pack a row that keeps its documents."""
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        held: dict[str, list] = {"word": [], "before": [], "first": [], "doc": [], "ids": [], "n": [], "training": []}
        ids = None

        def flush(batch: int):
            word, before, first, doc = (np.concatenate(held[k]) for k in ("word", "before", "first", "doc"))
            flags = np.concatenate(held["training"])
            key = word.copy()
            hot = words.is_hot(word)
            key[hot] = mix64(word[hot] ^ (before[hot] * _K))
            part = _part_of(key, parts)
            order = np.lexsort((before, word, part))
            word, before, first, doc, part = word[order], before[order] >> _SHORT, first[order] >> _SHORTER, doc[order], part[order]
            home = batch % parts
            doc_ids = [x for a in held["ids"] for x in a.to_pylist()]
            out = [(home, doc_ids, _join(np.concatenate(held["n"]), flags))]
            cuts = np.searchsorted(part, np.arange(parts + 1)).tolist()
            for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    starts = np.flatnonzero(np.concatenate(([True], word[a + 1 : b] != word[a : b - 1])))
                    table, local = np.unique(before[a:b], return_inverse=True)
                    out.append((p, None, _join(word[a:b][starts], _small(np.diff(np.append(starts, b - a))), (table >> np.uint64(32)).astype(np.uint8), table.astype(np.uint32), _small(local), (first[a:b] >> np.uint64(16)).astype(np.uint8), first[a:b].astype(np.uint16), _small(doc[a:b]), np.packbits(flags))))
            for x in held.values():
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in out], pa.int32()), pa.array([batch] * len(out), pa.int64()), pa.array([i for _, i, _ in out], pa.list_(ids)), pa.array([d for _, _, d in out], pa.binary())], names)

        batch, pending, docs_held = number, 0, 0
        for chunk in text_chunks(batches):
            ids = chunk.column(0).type
            counts, tokens = split_words(chunk.column(1))
            hashed = hash_words(tokens)[0] if len(tokens) else np.zeros(0, np.uint64)
            ends = np.cumsum(counts)
            word = np.insert(hashed, ends, END)
            before = np.concatenate(([START], word[:-1]))
            begins = ends - counts + np.arange(len(counts))
            before[begins] = START
            first = np.concatenate(([START], before[:-1]))
            first[begins] = START
            held["word"].append(word)
            held["before"].append(before)
            held["first"].append(first)
            held["doc"].append(np.repeat(np.arange(len(counts)), counts + 1) + docs_held)
            held["ids"].append(chunk.column(0))
            held["n"].append(counts + 1)
            held["training"].append(chunk.column(2).to_numpy(zero_copy_only=False).astype(bool))
            pending += len(word)
            docs_held += len(counts)
            if pending >= PACKED or docs_held >= 60_000:
                yield flush(batch)
                batch, pending, docs_held = batch + 1, 0, 0
        if docs_held:
            yield flush(batch)

    def answer(batches):
        """Build this part of the trie and sum up its tokens' probabilities for each pack and document."""
        packs = []
        for b in batches:
            keep = b.column(2).is_valid()
            ids = b.column(2).type
            if keep.true_count:
                yield b.filter(keep)
            packs += [(n, _part(d)) for n, i, d in zip(b.column(1).to_pylist(), b.column(2).is_null().to_pylist(), b.column(3).to_pylist()) if i]
        if not packs:
            return

        distinct = np.unique(np.concatenate([x[0] for _, x in packs]))
        cuts = np.cumsum([0, *(len(x[4]) for _, x in packs)])
        pair, first, own = np.empty(cuts[-1], np.uint64), np.empty(cuts[-1], np.uint32), np.empty(cuts[-1], np.uint8)
        for a, b, (_, x) in zip(cuts, cuts[1:], packs):
            table = (x[2].astype(np.uint64) << np.uint64(32)) | x[3]
            word = np.searchsorted(distinct, x[0]).astype(np.uint64) << _TO_WORD
            pair[a:b] = np.repeat(word, x[1].astype(np.int64)) | table[x[4]]
            first[a:b] = (x[5].astype(np.uint32) << np.uint32(16)) | x[6]
            own[a:b] = np.unpackbits(x[8])[x[7]]
        grams = Grams(distinct, pair, first, own)
        del first, own
        trie = Trie(mapped(Trie.build(grams, words, mu, mu_pair)))
        one, two, count = trie.lookup(grams, words, mu, mu_pair)
        one, two = grams.spread(one, grams.pair_tokens), grams.spread(two, grams.triple_tokens)
        del grams
        base, known = np.log10(count + 1.0), (count > 0).astype(np.float64)
        for s in range(0, len(packs), 8):
            out = []
            for a, b, (n, x) in zip(cuts[s:], cuts[s + 1 :], packs[s : s + 8]):
                doc, word = x[7].astype(np.int64), pair[a:b] >> _TO_WORD
                who = np.flatnonzero(np.bincount(doc))
                sums = [np.bincount(doc, values)[who] for values in (one[a:b], two[a:b], base[word], known[word])]
                out.append((n, _join(_small(who), *sums[:3], _small(sums[3].astype(np.int64)))))
            yield pa.RecordBatch.from_arrays([pa.array([n % parts for n, _ in out], pa.int32()), pa.array([n for n, _ in out], pa.int64()), pa.array([None] * len(out), ids), pa.array([d for _, d in out], pa.binary())], names)

    def collect(batches):
        """Add up the sums of each pack, which all arrive in its part."""
        kept, sums = {}, {}
        for b in batches:
            ids = b.column(2).type.value_type
            for n, doc_ids, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if doc_ids is not None:
                    kept[n] = (doc_ids, *_part(data))
                else:
                    who, *found = _part(data)
                    size = int(who.max()) + 1
                    own = sums.setdefault(n, np.zeros((4, 0)))
                    if own.shape[1] < size:
                        own = sums[n] = np.pad(own, ((0, 0), (0, size - own.shape[1])))
                    for k, values in enumerate(found):
                        own[k, who] += values
        space = np.log10(words.n + words.v + 1.0)
        for n, (doc_ids, size, flags) in kept.items():
            own = sums.get(n, np.zeros((4, 0)))
            own = np.pad(own, ((0, 0), (0, len(doc_ids) - own.shape[1])))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, ids),
                    pa.array(~flags),
                    pa.array(size.astype(np.int64)),
                    pa.array(np.rint(own[3]).astype(np.int64)),
                    pa.array(np.full(len(doc_ids), words.n, np.int64)),
                    pa.array(own[2] - size * space),
                    # the mean of the probabilities, by their logarithms
                    pa.array(np.logaddexp(own[0] * _LN, own[1] * _LN) / _LN - np.log10(2.0)),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    dealt = rows.mapInArrow(deal, schema).repartitionById(parts, "part").mapInArrow(answer, schema)
    return dealt.repartitionById(parts, "part").mapInArrow(collect, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
