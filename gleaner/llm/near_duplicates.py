"""N-gram Jaccard join with prefix trees (operator 2).

Word shingles are ordered globally by document frequency. Frequencies come from one exchange of packed shingles, dealt by
hash: a set whose shingles nobody shares in sufficient number drops out at once, and of the others only the rarest shared
shingles, the prefix that any partner must touch, tie sets into clusters. In a cluster the ordered sets form a trie; a
probe descends it, sharing the overlap of common beginnings, and leaves subtrees that can no longer reach the bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, lean, mix64, shuffle_width, split_words, stash, text_chunks
from .components import components

WORDS = 5
#: Similarity as a fraction: 100 * intersection >= 80 * union.
ABOVE, BELOW = 80, 100
#: Bits of a shingle's hash that are kept in the exchange.
KEPT = np.uint64(16)
#: Shingles that a worker packs at once.
PACKED = 1_500_000
#: Sets of one trie; a larger cluster is joined block by block.
TRIE = 4000
_K = np.uint64(0x9E3779B97F4A7C15)
_TOKEN = np.uint64((1 << 48) - 1)


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text of each shingle, its 64-bit hash): distinct within a text and sorted; a shorter text is one shingle."""
    counts, tokens = split_words(texts)
    if not len(tokens):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashed, _ = hash_words(tokens)
    of = np.repeat(np.arange(len(counts)), counts)
    n = len(hashed) - words + 1
    if n > 0:
        rolled = hashed[:n].copy()
        for k in range(1, words):
            rolled = rolled * _K + hashed[k : n + k]
        whole = of[:n] == of[words - 1 :]
        doc, value = of[:n][whole], mix64(rolled[whole])
    else:
        doc, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        ends = np.cumsum(counts)
        extra = []
        for i in short.tolist():
            x = np.uint64(counts[i])
            with np.errstate(over="ignore"):
                for h in hashed[ends[i] - counts[i] : ends[i]]:
                    x = x * _K + h
            extra.append(x)
        doc, value = np.concatenate((doc, short)), np.concatenate((value, mix64(np.array(extra, np.uint64) ^ _K)))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


#: Shingles of the smallest set that can be similar to another one: smaller sets only equal each other, and travel no further.
LEAST = next(n for n in range(1, BELOW + 1) if BELOW * n >= ABOVE * (n + 1))


def need(n):
    """Least intersection that a set of n shingles has with any partner."""
    return -(-ABOVE * n // BELOW)


# --- packed rows -----------------------------------------------------------------


def _join(*arrays: np.ndarray) -> bytes:
    """Arrays in one binary: number of each, type of each, then the data."""
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()
    kinds = b"".join(a.dtype.str.encode().ljust(4) for a in arrays)
    return head + kinds + b"".join(a.tobytes() for a in arrays)


def _part(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, n, 8).tolist()
    at, out = 8 + 8 * n + 4 * n, []
    for i, size in enumerate(sizes):
        kind = np.dtype(bytes(data[8 + 8 * n + 4 * i : 12 + 8 * n + 4 * i]).decode().strip())
        out.append(np.frombuffer(data, kind, size, at))
        at += size * kind.itemsize
    return out


def _squeeze(*arrays: np.ndarray) -> bytes:
    """As _join, with the bytes of equal weight side by side and compressed: high bytes of small numbers cost little."""
    import zstandard

    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).ravel() if len(a) else np.zeros(0, np.uint8) for a in arrays]
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()
    kinds = b"".join(a.dtype.str.encode().ljust(4) for a in arrays)
    return head + kinds + zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes).tobytes())


def _spread(data: bytes) -> list[np.ndarray]:
    import zstandard

    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, n, 8).tolist()
    head = 8 + 12 * n
    flat, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[head:]), np.uint8), 0, []
    for i, size in enumerate(sizes):
        kind = np.dtype(data[8 + 8 * n + 4 * i : 12 + 8 * n + 4 * i].decode().strip())
        out.append(np.ascontiguousarray(flat[at : at + size * kind.itemsize].reshape(kind.itemsize, size).T).ravel().view(kind))
        at += size * kind.itemsize
    return out


def _small(x: np.ndarray) -> np.ndarray:
    top = int(x.max(initial=0))
    return x.astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _pack_tokens(tokens: np.ndarray, sets: np.ndarray, keys: np.ndarray) -> bytes:
    """Sorted tokens as differences, with the number of each one's set in a table of the sets that occur."""
    used, local = np.unique(sets, return_inverse=True)
    return _squeeze(tokens[:1], _small(np.diff(tokens)), _small(local), keys[used])


_EXCHANGE = "part int, payload binary, doc_id {kind}, n long, key long"


def _deal(docs: DataFrame, parts: int) -> DataFrame:
    """Rows of three kinds: a document (doc_id, n, key of its set; no payload), packed shingles for a part, and, marked by
    an n of -1, packed sizes of sets for the part of their key. Documents are dealt evenly, whatever their set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    @lean
    def run(batches):
        import xxhash
        from pyspark import TaskContext

        seen: set[int] = set()
        tokens: list[np.ndarray] = []
        sets: list[np.ndarray] = []
        keys: list[int] = []
        sizes: list[int] = []
        ids = None

        def flush():
            if not tokens:
                return None
            token, own = np.concatenate(tokens), np.concatenate(sets)
            order = np.argsort(token, kind="stable")
            token, own = token[order], own[order]
            table = np.array(keys, np.uint64)
            # the parts cut the range of hashes evenly
            part = ((token >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(64 - 16 - int(KEPT))
            cuts = np.searchsorted(part, np.arange(parts + 1))
            rows = [(p, _pack_tokens(token[a:b], own[a:b], table), None) for p, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if b > a]
            home, many = table % np.uint64(parts), np.array(sizes, np.int64)
            order = np.argsort(home, kind="stable")
            cuts = np.searchsorted(home[order], np.arange(parts + 1))
            rows += [(p, _squeeze(table[order[a:b]], _small(many[order[a:b]])), -1) for p, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if b > a]
            for held in (tokens, sets, keys, sizes):
                held.clear()
            none = [None] * len(rows)
            return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in rows], pa.int32()), pa.array([d for _, d, _ in rows], pa.binary()), pa.array(none, ids), pa.array([m for _, _, m in rows], pa.int64()), pa.array(none, pa.int64())], names)

        names, pending, dealt = ["part", "payload", "doc_id", "n", "key"], 0, TaskContext.get().partitionId()
        for chunk in text_chunks(batches):
            ids = chunk.column(0).type
            doc, value = shingles(chunk.column(1))
            n = np.bincount(doc, minlength=chunk.num_rows)
            ends = np.cumsum(n)
            marks: list[int | None] = []
            for i, (end, size) in enumerate(zip(ends.tolist(), n.tolist())):
                if not size:
                    marks.append(None)
                    continue
                mark = xxhash.xxh3_64_intdigest(value[end - size : end].tobytes())
                marks.append(mark)
                if size >= LEAST and mark not in seen:
                    seen.add(mark)
                    sizes.append(size)
                    tokens.append(value[end - size : end] >> KEPT)
                    sets.append(np.full(size, len(keys), np.int64))
                    keys.append(mark)
                    pending += size
            signed = [None if m is None else m - (1 << 64) if m >> 63 else m for m in marks]
            home = [(dealt + i) % parts for i in range(len(marks))]
            dealt += len(marks)
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), pa.array([None] * len(home), pa.binary()), chunk.column(0), pa.array(n.astype(np.int64)), pa.array(signed, pa.int64())], names)
            if pending >= PACKED:
                yield flush()
                pending = 0
        if (last := flush()) is not None:
            yield last

    return docs.select("doc_id", "text").mapInArrow(run, _EXCHANGE.format(kind=kind))


def _split_rows(batches, names: list[str]):
    """(documents and sizes to pass on, packed shingles, packed sizes) of each batch."""
    for batch in batches:
        payload, marks = batch.column(1).to_pylist(), batch.column(3).to_pylist()
        on = pa.array([p is None or m == -1 for p, m in zip(payload, marks)], pa.bool_())
        rest = pa.RecordBatch.from_arrays([c.filter(on) for c in batch.columns], names)
        yield rest, [p for p, m in zip(payload, marks) if p is not None and m != -1], [p for p, m in zip(payload, marks) if p is not None and m == -1]


def _frequencies(dealt: DataFrame, parts: int, kind: str) -> DataFrame:
    """Within a part all sets that hold a token meet: its frequency is known. Shared tokens go to the part of their set."""

    @lean
    def run(batches):
        from pyspark import TaskContext

        names, held, here = ["part", "payload", "doc_id", "n", "key"], [], TaskContext.get().partitionId()
        for rest, payloads, _ in _split_rows(batches, names):
            held += payloads
            ids = rest.column(2).type
            if rest.num_rows:
                yield rest
        if not held:
            return
        token, key = [], []
        for data in held:
            first, steps, local, keys = _spread(data)
            token.append(np.concatenate((first, first + np.cumsum(steps, dtype=np.uint64))))
            key.append(keys[local])
        held.clear()
        token, key = np.concatenate(token), np.concatenate(key)
        order = np.lexsort((key, token))
        token, key = token[order], key[order]
        once = np.ones(len(token), bool)  # copies that other workers packed are the same set
        once[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        token, key = token[once], key[once]
        starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        times = np.diff(np.append(starts, len(token)))
        # the order of tokens: a step for each sixteenth of a doubling of frequency, then the number within the part
        frequency = np.repeat(np.minimum(255, np.floor(16 * np.log2(times))).astype(np.uint8), times)
        shared = np.repeat(times > 1, times)
        number = np.repeat(np.arange(len(times), dtype=np.uint32), times)
        # what a set has alone follows from its size: only shared tokens travel
        key, number, frequency = key[shared], number[shared], frequency[shared]
        home = (key % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((number, key, home))
        key, number, frequency, home = key[order], number[order], frequency[order], home[order]
        cuts = np.searchsorted(home, np.arange(parts + 1))
        rows = []
        for p, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
            if a == b:
                continue
            begins = np.flatnonzero(np.concatenate(([True], key[a + 1 : b] != key[a : b - 1])))
            n_shared = np.diff(np.append(begins, b - a))
            rows.append((p, _squeeze(np.array([here]), key[a:b][begins], _small(n_shared), number[a:b], frequency[a:b])))
        none = [None] * len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary()), pa.array(none, ids), pa.array(none, pa.int64()), pa.array(none, pa.int64())], names)

    return dealt.repartitionById(parts, "part").mapInArrow(run, _EXCHANGE.format(kind=kind))


def _survivors(counted: DataFrame, parts: int, kind: str) -> DataFrame:
    """Documents, and the sets that can have partners: tokens (shared ones, rarest first) and the prefix among them.

    A partner shares at least need(n) shingles. Sets with too many shingles of their own have none; for the others one
    of the rarest n - need(n) + 1, of which their own shingles are the first, is shared.
    """

    @lean
    def run(batches):
        names, held, told = ["doc_id", "n", "key", "tokens", "prefix"], [], []
        for rest, payloads, sizes in _split_rows(batches, ["part", "payload", "doc_id", "n", "key"]):
            held += payloads
            told += [_spread(s) for s in sizes]
            documents = rest.filter(rest.column(1).is_null())
            ids = documents.column(2).type
            if documents.num_rows:
                none = [None] * documents.num_rows
                yield pa.RecordBatch.from_arrays([documents.column(2), documents.column(3), documents.column(4), pa.array(none, pa.binary()), pa.array(none, pa.list_(pa.int64()))], names)
        if not held:
            return
        pieces = [_spread(d) for d in held]
        held.clear()
        keys, at = np.unique(np.concatenate([p[1] for p in pieces]), return_inverse=True)
        # the sizes of all sets of this part are told; those without shared shingles are not asked for
        n = np.zeros(len(keys), np.int64)
        named, sizes = np.concatenate([k for k, _ in told]), np.concatenate([x for _, x in told]).astype(np.int64)
        place = np.minimum(np.searchsorted(keys, named), len(keys) - 1)
        held_here = keys[place] == named
        n[place[held_here]] = sizes[held_here]
        n_shared = np.concatenate([p[2] for p in pieces]).astype(np.int64)
        # its own n - shared tokens come first in the prefix of n - need(n) + 1
        prefix = np.bincount(at, n_shared, len(keys)).astype(np.int64) - need(n) + 1
        owner = np.repeat(at, n_shared)
        # a token is known by the part that counted it and its number there
        token = np.concatenate([(np.uint64(p[0][0]) << np.uint64(32)) | p[3].astype(np.uint64) for p in pieces])
        frequency = np.concatenate([p[4] for p in pieces])
        keep = prefix[owner] > 0
        owner, token, frequency = owner[keep], token[keep], frequency[keep]
        order = np.lexsort((token, frequency, owner))
        owner, token, frequency = owner[order], token[order], frequency[order]
        # the packed order of a token: frequency, then its number
        packed = (frequency.astype(np.uint64) << np.uint64(48)) | token
        cuts = np.searchsorted(owner, np.arange(len(keys) + 1))
        rows = [(int(keys[i]), int(n[i]), packed[a:b]) for i, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if b > a]
        for s in range(0, len(rows), 2000):
            some = rows[s : s + 2000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None] * len(some), ids),
                    pa.array([r[1] for r in some], pa.int64()),
                    pa.array([r[0] - (1 << 64) if r[0] >> 63 else r[0] for r in some], pa.int64()),
                    pa.array([r[2].tobytes() for r in some], pa.binary()),
                    pa.array([(r[2][: len(r[2]) - need(r[1]) + 1] & _TOKEN).astype(np.int64) for r in some], pa.list_(pa.int64())),
                ],
                names,
            )

    return counted.repartitionById(parts, "part").mapInArrow(run, f"doc_id {kind}, n long, key long, tokens binary, prefix array<long>")


# --- the join in a cluster ---------------------------------------------------------


class Trie:
    """Sets of numbers, each sorted, as a prefix tree in arrays by level: children of a node stand together."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.order, self.sizes = np.array(order, np.int64), sizes[order]
        ordered = [sets[i] for i in order]
        lengths = np.array([len(s) for s in ordered], np.int64)
        flat = np.concatenate([*ordered, np.zeros(0, np.int64)])
        begins = np.cumsum(lengths) - lengths
        # tokens that a row has in common with the row before it
        common = np.full(len(sets), -1, np.int64)
        for i in range(1, len(ordered)):
            n = min(len(ordered[i]), len(ordered[i - 1]))
            apart = np.flatnonzero(ordered[i][:n] != ordered[i - 1][:n])
            common[i] = apart[0] if len(apart) else n
        # a node of level d: rows that agree in d + 1 tokens. Memory is one entry a node, whatever the longest set
        self.levels: list[tuple[np.ndarray, ...]] = []
        for d in range(int(lengths.max(initial=0))):
            starts = np.flatnonzero(common <= d)
            live = lengths[starts] > d
            first, last = starts[live], np.append(starts[1:], len(sets))[live]
            longest = np.maximum.reduceat(lengths, starts)[live]
            smallest = np.minimum.reduceat(self.sizes, starts)[live]
            # rows that end at a node stand first in it
            ending = np.add.reduceat((lengths == d + 1).astype(np.int64), starts)[live]
            self.levels.append((flat[begins[first] + d], first, last, longest, smallest, ending))

    def probe(self, x: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the sets that are similar to the sorted set ``x`` with ``size`` elements in all."""
        found: list[int] = []
        begin = end = shared = None
        for d, (token, first, last, longest, smallest, ending) in enumerate(self.levels):
            if begin is None:
                nodes, shared = np.arange(len(token)), np.zeros(len(token), np.int64)
            else:  # the children of a node lie within its rows
                a, b = np.searchsorted(first, begin), np.searchsorted(first, end)
                n = b - a
                nodes = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
                shared = np.repeat(shared, n)
            if not len(nodes):
                break
            own, upto = np.searchsorted(x, token[nodes]), np.searchsorted(x, token[nodes], side="right")
            shared = shared + (upto > own)
            left = np.minimum(len(x) - upto, longest[nodes] - d - 1)
            # intersection >= t / (1 + t) * (|x| + |y|)
            reach = (ABOVE + BELOW) * (shared + left) >= ABOVE * (size + smallest[nodes])
            nodes, shared = nodes[reach], shared[reach]
            begin, end = first[nodes], last[nodes]
            for i in np.flatnonzero(ending[nodes]).tolist():
                own = slice(begin[i], begin[i] + ending[nodes[i]])
                like = BELOW * shared[i] >= ABOVE * (size + self.sizes[own] - shared[i])
                found += self.order[own][like].tolist()
        return np.array(found, np.int64)


def _numbered(sets: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The sets with tokens numbered from the commonest on, so that like sets share the long beginnings of their paths; counts."""
    tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    return [np.sort(s) for s in np.split(len(tokens) - 1 - at, cuts)], np.bincount(at)[::-1]


def links(keys: list[int], sizes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect the sets of a cluster as all links do: exact, without listing every link.

    The set of commonest tokens is probed first. Its component may stay unprobed, for a link is found from either end;
    every other set is probed against all.
    """
    own, weight = _numbered(sets)
    heavy = int(np.argmax([weight[s].sum() / max(1, len(s)) * min(len(s), 1 << 20) for s in own]))
    trie = Trie(own, np.asarray(sizes, np.int64))
    near = trie.probe(own[heavy], int(sizes[heavy]))
    edges = [(keys[heavy], keys[j]) for j in near.tolist() if j != heavy]
    settled = set(near.tolist()) | {heavy}
    for i in range(len(own)):
        if i not in settled:
            edges += [(keys[i], keys[j]) for j in trie.probe(own[i], int(sizes[i])).tolist() if j != i]
    return _forest(edges)


def links_between(keys: list[int], sizes: np.ndarray, sets: list[np.ndarray], asks: np.ndarray) -> list[tuple[int, int]]:
    """As :func:`links`, for the links that lead from the sets that ask to the others. A set may be on both sides."""
    own, weight = _numbered(sets)
    told = np.flatnonzero(~asks)
    trie = Trie([own[j] for j in told], np.asarray(sizes, np.int64)[told])
    edges = []
    for i in np.flatnonzero(asks).tolist():
        edges += [(keys[i], keys[told[j]]) for j in trie.probe(own[i], int(sizes[i])).tolist()]
    return _forest(edges)


def _forest(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each vertex with the smallest of its component."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(v, find(v)) for v in list(root) if find(v) != v]


def _clusters(sets: DataFrame) -> DataFrame:
    """(key, cluster): sets that a chain of shared prefix tokens connects. Each token ties its sets to the smallest."""
    held = sets.select("key", F.explode("prefix").alias("token"))
    least = held.groupBy("token").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # written: a join that reads an aggregate in place cannot split a hot token's rows
    least = stash(least, "tokens")
    tied = held.join(least, "token").filter("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    found = stash(components(tied), "clusters")
    roots = found.select(F.col("root").alias("key")).distinct()
    return found.select(F.col("id").alias("key"), F.col("root").alias("cluster")).unionByName(roots.select("key", F.col("key").alias("cluster")))


def _by_pivot(placed: DataFrame, large: DataFrame) -> DataFrame:
    """(cluster, key, n, tokens, pivot, near): the sets of large clusters, and whether they link to their cluster's pivot.

    Rows are dealt by block and stream past a copy of the pivot that stands first in each.
    """

    @lean
    def run(batches):
        place, pivot = None, (0, np.zeros(0, np.uint64))
        for batch in batches:
            near, keep = [], []
            for c, i, role, n, tokens in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5))):
                own = np.frombuffer(tokens, np.uint64)
                if (c, i) != place:
                    place, pivot = (c, i), (n, own)
                shared = np.isin(own, pivot[1], assume_unique=True).sum()
                near.append(bool((ABOVE + BELOW) * shared >= ABOVE * (n + pivot[0])))
                keep.append(role == 1)
            out = pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 3, 4, 5, 6)), pa.array(near, pa.bool_())], ["cluster", "key", "n", "tokens", "pivot", "near"])
            yield out.filter(pa.array(keep, pa.bool_()))

    rows = placed.join(large, "cluster").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("role", F.lit(1))
    first = rows.filter("key = pivot").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("role", F.lit(0))
    names = ["cluster", "block", "role", "key", "n", "tokens", "pivot"]
    dealt = first.select(*names).unionByName(rows.select(*names)).repartition(shuffle_width(placed.sparkSession), "cluster", "block")
    return dealt.sortWithinPartitions("cluster", "block", "role").mapInArrow(run, "cluster long, key long, n long, tokens binary, pivot long, near boolean")


def _blocks(placed: DataFrame, trie: int) -> tuple[DataFrame, DataFrame | None]:
    """(cluster, i, j, key, n, tokens, asks) in groups to join, and edges (a, b) that are already known.

    A cluster of up to ``trie`` sets is one group. In a larger one all sets meet a pivot, the set with the largest share
    of shared shingles. Those that link to it are one component and need not ask, for a link is found from either end;
    blocks of the others ask the blocks of all. So a large group of near copies costs a pass, not its square.
    """
    sizes = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.max_by("key", "share").alias("pivot")).filter(F.col("m") > trie)
    in_blocks = lambda m: F.ceil(F.col(m) / (trie / 2)).cast("int")
    large = stash(sizes.select("cluster", "pivot", in_blocks("m").alias("blocks")), "large-clusters")
    names = ["cluster", "i", "j", "key", "n", "tokens", "asks"]
    small = placed.select("cluster", F.lit(0).alias("i"), F.lit(0).alias("j"), "key", "n", "tokens", F.lit(None).cast("boolean").alias("asks"))
    if large.isEmpty():
        return small.select(*names), None
    judged = stash(_by_pivot(placed, large), "judged")
    asking = judged.filter("NOT near").groupBy("cluster").agg(F.count(F.lit(1)).alias("u"))
    asking = stash(asking.join(large, "cluster").select("cluster", in_blocks("u").alias("askers"), "blocks"), "asking-clusters")
    rows = judged.join(asking, "cluster")
    block = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ask = rows.filter("NOT near").withColumn("i", block("askers")).withColumn("j", every("blocks")).withColumn("asks", F.lit(True))
    told = rows.withColumn("j", block("blocks")).withColumn("i", every("askers")).withColumn("asks", F.lit(False))
    out = small.join(large.select("cluster"), "cluster", "left_anti").select(*names).unionByName(ask.select(*names)).unionByName(told.select(*names))
    return out, judged.filter("near AND key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b"))


def _join_clusters(blocks: DataFrame) -> DataFrame:
    """(a, b) edges of each group of ``blocks``, whose rows arrive together."""

    @lean
    def run(batches):
        place, keys, sizes, sets, asks = None, [], [], [], []

        def settle():
            if len(keys) < 2:
                found = []
            elif asks[0] is None:
                found = links(keys, np.array(sizes), sets)
            else:
                found = links_between(keys, np.array(sizes), sets, np.array(asks, bool))
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for c, i, j, key, n, tokens, ask in zip(*(col.to_pylist() for col in batch.columns)):
                if (c, i, j) != place:
                    if keys:
                        yield settle()
                    place, keys, sizes, sets, asks = (c, i, j), [], [], [], []
                keys.append(key)
                sizes.append(n)
                sets.append(np.frombuffer(tokens, np.uint64))
                asks.append(ask)
        if keys:
            yield settle()

    width = shuffle_width(blocks.sparkSession)
    return blocks.repartition(width, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    Two documents link when 100 * intersection >= 80 * union of their sets of 5-word shingles; the component is the
    smallest doc_id that links lead to. Null, empty and blank texts have no shingles and stand alone. Equal sets are one
    set throughout, so a large group of copies costs one; rows that repeat a doc_id each get a row; a null doc_id never
    names a component while it has company. Other columns are ignored; an empty table gives an empty result. Sets
    are known by 64 bits; shingles by 48 where sets of :data:`LEAST` or more meet, so that a false link takes several false
    shingles at once.
    """
    spark = docs.sparkSession
    kind, parts = docs.schema["doc_id"].dataType.simpleString(), shuffle_width(spark)
    table = stash(_survivors(_frequencies(_deal(docs, parts), parts, kind), parts, kind), "shingle-sets")
    sets = table.filter("tokens IS NOT NULL").select("key", "n", "tokens", "prefix")
    rows = table.filter("tokens IS NULL").select("doc_id", "n", "key")
    # the share of shared shingles is taken before the join, so that a pass over it alone moves no tokens
    placed = sets.select("key", "n", "tokens", (F.octet_length("tokens") / F.col("n")).alias("share")).join(_clusters(sets), "key")
    blocks, known = _blocks(placed, TRIE)
    edges = stash(_join_clusters(blocks), "links")
    edges = edges if known is None else edges.unionByName(known)
    roots = components(edges).select(F.col("id").alias("key"), "root")
    named = rows.join(roots, "key", "left").withColumn("class", F.coalesce("root", "key"))
    named = stash(named.select("doc_id", "n", "class"), "classes")
    least = named.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    least = stash(least.drop("m"), "least")
    return named.join(least, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def oracle() -> str:
    """DuckDB SQL for :func:`near_duplicates`: shingle sets joined on shingles, least ids by reachability."""
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents),
t AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, a, a + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, CAST(len(w) - 3 AS BIGINT)))) AS a FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM t x JOIN t y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT a AS id, a AS root FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.root),
c AS (SELECT id, min(root) AS least FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.least, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id"""
