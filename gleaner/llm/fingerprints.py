"""Document fingerprints: canonical exact digests (operator 4).

A text is made canonical (NFKC, case fold, white space folded to one space) and digested by 128-bit xxhash. Equal
digests are grouped, and inside a group the canonical bytes themselves are compared. The fingerprint string carries,
after the digest, digests of the pieces of the canonical text between fixed, geometrically growing places; two
fingerprints are alike as far as their pieces are equal.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import bitmap, shuffle_width, stash

#: Ends of the pieces, in code points of the canonical text: each piece is about a sixth of what precedes it.
FIRST, GROWTH = 24, 1.16
#: Most slices of the range of ids, when a document is brought together with the next.
MOST_SLICES = 4096

_SPACE = re.compile(r"\s+")
_ASCII_SPACE = re.compile(r"[\x1c-\x20\t-\r]+")


def canonical(text: str | None) -> str:
    """NFKC, full case folding, NFKC again (folding can denormalise), runs of Unicode white space to one space, trimmed."""
    text = text or ""
    if text.isascii():
        return _ASCII_SPACE.sub(" ", text.lower()).strip()
    return _SPACE.sub(" ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())).strip()


def _ends(n: int) -> list[int]:
    ends, at, step = [], FIRST, float(FIRST)
    while at < n:
        ends.append(at)
        step = max(step, at * (GROWTH - 1))
        at = int(at + step)
    return [*ends, n]


def digest(canon: str) -> str:
    """Wide digest of canonical text: 32 hex digits."""
    import xxhash

    return xxhash.xxh3_128_hexdigest(canon.encode("utf-8", "surrogatepass"))


def fingerprint(text: str | None) -> str:
    """``digest:length:pieces`` with six hex digits a piece."""
    import xxhash

    canon = canonical(text)
    ends = _ends(len(canon))
    pieces = (xxhash.xxh3_64_hexdigest(canon[a:b].encode("utf-8", "surrogatepass"))[:6] for a, b in zip([0, *ends], ends))
    return f"{digest(canon)}:{len(canon)}:{''.join(pieces)}"


def likeness(a: str, b: str) -> float:
    """1 for equal digests; else the share of the longer text that lies in equal pieces (below 1)."""
    (da, na, pa_), (db, nb, pb) = a.split(":"), b.split(":")
    if da == db:
        return 1.0
    na, nb = int(na), int(nb)
    if not na or not nb:
        return 0.0
    begin, same = 0, 0
    for k, (x, y) in enumerate(zip(_ends(na), _ends(nb))):
        if x == y and pa_[6 * k : 6 * k + 6] == pb[6 * k : 6 * k + 6]:
            same += x - begin
        begin = min(x, y)
    return min(same / max(na, nb), 1.0 - 1e-9)


# --- exact duplicates --------------------------------------------------------


def canonical_digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest for every row of ``docs`` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            marks = [digest(canonical(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string())], ["doc_id", "digest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, digest string")


def _canonical_bytes(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """doc_id, digest, canon of the rows whose digest is in ``digests``.

    A bitmap of fixed size (4 MB) passes over most other texts before anything is shuffled; the semi-join is exact.
    """
    bits = bitmap(digests, F.conv(F.substring("digest", 1, 7), 16, 10).cast("long"))

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mark = digest(canon := canonical(text))
                at = int(mark[:7], 16) % (8 * len(bits))
                if bits[at >> 3] >> (at & 7) & 1:
                    rows.append((doc_id, mark, canon))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (batch.column(0).type, pa.string(), pa.string()))], ["doc_id", "digest", "canon"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, digest string, canon string")


def exact_duplicates(docs: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, group_id, n_copies: texts whose canonical bytes are equal share the smallest doc_id.

    Buckets of equal digest are compared by their bytes without gathering them: a bucket is one group exactly if its
    least and greatest canonical texts are equal, and both combine before the shuffle. Only buckets in which they
    differ are grouped by the text itself. Null texts count as empty; a null doc_id never names a group; a text that
    stands alone is a group of one. ``marks``: the digests, if a table of them is at hand.
    """
    marks = stash(canonical_digests(docs), "digests") if marks is None else marks
    buckets = marks.groupBy("digest").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("n_copies"))
    shared = stash(buckets.filter("n_copies > 1"), "buckets")
    canon = _canonical_bytes(docs, shared)
    uneven = canon.groupBy("digest").agg(F.min("canon").alias("least"), F.max("canon").alias("most")).filter("least <> most")
    uneven = stash(uneven.join(shared, "digest", "left_semi").select("digest"), "collisions")
    if uneven.isEmpty():
        found = marks.join(shared, "digest", "left")
    else:
        mixed = stash(canon.join(uneven, "digest", "left_semi"), "collided")
        by_text = mixed.groupBy("digest", "canon").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("n_copies"))
        found = marks.join(uneven, "digest", "left_anti").join(shared, "digest", "left").unionByName(mixed.join(by_text, ["digest", "canon"]).drop("canon"))
    return found.select("doc_id", "digest", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


# --- fingerprints of texts, of edited texts, and their likeness ----------------


def _bounds(docs: DataFrame, slices: int) -> list:
    """First ids of at most ``slices`` runs of about equal numbers of ids: only these few reach the driver.

    The bounds are ids that occur. They steer balance alone; any would give the same result. Ids that have no quantiles,
    such as strings, are drawn by their hash.
    """
    if not isinstance(docs.schema["doc_id"].dataType, NumericType):
        least, n = docs.agg(F.min("doc_id"), F.count("doc_id")).first()
        share = min(1.0, 16 * slices / max(1, n))
        ids = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).groupBy("doc_id").count()
        drawn = sorted(r["doc_id"] for r in ids.filter("doc_id IS NOT NULL").collect())
        return sorted({m for m in (least, *drawn[:: max(1, len(drawn) // slices)]) if m is not None})
    marks = docs.agg(F.min("doc_id"), F.percentile_approx("doc_id", [i / slices for i in range(1, slices)], 20_000)).first()
    return sorted({m for m in (marks[0], *(marks[1] or [])) if m is not None})


def edited_fingerprints(docs: DataFrame, slices: int | None = None) -> DataFrame:
    """The edit test: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are ranged by id, so that a document meets its successor in one partition; the first document of the
    next range comes along as a guest. The texts move once, compressed. Null texts are empty; a null id stands first;
    rows that repeat an id follow one another in order of their packed texts, which is the same in every run. One row alone is its own successor; an empty
    table gives an empty result.
    """
    import zstandard

    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    width = shuffle_width(docs.sparkSession)
    firsts = _bounds(docs, slices or min(MOST_SLICES, 2 * width))
    # the first document of each slice visits the slice before it; the very first visits the last
    visits = {first: (i - 1) % len(firsts) for i, first in enumerate(firsts)}

    def pack(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids, packed, slice_, guest = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = packer.compress((text or "").encode("utf-8", "surrogatepass"))
                homes = [(0 if doc_id is None else max(0, bisect_right(firsts, doc_id) - 1), False)]
                for home, visitor in homes + ([(visits[doc_id], True)] if doc_id in visits else []):
                    ids.append(doc_id)
                    packed.append(data)
                    slice_.append(home)
                    guest.append(visitor)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(packed, pa.binary()), pa.array(slice_, pa.int32()), pa.array(guest, pa.bool_())], ["doc_id", "packed", "slice", "guest"])

    packed = docs.mapInArrow(pack, f"doc_id {kind}, packed binary, slice int, guest boolean")
    dealt = packed.repartition(max(1, min(len(firsts), width)), "slice").sortWithinPartitions("slice", "guest", F.col("doc_id").asc_nulls_first(), "packed")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compare(doc_id, text, next_text, mark, next_mark):
        k = len(text) // 4
        edited = text[: len(text) - k] + next_text[:k]
        edited_mark = mark if edited == text else fingerprint(edited)
        return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark, edited_mark, likeness(mark, edited_mark), likeness(mark, next_mark)

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        held = None  # slice, doc_id, text, mark, guest
        types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            rows, types[0] = [], batch.column(0).type
            for doc_id, data, piece, guest in zip(*(batch.column(i).to_pylist() for i in range(4))):
                text = unpack.decompress(data).decode("utf-8", "surrogatepass") if data else ""
                mark = fingerprint(text)
                if held and held[0] == piece and not (held[4] and guest):
                    rows.append(compare(*held[1:3], text, held[3], mark))
                held = None if guest else (piece, doc_id, text, mark, guest)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names)

    return dealt.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
