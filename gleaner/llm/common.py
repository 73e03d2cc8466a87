"""Helpers shared by the training-data operators.

Two kinds live here: column expressions for the JVM side, and vectorised
tokenisation of Arrow text for operators that run Python on the executors.
"""

from __future__ import annotations

import ctypes
import functools
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_ALNUM = np.ones(256, bool)
_ALNUM[0x00:0x30] = False
_ALNUM[0x3A:0x61] = False
_ALNUM[0x7B:0x80] = False
_SPACED = np.ones(256, bool)
_SPACED[[0x20, *range(0x09, 0x0E)]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
#: Text handled at once by a Python worker, in bytes: bounds its memory whatever the Arrow batch holds.
CHUNK_BYTES = 3 << 20


# --- JVM side ---------------------------------------------------------------


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII takes the fast built-in, which does the same there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def alnum_words(text: Column) -> Column:
    """Lower-cased words of letters and digits. Splitting is linear; regexp_extract_all copies the text at each match."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def count_words(text: Column) -> Column:
    """Number of words between ASCII white space (null: 0)."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


# --- tables in the folder that all executors share ---------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. In local mode one is made where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stash(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/gleaner/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bitmap(df: DataFrame, number: Column, bits: int = 1 << 25) -> bytes:
    """Bits set at ``number`` mod ``bits`` for all rows: at most ``bits`` / 8 bytes reach the driver, whatever the input.

    Bit k is bit k % 8 of byte k // 8. A set bit may be another number's; a clear bit is certain.
    """
    at = F.pmod(number, F.lit(bits)) + 1  # Spark's bitmaps count from 1
    found = df.filter(number.isNotNull()).groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("set")).collect()
    out, width = bytearray(bits // 8 + 4096), 4096
    for row in found:
        start = (row["bucket"] - 1) * width
        out[start : start + width] = row["set"]
    return bytes(out[: bits // 8])


# --- Arrow side --------------------------------------------------------------


def text_chunks(batches, text: str = "text", limit: int = CHUNK_BYTES):
    """Cut Arrow batches into row slices of at most ``limit`` bytes of text (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(offsets_of(batch.column(batch.schema.get_field_index(text)))[0])
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start, batch.num_rows - start)


def give_back() -> None:
    """Return memory that Arrow and the C library keep after use to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run):
    """``run`` of mapInArrow, whose worker gives back memory at the end of a task: workers live on, idle, while the JVM beside
    them runs other stages."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def offsets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets, bytes) of a string array; a null is an empty text."""
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def split_words(texts: pa.Array, alnum: bool = False) -> tuple[np.ndarray, pa.Array]:
    """(words per text, all words in order as binary), A-Z lower-cased; white space or ``alnum`` separation."""
    offsets, data = offsets_of(texts)
    data = _FOLD[data]
    inside = (_ALNUM if alnum else _SPACED)[data]
    if not inside.any():
        return np.zeros(len(texts), np.int64), pa.array([], pa.large_binary())
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    before = np.concatenate(([0], np.cumsum(inside)))
    kept = data[inside]
    cuts = np.concatenate((before[starts], [len(kept)])).astype(np.int64)
    counts = np.diff(np.searchsorted(starts, offsets, side="left"))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(kept))])
    return counts, words


def hash_words(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(64-bit hash of every word, the distinct words): each distinct word is hashed once."""
    import xxhash

    coded = words.dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return table[coded.indices.to_numpy()], coded.dictionary


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the usual multiply-xorshift one)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def ceil_share(n: int, share: float) -> int:
    return math.ceil(n * share - 1e-9)
