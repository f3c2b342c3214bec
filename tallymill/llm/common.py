"""What several operators of this folder need: stored steps, joins with hot keys, words of a batch of texts."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill import session

# Keys of a join that are sent to every task, so that their rows stay where they are.
HOT_KEYS = 1000
# Characters that separate words: space, and tab to carriage return.
BLANKS = (0x20, *range(0x09, 0x0E))
# Text that one step of a Python task works on at a time, unless one text is longer.
SLICE_BYTES = 1_000_000
# Bits of a filter of hashes: 1 MB at any size; and of one row of bitmap_construct_agg.
FILTER_BITS = 1 << 23
BITMAP_BITS = 32768
# Rows of an Arrow batch between Spark and its Python workers. Texts are long, and both
# sides hold whole batches.
BATCH_ROWS = 500


def bitmap(hashes: DataFrame, column: str) -> DataFrame:
    """Rows (part, bits), FILTER_BITS bits in all whatever the number of hashes: a bit is set
    for each value of `column` (64-bit hashes)."""
    bit = F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1).cast("long")) + 1
    parts = hashes.select(F.bitmap_bucket_number(bit).alias("part"), F.bitmap_bit_position(bit).alias("bit"))
    return parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))


def may_be_in(rows: DataFrame, held: DataFrame, value: Column) -> DataFrame:
    """The `rows` whose `value` (a 64-bit hash) has its bit set in a `bitmap`, which is
    broadcast; others are certainly not among its hashes."""
    place = value.bitwiseAND(F.lit(FILTER_BITS - 1).cast("long"))
    found = rows.join(F.broadcast(held), F.floor(place / BITMAP_BITS) + 1 == held["part"])
    byte = F.substring(found["bits"], (place % BITMAP_BITS / 8).cast("int") + 1, F.lit(1))
    number = F.conv(F.hex(byte), 16, 10).cast("int")
    return found.filter(F.getbit(number, (place % 8).cast("int")) == 1).drop("part", "bits")


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Jobs started inside send at most `rows` rows per Arrow batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before) if int(before) > 0 else rows)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a Python task, which gives its memory back to the system at its end: a
    worker lives on for the tasks of other jobs, beside an executor that needs the memory."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        # Where the C library keeps what was freed (glibc).
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return tidied


def stored(df: DataFrame, name: str = "table", rows: int = BATCH_ROWS) -> DataFrame:
    """`df` written to the shared folder and read back, made in small batches."""
    with small_batches(df.sparkSession, rows):
        return session.stored(df, name)


def hot_join(rows: DataFrame, table: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """Join `rows` with `table`, which has one row per `key`, on a key without nulls.

    The HOT_KEYS keys with the largest `weight` (a column of `table`: how many rows have
    the key) are joined by broadcast, at most HOT_KEYS rows; so no other key has more than
    a thousandth of the rows, and the shuffle for those is even. `how`: inner or left.
    """
    hot = table.orderBy(F.desc(weight), key).limit(HOT_KEYS)
    names = F.broadcast(hot.select(key))
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(names, key, "left_anti").join(table.join(names, key, "left_anti"), key, how)
    return near.unionByName(far)


def text_batches(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of `batch` with about `most` bytes of text each, or one longer text."""
    sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    group = (np.cumsum(sizes) - sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for start, end in zip(edges, edges[1:], strict=False):
        if end > start:
            yield batch.slice(start, end - start)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hashes_of(data: np.ndarray, kinds: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words in `data`, which ends with a blank."""
    inside = ~blank[data]
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    # Polynomial over the bytes of each word: sum of kind * odd ** (place in the word).
    lengths = np.flatnonzero(~inside & before) - starts
    powers = np.full(int(lengths.max()), 0x2545F4914F6CDD1D, dtype=np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    hashes = np.add.reduceat(kinds[data[inside]] * powers[place], first)
    return mixed(hashes + lengths.astype(np.uint64)), starts


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z lower-cased if `lower`, and the number
    of words before each text (with the total at the end). The same word has the same hash
    in any task. Long texts are worked on in parts, cut at blanks."""
    kinds = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if lower:
        kinds[ord("A") : ord("Z") + 1] = kinds[ord("a") : ord("z") + 1]
    blank = np.zeros(256, dtype=bool)
    blank[list(BLANKS)] = True
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(at + SLICE_BYTES, len(data))
        while not blank[data[end - 1]]:
            end += 1
        found, places = _hashes_of(data[at:end], kinds, blank)
        hashes.append(found)
        starts.append(places + at)
        at = end
    return np.concatenate(hashes), np.concatenate(([0], np.searchsorted(np.concatenate(starts), ends)))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words of one text. A text with fewer words, but one at
    least, has one hash for all of them."""
    size = min(size, len(words)) or 1
    total = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k]
    return mixed(total + np.uint64(size))


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def key_hash(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % modulus


def crc32_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
