"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import BITMAP_BITS, FILTER_BITS, bitmap, hot_join, mixed, stored, text_batches, tidy, word_hashes

# Words of the shortest tile, and the share of an item's words that tiles must cover.
MIN_TILE = 5
COVERAGE = 0.5

SEEDS = "key long, text_hash long, n_words long, seed long, place int"


def normal(text: str | None) -> bytes:
    """Lower case, ASCII punctuation as blanks."""
    apart = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
    return (text or "").lower().encode().translate(apart)


def _seeds(size: int, held: np.ndarray | None):
    """Rolling (Karp-Rabin) hashes of `size` words at each place of a text, if the filter `held` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in text_batches(b)):
            words, starts = word_hashes([normal(t) for t in batch.column("text").to_pylist()])
            counts = np.diff(starts)
            n = max(0, len(words) - size + 1)
            total = np.zeros(n, dtype=np.uint64)
            for k in range(size):
                total = total * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
            seeds = mixed(total)
            row = np.repeat(np.arange(len(counts)), counts)[:n]
            good = np.arange(n) + size <= starts[1:][row]
            if held is not None:
                bit = (seeds % np.uint64(FILTER_BITS)).astype(np.int64)
                good &= (held[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            at = np.flatnonzero(good)
            row = row[at]
            columns = [batch.column(c).take(pa.array(row)) for c in ("key", "text_hash")]
            rest = [pa.array(counts[row]), pa.array(seeds[at].view(np.int64)), pa.array((at - starts[row]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, *rest], ["key", "text_hash", "n_words", "seed", "place"])

    return run


def seeds(texts: DataFrame, key: str, size: int, held: np.ndarray | None = None) -> DataFrame:
    rows = texts.select(F.col(key).cast("long").alias("key"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(tidy(_seeds(size, held)), SEEDS)


def seed_filter(found: DataFrame) -> np.ndarray:
    """Bitmap of the seeds, FILTER_BITS / 8 bytes whatever their number."""
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for part, bits in bitmap(found, "seed").collect():
        start = (part - 1) * BITMAP_BITS // 8
        out[start : start + BITMAP_BITS // 8] = np.frombuffer(bits, dtype=np.uint8)
    return out


def tiles(matches: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """(length, place in the document, place in the item) of the tiles: again and again the
    longest match that no earlier tile overlaps, the first in both texts of equal ones.
    `matches` are the places of equal seeds of `size` words."""
    present = set(matches)
    heap = []
    for d, i in present:
        if (d - 1, i - 1) not in present:
            length = size
            while (d + length - size + 1, i + length - size + 1) in present:
                length += 1
            heap.append((-length, d, i))
    heapq.heapify(heap)
    marked_d, marked_i, found = set(), set(), []
    while heap:
        length, d, i = heapq.heappop(heap)
        free = [k for k in range(-length) if d + k not in marked_d and i + k not in marked_i]
        if len(free) == -length:
            found.append((-length, d, i))
            marked_d.update(range(d, d - length))
            marked_i.update(range(i, i - length))
            continue
        start = 0
        for k in range(1, len(free) + 1):
            if k == len(free) or free[k] != free[k - 1] + 1:
                if k - start >= size:
                    heapq.heappush(heap, (start - k, d + free[start], i + free[start]))
                start = k
    return found


def _tiled(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tiles([(m["d"], m["i"]) for m in row], size) for row in batch.column("matches").to_pylist()]
            columns = [batch.column(c) for c in ("doc_id", "text_hash", "item_id", "n_words")]
            covered = pa.array([sum(t[0] for t in x) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in found], pa.int64()), covered], ["doc_id", "text_hash", "item_id", "n_words", "n_tiles", "n_covered"])

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, text_hash, item_id, n_words, n_tiles, n_covered, coverage) of each document
    and benchmark item whose tiles cover `coverage` or more of the item's words.

    Words are compared without case and ASCII punctuation. The benchmark's seeds (hashes of
    `min_tile` words at each place) go into a bitmap of fixed size, by which each task drops
    seeds that no item has. The others are joined with the benchmark on the seed; the places
    that a document and an item share, without any text, then give the tiles, so reordered
    passages count as much as whole ones. Pairs whose seeds can't cover enough aren't tiled.

    - Null and empty texts, and items of fewer than `min_tile` words, match nothing.
    - Repeated items count once; rows of one id with other texts are told apart by
      text_hash; equal rows give one row. Null ids match like others.
    - Empty tables give an empty table.
    """
    items = stored(seeds(benchmark.select("item_id", "text").distinct(), "item_id", min_tile), "item-seeds")
    found = stored(seeds(docs.select("doc_id", "text"), "doc_id", min_tile, seed_filter(items)).distinct(), "seeds")
    held = F.struct(F.col("key").alias("item_id"), F.col("text_hash").alias("item_hash"), "n_words", F.col("place").alias("i"))
    index = items.groupBy("seed").agg(F.collect_list(held).alias("held")).join(found.groupBy("seed").agg(F.count("*").alias("n")), "seed")
    pairs = hot_join(found.select("seed", "key", "text_hash", "place"), stored(index, "seed-index"), "seed", "n")
    pairs = pairs.select(F.col("key").alias("doc_id"), "text_hash", F.col("place").alias("d"), F.inline("held"))
    groups = pairs.groupBy("doc_id", "text_hash", "item_id", "item_hash", "n_words").agg(F.collect_list(F.struct("d", "i")).alias("matches"))
    reach = F.array_distinct(F.flatten(F.transform("matches.i", lambda i: F.sequence(i, i + (min_tile - 1)))))
    likely = groups.filter(F.array_size(reach) >= coverage * F.col("n_words"))
    columns = "doc_id long, text_hash long, item_id long, n_words long, n_tiles long, n_covered long"
    tiled = likely.select("doc_id", "text_hash", "item_id", "n_words", "matches").mapInArrow(tidy(_tiled(min_tile)), columns)
    tiled = stored(tiled, "tiles")
    share = F.col("n_covered") / F.col("n_words")
    return tiled.withColumn("coverage", share).filter(F.col("coverage") >= coverage)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """The rows of `docs` whose text has no such overlap with any item."""
    found = stored(overlaps(docs, benchmark, min_tile, coverage).select(F.col("doc_id").alias("_id"), "text_hash").distinct(), "contaminated")
    same = docs["doc_id"].cast("long").eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["text_hash"])
    return docs.join(found, same, "left_anti")
