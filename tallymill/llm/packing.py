"""Documents packed into sequences of a fixed number of tokens by bounded-space best fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import stored, text_batches, tidy
from tallymill.llm.tokens import TextEncoder

SEQUENCE = 2048
END_ID = 0
# Bins a task keeps open, and tasks whose last open bins are packed together in one.
OPEN_BINS = 64
TASKS_TOGETHER = 64

PIECE = "doc_id long, piece int, start long, length long, ids binary"
PACKED = f"{PIECE}, sequence_id long, offset long"


class Packer:
    """Best fit with at most `most` open bins. A bitset has a bit for each free space that an
    open bin has. An item goes to the bin with the least space that holds it; if there is
    none, and no bin may be opened, the fullest closes first."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.bits, self.count = 0, 0
        self.bins: dict[int, list[list]] = {}

    def _take(self, free: int) -> list:
        held = self.bins[free]
        out = held.pop()
        if not held:
            self.bits ^= 1 << free
        self.count -= 1
        return out

    def _lowest(self, bits: int) -> int:
        return (bits & -bits).bit_length() - 1

    def put(self, item, length: int) -> list[list]:
        """Adds (item, offset) to a bin; returns the bins that this closes."""
        closed = []
        fitting = self.bits >> length
        if fitting:
            free = length + self._lowest(fitting)
            chosen = self._take(free)
        else:
            if self.count == self.most:
                closed.append(self._take(self._lowest(self.bits)))
            free, chosen = self.size, []
        chosen.append((item, self.size - free))
        free -= length
        if not free:
            closed.append(chosen)
        else:
            self.bins.setdefault(free, []).append(chosen)
            self.bits |= 1 << free
            self.count += 1
        return closed

    def rest(self) -> list[list]:
        return [b for free in sorted(self.bins) for b in self.bins[free]]


def pieces_of(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: one, or a shorter first and full ones."""
    if length <= size:
        return [(0, length)]
    first = length % size
    return [(0, first)] * bool(first) + [(start, size) for start in range(first, length, size)]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


_NAMES = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset", "full"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
_EMIT = 2000


def _first_round(path: str, size: int, most: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = TextEncoder(path), Packer(size, most)
        base, bins, rows = TaskContext.get().partitionId() << 33, 0, []
        for batch in (part for b in batches for part in text_batches(b, most=4_000_000)):
            flat, counts = encoder.encode(batch.column("text"))
            raw = np.insert(flat, np.cumsum(counts), end_id).astype("<u4").tobytes()
            counts += 1
            begins = np.cumsum(counts) - counts
            for doc_id, begin, count in zip(batch.column("doc_id").to_pylist(), begins.tolist(), counts.tolist(), strict=True):
                for k, (start, length) in enumerate(pieces_of(count, size)):
                    item = (doc_id, k, start, length, raw[4 * (begin + start) : 4 * (begin + start + length)])
                    for closed in packer.put(item, length):
                        rows += [(*piece, base + bins, offset, True) for piece, offset in closed]
                        bins += 1
                if len(rows) > _EMIT:
                    yield _batch(rows, _NAMES, _TYPES)
                    rows = []
        for left in packer.rest():
            rows += [(*piece, base + bins, offset, False) for piece, offset in left]
            bins += 1
        if rows:
            yield _batch(rows, _NAMES, _TYPES)

    return run


def _second_round(size: int, most: int):
    """Packs whole bins, so that the pieces of one stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, places = Packer(size, most), []
        names, types = ["bin", "sequence_id", "shift"], [pa.int64()] * 3

        def place(bins: list[list]) -> None:
            for content in bins:
                places.extend((b, content[0][0], offset) for b, offset in content)

        for batch in batches:
            for b, used in zip(batch.column("bin").to_pylist(), batch.column("used").to_pylist(), strict=True):
                place(packer.put(b, used))
            if places:
                yield _batch(places, names, types)
                places.clear()
        place(packer.rest())
        if places:
            yield _batch(places, names, types)

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, open_bins: int = OPEN_BINS, end_id: int = END_ID) -> DataFrame:
    """Pieces of all rows of `docs` (doc_id, text, any other columns): (doc_id, piece, start,
    length, ids, sequence_id, offset). `ids` has the piece's token ids, little-endian unsigned
    32 bit; `tokenizer` is the path of a tokenizer file on every machine. A document's ids end
    with `end_id`; one with more than `size` ids is cut into pieces of that size, the first
    may be shorter. A sequence has its pieces without gaps from 0 and `size` ids at most.

    Each task packs the documents as they come, with `open_bins` open bins. Those left open
    at its end, a fixed number per task, are packed again as wholes, those of TASKS_TOGETHER
    tasks in one.

    - A null or empty text has one piece with the end id only.
    - Repeated rows are packed each; a null id stays null.
    - An empty table gives an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = stored(rows.mapInArrow(tidy(_first_round(tokenizer, size, open_bins, end_id)), f"{PACKED}, full boolean"), "pieces", 2500)
    left = first.filter("not full")
    used = left.groupBy(F.col("sequence_id").alias("bin")).agg(F.sum("length").alias("used"))
    tasks = max(1, rows.rdd.getNumPartitions() // TASKS_TOGETHER)
    moved = used.coalesce(tasks).mapInArrow(tidy(_second_round(size, open_bins)), "bin long, sequence_id long, shift long")
    moved = stored(moved, "moved-bins").withColumnRenamed("sequence_id", "moved_to")
    again = left.join(moved, left["sequence_id"] == moved["bin"])
    again = again.withColumn("offset", F.col("offset") + F.col("shift")).withColumn("sequence_id", F.col("moved_to"))
    names = [c for c in _NAMES if c != "full"]
    return first.filter("full").select(names).unionByName(again.select(names))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, doc_ids, starts, ids) of each sequence, in order of place; at
    most `size` pieces and ids each."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(pieces.alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"]))
    length = F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["length"])
    return rows.select("sequence_id", length.alias("length"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"), joined.alias("ids"))
