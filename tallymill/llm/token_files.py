"""Documents as token ids in compressed, checksummed binary files, and back.

A file is a header, the index of its documents, the table of its blocks and their payloads:

    magic "TMTOK001", then unsigned 32-bit: ids per block, documents, blocks; unsigned 64-bit:
    ids; per document: id (signed 64-bit), whether the id is null (8-bit), ids (unsigned
    64-bit); crc32 of all before it; per block: ids, payload bytes, crc32 of the ids as
    little-endian unsigned 32-bit integers (each unsigned 32-bit); payloads (range_coder).

Numbers are little-endian. A file holds whole documents. Files are the rows of a Parquet
table, so that a task that is run again or lost leaves none behind on any store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm.common import crc32_of_ids, small_batches, text_batches, tidy
from tallymill.llm.range_coder import decode, encode
from tallymill.llm.tokens import TextEncoder

MAGIC = b"TMTOK001"
BLOCK = 2048
# Ids after which a file ends with its document; a task's last file may be smaller.
FILE_IDS = 4_000_000
END_ID = 0

FILES = "part int, file int, before long, n_ids long, data binary"


def to_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    payloads = encode(ids, block) if len(ids) else []
    head = MAGIC + struct.pack("<IIIQ", block, len(doc_ids), len(payloads), len(ids))
    head += np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes()
    head += np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes()
    head += np.asarray(counts, dtype="<u8").tobytes()
    starts = range(0, len(ids), block)
    table = [(min(block, len(ids) - s), len(p), crc32_of_ids(ids[s : s + block])) for s, p in zip(starts, payloads, strict=True)]
    return head + struct.pack("<I", zlib.crc32(head)) + np.array(table, dtype="<u4").tobytes() + b"".join(payloads)


def from_bytes(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(ids of the documents, number of ids of each, all ids); a ValueError if any checksum fails."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    _, documents, blocks, total = struct.unpack_from("<IIIQ", data, 8)
    at = 28
    doc_ids = np.frombuffer(data, dtype="<i8", count=documents, offset=at)
    null = np.frombuffer(data, dtype=np.uint8, count=documents, offset=at + 8 * documents)
    counts = np.frombuffer(data, dtype="<u8", count=documents, offset=at + 9 * documents).astype(np.int64)
    at += 17 * documents
    if zlib.crc32(data[:at]) != struct.unpack_from("<I", data, at)[0]:
        raise ValueError("the index of a token file is damaged")
    table = np.frombuffer(data, dtype="<u4", count=3 * blocks, offset=at + 4).reshape(-1, 3).astype(np.int64)
    ends = at + 4 + 12 * blocks + np.cumsum(table[:, 1])
    ids = decode([data[e - n : e] for e, n in zip(ends.tolist(), table[:, 1].tolist(), strict=True)], table[:, 0])
    if len(ids) != total or int(counts.sum()) != total:
        raise ValueError("a token file has lost ids")
    places = np.cumsum(table[:, 0])
    for k, (end, size, crc) in enumerate(zip(places.tolist(), table[:, 0].tolist(), table[:, 2].tolist(), strict=True)):
        if crc32_of_ids(ids[end - size : end]) != crc:
            raise ValueError(f"block {k} of a token file is damaged")
    return [None if n else d for d, n in zip(doc_ids.tolist(), null.tolist(), strict=True)], counts, ids


def _files(path: str, end_id: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = TextEncoder(path), TaskContext.get().partitionId()
        file, before = 0, 0
        doc_ids: list[int | None] = []
        sizes: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            data = to_bytes(doc_ids, np.array(sizes), np.concatenate(parts))
            row = [[part], [file], [before], [held], [data]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], [c.split()[0] for c in FILES.split(", ")])

        for batch in (part for b in batches for part in text_batches(b, most=8_000_000)):
            flat, counts = encoder.encode(batch.column("text"))
            ends = np.cumsum(counts)
            for doc_id, end, count in zip(batch.column("doc_id").to_pylist(), ends.tolist(), counts.tolist(), strict=True):
                doc_ids.append(doc_id)
                sizes.append(count + 1)
                parts += [flat[end - count : end], np.array([end_id], dtype=np.uint32)]
                held += count + 1
                if held >= file_ids:
                    yield out()
                    file, before, held = file + 1, before + held, 0
                    doc_ids, sizes, parts = [], [], []
        if doc_ids:
            yield out()

    return run


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> None:
    """Write all rows of `docs` (doc_id, text, any other columns) to token files at `path`, in
    ascending order of doc_id (null first) over all files. `tokenizer` is the path of a
    tokenizer file, with fewer than 65,536 ids, on every machine; `end_id` ends a document.

    - A null or empty text has the end id only. Rows with the same id are all written, in the
      order of a hash of their texts. An empty table gives a folder without files.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    with small_batches(docs.sparkSession, 2500):
        rows.mapInArrow(tidy(_files(tokenizer, end_id, file_ids)), FILES).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, start in enumerate(batch.column("start").to_pylist()):
            doc_ids, counts, ids = from_bytes(batch.column("data")[row].as_py())
            ends = np.cumsum(counts)
            raw = np.ascontiguousarray(ids, dtype="<u4").tobytes()
            for k in range(0, len(doc_ids), 256):
                span = slice(k, k + 256)
                held = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends[span].tolist(), counts[span].tolist(), strict=True)]
                columns = [pa.array(doc_ids[span], pa.int64()), pa.array(start + ends[span] - counts[span]), pa.array(counts[span]), pa.array(held, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document in the files at `path`: how many ids
    all documents before it have, and its ids as little-endian unsigned 32-bit integers.
    Every checksum is checked."""
    files = spark.read.schema(FILES).parquet(path)
    # One row per task that wrote.
    sizes = {r.part: r.n for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(sizes):
        starts.append((part, total))
        total += sizes[part]
    before = spark.createDataFrame(starts, "part int, offset long")
    placed = files.join(F.broadcast(before), "part").select((F.col("offset") + F.col("before")).alias("start"), "data")
    return placed.mapInArrow(tidy(_documents), "doc_id long, start long, n_tokens long, ids binary")
