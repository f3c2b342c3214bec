"""Pairs of classes of equal texts, confirmed on their full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import bitmap, hot_join, may_be_in, stored, tidy, utf8

# Pairs that one copy of a text takes part in.
PAIRS_PER_COPY = 200


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def class_of(words: list[bytes]) -> bytes | None:
    """128-bit name of a sequence of words; texts with the same words are one class."""
    return hashlib.md5(b" ".join(words)).digest() if words else None


def shingles(text: bytes, size: int) -> set:
    words = words_of(text)
    return set(zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else {tuple(words)} if words else set()


def row_key(doc_id: Column, text_hash: Column) -> Column:
    return F.xxhash64(doc_id, text_hash)


def _of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = pa.array([class_of(words_of(t)) for t in utf8(batch.column("text"))], pa.binary())
        yield batch.filter(pa.compute.equal(own, batch.column("class").cast(pa.binary())))


def texts_of_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, text) for the `classes` (class, id, text_hash, n), whose text is that of a row of
    `docs` (doc_id, text) with this id and hash; n documents are of the class."""
    wanted = stored(classes.select(row_key(F.col("id"), F.col("text_hash")).alias("row"), "class", "n"), "wanted-texts")
    key = row_key(F.col("doc_id").cast("long"), F.xxhash64("text"))
    # Texts that are certainly not wanted stay out of the shuffle.
    likely = may_be_in(docs.select(key.alias("row"), "text"), stored(bitmap(wanted, "row"), "text-filter"), F.col("row"))
    rows = hot_join(likely, wanted, "row", "n").select("class", "text")
    return stored(rows.mapInArrow(tidy(_of_class), "class binary, text string").dropDuplicates(["class"]), "texts")


def _copies() -> Column:
    return F.ceil(F.col("_n") / PAIRS_PER_COPY)


def dealt(pairs: DataFrame, end: str, other: str) -> tuple[DataFrame, DataFrame]:
    """The pairs with the copy (`<end>_copy`) of the class in column `end` that they meet, and
    the number of pairs of each such class. A class may be in many pairs."""
    counted = stored(pairs.groupBy(end).agg(F.count("*").alias("_n")), "ends")
    copy = F.pmod(F.xxhash64(other), _copies()).alias(f"{end}_copy")
    return hot_join(pairs, counted, end, "_n").select(*pairs.columns, copy), counted


def copies_of(table: DataFrame, counted: DataFrame, end: str) -> DataFrame:
    """The rows of `table` (class, ...) for these classes, once for every PAIRS_PER_COPY pairs."""
    held = counted.join(table.withColumnRenamed("class", end), end)
    return held.withColumn(f"{end}_copy", F.explode(F.sequence(F.lit(0).cast("long"), _copies() - 1))).drop("_n")


def _confirm(size: int, percent: int):
    """Of rows sorted by (b, copy, a): each class `a` beside the text of `b`, which comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: set = set()
        for batch in batches:
            same = []
            for a, text in zip(batch.column("a").to_pylist(), utf8(batch.column("text")), strict=True):
                own = shingles(text, size)
                if a is None:
                    hub = own
                both = len(own & hub) if a is not None else 0
                same.append(a is not None and 100 * both >= percent * (len(own) + len(hub) - both))
            yield batch.filter(pa.array(same, pa.bool_())).select(["a", "b"])

    return run


def confirmed(texts: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those `pairs` (a, b) of classes whose full shingle sets are similar enough. Either end
    may be in many pairs: its text is copied, and each copy takes part of them."""
    pairs, of_a = dealt(pairs, "a", "b")
    pairs, of_b = dealt(pairs, "b", "a")
    members = pairs.join(copies_of(texts, of_a, "a"), ["a", "a_copy"]).select("b", "b_copy", "a", "text")
    hubs = copies_of(texts, of_b, "b").select("b", "b_copy", F.lit(None).cast("binary").alias("a"), "text")
    rows = members.unionByName(hubs)
    rows = rows.repartition("b", "b_copy").sortWithinPartitions("b", "b_copy", F.col("a").asc_nulls_first())
    return stored(rows.mapInArrow(tidy(_confirm(size, percent)), "a binary, b binary"), "confirmed")
