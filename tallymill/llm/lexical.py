"""Documents ranked for each of many items by an automaton of the items' terms, without an index of the documents."""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.common import small_batches, stored, text_batches, tidy, utf8

# Documents for each item.
BEST = 10
# Terms of the items that one automaton is broadcast for, in bytes with PER_TERM more for
# each; twice that at most, or one item that is larger.
AUTOMATON_BYTES = 4_000_000
PER_TERM = 16
# Scores of terms that a task adds up at a time.
POSTINGS = 4_000_000
# Groups of tasks whose best documents are compared first.
SALTS = 256
# Rows of pass one that count documents with terms, and all terms.
N_DOCS, N_TERMS = -1, -2

# Letters, digits and everything beyond ASCII belong to terms; A-Z become a-z, the rest a guard.
_NORMAL = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normal(text: bytes) -> bytes:
    """Terms, each between guards (spaces)."""
    return text.translate(_NORMAL)


@dataclass
class Items:
    """Some items: their ids, the terms of all, and for each term the items that have it
    (of term t: `holders[starts[t]:starts[t + 1]]`)."""

    ids: list
    terms: list[bytes]
    starts: np.ndarray
    holders: np.ndarray

    def automaton(self) -> ahocorasick.Automaton:
        """Finds the terms between guards in a text whose bytes are its letters."""
        found = ahocorasick.Automaton()
        for place, term in enumerate(self.terms):
            found.add_word(f" {term.decode('latin-1')} ", place)
        found.make_automaton()
        return found


def items_of(rows: list) -> Items:
    """From rows (item_id, term), no pair twice."""
    ids = list(dict.fromkeys(r[0] for r in rows))
    number = {i: k for k, i in enumerate(ids)}
    by_term: dict[bytes, list[int]] = {}
    for item, term in rows:
        by_term.setdefault(bytes(term), []).append(number[item])
    terms = sorted(by_term)
    holders = np.array([i for t in terms for i in by_term[t]], dtype=np.int64)
    return Items(ids, terms, np.cumsum([0, *(len(by_term[t]) for t in terms)]), holders)


def occurrences(automaton: ahocorasick.Automaton, n_terms: int, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text, with repeats; and (text, term of the automaton, occurrences), by text and term."""
    data = b" " + b" ".join(normal(t) for t in texts) + b" "
    # Place of the guard behind each text.
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))
    inside = np.frombuffer(data, dtype=np.uint8) != 32
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    lengths = np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(texts))
    pairs = np.fromiter(chain.from_iterable(automaton.iter(data.decode("latin-1"))), dtype=np.int64)
    text = np.searchsorted(ends, pairs[0::2], side="left")
    both, tf = np.unique(text * n_terms + pairs[1::2], return_counts=True)
    return lengths, both // n_terms, both % n_terms, tf


def _counted(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, n_terms = items.automaton(), len(items.terms)
        df, n_docs, total = np.zeros(n_terms, dtype=np.int64), 0, 0
        for batch in (part for b in batches for part in text_batches(b)):
            lengths, _, term, _ = occurrences(automaton, n_terms, utf8(batch.column("text")))
            df += np.bincount(term, minlength=n_terms)
            n_docs += int((lengths > 0).sum())
            total += int(lengths.sum())
        held = np.flatnonzero(df)
        terms, counts = [N_DOCS, N_TERMS, *held.tolist()], [n_docs, total, *df[held].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(counts, pa.int64())], ["term", "n"])

    return run


class _Best:
    """The best documents of each item so far: equal scores by ascending id, null first."""

    def __init__(self, n_items: int, most: int):
        self.most = most
        self.held: list[list[tuple]] = [[] for _ in range(n_items)]
        # The last of a full list, which others must come before; until then any score above 0.
        self.score = np.zeros(n_items, dtype=np.int64)
        self.known, self.id = (np.full(n_items, -1, dtype=np.int64) for _ in range(2))

    def add(self, item: np.ndarray, score: np.ndarray, known: np.ndarray, doc_id: np.ndarray) -> None:
        last, same = self.score[item], self.known[item]
        first = (score == last) & ((known < same) | ((known == same) & (doc_id < self.id[item])))
        ahead = np.flatnonzero((score > last) | first)
        ahead = ahead[np.lexsort((doc_id[ahead], known[ahead], -score[ahead], item[ahead]))]
        # No more than `most` of the new ones can stay.
        own = item[ahead]
        ahead = ahead[np.arange(len(own)) - np.searchsorted(own, own) < self.most]
        for i, row in zip(item[ahead].tolist(), zip((-score[ahead]).tolist(), known[ahead].tolist(), doc_id[ahead].tolist(), strict=True), strict=True):
            held = self.held[i]
            insort(held, row)
            if len(held) > self.most:
                held.pop()
            if len(held) == self.most:
                self.score[i], self.known[i], self.id[i] = -held[-1][0], held[-1][1], held[-1][2]


def _ranked(items: Items, weights: np.ndarray, n_docs: int, n_terms_all: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, n_terms = items.automaton(), len(items.terms)
        spread = np.diff(items.starts)
        best = _Best(len(items.ids), most)
        for batch in (part for b in batches for part in text_batches(b)):
            lengths, text, term, tf = occurrences(automaton, n_terms, utf8(batch.column("text")))
            known = np.asarray(batch.column("doc_id").is_valid()).astype(np.int64)
            ids = np.asarray(batch.column("doc_id").fill_null(0))
            m = 100 - 90 + (90 * lengths * n_docs) // n_terms_all
            value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[text]))
            # Whole texts at a time, as many as have POSTINGS places among the items.
            per_text = np.bincount(text, weights=spread[term], minlength=len(lengths)).astype(np.int64)
            group = ((np.cumsum(per_text) - per_text) // POSTINGS)[text]
            for g in np.unique(group).tolist():
                here = slice(*np.searchsorted(group, [g, g + 1]))
                n = spread[term[here]]
                at = np.repeat(items.starts[term[here]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                both = np.repeat(text[here], n) * len(items.ids) + items.holders[at]
                order = np.argsort(both, kind="stable")
                both = both[order]
                first = np.flatnonzero(np.diff(both, prepend=-1))
                score = np.add.reduceat(np.repeat(value[here], n)[order], first)
                doc, item = both[first] // len(items.ids), both[first] % len(items.ids)
                best.add(item, score, known[doc], ids[doc])
        rows = [(i, doc_id if has else None, -score) for i, held in zip(items.ids, best.held, strict=True) for score, has, doc_id in held]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["item_id", "doc_id", "score"])

    return run


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for b in batches for part in text_batches(b)):
        found = [sorted(set(normal(t).split())) for t in utf8(batch.column("text"))]
        ids = batch.column("item_id").take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
        yield pa.RecordBatch.from_arrays([ids, pa.array([t for x in found for t in x], pa.binary())], ["item_id", "term"])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of all items, each once."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(tidy(_terms), "item_id long, term binary").distinct()


def _dealt(terms: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The terms with `part`, so that those of a part fill `most` bytes or little more, or are
    of one item; all terms of an item are in one part."""
    size = F.octet_length("term") + PER_TERM
    parts = max(1, -(-(terms.agg(F.sum(size)).first()[0] or 0) // most))
    while True:
        dealt = terms.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
        by_part = dealt.groupBy("part").agg(F.sum(size).alias("bytes"), F.min("item_id").alias("low"), F.max("item_id").alias("high"))
        if not by_part.filter((F.col("bytes") > 2 * most) & (F.col("low") != F.col("high"))).head(1):
            return dealt, parts
        parts *= 2


def _top(rows: DataFrame, most: int, *within: str) -> DataFrame:
    order = Window.partitionBy("item_id", *within).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def search(docs: DataFrame, items: DataFrame, most: int = BEST, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item (item_id, text) the `most` rows of `docs`
    (doc_id, text, any other columns) with the highest score above 0, or all if there are
    fewer; equal scores by ascending doc_id.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z
    lower-cased. An Aho-Corasick automaton of the items' terms, each between guards, is
    broadcast; two scans of the texts count with it. The first gives document frequencies and
    lengths, a few numbers per task; the second scores each text as it comes, where the
    automaton's outputs lead to the items, and each task keeps the best of each item. Where
    the terms of all items are too large for one broadcast, items are dealt into parts with an
    automaton each.

    - A null or empty text, or one without terms, is no document; an item without terms gets
      no rows.
    - Rows are ranked each, so equal rows follow one another; a null doc_id precedes others
      of the same score.
    - Rows of one item_id (also of a null one) are one item with the terms of all.
    - Empty tables give an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    terms, parts = _dealt(stored(item_terms(items), "item-terms"), automaton_bytes)
    found = None
    for part in range(parts):
        some = items_of(terms.filter(F.col("part") == part).select("item_id", "term").collect())
        if not some.terms:
            continue
        with small_batches(rows.sparkSession):
            counted = rows.mapInArrow(tidy(_counted(some)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        counts = {r.term: r.n for r in counted}
        n_docs = counts.get(N_DOCS, 0)
        if not n_docs:
            break
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(some.terms))]
        ranked = rows.mapInArrow(tidy(_ranked(some, np.array(weights, dtype=np.int64), n_docs, counts[N_TERMS], most)), "item_id long, doc_id long, score long")
        best = stored(ranked.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))), "best-of-tasks")
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "item_id long, doc_id long, score long, salt int")
    return _top(_top(found, most, "salt"), most).select("item_id", "rank", "doc_id", "score")
