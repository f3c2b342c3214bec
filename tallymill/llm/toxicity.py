"""Toxicity scores from a linear classifier that is penalised where a swap of identity terms changes its score."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallymill.llm.common import bitmap, crc_mod, may_be_in, stored, text_batches, tidy

# Hash space of the features: words and their first 4 and 5 letters.
BUCKETS = 1 << 18
PREFIXES = (4, 5)
# Features that the classifier sees: those with the most evidence of a link with the label.
FEATURES = 4096
# The classifier is fitted on at most this many labelled documents, those with the smallest
# hash of their id; feature statistics cover all of them.
FIT_ROWS = 20_000
# Weight of the squared score change under a swap, and of the squared weights.
SWAP_PENALTY = 1.0
RIDGE = 1e-5
STEPS = 400
# A feature counts once for each different word that has it, up to this many.
MOST_WORDS = 3

# Neutral names of groups, one list per kind; a swap takes the next of the list.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
    ("musulmans", "chrétiens", "juifs"),
)

_WORD = re.compile(r"[^\W\d_]+")


def swaps(groups: tuple[tuple[str, ...], ...] = IDENTITIES) -> dict[str, str]:
    return {word: group[(k + 1) % len(group)] for group in groups for k, word in enumerate(group)}


def features_of(word: str) -> tuple[int, ...]:
    """Buckets of a lower-cased word: of itself and of its first letters."""
    parts = [f"w {word}", *(f"p {word[:n]}" for n in PREFIXES if len(word) > n)]
    return tuple(zlib.crc32(p.encode()) % BUCKETS for p in parts)


class _Lookup(dict):
    """word -> what `make` gives, kept for the words met so far; emptied when it gets large."""

    def __init__(self, make, most: int = 100_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = out = self.make(word)
        return out


def _words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _repeated(words: set[str], known: _Lookup) -> list[int]:
    """Features of the words, each as often as it counts."""
    counts = Counter(f for w in words for f in known[w])
    return sorted(f for f, n in counts.items() for _ in range(min(n, MOST_WORDS)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label per bucket, for all texts of the task."""
    seen = np.zeros((2, BUCKETS), dtype=np.int64)
    known = _Lookup(features_of)
    for batch in (part for b in batches for part in text_batches(b)):
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            seen[label, list({b for w in _words(text) for b in known[w]})] += 1
    at = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], ["bucket", "n0", "n1"])


def _vectors(buckets: np.ndarray, other: dict[str, str]):
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[buckets] = np.arange(len(buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Lookup(lambda w: tuple(int(place[b]) for b in features_of(w) if place[b] >= 0))
        for batch in (part for b in batches for part in text_batches(b)):
            own, swapped = [], []
            for text in batch.column("text").to_pylist():
                words = _words(text)
                own.append(_repeated(words, known))
                changed = {other.get(w, w) for w in words} if not words.isdisjoint(other) else words
                swapped.append(_repeated(changed, known) if changed is not words else None)
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (own, swapped)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *lists], ["label", "own", "swapped"])

    return run


@dataclass
class Model:
    """Weight per bucket (of FEATURES, and of the identity terms), the constant, and the number
    of fitted documents that a swap of identity terms changes: of 0, the penalty had no part."""

    buckets: np.ndarray
    weights: np.ndarray
    constant: float
    n_swapped: int = 0


def _sums(lists: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    sizes = np.array([len(x) for x in lists])
    flat = np.concatenate([*lists, np.zeros(1, dtype=np.int32)])
    total = np.concatenate(([0.0], np.cumsum(weights[flat])))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def fit_weights(own: list[np.ndarray], swapped: dict[int, np.ndarray], labels: np.ndarray, trust: np.ndarray, penalty: float = SWAP_PENALTY) -> tuple[np.ndarray, float]:
    """Logistic regression: mean log loss + RIDGE |w / trust|^2 + `penalty` x the mean over
    swapped documents of (score before - score after)^2, by accelerated gradient steps of
    Adam on w / trust: features of little trust (0 to 1 each) move late and cost more."""
    n = len(trust)
    free, c = np.zeros(n), float(np.log((labels.sum() + 0.5) / ((1 - labels).sum() + 0.5)))
    sizes = np.array([len(x) for x in own])
    flat = np.concatenate([*own, np.zeros(0, dtype=np.int32)]).astype(np.int64)
    before = [own[k] for k in swapped]
    after = list(swapped.values())
    moment, square = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        w = free * trust
        error = 1 / (1 + np.exp(-np.clip(c + _sums(own, w), -30, 30))) - labels
        slope = np.bincount(flat, weights=np.repeat(error, sizes), minlength=n) / len(labels)
        if swapped:
            change = 2 * penalty * (_sums(before, w) - _sums(after, w)) / len(swapped)
            for lists, sign in ((before, 1), (after, -1)):
                slope += sign * np.bincount(np.concatenate(lists).astype(np.int64), weights=np.repeat(change, [len(x) for x in lists]), minlength=n)
        gradient = np.append(slope * trust + 2 * RIDGE * free, error.mean())
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        move = 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        free, c = free - move[:-1], c - move[-1]
    return free * trust, c


def evidence(n0: Column, n1: Column, clean: int, toxic: int) -> Column:
    """Log-likelihood ratio of feature and label: 2 x the sum of k ln(k / expected k) over
    the documents of either label with and without the feature. A count of 0 adds nothing,
    so a word that no clean document has is not held back by that."""
    n, held = clean + toxic, n0 + n1

    def part(k: Column, expected: Column) -> Column:
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    cells = [(k, size, held) for k, size in ((n0, clean), (n1, toxic))]
    cells += [(F.lit(size) - k, size, F.lit(n) - held) for k, size in ((n0, clean), (n1, toxic))]
    return F.greatest(F.lit(0.0), 2 * sum((part(k, size * rest / n) for k, size, rest in cells), F.lit(0.0)))


def fit(labelled: DataFrame, identities: tuple[tuple[str, ...], ...] = IDENTITIES) -> Model:
    """Model from (doc_id, text, label): label 0 or 1, other labels are left out. Without
    rows of both labels the score is their smoothed share, one half for none.

    Counts per feature come from all rows, added up per task before the shuffle. The FEATURES
    with the most evidence are kept, whatever the number of rows, and the weights fitted on
    FIT_ROWS rows. The trust in a feature is (e / (e + chance))^2 for evidence e, where
    chance = 2 ln(features) is about the most that chance gives to one of so many features;
    that of the features of identity terms is 1.
    """
    other = swaps(identities)
    rows = labelled.filter(F.col("label").isin(0, 1)).select("doc_id", "text", F.col("label").cast("int").alias("label"))
    rows = stored(rows, "labelled")
    n1, n = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    if not 0 < n1 < n:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), float(np.log((n1 + 0.5) / (n - n1 + 0.5))))
    counts = rows.select("text", "label").mapInArrow(tidy(_counts), "bucket long, n0 long, n1 long")
    counts = stored(counts.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "label-counts")
    chance = 2 * np.log(max(counts.count(), 2))
    surest = counts.withColumn("e", evidence(F.col("n0"), F.col("n1"), n - n1, n1)).orderBy(F.desc("e"), "bucket").limit(FEATURES)
    trusted = {r.bucket: (r.e / (r.e + chance)) ** 2 for r in surest.select("bucket", "e").collect()}
    trusted |= {b: 1.0 for w in other for b in features_of(w)}
    buckets = np.array(sorted(trusted), dtype=np.int64)
    trust = np.array([trusted[b] for b in buckets.tolist()])
    place = F.xxhash64("doc_id").alias("place")
    last = rows.select(place).orderBy("place").limit(FIT_ROWS).agg(F.max("place")).first()[0]
    sample = rows.filter(place <= last)
    sample = sample.select("text", "label").mapInArrow(tidy(_vectors(buckets, other)), "label int, own array<int>, swapped array<int>")
    sample = stored(sample, "fit-rows").orderBy("label", "own").toArrow().to_pydict()
    lists = [np.array(x, dtype=np.int32) for x in sample["own"]]
    changed = {k: np.array(x, dtype=np.int32) for k, x in enumerate(sample["swapped"]) if x is not None}
    weights, constant = fit_weights(lists, changed, np.array(sample["label"], dtype=float), trust)
    return Model(buckets, weights, constant, len(changed))


def _scores(model: Model):
    buckets, given, constant = model.buckets, model.weights, model.constant

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = dict(zip(buckets.tolist(), given.tolist(), strict=True))
        known = _Lookup(lambda w: tuple(b for b in features_of(w) if b in weight))
        for batch in (part for b in batches for part in text_batches(b)):
            total = []
            for text in batch.column("text").to_pylist():
                total.append(constant + sum(weight[b] for b in _repeated(_words(text), known)))
            score = 1 / (1 + np.exp(-np.clip(np.array(total), -30, 30)))
            columns = [batch.column(c) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], [*names, "score"])

    return run


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text_hash, score) of every row; a null or empty text has no feature and gets
    the score of the constant."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return stored(rows.mapInArrow(tidy(_scores(model)), "doc_id long, text_hash long, score double"), "scores")


def labelled_rows(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, text, label) of the labelled documents that are not held out; documents of a
    null id, and ids whose labels disagree, are left out. A bitmap of the labelled ids keeps
    most other texts out of the shuffle."""
    marks = labels.groupBy("doc_id").agg(F.min("toxic").alias("label"), F.max("toxic").alias("most")).filter("label = most")
    marks = stored(marks.select("doc_id", "label").filter(F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), folds) != 0)), "marks")
    held = bitmap(marks.select(F.xxhash64(F.col("doc_id").cast("long")).alias("id_hash")), "id_hash")
    learn = may_be_in(docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull()), held, F.xxhash64(docs["doc_id"].cast("long")))
    return learn.join(marks.hint("merge"), "doc_id")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that score below `threshold`."""
    packed = docs.select(F.col("text").alias("text"), F.struct("*").alias("_row"))
    schema = StructType([StructField("_row", docs.schema), StructField("score", DoubleType())])
    kept = stored(packed.mapInArrow(tidy(_scores(model)), schema).filter(F.col("score") < threshold), "not-toxic")
    return kept.select(*[F.col(f"_row.`{c}`") for c in docs.columns])
