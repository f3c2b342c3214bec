"""Quality rules whose thresholds come from quantile sketches per language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import BLANKS, hot_join, mixed, stored, text_batches, tidy, utf8, word_hashes

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MOST_REPEATED = 50  # percent of the words
WINDOW = 3

# Size parameter of the sketches: a rank is off by about 0.15 percent.
SKETCH_K = 2048
# A group's thresholds are drawn to those of its language, and these to those of all documents,
# as if that many documents more were like the wider group: the pull fades as a group grows.
PULL = 200
# Values further from the quartiles than FENCE spreads are left out of the tail; the spread is
# the distance of the quartiles, or the slack of the measure if that is more. A value is an
# outlier if it is further beyond the last quantile of what remains than MARGIN distances of
# the last two, or than the slack of the measure if that is more.
FENCE = 4.0
MARGIN = 2.0
TAIL = (0.95, 0.99)
# Ranks at which a sketch is read.
RANKS = [k / 400 for k in range(401)]
#: measure -> (numerator, denominator, whether low values are bad too, slack)
MEASURES = {
    "word_length": ("word_chars", "n_words", True, 0.5),
    "symbol_share": ("n_symbols", "n_words", False, 0.05),
    "dup_line_share": ("n_dup_lines", "n_lines", False, 0.1),
    "repeat_share": ("n_repeat_words", "n_words", False, 0.08),
}

COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def _repeated(words: np.ndarray) -> int:
    """Words that lie in a window of WINDOW words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    _, which, counts = np.unique(mixed(windows), return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(WINDOW):
        covered[k : k + n] |= again
    return int(covered.sum())


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those equal to an earlier one."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines), len(lines) - len(set(lines))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blank = np.zeros(256, dtype=bool)
    blank[list(BLANKS)] = True
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS.encode())] = True
    starts_char = (np.arange(256) & 0xC0) != 0x80
    for batch in (part for b in batches for part in text_batches(b)):
        texts = utf8(batch.column("text"))
        words, starts = word_hashes(texts, lower=False)
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1]))
        word_chars = np.add.reduceat((starts_char & ~blank)[data].astype(np.int64), at)
        symbols = np.add.reduceat(symbol[data].astype(np.int64), at)
        repeated = [_repeated(words[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
        lines = np.array([_lines(t) for t in texts], dtype=np.int64).reshape(-1, 2)
        own = [batch.column(c) for c in ("doc_id", "lang", "source")]
        counts = [np.diff(starts), word_chars, symbols, lines[:, 0], lines[:, 1], np.array(repeated, dtype=np.int64)]
        names = ["doc_id", "lang", "source", *(c.split()[0] for c in COUNTS.split(", "))]
        yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, pa.int64()) for c in counts)], names)


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, the counts of COUNTS, base_failed) of each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("lang", "source")), "text")
    counted = rows.mapInArrow(tidy(_measure), f"doc_id long, lang string, source string, {COUNTS}")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _value(name: str) -> Column:
    over, under, _, _ = MEASURES[name]
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(0.0)


def thresholds(counted: DataFrame) -> DataFrame:
    """Bounds per group of language and source: (group, n, and <measure>_low, <measure>_high).

    Each task sketches its documents that pass the base rules, sketches are merged per
    group, those of the groups per language, and those of the languages for all. A group of n
    documents has n parts of its own bounds and PULL parts of its language's, which are drawn
    to those of all documents in the same way.
    """
    group = F.to_json(F.struct("lang", "source"))
    good = counted.filter(~F.col("base_failed"))
    sketched = good.groupBy(group.alias("group"), F.to_json(F.struct("lang")).alias("language"))
    sketched = sketched.agg(F.count("*").alias("good"), *[F.kll_sketch_agg_double(_value(m), SKETCH_K).alias(m) for m in MEASURES])
    sketched = stored(sketched, "sketches")
    merged = [F.kll_merge_agg_double(m, SKETCH_K).alias(m) for m in MEASURES]
    languages = sketched.groupBy("language").agg(F.sum("good").alias("good"), *merged)
    languages = stored(languages, "language-sketches")
    everything = languages.agg(F.sum("good").alias("good"), *merged)

    def bounds(m: str) -> list[Column]:
        def at(q: float) -> Column:
            return F.element_at(m, F.greatest(F.lit(1), F.ceil(F.array_size(m) * F.lit(q)).cast("int")))

        slack = F.lit(MEASURES[m][3])
        (inner, last), (lower, first) = map(at, TAIL), (at(1 - q) for q in TAIL)
        least = first - F.greatest((lower - first) * MARGIN, slack) if MEASURES[m][2] else F.lit(float("-inf"))
        return [least.alias(f"{m}_low"), (last + F.greatest((last - inner) * MARGIN, slack)).alias(f"{m}_high")]

    def within_fence(m: str) -> Column:
        """Junk may be a tenth of a group, so the tail is that of the values within the fence."""
        low, high = F.element_at(m, 1 + len(RANKS) // 4), F.element_at(m, 1 + 3 * len(RANKS) // 4)
        spread = F.greatest(high - low, F.lit(MEASURES[m][3])) * FENCE
        return F.filter(m, lambda v: v.between(low - spread, high + spread))

    ranks = F.lit(RANKS)

    def bounded(table: DataFrame, *keys: str) -> DataFrame:
        read = table.select(*keys, "good", *[F.when(F.col("good") > 0, F.kll_sketch_get_quantile_double(m, ranks)).alias(m) for m in MEASURES])
        read = read.select(*keys, "good", *[within_fence(m).alias(m) for m in MEASURES])
        return read.select(*keys, "good", *[b for m in MEASURES for b in bounds(m)])

    names = [f"{m}_{side}" for m in MEASURES for side in ("low", "high")]
    own, wider = bounded(sketched, "group"), bounded(languages, "language")
    # One row: the bounds of all documents; missing if no document passes the base rules.
    widest = bounded(everything).first().asDict()
    groups = counted.groupBy(group.alias("group"), F.to_json(F.struct("lang")).alias("language")).agg(F.count("*").alias("n"))
    renamed = wider.select("language", F.col("good").alias("wider_good"), *[F.col(c).alias(f"wider_{c}") for c in names])
    both = groups.join(own, "group", "left").join(renamed, "language", "left")

    def drawn(own: Column, good: Column, wide: Column) -> Column:
        held = F.coalesce(good, F.lit(0))
        # A bound without end stays so.
        endless = wide == F.lit(float("-inf"))
        return F.when((held > 0) & ~endless, (held * own + PULL * wide) / (held + PULL)).otherwise(wide)

    def chosen(c: str) -> Column:
        last = F.lit(widest[c]).cast("double")
        return drawn(F.col(c), F.col("good"), drawn(F.col(f"wider_{c}"), F.col("wider_good"), last)).alias(c)

    return both.select("group", "n", *[chosen(c) for c in names])


def judge(docs: DataFrame) -> DataFrame:
    """Each row of `docs` (doc_id, text, lang, source, any other columns) as (doc_id, the
    counts of COUNTS, base_failed, kept, the measures). Kept are documents that pass the
    base rules and whose measures all lie within their group's thresholds.

    - A null or empty text has no words, fails the base rules and isn't kept.
    - Null languages and sources form groups of their own. Repeated rows count each.
    - Where no document passes the base rules none is kept; an empty table stays empty.
    - The sketches choose at random which values they merge, so for groups of more than
      SKETCH_K documents the bounds may differ a little from run to run; they are written
      down before they are used.
    """
    counted = stored(measures(docs), "measures")
    bounds = stored(thresholds(counted), "thresholds")
    rows = counted.withColumn("group", F.to_json(F.struct("lang", "source")))
    both = hot_join(rows, bounds, "group", "n")
    within = F.lit(True)
    for m in MEASURES:
        within &= F.coalesce(_value(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(False))
    counts = [c.split()[0] for c in COUNTS.split(", ")]
    return both.select("doc_id", *counts, "base_failed", (~F.col("base_failed") & within).alias("kept"), *[_value(m).alias(m) for m in MEASURES])
