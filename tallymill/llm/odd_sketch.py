"""Near-duplicate documents: MinHash bands find candidates, odd sketches sift them, full shingle sets decide."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import hot_join, mixed, shingle_hashes, stored, text_batches, tidy, utf8, word_hashes
from tallymill.llm.components import components, merged
from tallymill.llm.verify import class_of, confirmed, texts_of_classes, words_of

SHINGLE = 5
PERCENT = 80
# A pair of similarity 0.8 agrees in none of 32 bands of 4 samples with probability 5e-8.
BANDS, ROWS = 32, 4
# Samples of a text: the first BANDS * ROWS give the band keys, all are folded into the sketch.
SAMPLES = 256
# Samples of the finer sketches of classes that are still apart after the first rounds.
FINE_SAMPLES = 1024
# Bits of a sketch for each sample. At similarity 0.8 a fifth of the samples differ on average.
BITS_PER_SAMPLE = 8
# Estimated similarity below which a candidate is not confirmed on the full sets: 0.8 less
# nearly five standard deviations of the estimate, 0.025 and 0.0125.
SIFT = {SAMPLES: 0.68, FINE_SAMPLES: 0.74}
# Rows of a bucket that are compared with each other in one step.
BLOCK = 1000
# Nearest classes that one outside a bucket's largest component meets first.
BEST = 3

SIGNATURE = "id long, text_hash long, class binary, n_shingles long, bands array<long>, sketch array<long>"


def minhashes(hashes: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """Minima of one text's distinct shingle hashes, each under its own order."""
    seeds = mixed(np.arange(1, 2 * samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    flips, factors = seeds[:samples, None], seeds[samples:, None] | np.uint64(1)
    least = np.full(samples, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(hashes), 512):
        values = (hashes[None, start : start + 512] ^ flips) * factors
        np.minimum(least, values.min(axis=1), out=least)
    return least


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of rows of samples: each sample, with its place, flips one bit."""
    n, size = samples.shape
    width = size * BITS_PER_SAMPLE
    places = np.arange(size, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    bits = (mixed(samples + places) % np.uint64(width)).astype(np.int64) + np.arange(n)[:, None] * width
    odd = (np.bincount(bits.ravel(), minlength=n * width) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, width), axis=1).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    groups = samples[:, : BANDS * ROWS].reshape(len(samples), BANDS, ROWS)
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(samples), 1))
    for k in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + groups[:, :, k])
    return keys.view(np.int64)


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in text_batches(b)):
            texts = utf8(batch.column("text"))
            words, starts = word_hashes(texts)
            found = [np.unique(shingle_hashes(words[a:b], size)) for a, b in zip(starts, starts[1:], strict=False)]
            samples = np.stack([minhashes(x) for x in found])
            full = [len(x) > 0 for x in found]
            lists = [[x if ok else None for x, ok in zip(rows, full, strict=True)] for rows in (band_keys(samples).tolist(), odd_sketches(samples).tolist())]
            columns = [batch.column("id"), batch.column("text_hash"), pa.array([class_of(words_of(t)) for t in texts], pa.binary()), pa.array([len(x) for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.list_(pa.int64())) for x in lists)], ["id", "text_hash", "class", "n_shingles", "bands", "sketch"])

    return run


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, text_hash, class, n_shingles, bands, sketch) of each document; null class, bands and sketch for one without words."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(tidy(_signatures(size)), SIGNATURE)


def estimate(one: Column, two: Column) -> Column:
    """Similarity from the population count of the XOR of two odd sketches of SAMPLES samples:
    with d samples that differ there are 2 d flips of m bits, and the count is near
    m / 2 * (1 - exp(-4 d / m))."""
    apart = F.aggregate(F.zip_with(one, two, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    left = F.greatest(F.lit(1.0) - 2.0 * apart / (SAMPLES * BITS_PER_SAMPLE), F.lit(1e-9))
    return F.lit(1.0) + F.log(left) * (BITS_PER_SAMPLE / 4.0)


def _estimates(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The same for all pairs of rows of two arrays of sketches."""
    apart = np.zeros((len(one), len(two)), dtype=np.int64)
    for k in range(one.shape[1]):
        apart += np.bitwise_count((one[:, k, None] ^ two[:, k]).view(np.uint64))
    return 1 + np.log(np.maximum(1 - 2 * apart / (64 * one.shape[1]), 1e-9)) * (BITS_PER_SAMPLE / 4)


def _fine_sketches(texts: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(class, sketch): odd sketches of FINE_SAMPLES samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in text_batches(b)):
            words, starts = word_hashes(utf8(batch.column("text")))
            found = [minhashes(np.unique(shingle_hashes(words[a:b], size)), FINE_SAMPLES) for a, b in zip(starts, starts[1:], strict=False)]
            sketches = pa.array(odd_sketches(np.stack(found)).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("class"), sketches], ["class", "sketch"])

    return stored(texts.join(classes, "class", "left_semi").mapInArrow(tidy(run), "class binary, sketch array<long>"), "fine-sketches")


def _cross_pairs(best: int | None):
    """Of rows sorted by (bucket, one, two): pairs of different components, one from block
    `one` and one from block `two`, whose sketches are near. With `best`, only that many of
    the nearest for each row, and none for rows of the bucket's largest component. Without,
    each pair comes from the first bucket that its classes share only."""

    def nearest(one: list, two: list, main: int) -> list[tuple[int, int]]:
        (_, roots_1, sketches_1, bands_1), (_, roots_2, sketches_2, bands_2) = one, two
        found = []
        sift = SIFT[sketches_1.shape[1] * 64 // BITS_PER_SAMPLE]
        for start in range(0, len(roots_1), 64):
            here = slice(start, start + 64)
            likeness = _estimates(sketches_1[here], sketches_2)
            likeness[roots_1[here, None] == roots_2] = -1.0
            if best is None:
                i, j = np.nonzero(likeness >= sift)
            else:
                likeness[roots_1[here] == main] = -1.0
                j = np.argsort(-likeness, axis=1, kind="stable")[:, :best]
                i, k = np.nonzero(np.take_along_axis(likeness, j, axis=1) >= sift)
                j = j[i, k]
            found += zip((i + start).tolist(), j.tolist(), strict=True)
        return found

    def compare(rows: list[tuple]) -> set[tuple[bytes, bytes]]:
        numbers = {root: k for k, root in enumerate(sorted({r[5] for r in rows}))}
        main = Counter(numbers[r[5]] for r in rows).most_common(1)[0][0]
        sides = []
        for block in dict.fromkeys(rows[0][1:3]):
            held = [r for r in rows if r[3] == block]
            if held:
                sketches, bands = (np.array([r[k] for r in held], dtype=np.int64) for k in (6, 7))
                sides.append((held, np.array([numbers[r[5]] for r in held]), sketches, bands))
        if len(sides) < len(set(rows[0][1:3])):
            return set()
        pairs = set()
        for one, two in ((sides[0], sides[-1]), (sides[-1], sides[0]))[: 2 if best and len(sides) > 1 else 1]:
            for i, j in nearest(one, two, main):
                if best is None and one[3][i][(one[3][i] == two[3][j]).argmax()] != rows[0][0]:
                    continue
                p, q = one[0][i][4], two[0][j][4]
                pairs.add((max(p, q), min(p, q)))
        return pairs

    def out(pairs: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        found: set[tuple[bytes, bytes]] = set()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "one", "two", "block", "class", "root", "sketch", "bands")]
            for row in zip(*columns, strict=True):
                if group and row[:3] != group[0][:3]:
                    found |= compare(group)
                    group = []
                    if len(found) > 50_000:
                        yield out(sorted(found))
                        found = set()
                group.append(row)
        if group:
            found |= compare(group)
        yield out(sorted(found))

    return run


def _crossing(shared: DataFrame, classes: DataFrame, texts: DataFrame, roots: DataFrame, size: int, best: int | None) -> DataFrame:
    """Pairs (a, b) of classes in one bucket but not yet in one component, sifted by their
    sketches: the `best` ones, or all by finer sketches."""
    placed = shared.join(roots.withColumnRenamed("node", "class"), "class", "left")
    placed = stored(placed.select("class", "bucket", "n", F.coalesce("root", "class").alias("root")), "placed")
    split = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low != high")
    split = stored(split.select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"), F.col("n").alias("size")), "split-buckets")
    if not split.head(1):
        return shared.sparkSession.createDataFrame([], "a binary, b binary")
    apart = stored(hot_join(placed.drop("n"), split, "bucket", "size"), "apart")
    sketches = classes.select("class", "sketch", "bands")
    if best is None:
        fine = _fine_sketches(texts, apart.select("class").distinct(), size)
        sketches = sketches.drop("sketch").join(fine, "class")
    blocks = apart.join(sketches, "class").withColumn("block", F.pmod(F.xxhash64("class", "bucket"), F.col("blocks")))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    one, two = F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")
    blocks = blocks.select("bucket", one, two, "block", "class", "root", "sketch", "bands")
    blocks = blocks.repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")
    return blocks.mapInArrow(tidy(_cross_pairs(best)), "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs` (doc_id, text, any
    other columns); see `linked`."""
    found = linked(docs, shingle, percent)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def linked(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, text_hash, n_shingles, component, component_id) for each row of `docs`. Words are runs without blanks, A-Z lower-cased; a document's set has its
    distinct runs of `shingle` words, or its whole sequence if that is shorter. Documents
    are linked if their sets' similarity is `percent` / 100 or more; component_id is the
    smallest doc_id reachable, `component` names what is connected.

    Documents with the same words form a class, and all further work is on classes. Samples
    (MinHash) give band keys; classes that share a bucket are candidates. First each class
    meets the smallest class of its buckets, so a group of copies gives a star and not all
    pairs. Then, in buckets that still hold several components, classes of different
    components meet through their odd sketches, in blocks: first each class outside the
    bucket's largest component the BEST nearest ones, then all that are left. Candidates whose
    sketches are far apart are dropped, the others confirmed on the full sets. So every pair
    that shares a bucket and is not already connected is examined.

    - A null or empty text, or one without words, has no shingles, no links and a null
      component; its component_id is its own id.
    - Rows with the same id may be in different components. A component whose ids are all
      null has a null component_id.
    - An empty table gives an empty table.
    """
    rows = stored(signatures(docs, shingle), "signatures")
    classes = rows.filter(F.col("class").isNotNull()).groupBy("class")
    classes = classes.agg(F.min("id").alias("least_id"), F.min(F.struct("id", "text_hash")).alias("of"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = stored(classes.select("class", "least_id", "of.*", "n", "bands", "sketch"), "classes")
    sketches = classes.select("class", "sketch")

    banded = classes.select("class", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("class").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    shared = stored(hot_join(banded, stored(buckets, "buckets"), "bucket", "n"), "shared-buckets")

    pairs = shared.filter("class != hub").select(F.col("class").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = stored(pairs.join(sketches.select(F.col("class").alias("a"), F.col("sketch").alias("one")), "a"), "pairs")
    hubs = pairs.groupBy(F.col("b").alias("class")).agg(F.count("*").alias("n")).join(sketches, "class")
    hubs = stored(hubs.select(F.col("class").alias("b"), F.col("sketch").alias("two"), "n"), "hub-sketches")
    near = hot_join(pairs, hubs, "b", "n").filter(estimate(F.col("one"), F.col("two")) >= SIFT[SAMPLES]).select("a", "b")
    near = stored(near, "near")
    # Only classes that share a bucket are looked at any further.
    texts = texts_of_classes(docs, classes.join(shared.select("class").distinct(), "class", "left_semi"))
    links = confirmed(texts, near, shingle, percent)
    roots = stored(components(links), "roots")

    tested = near
    for best in (BEST, None):
        crossing = _crossing(shared, classes, texts, roots, shingle, best)
        crossing = stored(crossing.join(tested, ["a", "b"], "left_anti"), "crossing")
        if not crossing.head(1):
            continue
        roots = merged(roots, confirmed(texts, crossing, shingle, percent))
        tested = tested.unionByName(crossing)

    placed = classes.select("class", "least_id", "n").join(roots.withColumnRenamed("node", "class"), "class", "left")
    placed = stored(placed.withColumn("component", F.coalesce("root", "class")).drop("root"), "placed")
    least = placed.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("size"))
    named = hot_join(placed, stored(least, "least"), "component", "size").select("class", "n", "component", "component_id")
    named = stored(named, "class-ids")

    narrow = rows.select("id", "text_hash", "class", "n_shingles")
    known = hot_join(narrow.filter(F.col("class").isNotNull()), named, "class", "n").drop("class", "n")
    alone = narrow.filter(F.col("class").isNull()).drop("class").withColumn("component", F.lit(None).cast("binary"))
    return known.unionByName(alone.withColumn("component_id", F.col("id")))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` that stay when one document of each group of near duplicates does:
    that with the smallest id, of several with this id that with the smallest hash of its
    text, of equal rows any. Documents without words all stay."""
    found = stored(linked(docs, shingle, percent), "near-duplicates")
    first = found.filter(F.col("component").isNotNull() & F.col("id").eqNullSafe(F.col("component_id")))
    first = first.groupBy("component", "id", "text_hash").agg(F.count("*").alias("n"))
    first = first.groupBy("component").agg(F.min(F.struct("text_hash", "id", "n")).alias("first")).select("first.*")
    alone = found.filter(F.col("component").isNull()).select("text_hash", "id", F.lit(1).cast("long").alias("n")).distinct()
    kept = stored(first.unionByName(alone), "kept")
    rows = docs.select(F.xxhash64("text").alias("_hash"), F.col("doc_id").cast("long").alias("_id"), F.struct("*").alias("_row"))
    rows = rows.join(kept, (rows["_hash"] == kept["text_hash"]) & rows["_id"].eqNullSafe(kept["id"]))
    if kept.filter("n > 1").head(1):
        rows = rows.filter("n = 1").unionByName(rows.filter("n > 1").dropDuplicates(["_id", "_hash"]))
    return rows.select(*[F.col(f"_row.`{c}`") for c in docs.columns])
