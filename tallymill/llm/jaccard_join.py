"""Documents whose sets of word n-grams are similar: prefixes under several global orders at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import bitmap, hot_join, may_be_in, mixed, shingle_hashes, stored, text_batches, tidy, utf8, word_hashes
from tallymill.llm.components import components, merged
from tallymill.llm.verify import class_of, confirmed, copies_of, dealt, texts_of_classes, words_of

SHINGLE = 3
PERCENT = 90
# Counters of the frequency table (2 MB at any size), and of one row of it.
COUNTERS = 1 << 18
PART = 1 << 14
# Bits of an order's key below the frequency class.
KEY_BITS = 58
# Bits of a class's sketch: the power of two from this many a token, between two bounds.
BITS_PER_TOKEN = 1
SKETCH_BITS = 256, 8192
# Classes of a bucket that are compared with each other in one step; nearest ones met first,
# but all at once in a bucket of few.
BLOCK = 1000
BEST = 3
FEW = 16
# Pairs of sketches that are compared one by one; more of a block are compared together.
PAIRS_ALONE = 500
# Classes that a task remembers as sent.
REMEMBERED = 200_000

PROFILE = "id long, text_hash long, class binary, n_shingles long, part int, counts binary"
PREFIXES = "class binary, size long, first array<long>, second array<int>, third array<int>, sketch binary"
_SEEDS = mixed(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def tokens_of(words: np.ndarray, size: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text as 64-bit hashes, and the frequency class of each: that
    of its rarest word."""
    found, first = np.unique(shingle_hashes(words, size), return_index=True)
    each = frequent[words & np.uint64(COUNTERS - 1)]
    n = len(words) - min(size, len(words)) + 1
    rarest = each[:n]
    for k in range(1, min(size, len(words))):
        rarest = np.minimum(rarest, each[k : k + n])
    return found, rarest[first]


def _profiles(size: int):
    """A row for each text, and at the end of the task a table of how often its classes have
    words, counted by the last bits of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(COUNTERS, dtype=np.uint32), set()
        for batch in (part for b in batches for part in text_batches(b)):
            texts = utf8(batch.column("text"))
            words, starts = word_hashes(texts)
            classes, sizes, new = [class_of(words_of(t)) for t in texts], [], []
            for name, a, b in zip(classes, starts, starts[1:], strict=False):
                sizes.append(len(np.unique(shingle_hashes(words[a:b], size))))
                if name not in seen:
                    seen.add(name)
                    new.append(words[a:b])
            if len(seen) > REMEMBERED:
                seen.clear()
            if new:
                counts += np.bincount(np.concatenate(new) & np.uint64(COUNTERS - 1), minlength=COUNTERS).astype(np.uint32)
            n = len(texts)
            columns = [batch.column("id"), batch.column("text_hash"), pa.array(classes, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["id", "text_hash", "class", "n_shingles", "part", "counts"])
        parts = [p for p in range(COUNTERS // PART) if counts[p * PART : (p + 1) * PART].any()]
        nothing = [pa.nulls(len(parts), t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int64())]
        tables = pa.array([counts[p * PART : (p + 1) * PART].tobytes() for p in parts], pa.binary())
        yield pa.RecordBatch.from_arrays([*nothing, pa.array(parts, pa.int32()), tables], ["id", "text_hash", "class", "n_shingles", "part", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            sums[part] = sums.get(part, 0) + np.frombuffer(counts, dtype=np.uint32).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])


def frequency_classes(tables: DataFrame) -> np.ndarray:
    """The frequency class of the words of each counter: one more for each doubling."""
    counts = np.zeros(COUNTERS, dtype=np.int64)
    # At most COUNTERS / PART rows.
    for part, held in tables.repartition("part").mapInArrow(tidy(_summed), "part int, counts binary").collect():
        counts[part * PART : (part + 1) * PART] = np.frombuffer(held, dtype=np.int64)
    return np.log2(np.maximum(counts, 1)).astype(np.uint64)


def prefix_length(n: int, percent: int) -> int:
    """Tokens of a set of n of which at least one is shared with every set that is similar
    enough, in any order of the tokens that both sets follow."""
    return n - (percent * n + 99) // 100 + 1


def sketch_of(tokens: np.ndarray) -> bytes:
    """Parity bitmap of a set: each token flips one bit. Tokens that two sets share flip the same
    bits, so two sketches differ in no more bits than the sets have tokens of their own."""
    low, high = SKETCH_BITS
    bits = min(max(1 << (BITS_PER_TOKEN * len(tokens) - 1).bit_length(), low), high)
    places = (mixed(tokens ^ _SEEDS[3]) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch that the same set has in fewer bytes."""
    held = np.frombuffer(sketch, dtype=np.uint8)
    while len(held) > size:
        held = held[: len(held) // 2] ^ held[len(held) // 2 :]
    return held


def bits_apart(one: bytes, two: bytes) -> int:
    if len(one) != len(two):
        size = min(len(one), len(two))
        one, two = folded(one, size).tobytes(), folded(two, size).tobytes()
    return (int.from_bytes(one) ^ int.from_bytes(two)).bit_count()


def may_be_similar(apart, sizes, percent: int):
    """Whether two sets with `sizes` tokens in all, of which `apart` at least are in one of them
    only, may be similar enough."""
    return (100 + percent) * apart <= (100 - percent) * sizes


def _prefixes(size: int, percent: int, frequent: np.ndarray):
    """The first tokens of each class under three orders: by frequency class, rare ones first,
    and within it by hashes that differ between the orders; and its sketch.
    A task sends a class once, so a group of copies has a row per task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in (part for b in batches for part in text_batches(b)):
            texts = utf8(batch.column("text"))
            words, starts = word_hashes(texts)
            rows = []
            for text, a, b in zip(texts, starts, starts[1:], strict=False):
                name = class_of(words_of(text))
                if name is None or name in seen:
                    continue
                seen.add(name)
                tokens, rarity = tokens_of(words[a:b], size, frequent)
                n = len(tokens)
                p = prefix_length(n, percent)
                keys = [(rarity << np.uint64(KEY_BITS)) | (mixed(tokens ^ s) >> np.uint64(64 - KEY_BITS)) for s in _SEEDS[:3]]
                keys = [np.partition(k, p - 1)[:p] for k in keys]
                # The last bits are enough to tell that nothing is shared.
                rows.append((name, n, keys[0].view(np.int64), *(k.astype(np.uint32).view(np.int32) for k in keys[1:]), sketch_of(tokens)))
            if len(seen) > REMEMBERED:
                seen.clear()
            if rows:
                names, sizes, *lists, sketches = zip(*rows, strict=True)
                lists = [pa.array(x, pa.list_(t)) for x, t in zip(lists, [pa.int64()] + [pa.int32()] * 2, strict=True)]
                columns = [pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), *lists, pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["class", "size", "first", "second", "third", "sketch"])

    return run


def _common(one: list, two: list) -> np.ndarray:
    """How many keys each of the lists in `one` shares with each in `two`; a list has no key twice."""
    sizes = [np.array([len(x) for x in side]) for side in (one, two)]
    keys, place = np.unique(np.concatenate([np.concatenate(side) for side in (one, two)]), return_inverse=True)
    rows = [np.repeat(np.arange(len(s)), s) for s in sizes]
    split = len(rows[0])
    out = np.zeros((len(one), len(two)), dtype=np.float32)
    for start in range(0, len(keys), 4096):
        sides = []
        for row, at, n in ((rows[0], place[:split], len(one)), (rows[1], place[split:], len(two))):
            here = (at >= start) & (at < start + 4096)
            held = np.zeros((n, min(4096, len(keys) - start)), dtype=np.float32)
            held[row[here], at[here] - start] = 1
            sides.append(held)
        both = sides[0].any(axis=0) & sides[1].any(axis=0)
        if both.any():
            out += sides[0][:, both] @ sides[1][:, both].T
    return out


def _all_apart(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """Bits in which each sketch in `one` differs from each in `two`."""
    out = np.zeros((len(one), len(two)), dtype=np.int64)
    lengths = [np.array([len(x) for x in side]) for side in (one, two)]
    for m in np.unique(lengths[0]).tolist():
        for n in np.unique(lengths[1]).tolist():
            at = np.flatnonzero(lengths[0] == m), np.flatnonzero(lengths[1] == n)
            odd = [[np.flatnonzero(np.unpackbits(folded(side[k], min(m, n)))) for k in i.tolist()] for side, i in zip((one, two), at, strict=True)]
            held = [np.array([len(x) for x in side]) for side in odd]
            out[np.ix_(*at)] = held[0][:, None] + held[1] - 2 * _common(*odd).astype(np.int64)
    return out


def _across(percent: int, best: int | None):
    """Of rows sorted by (bucket, one, two): pairs of different components, one from block
    `one` and one from block `two`, whose sizes and sketches allow them to be similar. With
    `best`, for each row outside the bucket's largest component only its nearest ones, but
    all in a bucket of few."""

    def compare(rows: list[tuple]) -> set[tuple[bytes, bytes]]:
        # Rows of one block hold each pair once: a class meets those after it.
        alone = rows[0][1] == rows[0][2]
        one, two = [[r for r in rows if r[3] == block] for block in rows[0][1:3]]
        if not one or not two:
            return set()
        numbers = {root: k for k, root in enumerate(dict.fromkeys(r[5] for r in rows))}
        roots = [np.array([numbers[r[5]] for r in side]) for side in (one, two)]
        sizes = [np.array([r[6] for r in side]) for side in (one, two)]
        small, large = np.minimum.outer(*sizes), np.maximum.outer(*sizes)
        good = (100 * small >= percent * large) & (roots[0][:, None] != roots[1])
        if alone:
            good = np.triu(good)
        at = np.argwhere(good)
        if not len(at):
            return set()
        if len(at) <= PAIRS_ALONE:
            apart = np.array([bits_apart(one[i][7], two[j][7]) for i, j in at.tolist()])
        else:
            apart = _all_apart([r[7] for r in one], [r[7] for r in two])[good]
        passed = may_be_similar(apart, sizes[0][at[:, 0]] + sizes[1][at[:, 1]], percent)
        at, apart = at[passed], apart[passed]
        if best is not None and not (alone and len(rows) <= FEW):
            main = numbers[Counter(r[5] for r in rows).most_common(1)[0][0]]
            # Both ends of each pair, the nearest first; a class of one block may be at either.
            ends = np.concatenate((at[:, 0], at[:, 1] + (0 if alone else len(one))))
            order = np.lexsort((np.concatenate((apart, apart)), ends))
            place = np.arange(len(ends)) - np.searchsorted(ends[order], ends[order])
            outside = np.concatenate((roots[0][at[:, 0]], roots[1][at[:, 1]]))[order] != main
            at = at[np.unique(order[(place < best) & outside] % len(at))] if len(at) else at
        return {(max(p, q), min(p, q)) for p, q in ((one[i][4], two[j][4]) for i, j in at.tolist())}

    def out(pairs: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        found: set[tuple[bytes, bytes]] = set()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "one", "two", "block", "class", "root", "size", "sketch")]
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


def _crossing(shared: DataFrame, classes: DataFrame, roots: DataFrame, percent: int, best: int | None) -> DataFrame:
    """Pairs (a, b) of classes in one bucket but not yet in one component. A bucket of few gives
    all of them with `best`, so that it is left out without."""
    placed = shared.join(roots.withColumnRenamed("node", "class"), "class", "left")
    placed = stored(placed.select("class", "bucket", F.coalesce("root", "class").alias("root")), "placed")
    split = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low != high")
    split = split.select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"), F.col("n").alias("held"))
    if best is None:
        split = split.filter((F.col("held") > FEW) | (F.col("blocks") > 1))
    split = stored(split, "split-buckets")
    if not split.head(1):
        return shared.sparkSession.createDataFrame([], "a binary, b binary")
    apart = hot_join(placed, split, "bucket", "held").join(classes.select("class", "size", "sketch"), "class")
    blocks = apart.withColumn("block", F.pmod(F.xxhash64("class", "bucket"), F.col("blocks")))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    one, two = F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")
    blocks = blocks.select("bucket", one, two, "block", "class", "root", "size", "sketch")
    blocks = blocks.repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")
    return blocks.mapInArrow(tidy(_across(percent, best)), "a binary, b binary").distinct()


def _near(percent: int):
    """Of pairs with sizes and sketches, those (a, b) whose sketches allow them to be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(c).to_pylist() for c in ("a_sketch", "b_sketch"))
            apart = np.array([bits_apart(p, q) for p, q in zip(one, two, strict=True)], dtype=np.int64)
            yield batch.filter(pa.array(may_be_similar(apart, batch.column("sizes").to_numpy(), percent), pa.bool_())).select(["a", "b"])

    return run


def _allowed(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow them to be similar, that share a token of their
    prefixes under the second and the third order too, and whose sketches are near enough."""
    pairs, of_a = dealt(pairs, "a", "b")
    pairs, of_b = dealt(pairs, "b", "a")
    for end, counted in (("a", of_a), ("b", of_b)):
        held = copies_of(classes.select("class", "size", "second", "third", "sketch"), counted, end)
        held = held.withColumnsRenamed({c: f"{end}_{c}" for c in ("size", "second", "third", "sketch")})
        pairs = pairs.join(held, [end, f"{end}_copy"])
    alike = 100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size")
    both = F.arrays_overlap("a_second", "b_second") & F.arrays_overlap("a_third", "b_third")
    rest = pairs.filter(alike).filter(both).select("a", "b", "a_sketch", "b_sketch", (F.col("a_size") + F.col("b_size")).alias("sizes"))
    return rest.mapInArrow(tidy(_near(percent)), "a binary, b binary")


def jaccard_join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs` (doc_id, text, any other
    columns). Words are runs without blanks, A-Z lower-cased; a document's set has its distinct
    runs of `shingle` words, or its whole sequence if that is shorter. Documents are linked if
    100 * intersection >= `percent` * union; component_id is the smallest doc_id reachable.

    Documents with the same words form a class, and further work is on classes. A table of
    fixed size counts how often words occur; the orders put tokens with rare words first. Two
    similar sets share a token of their prefixes under every such order: classes that share one under
    the first are candidates, those that do under the second and third as well, and whose
    sketches do not show that they have too many tokens of their own, are compared in full. A
    bucket (a first-order token) does not give all pairs: each class meets the smallest one in
    it, then in buckets with several components each class outside the largest one its nearest
    ones, then all pairs of different components, in blocks. Only pairs with near sketches leave
    a block, so that large groups which are just not similar enough give few.

    Tokens are 64-bit hashes; sets are compared by their words. n_shingles counts hashes.

    - A null or empty text, or one without words, has no shingles and no links; its
      component_id is its own id.
    - Rows with the same id may be in different components. A component whose ids are all
      null has a null component_id.
    - An empty table gives an empty table.
    """
    texts_in = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    profile = stored(texts_in.mapInArrow(tidy(_profiles(shingle)), PROFILE), "profiles")
    rows = profile.filter("part is null").select("id", "text_hash", "class", "n_shingles")
    frequent = frequency_classes(profile.filter("part is not null").select("part", "counts"))
    prefixes = texts_in.select("text").mapInArrow(tidy(_prefixes(shingle, percent, frequent)), PREFIXES)
    prefixes = stored(prefixes, "prefixes")

    banded = prefixes.select("class", F.explode("first").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("class").alias("hub"), F.max("class").alias("last"), F.count("*").alias("n"))
    buckets = stored(buckets.filter("hub != last").drop("last"), "buckets")
    likely = may_be_in(banded, stored(bitmap(buckets, "bucket"), "bucket-filter"), F.col("bucket"))
    shared = stored(hot_join(likely, buckets, "bucket", "n").distinct(), "shared-buckets")
    found = stored(shared.select("class").distinct(), "shared-classes")
    classes = stored(prefixes.drop("first").join(found, "class", "left_semi").dropDuplicates(["class"]), "classes")

    named = rows.filter(F.col("class").isNotNull()).groupBy("class")
    named = named.agg(F.min(F.struct("id", "text_hash")).alias("of"), F.min("id").alias("least_id"), F.count("*").alias("n"))
    named = stored(named.select("class", "of.*", "least_id", "n"), "class-rows")
    texts = texts_of_classes(docs, named.join(found, "class", "left_semi"))

    pairs = stored(shared.filter("class != hub").select(F.col("class").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    near = stored(_allowed(pairs, classes, percent), "near")
    roots = stored(components(confirmed(texts, near, shingle, percent)), "roots")
    tested = pairs
    for best in (BEST, None):
        crossing = _crossing(shared.select("class", "bucket"), classes, roots, percent, best)
        crossing = stored(crossing.join(tested, ["a", "b"], "left_anti"), "crossing")
        if not crossing.head(1):
            continue
        near = stored(_allowed(crossing, classes, percent), "near")
        roots = merged(roots, confirmed(texts, near, shingle, percent))
        tested = tested.unionByName(crossing)

    placed = named.select("class", "least_id", "n").join(roots.withColumnRenamed("node", "class"), "class", "left")
    placed = stored(placed.withColumn("component", F.coalesce("root", "class")).drop("root"), "placed")
    least = placed.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("held"))
    known = hot_join(placed, stored(least, "least"), "component", "held").select("class", "n", "component_id")
    linked = hot_join(rows.filter(F.col("class").isNotNull()), stored(known, "class-ids"), "class", "n")
    alone = rows.filter(F.col("class").isNull()).withColumn("component_id", F.col("id"))
    names = [F.col("id").alias("doc_id"), "n_shingles", "component_id"]
    return linked.select(names).unionByName(alone.select(names))
