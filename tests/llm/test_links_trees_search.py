"""The n-gram join, the Merkle manifest and the lexical search against brute force, on every
awkward case, on empty tables and over many small blocks."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import documents, empty, groups, prose, texts
from pyspark.sql import functions as F
from test_documents import multiset

from tallymill.llm import jaccard_join, lexical, merkle, odd_sketch, verify
from tallymill.llm.common import mixed


def near_texts(n=60, words=150, most=4, seed=7):
    """A group whose members are linked or just not, and texts that share a passage."""
    r = random.Random(seed)
    base = prose(50, words).split()
    rows = []
    for k in range(n):
        changed = list(base)
        for _ in range(r.randint(0, most)):
            changed[r.randrange(words)] = f"w{r.randint(0, 9999)}"
        rows.append((100 + k, " ".join(changed)))
    passage = prose(51, 60)
    return rows + [(1000 + k, f"{prose(2000 + k, 20 + 7 * k)} {passage}") for k in range(25)]


def check_join(spark, rows, size=3, percent=90):
    ids, sizes, _ = groups(rows, size, percent)
    want = [(i, n, c) for (i, _), n, c in zip(rows, sizes, ids, strict=True)]
    found = jaccard_join.jaccard_join(documents(spark, rows), size, percent)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert multiset(tuple(x) for x in found.collect()) == multiset(want)


def test_jaccard_join(spark):
    check_join(spark, texts() + near_texts())


def test_jaccard_join_in_small_blocks(spark, monkeypatch):
    """Buckets of many blocks, texts of many copies, tokens of all frequency classes."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    monkeypatch.setattr(jaccard_join, "COUNTERS", 64)
    monkeypatch.setattr(jaccard_join, "PART", 16)
    monkeypatch.setattr(jaccard_join, "REMEMBERED", 5)
    monkeypatch.setattr(verify, "PAIRS_PER_COPY", 3)
    check_join(spark, near_texts(40, 100, 6), size=2, percent=80)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.jaccard_join(empty(spark)).count() == 0
    assert [tuple(r) for r in jaccard_join.jaccard_join(documents(spark, [(None, None), (3, " ")])).orderBy("doc_id").collect()] == [(None, 0, None), (3, 0, 3)]


def test_prefixes_share_a_token_in_every_order():
    """The bound behind the filter, for sets that are just similar enough."""
    r = np.random.default_rng(3)
    for n in (1, 2, 9, 10, 11, 37, 100):
        for changed in range(n):
            one = r.integers(0, 1 << 62, n, dtype=np.uint64)
            two = np.concatenate((one[changed:], r.integers(0, 1 << 62, r.integers(0, changed + 1), dtype=np.uint64)))
            both = len(np.intersect1d(one, two))
            if 100 * both < 90 * len(np.union1d(one, two)):
                continue
            for seed in (1, 2, 3):
                first = [set(sorted(mixed(x ^ np.uint64(seed)).tolist())[: jaccard_join.prefix_length(len(x), 90)]) for x in (one, two)]
                assert first[0] & first[1]


def test_rarity_is_that_of_the_rarest_word():
    words = np.array([5, 6, 5, 6, 5, 7], dtype=np.uint64)
    frequent = np.zeros(jaccard_join.COUNTERS, dtype=np.uint64)
    frequent[[5, 6, 7]] = 3, 2, 1
    tokens, rarity = jaccard_join.tokens_of(words, 2, frequent)
    assert len(tokens) == 3 and sorted(rarity.tolist()) == [1, 2, 2]
    assert [x.tolist() for x in jaccard_join.tokens_of(words[:1], 2, frequent)][1] == [3]


def test_sketches_never_tell_similar_sets_apart():
    r = np.random.default_rng(5)
    sets = []
    for n in (1, 5, 100, 300, 520, 3000):
        base = r.integers(0, 1 << 62, n, dtype=np.uint64)
        sets += [np.unique(np.concatenate((base[k:], r.integers(0, 1 << 62, k // 2 + 1, dtype=np.uint64)))) for k in (0, 1, n // 20, n // 8, n)]
    sketches = [jaccard_join.sketch_of(x) for x in sets]
    apart = jaccard_join._all_apart(sketches, sketches)
    for i, one in enumerate(sets):
        for k, two in enumerate(sets):
            assert apart[i, k] == jaccard_join.bits_apart(sketches[i], sketches[k]) <= len(np.setxor1d(one, two))
            for percent in (50, 80, 90, 100):
                if 100 * len(np.intersect1d(one, two)) >= percent * len(np.union1d(one, two)):
                    assert jaccard_join.may_be_similar(apart[i, k], len(one) + len(two), percent)


@pytest.mark.parametrize("alone", [0, 1000])
def test_a_large_group_of_texts_just_not_similar_gives_few_pairs(spark, monkeypatch, alone):
    """All share tokens under every order; comparing them all in full grows with the square of their number."""
    r = random.Random(9)
    base = prose(52, 200).split()
    rows = []
    for k in range(150):
        changed = list(base)
        for at in r.sample(range(0, 200, 4), 4):
            changed[at] = f"w{k}x{at}"
        rows.append((k, " ".join(changed)))
    pairs = []

    def counted(texts, near, size, percent, own=verify.confirmed):
        pairs.extend(near.collect())
        return own(texts, near, size, percent)

    monkeypatch.setattr(jaccard_join, "confirmed", counted)
    monkeypatch.setattr(jaccard_join, "PAIRS_ALONE", alone, raising=False)
    check_join(spark, rows)
    assert len(pairs) < 10 * len(rows)


def test_common_keys():
    r = random.Random(1)
    sides = [[np.array(r.sample(range(9000), r.randint(1, 300))) for _ in range(20)] for _ in range(2)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sides[1]] for a in sides[0]]
    assert jaccard_join._common(*sides).tolist() == want


@pytest.mark.parametrize("same_id", [7, None])
def test_rows_of_one_id_do_not_multiply(spark, same_id):
    """Texts of classes are joined by id and text: as many rows as there are."""
    rows = [(same_id, f"{prose(k, 30)} end") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    classes = odd_sketch.signatures(docs).select("class", "id", "text_hash", F.lit(1).cast("long").alias("n"))
    wanted = classes.select(verify.row_key(F.col("id"), F.col("text_hash")).alias("row"), "class", "n")
    key = verify.row_key(F.col("doc_id"), F.xxhash64("text"))
    assert docs.select(key.alias("row"), "text").join(wanted, "row").count() == len(rows)
    assert verify.texts_of_classes(docs, classes).count() == len(rows)
    found = odd_sketch.near_duplicates(docs.limit(300))
    assert found.count() == 300 and {r.component_id for r in found.collect()} == {same_id}


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_tree(digests):
    """Root and each leaf's siblings, the level above last."""
    level, above = list(digests), [[] for _ in digests]
    at = list(range(len(digests)))
    while len(level) > 1:
        for k, i in enumerate(at):
            above[k] += [level[j] for j in (i ^ 1,) if j < len(level)]
        at = [i // 2 for i in at]
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], above


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def slow_manifest(rows):
    """(id, leaf, subroot, root, digest of the proof) of rows (doc_id, source, lang, n_chars, text)."""
    by_lang: dict = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, h(*map(written, row)), row))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = [slow_tree([x[2] for x in sorted(by_lang[lang], key=lambda x: x[:3])]) for lang in langs]
    root, tops = slow_tree([t[0] for t in trees])
    out = []
    for lang, (subroot, above), top in zip(langs, trees, tops, strict=True):
        for x, own in zip(sorted(by_lang[lang], key=lambda x: x[:3]), above, strict=True):
            out.append((x[3][0], x[2], subroot, root, h(*own, *top)))
    return out


def check_manifest(spark, docs):
    rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    leaves = merkle.leaves(docs, wrong=F.sha2(F.lit("other").cast("binary"), 256))
    found = merkle.manifest(leaves).cache()
    good = merkle.verified(found).collect()
    assert all(r.verified and r.folded_root == r.root for r in good)
    assert multiset((r.key, r.leaf, r.subroot, r.root, r.proof_sha256) for r in good) == multiset(slow_manifest(rows))
    assert not merkle.verified(found, "wrong").filter("verified").count()
    found.unpersist()


def test_manifest(spark):
    check_manifest(spark, documents(spark))
    check_manifest(spark, documents(spark).filter("doc_id = 17"))


def test_manifest_of_many_blocks(spark, monkeypatch):
    """Blocks of four leaves and groups of very different size: rounds of digests and of proofs."""
    monkeypatch.setattr(merkle, "HEIGHTS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    rows = [(k * 7919 % 1000, prose(k, 5)) for k in range(300)] + [(5, "again")] * 40
    docs = documents(spark, rows).withColumn("lang", F.concat(F.lit("l"), F.least(F.lit(30), F.pmod(F.xxhash64("doc_id", "text"), F.lit(60))).cast("string")))
    check_manifest(spark, docs)


def test_manifest_of_lone_leaves_and_of_nothing(spark):
    docs = documents(spark).dropDuplicates(["doc_id"]).withColumn("lang", F.col("doc_id").cast("string"))
    check_manifest(spark, docs)
    assert merkle.verified(merkle.manifest(merkle.leaves(empty(spark)))).count() == 0


def test_sweeps():
    for n in (1, 2, 3, 5, 8, 13, 64, 100):
        digests = [h(str(k)) for k in range(n)]
        root, above = slow_tree(digests)
        for top in (merkle.height(n), merkle.height(n) + 3):
            known = {}
            end = merkle.sweep(digests, top, known)
            proofs = merkle.suffixes(digests, top, "-")
            assert [merkle.siblings(p) for p in proofs] == ["".join(x) for x in above]
            assert {merkle.fold(d, p) for d, p in zip(digests, proofs, strict=True)} == {h(end)}
            assert top > merkle.height(n) or end == root


# Lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_search(rows, items, most=10):
    found = [Counter(TERM.findall((t or "").translate(LOWER))) for _, t in rows]
    n_docs, total = sum(1 for f in found if f), sum(sum(f.values()) for f in found)
    df = Counter(t for f in found for t in f)
    terms: dict = {}
    for item, text in items:
        terms.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, wanted in terms.items():
        scored = []
        for (doc_id, _), f in zip(rows, found, strict=True):
            m = 100 - 90 + (90 * sum(f.values()) * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * f[t] // (1000 * f[t] + 8 * m)) for t in wanted if f[t])
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0))
        out += [(item, k + 1, i if has else None, -s) for k, (s, has, i) in enumerate(sorted(scored)[:most])]
    return out


ITEMS = [(1, "Alpha1 beta2, GAMMA3"), (1, "delta4"), (2, None), (3, ""), (4, "¿ñandú? naïve-café 日本語"), (5, prose(1, 200)), (6, "This very line is shared"),
         (None, "one"), (7, "nothingofthesort"), (8, "password akia a"), (9, "a" * 200_000), (9, "a" * 200_000)]


@pytest.mark.parametrize("size", [lexical.AUTOMATON_BYTES, 200])
def test_search(spark, monkeypatch, size):
    """Also with many automatons, and with few scores at a time."""
    if size == 200:
        monkeypatch.setattr(lexical, "POSTINGS", 50)
    rows = texts() + [(3000 + k, prose(k % 9, 40)) for k in range(60)] + [(50, "one\x00one\x7fONE_one")] * 12
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = lexical.search(documents(spark, rows), items, automaton_bytes=size)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert multiset(tuple(r) for r in found.collect()) == multiset(slow_search(rows, ITEMS))


def test_search_of_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(empty(spark), items).count() == 0
    assert lexical.search(documents(spark, [(1, None), (2, "?!")]), items).count() == 0
    assert lexical.search(documents(spark), items.limit(0)).count() == 0
