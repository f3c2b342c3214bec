"""Language identification and toxicity against slow versions with dense vectors, in plain loops."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import documents, empty, prose, texts
from pyspark.sql import functions as F

from tallymill.llm import hypervectors, toxicity
from tallymill.llm.common import mixed


def letter_vector(letter: str) -> np.ndarray:
    """The random vector of a letter: the bits of hashes of its code, 64 at a time, as -1 and 1."""
    signs = []
    for k in range(hypervectors.DIMENSION // 64):
        seed = (ord(letter) * 0x9E3779B97F4A7C15 + k) % 2**64
        word = int(mixed(mixed(np.array([seed], dtype=np.uint64)) + np.uint64(1))[0])
        for byte in word.to_bytes(8, "little"):
            signs += [1.0 if byte >> (7 - b) & 1 else -1.0 for b in range(8)]
    return np.array(signs)


def slow_vector(text, letters):
    clean = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    words = clean.split(" ")
    if not any(words):
        return None
    line = " " + " ".join(w for w in words if w) + " "
    total = np.zeros(hypervectors.DIMENSION)
    for k in range(len(line) - 2):
        bound = np.ones(hypervectors.DIMENSION)
        for j, c in enumerate(line[k : k + 3]):
            if c not in letters:
                letters[c] = letter_vector(c)
            bound = bound * np.roll(letters[c], 2 - j)
        total += bound
    return total / np.linalg.norm(total)


def test_language_against_dense_vectors(spark):
    rows = [(i, t if t is None or len(t) < 3000 else t[:3000]) for i, t in texts()] + [(60, "Ärger über Öl, ß!"), (61, "straße ÜBER alles"), (62, "déjà vu où ça")]
    learn = [("the cat and the dog", "en"), ("of the and in it", "en"), ("der hund und die katze", "de"), ("über die straße", "de"), (prose(3, 30), "la"), (None, "en"), ("x", None)]
    letters: dict = {}
    sums: dict = {}
    for text, lang in learn:
        vector = slow_vector(text, letters)
        if vector is not None and lang is not None:
            sums[lang] = sums.get(lang, 0) + vector
    profiles = {lang: v / np.linalg.norm(v) for lang, v in sorted(sums.items())}
    found = hypervectors.prototypes(spark.createDataFrame(learn, "text string, lang string").repartition(3))
    assert list(found) == list(profiles)
    for lang, v in profiles.items():
        np.testing.assert_allclose(found[lang], v, atol=1e-5)
    want = Counter()
    for i, text in rows:
        vector = slow_vector(text, letters)
        cosines = {} if vector is None else {lang: float(v @ vector) for lang, v in profiles.items()}
        best = max(cosines, key=cosines.get) if cosines else "und"
        want[i, best, round(min(1.0, max(0.0, cosines[best])), 3) if cosines else 0.0] += 1
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 3)) for r in hypervectors.identify(documents(spark, rows), found).collect())
    assert got == want


def words_of(text):
    return set(re.findall(r"[^\W\d_]+", (text or "").lower()))


def slow_features(words):
    """How often each feature counts: a word's own and its first letters."""
    counts = Counter()
    for w in words:
        for part in [f"w {w}"] + [f"p {w[:n]}" for n in (4, 5) if len(w) > n]:
            counts[zlib.crc32(part.encode()) % toxicity.BUCKETS] += 1
    return {b: min(n, toxicity.MOST_WORDS) for b, n in counts.items()}


def slow_model(rows, identities):
    """Weights by feature and the constant, from the written loss with dense matrices."""
    other = {w: g[(k + 1) % len(g)] for g in identities for k, w in enumerate(g)}
    labels = np.array([y for _, y in rows], dtype=float)
    held = [slow_features(words_of(t)) for t, _ in rows]
    n, n1 = len(rows), int(labels.sum())
    evidence = {}
    for b in {b for x in held for b in x}:
        table = np.zeros((2, 2))
        for x, y in zip(held, labels, strict=True):
            table[int(y), int(b in x)] += 1
        expected = table.sum(axis=1, keepdims=True) * table.sum(axis=0, keepdims=True) / n
        evidence[b] = max(0.0, 2 * sum(k * math.log(k / e) for k, e in zip(table.ravel(), expected.ravel(), strict=True) if k))
    chance = 2 * math.log(max(len(evidence), 2))
    surest = sorted(evidence, key=lambda b: (-evidence[b], b))[: toxicity.FEATURES]
    trusted = {b: (evidence[b] / (evidence[b] + chance)) ** 2 for b in surest}
    trusted |= {b: 1.0 for w in other for b in slow_features({w})}
    names = sorted(trusted)
    trust = np.array([trusted[b] for b in names])

    def matrix(all_words):
        return np.array([[slow_features(w).get(b, 0) for b in names] for w in all_words], dtype=float).reshape(-1, len(names))

    x = matrix([words_of(t) for t, _ in rows])
    changed = [words_of(t) for t, _ in rows if words_of(t) & set(other)]
    gap = matrix(changed) - matrix([{other.get(w, w) for w in words} for words in changed])
    v, c = np.zeros(len(names)), math.log((n1 + 0.5) / (n - n1 + 0.5))
    first, second = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, toxicity.STEPS + 1):
        w = v * trust
        off = 1 / (1 + np.exp(-(c + x @ w))) - labels
        slope = x.T @ off / n + (2 * toxicity.SWAP_PENALTY * gap.T @ (gap @ w) / len(changed) if len(changed) else 0)
        gradient = np.append(slope * trust + 2 * toxicity.RIDGE * v, off.mean())
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        v, c = v - move[:-1], c - move[-1]
    return dict(zip(names, v * trust, strict=True)), c


@pytest.mark.parametrize("groups", [(), (("women", "men"), ("gay", "straight"))])
def test_toxicity_against_dense_gradients(spark, groups):
    r = random.Random(6)
    rows = []
    for k in range(60):
        toxic = int(k % 4 == 0)
        words = [*prose(k, 6).split(), r.choice(["women", "men", "gay", "nobody", "straight"])] + ["vermin"] * (toxic and r.random() < 0.8) + ["vermins"] * (r.random() < 0.1)
        rows.append((" ".join(words), toxic))
    weights, constant = slow_model(rows, groups)
    labelled = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "doc_id long, text string, label int").repartition(3)
    model = toxicity.fit(labelled, groups)
    assert model.buckets.tolist() == sorted(weights) and model.n_swapped == (sum(bool(words_of(t) & {w for g in groups for w in g}) for t, _ in rows))
    docs = [(900 + k, t) for k, t in enumerate(["vermin women", "women", "men", "gay men vermins", "", None, prose(3, 6)])] + [(i, t) for i, t in texts()[:12]]
    want = Counter()
    for i, text in docs:
        total = constant + sum(weights.get(b, 0.0) * n for b, n in slow_features(words_of(text)).items())
        want[i, round(1 / (1 + math.exp(-total)), 4)] += 1
    got = Counter((x.doc_id, round(x.score, 4)) for x in toxicity.scores(documents(spark, docs), model).collect())
    assert got == want
    assert toxicity.scores(empty(spark), model).count() == 0


def test_labels_of_one_kind_only(spark):
    one = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "doc_id long, text string, label int")
    assert toxicity.scores(documents(spark, [(1, "a")]), toxicity.fit(one)).select(F.round("score", 6)).first()[0] == pytest.approx(2.5 / 3, abs=1e-6)
