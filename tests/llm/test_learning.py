"""Toxicity and benchmark overlap."""

import random

import numpy as np
from cases import documents, empty, prose, texts
from pyspark.sql import functions as F

from tallymill.llm import queries, tiling, toxicity
from tallymill.llm.common import crc_mod

SF = "/root/testdata/sf0.1"


def test_held_out_toxicity(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    found = queries.op9_toxicity(spark, SF)
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = found.filter("held_out").join(labels, "doc_id").collect()
    hits = sum(r.predicted for r in rows if r.toxic)
    wrong = sum(r.predicted for r in rows if not r.toxic)
    assert hits >= 0.85 * sum(r.toxic for r in rows) and wrong <= 0.01 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_words_of_no_clean_document_are_found_at_any_size(spark):
    """Insults that occur in toxic texts only; labels in equal parts, each share of the rows."""
    rows = [(k, f"{prose(k, 12)} {'filthscum' if k % 2 else ''}", k % 2) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    new = spark.createDataFrame([(1, prose(901, 12) + " filthscum"), (2, prose(902, 12))], "doc_id long, text string")
    found = {r.doc_id: r.score for r in toxicity.scores(new, toxicity.fit(docs)).collect()}
    assert found[1] > 0.5 > found[2]


def test_held_out_toxicity_of_a_small_table(spark):
    """Each fifth of the labelled documents scored by a model of the others."""
    small = SF.replace("sf0.1", "sf0.01")
    labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").join(labels, "doc_id").filter("label is not null").persist()
    hits = wrong = 0
    for k in range(5):
        held = crc_mod(F.col("doc_id"), 5) == k
        found = toxicity.scores(docs.filter(held), toxicity.fit(docs.filter(~held)))
        rows = found.join(docs.select("doc_id", "label"), "doc_id").collect()
        hits += sum(r.score >= 0.5 for r in rows if r.label)
        wrong += sum(r.score >= 0.5 for r in rows if not r.label)
    n, toxic = docs.count(), docs.filter("label = 1").count()
    docs.unpersist()
    print(f"{hits} of {toxic} found, {wrong} of {n - toxic} wrong")
    assert hits >= 0.7 * toxic and wrong <= 0.01 * n


def labelled(spark):
    """Insults are toxic; sentences that name one group are toxic more often in the sample."""
    r = random.Random(1)
    rows = []
    for k in range(600):
        toxic = k % 3 == 0
        words = prose(k, 12).split()
        if toxic:
            words.insert(3, r.choice(["filthscum", "vermin"]))
        if r.random() < (0.7 if toxic else 0.05):
            words.insert(5, "muslims")
        elif r.random() < 0.5:
            words.insert(5, r.choice(["christians", "jews"]))
        rows.append((k, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_swaps_reduce_the_weight_of_groups(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the muslims of the town"), (2, "the christians of the town"), (3, "the vermin of the town")], "doc_id long, text string")

    def gap():
        s = {r.doc_id: r.score for r in toxicity.scores(docs, toxicity.fit(labelled(spark))).collect()}
        return s[1] - s[2], s[3]

    fair, insult = gap()
    monkeypatch.setattr(toxicity.fit_weights, "__defaults__", (0.0,))
    unfair, _ = gap()
    assert insult > 0.5 and abs(fair) < 0.5 * unfair


def test_swapped_documents_are_counted(spark):
    named = labelled(spark).filter(r"text rlike '\\b(muslims|christians|jews)\\b'").count()
    assert toxicity.fit(labelled(spark)).n_swapped == named > 0
    assert toxicity.fit(labelled(spark).withColumn("text", F.regexp_replace("text", "muslims|christians|jews", "people"))).n_swapped == 0


def test_toxicity_edges(spark):
    model = toxicity.fit(labelled(spark))
    rows = toxicity.scores(documents(spark), model).collect()
    assert len(rows) == len(texts()) and all(0 <= r.score <= 1 for r in rows)
    constant = 1 / (1 + np.exp(-model.constant))
    assert all(abs(r.score - constant) < 1e-9 for r in rows if r.doc_id in (1, 2, 3))
    kept = toxicity.drop_toxic(documents(spark), model)
    assert kept.columns == documents(spark).columns and kept.first().score == "x"
    assert toxicity.drop_toxic(empty(spark), model).count() == 0
    one_sided = toxicity.fit(labelled(spark).filter("label = 0"))
    assert one_sided.constant < -5
    assert toxicity.fit(labelled(spark).limit(0)).constant == 0


def test_learning_rows(spark):
    labels = spark.createDataFrame([(10, 1), (10, 1), (11, 0), (12, 0), (12, 1), (None, 1), (13, None)], "doc_id long, toxic int")
    found = toxicity.labelled_rows(documents(spark), labels)
    crc = documents(spark).filter(F.col("doc_id").isin(10, 11)).filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    assert found.count() == crc.count() and "label" in found.columns


def slow_tiles(one, two, size):
    """Greedy string tiling by its definition."""
    marked_1, marked_2, found = set(), set(), []
    while True:
        best = (0, 0, 0)
        for d in range(len(one)):
            for i in range(len(two)):
                k = 0
                while d + k < len(one) and i + k < len(two) and one[d + k] == two[i + k] and d + k not in marked_1 and i + k not in marked_2:
                    k += 1
                if k > best[0]:
                    best = (k, d, i)
        if best[0] < size:
            return found
        found.append(best)
        marked_1.update(range(best[1], best[1] + best[0]))
        marked_2.update(range(best[2], best[2] + best[0]))


def test_tiles_follow_the_definition():
    r = random.Random(3)
    for _ in range(150):
        one, two = ([r.choice("abc") for _ in range(r.randint(0, 40))] for _ in range(2))
        matches = [(d, i) for d in range(len(one) - 2) for i in range(len(two) - 2) if one[d : d + 3] == two[i : i + 3]]
        assert tiling.tiles(matches, 3) == slow_tiles(one, two, 3)


def test_overlaps(spark):
    items = [(1, prose(70, 30)), (2, prose(71, 12)), (2, prose(71, 12)), (3, "too short"), (4, None), (5, ""), (None, prose(72, 20))]
    a, b = items[0][1].split()[:15], items[0][1].split()[15:]
    own = [
        (50, f"{prose(80, 40)} {items[0][1]} {prose(81, 10)}"), (51, " ".join(b) + " " + prose(82, 9) + " " + " ".join(a)), (52, " ".join(a[:9])),
        (53, items[1][1].upper().replace(" ", ", ")), (53, items[1][1].upper().replace(" ", ", ")), (54, items[6][1] + " end"), (55, prose(90, 3000)),
    ]
    rows = texts() + own
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit("x"))
    found = tiling.overlaps(documents(spark, rows), bench).collect()
    want = {}
    for i, t in rows:
        for k, item in items:
            one, two = tiling.normal(t).split(), tiling.normal(item).split()
            if len(one) > 1000 or len(two) < 5:
                continue
            tiles = slow_tiles(one, two, 5)
            if sum(x[0] for x in tiles) >= 0.5 * len(two):
                want[i, k] = (len(two), len(tiles), sum(x[0] for x in tiles))
    assert {(r.doc_id, r.item_id): (r.n_words, r.n_tiles, r.n_covered) for r in found} == want and len(found) == len(want)
    assert set(want) == {(50, 1), (51, 1), (53, 2), (54, None)} and want[51, 1] == (30, 2, 30)
    kept = tiling.drop_contaminated(documents(spark, rows), bench)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id and r.doc_id >= 50) == [52, 55]
    assert kept.count() == len(texts()) + 2 and kept.columns == documents(spark).columns
    assert tiling.overlaps(empty(spark), bench).count() == 0
    assert tiling.overlaps(documents(spark), bench.limit(0)).count() == 0
