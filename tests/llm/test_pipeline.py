"""The stages of the corpus pipeline, each against a brute-force version on its own input."""

import corpus_pipeline
from cases import documents, empty, groups, without_shared_lines
from test_documents import check_packing, multiset
from test_learning import slow_tiles

from tallymill.llm import tiling, toxicity
from tallymill.session import stored

SF = "/root/testdata/sf0.001"


def brute_leaks(rows, items):
    """Places of the rows that hold half of an item in tiles."""
    items = [tiling.normal(t).split() for _, t in items]
    found = set()
    for k, (_, t) in enumerate(rows):
        words = tiling.normal(t).split()
        grams = {tuple(words[j : j + 5]) for j in range(len(words) - 4)}
        for item in items:
            if len(item) >= 5 and any(tuple(item[j : j + 5]) in grams for j in range(len(item) - 4)):
                if len(words) > 400 and b" ".join(item) in b" ".join(words):
                    found.add(k)  # the whole item as one tile
                elif sum(x[0] for x in slow_tiles(words, item, 5)) >= 0.5 * len(item):
                    found.add(k)
    return found


def run_stages(spark, docs, sf):
    given, name_of = {}, [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES:
        given[name] = docs
        docs = stored(stage(spark, docs, sf), name)
    return given, docs, name_of


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given, packed, names = run_stages(spark, docs, SF)
    assert names == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    for name in names[1:]:
        assert given[name].schema == docs.schema
    model = toxicity.fit(toxicity.labelled_rows(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    clean = {r.doc_id for r in toxicity.scores(docs, model).collect() if r.score < 0.5}
    assert multiset(pairs(given["line_dedup"])) == multiset(p for p in pairs(docs) if p[0] in clean)

    rows = pairs(given["line_dedup"])
    assert multiset(pairs(given["near_duplicates"])) == multiset((i, t) for (i, _), (_, _, t) in zip(rows, without_shared_lines(rows), strict=True))
    assert all(r.n_chars == len(r.text) for r in given["near_duplicates"].collect())

    rows = pairs(given["near_duplicates"])
    ids, sizes, _ = groups(rows, 5)
    assert multiset(pairs(given["decontamination"])) == multiset(r for r, c, n in zip(rows, ids, sizes, strict=True) if r[0] == c or not n)

    rows = pairs(given["decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = brute_leaks(rows, items)
    assert multiset(pairs(given["packing"])) == multiset(r for k, r in enumerate(rows) if k not in leaks)

    used, bound = check_packing(packed.collect(), pairs(given["packing"]))
    assert used <= bound * 1.05 + 2


def test_stages_on_awkward_and_empty_tables(spark):
    given, packed, _ = run_stages(spark, documents(spark), SF)
    assert all(g.columns == documents(spark).columns for g in given.values()) and packed.count() > 0
    _, packed, _ = run_stages(spark, empty(spark), SF)
    assert packed.count() == 0
