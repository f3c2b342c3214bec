import random
from functools import lru_cache

from pyspark.sql import functions as F

from tallymill.llm import chat

LEGAL = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def least_cost(roles):
    """Least cost of making the turns legal, by trying everything."""

    @lru_cache(None)
    def best(k, state, inserts):
        found = [0] if k == len(roles) and state == "assistant" else []
        if inserts < 3:
            found += [chat.INSERT + best(k, r, inserts + 1) for r in LEGAL[state]]
        if k < len(roles):
            for r in chat.ROLES:
                label = 0 if roles[k] == r else chat.RELABEL
                if r in LEGAL[state]:
                    found.append(label + best(k + 1, r, 0))
                if r == state:
                    found.append(chat.MERGE + label + best(k + 1, r, 0))
        return min(found, default=10**6)

    for k in range(len(roles), 0, -1):  # from the end, so that the recursion stays flat
        for state in LEGAL:
            best(k, state, 0)
    return best(0, None, 0)


def turns(spark, conversations):
    rows = [(c, k, role, text, "x", 0) for c, held in conversations.items() for k, (role, text) in enumerate(held)]
    schema = "conv_id long, turn int, role string, text string, row string, piece int"
    return spark.createDataFrame(rows, schema).repartition(5) if rows else spark.createDataFrame([], schema)


def parse(text):
    assert text.endswith(chat.CLOSE)
    found = [x.split("\n", 1) for x in text.removesuffix(chat.CLOSE).split(chat.CLOSE)]
    return [(head.removeprefix("<|im_start|>"), body) for head, body in found]


def check(found, conversations):
    for c, held in conversations.items():
        legal, state = parse(found[c].text), None
        for role, _ in legal:
            assert role in LEGAL[state], (c, legal)
            state = role
        assert state == "assistant"
        assert "".join(body.replace(chat.JOIN, "") for _, body in legal) == "".join((t or "") for _, t in held)
        assert found[c].cost == least_cost(tuple((r or "").strip().lower() for r, _ in held)), held


def test_repairs_cost_least(spark):
    r = random.Random(1)
    roles = ["user", "assistant", "system", "User ", "tool", None]
    conversations = {c: [(r.choice(roles[: r.choice([2, 3, 6])]), r.choice(["hello", "", None, "é日本"]) if k else f"t{c}") for k in range(r.randint(1, 9))] for c in range(250)}
    pieces = chat.repair(turns(spark, conversations))
    check({x.conv_id: x for x in chat.whole(pieces).collect()}, conversations)
    numbers = pieces.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("piece").alias("last"), F.count_distinct("piece").alias("d")).collect()
    assert all(x.n == x.d == x.last + 1 for x in numbers)
    starts = pieces.filter(F.col("rendered").contains("<|im_start|>")).groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn_no").alias("last")).collect()
    assert all(x.n == x.last + 1 for x in starts)


def test_long_conversation_over_many_partitions(spark):
    r = random.Random(2)
    conversations = {c: [(r.choice(["user", "assistant", "system"]), f"{c}.{k} ") for k in range(n)] for c, n in ((1, 3), (2, 700), (3, 2), (4, 400), (5, 1))}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = chat.repair(turns(spark, conversations))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spread = pieces.filter("conv_id = 2").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread > 2
    check({x.conv_id: x for x in chat.whole(pieces).collect()}, conversations)


def test_legal_conversations_stay(spark):
    held = [("system", "s"), ("user", "u"), ("assistant", "a")]
    found = chat.whole(chat.repair(turns(spark, {1: held}))).first()
    assert found.cost == 0 and parse(found.text) == held


def test_edges(spark):
    assert chat.repair(turns(spark, {})).count() == 0
    rows = [(None, None, None, None), (None, 1, "user", "x"), (7, 2, "assistant", "b"), (7, 1, "user", "a"), (7, 1, "user", "a")]
    found = {x.conv_id: x for x in chat.whole(chat.repair(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).collect()}
    assert parse(found[7].text) == [("user", "a" + chat.JOIN + "a"), ("assistant", "b")] and found[7].cost == chat.MERGE
    assert [r for r, _ in parse(found[None].text)] == ["user", "assistant"] and found[None].cost == 2 * chat.RELABEL
