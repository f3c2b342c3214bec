"""Merkle manifest of a table: a digest tree per group, one root above them, and a proof for each row.

The trees are worked through by time-forward processing. Nodes are labelled by the last leaf
below them, then by their height, so children come before parents. A sweep over the leaves in
order of label puts each digest into a priority queue under its parent's label and takes out
what is due; a sweep in reversed order hands each node's proof suffix to its children. A task
sweeps aligned blocks of BLOCK leaves, so its queue holds a message per height. Messages that
leave a block are written to the shared folder and sorted there by label for the next round:
that table is the external part of the queue.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from tallymill.functions.joins import if_small
from tallymill.functions.ranking import ROW_BITS, with_position
from tallymill.llm.common import stored, tidy

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Heights that one round works through, and the leaves of a block.
HEIGHTS = 12
BLOCK = 1 << HEIGHTS
# A proof has a mark for each height, and behind LEFT and RIGHT the digest of the sibling there.
ALONE, LEFT, RIGHT = "-", "L", "R"
DIGEST = 64

UP = "tree long, place long, nodes long, digest string"


def leaf(values: Sequence[Column]) -> Column:
    """Hex sha256 of the values as text: `-` for a null, else byte count, `:`, value."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", key: str = "doc_id", **more: Column) -> DataFrame:
    """(group, key, leaf, and `more` columns) of each row of `docs`, for `manifest`."""
    own = leaf([F.col(f) for f in fields]).alias("leaf")
    return docs.select(F.col(group).alias("group"), F.col(key).alias("key"), own, *[c.alias(name) for name, c in more.items()])


def hashed(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(nodes: int) -> int:
    """Heights above `nodes` leaves up to the root; a lone leaf is its own root."""
    return (nodes - 1).bit_length()


def sweep(digests: Sequence[str], top: int, known: dict | None = None) -> str:
    """Digest of the node at height `top` over the given leaves. `known` takes the digest of
    every node (height, place)."""
    last = len(digests) - 1
    queue: list[tuple] = []

    def send(level: int, place: int, digest: str) -> None:
        if known is not None:
            known[level, place] = digest
        above = place >> 1
        label = min(((above + 1) << (level + 1)) - 1, last), level + 1
        heapq.heappush(queue, (*label, above, place, digest))

    for place, digest in enumerate(digests):
        if not top:
            return digest
        send(0, place, digest)
        while queue and queue[0][0] <= place:
            _, level, above, _, one = heapq.heappop(queue)
            parts = [one]
            while queue and queue[0][1:3] == (level, above):
                parts.append(heapq.heappop(queue)[4])
            if level == top:
                if known is not None:
                    known[level, above] = hashed(parts)
                return hashed(parts)
            send(level, above, hashed(parts))
    raise ValueError("no leaves")


def suffixes(digests: Sequence[str], top: int, above: str) -> list[str]:
    """The proof of each leaf, in order; `above` is that of the node at height `top` over them."""
    known: dict = {}
    sweep(digests, top, known)
    last = len(digests) - 1
    out = [above] * len(digests)
    # Largest label first: the suffix of a node lies in the queue until its turn comes.
    queue = [(-last, -top, 0, above)]
    while queue:
        _, level, place, suffix = heapq.heappop(queue)
        level = -level
        if not level:
            out[place] = suffix
            continue
        for child in (2 * place, 2 * place + 1):
            if (child << (level - 1)) > last:
                continue
            sibling = known.get((level - 1, child ^ 1)) if ((child ^ 1) << (level - 1)) <= last else None
            mark = ALONE if sibling is None else (LEFT if child & 1 else RIGHT) + sibling
            end = min(((child + 1) << (level - 1)) - 1, last)
            heapq.heappush(queue, (-end, 1 - level, child, mark + suffix))
    return out


def fold(digest: str, proof: str) -> str:
    """The root that a leaf and the siblings of its proof give."""
    at = 0
    while at < len(proof):
        mark = proof[at]
        if mark == ALONE:
            digest, at = hashed([digest]), at + 1
            continue
        sibling = proof[at + 1 : at + 1 + DIGEST]
        digest, at = hashed([sibling, digest] if mark == LEFT else [digest, sibling]), at + 1 + DIGEST
    return digest


def siblings(proof: str) -> str:
    """The digests of a proof, without its marks."""
    return proof.replace(ALONE, "").replace(LEFT, "").replace(RIGHT, "")


def _blocks(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[dict[str, list]]:
    """The rows of each (tree, block), as lists by name, of rows sorted by (tree, block, place)."""
    held: dict[str, list] = {}
    at = None
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in (*names, "tree", "block")}
        keys = list(zip(columns["tree"], columns["block"], strict=True))
        start = 0
        for k in range(1, len(keys) + 1):
            if k < len(keys) and keys[k] == keys[start]:
                continue
            if keys[start] != at:
                if held:
                    yield held
                at, held = keys[start], {c: [] for c in columns}
            for c, values in columns.items():
                held[c] += values[start:k]
            start = k
    if held:
        yield held


def _upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []

    def out() -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], ["tree", "place", "nodes", "digest"])

    for block in _blocks(batches, ("place", "nodes", "digest")):
        nodes = block["nodes"][0]
        digest = sweep(block["digest"], min(HEIGHTS, height(nodes)))
        rows.append((block["tree"][0], block["block"][0], -(-nodes // BLOCK), digest))
        if len(rows) == 1000:
            yield out()
            rows = []
    if rows:
        yield out()


def _downward(schema: pa.Schema):
    """Of rows sorted by (tree, block, place), with the block's message at place -1: its other
    rows with their proofs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [f.name for f in schema if f.name != "proof"]
        for block in _blocks(batches, [*given, "above"]):
            if len(block["place"]) < 2 or block["place"][0] != -1:
                raise ValueError("a block lacks its message")
            top = min(HEIGHTS, height(block["nodes"][1]))
            proofs = suffixes(block["digest"][1:], top, block["above"][0])
            columns = {c: block[c][1:] for c in given}
            for c in ("root", "subroot"):
                columns[c] = [block[c][0]] * len(proofs)
            columns["proof"] = proofs
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    return run


def _with_texts(rows: DataFrame, *names: str) -> StructType:
    """The columns of `rows` and texts of these names, all with nulls."""
    return StructType([StructField(f.name, f.dataType) for f in rows.schema] + [StructField(n, StringType()) for n in names])


def _up(nodes: DataFrame) -> DataFrame:
    rows = nodes.select("tree", "place", "nodes", "digest", F.shiftright("place", HEIGHTS).alias("block"))
    rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
    return stored(rows.mapInArrow(tidy(_upward), UP), "digests")


def _raised(nodes: DataFrame) -> list[DataFrame]:
    """The nodes at the foot of each round, and the root of each tree last."""
    rounds = [nodes]
    while rounds[-1].filter("nodes > 1").head(1):
        rounds.append(_up(rounds[-1]))
    return rounds


def _down(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """`rows` with root, subroot and proof, of the messages (tree, place of the block, root,
    subroot, above) from the round above."""
    given = rows.withColumn("block", F.shiftright("place", HEIGHTS))
    sent = messages.select("tree", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), "root", "subroot", F.col("proof").alias("above"))
    both = given.unionByName(sent, allowMissingColumns=True)
    both = both.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
    wanted = _with_texts(rows, "root", "subroot", "proof")
    return both.mapInArrow(tidy(_downward(to_arrow_schema(wanted))), wanted)


def _placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with (tree, place, nodes): number of the group, place in it from 0, rows of the
    group; and the groups with their numbers. Equal rows are told apart by a number of their own."""
    numbered = stored(rows.withColumn("_own", F.monotonically_increasing_id()), "leaves")
    order = ["group", "key", "leaf", "_own"]
    ordered = numbered.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ordered = stored(ordered.withColumn("_part", F.shiftright("_at", ROW_BITS)).drop("_own"), "ordered-leaves")
    # One row for each group of a sorted partition: no more than partitions and groups together.
    parts = ordered.groupBy("_part", "group").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    of_group = Window.partitionBy("group")
    before = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(
        parts.select("_part", "group", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(of_group).alias("nodes")),
        "leaf-parts",
    )
    groups = with_position(parts.groupBy("group").agg(F.first("nodes").alias("nodes")), "group", name="tree")
    groups = stored(groups.select("group", (F.col("tree") - 1).alias("tree"), F.col("tree_count").alias("trees")), "trees")
    numbers = groups.select(F.col("group").alias("_group"), "tree")
    parts = parts.join(if_small(numbers), parts["group"].eqNullSafe(F.col("_group"))).drop("_group", "_rows")
    parts = stored(parts.withColumnsRenamed({"_part": "_of", "group": "_in"}), "leaf-offsets")
    same = (ordered["_part"] == parts["_of"]) & ordered["group"].eqNullSafe(parts["_in"])
    placed = ordered.join(if_small(parts), same).withColumn("place", F.col("_at") - F.col("_first") + F.col("_before"))
    return placed.drop("_part", "_of", "_in", "_at", "_first", "_before"), groups


def manifest(rows: DataFrame) -> DataFrame:
    """Adds (subroot, root, proof) to each of `rows` (group, key, leaf, any other columns but
    tree, place, nodes, digest, block, above and names with a leading underscore).

    The leaves of a group ascend by key. While a group has several nodes, every two
    consecutive ones become the sha256 of their hex digests, the last one alone if their
    number is odd; what remains, or a lone leaf itself, is `subroot`. The subroots, ordered by
    group, give `root` in the same way. `proof` has the siblings from the leaf up to the root,
    see `fold` and `siblings`.

    - A null group is the first one, a null key the first of its group.
    - Leaves of one key are ordered by digest, and equal rows are leaves beside each other.
    - An empty table gives an empty table.
    """
    placed, groups = _placed(rows)
    feet = stored(placed.withColumnRenamed("leaf", "digest"), "placed-leaves")
    rounds = _raised(feet)
    subroots = rounds[-1]
    tops = subroots.join(if_small(groups.select("tree", "trees")), "tree")
    tops = tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("trees").alias("nodes"), "digest")
    upper = _raised(stored(tops, "subroots"))

    digest = F.col("digest")
    message = upper[-1].select("tree", "place", "nodes", "digest", digest.alias("root"), F.lit(None).cast("string").alias("subroot"), F.lit("").alias("proof"))
    for nodes in reversed(upper[:-1]):
        message = stored(_down(nodes, message), "proofs")
    # A subroot stands for its whole tree in the rounds below.
    message = message.select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("place"), "root", digest.alias("subroot"), "proof")
    for nodes in reversed(rounds[1:-1]):
        message = stored(_down(nodes, message), "proofs")
    if len(rounds) > 1:
        found = _down(feet, message)
    else:
        found = feet.join(message.drop("place"), "tree")
    return found.select(*[digest.alias("leaf") if c == "leaf" else F.col(c) for c in rows.columns], "subroot", "root", "proof")


def verified(found: DataFrame, leaf_column: str = "leaf", fold_of: Callable[[str, str], str] = fold) -> DataFrame:
    """Adds to rows of a manifest (`leaf_column`, root, proof): proof_sha256, the digest of the
    proof's siblings, folded_root, which the leaf in `leaf_column` and the siblings give, and
    whether it is the root."""
    given, wanted = found.columns, _with_texts(found, "proof_sha256", "folded_root")
    schema = to_arrow_schema(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proofs, own = batch.column("proof").to_pylist(), batch.column(leaf_column).to_pylist()
            columns = [batch.column(c).cast(schema.field(c).type) for c in given]
            columns.append(pa.array([hashed([siblings(p)]) for p in proofs], pa.string()))
            columns.append(pa.array([fold_of(d, p) for d, p in zip(own, proofs, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return found.mapInArrow(tidy(run), wanted).withColumn("verified", F.col("folded_root") == F.col("root"))
