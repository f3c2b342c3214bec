"""Secret scan with a trigram inverted index. Only DataFrame functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import stored
from tallymill.llm.trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern`, leftmost and not overlapping, whose `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules, in their order.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
# Public formats of keys.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE

_SPAN = "struct<start:int,place:int,end:int>"


def _key(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text")]


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index, for the trigrams that the rules ask for: (gram, _id, _text), one
    row for each different text and trigram that it has in either case."""
    lower = F.lower("text")
    present = F.array(*[F.when(F.contains(lower, F.lit(g)), F.lit(k)) for k, g in enumerate(grams)])
    return docs.select(*_key(docs), F.explode(F.array_compact(present)).alias("gram"))


def candidates(index: DataFrame, grams: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """(_id, _text, rules): the rules, by place, whose trigram query the text's postings meet."""
    place = {g: k for k, g in enumerate(grams)}
    held = index.groupBy("_id", "_text").agg(F.collect_set("gram").alias("grams"))

    def met(rule: Rule) -> Column:
        options = [F.array(*[F.lit(place[g]) for g in sorted(option)]) for option in trigram_query(rule.pattern)]
        return reduce(lambda a, b: a | b, [F.array_size(F.array_except(o, F.col("grams"))) == 0 for o in options])

    which = [F.when(met(r), F.lit(k)) for k, r in enumerate(rules) if trigram_query(r.pattern)]
    found = held.select("_id", "_text", F.array_compact(F.array(*which)).alias("rules"))
    return found.filter(F.array_size("rules") > 0)


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """Spans of the rule's matches, from the lengths of the matches and of what lies between."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = whole if not rule.group else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    matches = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(part, F.length).alias("checked"))
    none = F.array().cast(f"array<{_SPAN}>")
    empty = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(state: Column, match: Column) -> Column:
        start = state["at"] + match["gap"]
        end = start + F.coalesce(match["size"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end"))
        spans = F.when(match["checked"] >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    found = F.aggregate(matches, empty, step, lambda state: state["spans"])
    return F.when(text.rlike(_long_enough(rule)), found).otherwise(none)


def _long_enough(rule: Rule) -> str:
    """A pattern that every text with a span matches, quicker to fail than the rule's own."""
    if rule.pattern.endswith("+") and not rule.group:
        return f"{rule.pattern[:-1]}{{{rule.least - len(rule.pattern.split('[')[0])},}}"
    return rule.pattern


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows of `docs` (doc_id, text, any other columns) with `secrets`, in place of a
    column of that name: the spans of all rules as structs (kind, start, end), in code
    points, end exclusive, by start and then by the rules' order.

    Each rule's expression gives a Boolean query of trigrams that any match must have. The
    postings of these trigrams are gathered per text, the queries are checked on them, and
    only the rules that a text may match are run on it. Rules without such trigrams (hex)
    read every text.

    - A null or empty text has no spans; an empty table gives an empty table.
    - Rows with the same id and text share their postings and each get their spans.
    """
    grams = sorted({g for r in rules for option in trigram_query(r.pattern) for g in option})
    rows = docs.select(*_key(docs), F.struct("*").alias("_row"))
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    if grams:
        may = stored(candidates(postings(docs, grams), grams, rules), "candidates")
        same = rows["_id"].eqNullSafe(may["_id"]) & (rows["_text"] == may["_text"])
        rows = rows.join(may, same, "left").select("_row", "rules")
    else:
        rows = rows.select("_row", F.array().cast("array<int>").alias("rules"))
    none = F.array().cast(f"array<{_SPAN}>")
    found = []
    for k, rule in enumerate(rules):
        spans = _spans(text, rule, k)
        if trigram_query(rule.pattern):
            spans = F.when(F.coalesce(F.array_contains("rules", k), F.lit(False)), spans).otherwise(none)
        found.append(spans)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    ordered = F.array_sort(F.concat(*found))
    named = F.transform(ordered, lambda s: F.struct(F.get(kinds, s["place"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    given = [F.col(f"_row.`{c}`") for c in docs.columns if c != "secrets"]
    return rows.select(*given, named.alias("secrets"))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
