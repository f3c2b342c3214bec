"""Lines that many documents share, dropped from all of them but one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import hot_join, stored

MIN_CHARS = 20
MIN_DOCS = 3
_BLANKS = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_BLANKS)), _UPPER, _LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Places of the lines to drop: (_id, _text, places). `_text` is a hash that tells apart
    different texts under one id."""
    lines = docs.select(
        F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), F.posexplode(lines_of(F.col("text"))).alias("place", "line")
    ).withColumn("line", line_key(F.col("line")))
    lines = lines.filter(F.length("line") >= min_chars)
    per_text = lines.groupBy(F.unhex(F.md5("line")).alias("line"), "_id", "_text").agg(F.collect_list("place").alias("places"))
    per_text = stored(per_text, "lines")
    shared = per_text.groupBy("line").agg(F.count("*").alias("n"), F.max("_id").alias("last")).filter(F.col("n") >= min_docs)
    found = hot_join(per_text, stored(shared, "shared-lines"), "line", "n")
    # A null id is smaller than any other.
    dropped = found.filter(F.col("last").isNotNull() & ~F.col("_id").eqNullSafe(F.col("last")))
    return dropped.groupBy("_id", "_text").agg(F.flatten(F.collect_list("places")).alias("places"))


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All rows of `docs` (doc_id, text, any other columns), `text` without the lines whose
    key has `min_chars` code points or more and is found in `min_docs` documents or more,
    except in the document with the largest id that holds the line. Adds n_lines (before
    dropping) and n_dropped, in place of columns of these names.

    Lines are exploded, keyed and hashed to 128 bits; documents are counted per hash; what
    is to be dropped goes back to each text as places, and the text is put together again
    from the other places.

    - A null text has one empty line and becomes an empty text, as does one that loses all.
    - Rows equal in id and text count as one document and lose the same lines; other texts
      under the same id count as other documents, and all of them keep the line if the id
      is the largest. A null id is the smallest; lines found only under null ids stay.
    - An empty table gives an empty table.
    """
    places = shared_lines(docs, min_chars, min_docs)
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), F.struct("*").alias("_row"))
    same = rows["_id"].eqNullSafe(places["_id"]) & (rows["_text"] == places["_text"])
    both = rows.join(places, same, "left").select("_row", "places", lines_of(F.col("_row.text")).alias("_lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.array_size("_lines") - 1), F.col("places"))
    text = F.array_join(F.transform(stay, lambda place: F.get(F.col("_lines"), place)), "\n")
    kept = F.when(F.col("places").isNull(), F.coalesce("_row.text", F.lit(""))).otherwise(text)
    counts = [F.array_size("_lines").cast("long").alias("n_lines"), F.coalesce(F.array_size("places"), F.lit(0)).cast("long").alias("n_dropped")]
    given = [kept.alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return both.select(*given, *counts)
