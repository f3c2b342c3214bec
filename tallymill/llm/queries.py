"""Registered queries of this folder: one thin query per operator, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import chat, hypervectors, jaccard_join, lexical, line_dedup, merkle, odd_sketch, packing, quality, secrets, tiling, token_files, toxicity
from tallymill.llm.common import crc_mod
from tallymill.session import new_folder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.judge(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *quality.MEASURES
    )


def op2_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    return chat.repair(table(spark, sf, "conversations"))


def op3_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "token-files")
    token_files.write_files(table(spark, sf, "documents").select("doc_id", "text"), path, TOKENIZER)
    return token_files.read_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _equals(kind: str) -> Callable:
    return lambda other: other == kind


def op4_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.scan(table(spark, sf, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.BASE]
    kinds = F.transform("secrets", lambda s: s["kind"])
    counts = [F.array_size(F.filter(kinds, _equals(k))).cast("long").alias(f"n_{k}") for k in base]
    kept = F.filter("secrets", lambda s: s["kind"].isin(base))
    digest = F.sha2(secrets.as_text(kept).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, secrets.as_text(F.col("secrets")).alias("spans"))


def op5_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = line_dedup.drop_shared_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    profiles = hypervectors.prototypes(docs.filter(~held_out))
    found = hypervectors.identify(docs.drop("lang"), profiles)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"), shingle=4)


def op6_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    packed = packing.pack(table(spark, sf, "documents").select("doc_id", "text"), TOKENIZER)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(toxicity.labelled_rows(docs, table(spark, sf, "labels")))
    scored = toxicity.scores(docs, model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = tiling.overlaps(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "n_tiles", "n_covered", "coverage")


def op11_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf, "documents").select("doc_id", "text"))


def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(*merkle.FIELDS)
    # Wider than long, so that the largest long can be raised too.
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, more).otherwise(F.col("n_chars"))
    seen = merkle.leaf([changed if f == "n_chars" else F.col(f) for f in merkle.FIELDS])
    found = merkle.verified(merkle.manifest(merkle.leaves(docs, seen=seen)), "seen")
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_chat_format": op2_chat_format,
    "op3_token_files": op3_token_files,
    "op4_secret_scan": op4_secret_scan,
    "op5_line_dedup": op5_line_dedup,
    "op7_language": op7_language,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_lexical_search": op13_lexical_search,
    "pipeline": corpus_pipeline.run,
}

# Fixed values, written down here again and with the least lengths in the patterns:
# kind, pattern, group whose length counts, least length.
_KINDS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 0),
    ("hex", "[0-9a-f]{24,}", 0, 0),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", "AIza[0-9A-Za-z_-]{35}", 0, 0),
    ("stripe", "[sr]k_live_[0-9A-Za-z]{16,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)


def _kind_sql(place: int, kind: str, pattern: str, group: int, least: int) -> str:
    quoted = "'" + pattern.replace("\\'", "'").replace("'", "''") + "'"
    return f"""SELECT doc_id, '{kind}' AS kind, {place} AS place, {least} AS least, string_split_regex(t, {quoted}) AS gaps,
      regexp_extract_all(t, {quoted}, 0) AS whole, regexp_extract_all(t, {quoted}, {group}) AS part FROM texts"""


ORACLE: dict[str, str] = {
    "op4_secret_scan": f"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        found AS ({" UNION ALL ".join(_kind_sql(k, *row) for k, row in enumerate(_KINDS))}),
        each AS (SELECT doc_id, kind, place, least, gaps, whole, part, unnest(range(1, len(whole) + 1)) AS i FROM found WHERE len(whole) > 0),
        placed AS (SELECT doc_id, kind, place, length(part[i]) >= least AS good, length(whole[i]) AS size,
            list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS start FROM each),
        spans AS (SELECT doc_id, kind, place, start, kind || ':' || start || ':' || (start + size) AS s FROM placed WHERE good)
        SELECT t.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
            count(*) FILTER (kind = 'hex') AS n_hex,
            sha256(coalesce(string_agg(s, ',' ORDER BY start, place) FILTER (place < 3), '')) AS base_sha256,
            coalesce(string_agg(s, ',' ORDER BY start, place), '') AS spans
        FROM texts t LEFT JOIN spans p ON p.doc_id = t.doc_id GROUP BY t.doc_id
    """,
    "op5_line_dedup": r"""
        WITH split AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents
        ), lines AS (
            SELECT doc_id, unnest(all_lines) AS line, generate_subscripts(all_lines, 1) AS place FROM split
        ), keyed AS (
            SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
        ), shared AS (
            SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
        ), marked AS (
            SELECT keyed.*, shared.k IS NOT NULL AND doc_id <> last AS dropped FROM keyed LEFT JOIN shared ON keyed.k = shared.k
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op8_near_duplicates": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN
                list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                ELSE [array_to_string(w, ' ')] END) AS s FROM words WHERE len(w) > 0
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
            JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))
        ), reach AS (
            SELECT doc_id AS node, doc_id AS other FROM documents
            UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other
        )
        SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
        FROM documents d JOIN reach ON reach.node = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id GROUP BY d.doc_id
    """,
    "op11_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN
                list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                ELSE [array_to_string(w, ' ')] END) AS s FROM words WHERE len(w) > 0
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
            JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))
        ), reach AS (
            SELECT doc_id AS node, doc_id AS other FROM documents
            UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other
        )
        SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id
        FROM documents d JOIN reach ON reach.node = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id GROUP BY d.doc_id
    """,
    "op12_merkle_manifest": r"""
        WITH RECURSIVE crc_table AS (
            SELECT list_transform(range(256), lambda i: list_reduce(range(8),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS x
        ), marked AS (
            SELECT *, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
                lambda c, b: xor(x[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 7 = 0 AS hit FROM documents, crc_table
        ), written AS (
            SELECT doc_id, lang, hit,
                coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                    || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS own,
                coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS raised,
                coalesce(strlen(text) || ':' || text, '-') AS tail FROM marked
        ), leaves AS (
            SELECT doc_id, lang, sha256(head || own || tail) AS leaf, sha256(head || CASE WHEN hit THEN raised ELSE own END || tail) AS seen,
                row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS size FROM written
        ), trees AS (
            SELECT lang, size, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER () AS trees FROM (SELECT DISTINCT lang, size FROM leaves)
        ), lower_nodes AS (
            SELECT tree, 0 AS level, place, leaves.size AS size, leaf AS digest FROM leaves JOIN trees ON leaves.lang IS NOT DISTINCT FROM trees.lang
            UNION ALL
            SELECT tree, max(level) + 1, place // 2, max((size + 1) // 2), sha256(string_agg(digest, '' ORDER BY place)) FROM lower_nodes
            WHERE size > 1 GROUP BY tree, place // 2
        ), upper_nodes AS (
            SELECT 0 AS level, tree AS place, trees AS size, digest FROM lower_nodes JOIN trees USING (tree) WHERE lower_nodes.size = 1
            UNION ALL
            SELECT max(level) + 1, place // 2, max((size + 1) // 2), sha256(string_agg(digest, '' ORDER BY place)) FROM upper_nodes
            WHERE size > 1 GROUP BY place // 2
        ), steps AS (
            SELECT doc_id, n.level AS level, l.place >> n.level AS spot, s.digest AS sibling FROM leaves l JOIN trees t ON l.lang IS NOT DISTINCT FROM t.lang
            JOIN (SELECT DISTINCT tree, level FROM lower_nodes WHERE size > 1) n ON n.tree = t.tree
            LEFT JOIN lower_nodes s ON s.tree = t.tree AND s.level = n.level AND s.place = xor(l.place >> n.level, 1)
            UNION ALL
            SELECT doc_id, 1000 + n.level, t.tree >> n.level, s.digest FROM leaves l JOIN trees t ON l.lang IS NOT DISTINCT FROM t.lang
            CROSS JOIN (SELECT DISTINCT level FROM upper_nodes WHERE size > 1) n
            LEFT JOIN upper_nodes s ON s.level = n.level AND s.place = xor(t.tree >> n.level, 1)
        ), proofs AS (
            SELECT doc_id, list({'spot': spot, 'sibling': sibling} ORDER BY level) AS steps,
                sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256 FROM steps GROUP BY doc_id
        ), folds AS (
            SELECT doc_id, seen AS digest, coalesce(steps, []) AS steps, 1 AS k FROM leaves LEFT JOIN proofs USING (doc_id)
            UNION ALL
            SELECT doc_id, sha256(CASE WHEN steps[k].sibling IS NULL THEN digest WHEN steps[k].spot & 1 = 1 THEN steps[k].sibling || digest
                ELSE digest || steps[k].sibling END), steps, k + 1 FROM folds WHERE k <= len(steps)
        )
        SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
            f.digest AS folded_root, f.digest = r.digest AS verified
        FROM leaves l JOIN trees t ON l.lang IS NOT DISTINCT FROM t.lang JOIN lower_nodes s ON s.tree = t.tree AND s.size = 1
        JOIN upper_nodes r ON r.size = 1 JOIN folds f ON f.doc_id = l.doc_id AND f.k = len(f.steps) + 1 LEFT JOIN proofs p ON p.doc_id = l.doc_id
    """,
    "op13_lexical_search": r"""
        WITH texts AS (
            SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
        ), terms AS (
            SELECT kind, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts
        ), counted AS (
            SELECT id AS doc_id, term, count(*) AS tf FROM terms WHERE kind = 'd' GROUP BY id, term
        ), sizes AS (
            SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY doc_id
        ), whole AS (
            SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes
        ), weights AS (
            SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counted, whole GROUP BY term
        ), scored AS (
            SELECT i.id AS item_id, c.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
            FROM (SELECT DISTINCT id, term FROM terms WHERE kind = 'i') i JOIN counted c ON c.term = i.term
            JOIN weights ON weights.term = i.term JOIN sizes ON sizes.doc_id = c.doc_id CROSS JOIN whole GROUP BY i.id, c.doc_id
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
    """,
}
