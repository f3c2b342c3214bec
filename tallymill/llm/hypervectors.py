"""Language identification with hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import mixed, small_batches, stored, text_batches, tidy

DIMENSION = 1024
GRAM = 3
UNKNOWN = "und"


class Profiler:
    """Vectors of texts. Each letter (and the gap between words) has a random vector of -1
    and 1, the same in every task. A trigram's vector binds those of its letters, shifted by
    their place in it; a text's vector is the sum over its trigrams, of length 1."""

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension
        self.row: dict[int, int] = {}
        self.letters: dict[int, bool] = {}
        self.tables = [np.zeros((0, dimension), dtype=np.int8) for _ in range(GRAM)]

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        different, which = np.unique(codes, return_inverse=True)
        new = [c for c in different.tolist() if c not in self.row]
        if new:
            words = mixed(np.array(new, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(self.dimension // 64, dtype=np.uint64))
            bits = np.unpackbits(mixed(words + np.uint64(1)).astype("<u8").view(np.uint8).reshape(len(new), -1), axis=1)
            vectors = bits.astype(np.int8) * np.int8(2) - np.int8(1)
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            for k in range(GRAM):
                self.tables[k] = np.concatenate((self.tables[k], np.roll(vectors, GRAM - 1 - k, axis=1)))
        return np.array([self.row[c] for c in different.tolist()])[which]

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Different trigrams, as rows of the letter tables, with their counts; None for a
        text without a letter."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le"), dtype=np.uint32)
        different, which = np.unique(codes, return_inverse=True)
        for c in different.tolist():
            if c not in self.letters:
                self.letters[c] = chr(c).isalpha()
        letter = np.array([self.letters[c] for c in different.tolist()], dtype=bool)[which]
        if not letter.any():
            return None
        codes = np.concatenate(([32], np.where(letter, codes, 32), [32])).astype(np.int64)
        codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
        keys = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
        keys, counts = np.unique(keys, return_counts=True)
        letters = np.stack([keys >> 42, (keys >> 21) & 0x1FFFFF, keys & 0x1FFFFF], axis=1)
        return self._rows(letters.ravel()).reshape(-1, GRAM), counts

    def vector(self, text: str | None) -> np.ndarray | None:
        found = self.grams(text)
        if found is None:
            return None
        rows, counts = found
        total = np.zeros(self.dimension, dtype=np.float32)
        for start in range(0, len(rows), 512):
            part = rows[start : start + 512]
            bound = self.tables[0][part[:, 0]]
            for k in range(1, GRAM):
                bound *= self.tables[k][part[:, k]]
            total += counts[start : start + 512].astype(np.float32) @ bound.astype(np.float32)
        size = float(np.linalg.norm(total))
        return total / size if size else None


def _partial_sums(dimension: int):
    """One row per language of the task: the sum of its documents' vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, sums = Profiler(dimension), {}
        for batch in (part for b in batches for part in text_batches(b)):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                vector = profiler.vector(text)
                if vector is not None:
                    if lang not in sums:
                        sums[lang] = np.zeros(dimension)
                    sums[lang] += vector
        rows = pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), rows], ["lang", "profile"])

    return run


def prototypes(learn: DataFrame, dimension: int = DIMENSION) -> dict[str, np.ndarray]:
    """Language -> profile of length 1, from (text, lang); rows of a null language or without
    a letter teach nothing. Only sums travel: one row per task and language."""
    sums = learn.filter(F.col("lang").isNotNull()).select("text", "lang").mapInArrow(tidy(_partial_sums(dimension)), "lang string, profile array<double>")
    sums = sums.groupBy("lang").agg(Summarizer.sum(array_to_vector("profile")).alias("total"))
    with small_batches(learn.sparkSession):
        rows = sums.select("lang", vector_to_array("total").alias("total")).collect()
    found = {r.lang: np.array(r.total) for r in sorted(rows, key=lambda r: r.lang)}
    return {lang: v / (np.linalg.norm(v) or 1.0) for lang, v in found.items()}


def _predictions(profiles: dict[str, np.ndarray], dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, names = Profiler(dimension), list(profiles)
        matrix = np.array([profiles[n] for n in names], dtype=np.float32).reshape(len(names), dimension)
        for batch in (part for b in batches for part in text_batches(b)):
            found, score = [], []
            for text in batch.column("text").to_pylist():
                vector = profiler.vector(text) if names else None
                if vector is None:
                    found.append(UNKNOWN)
                    score.append(0.0)
                    continue
                cosines = matrix @ vector
                best = int(cosines.argmax())
                found.append(names[best])
                score.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], dimension: int = DIMENSION) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of `docs` (doc_id, text, any other columns):
    the language whose profile has the largest cosine with the text's vector, the first by
    name of equal ones, and that cosine (0 if negative). `und` and 0 for a null or empty
    text, one without a letter, or if no language was learned."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(tidy(_predictions(profiles, dimension)), "doc_id long, lang_pred string, score double")
    return stored(found, "languages")
