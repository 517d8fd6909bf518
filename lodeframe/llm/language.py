"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1.  A run of three letters is the
product of their vectors, each rotated by its place, so its vector is unlike
those of other runs; a text is the sum of the vectors of its runs, and a language
the sum of its training texts.  A text gets the language whose sum points most in
its direction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.frames import mapped
from lodeframe.llm.quality import held_out

DIMENSIONS = 1024
RUN = 3
#: Most rows that are learned from, taken by a hash of their id.
TRAIN_ROWS = 20_000
SALTS = 8
UNKNOWN = "und"
#: Texts bundled at once, and runs remembered by a worker.
TEXTS = 64
CACHE_RUNS = 40_000

_letters: dict[int, np.ndarray] = {}
_runs: dict[int, np.ndarray] = {}


def letter_vector(code: int) -> np.ndarray:
    if code not in _letters:
        _letters[code] = np.random.default_rng(1_000_003 + code).integers(0, 2, DIMENSIONS, dtype=np.int8) * np.int8(2) - np.int8(1)
    return _letters[code]


def run_vector(key: int) -> np.ndarray:
    """Bound vector of three code points packed into ``key``."""
    if key not in _runs:
        if len(_runs) >= CACHE_RUNS:
            _runs.clear()
        out = np.ones(DIMENSIONS, np.int8)
        for place in range(RUN):
            out = out * np.roll(letter_vector((key >> 21 * (RUN - 1 - place)) & 0x1FFFFF), place)
        _runs[key] = out
    return _runs[key]


def run_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct runs of three letters and their counts, words parted by one space; None without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    kinds, at = np.unique(codes, return_inverse=True)
    letter = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in kinds.tolist()], bool)
    if not letter.any():
        return None
    codes = np.where(letter[at], codes, 32)
    codes = np.concatenate(([32], codes, [32]))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = codes[keep]
    return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)


def bundle(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors of texts, which have letters)."""
    out, has = np.zeros((len(texts), DIMENSIONS), np.float32), np.zeros(len(texts), bool)
    for first in range(0, len(texts), TEXTS):
        found = [(i, c) for i, t in enumerate(texts[first : first + TEXTS]) if (c := run_counts(t)) is not None]
        if not found:
            continue
        keys = np.unique(np.concatenate([c[0] for _, c in found]))
        counts = np.zeros((len(found), len(keys)), np.float32)
        for row, (_, (k, n)) in enumerate(found):
            counts[row, np.searchsorted(keys, k)] = n
        for at in range(0, len(keys), 8192):
            part = np.array([run_vector(k) for k in keys[at : at + 8192].tolist()], np.float32)
            out[[first + i for i, _ in found]] += counts[:, at : at + 8192] @ part
        has[[first + i for i, _ in found]] = True
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1), has


def _sums(rows: pa.Table) -> pa.Table:
    vectors, has = bundle(rows.column("text").to_pylist())
    total = vectors[has].sum(axis=0, dtype=np.float64)
    return pa.table({"lang": rows.column("lang").slice(0, 1).combine_chunks(), "vector": pa.array([total.tolist()], pa.list_(pa.float64()))})


def fit_languages(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, unit prototypes) from ``(doc_id, text, lang)``, at most ``train_rows`` of them by hash of the id."""
    keyed = docs.where("lang is not null and doc_id is not null and text is not null").withColumn("hash", F.xxhash64("doc_id"))
    few = F.broadcast(keyed.select("hash", "doc_id").distinct().orderBy("hash", "doc_id").limit(train_rows).select("doc_id"))
    sample = keyed.join(few, "doc_id", "left_semi").select("lang", "text", F.expr(f"pmod(hash div 64, {SALTS})").alias("salt"))
    sums: dict[str, np.ndarray] = {}
    for row in sample.groupBy("lang", "salt").applyInArrow(_sums, "lang string, vector array<double>").orderBy("lang").collect():  # SALTS rows a language
        sums[row["lang"]] = sums.get(row["lang"], 0) + np.array(row["vector"])
    names = sorted(name for name, v in sums.items() if np.linalg.norm(v) > 0)
    if not names:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    matrix = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    return names, matrix.astype(np.float32)


def predict_languages(docs: DataFrame, names: list[str], prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``: the nearest prototype and its cosine (0 to 1).

    Null texts and texts without a letter are ``und`` with score 0, as all are when nothing
    was learned.  Ties go to the first language by name.
    """
    model = docs.sparkSession.sparkContext.broadcast((names, prototypes))  # one vector a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prototypes = model.value
        for batch in batches:
            lang, score = [], []
            for at in range(0, batch.num_rows, TEXTS):
                vectors, has = bundle(batch.column("text").slice(at, TEXTS).to_pylist())
                cosine = vectors @ prototypes.T if names else np.zeros((len(has), 1), np.float32)
                best = cosine.argmax(axis=1)
                known = has & bool(names)
                lang += [names[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)]
                score += np.where(known, np.clip(cosine.max(axis=1), 0, 1), 0).astype(np.float64).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(rows, run, "doc_id long, lang_pred string, score double")


def languages_of(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; learns from rows that are not held out (crc32 of the id modulo 3 is 1)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    names, prototypes = fit_languages(rows.where(~held_out("doc_id", 3, 1)))
    found = predict_languages(rows, names, prototypes)
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
