"""Quality classifier: logistic regression on hashed word n-grams.

Features are runs of one and two words, hashed into a fixed number of slots, in two
views: the words themselves (A-Z folded) and their shapes (letter case, digits and
punctuation with repeats collapsed; a pair also tells whether its words are equal).
A text is the vector of relative frequencies per view.  Weights come from
follow-the-regularised-leader updates with per-slot learning rates and an L1 term
that leaves most slots at zero; shards of a bounded sample are trained side by side
and averaged.  A score is the sigmoid of one sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.frames import mapped
from lodeframe.llm.words import _INVERSE, _MULTIPLIER, _TABLE, Words, _power_table, encoded_blocks, mix, shingle_hashes

#: Slots of the hashed feature space; the model is this many 32-bit floats.
SLOTS = 1 << 18
#: Most labelled rows that are learned from, taken by a hash of their id.
TRAIN_ROWS = 16_384
SHARDS = 4
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: Weight of a view in the feature vector.
SCALE = 12.0
#: Texts with a lower score are rejected.
THRESHOLD = 0.3

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3


def _shapes(words: Words) -> np.ndarray:
    """Hash of each word's classes of characters, repeats collapsed."""
    kind = _CLASS[words.data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[words.start] = True
    order = np.concatenate(([0], np.cumsum(keep)))
    first, last = order[words.start], order[words.end]
    n = int(order[-1])
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[kind[keep]] * _power_table(_MULTIPLIER, n))))
    return mix((total[last] - total[first]) * _power_table(_INVERSE, n)[first]) if len(first) else np.zeros(0, np.uint64)


def features(raw: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(first word of each text, slots of every word by view); pairs stand at their first word, -1 where there is none."""
    words = Words(raw)
    slot = lambda h, view: (mix(h + np.uint64(view)) & np.uint64(SLOTS - 1)).astype(np.int64)
    whole, shape = words.hashes(lower=True), _shapes(words)
    views = [slot(whole, 1), slot(shape, 2)]
    inside = words.doc[1:] == words.doc[:-1] if len(words.doc) else np.zeros(0, bool)
    equal = (whole[1:] == whole[:-1]).astype(np.uint64)
    for h, view in ((shingle_hashes(whole, 2), 3), (mix(shingle_hashes(shape, 2) + equal), 4)):
        pair = np.full(len(words.start), -1, np.int64)
        pair[:-1][inside] = slot(h, view)[inside]
        views.append(pair)
    return words.doc_first, views


def vectors(raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slots, values) of each text, slots distinct."""
    first, views = features(raw)
    for a, b in zip(first[:-1], first[1:], strict=True):
        slots, values = [], []
        for view in views:
            own = view[a:b]
            own = own[own >= 0]
            if len(own):
                s, c = np.unique(own, return_counts=True)
                slots.append(s)
                values.append(c * (SCALE / len(own)))
        if slots:
            s, at = np.unique(np.concatenate(slots), return_inverse=True)
            yield s.astype(np.int32), np.bincount(at, np.concatenate(values)).astype(np.float32)
        else:
            yield np.zeros(0, np.int32), np.zeros(0, np.float32)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by follow-the-regularised-leader; the last one is the intercept."""
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(s: np.ndarray | slice) -> np.ndarray:
        lead = np.where(s == SLOTS, 0.0, L1) if isinstance(s, np.ndarray) else np.append(np.full(SLOTS, L1), 0.0)
        return np.where(np.abs(z[s]) <= lead, 0.0, -(z[s] - np.sign(z[s]) * lead) / ((BETA + np.sqrt(n[s])) / ALPHA + L2))

    for turn in range(epochs):
        for i in np.random.default_rng(turn).permutation(len(rows)):
            # the intercept is one more slot; rows stay as they are to save memory
            s, v = np.append(rows[i][0], SLOTS), np.append(rows[i][1], 1.0)
            w = weights(s)
            p = 1 / (1 + np.exp(-np.clip(w @ v, -35, 35)))
            g = (p - labels[i]) * v
            sigma = (np.sqrt(n[s] + g * g) - np.sqrt(n[s])) / ALPHA
            z[s] += g - sigma * w
            n[s] += g * g
    return weights(slice(None))


def _fit(rows: pa.Table) -> pa.Table:
    order = np.lexsort((rows.column("doc_id").to_numpy(), rows.column("hash").to_numpy()))
    labels = rows.column("label").to_numpy().astype(np.float64)[order]
    # block by block: the arrays over all texts at once would be many times their size
    found = [v for chunk in rows.column("text").chunks for _, raw in encoded_blocks(chunk) for v in vectors(raw)]
    weights = train_ftrl([found[i] for i in order], labels)
    return pa.table({"rows": pa.array([len(found)], pa.int64()), "weights": pa.array([weights.astype("<f4").tobytes()], pa.binary())})


def fit_quality(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learned from ``(doc_id, text, label)``, at most ``train_rows`` of them by hash of the id.

    Null labels and ids are left out.  Without any row all weights are zero.
    """
    keyed = labelled.where("label is not null and doc_id is not null").withColumn("hash", F.xxhash64(F.col("doc_id")))
    chosen = keyed.select("hash").orderBy("hash").limit(train_rows).agg(F.max("hash")).first()[0]
    if chosen is None:
        return np.zeros(SLOTS + 1, np.float32)
    sample = keyed.where(F.col("hash") <= F.lit(chosen)).select("doc_id", "hash", "text", F.col("label").cast("int").alias("label"))
    shards = sample.withColumn("shard", F.expr(f"pmod(hash div 64, {SHARDS})")).groupBy("shard").applyInArrow(_fit, "rows long, weights binary")
    parts = [(r["rows"], np.frombuffer(r["weights"], "<f4")) for r in shards.collect()]  # SHARDS rows of a fixed size
    total = sum(n for n, _ in parts)
    return sum(n * w for n, w in parts).astype(np.float32) / np.float32(total)


def scores(raw: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text."""
    first, views = features(raw)
    padded = np.append(weights[:SLOTS], np.float32(0)).astype(np.float64)
    out = np.full(len(raw), float(weights[SLOTS]))
    for view in views:
        sums = np.concatenate(([0.0], np.cumsum(padded[view])))
        counts = np.concatenate(([0], np.cumsum(view >= 0)))
        dot, n = sums[first[1:]] - sums[first[:-1]], counts[first[1:]] - counts[first[:-1]]
        out += SCALE * dot / np.maximum(n, 1)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def score_quality(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` ids with ``score`` (0 to 1) and ``predicted`` (1 where the score is at least 0.3).

    Null and empty texts get the score of the intercept.  One row per input row.
    """
    model = docs.sparkSession.sparkContext.broadcast(np.asarray(weights, np.float32))  # SLOTS + 1 floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scores(raw, model.value) for _, raw in encoded_blocks(batch.column("text"))]
            score = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(rows, run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out(id_column: str, parts: int, part: int) -> F.Column:
    """True for ids whose crc32 as text has remainder ``part``; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % parts == part, F.lit(False))


def _fit_from(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where("label is not null").where(~held_out("doc_id", 5, 0))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).withColumn("hash", F.xxhash64("doc_id"))
    # at most TRAIN_ROWS ids travel to the texts
    few = known.orderBy("hash", "doc_id").limit(TRAIN_ROWS).select("doc_id", "label")
    return fit_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id"))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least 0.3; learns as :func:`quality_of` does."""
    model = docs.sparkSession.sparkContext.broadcast(_fit_from(docs, labels))  # SLOTS + 1 floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scores(raw, model.value) for _, raw in encoded_blocks(batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate(found) >= THRESHOLD)) if found else batch

    return mapped(docs, run, docs.schema)


def quality_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Learns from ``labels`` (doc_id, quality) of documents that are not held out (crc32 of the id
    modulo 5 is 0).  Of several labels of one id the smallest counts.
    """
    scored = score_quality(docs, _fit_from(docs, labels))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
