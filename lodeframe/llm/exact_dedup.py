"""Exact de-duplication by composable polynomial fingerprints.

The normalised text (white space deleted) is read as a polynomial over its bytes,
evaluated at 256 modulo a 120-bit prime.  A text is hashed in chunks; the hashes
of two neighbouring pieces combine by shifting the right one by the length of
the left one, so chunks can be hashed in any order or place.  The chunks of a huge
text become rows that are hashed in parallel, and only their hashes meet again; those of
other texts are combined where they are read.  Rows with equal fingerprint and length form a group; before a group is
believed, every member is compared with the group's kept text chunk by chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.frames import discard, free_prefix, mapped, pick, sized, stored
from lodeframe.llm.words import WHITESPACE

PRIME = (1 << 120) - 119
CHUNK_BYTES = 1 << 16
#: Code points of one compared chunk, and of one that is hashed as a row.
COMPARE_CHARS = 1 << 16
ROW_CHARS = 1 << 18
#: Texts of more code points are hashed chunk by chunk in parallel.
HUGE_CHARS = 1 << 20
_LOW = (1 << 60) - 1


def chunk_fingerprint(chunk: bytes) -> tuple[int, int]:
    """(hash, length) of a piece."""
    return int.from_bytes(chunk, "little") % PRIME, len(chunk)


def combine(left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int]:
    """(hash, length) of two pieces put together."""
    return (left[0] + right[0] * pow(256, left[1], PRIME)) % PRIME, left[1] + right[1]


def fingerprint(data: bytes, chunk: int = CHUNK_BYTES) -> tuple[int, int]:
    """(hash, length) of the whole, from its chunks."""
    out = (0, 0)
    for at in range(0, len(data), chunk):
        out = combine(out, chunk_fingerprint(data[at : at + chunk]))
    return out


def _squeezed(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(None, WHITESPACE)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low, high, length, chars, sha = [], [], [], [], []
        for value in batch.column("text"):
            text = value.as_py() or ""
            raw = _squeezed(text)
            f, n = fingerprint(raw)
            low.append(f & _LOW)
            high.append(f >> 60)
            length.append(n)
            chars.append(len(text))
            sha.append(hashlib.sha256(raw).hexdigest())
        cols = [pa.array(x, pa.int64()) for x in (low, high, length, chars)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols, pa.array(sha, pa.string())], names=["doc_id", "f1", "f2", "n_bytes", "n_chars", "text_sha256"])


def _chunk_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(_squeezed(chunk.as_py())) for chunk in batch.column("chunk")]
        cols = [pa.array(x, pa.int64()) for x in ([f & _LOW for f, _ in found], [f >> 60 for f, _ in found], [n for _, n in found])]
        yield pa.RecordBatch.from_arrays([batch.column("huge"), batch.column("no"), *cols], names=["huge", "no", "f1", "f2", "n_bytes"])


def _combined(chunks: pa.Table) -> pa.Table:
    """The fingerprint of a text from those of its chunks."""
    whole = (0, 0)
    for row in chunks.sort_by("no").to_pylist():
        whole = combine(whole, (row["f1"] | row["f2"] << 60, row["n_bytes"]))
    values = (chunks.column("huge")[0].as_py(), whole[0] & _LOW, whole[0] >> 60, whole[1])
    return pa.table({k: pa.array([v], pa.int64()) for k, v in zip(("huge", "f1", "f2", "n_bytes"), values, strict=True)})


def text_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, f1, f2, n_bytes, n_chars, text_sha256`` of every row of ``docs`` (doc_id, text)."""
    long_ = F.coalesce(F.length("text"), F.lit(0)) > HUGE_CHARS
    small = mapped(docs.where(~long_), _digests, "doc_id long, f1 long, f2 long, n_bytes long, n_chars long, text_sha256 string")
    huge = stored(docs.where(long_).withColumn("huge", F.monotonically_increasing_id()))
    cut = F.expr(f"transform(sequence(0, cast((length(text) - 1) div {ROW_CHARS} as int)), i -> substring(text, i * {ROW_CHARS} + 1, {ROW_CHARS}))")
    chunks = huge.select("huge", F.posexplode(cut).alias("no", "chunk")).repartition("huge", "no")
    hashed = mapped(chunks, _chunk_digests, "huge long, no int, f1 long, f2 long, n_bytes long")
    whole = hashed.groupBy("huge").applyInArrow(_combined, "huge long, f1 long, f2 long, n_bytes long")
    sha = F.sha2(F.regexp_replace("text", r"[\x20\x09-\x0D]+", ""), 256)
    rows = huge.select("doc_id", "huge", F.length("text").cast("long").alias("n_chars"), sha.alias("text_sha256"))
    return small.unionByName(rows.join(whole, "huge").select(*small.columns))


def _different(docs: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (f1, f2, n_bytes) with a member whose text differs from the kept one, compared chunkwise; and the stored chunks."""
    texts = pick(docs, members.select("doc_id"))
    squeezed = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")
    pieces = texts.select("doc_id", squeezed.alias("t")).join(members, "doc_id")
    cut = F.expr(f"transform(sequence(0, cast(length(t) div {COMPARE_CHARS} as int)), i -> substring(t, i * {COMPARE_CHARS} + 1, {COMPARE_CHARS}))")
    chunks = stored(pieces.select("keep_row", "row", "f1", "f2", "n_bytes", F.posexplode(cut).alias("no", "chunk")))
    kept = chunks.where("row = keep_row").select("keep_row", "no", F.col("chunk").alias("kept_chunk")).distinct()
    other = chunks.where("row <> keep_row")
    return other.join(kept, ["keep_row", "no"], "left").where("not (chunk <=> kept_chunk)").select("f1", "f2", "n_bytes").distinct(), chunks


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after deleting every character of
    ``[\\x20\\x09-\\x0D]``; null counts as empty.  Of equal texts the row with the most
    code points in the original stays, then the one with the smallest id (null
    ids last); of wholly equal rows exactly one has ``kept``.  ``text_sha256`` is of the
    normalised text.  Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(text_digests(docs).withColumn("row", F.monotonically_increasing_id()))
    key = ["f1", "f2", "n_bytes"]

    def groups(df: DataFrame, by: list[str]) -> DataFrame:
        # bitwise not turns the order of ids and row numbers round without overflow
        best = F.max(F.struct("n_chars", F.expr("~doc_id").alias("d"), F.expr("~row").alias("r"))).alias("best")
        out = df.groupBy(*by).agg(F.count("*").alias("group_size"), best, (F.min("text_sha256") != F.max("text_sha256")).alias("unlike"))
        return out.select(*by, "group_size", F.expr("~best.d").alias("keep_id"), F.expr("~best.r").alias("keep_row"), "unlike")

    found = stored(groups(rows, key))
    several = found.where("group_size > 1")
    members = rows.where("doc_id is not null").join(several, key).select("doc_id", "row", "keep_row", *key)
    members = stored(members)
    different, chunks = _different(docs, members)
    apart = stored(different.unionByName(several.where("unlike").select(*key)).distinct())
    discard(chunks, members)
    if not apart.isEmpty():
        rows = rows.join(apart.withColumn("split", F.lit(True)), key, "left").withColumn("sub", F.when(F.col("split"), F.col("text_sha256")).otherwise(""))
        key = [*key, "sub"]
        found = groups(rows, key)
    out = rows.join(found.drop("unlike"), key)
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def keep_one_of_equal(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) without the rows that :func:`exact_duplicates` drops; null ids are ids like others."""
    own = free_prefix(docs)
    rows = stored(exact_duplicates(docs))
    gone, stays = rows.where("not kept"), rows.where("kept")
    # ids that stay in one row and go in another cannot be told apart by id
    if gone.join(stays, gone.doc_id.eqNullSafe(stays.doc_id), "left_semi").isEmpty():
        ids = sized(gone.select(F.col("doc_id").alias(f"{own}gone")).distinct())
        return docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col(f"{own}gone")), "left_anti").select(*docs.columns)
    squeezed = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", ""), 256)
    order = Window.partitionBy("doc_id", f"{own}sha").orderBy(F.length(F.coalesce("text", F.lit(""))).desc())
    numbered = docs.withColumn(f"{own}sha", squeezed).withColumn(f"{own}place", F.row_number().over(order))
    ids = stays.select(F.col("doc_id").alias(f"{own}id"), F.col("text_sha256").alias(f"{own}text"))
    met = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{own}id")) & (F.col(f"{own}sha") == F.col(f"{own}text"))
    return numbered.where(F.col(f"{own}place") == 1).join(ids, met, "left_semi").select(*docs.columns)
