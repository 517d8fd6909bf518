"""Removal of repeated word passages with difference-cover anchors.

A window of ``window`` consecutive words is a repeat when the same words also start
earlier.  Comparing every window with every other would move all of them, so the
search runs in two steps.

*Anchors.*  Runs of ``window - period + 1`` words are hashed only at positions whose
remainder modulo ``period`` is in a difference cover: for any two remainders some
shift below ``period`` brings both into the cover.  Two equal windows therefore share
an anchor at one of their first ``period`` offsets, whatever their positions are.
Anchors seen once are dropped.

*Extension.*  Only windows that contain a repeated anchor are hashed over their full
length (96 bits) and compared by earliest start.

*Copies.*  Of documents with the same words all but the first are repeats as a whole
and stay out of both steps.

Each task first settles repeats among its own rows: of equal keys in a batch only
the earliest goes to the shuffle, so a passage that a third of all documents share
arrives as one row per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.frames import discard, mapped, sized, stored
from lodeframe.llm.words import Words, encoded_blocks, mix, shingle_hashes

#: Perfect difference covers: period -> positions.
COVERS = {13: (0, 1, 3, 9), 7: (0, 1, 3), 3: (0, 1), 1: (0,)}
_SALT = np.uint64(0xD6E8FEB86659FD93)


def plan(window: int) -> tuple[int, np.ndarray, int]:
    """(period, cover flags by remainder, anchor length) for a window; anchors keep at least 4 words if they can."""
    period = next(p for p in COVERS if window - p + 1 >= min(4, window))
    flags = np.zeros(period, bool)
    flags[list(COVERS[period])] = True
    return period, flags, window - period + 1


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before in any column."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, h1, h2): number of words and 128-bit hash of the whole word sequence."""
    for batch in batches:
        count, one, two = [], [], []
        for value in batch.column("text"):
            words = (value.as_py() or "").encode("utf-8", "surrogatepass").split()
            digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
            count.append(len(words))
            one.append(int.from_bytes(digest[:8], "little", signed=True))
            two.append(int.from_bytes(digest[8:], "little", signed=True))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (count, one, two))], names=["doc_id", "n", "h1", "h2"])


def _anchors(window: int):
    period, cover, size = plan(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            key, doc, pos = [], [], []
            for first, raw in encoded_blocks(batch.column("text")):
                words = Words(raw)
                hashes = shingle_hashes(words.hashes(), size)
                if not len(hashes):
                    continue
                at = np.arange(len(hashes))
                own = at - words.doc_first[words.doc[: len(at)]]
                enough = np.diff(words.doc_first)[words.doc[: len(at)]] >= window
                take = cover[own % period] & (words.doc[: len(at)] == words.doc[size - 1 :]) & enough
                key.append(hashes[take])
                doc.append(ids[first + words.doc[: len(at)][take]])
                pos.append(own[take])
            if not key:
                continue
            key, doc, pos = map(np.concatenate, (key, doc, pos))
            order = np.lexsort((pos, doc, key))
            key, doc, pos = key[order], doc[order], pos[order]
            head = _changes(key)
            # a key met twice here is known to repeat; its first row still tells the other batches
            known = ~head
            known[:-1] |= ~head[1:]
            spread = np.where(head, key, mix(key + doc.astype(np.uint64) * _SALT + pos.astype(np.uint64)))
            order = np.lexsort((pos, doc))  # rows of a document together compress best
            spread, key, doc, pos, head, known = (c[order] for c in (spread, key, doc, pos, head, known))
            yield pa.RecordBatch.from_arrays([_long(spread), _long(key), pa.array(doc), pa.array(pos.astype(np.int32)), pa.array(head), pa.array(known)], names=["spread", "key", "doc", "pos", "head", "known"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (spread, key): positions of anchors that occur more than once."""
    last = None  # the last head of the batch before: (key, doc, pos, already told)
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc, pos, head, known = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc", "pos", "head", "known"))
        out_doc, out_pos = [doc[known]], [pos[known]]
        at = np.flatnonzero(head)
        if len(at):
            k, d, p, told = key[at], doc[at], pos[at], known[at].copy()
            if last is not None and last[0] == k[0]:
                if not last[3]:
                    out_doc.append(np.array([last[1]], doc.dtype))
                    out_pos.append(np.array([last[2]], pos.dtype))
                again_first = True
            else:
                again_first = False
            same = np.zeros(len(k) + 1, bool)
            same[1:-1] = k[1:] == k[:-1]
            same[0] = again_first
            repeat = same[:-1] | same[1:]
            new = repeat & ~told
            out_doc.append(d[new])
            out_pos.append(p[new])
            last = (k[-1], d[-1], p[-1], bool(told[-1] or repeat[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_doc)), pa.array(np.concatenate(out_pos))], names=["doc_id", "pos"])


def _windows(window: int):
    """Rows (text, repeated anchor positions): hashes of the windows over them, or (known) ranges settled here."""
    period, _, _ = plan(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            marks = batch.column("marks")
            one, two, doc, pos = [], [], [], []
            for first, raw in encoded_blocks(batch.column("text")):
                words = Words(raw)
                hashes = words.hashes()
                n = len(hashes) - window + 1
                if n <= 0:
                    continue
                flags = np.zeros(len(hashes) + 1, np.int64)
                for i, length in enumerate(np.diff(words.doc_first).tolist()):
                    own = np.asarray(marks[first + i].values)
                    # marks of a longer row that shares the id may lie beyond this one's end
                    flags[words.doc_first[i] + own[own < length]] = 1
                total = np.concatenate(([0], np.cumsum(flags)))
                at = np.arange(n)
                take = (total[at + period] > total[at]) & (words.doc[:n] == words.doc[window - 1 :])
                at = at[take]
                one.append(shingle_hashes(hashes, window)[at])
                two.append(shingle_hashes(mix(hashes ^ _SALT), window)[at] & np.uint64(0xFFFFFFFF))
                doc.append(ids[first + words.doc[at]])
                pos.append(at - words.doc_first[words.doc[at]])
            if not one:
                continue
            one, two, doc, pos = map(np.concatenate, (one, two, doc, pos))
            order = np.lexsort((pos, doc, two, one))
            one, two, doc, pos = one[order], two[order], doc[order], pos[order]
            head = _changes(one, two)
            start = np.flatnonzero(head)[np.cumsum(head) - 1]
            later = (doc != doc[start]) | (pos != pos[start])
            d, p = doc[later], pos[later]
            order = np.lexsort((p, d))
            d, p = d[order], p[order]
            fresh = _changes(d, p)
            d, p = d[fresh], p[fresh]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)
            begins = np.flatnonzero(new)
            ends = np.append(begins[1:], len(d)) - 1 if len(d) else begins
            spread = mix(d[begins].astype(np.uint64) + _SALT * p[begins].astype(np.uint64))
            one, two, doc, pos = (c[head] for c in (one, two, doc, pos))
            order = np.lexsort((pos, doc))
            one, two, doc, pos = one[order], (two << np.uint64(32) | pos.astype(np.uint64))[order], doc[order], pos[order]
            columns = [
                pa.array(np.concatenate((one.view(np.int64), spread.view(np.int64)))),
                pa.array(np.concatenate((two.view(np.int64), p[begins]))),
                pa.array(np.concatenate((doc, d[begins]))),
                # null: a head, else the end of a range settled here
                pa.array(np.concatenate((np.zeros(len(one), np.int32), p[ends].astype(np.int32) + np.int32(1))), mask=np.arange(len(one) + len(begins)) < len(one)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["one", "two", "doc", "stop"])

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hash, then (doc, start): window starts that are not the earliest of their words."""
    head_key, head_at = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        known = batch.column("stop").is_valid().to_numpy(zero_copy_only=False)
        one, two, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("one", "two", "doc"))
        stop = batch.column("stop").fill_null(0).to_numpy(zero_copy_only=False)
        start = (two & 0xFFFFFFFF).astype(np.int32)
        out = [(doc[known], start[known], stop[known])]
        at = np.flatnonzero(~known)
        if len(at):
            o, t, d, s = one[at], two[at] >> 32, doc[at], start[at]
            head = _changes(o, t)
            head[0] = head_key != (o[0], t[0])
            group = np.cumsum(head)
            heads = np.flatnonzero(head)
            first_d = np.concatenate(([head_at[0] if head_at else 0], d[heads]))[group]
            first_s = np.concatenate(([head_at[1] if head_at else 0], s[heads]))[group]
            later = (d != first_d) | (s != first_s)
            out.append((d[later], s[later], s[later] + np.int32(1)))
            head_key, head_at = (o[-1], t[-1]), (first_d[-1], first_s[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["doc_id", "start", "stop"])


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, spans, texts = [], [], [], []
            for raw, cut in zip(batch.column("text"), batch.column("cut"), strict=True):
                words = (raw.as_py() or "").encode("utf-8", "surrogatepass").split()
                n, own, kept, at = len(words), [], [], 0
                for piece in sorted((c["start"], c["stop"]) for c in cut.as_py() or ()):
                    start, end = piece[0], min(n, piece[1] - 1 + window)
                    if own and start <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], end)
                    elif start < n:
                        own.append([start, end])
                for start, end in own:
                    kept.extend(words[at:start])
                    at = end
                kept = kept + words[at:] if own else words
                total.append(n)
                removed.append(n - len(kept))
                spans.append([{"start": s, "stop": e} for s, e in own])
                texts.append(b" ".join(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "removed_spans", "kept_text"],
            )

    return run


def remove_repeated_passages(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, removed_spans, kept_text`` with one row per input row.

    Words are runs of ``[^\\x20\\x09-\\x0D]``, unchanged.  Every word covered by a window whose
    words also start earlier (smaller id, or same document and earlier start) is
    removed; windows are judged on the input.  ``removed_spans`` are word ranges
    (stop exclusive) and ``kept_text`` joins the other words by one space.

    Null and blank texts have no words and an empty ``kept_text``; texts shorter than
    the window keep all.  A row with a null id keeps all its words and makes no other
    lose any.  Rows that share an id are one document with several texts: a start counts
    once however many of them have the same words there, and a place removed from one
    is removed from all that reach so far.  Other columns are ignored; an empty table gives
    an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = docs.where("doc_id is not null")
    whole = stored(mapped(known, _whole, "doc_id long, n long, h1 long, h2 long"))
    first = whole.where(f"n >= {window}").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    copies = whole.join(first, ["n", "h1", "h2"]).where("doc_id <> first").select("doc_id").distinct()
    # an id with several rows is not settled as a whole
    several = whole.groupBy("doc_id").count().where("count > 1")
    copies = sized(copies.join(several, "doc_id", "left_anti"))
    once = known.join(copies, "doc_id", "left_anti")
    anchors = mapped(once, _anchors(window), "spread long, key long, doc long, pos int, head boolean, known boolean")
    again = mapped(anchors.repartition("spread").sortWithinPartitions("spread", "key"), _repeated, "doc_id long, pos int")
    marks = stored(again.groupBy("doc_id").agg(F.collect_list("pos").alias("marks")))
    del anchors, again
    discard(whole)
    windows = mapped(known.join(marks, "doc_id").select("doc_id", "text", "marks"), _windows(window), "one long, two long, doc long, stop int")
    windows = windows.repartition("one").sortWithinPartitions("one", F.expr("shiftrightunsigned(two, 32)"), "doc", "two")
    later = mapped(windows, _later, "doc_id long, start int, stop int")
    later = later.unionByName(copies.select("doc_id", F.lit(0).alias("start"), F.lit((1 << 31) - 1).alias("stop")))
    # written, so that the texts are not dealt for the last join while the windows still take disk
    cuts = stored(later.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("cut")))
    del windows, later
    discard(marks)
    all_ = known.join(cuts, "doc_id", "left").select("doc_id", "text", "cut")
    rest = docs.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<struct<start:int,stop:int>>").alias("cut"))
    schema = "doc_id long, n_words long, n_removed long, removed_spans array<struct<start:int,stop:int>>, kept_text string"
    return mapped(all_.unionByName(rest), _kept(window), schema)
