"""Packing documents into training sequences by the sum-of-squares rule.

Each task tokenises its rows and packs them online.  Whole sequences are cut off a
document first; the remainder goes to the fill level that makes the sum over
levels of (number of partially filled sequences at that level) squared smallest,
read off an array of counts per level.  When a task has read all its rows, the
sequences still open are merged by cutting pieces, and what is left is cut into
lengths that are powers of two, so nothing is padded.

No row moves between tasks, the pieces of open sequences are all a task holds, and a
task that runs again gives the same rows, so results stay whole when an executor is
lost.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.frames import mapped
from lodeframe.llm.words import _INVERSE, _MULTIPLIER, _TABLE, Words, _power_table, encoded_blocks, mix

#: White space that is not a separator of words: such texts are tokenised in one piece.
_OTHER_SPACE = "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Memory for remembered units in a Python worker.
CACHE_BYTES = 48 << 20
#: Bytes of text tokenised at once, and units put into one call of the tokenizer.
TEXT_BYTES = 1 << 19
UNITS = 512
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of texts through a byte-level BPE file.

    The tokenizer splits a text before every space that precedes a word, and runs of
    other white space by themselves, so a text falls into *units* whose ids do not
    depend on what is around them.  Distinct units are encoded once and remembered by a
    64-bit hash, in sorted arrays of a bounded size.  Texts with other white space or
    with an added token of the file are handed over whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([_OTHER_SPACE, *added]))
        vocabulary = self.tokenizer.get_vocab()
        #: bytes that each id stands for: one per character of a byte-level token
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.firsts = np.zeros(0, np.int32)
        self.lengths = np.zeros(0, np.int32)
        self.store = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def _singly(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([u.decode("utf-8", "replace") for u in units], add_special_tokens=False)]
        return np.fromiter(map(len, ids), np.int64, len(ids)), np.concatenate([np.array(x, np.uint32) for x in ids] or [np.zeros(0, np.uint32)])

    def _together(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`_singly` for words after a space: many are encoded as one text and parted by the bytes of their ids."""
        try:
            texts = [b"".join(units[i : i + UNITS]).decode() for i in range(0, len(units), UNITS)]
        except UnicodeDecodeError:
            return self._singly(units)
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] or [np.zeros(0, np.uint32)])
        reached = np.cumsum(self.bytes_of[flat])
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        stop = np.searchsorted(reached, ends) + 1
        if len(units) and (stop[-1] != len(flat) or np.any(reached[stop - 1] != ends)):
            return self._singly(units)
        return np.diff(stop, prepend=0), flat

    def _add(self, keys: np.ndarray, units: list[bytes]) -> None:
        """Remember units by their keys, both in the order of the keys."""
        word = np.fromiter((len(u) > 1 and u[0] == 32 and u[1] > 32 for u in units), bool, len(units))
        lengths = np.zeros(len(units), np.int64)
        firsts = np.zeros(len(units), np.int64)
        for rows, encode in ((np.flatnonzero(word), self._together), (np.flatnonzero(~word), self._singly)):
            lengths[rows], flat = encode([units[i] for i in rows.tolist()])
            firsts[rows] = self.used + np.cumsum(lengths[rows]) - lengths[rows]
            while self.used + len(flat) > len(self.store):
                self.store = np.concatenate((self.store, np.zeros_like(self.store)))
            self.store[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.firsts, self.lengths = np.insert(self.keys, at, keys), np.insert(self.firsts, at, firsts), np.insert(self.lengths, at, lengths)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, without special tokens."""
        whole = {i: u for i, t in enumerate(texts) if self.whole.search(u := t.decode("utf-8", "replace"))}
        texts = [b"" if i in whole else t for i, t in enumerate(texts)]
        words = Words(texts)
        data = words.data
        bounds = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))))
        ends = bounds[1:] - 1  # of documents, without the separator
        doc_start = bounds[:-1][words.doc]
        attached = (words.start > doc_start) & (data[np.maximum(words.start - 1, 0)] == 32)
        start = words.start - attached
        # white space before each word, and at the end of each document
        before = np.concatenate(([0], words.end[:-1])) if len(words.end) else words.end
        before = np.maximum(before, doc_start)
        gap_from, gap_to = before, start
        split = ~attached & (gap_to - gap_from >= 2)
        last_word = np.maximum(np.concatenate(([0], words.end))[words.doc_first[1:]], bounds[:-1])
        starts = np.concatenate((start, gap_from, gap_to[split] - 1, last_word))
        stops = np.concatenate((words.end, np.where(split, gap_to - 1, gap_to), gap_to[split], ends))
        real = stops > starts
        starts, stops = starts[real], stops[real]
        order = np.argsort(starts, kind="stable")
        starts, stops = starts[order], stops[order]
        n = len(data)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * _power_table(_MULTIPLIER, n))))
        keys = mix((total[stops] - total[starts]) * _power_table(_INVERSE, n)[starts]) if len(starts) else np.zeros(0, np.uint64)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if self.keys.nbytes + self.firsts.nbytes + self.lengths.nbytes + self.store.nbytes > CACHE_BYTES:
            self._clear()
        at = np.searchsorted(self.keys, distinct)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != distinct) if len(self.keys) else np.arange(len(distinct))
        raw = data.tobytes()
        self._add(distinct[new], [raw[a:b] for a, b in zip(starts[first[new]].tolist(), stops[first[new]].tolist(), strict=True)])
        place = np.searchsorted(self.keys, distinct)[inverse]
        lengths = self.lengths[place].astype(np.int64)
        offset = np.concatenate(([0], np.cumsum(lengths)))
        flat = self.store[np.repeat(self.firsts[place] - offset[:-1], lengths) + np.arange(offset[-1])]
        cut = offset[np.searchsorted(starts, bounds)]
        out = [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        for i, text in whole.items():
            out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """Online sum-of-squares packing of pieces into sequences of ``capacity``."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        #: number of open sequences by fill level; level 0 stands for a new sequence
        self.level = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.next = 0

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, size: int) -> int:
        """Fill level to put a piece of ``size`` on."""
        most = self.capacity - size
        counts = self.level
        # change of the sum of squares when a sequence moves from level h to h + size
        change = 2 * (counts[size : size + most + 1] - counts[: most + 1]) + 2
        change[0] = 2 * counts[size] + 1 if most else 1
        if most:
            change[most] = 1 - 2 * counts[most]
        change[1:][counts[1 : most + 1] == 0] = np.iinfo(np.int64).max
        return most - int(np.argmin(change[::-1]))

    def add(self, piece: tuple[int | None, int, np.ndarray, int]) -> Iterator[tuple]:
        """Place (document, start, ids, document's tokens); yields pieces of sequences that are now full."""
        size = len(piece[2])
        if size == self.capacity:
            yield (*piece, self._new(), 0)
            return
        at = self.place(size)
        if at:
            pieces = self.open[at].pop()
            self.level[at] -= 1
        else:
            pieces = []
        pieces.append(piece)
        if at + size == self.capacity:
            yield from self._close(pieces)
        else:
            self.level[at + size] += 1
            self.open.setdefault(at + size, []).append(pieces)

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        sequence, offset = self._new(), 0
        for piece in pieces:
            yield (*piece, sequence, offset)
            offset += len(piece[2])

    def finish(self) -> Iterator[tuple]:
        """Merge the open sequences, fullest first, and cut the rest into powers of two."""
        rows = [pieces for fill in sorted(self.open, reverse=True) for pieces in self.open[fill]]
        stream = [p for pieces in rows for p in pieces]
        left = sum(len(p[2]) for p in stream)
        room = target = min(self.capacity, 1 << (left.bit_length() - 1)) if left < self.capacity and left else self.capacity
        current: list[tuple] = []
        for doc, start, ids, tokens in stream:
            while len(ids):
                part = ids[:room]
                current.append((doc, start, part, tokens))
                start += len(part)
                ids = ids[room:]
                room -= len(part)
                if not room:
                    yield from self._close(current)
                    left -= target
                    current = []
                    room = target = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1) if left else self.capacity


def _pack(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(capacity), TaskContext.get().partitionId() << 36
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

        def rows(out: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, tokens, sequence, offset = zip(*out, strict=True)
            columns = [doc, start, [x.astype("<u4").tobytes() for x in ids], tokens, [base + s for s in sequence], offset]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, raw in encoded_blocks(batch.column("text"), TEXT_BYTES):
                out: list[tuple] = []
                for i, tokens in enumerate(encoder(path).encode(raw), first):
                    tokens = np.append(tokens, np.uint32(end_id)).astype(np.uint32)
                    for at in range(0, len(tokens), capacity):
                        # a copy: the piece must not keep the whole block alive
                        out.extend(packer.add((ids[i], at, tokens[at : at + capacity].copy(), len(tokens))))
                if out:
                    yield rows(out)
        if out := list(packer.finish()):
            yield rows(out)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of token sequences: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    A document is its ids (no special tokens) followed by ``end_id``.  ``start`` counts the
    document's ids before the piece, ``ids`` are little-endian unsigned 32-bit, ``offset``
    is the place in the sequence.  Every id lies in exactly one piece; sequences
    have no gaps and hold ``capacity`` ids, but for the last few of each task, whose
    lengths are powers of two.  Null and empty texts are ``end_id`` alone; null or repeated
    ids are packed row by row; other columns are ignored; an empty table gives no pieces.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = mapped(docs, _pack(tokenizer_path, capacity, end_id), "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")
    return pieces.select("doc_id", "start", F.expr("cast(length(ids) div 4 as long)").alias("length"), "ids", "doc_tokens", "sequence_id", "offset")
