"""Vectorised word handling shared by the text operators.

A *word* is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; since all
separators are ASCII, working on UTF-8 bytes gives the same words as working on
code points.  A block of documents becomes one byte array, and every step is a
handful of numpy passes over it, so no Python code runs per word.

Hashes are 64-bit: each byte is mapped through a fixed random table, weighted by
a power of an odd multiplier at its position, summed modulo 2**64 through a
prefix sum, normalised to the word's own start and mixed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

WHITESPACE = b" \t\n\x0b\x0c\r"
#: Java and DuckDB spelling of a word.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of text handled at once; keeps the numpy temporaries small.
BLOCK_BYTES = 1 << 18

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(WHITESPACE)] = True
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_TABLE = _TABLE.copy()
_LOWER_TABLE[65:91] = _TABLE[97:123]
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    key = str(int(base))
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 2 * BLOCK_BYTES)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if size <= 4 * BLOCK_BYTES:
            _powers[key] = have
    return have[:n]


class Words:
    """Words of a block of texts: byte ``start``/``end`` in ``data``, document index ``doc``."""

    __slots__ = ("data", "doc", "doc_first", "end", "n_docs", "start")

    def __init__(self, texts: list[bytes]):
        self.n_docs = len(texts)
        raw = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(raw, dtype=np.uint8)
        space = _IS_SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        self.start = edge[0::2]
        self.end = edge[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        #: index of the first word of each document, and the total at the end
        self.doc_first = np.searchsorted(self.start, bounds)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.doc_first))

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hash of every word; ``lower`` folds A-Z only."""
        n = len(self.data)
        weighted = (_LOWER_TABLE if lower else _TABLE)[self.data] * _power_table(_MULTIPLIER, n)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(weighted)))
        return mix((total[self.end] - total[self.start]) * _power_table(_INVERSE, n)[self.start])


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of every run of ``k`` consecutive entries."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _MULTIPLIER + words[j : j + n]
    return mix(out)


def blocks(texts: Iterable[str | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Split texts into (first index, encoded texts) of about ``limit`` bytes; null counts as empty."""
    first, size, out = 0, 0, []
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if out and size + len(raw) > limit:
            yield first, out
            first, size, out = i, 0, []
        out.append(raw)
        size += len(raw)
    if out:
        yield first, out


def encoded_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """As :func:`blocks` for an Arrow string column, without decoding to ``str``."""
    raw = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    first, size, out = 0, 0, []
    for i, value in enumerate(raw):
        text = value.as_py() or b""
        if out and size + len(text) > limit:
            yield first, out
            first, size, out = i, 0, []
        out.append(text)
        size += len(text)
    if out:
        yield first, out
