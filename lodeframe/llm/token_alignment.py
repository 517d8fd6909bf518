"""Alignment of the tokens that two tokenizers make of the same texts.

Both tokenizers cut the same bytes, so their tokens are aligned where tokens of both end
at one byte: a *cut*.  Cuts are found by divide and conquer.  An interval of tokens that ends in a cut is
split at the cut nearest to the end of its middle token, which a binary search among the ends of the
other tokenizer finds; the search widens to neighbouring tokens while none is met.  Both
halves are split in the same way; an interval without a cut inside is a group.  The
intervals of all texts of a block are split together, level by level.

A link is a pair of tokens that end at one cut.  How often a pair of ids is linked is
counted over the whole corpus: links of a document are counted in its task, summed by
pair, and given back to the documents by a join on the pair.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.frames import mapped, sized, stored
from lodeframe.llm.packing import Encoder
from lodeframe.llm.words import encoded_blocks

#: Bytes of text aligned as one block.
TEXT_BYTES = 1 << 19
_pairs: dict[tuple[str, str], TokenPair] = {}


def byte_level_alphabet() -> dict[str, int]:
    """Byte of each character of a byte-level token: printable ones stand for themselves, the others for characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenPair:
    """Ids and token bytes of a byte-level BPE file (A) and a sentence piece model (B)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.a = Encoder(path_a)
        self.a.tokenizer.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        vocabulary, alphabet = self.a.tokenizer.get_vocab(), byte_level_alphabet()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        #: decimal ids followed by each of the separators of a listing
        self.written_a = [f"{i}{s}" for s in ",|" for i in range(len(self.bytes_a))]
        self.written_b = [f"{i}{s}" for s in ",;" for i in range(len(self.bytes_b))]

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both tokenizers, without any for texts that are empty or that one of them changes."""
        some = [i for i, t in enumerate(texts) if t]
        whole = [b" " + texts[i] for i in some]
        a = self.a.encode(whole) if whole else []
        b = self.b.encode([texts[i].decode("utf-8", "replace") for i in some], num_threads=1)
        none = np.zeros(0, np.int64)
        out = [(none, none)] * len(texts)
        for i, raw, x, y in zip(some, whole, a, b, strict=True):
            if b"".join(map(self.bytes_b.__getitem__, y)) == raw and b"".join(map(self.bytes_a.__getitem__, x.tolist())) == raw:
                out[i] = (x.astype(np.int64), np.array(y, np.int64))
        return out


def token_pair(path_a: str, path_b: str) -> TokenPair:
    """The worker's tokenizers for two files."""
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = TokenPair(path_a, path_b)
    return _pairs[path_a, path_b]


def _nearest_cuts(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval of tokens [low, high) of ``a``: the token nearest to its middle, but not the last, whose end is in ``b``; and its place in ``b`` (-1: none)."""
    middle = (low + high - 1) // 2
    token, place = np.full(len(low), -1), np.full(len(low), -1)
    todo, near, far = np.flatnonzero(high - low > 1), 0, 1
    while len(todo):
        # tokens at a distance in [near, far) from the middle, on either side
        steps = np.arange(near, far)
        steps = np.concatenate((-steps, steps)) if near else steps
        tried = middle[todo, None] + steps
        inside = (tried >= low[todo, None]) & (tried < high[todo, None] - 1)
        value = a[np.where(inside, tried, 0)]
        at = np.minimum(np.searchsorted(b, value), len(b) - 1)
        met = inside & (b[at] == value)
        cost = np.where(met, np.abs(steps), far)
        best = np.argmin(cost, axis=1)
        rows = np.arange(len(todo))
        hit = met[rows, best]
        token[todo[hit]], place[todo[hit]] = tried[rows, best][hit], at[rows, best][hit]
        reach = np.maximum(middle[todo] - low[todo], high[todo] - 2 - middle[todo])
        todo, near, far = todo[~hit & (reach >= far)], far, far * 2
    return token, place


def groups(a: np.ndarray, b: np.ndarray, whole_a: np.ndarray, whole_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B up to each cut, from the ascending ends of all tokens of a block and the token bounds of its texts."""
    low_a, high_a, low_b, high_b = whole_a[:-1], whole_a[1:], whole_b[:-1], whole_b[1:]
    some = high_a > low_a
    low_a, high_a, low_b, high_b = low_a[some], high_a[some], low_b[some], high_b[some]
    done_a, done_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(low_a):
        token, place = np.full(len(low_a), -1), np.full(len(low_a), -1)
        open_ = np.flatnonzero(high_b - low_b > 1)
        token[open_], place[open_] = _nearest_cuts(a, b, low_a[open_], high_a[open_])
        split = token >= 0
        done_a.append(high_a[~split])
        done_b.append(high_b[~split])
        at_a, at_b = token[split] + 1, place[split] + 1
        low_a, high_a = np.concatenate((low_a[split], at_a)), np.concatenate((at_a, high_a[split]))
        low_b, high_b = np.concatenate((low_b[split], at_b)), np.concatenate((at_b, high_b[split]))
    return np.sort(np.concatenate(done_a)), np.sort(np.concatenate(done_b))


def listing(pair: TokenPair, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3`` of the groups that end before the tokens ``to_a`` and ``to_b``."""
    if not len(a):
        return ""
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[to_a - 1], last_b[to_b - 1] = 1, 1
    # a token comes after all earlier groups of the other side
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    out = np.empty(len(a) + len(b), object)
    out[np.arange(len(a)) + np.concatenate(([0], to_b))[group_a]] = list(map(pair.written_a.__getitem__, (a + last_a * len(pair.bytes_a)).tolist()))
    out[np.arange(len(b)) + to_a[group_b]] = list(map(pair.written_b.__getitem__, (b + last_b * len(pair.bytes_b)).tolist()))
    return "".join(out.tolist())[:-1]


def _aligned(path_a: str, path_b: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = token_pair(path_a, path_b)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, texts in encoded_blocks(batch.column("text"), TEXT_BYTES):
                tokens = pair.encode(texts)
                whole_a, whole_b = (np.concatenate(([0], np.cumsum([len(t[side]) for t in tokens]))).astype(np.int64) for side in (0, 1))
                flat_a, flat_b = (np.concatenate([t[side] for t in tokens]) for side in (0, 1))
                # texts follow one another, so ends ascend over the block
                to_a, to_b = groups(np.cumsum(pair.length_a[flat_a]), np.cumsum(pair.length_b[flat_b]), whole_a, whole_b)
                bounds = np.searchsorted(to_a, whole_a, "right")
                rows = []
                for i, (a, b) in enumerate(tokens):
                    own = slice(bounds[i], bounds[i + 1])
                    own_a, own_b = to_a[own] - whole_a[i], to_b[own] - whole_b[i]
                    linked, times = np.unique(a[own_a - 1] << 32 | b[own_b - 1], return_counts=True)
                    text = listing(pair, a, b, own_a, own_b)
                    sha = hashlib.sha256(text.encode()).hexdigest() if text else ""
                    rows.append((ids[first + i], len(a), len(b), len(own_a), len(own_a), sha, linked, times))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, pairs, times``.

    A encodes a space and the text by a byte-level BPE file, B the text by a sentence
    piece model, both without special tokens.  ``n_a`` and ``n_b`` count their tokens,
    ``n_groups`` the groups between cuts and ``n_links`` the links; ``pairs`` are the distinct linked ids
    (A's times 2**32 plus B's) and ``times`` their links in the document.  ``count_sum`` adds, over the
    links, how many links of the corpus hold the same ids; ``n_best`` counts the links whose number is the
    highest among those of their B id, ties included.  ``groups_sha256`` is of ``a1,a2|b1;a3|b2,b3``.

    Texts that are null or empty, or that a tokenizer does not give back byte by byte, have no
    tokens: zeros, an empty string and empty arrays.  Rows that share an id or have none are
    aligned row by row; other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    rows = stored(mapped(docs, _aligned(path_a, path_b), schema).withColumn("row", F.monotonically_increasing_id()))
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    counts = links.groupBy("pair").agg(F.sum("times").alias("n"))
    highest = F.max("n").over(Window.partitionBy(F.expr("pair & 4294967295")))
    counts = sized(counts.select("pair", "n", (F.col("n") == highest).alias("best")))
    scored = links.join(counts, "pair").groupBy("row").agg(F.sum(F.expr("times * n")).alias("count_sum"), F.sum(F.expr("if(best, times, 0)")).alias("n_best"))
    out = rows.join(scored, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", "pairs", "times")
