"""Exact top-k search by inner product without random access.

Candidates are dealt into blocks, queries into blocks, and every query block meets
every candidate block once.  Inside such a tile each component is a list of the
candidates sorted by it.  A query reads the lists in sequence from the end that its own
component favours, all of them down to one common contribution c: whatever a list
has not shown adds at most c to a score, and at least what its far end adds.  So after
each round a candidate's score lies between what was read of it plus the worst, and plus
c, for every list that has not shown it.  c falls from round to round, and a round goes on
where the one before stopped.

Candidates with the best upper bounds get their final scores first; reading ends when
no more than a few outsiders can reach the k-th lower bound, and a query ends when none can.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.frames import stored

#: Bytes of the vectors in a block of candidates and in a block of queries.
BLOCK_BYTES = 4 << 20
QUERY_BYTES = 8 << 20
#: The common contribution c after each round, in units of a list's mean contribution; at 0 half of a centred list is read.
ROUNDS = (1.25, 0.0)
#: Reading ends when this share of a block at most can still qualify.
FEW = 1 / 16
_LONG = (1 << 63) - 1


class Lists:
    """The sorted lists of a block of candidates: one for each component, smallest value first."""

    def __init__(self, x: np.ndarray):
        self.order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T)
        self.values = np.take_along_axis(np.ascontiguousarray(x.T), self.order, 1)
        self.mean = np.abs(x).mean(axis=0) if len(x) else np.zeros(x.shape[1])

    def stops(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where each query (row) stops in each list, if it reads all entries that add more than its c."""
        out = np.zeros(q.shape, np.int64)
        for d, values in enumerate(self.values):
            up, down = q[:, d] > 0, q[:, d] < 0
            out[up, d] = np.searchsorted(values, c[up] / q[up, d], "left")
            out[down, d] = np.searchsorted(values, c[down] / q[down, d], "right")
        return out

    def read(self, row: np.ndarray, last: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(candidates, contributions) of the entries between two places of every list."""
        first, end = np.minimum(last, stop), np.maximum(last, stop)
        some = np.flatnonzero(end > first).tolist()
        if not some:
            return np.zeros(0, np.int64), np.zeros(0)
        spans = [(d, first[d], end[d]) for d in some]
        ids = np.concatenate([self.order[d, a:b] for d, a, b in spans])
        return ids, np.concatenate([self.values[d, a:b] * row[d] for d, a, b in spans])


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def _resolve(x: np.ndarray, x_id: np.ndarray, row: np.ndarray, upper: np.ndarray, floor: float, k: int, most: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """Final scores by falling upper bound: (candidates, scores, whether no other can qualify); gives up beyond ``most`` of them."""
    open_ = np.flatnonzero(upper >= floor)
    found, scores, size = np.zeros(0, np.int64), np.zeros(0), 8 * k
    while len(open_):
        if size < len(open_):
            part = np.argpartition(-upper[open_], size)
            now, open_ = open_[part[:size]], open_[part[size:]]
        else:
            now, open_ = open_, open_[:0]
        found, scores = np.concatenate((found, now)), np.concatenate((scores, x[now] @ row))
        if len(scores) >= k:
            floor = max(floor, np.partition(scores, -k)[-k])
            open_ = open_[upper[open_] >= floor]
        if len(open_) > most:
            return found, scores, False
        size *= 4
    return found, scores, True


def block_topk(x: np.ndarray, x_id: np.ndarray, q: np.ndarray, q_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of the ``k`` best candidates of every query, own id left out, and list entries read by each query.

    ``x`` and ``q`` hold integers as doubles.  Ties go to the smaller id.  Where partial
    sums could leave the exact range of a double, whole integers are multiplied
    instead of lists read, and scores beyond a long are held at its ends.
    """
    n, dims = x.shape
    reads = np.zeros(len(q), np.int64)
    if not n or not len(q):
        return *(np.zeros(0, np.int64),) * 3, reads
    if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, dims) >= 2.0**53:
        return *_whole_integers(x, x_id, q, q_id, k), reads
    lists = Lists(x)
    scale = np.abs(q) @ lists.mean / max(1, dims)
    levels = [np.floor(scale * share) for share in ROUNDS]
    stops = [lists.stops(q, c) for c in levels]
    place = np.argsort(x_id, kind="stable")
    at = np.minimum(np.searchsorted(x_id[place], q_id), n - 1)
    own = np.where(x_id[place][at] == q_id, place[at], -1)
    out = []
    for i, row in enumerate(q):
        used = np.count_nonzero(row)
        ends = np.minimum(row * lists.values[:, 0], row * lists.values[:, -1])
        worst = float(ends.min(initial=0))
        last = np.where(row > 0, n, 0)
        total, unseen, floor = np.zeros(n), np.full(n, used), -np.inf
        for level, stop in zip(levels, stops, strict=True):
            ids, adds = lists.read(row, last, stop[i])
            last, c = stop[i], level[i]
            reads[i] += len(ids)
            total += np.bincount(ids, adds, n)
            if c:
                unseen -= np.bincount(ids, minlength=n)
                upper = total + c * unseen
                lower = total + worst * unseen
                if own[i] >= 0:
                    lower[own[i]] = -np.inf
                floor = max(floor, np.partition(lower, -k)[-k]) if n > k else floor
            else:
                upper = total
            if own[i] >= 0:
                upper[own[i]] = -np.inf
            found, scores, done = _resolve(x, x_id, row, upper, floor, k, n * FEW if c else np.inf)
            if done:
                break
        real = found != own[i]
        found, scores = found[real], scores[real]
        best = _best(scores, x_id[found], k)
        out.append((np.full(len(best), i), found[best], scores[best].astype(np.int64)))
    which, cols, score = (np.concatenate(c) for c in zip(*out, strict=True))
    return which, cols, score, reads


def _whole_integers(x: np.ndarray, x_id: np.ndarray, q: np.ndarray, q_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    whole = [[int(v) for v in row] for row in x.tolist()]
    out = []
    for i, row in enumerate(q.tolist()):
        row = [int(v) for v in row]
        scored = ((-sum(a * b for a, b in zip(row, other, strict=True)), int(x_id[j]), j) for j, other in enumerate(whole) if x_id[j] != q_id[i])
        out += [(i, j, min(max(-s, -_LONG - 1), _LONG)) for s, _, j in sorted(scored)[:k]]
    return tuple(np.array(c, np.int64) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _tile(k: int):
    def run(rows: pa.Table) -> pa.Table:
        ids = rows.column("vec_id").to_numpy()
        flat = rows.column("v").combine_chunks()
        dims = len(flat[0]) if len(flat) else 0
        matrix = flat.flatten().to_numpy().reshape(len(ids), dims)
        query = rows.column("query").to_numpy()
        q, x = np.flatnonzero(query), np.flatnonzero(~query)
        which, at, score, _ = block_topk(matrix[x], ids[x], matrix[q], ids[q], k)
        return pa.table({"query_id": ids[q][which].astype(np.int64), "vec_id": ids[x][at].astype(np.int64), "score": score})

    return run


def exact_topk(vectors: DataFrame, k: int = 5, query_mod: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best by inner product of floor(scale * x).

    Queries are rows whose id is divisible by ``query_mod``, candidates all rows but the
    query's own.  Fewer than ``k`` candidates give fewer rows; ties go to the smaller id.
    Vectors that are null or hold null or non-finite components (before or after
    scaling), and rows with a null id, take no part.  Only vectors of equal length are
    compared.  Rows that share an id count as one, with the smallest vector.  Scores
    beyond the range of a long are held at its ends, after ranking by their true
    values inside a block.  Other columns are ignored; an empty table gives an empty result.
    """
    finite = F.expr(f"v is not null and forall(v, x -> x is not null and not isnan(x) and abs({scale} * x) < double('infinity'))")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null").where(F.coalesce(finite, F.lit(False)))
    # floor gives a long; values beyond 2 ** 53 are whole already
    rows = rows.select("vec_id", F.expr(f"transform(v, x -> if(abs({scale} * x) < {2.0**53}D, cast(floor({scale} * x) as double), {scale} * x))").alias("v"))
    rows = stored(rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dims", F.size("v")))
    asked = F.col("vec_id") % query_mod == 0
    n, n_asked, dims = rows.agg(F.count("*"), F.count(F.when(asked, 1)), F.coalesce(F.max("dims"), F.lit(1))).first()
    x_blocks, q_blocks = (max(1, -(-count * 8 * max(1, dims) // most)) for count, most in ((n, BLOCK_BYTES), (n_asked, QUERY_BYTES)))
    deal = lambda df, by, n, other, m, flag: df.select(
        F.expr(f"cast(pmod(xxhash64(vec_id), {n}) as int)").alias(by), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other), "dims", "vec_id", "v", F.lit(flag).alias("query")
    )
    tiles = deal(rows, "x_block", x_blocks, "q_block", q_blocks, False).unionByName(deal(rows.where(asked), "q_block", q_blocks, "x_block", x_blocks, True))
    best = tiles.groupBy("x_block", "q_block", "dims").applyInArrow(_tile(k), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", place.cast("int").alias("rank"), "vec_id", "score").where(f"rank <= {k}")
