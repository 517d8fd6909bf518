"""Quadratic forms in the inverse of a matrix of products that is too large for one task.

The products of all columns over the dates are kept in square tiles.  Columns are eliminated a
block at a time, as in Gaussian elimination of a symmetric positive matrix: the tiles below the
pivot are solved by its triangular root, and each later tile loses the product of the two that
face it.  The last block holds further rows E; when all others are gone, its tile has lost
E G^-1 E', so neither the inverse nor the root is ever put together.

A task holds three tiles, or two blocks of :data:`CHUNK` dates.  Every step is written to the shared
folder, so a lost executor costs the tasks of the running step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.session import scratch_path

#: Columns of one tile: 2 MB of doubles.
TILE = 512
#: Dates that one product of two blocks takes, and sums of products that one task adds.
CHUNK = 512
FAN_IN = 8
#: A pivot below this part of its column's own sum of squares is none.
TINY = 1e-12

_TILES = "i int, j int, chunk int, cells binary, own binary"


def _row(i: int, j: int, chunk: int, cells: np.ndarray, own: bytes | None) -> pa.Table:
    kinds = [("i", pa.int32()), ("j", pa.int32()), ("chunk", pa.int32()), ("cells", pa.binary()), ("own", pa.binary())]
    return pa.table([pa.array([v], t) for v, (_, t) in zip((i, j, chunk, np.ascontiguousarray(cells).tobytes(), own), kinds, strict=True)], names=[n for n, _ in kinds])


def _numbers(value: object, width: int) -> np.ndarray:
    return np.frombuffer(value.as_py()).reshape(-1, width)


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def products(rows: DataFrame, widths: list[int], n_dates: int) -> DataFrame:
    """Tiles ``i >= j`` of the sums over dates of products of columns, from rows ``date, block, scale, cells``.

    Every date has every block.  Cells of all blocks but the last are taken times ``scale`` where
    they meet each other, and as they are where they meet the last one.
    """
    last = len(widths) - 1
    chunks = max(1, -(-n_dates // CHUNK))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(last))))
    met = met.select(F.greatest("block", "other").alias("i"), F.least("block", "other").alias("j"), F.expr(f"cast(pmod(xxhash64(date), {chunks}) as int)").alias("chunk"), "block", "date", "scale", "cells")

    def product(table: pa.Table) -> pa.Table:
        i, j, chunk = (table.column(c)[0].as_py() for c in ("i", "j", "chunk"))
        table = table.sort_by([("block", "ascending"), ("date", "ascending")])
        block = table.column("block").to_numpy()

        def matrix(b: int) -> np.ndarray:
            part = table.filter(pa.array(block == b))
            x = part.column("cells").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, widths[b])
            return x * part.column("scale").to_numpy()[:, None] if i < last else x

        right = matrix(j)
        out = (right if i == j else matrix(i)).T @ right
        return _row(i, j, chunk, out, np.diag(out).tobytes() if i == j else None)

    def total(table: pa.Table) -> pa.Table:
        i, j, chunk = (table.column(c)[0].as_py() for c in ("i", "j", "chunk"))
        out = sum(_numbers(x, widths[j]) for x in table.column("cells"))
        return _row(i, j, chunk, out, np.diag(out).tobytes() if i == j else None)

    tiles = met.groupBy("i", "j", "chunk").applyInArrow(product, _TILES)
    while chunks > 1:
        tiles = tiles.withColumn("chunk", F.expr(f"chunk div {FAN_IN}").cast("int")).groupBy("i", "j", "chunk").applyInArrow(total, _TILES)
        chunks = -(-chunks // FAN_IN)
    return _written(tiles)


def without_block(tiles: DataFrame, k: int, widths: list[int]) -> DataFrame:
    """The tiles of the blocks after ``k`` once its columns are eliminated; NaN where a pivot vanishes."""
    last, width = len(widths) - 1, widths[k]
    column = tiles.where(F.col("j") == k)
    pivot = column.where(F.col("i") == k).withColumn("i", F.explode(F.sequence(F.lit(k + 1), F.lit(last))))
    met = column.where(F.col("i") > k).select("i", F.lit(False).alias("pivot"), "cells", "own").union(pivot.select("i", F.lit(True), "cells", "own"))

    def solve(table: pa.Table) -> pa.Table:
        at = table.column("pivot").to_pylist()
        top, below = at.index(True), at.index(False)
        a = _numbers(table.column("cells")[below], width)
        try:
            root = np.linalg.cholesky(_numbers(table.column("cells")[top], width))
            if (np.diag(root) ** 2 <= TINY * np.frombuffer(table.column("own")[top].as_py())).any():
                raise np.linalg.LinAlgError
            a = np.linalg.solve(root, a.T).T
        except np.linalg.LinAlgError:
            a = np.full(a.shape, np.nan)
        return _row(table.column("i")[0].as_py(), k, 0, a, None)

    panel = met.groupBy("i").applyInArrow(solve, _TILES)
    to = F.expr(f"concat(transform(sequence({k + 1}, i), x -> struct(i as i, x as j, 1 as role)), transform(sequence(i, {last}), x -> struct(x as i, i as j, 2 as role)))")
    sent = panel.select(F.explode(to).alias("to"), "cells").select("to.i", "to.j", "to.role", "cells", F.lit(None).cast("binary").alias("own"))
    rest = tiles.where(F.col("j") > k).select("i", "j", F.lit(0).alias("role"), "cells", "own")

    def update(table: pa.Table) -> pa.Table:
        i, j = (table.column(c)[0].as_py() for c in "ij")
        at = {role: n for n, role in enumerate(table.column("role").to_pylist())}
        left, right = (_numbers(table.column("cells")[at[r]], width) for r in (1, 2))
        return _row(i, j, 0, _numbers(table.column("cells")[at[0]], widths[j]) - left @ right.T, table.column("own")[at[0]].as_py())

    return _written(rest.union(sent).groupBy("i", "j").applyInArrow(update, _TILES))


def quadratic_forms(rows: DataFrame, widths: list[int], n_dates: int) -> list[np.ndarray]:
    """``E G^-1 E'`` for the columns of the first block, the first two and so on; E are the last block's products with them.

    Each is as large as the last block is wide.  NaN where G is singular.
    """
    last = len(widths) - 1
    tiles = products(rows, widths, n_dates)

    def corner(t: DataFrame) -> np.ndarray:
        return np.frombuffer(t.where((F.col("i") == last) & (F.col("j") == last)).first()["cells"]).reshape(widths[last], widths[last])

    start, out = corner(tiles), []
    for k in range(last):
        tiles = without_block(tiles, k, widths)
        out.append(start - corner(tiles))
    return out
