"""Similarity join of documents on word n-gram sets.

Two documents link when the Jaccard similarity of their shingle sets reaches a
threshold; the result carries the connected components of those links.

*Tiles.*  A set of ``n`` 64-bit shingle hashes belongs to the size band
``[2**b, 2**(b+1))``, and near a band border also to the tile row that joins the
two bands.  Inside a tile row the hash range is cut into ``m`` segments.  Linked
sets of sizes x and y differ in at most ``d = (x+y)(100-p)/(100+p)`` elements, so of
any ``d+1`` non-empty segments at least one is equal in both, and the first such
segment is among the first ``d+1`` non-empty ones of either set.  Each set
therefore names only its first ``d+1`` segments by digest: a tile is the group of
sets that share one.  (Sets with too few non-empty segments repeat this with a
rehash; the last round names empty segments as well, so no link is lost.)

*Bounds.*  In a tile every set is compared with one hub, the member that shares most
tiles with others, not with every other.  A candidate must pass the size ratio and a bitmap bound: a bit set
in one bitmap only stands for an element missing from the other set, so the bit
counts bound the overlap from above.  Survivors are decided by intersecting the
sorted hash arrays.  Tiles left with more than one component after that compare
the sets of different components, block against block of a bounded size; only pairs
that pass the bound leave a task.  Of tiles with the same members one is enough there, as near
copies share most of their tiles, and a pair that shares one of the first few tiles of both leaves
from the first of these only; what leaves twice is made one afterwards.

*Skew.*  Every task first collapses equal tiles among its own rows, so a tile that
a third of all documents share arrives as one row per batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.frames import discard, mapped, pick, sized, stored
from lodeframe.llm.graph import connected_components
from lodeframe.llm.words import Words, encoded_blocks, mix, shingle_hashes

_ROUNDS = 8
#: Most documents in one block of a tile.
BLOCK_ROWS = 1024
#: Tiles of a document that travel with each of its members: were it all, they would grow with their square.
EARLIER = 16
_U32 = np.uint64(32)
_TILE_CUT = np.uint64(16)


def shingle_sets(raw: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z folded; fewer than ``k`` words make one shingle."""
    words = Words(raw)
    hashes = words.hashes(lower=True)
    runs = shingle_hashes(hashes, k)
    out = []
    for first, last in zip(words.doc_first[:-1], words.doc_first[1:], strict=True):
        if last - first >= k:
            out.append(np.unique(runs[first : last - k + 1]))
        elif last > first:
            short = shingle_hashes(hashes[first:last], int(last - first))
            out.append(mix(short + np.uint64(last - first)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def bitmap(elements: np.ndarray) -> bytes:
    """Bitmap of at least four times as many bits as elements (a power of two, 64 at least)."""
    bits = max(64, 1 << (4 * len(elements) - 1).bit_length()) if len(elements) else 64
    flags = np.zeros(bits, np.uint8)
    flags[(elements & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def fold(bits: bytes) -> bytes:
    """Half as many bits; elements that met in one bit before still do."""
    words = np.frombuffer(bits, np.uint64)
    return (words[: len(words) // 2] | words[len(words) // 2 :]).tobytes() if len(words) > 1 else bits


def overlap_bound(x: bytes, nx: int, y: bytes, ny: int) -> int:
    """Upper bound of the intersection size of two sets from their bitmaps."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = np.frombuffer(fold(a.tobytes()), np.uint64)
    while len(b) > len(a):
        b = np.frombuffer(fold(b.tobytes()), np.uint64)
    only_x = int(np.bitwise_count(a & ~b).sum())
    only_y = int(np.bitwise_count(b & ~a).sum())
    return min(nx - only_x, ny - only_y)


@cache
def tile_rows(n: int, percent: int) -> tuple[tuple[int, int, int], ...]:
    """For a set of ``n``: (tile row id, segments in that row, segments this set must name)."""

    def differ(total: int) -> int:
        return total * (100 - percent) // (100 + percent)

    def segments(most: int) -> int:
        return 1 if most == 1 else most + most // 16 + 1

    band = n.bit_length() - 1
    top = (2 << band) - 1
    partner = n * 100 // percent
    rows = [(2 * band, segments(differ(2 * top) + 1), differ(n + min(top, partner)) + 1)]
    for border, below in ((2 << band, True), (1 << band, False)):
        largest = (border - 1) * 100 // percent
        if (below and partner >= border) or (not below and n <= largest):
            total = n + (partner if below else border - 1)
            rows.append((2 * (border.bit_length() - 1) - 1, segments(differ(border - 1 + largest) + 1), differ(total) + 1))
    return tuple(rows)


def tiles_of(elements: np.ndarray, percent: int) -> np.ndarray:
    """The tiles (64-bit digests) that a sorted set belongs to."""
    n = len(elements)
    if n == 0:
        return np.zeros(0, np.uint64)
    out = []
    for row, segments, need in tile_rows(n, percent):
        values = elements
        for turn in range(_ROUNDS):
            if turn:
                values = np.sort(mix(elements + np.uint64(turn)))
            place = ((values >> _U32) * np.uint64(segments)) >> _U32
            first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(0x5DEECE66D)))))
            last = np.append(first[1:], n)
            digest = (total[last] - total[first])[:need]
            salt = np.uint64((row * _ROUNDS + turn) << 40)
            out.append(mix(digest + mix(place[first[:need]] + salt)))
            if len(first) >= need:
                break
        else:
            empty = np.setdiff1d(np.arange(segments, dtype=np.uint64), place)
            out.append(mix(mix(empty + np.uint64((row * _ROUNDS + _ROUNDS - 1) << 40))))
    return np.concatenate(out)


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, one, two, bits = [], [], [], []
            for _, raw in encoded_blocks(batch.column("text")):
                for s in shingle_sets(raw, k):
                    sizes.append(len(s))
                    one.append(int(mix(s).sum(dtype=np.uint64)))
                    two.append(int(mix(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)))
                    bits.append(bitmap(s))
            as_long = lambda v: pa.array(np.array(v, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), as_long(one), as_long(two), pa.array(bits, pa.binary())], names=["doc_id", "n", "f1", "f2", "bits"])

    return run


def _tile_rows(k: int, percent: int):
    """Rows (tile, rep, doc, score): of the rows of a batch that share a tile one is the head (rep = doc).

    Tiles keep 48 of their bits, so that less travels: tiles that fall together only add candidates.
    The head is the document that shares most tiles with others of the batch, its
    score; near the centre of a group of copies that number is largest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            tiles, docs = [], []
            for first, raw in encoded_blocks(batch.column("text")):
                for i, s in enumerate(shingle_sets(raw, k)):
                    t = tiles_of(s, percent)
                    tiles.append(t)
                    docs.append(np.full(len(t), ids[first + i], np.int64))
            if not tiles:
                continue
            tile, doc = np.concatenate(tiles) >> _TILE_CUT, np.concatenate(docs)
            order = np.lexsort((doc, tile))
            tile, doc = tile[order], doc[order]
            once = np.ones(len(tile), bool)
            once[1:] = (tile[1:] != tile[:-1]) | (doc[1:] != doc[:-1])
            tile, doc = tile[once], doc[once]
            new = np.ones(len(tile), bool)
            new[1:] = tile[1:] != tile[:-1]
            shared = ~new
            shared[:-1] |= ~new[1:]
            names, place = np.unique(doc, return_inverse=True)
            score = np.bincount(place, shared, len(names)).astype(np.int32)[place]
            order = np.lexsort((doc, -score, tile))
            tile, doc, score = tile[order], doc[order], score[order]
            rep = doc[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(new) else doc
            order = np.argsort(doc, kind="stable")  # rows of a document together compress best
            cols = [pa.array(x[order]) for x in (tile.view(np.int64), rep, doc, score)]
            yield pa.RecordBatch.from_arrays(cols, names=["tile", "rep", "doc", "score"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (tile, score descending): (tile, hub, doc), heads on the tile's first head, others on their own head."""
    last_tile, hub = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        tile, rep, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "rep", "doc"))
        rep = rep.copy()
        at = np.flatnonzero(rep == doc)
        if len(at):
            t, d = tile[at], doc[at]
            new = np.ones(len(t), bool)
            new[1:] = t[1:] != t[:-1]
            new[0] = last_tile is None or t[0] != last_tile
            hubs = np.concatenate(([hub if hub is not None else 0], d[new]))
            rep[at] = hubs[np.cumsum(new)]
            last_tile, hub = t[-1], rep[at[-1]]
        keep = rep != doc
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (tile, rep, doc)], names=["tile", "hub", "doc"])


def _bounded(percent: int):
    """Of candidate pairs with sizes and bitmaps: those whose bound still allows a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b")), strict=True):
                c = overlap_bound(x, na, y, nb)
                keep.append(100 * c >= percent * (na + nb - c))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _intersections(k: int, percent: int):
    """Rows sorted by (a, salt, role): the set of ``a`` first, then its partners; yields the linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchors = None, []
        for batch in batches:
            a, salt, role, doc = (batch.column(c).to_pylist() for c in ("a", "salt", "role", "doc_id"))
            left, right = [], []
            for first, raw in encoded_blocks(batch.column("text")):
                for i, s in enumerate(shingle_sets(raw, k), first):
                    if key != (a[i], salt[i]):
                        key, anchors = (a[i], salt[i]), []
                    if role[i] == 0:
                        anchors.append(s)
                        continue
                    for anchor in anchors:
                        common = len(np.intersect1d(anchor, s, assume_unique=True))
                        if 100 * common >= percent * (len(anchor) + len(s) - common):
                            left.append(a[i])
                            right.append(doc[i])
                            break
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, over batch borders, as one table each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
        change = np.zeros(batch.num_rows, bool)
        change[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        if held:
            last = [held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in keys]
            change[0] = any(c[0] != x for c, x in zip(columns, last, strict=True))
        starts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        if starts[0]:
            held.append(batch.slice(0, starts[0]))
        for start, end in zip(starts[:-1], starts[1:], strict=True):
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(start, end - start)]
    if held:
        yield pa.Table.from_batches(held)


def _across(percent: int):
    """Blocks of a tile, rows sorted by (tile, lo, hi): pairs of different components that pass the bound."""

    def words_of(sketches: list[bytes]) -> np.ndarray:
        width = min(map(len, sketches))
        out = []
        for s in sketches:
            while len(s) > width:
                s = fold(s)
            out.append(s)
        return np.frombuffer(b"".join(out), np.uint64).reshape(len(out), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_a, found_b = [], []
        for rows in _groups(batches, ["tile", "lo", "hi"]):
            block, doc, part, least, most = (rows.column(c).to_numpy() for c in ("block", "doc", "part", "least", "most"))
            lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
            bits = words_of(rows.column("bits").to_pylist())
            lists, known = rows.column("earlier"), {}

            def earlier(row: int, lists: pa.ChunkedArray = lists, known: dict[int, set[int]] = known) -> set[int]:
                if row not in known:
                    known[row] = set(lists[row].as_py())
                return known[row]

            left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
            step = max(1, (1 << 21) // (8 * bits.shape[1] * max(1, len(right))))
            for at in range(0, len(left), step):
                x = left[at : at + step]
                open_ = (part[x][:, None] != part[right]) & (100 * most[x][:, None] >= percent * least[right]) & (100 * most[right] >= percent * least[x][:, None])
                if lo == hi:
                    open_ &= doc[x][:, None] < doc[right]
                i, j = np.nonzero(open_)
                if not len(i):
                    continue
                a, b = bits[x[i]], bits[right[j]]
                na, nb = most[x[i]], most[right[j]]
                c = np.minimum(na - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), nb - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
                # with several rows of one id the sizes are ranges; the bound then holds for the largest only
                ok = (100 * c >= percent * (na + nb - c)) | (least[x[i]] != na) | (least[right[j]] != nb)
                i, j = x[i[ok]], right[j[ok]]
                # a pair that is known to share an earlier tile is met there
                first = np.fromiter((earlier(m).isdisjoint(earlier(n)) for m, n in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
                p, q = doc[i[first]], doc[j[first]]
                found_a.append(np.minimum(p, q))
                found_b.append(np.maximum(p, q))
            if sum(map(len, found_a)) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], names=["a", "b"])
                found_a, found_b = [], []
        if found_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], names=["a", "b"])

    return run


def _links(pairs: DataFrame, sets: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b): those that link.  Sizes meet the pairs before bitmaps do, bitmaps before texts."""
    of = lambda c, *more: sets.select(F.col("doc_id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in more))
    close = pairs.join(of("a", "n"), "a").join(of("b", "n"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b").distinct()
    wide = close.join(of("a", "n", "bits"), "a").join(of("b", "n", "bits"), "b")
    open_ = stored(mapped(wide, _bounded(percent), "a long, b long").distinct())
    # a's text goes once to every 64 or so of its partners
    many = open_.groupBy("a").agg(F.ceil(F.count("*") / 64).alias("parts"))
    salted = open_.join(many, "a").select("a", "b", F.expr("cast(pmod(xxhash64(b), parts) as int)").alias("salt"))
    asked = salted.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("doc_id")).unionByName(
        salted.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("doc_id"))
    )
    met = asked.join(pick(texts, asked.select("doc_id")), "doc_id").select("a", "salt", "role", "doc_id", "text")
    met = met.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return mapped(met, _intersections(k, percent), "a long, b long")


def _mixed_tiles(stars: DataFrame, tried: DataFrame, links: DataFrame, parts: DataFrame) -> DataFrame:
    """Tiles with a compared pair that lies in two components, and with a pair that has not been compared."""
    label = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    apart = tried.join(links, ["a", "b"], "left_anti").join(label("a"), "a", "left").join(label("b"), "b", "left")
    apart = sized(apart.where("coalesce(a_part, a) <> coalesce(b_part, b)").select("a", "b", F.lit(1).alias("apart")))
    pairs = stars.select("tile", F.least("hub", "doc").alias("a"), F.greatest("hub", "doc").alias("b"))
    status = pairs.join(apart, ["a", "b"], "left").groupBy("tile").agg(F.count("*").alias("others"), F.max("apart").alias("apart"))
    return status.where("apart = 1 and others > 1").select("tile")


def _across_tiles(stars: DataFrame, mixed: DataFrame, sets: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a mixed tile and pass the bound, block against block."""
    rows = stars.join(mixed, "tile", "left_semi")
    every = stored(rows.select("tile", "doc").unionByName(rows.select("tile", F.col("hub").alias("doc"))).distinct())
    # members of a tile are told by their number and 128 bits of their hashes
    alike = every.groupBy("tile").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("doc")).alias("f1"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("f2"))
    sizes = alike.groupBy("size", "f1", "f2").agg(F.min("tile").alias("tile")).select("tile", F.ceil(F.col("size") / BLOCK_ROWS).alias("blocks"))
    members = stored(every.join(sizes, "tile"))
    discard(every, shuffles=False)
    sketch = sets.groupBy(F.col("doc_id").alias("doc")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max_by("bits", "n").alias("bits"))
    sketch = sketch.join(parts.withColumnRenamed("node", "doc"), "doc", "left").withColumn("part", F.coalesce("component", "doc"))
    sketch = sketch.join(members.groupBy("doc").agg(F.slice(F.sort_array(F.collect_list("tile")), 1, EARLIER).alias("tiles")), "doc")
    dealt = members.join(sketch, "doc").withColumn("earlier", F.expr("filter(tiles, t -> t < tile)")).withColumn("block", F.expr("pmod(xxhash64(doc), blocks)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    dealt = dealt.select("tile", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "doc", "part", "least", "most", "bits", "earlier")
    dealt = dealt.repartition("tile", "lo", "hi").sortWithinPartitions("tile", "lo", "hi")
    return mapped(dealt, _across(percent), "a long, b long")


def ngram_jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate classes of ``docs``.

    Returns ``doc_id, n_shingles, component_id`` with one row per input row:
    ``n_shingles`` is the size of the shingle set and ``component_id`` the smallest
    id reachable over links, the row's own included.  Two documents link when
    ``100 * |intersection| >= percent * |union|`` of their sets of ``k``-word shingles
    (A-Z folded; a text with fewer than ``k`` words is one shingle).

    Null, empty and blank texts have no shingles and link with nothing.  A null id
    takes no part in links and has a null component.  Rows that share an id are one
    document, linked wherever one of its rows is.  Other columns are ignored; an
    empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = texts.where("doc_id is not null")
    sets = stored(mapped(texts, _set_rows(k), "doc_id long, n long, f1 long, f2 long, bits binary"))
    own = sets.where("doc_id is not null and n > 0")
    # equal sets link; the smallest id of a class stands for it from here on
    same = ["n", "f1", "f2"]
    classes = own.groupBy(*same).agg(F.min("doc_id").alias("head"))
    members = stored(own.select("doc_id", *same).join(classes, same).select("doc_id", "head"))
    by_id = members.groupBy("doc_id").agg(F.min("head").alias("head"), F.max("head").alias("other"), F.max(F.expr("head = doc_id")).alias("stands"))
    by_id = stored(by_id)
    alone = known.join(sized(by_id.where("not stands").select("doc_id")), "doc_id", "left_anti")
    tiles = mapped(alone, _tile_rows(k, percent), "tile long, rep long, doc long, score int")
    # heads of a tile meet; the others are dealt over all tasks
    tiles = tiles.repartition(F.when(F.col("rep") == F.col("doc"), F.col("tile")).otherwise(F.xxhash64("tile", "doc"))).sortWithinPartitions("tile", F.desc("score"), "doc")
    stars = stored(mapped(tiles, _stars, "tile long, hub long, doc long"))
    discard(members)
    tried = stored(stars.select(F.least("hub", "doc").alias("a"), F.greatest("hub", "doc").alias("b")).distinct())
    links = stored(_links(tried, own, alone, k, percent))
    # the classes of an id's rows belong together
    shared = by_id.where("head <> other").select(F.col("head").alias("a"), F.col("other").alias("b"))
    parts = connected_components(links.unionByName(shared))
    # a tile can still join components where one of its compared pairs lies in two
    mixed = sized(_mixed_tiles(stars, tried, links, parts))
    across = stored(_across_tiles(stars, mixed, own, parts, percent).distinct().join(tried, ["a", "b"], "left_anti"))
    discard(stars, tried, links, mixed)
    more = _links(across, own, alone, k, percent)
    # links that join components, as links between their names
    label = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    named = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b"))
    joined = connected_components(named).select(F.col("node").alias("own"), F.col("component").alias("top"))
    top = by_id.select("doc_id", F.col("head").alias("node")).join(parts, "node", "left").select("doc_id", F.coalesce("component", "node").alias("own"))
    top = stored(top.join(joined, "own", "left").select("doc_id", F.coalesce("top", "own").alias("component_id")))
    slim = stored(sets.select("doc_id", F.col("n").alias("n_shingles")))
    discard(sets, by_id, across)
    return slim.join(top, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_similar(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with only the document of the smallest id of each component."""
    parts = ngram_jaccard_components(docs, k, percent)
    gone = sized(parts.where("component_id <> doc_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
