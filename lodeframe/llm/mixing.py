"""Mixing sources to target weights with a low-discrepancy schedule.

Targets are shares of all words by weight, limited to a multiple of each source's
own words, the excess going to the others by weight.  Slots of equal length are
given to sources by golden-ratio points mapped through the cumulative targets, so
every stretch of the schedule is close to the target mix.  The r-th slot of a
source takes the r-th block of words of that source's shuffled documents, running
through them again when they end; what a document gives to the mix, and where, is read off
the slots that its words fall into.  A source that the schedule has given fewer slots than
its target fills has the last ones after the end of the schedule.

Everything is DataFrame code.  Running totals inside a source are taken over hash
ranges of bounded size and then over the ranges, so a source that holds a third of
all rows is spread over many tasks.  Only tables with one row per source go through
one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.frames import discard, free_prefix, sized, stored
from lodeframe.llm.words import WORD_PATTERN

#: Fractional part of the golden ratio, in units of 2**-31 (nearest odd number).
GOLDEN = 1327217885
_UNIT = 1 << 31
#: Documents or slots of one source that one task ranks.
RANGE_ROWS = 1_000
#: A slot is at most so many words; in small inputs a source gets about so many slots at least.
SLOT_WORDS = 256
SLOTS_PER_SOURCE = 4096


def word_count(column: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Adds ``target`` to rows ``(source, source_size)``.

    Sources in code point order, null last, take the weights in turn.  With every
    source limited to ``most`` times its size, those whose limit per weight is smallest
    reach it first: with the sources in that order, a prefix is at its limit and the
    others share what is left by weight.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    tight = Window.partitionBy(F.lit(0)).orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    all_ = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("all_words", F.sum("source_size").over(all_)).withColumn("all_weight", F.sum("weight").over(all_))
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("rest_words", F.col("all_words") - F.coalesce(F.sum("limit").over(before), F.lit(0)))
    rows = rows.withColumn("rest_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # the first source that stays under its limit fixes the rate of all that follow
    rate = F.col("rest_words") / F.col("rest_weight")
    free = F.col("limit") / F.col("weight") >= rate
    rows = rows.withColumn("rate", F.first(F.when(free, rate), ignorenulls=True).over(tight.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.select("source", "source_size", F.when(F.col("rate").isNull(), F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("rate")).alias("target"))


def _same(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Join of ``b`` onto ``a`` in which null keys meet."""
    renamed = b.select(*(F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in b.columns))
    return a.join(renamed, [a[c].eqNullSafe(renamed[f"__{c}"]) for c in on]).drop(*(f"__{c}" for c in on))


def _before(rows: DataFrame, by: list[str], part: str, order: list, value: str, out: str) -> DataFrame:
    """Running total of ``value`` before each row of a group, over parts of the group and then inside them."""
    parts = rows.groupBy(*by, part).agg(F.sum(value).alias("__sum"))
    w = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, part, F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return _same(rows, parts, [*by, part]).withColumn(out, F.col("__base") + F.col("__in")).drop("__base", "__in")


def slot_schedule(targets: DataFrame, slot_words: int, total_words: int) -> DataFrame:
    """Rows ``(source, rank, slot)``: which slots a source gets, in order.

    Slot i lies at the fractional part of i golden ratios on a line that the
    targets divide, for every i below ceil(total / slot_words).  A source keeps its first
    ceil(target / slot_words) slots.  Where the schedule gave it fewer, the missing ones
    follow after the schedule, by rank and then by source.
    """
    spark = targets.sparkSession
    ordered = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    ends = F.sum("target").over(ordered)
    whole = F.sum("target").over(Window.partitionBy(F.lit(0)))
    bounds = targets.select("source", "target", F.round(ends / whole * _UNIT).cast("long").alias("to"), (F.row_number().over(ordered) - 1).alias("turn"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("sources"))
    bounds = bounds.select("*", F.coalesce(F.lag("to").over(ordered), F.lit(0)).alias("from")).where("target > 0")
    need = F.ceil(F.col("target") / slot_words)
    n = -(-total_words // slot_words)
    # points meet sources by equal strips of the line, so neither side is broadcast
    strips = 1024
    strip = _UNIT // strips
    areas = bounds.where("to > from").withColumn("strip", F.explode(F.expr(f"sequence(from div {strip}, (to - 1) div {strip})")))
    points = spark.range(n).select(F.col("id").alias("slot"), F.expr(f"pmod((id % {_UNIT}) * {GOLDEN}L, {_UNIT}L)").alias("point"))
    points = points.withColumn("strip", F.expr(f"point div {strip}"))
    slots = points.join(areas, "strip").where("point >= from and point < to").select("source", "slot", F.expr(f"slot div {RANGE_ROWS * 16}").alias("part"), F.lit(1).alias("one"))
    ranked = _before(slots, ["source"], "part", ["slot"], "one", "rank")
    wanted = bounds.select("source", need.alias("need"), "turn", "sources")
    given = _same(ranked.select("source", "slot", "rank"), wanted, ["source"]).where("rank < need").select("source", "rank", "slot")
    count = slots.groupBy("source").agg(F.count("*").alias("given"))
    short = wanted.join(count.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")), "left").withColumn("given", F.coalesce("given", F.lit(0)))
    missing = short.where("given < need").withColumn("rank", F.explode(F.expr("sequence(given, need - 1)")))
    return given.unionByName(missing.select("source", "rank", F.expr(f"{n} + rank * sources + turn").alias("slot")))


def scheduled_turns(docs: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame]:
    """The rows ``(row, doc_id, source, size, source_size, target, ...)`` of ``docs`` (doc_id, source, text) and what the mix takes of them.

    The second table has a row ``(row, turn, words, first_slot, last_slot)`` for every time that
    the schedule runs over a document.  Documents are shuffled by a hash of their id;
    rows that tie in it are ordered by size and a hash of their text, and beyond
    that are alike in all that counts here.
    """
    rows = docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("hash"))
    rows = stored(rows)
    n_rows = rows.count()
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, most))
    total, n = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    slot_words = max(1, min(SLOT_WORDS, total // max(1, n) // SLOTS_PER_SOURCE))
    # at most so many hash ranges, each a bounded number of rows on average
    ranges = max(1, -(-n_rows // RANGE_ROWS))
    placed = rows.withColumn("part", F.expr(f"cast(conv(substring(hash, 1, 8), 16, 10) as long) * {ranges} div {1 << 32}"))
    placed = _before(placed, ["source"], "part", ["hash", "doc_id", "size", "text_hash"], "size", "at")
    placed = stored(_same(placed, targets, ["source"]).withColumn("row", F.monotonically_increasing_id()).drop("part", "hash"))
    discard(rows)
    # the source's words as often as the target reaches, cut into blocks
    turns = placed.where("size > 0").withColumn("turn", F.explode(F.expr(f"sequence(0L, {most - 1}L)"))).withColumn("from", F.expr("turn * source_size + at"))
    turns = turns.withColumn("to", F.expr("least(from + size, cast(floor(target) as long))")).where("from < to")
    pieces = turns.withColumn("rank", F.explode(F.expr(f"sequence(from div {slot_words}, (to - 1) div {slot_words})")))
    pieces = pieces.withColumn("words", F.expr(f"least(to, (rank + 1) * {slot_words}) - greatest(from, rank * {slot_words})"))
    slots = slot_schedule(targets, slot_words, total)
    taken = _same(pieces.select("row", "turn", "source", "rank", "words"), slots, ["source", "rank"])
    return placed, taken.groupBy("row", "turn").agg(F.sum("words").alias("words"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, first_slot, last_slot`` with one row per input row.

    ``size`` counts the words of a text (null: 0), ``target`` is the share of its source and
    ``taken`` the words that the mix takes of the document, repeats counted: a
    source's taken words are its target rounded down, and no document exceeds
    ``most`` times its size.  ``first_slot`` and ``last_slot`` are the ends of its places in the
    schedule, null where nothing is taken.  Documents are shuffled by a hash of their id,
    so runs agree; rows with one hash are told apart by size and text.  A null source is
    a source of its own, after all others.  Empty texts and empty tables give zeros;
    rows that share an id, null ids too, are taken separately.  Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    placed, turns = scheduled_turns(docs, weights, most)
    taken = turns.groupBy("row").agg(F.sum("words").alias("taken"), F.min("first_slot").alias("first_slot"), F.max("last_slot").alias("last_slot"))
    out = placed.join(taken, "row", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "last_slot")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``docs`` in the mix, in the order of the schedule: each row as often as its taken words come to whole texts, rounded.

    Keeps all columns.  A turn that takes half of a text or more gives a copy of the row, at
    its first slot.  Rows without words take no share and stay once, at the
    front.  Rows are told apart by id (null is an id), source and text; equal rows are
    taken equally often.  An empty table stays empty.
    """
    own = free_prefix(docs)
    id_, source, text, size, slot = (f"{own}{c}" for c in ("id", "source", "text", "size", "slot"))
    key = [F.col("doc_id").cast("long").alias(id_), F.col("source").cast("string").alias(source), F.xxhash64(F.coalesce("text", F.lit(""))).alias(text)]
    plain = docs.select(key[0].alias("doc_id"), key[1].alias("source"), "text")
    placed, turns = scheduled_turns(plain, weights, most)
    copies = placed.where("size > 0").join(turns, "row", "left").withColumn("copy", F.expr("coalesce(2 * words >= size, false)"))
    at = [F.min(F.when(F.col("copy") & (F.col("turn") == t), F.col("first_slot"))).alias(f"at{t}") for t in range(most)]
    # equal rows share the copies of all of them
    met = [F.col(c).alias(f"{own}{n}") for c, n in (("doc_id", "i"), ("source", "s"), ("text_hash", "t"))]
    copies = copies.groupBy(*met).agg(F.count_distinct("row").alias("rows"), F.count_if("copy").alias("copies"), *at)
    copies = copies.withColumn("times", F.expr("cast((2 * copies + rows) div (2 * rows) as int)")).where("times > 0")
    slots = F.expr(f"slice(array_sort(array({', '.join(f'at{t}' for t in range(most))})), 1, times)")
    copies = copies.select(f"{own}i", f"{own}s", f"{own}t", F.explode(slots).alias(slot))
    keyed = docs.select("*", *key, word_count("text").alias(size))
    same = F.col(id_).eqNullSafe(F.col(f"{own}i")) & F.col(source).eqNullSafe(F.col(f"{own}s")) & (F.col(text) == F.col(f"{own}t"))
    names = docs.columns
    some = keyed.where(F.col(size) > 0).join(sized(copies), same).select(*names, slot)
    none = keyed.where(F.col(size) == 0).select(*names, F.lit(-1).cast("long").alias(slot))
    return some.unionByName(none).repartitionByRange(slot).sortWithinPartitions(slot).select(*names)
