"""Dropping lines whose log template recurs across documents.

A line descends a tree of fixed depth: first by its number of words, then by its leading
words, in which words with digits count as a variable field.  In its leaf, a word
beyond the leading ones stays a constant if it occurs at its place in enough documents; the
others are variable fields too.  The constants that are left are the line's template, and
a leaf has as many templates as its lines show.  A template that is constant enough, in
one word at least beyond the leading ones, and occurs in enough documents is dropped with
all its lines.  So are the lines that agree with a leaf's most frequent line in
enough words, if they are in enough documents together.

Everything is DataFrame code in a fixed number of aggregations.  Only hashes are shuffled
to find the leaves that recur; texts meet the list of dropped lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.frames import discard, sized, stored

#: Words that lead to a leaf.
DEPTH = 3
#: Documents in which a template must occur to be dropped.
MIN_DOCS = 5
#: Share of constant words, in percent, of a template that is dropped.
SIMILARITY = 60
FIELD = "<*>"
_SPACE = r"[\x20\x09-\x0D]+"
#: Words with a digit, tried only where a word begins and without stepping back.
_FIELDS = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def _hash(c: Column) -> Column:
    """md5 in 16 bytes; known not to be null, or joins on it would compute it twice to make sure."""
    return F.coalesce(F.unhex(F.md5(c)), F.lit(b""))


def line_table(docs: DataFrame) -> DataFrame:
    """``(doc, text_key, no, words, leaf)`` of every line that has words; words with digits are fields."""
    # hashed and split below the explosion, which otherwise hashes the whole text for every line
    whole = docs.select(F.col("doc_id").alias("doc"), _hash("text").alias("text_key"), F.split("text", "\n").alias("lines"))
    white = F.lit(" \t\n\x0b\f\r")
    # the outer form, as the other first splits every text again to leave out those without lines, and there are none
    lines = whole.select("doc", "text_key", F.posexplode_outer("lines").alias("no", "line")).where(F.btrim("line", white) != "")
    digits = F.col("line").rlike("[0-9]")
    masked = F.when(digits, F.regexp_replace("line", _FIELDS, FIELD)).otherwise(F.col("line"))
    trimmed = lines.select("doc", "text_key", "no", F.btrim(masked, white).alias("line"))
    rows = trimmed.select("doc", "text_key", "no", F.split("line", _SPACE).alias("words"))
    leaf = _hash(F.concat_ws(" ", F.size("words").cast("string"), F.slice("words", 1, DEPTH)))
    return rows.select("doc", "text_key", "no", "words", leaf.alias("leaf"))


def _agrees(words: str, template: str, similarity: int) -> Column:
    """Enough equal words; the leading words, equal in a whole leaf, are not enough by themselves."""
    agree = F.size(F.filter(F.zip_with(words, template, lambda a, b: a == b), lambda x: x))
    return (100 * agree >= similarity * F.size(words)) & ((F.size(words) <= DEPTH) | (agree > DEPTH))


def _recurring(rows: DataFrame, keys: list[str], min_docs: int) -> DataFrame:
    """The keys that occur in enough documents."""
    return rows.select(*keys, "doc").distinct().groupBy(*keys).agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select(*keys)


def dropped_forms(once: DataFrame, min_docs: int, similarity: int) -> DataFrame:
    """``leaf, form`` of the lines to drop, from ``(doc, leaf, form, words)`` with each form once per document."""
    key = ["leaf", "form"]
    forms = stored(once.groupBy(*key).agg(F.first("words").alias("words"), F.count("*").alias("docs")))
    # lines like the most frequent one of their leaf
    best = forms.groupBy("leaf").agg(F.max(F.struct("docs", "form", F.col("words").alias("template"))).alias("b")).select("leaf", "b.template")
    alike = stored(forms.join(sized(best), "leaf").where(_agrees("words", "template", similarity)).select(*key))
    by_best = alike.join(sized(_recurring(once.join(alike, key, "left_semi"), ["leaf"], min_docs)), "leaf", "left_semi")
    # lines whose constants recur
    def places(rows: DataFrame, *columns: object) -> DataFrame:
        """Words beyond the leading ones; ``at`` stands for (leaf, place, word)."""
        rows = rows.select("leaf", *columns, F.posexplode("words").alias("place", "word")).where(f"place >= {DEPTH}")
        return rows.withColumn("at", F.xxhash64("leaf", "place", "word"))

    common = sized(_recurring(places(once, "doc"), ["at"], min_docs))
    constant = places(forms, "form", F.size("words").alias("n")).join(common, "at", "left_semi")
    templates = constant.groupBy(*key, "n").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("kept"))
    name = _hash(F.array_join(F.transform("kept", lambda k: F.concat_ws(" ", k["place"].cast("string"), k["word"])), " "))
    templates = stored(templates.where(100 * (F.size("kept") + DEPTH) >= similarity * F.col("n")).select(*key, name.alias("template")))
    recurring = sized(_recurring(once.join(templates, key), ["leaf", "template"], min_docs))
    by_template = templates.join(recurring, ["leaf", "template"], "left_semi").select(*key)
    short = forms.where((F.size("words") <= DEPTH) & (F.col("docs") >= min_docs)).select(*key)
    return by_best.unionByName(by_template).unionByName(short).distinct()


def drop_template_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` with one row per input row.

    Lines are parted by line feeds; a line without words, or of words with digits only, is
    never dropped.  Null and empty texts have no lines and an empty ``kept_text``.
    Documents are told apart by id, null ids counting as one document; equal rows get
    equal results.  Of a leaf's most frequent lines the one with the largest md5 stands for
    the others.  Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = line_table(docs.where("text <> ''"))
    # only lines of recurring leaves are needed as words
    open_ = stored(lines.join(sized(_recurring(lines, ["leaf"], min_docs)), "leaf", "left_semi"))
    formed = open_.where(F.exists("words", lambda w: w != FIELD)).withColumn("form", _hash(F.array_join("words", " ")))
    once = stored(formed.groupBy("leaf", "form", "doc").agg(F.first("words").alias("words")))
    gone = sized(dropped_forms(once, min_docs, similarity))
    cut = formed.join(gone, ["leaf", "form"], "left_semi").select("text_key", "no").distinct().groupBy("text_key").agg(F.collect_list("no").alias("cut"))
    cut = sized(cut)
    discard(open_, once)
    rows = docs.withColumn("text_key", _hash("text")).join(cut, "text_key", "left")
    rows = rows.withColumn("lines", F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", "\n")))
    # positions by set difference, so that long texts with many dropped lines stay linear
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "cut")
    kept = F.when(F.col("cut").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.get("lines", i)))
    n = F.size("lines").cast("long")
    rows = rows.withColumn("kept", kept)
    return rows.select("doc_id", n.alias("n_lines"), (n - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))
