"""Line dedup: the first document that holds a line keeps it. DataFrame functions only.

Hashes of lines, with the document's salt, are range-partitioned, sorted by document and position, and first
occurrences are taken in that order. Hashes are even, so ranges of equal width are: partition i of n takes the i-th of n such ranges, and no
pass samples their bounds. Salts split a line that many documents share; only the first document of
each salt is still open afterwards, a few rows per line, and meets the others in a second, small window.
What is returned is a compressed keep bitmap per document: a map of 64-bit words, bit p of word w for line 64 w + p; a word that is absent
is all ones, and a document without any map keeps all its lines.

A document is a row's key and text: repeated rows of one key share a bitmap. Defined results: null or empty text is one
empty line; lines under ``shortest`` code points stay; a null key sorts before all others and is a document of its own;
an empty table gives an empty result; other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shuffle_partitions, text_or_empty, unused

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lowered."""
    bare = F.trim(line, F.lit(" \t\n\x0b\x0c\r"))
    ascii_ = F.octet_length(bare) == F.char_length(bare)  # there the faster function does the same
    return F.when(ascii_, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("id"), text_or_empty(text).alias("text"))


def keep_words(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 10, salts: int | None = None) -> DataFrame:
    """(id, row: hash of the text, words: keep bitmap); only documents that lose lines. ``salts``: as many as shuffle partitions, 64 at least."""
    n = shuffle_partitions(docs.sparkSession)
    salts = salts or max(64, n)
    lines = _rows(docs, key, text).select("id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("line", line_key(F.col("line"))).filter(F.char_length("line") >= shortest)
    # two hashes with different seeds: equal only for equal lines, for all practical sizes
    lines = lines.select("id", "row", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), F.pmod(F.hash("id"), F.lit(salts)).alias("salt"))
    place = F.shiftright(F.shiftrightunsigned(F.xxhash64("h", "g", "salt"), 33) * F.lit(n).cast("long"), 31).cast("int")
    dealt = lines.withColumn("range", place).repartitionById(n, F.col("range"))
    first = F.first("id").over(W.partitionBy("range", "h", "g", "salt").orderBy(F.col("id").asc_nulls_first(), "pos").rowsBetween(W.unboundedPreceding, 0))
    marked = dealt.withColumn("first", first).withColumn("later", ~F.col("id").eqNullSafe(F.col("first")))
    sure = marked.filter("later").select("id", "row", "pos")
    open_ = marked.filter("NOT later").groupBy("h", "g", "id", "row").agg(F.collect_list("pos").alias("at"))
    best = F.first("id").over(W.partitionBy("h", "g").orderBy(F.col("id").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    lost = open_.withColumn("best", best).filter(~F.col("id").eqNullSafe(F.col("best"))).select("id", "row", F.explode("at").alias("pos"))
    words = sure.unionByName(lost).groupBy("id", "row", F.expr("pos div 64").alias("word")).agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos % 64)"))).alias("bits"))
    return words.groupBy("id", "row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 10, salts: int | None = None, name: str = "__kept") -> DataFrame:
    """``docs`` (all columns) with ``name``, the keep bitmap (null: all lines)."""
    if name in docs.columns:
        raise ValueError(f"there is a column {name}; give another name")
    i, row = unused([*docs.columns, name], "__id", "__row")
    words = keep_words(docs, key, text, shortest, salts).select(F.col("id").alias(i), F.col("row").alias(row), F.col("words").alias(name))
    same = F.col(key).cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(text_or_empty(text)) == F.col(row))
    return docs.join(words, same, "left").drop(i, row)


def kept_lines(text: str = "text", kept: str = "__kept") -> Column:
    """The lines that stay, from the text and its bitmap."""
    lines = F.split(text_or_empty(text), "\n", -1)
    words = F.transform(F.sequence(F.lit(0), F.expr(f"(size(split(coalesce(`{text}`, ''), '\\n', -1)) - 1) div 64").cast("int")), lambda w: F.coalesce(F.element_at(F.col(kept), w.cast("long")), F.lit(-1).cast("long")))
    return F.when(F.col(kept).isNull(), lines).otherwise(F.filter(lines, lambda _, i: F.getbit(F.get(words, F.floor(i / 64).cast("int")), (i % 64).cast("int")) == 1))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 10, salts: int | None = None) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``. A text that loses nothing stays as it is, null too."""
    (name,) = unused(docs.columns, "__kept")
    marked = keep_bitmaps(docs, key, text, shortest, salts, name)
    kept = F.when(F.col(name).isNull(), F.col(text)).otherwise(F.array_join(kept_lines(text, name), "\n"))
    return marked.withColumn(text, kept).select(*docs.columns)
