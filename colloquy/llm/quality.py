"""Quality rules over word and line statistics, with cross-document line frequency.

Native: DataFrame functions only.  Each text is split once in lines and words; repeated five-word
windows are found inside the row (hashes first, the windows themselves where hashes repeat).
Normalised lines (words joined by one space, lower case) are hashed and the distinct documents
that have them are counted per host; exact copies of a text are one document there.  A line in
more than ``MAX_DOCS`` documents of a host is removed, however large the host is, and a document
that keeps fewer than ``MIN_WORDS`` words or less than ``MIN_LEFT`` of its words is rejected.

Counting is pre-aggregated per task, so a line of a third of all documents is no hot key.  Null
texts have no words (base fails); a null host is a host of its own; null ids keep their rows;
repeated rows give a row each; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import as_rows, from_rows, stage

MAX_DOCS = 6
MIN_WORDS = 10
MIN_LEFT = 0.5

_SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def line_hash(ws: Column) -> Column:
    return F.xxhash64(F.lower(F.array_join(ws, " ")))


def _lines(text: Column) -> Column:
    """Lines with a word: the line and its words."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), words(x).alias("ws"))),
                    lambda x: F.size(x["ws"]) > 0)


def _covered(windows: Column, size: int) -> Column:
    """Words in windows that occur twice or more; windows: (key, position), any order."""
    def hit(s):
        return F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["w"] == x["w"]))
                        | F.coalesce(F.get(s, k + 1)["w"] == x["w"], F.lit(False)))

    def total(p):
        gaps = F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size))).cast("long"))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, b: a + b)

    return let(F.sort_array(windows), lambda s: let(F.sort_array(F.transform(hit(s), lambda x: x["i"])), total))


def repeated_words(ws: Column, size: int = 5) -> Column:
    """Number of words inside ``size``-word windows found twice or more among ``ws``."""
    n = F.size(ws) - (size - 1)
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(ws, i, F.lit(size))))
    exact = F.transform(F.sequence(F.lit(0), n - 1),
                        lambda i: F.struct(F.array_join(F.slice(ws, i + 1, F.lit(size)), " ").alias("w"), i.alias("i")))
    some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(n < 2, F.lit(0).cast("long")).when(some, _covered(exact, size)).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keys, base counts and the (hash, words) of its lines."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def stats(ls):
        return let(F.flatten(F.transform(ls, lambda x: x["ws"])), lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.char_length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            (F.size(ls) - F.size(F.array_distinct(F.transform(ls, lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
            repeated_words(ws).alias("n_repeat_words"),
            F.transform(ls, lambda x: F.struct(line_hash(x["ws"]).alias("h"), F.size(x["ws"]).alias("n"))).alias("lines")))

    rows = docs.select("doc_id", _key(), _host(), F.xxhash64(text).alias("_text"),
                       F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                       let(_lines(text), stats).alias("_s"))
    return rows.select("doc_id", "_key", "_host", "_text", "_s.n_words", "_s.word_chars", "n_symbols",
                       "_s.n_dup_lines", "_s.n_repeat_words", "_s.lines")


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_key")


def _host() -> Column:
    return F.coalesce(F.concat(F.lit("h:"), F.col("source")), F.lit("null")).alias("_host")


def frequent_lines(rows: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(_host, h) of the lines above the limit, from the rows of ``measure``."""
    one = rows.select("_host", "_text", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    # one row per (host, document, line) first: exact copies count once
    seen = one.groupBy("_host", "h", "_text").agg(F.lit(1).alias("_one")).groupBy("_host", "h").agg(F.count("*").alias("n_docs"))
    return seen.where(F.col("n_docs") > max_docs).select("_host", "h")


def judge(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """``measure`` with the hashes of the removed lines (null: none), the words left, and the verdicts."""
    rows = stage(measure(docs), "line-counts")
    cut = (rows.select("_host", "_key", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
           .join(frequent_lines(rows, max_docs), ["_host", "h"], "left_semi")
           .groupBy("_host", "_key").agg(F.collect_set("h").alias("cut")))
    rows = rows.join(cut, ["_host", "_key"], "left")
    gone = F.aggregate(F.filter("lines", lambda x: F.array_contains("cut", x["h"])), F.lit(0).cast("long"),
                       lambda a, x: a + x["n"])
    rows = rows.withColumn("n_removed_words", F.when(F.col("cut").isNull(), F.lit(0).cast("long")).otherwise(gone))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    return rows.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (left >= MIN_WORDS) & (left >= F.col("n_words") * F.lit(MIN_LEFT)))


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept", "n_removed_words")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, without their removed lines; columns as given."""
    verdict = judge(docs).where("kept").select("_host", "_key", "_text", "cut").dropDuplicates(["_host", "_key", "_text"])
    keyed = as_rows(docs).select("row", "text", _host(), _key(), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_text"))
    lines = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("cut", line_hash(words(x))))
    text = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    return from_rows(keyed.join(verdict, ["_host", "_key", "_text"]), text)
