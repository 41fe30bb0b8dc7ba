"""BM25 keyword search over a text column.

A stored index holds postings (term, document, its length, term frequency), clustered by term, and
the corpus statistics; a query reads the postings of its own terms (pushed-down filter, row groups
skipped by their term range) and no text.  Without an index the same scores come from two passes
over the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.gold import gold_table, input_bytes
from colloquy.operators.records import enriched
from colloquy.rules import SEARCH_B, SEARCH_K1, SEARCH_MAX_K, SEARCH_TOP_K
from colloquy.sources.tables import table

TOKEN_PATTERN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Unicode word tokens of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), 0)


def query_terms(query: str) -> Counter:
    """Tokenise the (small) query string itself; repeated terms count again."""
    return Counter(re.findall(r"\w+", query.lower()))


def corpus_stats(docs: DataFrame, terms: list) -> tuple:
    """(N, avgdl, {term: df}) in ONE aggregate pass over the corpus: a single row whose
    width is bounded by the number of query terms (map-side combined)."""
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("avgdl")]
    aggs += [F.count_if(F.array_contains("tokens", F.lit(t))).alias(f"df{i}") for i, t in enumerate(terms)]
    row = docs.agg(*aggs).first()
    return int(row["n"]), float(row["avgdl"] or 0.0), {t: int(row[f"df{i}"]) for i, t in enumerate(terms)}


class Index(NamedTuple):
    """Stored search index: stats (n_docs, sum_dl; one row per appended part), term_df (term, df;
    one row per term and part) and postings (term, doc_id, dl, tf)."""

    stats: DataFrame
    term_df: DataFrame
    postings: DataFrame

    def plus(self, other: Index) -> Index:
        """The index with new documents appended: three unions, nothing is rebuilt."""
        return Index(*(a.unionByName(b) for a, b in zip(self, other)))


#: Slots by a hash of the id that a term's postings are dealt to; input bytes whose postings one task sorts.
SLOTS = 4096
BYTES_PER_TASK = 8 << 20


def term_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, dl, term, tf) of every row of (doc_id, tokens): the row's sorted tokens in runs, without a shuffle."""
    t = docs.select("doc_id", F.sort_array("tokens").alias("_s"))
    first = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1)))
    t = t.select("doc_id", "_s", F.when(F.size("_s") > 0, first).alias("_f"))
    runs = F.transform("_f", lambda i, j: F.struct(F.get("_s", i).alias("term"),
                                                   (F.coalesce(F.get("_f", j + 1), F.size("_s")) - i).cast("bigint").alias("tf")))
    # the outer form keeps Spark from testing the size of the runs by making them twice
    return t.select("doc_id", F.size("_s").alias("dl"), F.inline_outer(runs)).where(F.col("term").isNotNull())


def postings(docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """(term, doc_id, dl, tf) of (doc_id, tokens) rows, in ranges of (term, slot by a hash of the id): a
    query's terms are few row groups, and a term of most documents spans many partitions.

    Counted per row, shuffled once; rows that share id, length and term meet in a range and are
    added up there.  ``tasks``: the ranges, if more than there are shuffle partitions."""
    rows = term_counts(docs).select("term", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).alias("_h"), "doc_id", "dl", "tf")
    many = tasks and tasks > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(*([tasks] if many else []), "term", "_h")
    return (dealt.groupBy("term", "_h", "doc_id", "dl").agg(F.sum("tf").alias("tf"))
            .sortWithinPartitions("term", "_h").select("term", "doc_id", "dl", "tf"))


def corpus_index(docs: DataFrame, n_docs: DataFrame | None = None, stored: DataFrame | None = None) -> Index:
    """Index of (doc_id, tokens) rows.  The statistics are counted on the postings (``stored``, if
    they are materialised) and on ``n_docs`` (any table with one row per document), so the text is
    read once.  Per-term counts are combined map-side: a frequent term is no hot key."""
    post = postings(docs) if stored is None else stored
    total = post.agg(F.sum("tf").cast("bigint").alias("sum_dl"))
    n = (docs if n_docs is None else n_docs).agg(F.count(F.lit(1)).alias("n_docs"))
    stats = (n.select("n_docs", F.lit(None).cast("bigint").alias("sum_dl"))
             .unionByName(total.select(F.lit(None).cast("bigint").alias("n_docs"), "sum_dl"))
             .agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_dl").alias("sum_dl")))
    return Index(stats, post.groupBy("term").agg(F.count(F.lit(1)).alias("df")), post)


def indexed_stats(stats: DataFrame, term_df: DataFrame, terms: list) -> tuple:
    """(N, avgdl, {term: df}) from a stored index: one row per query term."""
    row = stats.agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_dl").alias("sum_dl")).first()
    n = int(row["n_docs"] or 0)
    avgdl = (row["sum_dl"] or 0) / n if n else 0.0
    found = term_df.filter(F.col("term").isin(*terms)).groupBy("term").agg(F.sum("df").alias("df")).collect()
    got = {r["term"]: int(r["df"]) for r in found}
    return n, float(avgdl), {t: got.get(t, 0) for t in terms}


def stored_index(spark: SparkSession, name: str, inputs: list, docs: Callable[[], DataFrame]) -> Index:
    """The gold index of ``docs()`` (doc_id, tokens), built once per input and code fingerprint."""
    post = gold_table(spark, f"{name}-postings", inputs, "bm25", lambda: postings(docs(), -(-input_bytes(spark, inputs) // BYTES_PER_TASK)))
    lazy = lambda: corpus_index(docs(), n_docs=docs().select("doc_id"), stored=post)
    return Index(gold_table(spark, f"{name}-stats", inputs, "bm25", lambda: lazy().stats),
                 gold_table(spark, f"{name}-terms", inputs, "bm25", lambda: lazy().term_df, sort_by=["term"]), post)


def document_index(spark: SparkSession, sf_dir: str) -> Index:
    """Gold index of ``documents``."""
    return stored_index(spark, "doc", [f"{sf_dir.rstrip('/')}/documents.parquet"],
                        lambda: table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("tokens")))


def records_index(spark: SparkSession, sf_dir: str, version: str) -> Index:
    """Gold index of the record search documents (per document version)."""
    src = [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("orders", "customer", "lineitem")]
    return stored_index(spark, f"rec-{version}", src, lambda: enriched(spark, sf_dir).select(
        F.col("meeting_id").alias("doc_id"), tokens(record_doc(version)).alias("tokens")))


def bm25(df: DataFrame, id_col: str, text: Column, query: str, k1: float = SEARCH_K1, b: float = SEARCH_B,
         index: Index | None = None) -> DataFrame:
    """Score every document with at least one query term: (id, score).

    With a stored ``index`` the query reads the postings of its terms and never the text.
    Without one it makes two passes over the text: the corpus statistics (one aggregate row)
    and the hits.  The per-term constants are literals in the plan (no join, no broadcast)."""
    q = query_terms(query)
    spark = df.sparkSession
    terms = list(q)
    if not terms:
        return spark.createDataFrame([], "doc_id string, score double").select(F.col("doc_id").alias(id_col), "score")
    docs = df.select(F.col(id_col).alias("doc_id"), tokens(text).alias("tokens"))
    n_docs, avgdl, dfs = indexed_stats(index.stats, index.term_df, terms) if index is not None else corpus_stats(docs, terms)
    if n_docs == 0:
        return spark.createDataFrame([], "doc_id string, score double").select(F.col("doc_id").alias(id_col), "score")
    # weight(term) = query count * idf(term), a literal per term
    weight = None
    for t in terms:
        d = dfs[t]
        w = F.lit(q[t]) * F.log(F.lit((n_docs - d + 0.5) / (d + 0.5)) + F.lit(1.0))
        weight = F.when(F.col("term") == t, w) if weight is None else weight.when(F.col("term") == t, w)
    if index is not None:
        hits = index.postings.filter(F.col("term").isin(*terms))
    else:
        hits = _scan_hits(df, id_col, text, terms)
    norm = F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(avgdl))
    contrib = weight * (F.col("tf") * F.lit(k1 + 1)) / norm
    return hits.groupBy("doc_id").agg(F.sum(contrib).alias("score")).select(F.col("doc_id").alias(id_col), "score")


def _scan_hits(df: DataFrame, id_col: str, text: Column, terms: list) -> DataFrame:
    """(doc_id, dl, term, tf) of the query terms from the text itself.  A token equal to a term
    implies that the lower-cased text contains it, so texts with none of the terms as a substring
    are not tokenised (exact), and only tokens equal to a term are exploded."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    maybe = df.filter(F.coalesce(lowered.rlike("|".join("\\Q" + t + "\\E" for t in terms)), F.lit(False)))
    docs = maybe.select(F.col(id_col).alias("doc_id"), tokens(text).alias("tokens"))
    return (docs.select("doc_id", F.size("tokens").alias("dl"),
                        F.explode(F.filter("tokens", lambda t: t.isin(*terms))).alias("term"))
            .groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))


def top_k(scores: DataFrame, id_col: str, k: int = SEARCH_TOP_K) -> DataFrame:
    """k clamped to 1..20; positive scores only; ties broken by id.  The limit is the
    feature (a top-k report): TakeOrderedAndProject keeps k rows per partition."""
    k = min(max(1, int(k)), SEARCH_MAX_K)
    r = F.floor(F.col("score") * 1_000_000 + 0.5) / 1_000_000
    return (scores.filter(F.col("score") > 0).select(id_col, r.alias("score"))
            .orderBy(F.col("score").desc(), id_col).limit(k))


def record_doc(version: str = "chat") -> Column:
    """Search document of a record: the chat version (8 fields, issue title else description,
    first 3 issues) or the server version (5 fields)."""
    issues = F.array_join(F.transform(F.slice(F.coalesce("issues", F.array().cast(
        "array<struct<title:string,severity:string,type:string>>")), 1, 3),
        lambda i: F.coalesce(i["title"], F.lit(""))), " ")
    if version == "chat":
        fields = ["title", "account_name", "call_type", "category", "sentiment_label", "escalation_team",
                  "escalation_priority"]
    else:
        fields = ["title", "call_type", "category", "sentiment_label"]
    parts = [F.nullif(F.col(f), F.lit("")) for f in fields] + [F.nullif(issues, F.lit(""))]
    return F.concat_ws(" ", *parts)


def context_block(hit: DataFrame) -> DataFrame:
    """D-25: one text block per retrieved record."""
    issues = F.array_join(F.transform(F.slice("issues", 1, 3), lambda i: F.concat(
        F.upper(F.coalesce(i["severity"], F.lit("?"))), F.lit(": "), F.coalesce(i["title"], F.lit("")))), "; ")
    block = F.format_string(
        "meeting_id:  %s\ntitle:       %s\naccount:     %s\ncall_type:   %s\ncategory:    %s\n"
        "sentiment:   %s  (score=%s  z=%s  anomaly=%s)\nescalation:  team=%s  priority=%s  pagerduty=%s\n"
        "feature_gap: %s\nissues:      %s\nmonth:       %s",
        "meeting_id", "title", F.coalesce(F.nullif("account_name", F.lit("")), F.lit("-")), "call_type", "category",
        "sentiment_label", "sentiment_score", "z_score", "is_anomaly", "escalation_team", "escalation_priority",
        "has_pagerduty", "feature_gap", F.coalesce(F.nullif(issues, F.lit("")), F.lit("none")), "month")
    return hit.select("meeting_id", "score", block.alias("context"))
