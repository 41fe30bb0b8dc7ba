"""Transcript metrics per conversation (turns, words, sentences, speakers)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.search import TOKEN_PATTERN

SENTENCE_END = r"[.!?]+"


def transcript_metrics(conv: DataFrame) -> DataFrame:
    """Per conversation: turns, word count, sentence count (runs of . ! ?), distinct speakers
    and turns per role.  Per-turn sizes are computed in-row; the group-by combines map-side."""
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN_PATTERN), 0))
    sentences = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(SENTENCE_END), 0))
    return conv.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.sum(words).cast("bigint").alias("n_words"),
        F.sum(sentences).cast("bigint").alias("n_sentences"),
        F.count_distinct("role").alias("n_speakers"),
        F.count_if(F.col("role") == "user").alias("user_turns"),
        F.count_if(F.col("role") == "assistant").alias("assistant_turns"))
