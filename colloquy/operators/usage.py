"""D-27 (re-aimed): token usage and cost per model from a usage log.

The reference prices model calls from a dict; here the price list is an input
table (model, input_per_million, output_per_million) — bounded by the number of
models, so it is broadcast — with a default price for unknown models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_INPUT_PER_MILLION = 3.00
DEFAULT_OUTPUT_PER_MILLION = 15.00


def usage_cost(usage: DataFrame, prices: DataFrame, default_in: float = DEFAULT_INPUT_PER_MILLION,
               default_out: float = DEFAULT_OUTPUT_PER_MILLION) -> DataFrame:
    """Per model: calls, tokens in/out, cost in USD rounded to 6 places."""
    j = usage.join(F.broadcast(prices), "model", "left")
    cost = (F.col("input_tokens") * F.coalesce("input_per_million", F.lit(default_in))
            + F.col("output_tokens") * F.coalesce("output_per_million", F.lit(default_out))) / F.lit(1_000_000)
    return j.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.round(F.sum(cost), 6).alias("cost_usd"))
