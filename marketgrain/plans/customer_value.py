"""Historical customer value and its tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrain.operators.ranks import average_percent_rank

# Smallest average percent rank of each tier, highest first.
TIERS = [("Top 5%", 0.95), ("High Value", 0.75), ("Developing", 0.40)]
LOWEST_TIER = "Low Value"


def customer_value(features: DataFrame) -> DataFrame:
    """Customer features plus ``historical_customer_value`` and ``value_tier``.

    The rank of a spend is monotone in the spend, so a tier is everything from its smallest spend on:
    three cut points decide all rows and no customer is joined back to a rank.
    """
    ranks = average_percent_rank(features.select("total_spend"), "total_spend")
    cuts = ranks.agg(
        F.struct(*[F.min(F.when(F.col("percent") >= p, F.col("total_spend"))).alias(n) for n, p in TIERS])
    ).scalar()
    tier = F.lit(LOWEST_TIER)
    for name, _ in reversed(TIERS):
        tier = F.when(F.col("total_spend") >= F.col("__cuts").getField(name), name).otherwise(tier)
    return (
        features.select("*", cuts.alias("__cuts"))
        .withColumns({"historical_customer_value": F.col("total_spend"), "value_tier": tier})
        .drop("__cuts")
    )
