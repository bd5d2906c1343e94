"""Prices, reservations and the three spend policies. Amounts are decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(14,8)"


def reserve_amount(amount: Column) -> Column:
    """Eight decimal places, always rounded up."""
    return F.ceil(amount, F.lit(8)).cast(MONEY)


def conservative(reserved: Column, estimated: Column, actual: Column) -> Column:
    """Durable jobs: the most that any of the three says."""
    zero = F.lit(0).cast(MONEY)
    return F.greatest(reserved, F.coalesce(estimated, zero), F.coalesce(actual, zero))


def never_refunded(reserved: Column, cost: Column) -> Column:
    """Benchmarks: the reservation, or the cost where that is more."""
    return F.greatest(reserved, F.coalesce(cost, reserved))


def replaced(reserved: Column, cost: Column) -> Column:
    """Interactive sessions: the cost once it is known, else the reservation."""
    return F.coalesce(cost, reserved)


def price(usage: DataFrame, catalogue: DataFrame, *, model: str = "model") -> DataFrame:
    """usage (model, input_tokens, output_tokens, audio_tokens, seconds) with its price: per minute of whole seconds, or per million tokens.

    Unknown models, unknown tokens, and audio tokens that exceed the input have no price. The catalogue is one row a model; Spark
    broadcasts it when it finds it small.
    """
    rates = catalogue.select(F.col("model").alias("_model"), "per_minute", "input_per_million", "audio_input_per_million", "output_per_million")
    audio = F.coalesce("audio_tokens", F.lit(0))
    text_rate = F.col("input_per_million")
    tokens = ((F.col("input_tokens") - audio) * text_rate + audio * F.coalesce("audio_input_per_million", text_rate) + F.col("output_tokens") * F.col("output_per_million")) / 1e6
    usable = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull() & audio.between(0, F.col("input_tokens"))
    by_minute = F.when(F.col("seconds").isNotNull(), F.ceil("seconds") / 60 * F.col("per_minute"))
    priced = F.when(F.col("_model").isNull(), None).when(F.col("per_minute").isNotNull(), by_minute).when(usable, tokens)
    return usage.join(rates, F.col(model) == F.col("_model"), "left").withColumn("price_usd", priced).drop("_model", *rates.columns[1:])


def fresh(verified_on: Column, as_of: Column, *, most_days: int = 30) -> Column:
    return F.datediff(as_of, verified_on).between(0, most_days)


def back_off(attempt: Column, jitter: Column, *, most: float = 300.0) -> Column:
    """Seconds to wait; the jitter is a column so that reruns agree."""
    return F.least(F.lit(most), F.pow(F.lit(2.0), attempt) + jitter)
