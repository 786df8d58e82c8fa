"""Estimated cost of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import approx_tokens, strip

# Dollars for 1,000 tokens of input and output by prefix, first match; tokens of the prompt and of a response.
PRICES = (("gpt-4o-mini", 0.00015, 0.00060), ("gpt-4o", 0.00250, 0.01000), ("claude-3-5-sonnet", 0.00300, 0.01500), ("gemini-1.5-pro", 0.00350, 0.01050))
PROMPT_TOKENS, RESPONSE_TOKENS, VOTES = 350, 200, 3


def price(model: Column, output: bool = False) -> Column:
    """Price by the first fitting prefix; unknown models cost nothing."""
    out = None
    for prefix, given, made in PRICES:
        fits, p = model.startswith(prefix), F.lit(made if output else given)
        out = F.when(fits, p) if out is None else out.when(fits, p)
    return out.otherwise(0.0)


def estimated(df: DataFrame, input_tokens: Column, output_tokens: Column, model: Column, majority_vote: bool = False) -> DataFrame:
    """df with input_tokens, output_tokens, input_cost_usd, output_cost_usd, total_usd, multiplier."""
    times = VOTES if majority_vote else 1
    df = df.withColumns({"input_tokens": input_tokens, "output_tokens": output_tokens, "multiplier": F.lit(times)})
    df = df.withColumns({"input_cost_usd": F.col("input_tokens") / 1000 * price(model) * times, "output_cost_usd": F.col("output_tokens") / 1000 * price(model, True) * times})
    return df.withColumn("total_usd", F.col("input_cost_usd") + F.col("output_cost_usd"))


def source_tokens(sources: Column) -> Column:
    """Tokens of the first three texts."""
    return F.aggregate(F.slice(sources, 1, 3), F.lit(0).cast("long"), lambda a, s: a + approx_tokens(s))


def answer_cost(df: DataFrame, claim: str, sources: str, model: Column, majority_vote: bool = False) -> DataFrame:
    return estimated(df, PROMPT_TOKENS + approx_tokens(F.col(claim)) + source_tokens(F.col(sources)), F.lit(RESPONSE_TOKENS).cast("long"), model, majority_vote)


def analysis_cost(df: DataFrame, text: str, sources: str, model: Column, majority_vote: bool = False) -> DataFrame:
    parts = F.filter(F.transform(F.split(F.col(text), r"\."), strip), lambda s: s != "")
    n = F.greatest(F.size(parts), F.lit(1)).cast("long")
    own = F.aggregate(parts, F.lit(0).cast("long"), lambda a, s: a + approx_tokens(s))
    return estimated(df, (PROMPT_TOKENS + source_tokens(F.col(sources))) * n + own, RESPONSE_TOKENS * n, model, majority_vote)
