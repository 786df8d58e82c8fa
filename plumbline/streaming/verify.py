"""Streams of claims and of conversation results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.evaluators.protocol import Evaluator
from plumbline.model import Config
from plumbline.plans.stages import sweep
from plumbline.plans.verify import verify


def verify_stream(claims: DataFrame, sources: DataFrame, path: str, checkpoint: str, cfg: Config | None = None, evaluator: Evaluator | None = None, cache: str | None = None):
    """Verifies each micro-batch of claims against static sources; results are appended to path as Parquet.

    A batch's folder is named by its number and overwritten if the batch is repeated, so none is stored twice. The
    stages of a batch's plan are deleted once it is stored.
    """

    def settle(batch: DataFrame, number: int) -> None:
        verify(batch, sources, cfg, evaluator, cache).write.mode("overwrite").parquet(f"{path}/batch={number}")
        sweep(batch.sparkSession)

    return claims.writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint)


def conversation_scores(results: DataFrame, key: str = "conv_id") -> DataFrame:
    """Running overall score of each conversation, for update mode."""
    grounded, units = F.sum("grounded_units"), F.sum(F.col("grounded_units") + F.col("ungrounded_units"))
    return results.groupBy(key).agg(F.when(units > 0, grounded / units).otherwise(F.avg("score")).alias("overall_score"), F.bool_and("is_grounded").alias("is_grounded"), F.count("*").alias("n_results"))


def windowed_scores(results: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Mean score and share of grounded results by event-time window; rows later than the watermark are dropped."""
    return results.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.avg("score").alias("mean_score"), F.avg(F.col("is_grounded").cast("double")).alias("grounded_share"), F.count("*").alias("n_results"))
