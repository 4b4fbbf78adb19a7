"""Prepared rows and scores of streams: the same stateless functions on a streaming table."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from augury.operators.prep import Fit
from augury.operators.train import score


def score_stream(rows: DataFrame, fit: Fit, model: PipelineModel, keep: list[str]) -> DataFrame:
    """As ``score``; rows may be a stream, as nothing is grouped, joined or kept between batches."""
    return score(rows, fit, model, keep)


def write_scores(scores: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append scores to parquet until the input is used up; the checkpoint makes a restart go on where it stopped."""
    return scores.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
