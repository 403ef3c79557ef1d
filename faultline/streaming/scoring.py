"""Scoring reports as they arrive: the batch plan on a stream. It keeps no state, so it needs no
watermark, and any streaming source with report columns will do."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.confidence import GATE
from ..operators.scoring import predict_and_route
from ..sources.bundle import ModelBundle


def score_stream(reports: DataFrame, bundle: ModelBundle, threshold: float = GATE) -> DataFrame:
    if not reports.isStreaming:
        raise ValueError("score_stream needs a streaming DataFrame; use predict_and_route for a table")
    return predict_and_route(reports, bundle, threshold)
