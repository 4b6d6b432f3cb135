"""Scoring of streams. The map is fixed, so scoring is stateless; drift is a windowed mean distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growmap.model import GrowingMap
from growmap.operators.bmu import assign


def score(stream: DataFrame, model: GrowingMap) -> DataFrame:
    """stream + neuron_id, x, y, distance, in the metric for missing values, which needs no look at the
    whole table."""
    return assign(model.rows(stream), model.book, model.features, model.missing.weights if model.missing else None, nan=True)


def drift(scored: DataFrame, time: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, n, qe) by event time; rows later than ``late`` are left out, and closed windows leave
    the state."""
    w = scored.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("w"))
    return w.agg(F.count("*").alias("n"), F.avg("distance").alias("qe")).select(F.col("w.start").alias("window_start"), "n", "qe")
