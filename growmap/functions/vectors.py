"""Distances between array<double> columns, and ingestion of feature vectors.

A missing value is NULL inside the array; NaN becomes NULL on ingestion.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def null_nan(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def vectorise(df: DataFrame, feature_cols: list[str], id_col: str | None = None) -> DataFrame:
    """(row_id, features array<double>); without ``id_col``, row ids are unique but not dense."""
    vec = F.array(*[null_nan(F.col(c).cast("double")) for c in feature_cols])
    row_id = F.col(id_col) if id_col else F.monotonically_increasing_id()
    return df.select(row_id.alias("row_id"), vec.alias("features"))


def clean(features: Column) -> Column:
    """array<numeric> -> array<double> with NULL for NaN."""
    return F.transform(features.cast("array<double>"), null_nan)


def has_nan(df: DataFrame, features: str = "features") -> bool:
    """Whether any value of the whole table is missing; NULL features are."""
    missing = F.exists(F.col(features), lambda v: v.isNull() | F.isnan(v))
    return bool(df.agg(F.max(F.coalesce(missing, F.lit(True)))).first()[0])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def euclidean_squared(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(euclidean_squared(a, b))


def euclidean_squared_nan(a: Column, b: Column) -> Column:
    """Over the dimensions valid in both, scaled up by total/valid; none: infinity."""
    terms = F.filter(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), lambda t: t.isNotNull())
    return F.when(F.size(terms) == 0, F.lit(INF)).otherwise(_total(terms) * F.size(a) / F.size(terms))


def euclidean_nan(a: Column, b: Column) -> Column:
    return F.sqrt(euclidean_squared_nan(a, b))


def euclidean_squared_weighted(a: Column, b: Column, weights: Column) -> Column:
    """Weighted over valid dimensions with a weight above 0, scaled by the sum of all weights over that of
    the used ones; none: infinity."""
    diff = F.zip_with(a, b, lambda p, q: (p - q) * (p - q))
    both = F.filter(F.arrays_zip(diff.alias("t"), weights.alias("w")), lambda s: s["t"].isNotNull() & (s["w"] > 0))
    used = _total(F.transform(both, lambda s: s["w"]))
    terms = _total(F.transform(both, lambda s: s["w"] * s["t"]))
    return F.when(F.size(both) == 0, F.lit(INF)).otherwise(terms * _total(weights) / used)


def gaussian(distance: Column, sigma: float) -> Column:
    return F.exp(-(distance * distance) / (2 * sigma * sigma))


def sigma_start(extent: int) -> float:
    return max(extent, 1) / 2


def sigma_range(extent: int) -> tuple[float, float]:
    first = sigma_start(extent)
    return first, max(0.2 * first, 0.5)


def decay_sigma(epoch: int, epochs: int, first: float, last: float) -> float:
    """Linear from the first of ``epochs`` to the last."""
    return first if epochs <= 1 else first + (last - first) * (epoch - 1) / (epochs - 1)


def threshold_from_spread(sf: float, dim: int) -> float:
    return -math.log(sf) * dim
