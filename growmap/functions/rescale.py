"""Rescaling to [0, 100] and scaler expressions. Window-free: statistics come from one aggregate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _value(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def signed_log(v: Column) -> Column:
    return F.signum(v) * F.log1p(F.abs(v))


def _rescale(df: DataFrame, columns: dict[str, tuple[Callable[[Column], Column], bool]]) -> DataFrame:
    """columns: name -> (function, whether all values must be above 0). One aggregate for all of them; a
    column without values, constant, or with a forbidden value stays as it is."""
    aggs = []
    for k, (c, (f, _)) in enumerate(columns.items()):
        v = _value(c)
        aggs += [F.min(f(v)).alias(f"lo{k}"), F.max(f(v)).alias(f"hi{k}"), F.min(v).alias(f"least{k}")]
    s = df.agg(*aggs).first()
    out = {}
    for k, (c, (f, positive)) in enumerate(columns.items()):
        lo, hi, least = s[f"lo{k}"], s[f"hi{k}"], s[f"least{k}"]
        if lo is not None and hi > lo and not (positive and least <= 0):
            out[c] = (f(_value(c)) - lo) / (hi - lo) * 100
    return df.withColumns(out) if out else df


def log_rescale(df: DataFrame, *columns: str) -> DataFrame:
    return _rescale(df, {c: (F.log, True) for c in columns})


def signed_log_rescale(df: DataFrame, *columns: str) -> DataFrame:
    return _rescale(df, {c: (signed_log, False) for c in columns})


def minmax_rescale(df: DataFrame, *columns: str) -> DataFrame:
    return _rescale(df, {c: (lambda v: v, False) for c in columns})


def transform_features(df: DataFrame, log: tuple[str, ...] = (), signed: tuple[str, ...] = (), minmax: tuple[str, ...] = ()) -> DataFrame:
    """All three at once; absent columns are skipped."""
    plan = {c: (F.log, True) for c in log} | {c: (signed_log, False) for c in signed} | {c: (lambda v: v, False) for c in minmax}
    plan = {c: v for c, v in plan.items() if c in df.columns}
    return _rescale(df, plan) if plan else df
