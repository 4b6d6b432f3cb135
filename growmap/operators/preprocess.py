"""Column kinds and a fitted scaler. Fitting is one aggregate over all columns."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growmap.functions.rescale import _value


class ColumnType(Enum):
    BINARY = "binary"
    CONTINUOUS = "continuous"


class Normalization(Enum):
    NONE = "none"
    ZSCORE = "zscore"
    MINMAX = "minmax"


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    kind: ColumnType
    method: Normalization
    index: int
    min: float | None = None
    max: float | None = None
    mean: float | None = None
    std: float | None = None


@dataclass
class Scaler:
    """Z-scores (population deviation, 0 counts as 1) or min-max of continuous columns; binary columns, those
    with values 0 and 1 only, and columns without values pass as they are."""

    method: Normalization = Normalization.ZSCORE
    columns: tuple[ColumnInfo, ...] = ()

    def fit(self, df: DataFrame, columns: list[str] | None = None) -> Scaler:
        columns = columns or df.columns
        aggs = []
        for k, c in enumerate(columns):
            v = _value(c)
            aggs += [F.count(v).alias(f"n{k}"), F.min(v.isin(0.0, 1.0)).alias(f"bin{k}"), F.min(v).alias(f"min{k}"), F.max(v).alias(f"max{k}"), F.avg(v).alias(f"mean{k}"), F.stddev_pop(v).alias(f"std{k}")]
        s = df.agg(*aggs).first()
        out = []
        for k, c in enumerate(columns):
            binary = bool(s[f"n{k}"] and s[f"bin{k}"])
            method = Normalization.NONE if binary or not s[f"n{k}"] else self.method
            out.append(ColumnInfo(c, ColumnType.BINARY if binary else ColumnType.CONTINUOUS, method, k, s[f"min{k}"], s[f"max{k}"], s[f"mean{k}"], (s[f"std{k}"] or 1.0) if s[f"n{k}"] else None))
        self.columns = tuple(out)
        return self

    def _check(self, df: DataFrame) -> None:
        if not self.columns:
            raise ValueError("the scaler is not fitted")
        if missing := [c.name for c in self.columns if c.name not in df.columns]:
            raise ValueError(f"columns missing from the input: {missing}")

    def transform(self, df: DataFrame) -> DataFrame:
        """A constant min-max column is 0 in every row, missing values too."""
        self._check(df)
        out = {}
        for c in self.columns:
            v = _value(c.name)
            if c.method is Normalization.ZSCORE:
                v = (v - c.mean) / c.std
            elif c.method is Normalization.MINMAX:
                v = (v - c.min) / (c.max - c.min) if c.max > c.min else F.lit(0.0)
            out[c.name] = v
        return df.withColumns(out)

    def fit_transform(self, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
        return self.fit(df, columns).transform(df)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        self._check(df)
        out = {}
        for c in self.columns:
            v = _value(c.name)
            if c.method is Normalization.ZSCORE:
                v = v * c.std + c.mean
            elif c.method is Normalization.MINMAX:
                v = v * (c.max - c.min) + c.min
            out[c.name] = v
        return df.withColumns(out)

    @property
    def types(self) -> dict[str, ColumnType]:
        return {c.name: c.kind for c in self.columns}

    def of_kind(self, kind: ColumnType) -> list[str]:
        return [c.name for c in self.columns if c.kind is kind]

    def summary(self) -> str:
        rows = [f"{c.name}: {c.kind.value}, {c.method.value}" for c in self.columns]
        return "\n".join([f"{len(rows)} columns, {len(self.of_kind(ColumnType.BINARY))} binary", *rows])


def entity_zscore(df: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """Z-scores in each entity over all its rows, by the sample deviation; 0 counts as 1, and a single value
    gives NULL. Statistics are aggregated and joined back, so a hot entity is summed where its rows are."""
    aggs = [f(_value(c)).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    stats = df.groupBy(F.col(entity).alias("__entity")).agg(*aggs)
    out = df.join(stats, df[entity].eqNullSafe(stats["__entity"])).withColumns({c: (_value(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}")) for c in columns})
    return out.select(*df.columns)
