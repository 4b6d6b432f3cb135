"""The relational steps of panel preparation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outer_merge(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of tables with one value column each: stacked and aggregated, one shuffle for all."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    values = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])


def missing_share(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, n_rows, missing_pct) over all cells of the columns."""
    missing = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return df.groupBy(group).agg(F.count("*").alias("n_rows"), (F.sum(missing) * 100.0 / (F.count("*") * len(columns))).alias("missing_pct"))


def drop_sparse_groups(df: DataFrame, group: str, columns: list[str], max_pct: float = 30.0) -> DataFrame:
    keep = missing_share(df, group, columns).filter(F.col("missing_pct") <= max_pct).select(group)
    return df.join(keep, group, "left_semi")


def exclude(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows with one of the values go; rows without a value stay."""
    return df.filter(~F.coalesce(F.col(column).isin(values), F.lit(False)))


def null_before(df: DataFrame, column: str, year: str, first: int) -> DataFrame:
    return df.withColumn(column, F.when(F.col(year) >= first, F.col(column)))


def known_columns(df: DataFrame, columns: list[str], year: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    out = df.select(*[c for c in columns if c in df.columns])
    return out if year is None else out.filter(F.col(year).between(first, last))


def first_names(df: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """(key, name): the name of each key's first row by ``order``."""
    return df.groupBy(key).agg(F.min_by(name, F.struct(order, name)).alias(name))


#: Classes up to which their codes are sent to every executor.
BROADCAST_CLASSES = 200_000


def count_distinct(df: DataFrame, **columns: str | Column) -> DataFrame:
    """One row: the number of distinct values of each column, by its result's name."""
    return df.agg(*[F.count_distinct(c).alias(name) for name, c in columns.items()])


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Sorted classes -> 0, 1, ...; no value, no code. Only the distinct classes are ranked, in one sorted
    task; their codes are sent out up to BROADCAST_CLASSES of them, else both sides shuffle."""
    classes = df.select(F.col(column).alias("__class")).distinct().filter("__class IS NOT NULL")
    codes = classes.select("__class", (F.row_number().over(Window.orderBy("__class")) - 1).alias(out))
    few = classes.count() <= BROADCAST_CLASSES
    return df.join(F.broadcast(codes) if few else codes, df[column] == codes["__class"], "left").drop("__class")


def prepare_panel(df: DataFrame, entity: str, year: str, columns: list[str], excluded: list, sparse_pct: float = 30.0, late: dict[str, int] | None = None, **rescale: tuple[str, ...]) -> DataFrame:
    """Sparse groups and excluded entities go, late series are cut, features rescaled, rows sorted."""
    from growmap.functions.rescale import transform_features

    out = exclude(drop_sparse_groups(df, entity, columns, sparse_pct), entity, excluded)
    for column, first in (late or {}).items():
        out = null_before(out, column, year, first)
    return transform_features(out, **rescale).orderBy(entity, year)
