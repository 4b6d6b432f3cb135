"""Panels: sliding windows of entities over time, trajectories and their summaries."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from growmap.functions import vectors
from growmap.operators.cluster import NeuronClustering
from growmap.operators.bmu import Codebook
from growmap.operators.preprocess import entity_zscore


@dataclass(frozen=True)
class Panel:
    """Long table (entity, time, features)."""

    df: DataFrame
    entity: str
    time: str
    features: tuple[str, ...]

    def __post_init__(self) -> None:
        if not self.features:
            raise ValueError("a panel needs features")
        if missing := [c for c in (self.entity, self.time, *self.features) if c not in self.df.columns]:
            raise ValueError(f"columns missing from the panel: {missing}")


def from_columns(df: DataFrame, entity: str, time: str, features: list[str]) -> Panel:
    out = df.select(entity, time, *[vectors.null_nan(F.col(c).cast("double")).alias(c) for c in features])
    return Panel(out, entity, time, tuple(features))


def from_matrices(spark: SparkSession, matrices: dict, names: list[str] | None = None, samples_in_rows: bool = True) -> Panel:
    """entity -> matrix, time by position from 1; all with the same features."""
    parts = {k: np.asarray(m, float) if samples_in_rows else np.asarray(m, float).T for k, m in matrices.items()}
    if not parts or len({m.shape[1] for m in parts.values()}) != 1:
        raise ValueError("matrices must be there and have the same features")
    d = next(iter(parts.values())).shape[1]
    names = names or [f"f{k + 1}" for k in range(d)]
    if len(names) != d:
        raise ValueError("as many names as features are needed")
    rows = [(str(k), t + 1, *map(float, r)) for k, m in parts.items() for t, r in enumerate(m)]
    schema = ", ".join(["entity string", "time int", *(f"`{n}` double" for n in names)])
    return from_columns(spark.createDataFrame(rows, schema), "entity", "time", names)


def sliding_windows(panel: Panel, size: int, step: int = 1, zscore: bool = False) -> DataFrame:
    """(entity, time_index, end_time, features): the last ``size`` rows ending at row size, size + step, ...
    of each entity, oldest first; rows are counted, gaps in time are not. Shorter entities have none.

    A bounded frame over rows sorted within each entity: one shuffle on the entity."""
    df = entity_zscore(panel.df, panel.entity, list(panel.features)) if zscore else panel.df
    w = Window.partitionBy(panel.entity).orderBy(panel.time)
    vec = F.array(*[F.col(c).cast("double") for c in panel.features])
    rows = df.select(F.col(panel.entity).alias("entity"), F.row_number().over(w).alias("time_index"), F.col(panel.time).alias("end_time"), F.collect_list(vec).over(w.rowsBetween(1 - size, 0)).alias("frame"))
    ends = (F.col("time_index") >= size) & ((F.col("time_index") - size) % step == 0)
    return rows.filter(ends).select("entity", "time_index", "end_time", F.flatten("frame").alias("features"))


def window_dim(n_features: int, size: int) -> int:
    return n_features * size


def window_feature_names(names: list[str] | None, n_features: int, size: int) -> list[str]:
    """name_t-2, name_t-1, name_t0 for a size of 3."""
    names = names or [f"f{k + 1}" for k in range(n_features)]
    return [f"{n}_t{'-' + str(back) if back else '0'}" for back in range(size - 1, -1, -1) for n in names]


def entity_windows(windows: DataFrame, entity) -> DataFrame:
    return windows.filter(F.col("entity") == entity)


def entity_counts(windows: DataFrame) -> DataFrame:
    return windows.groupBy("entity").agg(F.count("*").alias("n_windows"))


def unique_entities(windows: DataFrame) -> DataFrame:
    return windows.select("entity").distinct()


def trajectory(scored: DataFrame, entity) -> DataFrame:
    """(time_index, neuron_id, x, y, distance) of one entity in order of time."""
    return entity_windows(scored, entity).select("time_index", "neuron_id", "x", "y", "distance").orderBy("time_index")


def trajectories(parts: list[DataFrame]) -> DataFrame:
    """Scored windows of several entities or maps as one table, in order of entity and time; columns that
    some of them lack are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).orderBy("entity", "time_index")


def decade(year: Column, decades: list[int] | None = None) -> Column:
    """The largest decade not after the year; of a list, NULL before the first."""
    if decades is None:
        return (F.floor(year / 10) * 10).cast("int")
    out = F.lit(None).cast("int")
    for d in sorted(decades):
        out = F.when(year >= d, F.lit(d)).otherwise(out)
    return out


def active_clusters(scored: DataFrame, book: Codebook, spark: SparkSession, min_k: int = 8, max_k: int = 10) -> tuple[Codebook, NeuronClustering]:
    """Ward clusters of the neurons that some row matches."""
    ids = {r.neuron_id for r in scored.select("neuron_id").distinct().collect()}
    k = [i for i, n in enumerate(book.ids) if int(n) in ids]
    part = Codebook.of([tuple(map(int, p)) for p in book.xy[k]], book.weights[k], [int(i) for i in book.ids[k]])
    return part, NeuronClustering(min_clusters=min_k, max_clusters=max_k).fit(part, spark)


def decade_clusters(scored: DataFrame, book: Codebook, year: str, decades: list[int], min_k: int = 8, max_k: int = 10) -> DataFrame:
    """(decade, neuron_id, cluster) from the rows of each decade."""
    spark, rows = scored.sparkSession, []
    for d in decades:
        part, got = active_clusters(scored.filter((F.col(year) >= d) & (F.col(year) < d + 10)), book, spark, min_k, max_k)
        rows += [(d, int(i), int(c)) for i, c in zip(part.ids, got.labels)]
    return spark.createDataFrame(rows, "decade int, neuron_id int, cluster int")


def snapshot_clusters(scored: DataFrame, labels: DataFrame, year: str, decades: list[int] | None = None, default: int = 1) -> DataFrame:
    """scored + decade, cluster: the neuron's label in that decade; without one, or in a snapshot of fewer than
    two entities, ``default``."""
    rows = scored.withColumn("decade", decade(F.col(year), decades))
    n = scored.groupBy(F.col(year).alias("__year")).agg(F.count("*").alias("__n"))
    rows = rows.join(F.broadcast(labels), ["decade", "neuron_id"], "left").join(n, rows[year] == n["__year"])
    cluster = F.when(F.col("__n") < 2, default).otherwise(F.coalesce("cluster", F.lit(default)))
    return rows.withColumn("cluster", cluster).drop("__year", "__n")


def entity_summary(snapshots: DataFrame, entity: str = "entity", time: str = "time_index", cluster: str = "cluster", era: str | None = None) -> DataFrame:
    """One row per entity: first and last snapshot with their neurons, the most frequent cluster (the least
    on ties), and how often the cluster changed between neighbours of the same ``era``."""
    w = Window.partitionBy(entity).orderBy(time)
    changed = F.col(cluster) != F.lag(cluster).over(w)
    if era:
        changed = changed & (F.col(era) == F.lag(era).over(w))
    rows = snapshots.withColumn("__changed", F.coalesce(changed, F.lit(False)).cast("long"))
    return rows.groupBy(entity).agg(
        F.count("*").alias("n_snapshots"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        F.min_by("neuron_id", time).alias("first_neuron"),
        F.max_by("neuron_id", time).alias("last_neuron"),
        F.mode(cluster, True).alias("main_cluster"),
        F.sum("__changed").alias("n_changes"),
    )


def name_clusters(clusters: DataFrame, value: str, tiers: list[str], cluster: str = "cluster") -> DataFrame:
    """(cluster, mean_value, name): tiers by rank of the mean; every name after the first gets " (2)"."""
    means = clusters.groupBy(F.col(cluster).alias("cluster")).agg(F.avg(value).alias("mean_value"))
    order = Window.orderBy(F.col("mean_value").asc_nulls_first(), "cluster")
    ranked = means.withColumn("r", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    tier = F.floor(F.col("r") * len(tiers) / F.col("n")).cast("int")
    named = ranked.withColumn("tier", F.element_at(F.array(*map(F.lit, tiers)), F.least(tier, F.lit(len(tiers) - 1)) + 1))
    again = F.row_number().over(Window.partitionBy("tier").orderBy("r")) > 1
    return named.select("cluster", "mean_value", F.when(again, F.concat("tier", F.lit(" (2)"))).otherwise(F.col("tier")).alias("name"))
