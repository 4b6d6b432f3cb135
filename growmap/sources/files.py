"""File sources and sinks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growmap.operators import maps, metrics


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and inferred types, or Parquet."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    return spark.read.parquet(path)


def scratch(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a temporary
    folder serves a local session; on a cluster that is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="growmap-"))
    return sc.getCheckpointDir().rstrip("/")


def _flat(df: DataFrame, array: str, names: list[str] | None = None) -> DataFrame:
    """An array column as columns, for CSV."""
    n = len(names) if names else (df.agg(F.max(F.size(array))).first()[0] or 0)
    names = names or [f"f{k + 1}" for k in range(n)]
    return df.select(*[c for c in df.columns if c != array], *[F.get(array, k).alias(v) for k, v in enumerate(names)])


def _write(df: DataFrame, path: str, fmt: str, partition: str | None = None) -> None:
    """Partitioned output is dealt by its key first, so each folder gets files of few tasks, not of all; the
    rebalance splits keys with many rows."""
    df = df.hint("rebalance", partition) if partition else df
    w = df.write.mode("overwrite").partitionBy(partition) if partition else df.write.mode("overwrite")
    w.csv(path, header=True) if fmt == "csv" else w.parquet(path)


def save_umatrix(neurons: DataFrame, path: str, fmt: str = "csv") -> None:
    _write(maps.umatrix(neurons), path, fmt)


def save_mappings(scored: DataFrame, path: str, features: str = "features", names: list[str] | None = None, clusters: DataFrame | None = None, fmt: str = "csv") -> None:
    """Rows with their neurons, and clusters if given."""
    if clusters is not None:
        scored = scored.join(F.broadcast(clusters.select("neuron_id", "cluster")), "neuron_id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(0)))
    _write(_flat(scored, features, names) if fmt == "csv" and features in scored.columns else scored, path, fmt)


def save_weights(neurons: DataFrame, path: str, names: list[str] | None = None, fmt: str = "csv") -> None:
    _write(_flat(neurons.select("neuron_id", "x", "y", "weights"), "weights", names) if fmt == "csv" else neurons, path, fmt)


def save_clusters(clusters: DataFrame, path: str, fmt: str = "csv") -> None:
    _write(clusters, path, fmt)


def save_trajectories(scored: DataFrame, path: str, entity: str = "entity", fmt: str = "csv") -> None:
    """A folder for each entity, in one job."""
    keep = [c for c in ("time_index", "end_time", "neuron_id", "x", "y", "distance", "cluster") if c in scored.columns]
    _write(scored.select(entity, *keep), path, fmt, entity)


def save_windows(windows: DataFrame, path: str, names: list[str] | None = None, fmt: str = "parquet") -> None:
    """A folder for each window end."""
    _write(_flat(windows, "features", names) if fmt == "csv" else windows, path, fmt, "time_index")


def save_all(neurons: DataFrame, scored: DataFrame, path: str, clusters: DataFrame | None = None, label: str | None = None, fmt: str = "csv") -> None:
    """U-matrix, mappings, weights, plot data, and with clusters and classes their report."""
    save_umatrix(neurons, f"{path}/umatrix", fmt)
    save_mappings(scored, f"{path}/mappings", clusters=clusters, fmt=fmt)
    save_weights(neurons, f"{path}/weights", fmt=fmt)
    _write(maps.edge_segments(neurons), f"{path}/edges", fmt)
    _write(maps.hit_counts(neurons, scored), f"{path}/hits", fmt)
    if clusters is not None:
        save_clusters(clusters, f"{path}/clusters", fmt)
        if label:
            both = scored.join(F.broadcast(clusters.select("neuron_id", "cluster")), "neuron_id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(0)))
            _write(metrics.distribution(metrics.contingency(both, "cluster", label)), f"{path}/distribution", fmt)


def save_panel(path: str, neurons: DataFrame, snapshots: DataFrame, summary: DataFrame, labels: DataFrame, names: DataFrame | None = None, features: list[str] | None = None, fmt: str = "csv") -> None:
    """Exports of a panel analysis: snapshots by time, trajectories by entity, summary, weights, clusters, names."""
    plain = snapshots.drop("features")
    _write(plain, f"{path}/snapshots", fmt, "time_index")
    save_trajectories(plain, f"{path}/trajectories", fmt=fmt)
    for name, df in (("summary", summary), ("clusters", labels), ("names", names)):
        if df is not None:
            _write(df, f"{path}/{name}", fmt)
    save_weights(neurons, f"{path}/weights", features, fmt)
