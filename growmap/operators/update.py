"""Batch updates of the codebook.

A neighbourhood weight depends on a row only through its best-matching neuron, so one scan reduces the
rows to sums and counts for each neuron and dimension, and the smoothing over the grid is a small matrix
product on the driver. Tasks send one row for each neuron and dimension they met.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growmap.functions import grid, vectors
from growmap.operators.bmu import Codebook, assign, matrix, nearest

EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Missingness:
    """Share of missing values, and weight (1 - share) squared, of each dimension."""

    rates: np.ndarray
    weights: np.ndarray
    n_rows: int


def missingness(rows: DataFrame, dim: int, features: str = "features") -> Missingness:
    n = rows.count()
    if dim < 1 or n < 1:
        raise ValueError("missingness needs rows and dimensions")
    seen = np.zeros(dim)
    for r in by_dimension(rows, features).agg(F.count("v").alias("n")).filter(F.col("k") < dim).collect():
        seen[r.k] = r.n
    rates = (n - seen) / n
    return Missingness(rates, (1 - rates) ** 2, n)


def by_dimension(rows: DataFrame, features: str):
    """Values v grouped by dimension k; each row is unfolded once, and aggregates are partial in each task."""
    return rows.select(F.posexplode(vectors.clean(F.col(features))).alias("k", "v")).groupBy("k")


def growth_threshold(rows: DataFrame | None, dim: int, spread: float | None = None, error: float | None = None, features: str = "features") -> float:
    """-ln(spread) x dim, or error x root of the summed sample variances (fewer than two values: 0)."""
    if error is None:
        return vectors.threshold_from_spread(spread, dim)
    if rows is None:
        raise ValueError("the statistical threshold needs rows")
    s = by_dimension(rows, features).agg(F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("s")).filter(F.col("k") < dim).collect()
    return error * float(np.sqrt(sum(r.s for r in sorted(s))))


def block_sums(x: np.ndarray, weights: np.ndarray, dim_weights: np.ndarray | None, nan: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts (m, d) of the valid values of a block of rows, by best-matching neuron."""
    m, d = weights.shape
    at, valid = nearest(x, weights, dim_weights, nan)[0][:, 0], ~np.isnan(x)
    sums = np.stack([np.bincount(at, np.where(valid[:, k], x[:, k], 0.0), m) for k in range(d)], 1)
    counts = np.stack([np.bincount(at, valid[:, k], m) for k in range(d)], 1)
    return sums, counts


def block_errors(x: np.ndarray, old: np.ndarray, new: np.ndarray, dim_weights: np.ndarray | None, nan: bool) -> tuple[np.ndarray, np.ndarray]:
    """Summed distances from the new weights, and hits (m), of a block of rows matched by the old ones."""
    m, d = old.shape
    best = nearest(x, old, dim_weights, nan)[0][:, 0]
    valid = ~np.isnan(x)
    diff = np.where(valid, (x - new[best]) ** 2, 0.0)
    w = np.ones(d) if dim_weights is None else dim_weights
    with np.errstate(divide="ignore", invalid="ignore"):
        part = diff @ w * (w.sum() / (valid * w).sum(1))
    dist = np.sqrt(np.where(valid.all(1), diff.sum(1), part))
    fine = np.isfinite(dist)
    return np.bincount(best[fine], dist[fine], m), np.bincount(best[fine], minlength=m)


def bmu_sums(rows: DataFrame | np.ndarray, book: Codebook, features: str = "features", dim_weights: np.ndarray | None = None, nan: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """One scan: sums and counts (m, d) of valid values by best-matching neuron."""
    w = book.weights
    if isinstance(rows, np.ndarray):
        return block_sums(rows, w, dim_weights, nan)
    m, d = w.shape
    rows = rows.select(F.col(features).cast("array<double>").alias("f")).filter("f IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((m, d)), np.zeros((m, d))
        for b in batches:
            s, c = block_sums(matrix(b.column(0), d), w, dim_weights, nan)
            sums += s
            counts += c
        i, k = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(sums[i, k]), pa.array(counts[i, k])], ["i", "k", "s", "n"])

    sums, counts = np.zeros((m, d)), np.zeros((m, d))
    for r in rows.mapInArrow(run, "i int, k int, s double, n double").groupBy("i", "k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        sums[r.i, r.k], counts[r.i, r.k] = r.s, r.n
    return sums, counts


def grid_distances(xy: np.ndarray) -> np.ndarray:
    c = np.stack(grid.cube(xy[:, 0], xy[:, 1]), 1)
    return np.abs(c[:, None, :] - c[None, :, :]).max(2)


def neighborhood(xy: np.ndarray, sigma: float) -> np.ndarray:
    return np.exp(-(grid_distances(xy) ** 2) / (2 * sigma * sigma))


def neighborhood_sql(neurons: DataFrame, sigma: float) -> DataFrame:
    """(src_id, dst_id, h) for all pairs of neurons; one array in a broadcast row, as the map is small."""
    packed = neurons.agg(F.collect_list(F.struct("neuron_id", "x", "y")).alias("b"))
    both = neurons.select("neuron_id", "x", "y").join(F.broadcast(packed), F.lit(True)).select(F.col("neuron_id").alias("src_id"), "x", "y", F.explode("b").alias("o"))
    return both.select("src_id", F.col("o.neuron_id").alias("dst_id"), vectors.gaussian(grid.grid_distance_col(F.col("x"), F.col("y"), F.col("o.x"), F.col("o.y")).cast("double"), sigma).alias("h"))


def smooth(book: Codebook, sums: np.ndarray, counts: np.ndarray, sigma: float, dim_weights: np.ndarray | None = None) -> np.ndarray:
    """New weights; a dimension whose denominator is not above EPS keeps its value. Returns the
    denominators (m, d), scaled by dim_weights. ``book`` changes in place."""
    h = neighborhood(book.xy, sigma)
    v = np.ones(sums.shape[1]) if dim_weights is None else dim_weights
    num, den = (h @ sums) * v, (h @ counts) * v
    fine = den > EPS
    book.weights = np.where(fine, num / np.where(fine, den, 1.0), book.weights)
    return den


def impute(book: Codebook, at: int, counts: np.ndarray, min_obs: float = 5.0, max_dist: int = 2) -> None:
    """Dimensions of one neuron with fewer than min_obs observations become the mean of the neurons within
    max_dist, weighted by inverse grid distance. In place; without such neurons nothing changes."""
    d = grid_distances(book.xy)[at]
    near = np.flatnonzero((d <= max_dist) & (np.arange(len(book)) != at))
    if len(near):
        w = 1.0 / d[near]
        poor = counts < min_obs
        book.weights[at, poor] = (w @ book.weights[near][:, poor]) / w.sum()


def update(rows: DataFrame | np.ndarray, book: Codebook, sigma: float, features: str = "features", missing: Missingness | None = None, nan: bool = False) -> np.ndarray:
    """One epoch. With ``missing``, dimensions seen less than max(1, a tenth of the neuron's most) are
    imputed afterwards, neuron by neuron in order of their ids."""
    weights = missing.weights if missing else None
    sums, counts = bmu_sums(rows, book, features, weights, nan)
    den = smooth(book, sums, counts, sigma, weights)
    if missing:
        for k in range(len(book)):
            impute(book, k, den[k], max(1.0, 0.1 * den[k].max()))
    return den


def accumulate_errors(rows: DataFrame | np.ndarray, at: Codebook, now: Codebook, features: str = "features", missing: Missingness | None = None, nan: bool = False) -> None:
    """Errors and hits of ``now``, from zero: each row adds its distance from the new weights to the neuron
    that matched it best in ``at``. The metric of a row depends on whether that row has missing values;
    rows at infinite distance count neither way."""
    old, new, v = at.weights, now.weights, missing.weights if missing else None
    if isinstance(rows, np.ndarray):
        now.errors, now.hits = block_errors(rows, old, new, v, nan)
        return
    m, d = old.shape
    rows = rows.select(F.col(features).cast("array<double>").alias("f")).filter("f IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        errors, hits = np.zeros(m), np.zeros(m)
        for b in batches:
            e, n = block_errors(matrix(b.column(0), d), old, new, v, nan)
            errors += e
            hits += n
        i = np.flatnonzero(hits)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(errors[i]), pa.array(hits[i])], ["i", "e", "n"])

    now.errors, now.hits = np.zeros(m), np.zeros(m, int)
    for r in rows.mapInArrow(run, "i int, e double, n double").groupBy("i").agg(F.sum("e").alias("e"), F.sum("n").alias("n")).collect():
        now.errors[r.i], now.hits[r.i] = r.e, int(r.n)


def batch_update_sql(assigned: DataFrame, neurons: DataFrame, sigma: float) -> DataFrame:
    """(neuron_id, weights): the same epoch with built-in functions, from rows with neuron_id and features;
    NULL values are left out by dimension."""
    long = assigned.select("neuron_id", F.posexplode("features").alias("k", "v"))
    sums = long.groupBy("neuron_id", "k").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    h = neighborhood_sql(neurons, sigma)
    met = sums.join(F.broadcast(h), sums["neuron_id"] == h["src_id"]).groupBy("dst_id", "k").agg(F.sum(F.col("h") * F.col("s")).alias("num"), F.sum(F.col("h") * F.col("n")).alias("den"))
    old = neurons.select(F.col("neuron_id").alias("dst_id"), F.posexplode("weights").alias("k", "w"))
    new = old.join(met, ["dst_id", "k"], "left").select("dst_id", "k", F.when(F.col("den") > EPS, F.col("num") / F.col("den")).otherwise(F.col("w")).alias("w"))
    sorted_w = F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda s: s["w"])
    return new.groupBy(F.col("dst_id").alias("neuron_id")).agg(sorted_w.alias("weights"))


def errors_of(rows: DataFrame, book: Codebook, features: str = "features", **kw) -> DataFrame:
    """(neuron_id, error, hits) of the neurons that rows match, rows at infinite distance left out."""
    got = assign(rows, book, features, **kw).filter(F.col("distance") < F.lit(float("inf")))
    return got.groupBy("neuron_id").agg(F.sum("distance").alias("error"), F.count("*").alias("hits"))
