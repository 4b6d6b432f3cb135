"""Best-matching neurons of rows: a nearest-neighbour join against a small table.

The codebook has at most some thousand neurons and goes to the executors inside the kernel; rows stream
through one narrow stage in Arrow batches, and distances are one matrix product per batch. ``assign_sql``
states the same with built-in functions, for checks on small tables.

Ties go to the least neuron_id, and a row without valid values to the least of all, at distance infinity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growmap.functions import vectors

#: Rows x neurons whose distances are held at once.
CELLS = 4_000_000


@dataclass
class Codebook:
    """Neurons in order of their ids: ids (m), xy (m, 2), weights (m, d), errors and hits (m)."""

    ids: np.ndarray
    xy: np.ndarray
    weights: np.ndarray
    errors: np.ndarray
    hits: np.ndarray

    @staticmethod
    def of(xy: list[tuple[int, int]], weights: np.ndarray, ids: list[int] | None = None) -> Codebook:
        m = len(xy)
        return Codebook(np.arange(m) if ids is None else np.asarray(ids), np.asarray(xy, int).reshape(m, 2), np.asarray(weights, float).reshape(m, -1), np.zeros(m), np.zeros(m, int))

    @staticmethod
    def collect(neurons: DataFrame) -> Codebook:
        """From (neuron_id, x, y, weights); a map fits the driver."""
        rows = sorted(neurons.select("neuron_id", "x", "y", "weights").collect())
        return Codebook.of([(r.x, r.y) for r in rows], np.array([r.weights for r in rows], float), [r.neuron_id for r in rows])

    def __len__(self) -> int:
        return len(self.ids)

    @property
    def index(self) -> dict[tuple[int, int], int]:
        return {(int(x), int(y)): k for k, (x, y) in enumerate(self.xy)}

    def dataframe(self, spark) -> DataFrame:
        rows = [(int(i), int(x), int(y), [float(v) for v in w], float(e), int(h)) for i, (x, y), w, e, h in zip(self.ids, self.xy, self.weights, self.errors, self.hits)]
        return spark.createDataFrame(rows, "neuron_id int, x int, y int, weights array<double>, error double, hits bigint")


def distances2(x: np.ndarray, weights: np.ndarray, dim_weights: np.ndarray | None = None, nan: bool = False) -> np.ndarray:
    """Squared distances (n, m). nan: over valid dimensions, scaled up; with dim_weights weighted as well."""
    if not nan:
        d2 = (x**2).sum(1)[:, None] + (weights**2).sum(1)[None, :] - 2 * x @ weights.T
        return np.maximum(d2, 0)
    valid = ~np.isnan(x)
    v = np.ones(x.shape[1]) if dim_weights is None else dim_weights
    mask, x0 = valid * v, np.where(valid, x, 0.0)
    d2 = (mask * x0**2).sum(1)[:, None] + mask @ (weights**2).T - 2 * (mask * x0) @ weights.T
    used = mask.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        scaled = np.maximum(d2, 0) * (v.sum() / used)[:, None]
    return np.where(used[:, None] > 0, scaled, np.inf)


def nearest(x: np.ndarray, book: np.ndarray, dim_weights: np.ndarray | None, nan: bool, k: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Indices and squared distances (n, k) of the k nearest, the first index on ties."""
    step = max(1, CELLS // max(1, len(book)))
    at, d = [], []
    for i in range(0, len(x), step):
        d2 = distances2(x[i : i + step], book, dim_weights, nan)
        if k == 1:
            best = d2.argmin(1)[:, None]
        else:
            best = np.argsort(d2, axis=1, kind="stable")[:, :k]
        at.append(best)
        d.append(np.take_along_axis(d2, best, 1))
    return (np.concatenate(at), np.concatenate(d)) if at else (np.zeros((0, k), int), np.zeros((0, k)))


def find_bmu(x: list[float] | np.ndarray, book: Codebook, dim_weights: np.ndarray | None = None) -> tuple[int, float]:
    """neuron_id and distance of the neuron nearest to one vector; NaN is a missing value."""
    row = np.asarray(x, float).reshape(1, -1)
    if row.shape[1] != book.weights.shape[1]:
        raise ValueError(f"a vector of {book.weights.shape[1]} values is needed")
    at, d2 = nearest(row, book.weights, dim_weights, bool(np.isnan(row).any()))
    return int(book.ids[at[0, 0]]), float(np.sqrt(d2[0, 0]))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """list<double> -> (n, dim), NULL as NaN; no copy by row. Rows of another length are an error."""
    sizes = pc.list_value_length(column)
    if len(sizes) and (sizes.null_count or pc.any(pc.not_equal(sizes, dim)).as_py()):
        raise ValueError(f"features must have {dim} values in each row")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(-1, dim)


def assign(rows: DataFrame, book: Codebook, features: str = "features", dim_weights: np.ndarray | None = None, nan: bool | None = None, two: bool = False, keep: list[str] | None = None) -> DataFrame:
    """rows + neuron_id, x, y, distance (two: also neuron_id2, distance2). ``keep``: the columns of rows that
    are wanted, by default all; the others don't travel back. NULL features are those of a row without
    valid values.

    ``nan``: whether to use the metric for missing values; by default one scan finds out, as the metric is
    chosen for the whole table, not for each row."""
    nan = vectors.has_nan(rows, features) if nan is None else nan
    keep = [c for c in (rows.columns if keep is None else keep) if c not in ("neuron_id", "x", "y", "distance", "neuron_id2", "distance2")]
    none = F.array_repeat(F.lit(None).cast("double"), book.weights.shape[1])
    vec = F.coalesce(F.col(features).cast("array<double>"), none)
    rows = rows.select(*[vec.alias(c) if c == features else F.col(c) for c in keep], *([] if features in keep else [vec.alias("__vec")]))
    at_vec = keep.index(features) if features in keep else len(keep)
    ids, xy, w = book.ids, book.xy, book.weights
    two = two and len(book) > 1
    extra = ", neuron_id2 int, distance2 double" if two else ""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]), "neuron_id int, x int, y int, distance double"]) + extra
    names = [*keep, "neuron_id", "x", "y", "distance"] + (["neuron_id2", "distance2"] if two else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, d2 = nearest(matrix(b.column(at_vec), w.shape[1]), w, dim_weights, nan, 2 if two else 1)
            first = at[:, 0]
            made = [pa.array(ids[first].astype(np.int32)), pa.array(xy[first, 0].astype(np.int32)), pa.array(xy[first, 1].astype(np.int32)), pa.array(np.sqrt(d2[:, 0]))]
            if two:
                made += [pa.array(ids[at[:, 1]].astype(np.int32)), pa.array(np.sqrt(d2[:, 1]))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *made], names)

    return rows.mapInArrow(run, schema)


def assign_sql(rows: DataFrame, neurons: DataFrame, features: str = "features", row_id: str = "row_id", k: int = 1, weights: Column | None = None, nan: bool = False) -> DataFrame:
    """(row_id, neuron_id, x, y, distance, rank): the k nearest by built-in functions. Neurons travel as one
    array in a broadcast row, so a row is measured where it stands and nothing is shuffled."""
    packed = neurons.agg(F.sort_array(F.collect_list(F.struct("neuron_id", "x", "y", "weights"))).alias("__book"))
    x = vectors.clean(F.col(features))

    def measure(n: Column) -> Column:
        if weights is not None:
            d2 = vectors.euclidean_squared_weighted(x, n["weights"], weights)
        elif nan:
            d2 = vectors.euclidean_squared_nan(x, n["weights"])
        else:
            d2 = vectors.euclidean_squared(x, n["weights"])
        return F.struct(F.sqrt(d2).alias("distance"), n["neuron_id"].alias("neuron_id"), n["x"].alias("x"), n["y"].alias("y"))

    met = rows.select(row_id, features).join(F.broadcast(packed), F.lit(True))
    best = met.select(row_id, F.slice(F.array_sort(F.transform("__book", measure)), 1, k).alias("b"))
    out = best.select(row_id, F.posexplode("b").alias("rank", "b"))
    return out.select(row_id, "b.neuron_id", "b.x", "b.y", "b.distance", (F.col("rank") + 1).alias("rank"))
