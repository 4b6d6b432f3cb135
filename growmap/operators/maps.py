"""Map analytics as DataFrames: U-matrix, density-adjusted U-matrix, planes, hits, quality, plots' data."""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growmap.functions import grid, vectors
from growmap.operators.bmu import Codebook, assign

EPS = 2.220446049250313e-16


def umatrix_edges(neurons: DataFrame, log: bool = False) -> DataFrame:
    """(src_id, dst_id, distance) of occupied neighbours, src before dst by position."""
    n = neurons.select("neuron_id", "x", "y", "weights")
    a = n.select(*[F.col(c).alias(f"a_{c}") for c in n.columns])
    b = n.select(*[F.col(c).alias(f"b_{c}") for c in n.columns])
    met = grid.adjacency(neurons).join(a, F.col("src_id") == F.col("a_neuron_id")).join(b, F.col("dst_id") == F.col("b_neuron_id"))
    met = met.filter(F.struct("a_x", "a_y") < F.struct("b_x", "b_y"))
    d = vectors.euclidean(F.col("a_weights"), F.col("b_weights"))
    return met.select("src_id", "dst_id", (F.log(d + EPS) if log else d).alias("distance"))


def umatrix(neurons: DataFrame) -> DataFrame:
    """(neuron_id, x, y, u): mean distance to the occupied neighbours, 0 without any."""
    e = umatrix_edges(neurons)
    both = e.select(F.col("src_id").alias("id"), "distance").unionAll(e.select(F.col("dst_id").alias("id"), "distance"))
    u = both.groupBy("id").agg(F.avg("distance").alias("u"))
    return neurons.join(u, neurons["neuron_id"] == u["id"], "left").select("neuron_id", "x", "y", F.coalesce("u", F.lit(0.0)).alias("u"))


def hit_counts(neurons: DataFrame, assigned: DataFrame) -> DataFrame:
    """(neuron_id, x, y, hits), zeros too."""
    h = assigned.groupBy(F.col("neuron_id").alias("id")).agg(F.count("*").alias("hits"))
    cells = neurons.select("neuron_id", "x", "y")
    return cells.join(h, cells["neuron_id"] == h["id"], "left").select("neuron_id", "x", "y", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def ustar(neurons: DataFrame, assigned: DataFrame) -> DataFrame:
    """(neuron_id, x, y, ustar): u x (1 - hits / most hits); without hits, u."""
    both = umatrix(neurons).join(hit_counts(neurons, assigned).select("neuron_id", "hits"), "neuron_id")
    most = both.agg(F.max("hits").alias("most"))
    both = both.join(F.broadcast(most), F.lit(True))
    v = F.when(F.col("most") > 0, F.col("u") * (1 - F.col("hits") / F.col("most"))).otherwise(F.col("u"))
    return both.select("neuron_id", "x", "y", v.alias("ustar"))


def component_planes(neurons: DataFrame, dim: int | None = None) -> DataFrame:
    """(neuron_id, x, y, dim, weight), dim from 1; of one dimension or all."""
    out = neurons.select("neuron_id", "x", "y", F.posexplode("weights").alias("d", "weight")).select("neuron_id", "x", "y", (F.col("d") + 1).alias("dim"), "weight")
    return out if dim is None else out.filter(F.col("dim") == dim)


def heatmap(cells: DataFrame, value: str) -> DataFrame:
    """(x, y, value) on the full rectangle around the cells; NULL where there is none."""
    b = cells.agg(*[f(c).alias(f"{c}{n}") for c in "xy" for n, f in ((0, F.min), (1, F.max))])
    full = b.select(F.explode(F.sequence("x0", "x1")).alias("gx"), "y0", "y1").select("gx", F.explode(F.sequence("y0", "y1")).alias("gy"))
    return full.join(cells, (full["gx"] == cells["x"]) & (full["gy"] == cells["y"]), "left").select(F.col("gx").alias("x"), F.col("gy").alias("y"), value)


def coordinate_arrays(cells: DataFrame, value: str) -> DataFrame:
    """One row of arrays xs, ys, values, by neuron_id."""
    s = cells.agg(F.sort_array(F.collect_list(F.struct("neuron_id", "x", "y", value))).alias("s"))
    return s.select(F.col("s.x").alias("xs"), F.col("s.y").alias("ys"), F.col(f"s.{value}").alias("values"))


def pixel_cols(x, y):
    return F.sqrt(F.lit(3.0)) * (x + 0.5 * y.bitwiseAND(1)), 1.5 * y


def edge_segments(neurons: DataFrame) -> DataFrame:
    """(src_id, dst_id, x1, y1, x2, y2) in drawing coordinates."""
    n = neurons.select("neuron_id", *[v.alias(c) for c, v in zip(("px", "py"), pixel_cols(F.col("x"), F.col("y")))])
    e = grid.edges(neurons)
    a = n.select(F.col("neuron_id").alias("src_id"), F.col("px").alias("x1"), F.col("py").alias("y1"))
    b = n.select(F.col("neuron_id").alias("dst_id"), F.col("px").alias("x2"), F.col("py").alias("y2"))
    return e.join(a, "src_id").join(b, "dst_id").select("src_id", "dst_id", "x1", "y1", "x2", "y2")


def plotting_data(neurons: DataFrame, assigned: DataFrame) -> dict[str, DataFrame]:
    px, py = pixel_cols(F.col("x"), F.col("y"))
    return {
        "positions": neurons.select("neuron_id", "x", "y", px.alias("px"), py.alias("py")),
        "weights": component_planes(neurons),
        "umatrix": umatrix(neurons),
        "expanded_umatrix": umatrix_edges(neurons),
        "ustar": ustar(neurons, assigned),
        "hits": hit_counts(neurons, assigned),
        "edges": edge_segments(neurons),
        "bounds": grid.bounds(neurons),
    }


def quantization_error(assigned: DataFrame) -> DataFrame:
    """One row: qe, the mean distance of rows to their neurons."""
    return assigned.agg(F.avg("distance").alias("qe"))


def topographic_error(top_two: DataFrame, neurons: DataFrame) -> DataFrame:
    """One row: te, the share of rows whose two best neurons aren't neighbours; 0 for a single neuron."""
    if "neuron_id2" not in top_two.columns:
        return top_two.agg(F.lit(0.0).alias("te"))
    adjacent = grid.adjacency(neurons).select(F.col("src_id").alias("neuron_id"), F.col("dst_id").alias("neuron_id2"), F.lit(0).alias("apart"))
    met = top_two.join(F.broadcast(adjacent), ["neuron_id", "neuron_id2"], "left")
    return met.agg(F.avg(F.coalesce("apart", F.lit(1)).cast("double")).alias("te"))


def quality(rows: DataFrame, book: Codebook, neurons: DataFrame, features: str = "features", dim_weights: np.ndarray | None = None) -> tuple[float, float]:
    """Quantisation and topographic error from one scan. By default the metric is the unweighted one, even
    where prediction weighs dimensions by missingness."""
    both = assign(rows, book, features, dim_weights, two=True)
    if len(book) < 2:
        return float(quantization_error(both).first()[0] or 0.0), 0.0
    adjacent = grid.adjacency(neurons).select(F.col("src_id").alias("neuron_id"), F.col("dst_id").alias("neuron_id2"), F.lit(0).alias("apart"))
    s = both.join(F.broadcast(adjacent), ["neuron_id", "neuron_id2"], "left").agg(F.avg("distance"), F.avg(F.coalesce("apart", F.lit(1)).cast("double"))).first()
    return float(s[0] or 0.0), float(s[1] or 0.0)


def hops_from(book: Codebook, source: tuple[int, int]) -> dict[tuple[int, int], int]:
    """Hops over occupied cells to each that can be reached."""
    cells = set(book.index)
    seen, queue = ({source: 0}, deque([source])) if source in cells else ({}, deque())
    while queue:
        p = queue.popleft()
        for q in grid.neighbors(*p):
            if q in cells and q not in seen:
                seen[q] = seen[p] + 1
                queue.append(q)
    return seen


def geodesic(book: Codebook, source: tuple[int, int], target: tuple[int, int]) -> int:
    """-1 where there is no way or no neuron."""
    return hops_from(book, source).get(target, -1)


def geodesics(spark: SparkSession, book: Codebook, source: tuple[int, int]) -> DataFrame:
    """(neuron_id, hops) of all neurons that can be reached."""
    at = book.index
    return spark.createDataFrame([(int(book.ids[at[p]]), n) for p, n in hops_from(book, source).items()], "neuron_id int, hops int")


def empty_neurons(neurons: DataFrame, assigned: DataFrame) -> DataFrame:
    return neurons.join(assigned.select("neuron_id").distinct(), "neuron_id", "left_anti").select("neuron_id", "x", "y")


def neuron_stats(neurons: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row: total, active, empty, active_fraction, min_hits, mean_hits, max_hits."""
    h = hit_counts(neurons, assigned)
    s = h.agg(F.count("*").alias("total"), F.count_if(F.col("hits") > 0).alias("active"), F.count_if(F.col("hits") == 0).alias("empty"), F.min("hits").alias("min_hits"), F.avg("hits").alias("mean_hits"), F.max("hits").alias("max_hits"))
    return s.withColumn("active_fraction", F.col("active") / F.col("total"))


def hit_histogram(neurons: DataFrame, assigned: DataFrame) -> DataFrame:
    """(hits, n_neurons)."""
    return hit_counts(neurons, assigned).groupBy("hits").agg(F.count("*").alias("n_neurons"))


def grid_ascii(book: Codebook, hits: dict[int, int] | None = None) -> str:
    """A dot for each neuron, or its hits (+ for ten or more); odd rows are moved by one column."""
    return _ascii(book, lambda k: "●" if hits is None else (str(n) if (n := hits.get(int(book.ids[k]), 0)) <= 9 else "+"))


def umatrix_ascii(book: Codebook, u: dict[int, float], shades: str = " ░▒▓█") -> str:
    values = [u.get(int(i), 0.0) for i in book.ids]
    lo, hi = min(values, default=0.0), max(values, default=0.0)
    level = lambda v: round((v - lo) / (hi - lo) * (len(shades) - 1)) if hi > lo else 0
    return _ascii(book, lambda k: shades[level(values[k])])


def _ascii(book: Codebook, mark) -> str:
    if not len(book):
        return ""
    at = book.index
    (x0, y0), (x1, y1) = book.xy.min(0), book.xy.max(0)
    lines = []
    for y in range(y0, y1 + 1):
        cells = [mark(at[x, y]) if (x, y) in at else "·" for x in range(x0, x1 + 1)]
        lines.append((" " if y & 1 else "") + " ".join(cells))
    return "\n".join(lines)
