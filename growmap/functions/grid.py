"""Geometry of the hexagonal grid (odd-r offset coordinates), for Python integers and for columns.

The six neighbours come in the order E, NE, NW, W, SW, SE; odd rows are moved half a cell right, so the
offsets depend on the parity of y, taken as y & 1 as y may be negative.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Pos = tuple[int, int]


def offsets(odd: bool) -> list[Pos]:
    east = 1 if odd else 0
    return [(1, 0), (east, -1), (east - 1, -1), (-1, 0), (east - 1, 1), (east, 1)]


def neighbors(x: int, y: int) -> list[Pos]:
    return [(x + dx, y + dy) for dx, dy in offsets(bool(y & 1))]


def cube(x, y):
    """Cube coordinates, of integers or numpy arrays."""
    cx = x - (y - (y & 1)) // 2
    return cx, -cx - y, y


def grid_distance(a: Pos, b: Pos) -> int:
    return max(abs(p - q) for p, q in zip(cube(*a), cube(*b)))


def euclidean_grid_distance(a: Pos, b: Pos) -> float:
    return math.hypot(a[0] - b[0], a[1] - b[1])


def pixel(x: int, y: int) -> tuple[float, float]:
    """Centre of a cell for drawing, with unit side length."""
    return math.sqrt(3) * (x + 0.5 * (y & 1)), 1.5 * y


def neighbors_col(x: Column, y: Column) -> Column:
    """array<struct<x,y>> in neighbour order."""

    def shifted(odd: bool) -> Column:
        return F.array(*[F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in offsets(odd)])

    return F.when(y.bitwiseAND(1) == 1, shifted(True)).otherwise(shifted(False))


def grid_distance_col(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    def cx(x: Column, y: Column) -> Column:
        return x - ((y - y.bitwiseAND(1)) / 2).cast("int")

    dx, dz = cx(x1, y1) - cx(x2, y2), y1 - y2
    return F.greatest(F.abs(dx), F.abs(dz), F.abs(dx + dz)).cast("int")


def euclidean_grid_distance_col(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow((x1 - x2).cast("double"), 2) + F.pow((y1 - y2).cast("double"), 2))


def slots(neurons: DataFrame) -> DataFrame:
    """neurons (neuron_id, x, y) -> (neuron_id, k, nx, ny), the six cells around each, k from 0."""
    around = neurons.select("neuron_id", F.posexplode(neighbors_col(F.col("x"), F.col("y"))).alias("k", "c"))
    return around.select("neuron_id", "k", F.col("c.x").alias("nx"), F.col("c.y").alias("ny"))


def adjacency(neurons: DataFrame) -> DataFrame:
    """(src_id, dst_id, k): directed pairs of occupied neighbours, by an equi-join on cells."""
    other = neurons.select(F.col("neuron_id").alias("dst_id"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    return slots(neurons).join(other, ["nx", "ny"]).select(F.col("neuron_id").alias("src_id"), "dst_id", "k")


def edges(neurons: DataFrame) -> DataFrame:
    """(src_id, dst_id), src < dst: distinct undirected edges."""
    return adjacency(neurons).filter("src_id < dst_id").select("src_id", "dst_id").distinct()


def empty_slots(neurons: DataFrame) -> DataFrame:
    """(neuron_id, k, x, y) of the empty cells next to each neuron."""
    taken = neurons.select(F.col("x").alias("nx"), F.col("y").alias("ny"))
    return slots(neurons).join(taken, ["nx", "ny"], "left_anti").select("neuron_id", "k", F.col("nx").alias("x"), F.col("ny").alias("y"))


def boundary(neurons: DataFrame) -> DataFrame:
    """neurons + n_occupied, is_boundary (fewer than six occupied neighbours)."""
    n = adjacency(neurons).groupBy(F.col("src_id").alias("neuron_id")).agg(F.count("*").alias("n_occupied"))
    out = neurons.join(n, "neuron_id", "left").withColumn("n_occupied", F.coalesce("n_occupied", F.lit(0)).cast("long"))
    return out.withColumn("is_boundary", F.col("n_occupied") < 6)


def at_distance(neurons: DataFrame, distance: int) -> DataFrame:
    """(src_id, dst_id) at exactly that grid distance. The map has at most some thousand neurons, and rows
    of cells within reach are met by an equi-join rather than by all pairs."""
    a = neurons.select(F.col("neuron_id").alias("src_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.explode(F.sequence(F.col("y") - distance, F.col("y") + distance)).alias("y2"))
    b = neurons.select(F.col("neuron_id").alias("dst_id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    near = a.join(b, "y2").filter(grid_distance_col(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) == distance)
    return near.select("src_id", "dst_id")


def bounds(neurons: DataFrame) -> DataFrame:
    """One row: x_min, x_max, y_min, y_max (0 without neurons), extent (the longer side in cells)."""
    lo_hi = {f"{c}_{n}": F.coalesce(f(c), F.lit(0)) for c in "xy" for n, f in (("min", F.min), ("max", F.max))}
    b = neurons.agg(*[v.cast("int").alias(k) for k, v in lo_hi.items()])
    return b.withColumn("extent", F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")) + 1)
