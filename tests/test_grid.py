import itertools

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from growmap.functions import grid
from growmap.operators import update

CELL = st.tuples(st.integers(-50, 50), st.integers(-50, 50))


def test_neighbors_of_even_and_odd_rows():
    assert set(grid.neighbors(2, 0)) == {(3, 0), (2, -1), (1, -1), (1, 0), (1, 1), (2, 1)}
    assert set(grid.neighbors(2, 1)) == {(3, 1), (3, 0), (2, 0), (1, 1), (2, 2), (3, 2)}


@given(CELL)
def test_neighbors_are_the_cells_at_distance_one(p):
    around = [(p[0] + dx, p[1] + dy) for dx, dy in itertools.product(range(-2, 3), repeat=2)]
    assert {q for q in around if grid.grid_distance(p, q) == 1} == set(grid.neighbors(*p))


@given(CELL, CELL, CELL)
def test_grid_distance_is_a_metric(a, b, c):
    assert grid.grid_distance(a, b) == grid.grid_distance(b, a) >= 0
    assert (grid.grid_distance(a, b) == 0) == (a == b)
    assert grid.grid_distance(a, c) <= grid.grid_distance(a, b) + grid.grid_distance(b, c)


def test_columns_agree_with_python(spark):
    cells = [(x, y) for x in range(-3, 4) for y in range(-3, 4)]
    df = spark.createDataFrame([(*a, *b) for a in cells for b in cells], "x1 int, y1 int, x2 int, y2 int")
    d = grid.grid_distance_col(*[F.col(c) for c in df.columns])
    for r in df.select("*", d.alias("d"), grid.neighbors_col(F.col("x1"), F.col("y1")).alias("n")).collect():
        assert r.d == grid.grid_distance((r.x1, r.y1), (r.x2, r.y2))
        assert [(c.x, c.y) for c in r.n] == grid.neighbors(r.x1, r.y1)
    xy = np.array(cells)
    d = update.grid_distances(xy)
    assert all(d[i, j] == grid.grid_distance(cells[i], cells[j]) for i in range(0, 49, 5) for j in range(49))


def test_neuron_tables(spark):
    n = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (2, 5, 5)], "neuron_id int, x int, y int")
    assert {(r.src_id, r.dst_id) for r in grid.edges(n).collect()} == {(0, 1)}
    assert grid.bounds(n).first().extent == 6
    assert all(r.is_boundary for r in grid.boundary(n).collect())
    assert grid.empty_slots(n).count() == 5 + 5 + 6
    empty = n.filter("neuron_id < 0")
    assert tuple(grid.bounds(empty).first())[:4] == (0, 0, 0, 0)
