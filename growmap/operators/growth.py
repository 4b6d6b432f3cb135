"""Growth and pruning of the map, on the driver: some thousand neurons, in an order that matters.

All orders and ties follow neuron_id, the order of creation.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growmap.functions import grid
from growmap.operators.bmu import Codebook

Pos = tuple[int, int]


class Grid:
    """A codebook that can change: cells of neurons by position."""

    def __init__(self, book: Codebook) -> None:
        self.xy = [(int(x), int(y)) for x, y in book.xy]
        self.weights = [w.copy() for w in book.weights]
        self.errors, self.hits, self.ids = list(book.errors), list(book.hits), [int(i) for i in book.ids]
        self.at = {p: k for k, p in enumerate(self.xy)}

    def codebook(self) -> Codebook:
        out = Codebook.of(self.xy, np.array(self.weights), self.ids)
        out.errors, out.hits = np.array(self.errors, float), np.array(self.hits, int)
        return out

    def occupied(self, p: Pos) -> list[Pos]:
        return [q for q in grid.neighbors(*p) if q in self.at]

    def empty(self, p: Pos) -> list[Pos]:
        return [q for q in grid.neighbors(*p) if q not in self.at]

    def is_boundary(self, p: Pos) -> bool:
        return bool(self.empty(p))

    def error(self, p: Pos) -> float:
        return self.errors[self.at[p]]

    def weight(self, p: Pos) -> np.ndarray:
        return self.weights[self.at[p]]

    def by_error(self, cells: list[Pos]) -> list[Pos]:
        return sorted(cells, key=lambda p: (-self.error(p), self.at[p]))

    def add(self, p: Pos, weights: np.ndarray) -> None:
        if p in self.at:
            raise ValueError(f"{p} is occupied")
        self.at[p] = len(self.xy)
        self.xy.append(p)
        self.weights.append(np.asarray(weights, float))
        self.errors.append(0.0)
        self.hits.append(0)
        self.ids.append(max(self.ids, default=-1) + 1)

    def remove(self, cells: set[Pos]) -> None:
        keep = [k for k, p in enumerate(self.xy) if p not in cells]
        for name in ("xy", "weights", "errors", "hits", "ids"):
            setattr(self, name, [getattr(self, name)[k] for k in keep])
        self.at = {p: k for k, p in enumerate(self.xy)}


def distribute_errors(book: Codebook, threshold: float) -> None:
    """Inner neurons with an error of the threshold or more hand a twelfth to each neighbour on the
    boundary and, if there is one, keep half. Donors never receive, so order is no matter. In place."""
    g = Grid(book)
    inner = [p for p in g.xy if not g.is_boundary(p)]
    for p in inner:
        if (e := g.error(p)) >= threshold:
            takers = [q for q in g.occupied(p) if g.is_boundary(q)]
            for q in takers:
                book.errors[g.at[q]] += e / 12
            if takers:
                book.errors[g.at[p]] = e / 2


def growth_candidates(g: Grid, threshold: float) -> list[Pos]:
    return g.by_error([p for p in g.xy if g.error(p) > threshold and g.is_boundary(p)])


def direction(g: Grid, p: Pos, noise: np.random.Generator) -> tuple[Pos, np.ndarray] | None:
    """Where neuron p grows and with which weights, by its number of neighbours."""
    free = g.empty(p)
    if not free:
        return None
    own, near = g.weight(p), g.by_error(g.occupied(p))
    far = lambda cell: lambda a: grid.grid_distance(a, cell)
    if not near:
        return free[0], own + 0.01 * noise.standard_normal(len(own))
    if len(near) <= 2:
        second = g.by_error([q for q in g.xy if grid.grid_distance(p, q) == 2 and any(grid.grid_distance(q, a) == 1 for a in free)])
        if second:
            return min(free, key=far(second[0])), (own + g.weight(second[0])) / 2
        return max(free, key=far(near[0])), 2 * own - g.weight(near[0])
    if len(near) <= 4:
        return min(free, key=far(near[0])), 2 * own - g.weight(near[-1])
    opposite = [q for q in near if grid.grid_distance(q, free[0]) == 2]
    return free[0], 2 * own - (g.weight(opposite[0]) if opposite else np.mean([g.weight(q) for q in near], axis=0))


def reset_errors(book: Codebook) -> None:
    """In place."""
    book.errors, book.hits = np.zeros(len(book)), np.zeros(len(book), int)


def insert_reflected(g: Grid, p: Pos, parent: Pos, noise: np.random.Generator) -> None:
    """The simpler growth: reflected on the parent's first occupied neighbour."""
    own, near = g.weight(parent), g.occupied(parent)
    g.add(p, 2 * own - g.weight(near[0]) if near else own + 0.01 * noise.standard_normal(len(own)))


def grow(book: Codebook, threshold: float, max_neurons: int, noise: np.random.Generator | None = None, rule: str = "directed") -> Codebook:
    """Candidates are fixed at the start; later ones see the neurons that earlier ones added. ``rule``:
    "directed", by the number of neighbours, or "reflected", into the first empty cell."""
    g, noise = Grid(book), noise or np.random.default_rng(0)
    for p in growth_candidates(g, threshold):
        if len(g.xy) >= max_neurons:
            break
        if not g.is_boundary(p):
            continue
        if rule == "reflected":
            insert_reflected(g, g.empty(p)[0], p, noise)
        else:
            g.add(*direction(g, p, noise))
        g.errors[g.at[p]] = 0.0
    return g.codebook()


def dead(book: Codebook, min_hits: int = 1) -> list[int]:
    """Indices of neurons hit less often."""
    return [k for k, n in enumerate(book.hits) if n < min_hits]


def prune(book: Codebook, min_hits: int = 1, min_neurons: int = 4) -> Codebook:
    g = Grid(book)
    gone = dead(book, min_hits)[: max(0, len(book) - min_neurons)]
    g.remove({g.xy[k] for k in gone})
    return g.codebook()


def candidates_sql(neurons: DataFrame, threshold: float) -> DataFrame:
    """(neuron_id, error) of growth candidates with built-in functions."""
    return grid.boundary(neurons).filter((F.col("error") > threshold) & F.col("is_boundary")).select("neuron_id", "error")


def distribute_sql(neurons: DataFrame, threshold: float) -> DataFrame:
    """(neuron_id, error) after distribution, with built-in functions."""
    b = grid.boundary(neurons).select("neuron_id", "error", "is_boundary")
    links = grid.adjacency(neurons)
    donors = b.filter((~F.col("is_boundary")) & (F.col("error") >= threshold)).select(F.col("neuron_id").alias("src_id"), "error")
    takers = b.filter("is_boundary").select(F.col("neuron_id").alias("dst_id"))
    given = links.join(donors, "src_id").join(takers, "dst_id")
    got = given.groupBy("dst_id").agg(F.sum(F.col("error") / 12).alias("got"))
    gave = given.select("src_id").distinct().withColumn("gave", F.lit(True))
    out = b.join(got, b["neuron_id"] == got["dst_id"], "left").join(gave, b["neuron_id"] == gave["src_id"], "left")
    return out.select("neuron_id", (F.when(F.col("gave"), F.col("error") / 2).otherwise(F.col("error")) + F.coalesce("got", F.lit(0.0))).alias("error"))
