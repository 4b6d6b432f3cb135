"""Clusters of neurons: U*-valleys, Ward, k-means, and the choice of k. Small tables, on the driver.

Labels start at 1 and are numbered by the least neuron of each cluster.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growmap.functions import grid
from growmap.operators import maps, metrics
from growmap.operators.bmu import Codebook, distances2, matrix


def renumber(labels: np.ndarray) -> np.ndarray:
    """1, 2, ... in order of first appearance."""
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(int(v), len(seen) + 1) for v in labels], int)


def pairwise(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(2), 0))


def ward(x: np.ndarray) -> np.ndarray:
    """Merges (a, b, height, size) by least increase of variance; clusters n, n+1, ... are the merged ones."""
    n = len(x)
    d = pairwise(x) ** 2
    np.fill_diagonal(d, np.inf)
    name, size, out = list(range(n)), np.ones(n), []
    alive = np.ones(n, bool)
    for step in range(n - 1):
        live = np.flatnonzero(alive)
        block = d[np.ix_(live, live)]
        i, j = divmod(int(block.argmin()), len(live))
        a, b = live[min(i, j)], live[max(i, j)]
        h2, rest = d[a, b], live[(live != a) & (live != b)]
        total = size[rest] + size[a] + size[b]
        d[a, rest] = d[rest, a] = ((size[rest] + size[a]) * d[a, rest] + (size[rest] + size[b]) * d[b, rest] - size[rest] * h2) / total
        size[a] += size[b]
        alive[b] = False
        out.append((*sorted((name[a], name[b])), np.sqrt(h2), size[a]))
        name[a] = n + step
    return np.array(out, float).reshape(-1, 4)


def cut_tree(merges: np.ndarray, n: int, k: int) -> np.ndarray:
    """At most k clusters: the lowest height at which no more are left; equal heights merge together."""
    parent = list(range(n + len(merges)))
    heights = merges[:, 2]
    limit = heights[n - k - 1] if k < n else -1.0
    for step, (a, b, h, _) in enumerate(merges):
        if h <= limit:
            parent[int(a)] = parent[int(b)] = n + step

    def root(v: int) -> int:
        while parent[v] != v:
            v = parent[v]
        return v

    return renumber(np.array([root(v) for v in range(n)]))


def kmeans(x: np.ndarray, k: int, seed: int = 0, tries: int = 10, epochs: int = 300) -> tuple[np.ndarray, float]:
    """Labels and cost of the best of ``tries`` fits from seeded k-means++ centers. A cluster that loses all its
    points takes the one farthest from its own center."""
    rng, best, rows = np.random.default_rng(seed), None, np.arange(len(x))
    k = min(k, len(x))
    for _ in range(tries):
        centers = x[[int(rng.integers(len(x)))]]
        while len(centers) < k:
            d = ((x[:, None, :] - centers[None, :, :]) ** 2).sum(2).min(1)
            pick = rng.choice(len(x), p=d / d.sum()) if d.sum() else rng.integers(len(x))
            centers = np.vstack([centers, x[int(pick)]])
        labels = None
        for _ in range(epochs):
            d = ((x[:, None, :] - centers[None, :, :]) ** 2).sum(2)
            now = d.argmin(1)
            for c in np.setdiff1d(np.arange(k), now):
                now[int((d[rows, now] * (np.bincount(now, minlength=k)[now] > 1)).argmax())] = c
            if labels is not None and (now == labels).all():
                break
            labels = now
            centers = np.stack([x[labels == c].mean(0) for c in range(k)])
        cost = float(((x - centers[labels]) ** 2).sum())
        if best is None or cost < best[1] - 1e-12:
            best = labels, cost
    return renumber(best[0]), best[1]


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean of (b - a) / max(a, b); a row alone in its cluster counts 0, fewer than two clusters give 0."""
    ids = np.unique(labels)
    if len(ids) < 2 or len(ids) > len(x) - 1:
        return 0.0
    d = pairwise(x)
    sums = np.stack([d[:, labels == c].sum(1) for c in ids], 1)
    n = np.array([(labels == c).sum() for c in ids])
    own = np.searchsorted(ids, labels)
    rows = np.arange(len(x))
    a = sums[rows, own] / np.maximum(n[own] - 1, 1)
    means = sums / n
    means[rows, own] = np.inf
    b = means.min(1)
    with np.errstate(invalid="ignore"):
        s = np.where(n[own] > 1, (b - a) / np.maximum(a, b), 0.0)
    return float(np.nan_to_num(s).mean())


def davies_bouldin(x: np.ndarray, labels: np.ndarray) -> float:
    ids = np.unique(labels)
    if len(ids) < 2:
        return 0.0
    centers = np.stack([x[labels == c].mean(0) for c in ids])
    spread = np.array([np.sqrt(((x[labels == c] - m) ** 2).sum(1)).mean() for c, m in zip(ids, centers)])
    apart = pairwise(centers)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = (spread[:, None] + spread[None, :]) / apart
    ratio[~np.isfinite(ratio)] = 0.0
    np.fill_diagonal(ratio, 0.0)
    return float(ratio.max(1).mean())


@dataclass
class NeuronClustering:
    """Two-level clustering: method ward or kmeans; n_clusters, or the best k of a range by the least
    Davies-Bouldin index or the greatest silhouette (ties: the least k)."""

    method: str = "ward"
    n_clusters: int | None = None
    min_clusters: int = 2
    max_clusters: int = 10
    criterion: str = "davies_bouldin"
    seed: int = 0
    labels: np.ndarray | None = None
    k: int | None = None
    merges: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))
    profile: list[tuple[int, float, float]] = field(default_factory=list)
    ids: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.method not in ("ward", "kmeans"):
            raise ValueError("method is ward or kmeans")
        if self.criterion not in ("davies_bouldin", "silhouette"):
            raise ValueError("criterion is davies_bouldin or silhouette")
        if self.n_clusters is not None and self.n_clusters < 1 or self.min_clusters < 2 or self.max_clusters < self.min_clusters:
            raise ValueError("numbers of clusters are out of range")

    def fit(self, book: Codebook, spark: SparkSession | None = None) -> NeuronClustering:
        x, n = book.weights, len(book)
        self.ids, self.profile = book.ids, []
        if n <= 1:
            self.labels, self.k = np.ones(n, int), n
            return self
        if self.method == "ward":
            self.merges = ward(x)
            label = lambda k: cut_tree(self.merges, n, k)
        else:
            label = lambda k: kmeans(x, k, self.seed)[0]
        k = self.n_clusters
        if k is None:
            k = self.min_clusters
            for c in range(self.min_clusters, min(self.max_clusters, n - 1) + 1):
                got = label(c)
                if len(np.unique(got)) >= 2:
                    self.profile.append((c, davies_bouldin(x, got), silhouette(x, got)))
            if self.profile:
                k = min(self.profile, key=lambda p: (p[1] if self.criterion == "davies_bouldin" else -p[2], p[0]))[0]
        self.k = min(k, n)
        self.labels = label(self.k)
        return self

    def dataframe(self, spark: SparkSession, book: Codebook) -> DataFrame:
        rows = [(int(i), int(x), int(y), int(c)) for i, (x, y), c in zip(book.ids, book.xy, self.labels)]
        return spark.createDataFrame(rows, "neuron_id int, x int, y int, cluster int")

    def dendrogram(self, spark: SparkSession) -> DataFrame:
        rows = [(k, int(a), int(b), float(h), int(s)) for k, (a, b, h, s) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "step int, a int, b int, height double, size int")

    def k_profile(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.profile, "k int, davies_bouldin double, silhouette double")


def components_at(book: Codebook, low: np.ndarray) -> np.ndarray:
    """Labels of connected neurons where ``low`` holds, 0 elsewhere."""
    at, labels, n = book.index, np.zeros(len(book), int), 0
    for k in range(len(book)):
        if low[k] and not labels[k]:
            n += 1
            stack = [k]
            while stack:
                v = stack.pop()
                if not labels[v]:
                    labels[v] = n
                    stack += [at[q] for q in grid.neighbors(*map(int, book.xy[v])) if q in at and low[at[q]] and not labels[at[q]]]
    return labels


def umatrix_clusters(book: Codebook, ustar: np.ndarray, quantile: float = 0.6) -> np.ndarray:
    """Valleys of U* are clusters; every other neuron joins its first neighbour with a label, those of this
    pass included, or starts a cluster."""
    if not len(book):
        return np.zeros(0, int)
    labels, at = components_at(book, ustar <= np.quantile(ustar, quantile)), book.index
    for k in range(len(book)):
        if not labels[k]:
            near = [labels[at[q]] for q in grid.neighbors(*map(int, book.xy[k])) if q in at and labels[at[q]]]
            labels[k] = near[0] if near else labels.max() + 1
    return labels


def umatrix_clusters_n(book: Codebook, ustar: np.ndarray, n: int, strict: bool = False) -> np.ndarray:
    """As above at quantile 0.99, then the clusters with the nearest centroids merge until n are left. Fewer
    stay fewer, unless ``strict`` starts from single neurons."""
    labels = np.arange(1, len(book) + 1) if strict else umatrix_clusters(book, ustar, 0.99)
    while len(ids := np.unique(labels)) > n:
        centers = np.stack([book.weights[labels == c].mean(0) for c in ids])
        d = pairwise(centers)
        d[np.tril_indices(len(ids))] = np.inf
        i, j = divmod(int(d.argmin()), len(ids))
        labels = np.where(labels == ids[i], ids[j], labels)
    return renumber(labels)


def ustar_of(book: Codebook, neurons: DataFrame, assigned: DataFrame) -> np.ndarray:
    got = {r.neuron_id: r.ustar for r in maps.ustar(neurons, assigned).collect()}
    return np.array([got[int(i)] for i in book.ids])


def assign_labels(assigned: DataFrame, labels: DataFrame, default: int = 0) -> DataFrame:
    """assigned + cluster of its neuron; a neuron without a label gives ``default``."""
    return assigned.join(F.broadcast(labels.select("neuron_id", "cluster")), "neuron_id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(default)))


def cluster_info(labels: DataFrame, assigned: DataFrame) -> DataFrame:
    """(cluster, n_neurons, n_samples, positions)."""
    h = assigned.groupBy("neuron_id").agg(F.count("*").alias("n"))
    both = labels.join(h, "neuron_id", "left")
    return both.groupBy("cluster").agg(F.count("*").alias("n_neurons"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_samples"), F.sort_array(F.collect_list(F.struct("x", "y"))).alias("positions"))


#: Values of one block of rows that all rows are measured against.
BLOCK_VALUES = 1 << 20


def row_silhouettes(labelled: DataFrame, features: str = "features", labels: str = "labels") -> DataFrame:
    """(position, silhouette): the Euclidean silhouette of rows under each labelling in the array ``labels``.

    Every row is measured against all rows, in blocks of BLOCK_VALUES values: a scan for each block adds, by
    row, labelling and cluster, the distances to the block's rows. The work grows with the square of the
    rows, as the definition has it; no task holds more than a batch and a block. NULL features are no rows."""
    rows = labelled.select(F.xxhash64(features, labels).alias("h"), F.col(features).cast("array<double>").alias("f"), F.col(labels).cast("array<int>").alias("l")).filter("f IS NOT NULL").persist()
    try:
        n, dim, kinds = rows.agg(F.count("*"), F.max(F.size("f")), F.max(F.size("l"))).first()
        if not n:
            return rows.sparkSession.createDataFrame([], "position int, silhouette double")
        width = rows.select(F.explode("l").alias("l")).agg(F.max("l")).first()[0] + 1
        sizes = np.zeros((kinds, width))
        for r in rows.select(F.posexplode("l").alias("k", "l")).groupBy("k", "l").count().collect():
            sizes[r.k, r.l] = r["count"]
        blocks = -(-n * dim // BLOCK_VALUES)
        parts = []
        for b in range(blocks):
            block = rows.filter(F.pmod("h", F.lit(blocks)) == b).select("f", "l").toArrow()
            y = matrix(block.column(0).combine_chunks(), dim)
            at = np.array(block.column(1).to_pylist(), int).reshape(-1, kinds)
            hot = np.zeros((len(y), kinds * width))
            for k in range(kinds):
                hot[np.arange(len(y)), k * width + at[:, k]] = 1.0

            def run(batches, y=y, hot=hot):
                for part in batches:
                    x = matrix(part.column(1), dim)
                    for i in range(0, len(x), 1024):
                        sums = np.sqrt(distances2(x[i : i + 1024], y)) @ hot
                        yield pa.RecordBatch.from_arrays([part.column(0).slice(i, 1024), part.column(2).slice(i, 1024), pa.array(list(sums), pa.list_(pa.float64()))], ["h", "l", "sums"])

            parts.append(rows.select("h", "f", "l").mapInArrow(run, "h bigint, l array<int>, sums array<double>"))
        # equal rows share h and their sums; each counts
        long = reduce(DataFrame.unionAll, parts).select("h", "l", F.posexplode("sums").alias("at", "s"))
        both = long.groupBy("h", "l", "at").agg(F.sum("s").alias("s"), (F.count("*") / F.lit(blocks)).alias("times"))
        size = F.element_at(F.lit(sizes.ravel().tolist()), F.col("at") + 1)
        both = both.withColumns({"position": F.floor(F.col("at") / width).cast("int"), "c": F.col("at") % width, "size": size, "mean_s": F.col("s") / F.col("times")}).filter("size > 0")
        own = F.col("c") == F.get("l", F.col("position"))
        ab = both.groupBy("h", "l", "position").agg(
            F.max("times").alias("times"),
            F.max(F.when(own, F.col("size"))).alias("n"),
            F.max(F.when(own, F.try_divide(F.col("mean_s"), F.col("size") - 1))).alias("a"),
            F.min(F.when(~own, F.col("mean_s") / F.col("size"))).alias("b"),
        )
        s = F.when((F.col("n") < 2) | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
        got = ab.groupBy("position").agg((F.sum(s * F.col("times")) / F.sum("times")).alias("silhouette")).collect()
    finally:
        rows.unpersist()
    return labelled.sparkSession.createDataFrame([(r.position, r.silhouette) for r in sorted(got)], "position int, silhouette double")


def _row_fits(rows: DataFrame, ks: list[int], features: str, seed: int) -> tuple[DataFrame, list[float]]:
    """rows + labels, an array of the clusters by each k, and the costs of the fits."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    df = rows.withColumn("__v", array_to_vector(F.col(features).cast("array<double>")))
    points, costs = df.select("__v").cache(), []
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol=f"__k{k}").fit(points)
        costs.append(float(model.summary.trainingCost))
        df = model.transform(df)
    points.unpersist()
    return df.select(*rows.columns, F.array(*[F.col(f"__k{k}") for k in ks]).alias("labels")), costs


def elbow(rows: DataFrame, ks: range = range(2, 11), features: str = "features", seed: int = 0) -> DataFrame:
    """(k, inertia, silhouette) of k-means on the rows themselves; the silhouette is the Euclidean one."""
    labelled, costs = _row_fits(rows, list(ks), features, seed)
    s = {r.position: r.silhouette for r in row_silhouettes(labelled, features).collect()}
    return rows.sparkSession.createDataFrame([(k, c, s.get(i, 0.0)) for i, (k, c) in enumerate(zip(ks, costs))], "k int, inertia double, silhouette double")


def elbow_fits(rows: DataFrame, label: str, ks: range = range(2, 11), fixed_k: int = 3, features: str = "features", seed: int = 0) -> DataFrame:
    """(fit, k, inertia, silhouette, purity) of the k with the greatest silhouette (ties: the least) and of
    ``fixed_k``, against the classes in ``label``."""
    profile = {r.k: r for r in elbow(rows, ks, features, seed).collect()}
    best = max(profile, key=lambda k: (profile[k].silhouette, -k))
    two = [best, fixed_k]
    labelled, costs = _row_fits(rows, two, features, seed)
    s = [r.silhouette for r in row_silhouettes(labelled, features).collect()]
    p = [metrics.purity(metrics.contingency(labelled.withColumn("cluster", F.get("labels", k)), "cluster", label)).first()[0] for k in range(2)]
    return rows.sparkSession.createDataFrame(list(zip(["best", "fixed"], two, costs, s, p)), "fit string, k int, inertia double, silhouette double, purity double")
