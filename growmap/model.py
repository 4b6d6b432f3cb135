"""The growing map: parameters, training, scoring, analytics."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growmap.functions import vectors
from growmap.operators import cluster, growth, maps, metrics, update
from growmap.operators.bmu import Codebook, assign, matrix
from growmap.operators.preprocess import Normalization, Scaler


@dataclass
class GrowingMap:
    """A growing self-organising map on a hexagonal grid.

    Thresholds of growth: ``error_factor`` (statistical), else ``spread`` in (0, 1]. Inputs are tables with
    an array column ``features``, or with ``feature_cols``; ``scale`` z-scores those first. Missing values
    are NaN or NULL. Rows are scanned once or twice for each of ``n_iter`` epochs; between scans only the
    neurons are on the driver, so no plan grows with the epochs.

    ``nan_scope``: "batch" chooses the metric for the whole table, "row" for streams always takes the one
    for missing values, which is the plain one on complete rows but for the weights.

    ``growth_rule``: "directed" or "reflected", see ``growth.grow``. Tables of up to ``local_cells`` values are
    trained on the driver by the same kernel, which saves the jobs of small tables; by default none is.
    """

    max_neurons: int = 100
    n_iter: int = 100
    error_factor: float | None = 1.0
    spread: float | None = None
    init_size: tuple[int, int] = (2, 2)
    init_weights: np.ndarray | None = None
    feature_cols: list[str] | None = None
    features: str = "features"
    scale: Normalization | None = None
    seed: int = 0
    min_neurons: int = 4
    min_hits: int = 1
    nan_scope: str = "batch"
    local_cells: int = 0
    growth_rule: str = "directed"
    book: Codebook | None = None
    missing: update.Missingness | None = None
    threshold: float | None = None
    scaler: Scaler | None = None
    history: list[tuple[str, int, float, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.spread is not None:
            if not 0 < self.spread <= 1:
                raise ValueError("spread is in (0, 1]")
            self.error_factor = None
        elif self.error_factor is None:
            self.spread = 0.5
        if self.error_factor is not None and self.error_factor <= 0:
            raise ValueError("error_factor is above 0")
        if self.growth_rule not in ("directed", "reflected"):
            raise ValueError("growth_rule is directed or reflected")
        if self.max_neurons < 1 or self.n_iter < 0 or min(self.init_size) < 1:
            raise ValueError("sizes must be positive")

    # -- input

    def rows(self, df: DataFrame | str, spark: SparkSession | None = None, fitting: bool = False) -> DataFrame:
        """The table with a clean features column; a string is the path of a CSV or Parquet file."""
        if isinstance(df, str):
            from growmap.sources.files import read_table

            df = read_table(spark or SparkSession.getActiveSession(), df)
        if self.feature_cols is None and self.features in df.columns:
            return df.withColumn(self.features, vectors.clean(F.col(self.features)))
        cols = self.feature_cols or [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "boolean", "decimal")]
        self.feature_cols = cols
        plain = df.select("*", *[F.col(c).cast("double").alias(f"__f_{c}") for c in cols])
        if self.scale is not None:
            names = [f"__f_{c}" for c in cols]
            if fitting or self.scaler is None:
                self.scaler = Scaler(self.scale).fit(plain, names)
            plain = self.scaler.transform(plain)
        vec = F.array(*[vectors.null_nan(F.col(f"__f_{c}")) for c in cols])
        return plain.withColumn(self.features, vec).drop(*[f"__f_{c}" for c in cols])

    # -- training

    def fit(self, df: DataFrame | str) -> GrowingMap:
        rows = self.rows(df, fitting=True).select(self.features).filter(F.col(self.features).isNotNull()).persist()
        try:
            missing = F.exists(self.features, lambda v: v.isNull())
            n, dim, nan = rows.agg(F.count("*"), F.max(F.size(self.features)), F.coalesce(F.max(missing), F.lit(False))).first()
            if not n:
                raise ValueError("no rows to fit")
            self.missing = update.missingness(rows, dim, self.features) if nan else None
            self.threshold = update.growth_threshold(rows, dim, self.spread, self.error_factor, self.features)
            self.book, self.history = self._initial(dim), []
            if n * dim <= self.local_cells:
                rows.unpersist()
                rows = matrix(rows.select(self.features).toArrow().column(0).combine_chunks(), dim)
            coarse = self.n_iter // 2
            self._coarse(rows, coarse, nan)
            self._fine(rows, self.n_iter - coarse, nan)
            update.accumulate_errors(rows, self.book, self.book, self.features, self.missing, nan)
            self.book = growth.prune(self.book, self.min_hits, self.min_neurons)
        finally:
            if isinstance(rows, DataFrame):
                rows.unpersist()
        return self

    def _initial(self, dim: int) -> Codebook:
        w, h = self.init_size
        xy = [(x, y) for y in range(h) for x in range(w)]
        weights = self.init_weights if self.init_weights is not None else np.random.default_rng(self.seed).standard_normal((len(xy), dim))
        if np.shape(weights) != (len(xy), dim):
            raise ValueError(f"initial weights have the shape {(len(xy), dim)}")
        return Codebook.of(xy, weights)

    def _extent(self) -> int:
        return int((self.book.xy.max(0) - self.book.xy.min(0)).max()) + 1

    def _coarse(self, rows: DataFrame | np.ndarray, epochs: int, nan: bool) -> None:
        first, last = vectors.sigma_range(self._extent())
        noise = np.random.default_rng(self.seed + 1)
        for e in range(1, epochs + 1):
            sigma = vectors.decay_sigma(e, epochs, first, last)
            old = Codebook.of([tuple(map(int, p)) for p in self.book.xy], self.book.weights.copy(), list(self.book.ids))
            update.update(rows, self.book, sigma, self.features, self.missing, nan)
            update.accumulate_errors(rows, old, self.book, self.features, self.missing, nan)
            growth.distribute_errors(self.book, self.threshold)
            self.book = growth.grow(self.book, self.threshold, self.max_neurons, noise, self.growth_rule)
            self.history.append(("coarse", e, sigma, len(self.book)))

    def _fine(self, rows: DataFrame | np.ndarray, epochs: int, nan: bool) -> None:
        first = 0.3 * vectors.sigma_start(self._extent())
        for e in range(1, epochs + 1):
            sigma = vectors.decay_sigma(e, epochs, first, 0.5)
            update.update(rows, self.book, sigma, self.features, self.missing, nan)
            self.history.append(("fine", e, sigma, len(self.book)))

    # -- scoring

    @property
    def is_fitted(self) -> bool:
        return self.book is not None

    def _book(self) -> Codebook:
        if self.book is None:
            raise ValueError("the map is not fitted")
        return self.book

    def _weights(self) -> np.ndarray | None:
        return self.missing.weights if self.missing else None

    def predict(self, df: DataFrame | str) -> DataFrame:
        """Input rows + neuron_id, x, y, distance; where values are missing, dimensions are weighted by how
        often they were seen in training."""
        rows, book = self.rows(df), self._book()
        nan = True if self.nan_scope == "row" else vectors.has_nan(rows, self.features)
        return assign(rows, book, self.features, self._weights() if nan else None, nan)

    predict_with_distances = predict

    def transform(self, df: DataFrame | str) -> DataFrame:
        return self.predict(df).drop("distance")

    def fit_predict(self, df: DataFrame | str) -> DataFrame:
        return self.fit(df).predict(df)

    def fit_transform(self, df: DataFrame | str) -> DataFrame:
        return self.fit(df).transform(df)

    def _unweighted(self, df: DataFrame | str, two: bool = False) -> DataFrame:
        return assign(self.rows(df), self._book(), self.features, two=two)

    # -- analytics

    def neurons(self, spark: SparkSession | None = None) -> DataFrame:
        return self._book().dataframe(spark or SparkSession.getActiveSession())

    @property
    def positions(self) -> list[tuple[int, int]]:
        return [tuple(map(int, p)) for p in self._book().xy]

    @property
    def n_neurons(self) -> int:
        return len(self._book())

    @property
    def input_dim(self) -> int:
        return self._book().weights.shape[1]

    def has_neuron(self, x: int, y: int) -> bool:
        return (x, y) in self._book().index

    def get_neuron(self, x: int, y: int) -> tuple[int, np.ndarray]:
        """neuron_id and weights of the neuron in a cell; an empty cell is a KeyError."""
        k = self._book().index[x, y]
        return int(self.book.ids[k]), self.book.weights[k]

    def hit_counts(self, df: DataFrame | str) -> DataFrame:
        return maps.hit_counts(self.neurons(), self._unweighted(df))

    def umatrix(self) -> DataFrame:
        return maps.umatrix(self.neurons())

    def expanded_umatrix(self, log: bool = False) -> DataFrame:
        return maps.umatrix_edges(self.neurons(), log)

    def ustar(self, df: DataFrame | str) -> DataFrame:
        return maps.ustar(self.neurons(), self._unweighted(df))

    def component_plane(self, dim: int) -> DataFrame:
        """dim from 1."""
        if not 1 <= dim <= self._book().weights.shape[1]:
            raise ValueError("no such dimension")
        return maps.component_planes(self.neurons(), dim)

    def grid_bounds(self) -> tuple[tuple[int, int], tuple[int, int]]:
        lo, hi = self._book().xy.min(0), self._book().xy.max(0)
        return (int(lo[0]), int(hi[0])), (int(lo[1]), int(hi[1]))

    def quality(self, df: DataFrame | str, weighted: bool = False) -> tuple[float, float]:
        return maps.quality(self.rows(df), self._book(), self.neurons(), self.features, self._weights() if weighted else None)

    def quantization_error(self, df: DataFrame | str) -> float:
        return self.quality(df)[0]

    def topographic_error(self, df: DataFrame | str) -> float:
        return self.quality(df)[1]

    def geodesic(self, a: tuple[int, int], b: tuple[int, int]) -> int:
        return maps.geodesic(self._book(), a, b)

    def empty_neurons(self, df: DataFrame | str) -> DataFrame:
        return maps.empty_neurons(self.neurons(), self._unweighted(df))

    def dead_neurons(self, min_hits: int = 1) -> list[tuple[int, int]]:
        return [self.positions[k] for k in growth.dead(self._book(), min_hits)]

    def prune_dead_neurons(self, min_hits: int = 1) -> int:
        before = self.n_neurons
        self.book = growth.prune(self._book(), min_hits, self.min_neurons)
        return before - self.n_neurons

    def neuron_stats(self, df: DataFrame | str) -> DataFrame:
        return maps.neuron_stats(self.neurons(), self._unweighted(df))

    def plotting_data(self, df: DataFrame | str) -> dict[str, DataFrame]:
        return maps.plotting_data(self.neurons(), self._unweighted(df))

    def cluster(self, df: DataFrame | str, quantile: float = 0.6) -> DataFrame:
        """Valleys of U* (neuron_id, x, y, cluster)."""
        u = cluster.ustar_of(self._book(), self.neurons(), self._unweighted(df))
        return self._labelled(cluster.umatrix_clusters(self._book(), u, quantile))

    def cluster_n(self, df: DataFrame | str, n: int, strict: bool = False) -> DataFrame:
        u = cluster.ustar_of(self._book(), self.neurons(), self._unweighted(df))
        return self._labelled(cluster.umatrix_clusters_n(self._book(), u, n, strict))

    def cluster_two_level(self, **options) -> tuple[DataFrame, cluster.NeuronClustering]:
        spark = SparkSession.getActiveSession()
        got = cluster.NeuronClustering(**options).fit(self._book(), spark)
        return got.dataframe(spark, self._book()), got

    def _labelled(self, labels: np.ndarray) -> DataFrame:
        rows = [(int(i), int(x), int(y), int(c)) for i, (x, y), c in zip(self._book().ids, self._book().xy, labels)]
        return SparkSession.getActiveSession().createDataFrame(rows, "neuron_id int, x int, y int, cluster int")

    def evaluate(self, df: DataFrame | str, labels: DataFrame, label: str) -> dict[str, float]:
        """External metrics of clustered neurons, and the silhouette of the neurons."""
        scored = cluster.assign_labels(self.predict(df), labels)
        out = metrics.all_metrics(scored, "cluster", label)
        got = dict(labels.select("neuron_id", "cluster").collect())
        out["silhouette"] = cluster.silhouette(self._book().weights, np.array([got.get(int(i), 0) for i in self._book().ids]))
        return out

    def summary(self) -> str:
        book = self._book()
        (x0, x1), (y0, y1) = self.grid_bounds()
        lines = [f"neurons: {len(book)} of at most {self.max_neurons}", f"dimensions: {book.weights.shape[1]}", f"grid: x {x0}..{x1}, y {y0}..{y1}", f"growth threshold: {self.threshold}", f"missing values: {'yes' if self.missing else 'no'}"]
        return "\n".join(lines)


def standard(**options) -> GrowingMap:
    """The recommended preset: statistical threshold, inputs as they are."""
    return GrowingMap(**({"error_factor": 1.0} | options))


def legacy(**options) -> GrowingMap:
    """The older preset: spreading factor, z-scored inputs."""
    return GrowingMap(**({"spread": 0.5, "error_factor": None, "scale": Normalization.ZSCORE} | options))
