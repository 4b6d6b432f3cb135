"""Training, the model's own methods, clusters and sinks as queries; the maps are those of ``queries``."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growmap.functions import vectors
from growmap.model import GrowingMap, legacy, standard
from growmap.operators import cluster, growth, maps, metrics, panel, relational, update
from growmap.operators.bmu import Codebook, assign, find_bmu as nearest_neuron
from growmap.operators.preprocess import Normalization, Scaler
from growmap.plans.queries import LINE, SIDE, _daily, _long, _trajectories, holed, neurons_of, r6, rows_of, scored, table
from growmap.sources import files, indicators
from growmap.streaming import scoring


def _book(spark: SparkSession, sf: str) -> Codebook:
    return Codebook.collect(neurons_of(spark, sf))


def _model(spark: SparkSession, sf: str) -> GrowingMap:
    return GrowingMap(book=_book(spark, sf))


def _start(spark: SparkSession, sf: str, **options) -> GrowingMap:
    """The prototypes as initial weights of a map that can't grow."""
    return GrowingMap(max_neurons=SIDE * SIDE, init_size=(SIDE, SIDE), init_weights=_book(spark, sf).weights, error_factor=0.8, **options)


def _trained(model: GrowingMap, spark: SparkSession) -> DataFrame:
    n = model.neurons(spark)
    return n.select("neuron_id", "x", "y", "hits", r6("error").alias("error"), r6(F.get("weights", 0)).alias("first_weight"), r6(F.aggregate("weights", F.lit(0.0), lambda a, v: a + v)).alias("weight_sum"))


# -- training


def fit_fine_epoch(spark, sf):
    """One fine epoch, errors, and pruning of neurons that no row matches."""
    return _trained(_start(spark, sf, n_iter=1).fit(rows_of(spark, sf)), spark)


def fit_two_phases(spark, sf):
    """One coarse epoch and two fine ones."""
    return _trained(_start(spark, sf, n_iter=3).fit(rows_of(spark, sf)), spark)


def fit_two_phases_local(spark, sf):
    """The same on the driver."""
    return _trained(_start(spark, sf, n_iter=3, local_cells=1 << 40).fit(rows_of(spark, sf)), spark)


def coarse_epoch(spark, sf):
    """Update, errors by the old best matches, distribution, candidates; the threshold is the mean error."""
    rows, old, book = rows_of(spark, sf), _book(spark, sf), _book(spark, sf)
    growth.reset_errors(book)
    update.update(rows, book, 2.0)
    update.accumulate_errors(rows, old, book)
    threshold = float(book.errors.mean())
    growth.distribute_errors(book, threshold)
    grow = {growth.Grid(book).at[p] for p in growth.growth_candidates(growth.Grid(book), threshold)}
    made = [(int(i), round(float(e), 6), int(h), k in grow) for k, (i, e, h) in enumerate(zip(book.ids, book.errors, book.hits))]
    return spark.createDataFrame(made, "neuron_id int, error double, hits bigint, candidate boolean")


def _holed_book(spark, sf) -> Codebook:
    """The map with a hole, and a neuron apart from all others."""
    book = Codebook.collect(holed(neurons_of(spark, sf)))
    out = Codebook.of([*((int(x), int(y)) for x, y in book.xy), (10, 10)], np.vstack([book.weights, book.weights[:1]]), [*book.ids, 16])
    out.errors = np.array([float(int(i) * 37 % 23) for i in out.ids])
    return out


def growth_directions(spark, sf):
    """Where each neuron with an empty cell would grow, and with which weights; those of a neuron without
    neighbours are random."""
    g, noise, out = growth.Grid(_holed_book(spark, sf)), np.random.default_rng(0), []
    for k, p in enumerate(g.xy):
        if g.is_boundary(p):
            at, w = growth.direction(g, p, noise)
            out.append((g.ids[k], len(g.occupied(p)), *at, round(float(w[0]), 6) if g.occupied(p) else None, round(float(w.sum()), 6) if g.occupied(p) else None))
    return spark.createDataFrame(out, "neuron_id int, n_occupied int, x int, y int, first_weight double, weight_sum double")


def _grown(spark, sf, rule: str) -> DataFrame:
    book = Codebook.collect(neurons_of(spark, sf))
    book.errors = np.where(book.ids == 3, 9.0, 1.0)
    book = growth.grow(book, 5.0, 100, rule=rule)
    rows = [(int(i), int(x), int(y), round(float(w[0]), 6), round(float(w.sum()), 6), float(e)) for i, (x, y), w, e in zip(book.ids, book.xy, book.weights, book.errors)]
    return spark.createDataFrame(rows, "neuron_id int, x int, y int, first_weight double, weight_sum double, error double")


def grow_directed(spark, sf):
    """Neuron 3 alone is a candidate."""
    return _grown(spark, sf, "directed")


def grow_reflected(spark, sf):
    return _grown(spark, sf, "reflected")


def prune_map(spark, sf):
    book = _book(spark, sf)
    update.accumulate_errors(rows_of(spark, sf), book, book)
    book = growth.prune(book, int(np.median(book.hits)), 4)
    return spark.createDataFrame([(int(i), int(x), int(y)) for i, (x, y) in zip(book.ids, book.xy)], "neuron_id int, x int, y int")


def _rare_first(spark, sf) -> DataFrame:
    """The first dimension is missing but in every 97th row."""
    return rows_of(spark, sf).withColumn("features", F.transform("features", lambda v, k: F.when((k != 0) | (F.col("row_id") % 97 == 0), v)))


def batch_update_impute(spark, sf):
    """An epoch with missing values, where poorly seen dimensions are imputed neuron by neuron."""
    rows, book = _rare_first(spark, sf), _book(spark, sf)
    update.update(rows, book, 0.4, missing=update.missingness(rows, 64), nan=True)
    return _long(book.dataframe(spark))


def grid_add_remove(spark, sf):
    g = growth.Grid(_book(spark, sf))
    g.remove({(1, 1), (2, 3)})
    g.add((-1, 0), g.weight((0, 0)))
    g.add((4, 4), g.weight((3, 3)))
    book = g.codebook()
    return spark.createDataFrame([(int(i), int(x), int(y), round(float(w.sum()), 6)) for i, (x, y), w in zip(book.ids, book.xy, book.weights)], "neuron_id int, x int, y int, weight_sum double")


def initial_map(spark, sf):
    model = GrowingMap(init_size=(3, 2), init_weights=np.arange(12.0).reshape(6, 2))
    return model._initial(2).dataframe(spark).select("neuron_id", "x", "y", F.get("weights", 0).alias("a"), F.get("weights", 1).alias("b"), "error", "hits")


def presets(spark, sf):
    """Which threshold holds, by preset and parameters: a spread, else an error factor, else a spread of 0.5."""
    made = [("standard", standard()), ("legacy", legacy()), ("both", GrowingMap(spread=0.3, error_factor=2.0)), ("neither", GrowingMap(error_factor=None)), ("factor", GrowingMap(error_factor=2.0))]
    return spark.createDataFrame([(n, m.spread, m.error_factor, m.scale.value if m.scale else None) for n, m in made], "name string, spread double, error_factor double, scale string")


def sigma_schedule(spark, sf):
    first, last = vectors.sigma_range(9)
    rows = [(n, e, round(vectors.decay_sigma(e, n, first, last), 9), round(vectors.decay_sigma(e, n, 0.3 * vectors.sigma_start(9), 0.5), 9)) for n in (1, 2, 7) for e in range(1, n + 1)]
    return spark.createDataFrame(rows, "epochs int, epoch int, coarse double, fine double")


# -- the model's methods


def model_transform(spark, sf):
    return _model(spark, sf).transform(rows_of(spark, sf)).select("row_id", "neuron_id", "x", "y")


def model_predict_nan(spark, sf):
    """Weighted by the missingness that the model keeps."""
    model, rows = _model(spark, sf), rows_of(spark, sf, True)
    model.missing = update.missingness(rows, 64)
    return model.predict_with_distances(rows).select("row_id", "neuron_id", r6("distance").alias("distance"))


def model_quality(spark, sf):
    qe, te = _model(spark, sf).quality(rows_of(spark, sf))
    return spark.createDataFrame([(round(qe, 6), round(te, 6))], "qe double, te double")


def model_accessors(spark, sf):
    model = _model(spark, sf)
    cells = [(x, y) for x in range(-1, SIDE + 1) for y in range(-1, SIDE + 1)]
    rows = [(x, y, here, (got := model.get_neuron(x, y) if here else (None, None))[0], round(float(got[1].sum()), 6) if here else None) for x, y in cells for here in [model.has_neuron(x, y)]]
    return spark.createDataFrame(rows, "x int, y int, present boolean, neuron_id int, weight_sum double").withColumns({"n_neurons": F.lit(model.n_neurons), "input_dim": F.lit(model.input_dim)})


def model_evaluate(spark, sf):
    labels = neurons_of(spark, sf).select("neuron_id", F.col("x").alias("cluster"))
    got = _model(spark, sf).evaluate(rows_of(spark, sf), labels, "label")
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in got.items()], "name string, value double")


def all_metrics(spark, sf):
    rows = scored(spark, sf).select("label", F.col("neuron_id").alias("cluster"))
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in metrics.all_metrics(rows).items()], "name string, value double")


def model_on_columns(spark, sf):
    """A model on named columns, z-scored by itself."""
    model = GrowingMap(feature_cols=LINE, scale=Normalization.ZSCORE, book=Codebook.of([(k, 0) for k in range(3)], [[k - 1.0] * 4 for k in range(3)]))
    return model.predict(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LINE)).select("l_orderkey", "l_linenumber", "neuron_id", r6("distance").alias("distance"))


def find_bmu(spark, sf):
    """The neuron nearest to the mean of all rows."""
    mean = [r.m for r in sorted(update.by_dimension(rows_of(spark, sf), "features").agg(F.avg("v").alias("m")).collect())]
    i, d = nearest_neuron(mean, _book(spark, sf))
    return spark.createDataFrame([(i, round(d, 6))], "neuron_id int, distance double")


def nan_distances(spark, sf):
    """Distances to prototype 0 as column expressions; every fifth dimension weighs nothing."""
    w = F.lit(neurons_of(spark, sf).filter("neuron_id = 0").first().weights)
    weights = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(k % 5 == 0, 0.0).otherwise(1.0 / (k + 1)))
    f = F.col("features")
    return rows_of(spark, sf, True).select("row_id", r6(vectors.euclidean_nan(f, w)).alias("distance"), r6(F.sqrt(vectors.euclidean_squared_weighted(f, w, weights))).alias("weighted"))


def plotting_tables(spark, sf):
    got = maps.plotting_data(neurons_of(spark, sf), scored(spark, sf))
    return spark.createDataFrame([(k, df.count()) for k, df in got.items()], "name string, n_rows bigint")


def _lines(spark, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line int, text string")


def grid_ascii(spark, sf):
    return _lines(spark, maps.grid_ascii(Codebook.collect(holed(neurons_of(spark, sf)))))


def grid_ascii_hits(spark, sf):
    hits = {r.neuron_id: r.hits for r in maps.hit_counts(neurons_of(spark, sf), scored(spark, sf)).collect()}
    return _lines(spark, maps.grid_ascii(_book(spark, sf), {k: v - min(hits.values()) for k, v in hits.items()}))


def umatrix_ascii(spark, sf):
    n = holed(neurons_of(spark, sf))
    return _lines(spark, maps.umatrix_ascii(Codebook.collect(n), {r.neuron_id: r.u for r in maps.umatrix(n).collect()}))


def model_summary(spark, sf):
    return _lines(spark, _model(spark, sf).summary())


def coordinate_arrays(spark, sf):
    got = maps.coordinate_arrays(neurons_of(spark, sf).withColumn("v", F.col("x") * 10 + F.col("y")), "v")
    return got.select(*[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("xs", "ys", "values")])


# -- clusters


def k_profile(spark, sf):
    got = cluster.NeuronClustering("ward", max_clusters=6).fit(_book(spark, sf), spark)
    return got.k_profile(spark).select("k", r6("davies_bouldin").alias("davies_bouldin"), r6("silhouette").alias("silhouette"))


def model_two_level(spark, sf):
    """The model's own two-level clustering; the number of clusters is chosen."""
    return _model(spark, sf).cluster_two_level(min_clusters=2, max_clusters=10)[0]


def _kmeans(spark, **options) -> DataFrame:
    book = _uneven_book()
    got = cluster.NeuronClustering("kmeans", **options).fit(book, spark)
    return spark.createDataFrame([(int(i), int(c)) for i, c in zip(book.ids, got.labels)], "neuron_id int, cluster int")


def kmeans_three(spark, sf):
    """k-means of nine neurons, the best of ten fits."""
    return _kmeans(spark, n_clusters=3)


def kmeans_chosen(spark, sf):
    """The same with the number of clusters chosen by the Davies-Bouldin index."""
    return _kmeans(spark, min_clusters=2, max_clusters=4)


def cluster_n_strict(spark, sf):
    """Single neurons, the nearest centroids merged until four clusters are left."""
    book = _book(spark, sf)
    labels = cluster.umatrix_clusters_n(book, np.zeros(len(book)), 4, strict=True)
    return spark.createDataFrame([(int(i), int(c)) for i, c in zip(book.ids, labels)], "neuron_id int, cluster int")


def _uneven_book() -> Codebook:
    """Neurons of the trajectories' map with weights of which no two are equally far apart."""
    return Codebook.of([(k % 3, k // 3) for k in range(9)], [[float(k * k), float(k**3 % 7), 3.0 * (k % 4)] for k in range(9)])


def active_clusters(spark, sf):
    """Ward clusters of the neurons that some window matches."""
    part, got = panel.active_clusters(_trajectories(spark, sf), _uneven_book(), spark, 2, 4)
    return spark.createDataFrame([(int(i), int(c)) for i, c in zip(part.ids, got.labels)], "neuron_id int, cluster int")


def decade_clusters(spark, sf):
    """The same in each decade."""
    t = _trajectories(spark, sf).withColumn("year", F.col("end_time") + 1990)
    return panel.decade_clusters(t, _uneven_book(), "year", [1990, 2000, 2010], 2, 4)


def silhouette_neurons(spark, sf):
    """The clustering's own function, on the neurons by column of the grid."""
    book = _book(spark, sf)
    return spark.createDataFrame([(round(cluster.silhouette(book.weights, book.xy[:, 0]), 6),)], "silhouette double")


def davies_bouldin_neurons(spark, sf):
    book = _book(spark, sf)
    return spark.createDataFrame([(round(cluster.davies_bouldin(book.weights, book.xy[:, 0]), 6),)], "davies_bouldin double")


def row_silhouette(spark, sf):
    """Euclidean silhouette of all rows by their label."""
    return cluster.row_silhouettes(rows_of(spark, sf).withColumn("labels", F.array(F.col("label").cast("int")))).select(r6("silhouette").alias("silhouette"))


def elbow_fits(spark, sf):
    """k-means of the rows with the best and a fixed number of clusters, and their purity."""
    return cluster.elbow_fits(rows_of(spark, sf), "label", range(2, 11), 10)


# -- panels and preparation


def panel_from_matrices(spark, sf):
    """A matrix of nations for each region."""
    rows = sorted(table(spark, sf, "nation").select("n_regionkey", "n_nationkey").collect())
    matrices = {f"r{r}": [[float(n), float(n * n)] for k, n in rows if k == r] for r in sorted({k for k, _ in rows})}
    w = panel.sliding_windows(panel.from_matrices(spark, matrices, ["a", "b"]), 2)
    return w.select("entity", "time_index", *[F.get("features", k).alias(f"v{k}") for k in range(4)])


def window_names(spark, sf):
    names = [*panel.window_feature_names(["a", "b"], 2, 3), *panel.window_feature_names(None, 2, 2)]
    return spark.createDataFrame(list(enumerate(names)), "position int, name string")


def trajectory_union(spark, sf):
    t = _trajectories(spark, sf)
    out = panel.trajectories([t.filter("time_index <= 10"), t.filter("time_index > 10")])
    return out.select(F.col("entity").alias("user_id"), "time_index", "neuron_id", "x", "y")


def prepared_panel(spark, sf):
    """Yearly totals and numbers of orders by customer, prepared: sparse and excluded customers go, an early
    series is cut, values rescaled, rows sorted."""
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    o = o.groupBy("o_custkey", "year").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.when(F.count("*") > 1, F.count("*")).cast("double").alias("n_orders"))
    out = relational.prepare_panel(o, "o_custkey", "year", ["total", "n_orders"], [1, 2, 4], 30.0, {"n_orders": 1994}, log=("total",), minmax=("n_orders",))
    return out.select("o_custkey", "year", r6("total").alias("total"), r6("n_orders").alias("n_orders"))


def zscore_at_once(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LINE)
    return Scaler(Normalization.ZSCORE).fit_transform(df, LINE).withColumns({c: r6(c) for c in LINE})


def scaler_summary(spark, sf):
    df = table(spark, sf, "part").select((F.col("p_size") % 2).alias("odd"), "p_size", "p_retailprice")
    return _lines(spark, Scaler(Normalization.MINMAX).fit(df).summary())


# -- streams


def _stream(spark, sf) -> tuple[DataFrame, GrowingMap]:
    model = GrowingMap(feature_cols=["value"], book=Codebook.of([(k, 0) for k in range(4)], [[25.0 * k] for k in range(4)]))
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet"), model


def _ran(spark, stream: DataFrame) -> DataFrame:
    """All there is, once through, as a table."""
    at = f"{files.scratch(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def stream_scores(spark, sf):
    stream, model = _stream(spark, sf)
    got = _ran(spark, scoring.score(stream, model).select("neuron_id", "distance"))
    return got.groupBy("neuron_id").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 4).alias("mean_distance"))


def stream_drift(spark, sf):
    """Windows close when a later event comes by, so the last ones, which the stream leaves open, are not in it."""
    stream, model = _stream(spark, sf)
    got = _ran(spark, scoring.drift(scoring.score(stream, model), "ts", "1 day", "1 hour"))
    return got.filter("window_start < timestamp'2024-01-28'").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", F.round("qe", 4).alias("qe"))


# -- sources and sinks: written, read back


def _at(spark) -> str:
    return f"{files.scratch(spark)}/export-{uuid.uuid4().hex}"


def sink_umatrix(spark, sf):
    files.save_umatrix(holed(neurons_of(spark, sf)), at := f"{_at(spark)}.csv")
    return files.read_table(spark, at).withColumn("u", r6("u"))


def sink_weights(spark, sf):
    files.save_weights(neurons_of(spark, sf), at := f"{_at(spark)}.csv")
    got = files.read_table(spark, at)
    total = sum((F.col(f"f{k + 1}") for k in range(64)), F.lit(0.0))
    return got.select("neuron_id", "x", "y", r6("f1").alias("first_weight"), r6(total).alias("weight_sum"))


def sink_mappings(spark, sf):
    labels = neurons_of(spark, sf).filter("neuron_id <> 3").select("neuron_id", F.col("x").alias("cluster"))
    files.save_mappings(scored(spark, sf).drop("label"), at := f"{_at(spark)}.csv", clusters=labels)
    return files.read_table(spark, at).select(F.col("row_id").cast("long").alias("row_id"), "neuron_id", "cluster", r6("f64").alias("last_feature"))


def sink_clusters(spark, sf):
    files.save_clusters(neurons_of(spark, sf).select("neuron_id", F.col("x").alias("cluster")), at := f"{_at(spark)}.csv")
    return files.read_table(spark, at)


def sink_trajectories(spark, sf):
    files.save_trajectories(_trajectories(spark, sf), at := _at(spark), fmt="parquet")
    return files.read_table(spark, at).select(F.col("entity").cast("long").alias("user_id"), "time_index", "neuron_id", F.round("distance", 4).alias("distance"))


def sink_windows(spark, sf):
    w = panel.sliding_windows(panel.from_columns(_daily(spark, sf), "user_id", "day", ["total", "n"]), 2)
    files.save_windows(w, at := _at(spark))
    return files.read_table(spark, at).select(F.col("entity").alias("user_id"), "time_index", r6(F.get("features", 2)).alias("total"))


def _counted(spark, at: str, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n, spark.read.csv(f"{at}/{n}", header=True).count()) for n in names], "name string, n_rows bigint")


def sink_all(spark, sf):
    n = neurons_of(spark, sf)
    files.save_all(n, scored(spark, sf), at := _at(spark), n.select("neuron_id", F.col("x").alias("cluster")), "label")
    return _counted(spark, at, ["umatrix", "mappings", "weights", "edges", "hits", "clusters", "distribution"])


def sink_panel(spark, sf):
    t = _trajectories(spark, sf).withColumn("cluster", F.col("neuron_id") % 4)
    n = Codebook.of([(k % 3, k // 3) for k in range(9)], [[float(k)] for k in range(9)]).dataframe(spark)
    labels = n.select("neuron_id", (F.col("neuron_id") % 4).alias("cluster"))
    files.save_panel(at := _at(spark), n, t, panel.entity_summary(t), labels, panel.name_clusters(t, "distance", ["near", "far"]))
    return _counted(spark, at, ["snapshots", "trajectories", "summary", "weights", "clusters", "names"])


def _pages(at: str, path: str, records: list[dict], size: int) -> None:
    """The pages of a service as files."""
    n = max(1, -(-len(records) // size))
    for k in range(n):
        indicators.write_page(at, path, k + 1, [{"page": k + 1, "pages": n}, records[k * size : (k + 1) * size]])


def source_countries(spark, sf):
    """Nations as a service's countries, with an aggregate that isn't one."""
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name").collect()
    records = [{"id": f"N{k}", "name": n, "region": {"value": r}} for k, n, r in sorted(rows)]
    _pages(at := _at(spark), "country", [*records, {"id": "WLD", "name": "World", "region": {"value": "Aggregates"}}], 10)
    return indicators.read_countries(spark, at)


def source_indicators(spark, sf):
    """Yearly orders by nation as a service's series in batches and pages, merged."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = o.groupBy("n_nationkey", "n_name", F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").cast("double").alias("n")).collect()
    codes, at = [f"N{k}" for k in range(25)], _at(spark)
    for name, value in (("TOTAL", lambda r: r.total), ("MANY", lambda r: r.n if r.n > 3 else None)):
        for batch in indicators.chunks(codes, 20):
            records = [{"countryiso3code": f"N{r.n_nationkey}", "country": {"value": r.n_name}, "date": str(r.year), "value": value(r)} for r in sorted(g) if f"N{r.n_nationkey}" in batch]
            _pages(at, f"country/{';'.join(batch)}/indicator/{name}", records, 50)
    return indicators.read_indicators(spark, at, codes, {"TOTAL": "total", "MANY": "many"})


def source_csv(spark, sf):
    """A model on the path of a CSV file."""
    at = f"{_at(spark)}.csv"
    table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice").write.csv(at, header=True)
    model = GrowingMap(feature_cols=["p_size", "p_retailprice"], book=Codebook.of([(k, 0) for k in range(4)], [[12.0 * k, 500.0 * k] for k in range(4)]))
    return model.predict(at).select(F.col("p_partkey").cast("long").alias("p_partkey"), "neuron_id", r6("distance").alias("distance"))


def source_in_memory(spark, sf):
    df = vectors.vectorise(table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_size", "p_retailprice"], "p_partkey")
    return df.select(F.col("row_id").cast("long").alias("p_partkey"), *[F.get("features", k).alias(f"f{k}") for k in range(2)])
