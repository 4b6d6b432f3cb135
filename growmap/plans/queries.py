"""The library's operators as queries over the test tables.

Prototypes are the embeddings 0..15 on a 4 x 4 grid, so that everything about a given map can be stated in
SQL as well. Missing values come from a rule: dimension k of row i is missing where (i + k) % 7 = 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from growmap.functions import grid, rescale, vectors
from growmap.model import GrowingMap
from growmap.operators import cluster, growth, maps, metrics, panel, relational, update
from growmap.operators.bmu import Codebook, assign, assign_sql
from growmap.operators.preprocess import ColumnType, Normalization, Scaler, entity_zscore

SIDE = 4
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rows_of(spark: SparkSession, sf: str, nan: bool = False) -> DataFrame:
    f = F.col("embedding").cast("array<double>")
    if nan:
        f = F.transform(f, lambda v, k: F.when((F.col("vec_id") + k) % 7 != 0, v))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "label", f.alias("features"))


def neurons_of(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").filter(F.col("vec_id") < SIDE * SIDE)
    i = F.col("vec_id").cast("int")
    return e.select(i.alias("neuron_id"), (i % SIDE).alias("x"), F.floor(i / SIDE).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("weights"))


def holed(neurons: DataFrame) -> DataFrame:
    """Without neuron 5, so that the map has a hole."""
    return neurons.filter("neuron_id <> 5")


def scored(spark: SparkSession, sf: str, two: bool = False) -> DataFrame:
    return assign(rows_of(spark, sf), Codebook.collect(neurons_of(spark, sf)), nan=False, two=two)


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# -- best-matching neurons


def bmu_assign(spark, sf):
    return scored(spark, sf).select("row_id", "neuron_id", "x", "y", r6("distance").alias("distance"))


def bmu_assign_builtin(spark, sf):
    return assign_sql(rows_of(spark, sf), neurons_of(spark, sf)).select("row_id", "neuron_id", "x", "y", r6("distance").alias("distance"))


def bmu_top2(spark, sf):
    return scored(spark, sf, True).select("row_id", "neuron_id", "neuron_id2", r6("distance").alias("distance"), r6("distance2").alias("distance2"))


def bmu_lineitem(spark, sf):
    """Nearest of eight prototypes made by a rule, for the large table."""
    rows = vectors.vectorise(table(spark, sf, "lineitem").select(*LINE), LINE).select("features")
    book = Codebook.of([(k % 4, k // 4) for k in range(8)], [[6.0 * k + 1, 11000.0 * k + 500, 0.0125 * k, 0.01 * k] for k in range(8)])
    got = assign(rows, book, nan=False, keep=[])
    return got.groupBy("neuron_id", "x", "y").agg(F.count("*").alias("hits"), F.round(F.avg("distance"), 4).alias("mean_distance"))


def quantization_error(spark, sf):
    return maps.quantization_error(scored(spark, sf)).select(r6("qe").alias("qe"))


def topographic_error(spark, sf):
    return maps.topographic_error(scored(spark, sf, True), neurons_of(spark, sf)).select(r6("te").alias("te"))


def hit_counts(spark, sf):
    return maps.hit_counts(neurons_of(spark, sf), scored(spark, sf))


def empty_neurons(spark, sf):
    """Over all rows; prototype 16, ten in each dimension, is far from all of them."""
    near = neurons_of(spark, sf)
    far = near.filter("neuron_id = 0").select(F.lit(16).alias("neuron_id"), F.lit(0).alias("x"), F.lit(4).alias("y"), F.transform("weights", lambda w: F.lit(10.0)).alias("weights"))
    n = near.unionByName(far)
    return maps.empty_neurons(n, assign(rows_of(spark, sf), Codebook.collect(n), nan=False))


def neuron_stats(spark, sf):
    s = maps.neuron_stats(neurons_of(spark, sf), scored(spark, sf))
    return s.withColumns({"mean_hits": r6("mean_hits"), "active_fraction": r6("active_fraction")})


def hit_histogram(spark, sf):
    return maps.hit_histogram(neurons_of(spark, sf), scored(spark, sf))


# -- the grid


def hex_edges(spark, sf):
    return grid.edges(holed(neurons_of(spark, sf)))


def hex_adjacency(spark, sf):
    return grid.adjacency(holed(neurons_of(spark, sf)))


def grid_bounds(spark, sf):
    return grid.bounds(neurons_of(spark, sf))


def boundary_neurons(spark, sf):
    return grid.boundary(holed(neurons_of(spark, sf))).select("neuron_id", "n_occupied", "is_boundary")


def empty_slots(spark, sf):
    return grid.empty_slots(holed(neurons_of(spark, sf)))


def neighbors_at_two(spark, sf):
    return grid.at_distance(neurons_of(spark, sf), 2)


def grid_distances(spark, sf):
    n = neurons_of(spark, sf).select("neuron_id", "x", "y")
    o = n.agg(F.collect_list(F.struct("neuron_id", "x", "y")).alias("o"))
    p = n.join(F.broadcast(o), F.lit(True)).select("neuron_id", "x", "y", F.explode("o").alias("o"))
    xy = (F.col("x"), F.col("y"), F.col("o.x"), F.col("o.y"))
    return p.select(F.col("neuron_id").alias("src_id"), F.col("o.neuron_id").alias("dst_id"), grid.grid_distance_col(*xy).alias("hops"), r6(grid.euclidean_grid_distance_col(*xy)).alias("euclidean"))


def neighborhood_matrix(spark, sf):
    return update.neighborhood_sql(neurons_of(spark, sf), 1.5).withColumn("h", F.round("h", 9))


def umatrix(spark, sf):
    return maps.umatrix(holed(neurons_of(spark, sf))).withColumn("u", r6("u"))


def umatrix_edges(spark, sf):
    return maps.umatrix_edges(holed(neurons_of(spark, sf)), log=True).withColumn("distance", r6("distance"))


def ustar(spark, sf):
    return maps.ustar(neurons_of(spark, sf), scored(spark, sf)).withColumn("ustar", r6("ustar"))


def ustar_threshold(spark, sf):
    return maps.ustar(neurons_of(spark, sf), scored(spark, sf)).agg(r6(F.percentile("ustar", F.lit(0.6))).alias("threshold"))


def component_planes(spark, sf):
    return maps.component_planes(neurons_of(spark, sf)).withColumn("weight", r6("weight"))


def heatmap(spark, sf):
    return maps.heatmap(maps.umatrix(holed(neurons_of(spark, sf))), "u").withColumn("u", r6("u"))


def edge_segments(spark, sf):
    return maps.edge_segments(neurons_of(spark, sf)).withColumns({c: r6(c) for c in ("x1", "y1", "x2", "y2")})


def geodesic(spark, sf):
    book = Codebook.collect(holed(neurons_of(spark, sf)))
    return maps.geodesics(spark, book, (0, 0))


# -- updates and growth


def _long(weights: DataFrame) -> DataFrame:
    return weights.select("neuron_id", F.posexplode("weights").alias("k", "w")).select("neuron_id", (F.col("k") + 1).alias("dim"), r6("w").alias("weight"))


def _updated(spark, sf, nan: bool) -> DataFrame:
    book = Codebook.collect(neurons_of(spark, sf))
    update.update(rows_of(spark, sf, nan), book, 1.0, nan=nan)
    return _long(book.dataframe(spark))


def batch_update_epoch(spark, sf):
    return _updated(spark, sf, False)


def batch_update_nan(spark, sf):
    return _updated(spark, sf, True)


def batch_update_builtin(spark, sf):
    return _long(update.batch_update_sql(scored(spark, sf), neurons_of(spark, sf), 1.0))


def accumulate_errors(spark, sf):
    book = Codebook.collect(neurons_of(spark, sf))
    book.errors, book.hits = book.errors + 5.0, book.hits + 7  # what was there before doesn't count
    update.accumulate_errors(rows_of(spark, sf), book, book, nan=False)
    return book.dataframe(spark).select("neuron_id", r6("error").alias("error"), "hits")


def _with_errors(spark, sf) -> DataFrame:
    return holed(neurons_of(spark, sf)).withColumn("error", ((F.col("neuron_id") * 37) % 23 + F.when(F.col("neuron_id").isin(9, 10), 60).otherwise(0)).cast("double"))


def distribute_errors_builtin(spark, sf):
    full = neurons_of(spark, sf).withColumn("error", (F.col("neuron_id") * 11 % 17 + F.when(F.col("neuron_id").isin(5, 6, 9, 10), 50).otherwise(0)).cast("double"))
    return growth.distribute_sql(full, 55.0).withColumn("error", r6("error"))


def distribute_errors(spark, sf):
    """The trainer's own function."""
    book = Codebook.collect(neurons_of(spark, sf))
    book.errors = np.array([float(i * 11 % 17 + (50 if i in (5, 6, 9, 10) else 0)) for i in map(int, book.ids)])
    growth.distribute_errors(book, 55.0)
    return book.dataframe(spark).select("neuron_id", r6("error").alias("error"))


def growth_candidates_builtin(spark, sf):
    return growth.candidates_sql(_with_errors(spark, sf), 12.0)


def growth_candidates(spark, sf):
    """The trainer's own function."""
    n = _with_errors(spark, sf)
    book = Codebook.collect(n)
    errors = {r.neuron_id: r.error for r in n.select("neuron_id", "error").collect()}
    book.errors = np.array([errors[int(i)] for i in book.ids])
    g = growth.Grid(book)
    return spark.createDataFrame([(g.ids[g.at[p]], float(g.error(p))) for p in growth.growth_candidates(g, 12.0)], "neuron_id int, error double")


def growth_threshold_se(spark, sf):
    gt = update.growth_threshold(rows_of(spark, sf), 64, error=0.8)
    return spark.range(1).select(F.round(F.lit(gt), 6).alias("gt"))


def growth_threshold_sf(spark, sf):
    dim = rows_of(spark, sf).agg(F.max(F.size("features"))).first()[0]
    return spark.createDataFrame([(round(update.growth_threshold(None, dim, spread=0.3), 6),)], "gt double")


def missingness_info(spark, sf):
    info = update.missingness(rows_of(spark, sf, True), 64)
    return spark.createDataFrame([(k + 1, round(float(r), 6), round(float(w), 6)) for k, (r, w) in enumerate(zip(info.rates, info.weights))], "dim int, rate double, weight double")


def nan_distance_bmu(spark, sf):
    got = assign(rows_of(spark, sf, True), Codebook.collect(neurons_of(spark, sf)))
    return got.select("row_id", "neuron_id", r6("distance").alias("distance"))


def weighted_nan_bmu(spark, sf):
    rows = rows_of(spark, sf, True)
    info = update.missingness(rows, 64)
    got = assign(rows, Codebook.collect(neurons_of(spark, sf)), dim_weights=info.weights, nan=True)
    return got.select("row_id", "neuron_id", r6("distance").alias("distance"))


def impute_neighbors(spark, sf):
    """Neuron 5's odd dimensions, from the neurons within two cells."""
    book = Codebook.collect(neurons_of(spark, sf))
    counts = np.where(np.arange(book.weights.shape[1]) % 2 == 0, 0.0, 100.0)
    update.impute(book, 5, counts)
    return _long(book.dataframe(spark)).filter("neuron_id = 5")


# -- preprocessing


def scaler_fit(spark, sf):
    s = Scaler(Normalization.ZSCORE).fit(table(spark, sf, "lineitem"), LINE)
    return spark.createDataFrame([(c.name, c.kind.value, round(c.min, 6), round(c.max, 6), round(c.mean, 9), round(c.std, 9)) for c in s.columns], "name string, kind string, min double, max double, mean double, std double")


def _scaled(spark, sf, method: Normalization, back: bool = False) -> DataFrame:
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LINE)
    s = Scaler(method).fit(df, LINE)
    out = s.transform(df)
    return (s.inverse_transform(out) if back else out).withColumns({c: r6(c) for c in LINE})


def zscore(spark, sf):
    return _scaled(spark, sf, Normalization.ZSCORE)


def minmax(spark, sf):
    return _scaled(spark, sf, Normalization.MINMAX)


def inverse_scale(spark, sf):
    return _scaled(spark, sf, Normalization.ZSCORE, True)


def binary_detect(spark, sf):
    df = table(spark, sf, "part").select((F.col("p_size") % 2).alias("odd"), (F.col("p_size") > 25).cast("int").alias("big"), "p_size", "p_retailprice", F.lit(None).cast("double").alias("nothing"))
    kinds = Scaler().fit(df).types
    return spark.createDataFrame([(k, v is ColumnType.BINARY) for k, v in kinds.items()], "name string, is_binary boolean")


def _part(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", (F.col("p_size") - 25).cast("double").alias("offset_size"))


def log_rescale(spark, sf):
    return rescale.log_rescale(_part(spark, sf), "p_retailprice", "offset_size").select("p_partkey", r6("p_retailprice").alias("p_retailprice"), r6("offset_size").alias("offset_size"))


def signed_log_rescale(spark, sf):
    return rescale.signed_log_rescale(_part(spark, sf), "offset_size").select("p_partkey", r6("offset_size").alias("offset_size"))


def minmax_rescale(spark, sf):
    return rescale.minmax_rescale(_part(spark, sf), "p_size").select("p_partkey", r6("p_size").alias("p_size"))


# -- panels


def _daily(spark, sf) -> DataFrame:
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    e = table(spark, sf, "events").select("user_id", day.alias("day"), "value")
    return e.groupBy("user_id", "day").agg(F.sum("value").alias("total"), F.count("*").cast("double").alias("n"))


def _panel(spark, sf) -> panel.Panel:
    return panel.from_columns(_daily(spark, sf), "user_id", "day", ["total", "n"])


def sliding_windows(spark, sf):
    w = panel.sliding_windows(_panel(spark, sf), 3, 2)
    return w.select(F.col("entity").alias("user_id"), "time_index", "end_time", *[r6(F.get("features", k)).alias(f"v{k}") for k in range(6)])


def entity_zscores(spark, sf):
    return entity_zscore(_daily(spark, sf), "user_id", ["total", "n"]).select("user_id", "day", r6("total").alias("total"), r6("n").alias("n"))


def entity_counts(spark, sf):
    return panel.entity_counts(panel.sliding_windows(_panel(spark, sf), 3, 2)).withColumnRenamed("entity", "user_id")


def _trajectories(spark, sf) -> DataFrame:
    """Each user's days against nine prototypes made by a rule."""
    w = panel.sliding_windows(_panel(spark, sf), 2, 1)
    book = Codebook.of([(k % 3, k // 3) for k in range(9)], [[60.0 * k, 0.5 * k, 40.0 * k, 0.7 * k] for k in range(9)])
    return assign(w, book, nan=False)


def trajectory(spark, sf):
    return panel.trajectory(_trajectories(spark, sf), 7).withColumn("distance", F.round("distance", 4))


def entity_summary(spark, sf):
    t = _trajectories(spark, sf).withColumn("cluster", F.col("neuron_id") % 4).withColumn("era", F.floor(F.col("time_index") / 10).cast("int"))
    return panel.entity_summary(t, era="era").withColumnRenamed("entity", "user_id")


def decade_bucket(spark, sf):
    y = F.year("o_orderdate")
    o = table(spark, sf, "orders").select(panel.decade(y).alias("decade"), panel.decade(y, [1980, 1990, 1995]).alias("bucket"))
    return o.groupBy("decade", "bucket").agg(F.count("*").alias("n"))


def snapshot_clusters(spark, sf):
    t = _trajectories(spark, sf).withColumn("year", F.col("end_time") + 1990)
    labels = spark.range(9).select(F.col("id").cast("int").alias("neuron_id"), F.explode(F.array(F.lit(1990), F.lit(2000))).alias("decade"), (F.col("id") % 3 + 2).cast("int").alias("cluster")).filter("neuron_id <> 1")
    out = panel.snapshot_clusters(t, labels, "year")
    return out.groupBy("decade", "cluster").agg(F.count("*").alias("n"))


def name_clusters(spark, sf):
    c = table(spark, sf, "customer").select((F.col("c_custkey") % 9).cast("int").alias("cluster"), "c_acctbal")
    return panel.name_clusters(c, "c_acctbal", ["low", "middle", "high"]).withColumn("mean_value", r6("mean_value"))


# -- relational steps


def outer_merge(spark, sf):
    """Series by the status of the order: F, O, and all others, which together are all orders."""
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    total = lambda s: o.filter(F.col("o_orderstatus") == s).groupBy("o_custkey", "year").agg(F.round(F.sum("o_totalprice"), 2).alias(f"total_{s.lower()}"))
    other = o.filter(~F.coalesce(F.col("o_orderstatus").isin("F", "O"), F.lit(False))).groupBy("o_custkey", "year").agg(F.count("*").alias("n_other"))
    return relational.outer_merge([total("F"), total("O"), other], ["o_custkey", "year"])


def missing_filter(spark, sf):
    columns = ["total_f", "total_o", "n_other"]
    m = outer_merge(spark, sf)
    return relational.missing_share(relational.drop_sparse_groups(m, "o_custkey", columns, 50.0), "o_custkey", columns).withColumn("missing_pct", r6("missing_pct"))


def anti_filter(spark, sf):
    return relational.exclude(table(spark, sf, "nation"), "n_name", ["FRANCE", "GERMANY"]).select("n_nationkey", "n_name")


def conditional_null(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    return relational.null_before(o, "o_totalprice", "year", 1995)


def label_encode(spark, sf):
    return relational.label_encode(table(spark, sf, "events").select("event_type", "user_id"), "event_type", "code").groupBy("event_type", "code").agg(F.count("*").alias("n"))


def first_names(spark, sf):
    return relational.first_names(table(spark, sf, "events"), "user_id", "event_type", "ts")


def range_filter(spark, sf):
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return relational.known_columns(o, ["o_orderkey", "absent", "year"], "year", 1994, 1996)


# -- clusters and metrics


def _clustered(spark, sf) -> DataFrame:
    labels = neurons_of(spark, sf).filter("neuron_id <> 3").select("neuron_id", F.col("x").alias("cluster"))
    return cluster.assign_labels(scored(spark, sf), labels, default=9)


def _contingency(spark, sf) -> DataFrame:
    return metrics.contingency(_clustered(spark, sf))


def assign_labels(spark, sf):
    return _clustered(spark, sf).select("row_id", "neuron_id", "cluster")


def cluster_info(spark, sf):
    labels = neurons_of(spark, sf).select("neuron_id", "x", "y", F.col("x").alias("cluster"))
    return cluster.cluster_info(labels, scored(spark, sf)).select("cluster", "n_neurons", "n_samples", F.to_json("positions").alias("positions"))


def contingency(spark, sf):
    return _contingency(spark, sf)


def crosstab(spark, sf):
    t = metrics.crosstab(_clustered(spark, sf))
    return t.select("cluster", *[F.col(str(k)).alias(f"label_{k}") for k in range(10)])


def purity(spark, sf):
    return metrics.purity(_contingency(spark, sf)).select(r6("purity").alias("purity"))


def nmi(spark, sf):
    return metrics.nmi(_contingency(spark, sf)).select(r6("nmi").alias("nmi"))


def ari(spark, sf):
    return metrics.ari(_contingency(spark, sf)).select(r6("ari").alias("ari"))


def per_cluster_purity(spark, sf):
    return metrics.cluster_purity(_contingency(spark, sf)).withColumn("purity", r6("purity"))


def count_clusters(spark, sf):
    return metrics.count_clusters(_clustered(spark, sf))


def distribution(spark, sf):
    return metrics.distribution(_contingency(spark, sf)).withColumns({c: r6(c) for c in ("percent", "percent_of_cluster")})


def neuron_classes(spark, sf):
    return metrics.neuron_classes(neurons_of(spark, sf), scored(spark, sf)).withColumn("purity", r6("purity"))


def class_stats(spark, sf):
    return metrics.class_stats(scored(spark, sf))


def silhouette(spark, sf):
    p = neurons_of(spark, sf).withColumn("cluster", F.col("x"))
    return metrics.silhouette_sql(p).select(r6("silhouette").alias("silhouette"))


def davies_bouldin(spark, sf):
    return metrics.davies_bouldin_sql(rows_of(spark, sf), "label").select(r6("davies_bouldin").alias("davies_bouldin"))


# -- fitted maps: seeded, not stated in SQL


def _fitted(spark, sf) -> tuple[GrowingMap, DataFrame]:
    rows = rows_of(spark, sf).coalesce(8)
    return GrowingMap(max_neurons=24, n_iter=6, error_factor=0.8, seed=19).fit(rows), rows


def fit_map(spark, sf):
    model, rows = _fitted(spark, sf)
    return model.neurons(spark)


def fit_map_nan(spark, sf):
    model = GrowingMap(max_neurons=16, n_iter=4, seed=19).fit(rows_of(spark, sf, True).coalesce(8))
    return model.predict(rows_of(spark, sf, True)).select("row_id", "neuron_id", "x", "y", "distance")


def fit_lineitem(spark, sf):
    """A map of the large table, z-scored."""
    model = GrowingMap(max_neurons=32, n_iter=6, error_factor=1.0, feature_cols=LINE, scale=Normalization.ZSCORE, seed=19)
    model.fit(table(spark, sf, "lineitem").select(*LINE))
    return model.neurons(spark)


def ward_clusters(spark, sf):
    book = Codebook.collect(neurons_of(spark, sf))
    return cluster.NeuronClustering("ward").fit(book, spark).dataframe(spark, book)


def ward_dendrogram(spark, sf):
    book = Codebook.collect(neurons_of(spark, sf))
    return cluster.NeuronClustering("ward", n_clusters=3).fit(book, spark).dendrogram(spark).withColumn("height", r6("height"))


def kmeans_clusters(spark, sf):
    book = Codebook.collect(neurons_of(spark, sf))
    return cluster.NeuronClustering("kmeans", n_clusters=3).fit(book, spark).dataframe(spark, book)


def umatrix_clusters(spark, sf):
    n, s = neurons_of(spark, sf), scored(spark, sf)
    book = Codebook.collect(n)
    labels = cluster.umatrix_clusters(book, cluster.ustar_of(book, n, s))
    return spark.createDataFrame([(int(i), int(c)) for i, c in zip(book.ids, labels)], "neuron_id int, cluster int")


def elbow(spark, sf):
    return cluster.elbow(rows_of(spark, sf))


# -- more of the above


def pairwise_distances(spark, sf):
    n = neurons_of(spark, sf).select(F.col("neuron_id").alias("row_id"), F.col("weights").alias("features"))
    got = assign_sql(n, neurons_of(spark, sf), k=SIDE * SIDE)
    return got.select("row_id", "neuron_id", r6("distance").alias("distance"))


def has_missing(spark, sf):
    return spark.createDataFrame([("plain", vectors.has_nan(rows_of(spark, sf))), ("holed", vectors.has_nan(rows_of(spark, sf, True)))], "name string, missing boolean")


def dead_neurons(spark, sf):
    h = maps.hit_counts(neurons_of(spark, sf), scored(spark, sf))
    book = Codebook.collect(neurons_of(spark, sf))
    got = dict(h.select("neuron_id", "hits").collect())
    book.hits = np.array([got[int(i)] for i in book.ids])
    return spark.createDataFrame([(int(book.ids[k]), int(book.hits[k])) for k in growth.dead(book, 30)], "neuron_id int, hits bigint")


def unique_entities(spark, sf):
    return panel.unique_entities(panel.sliding_windows(_panel(spark, sf), 3, 2)).withColumnRenamed("entity", "user_id")


def count_distinct(spark, sf):
    return relational.count_distinct(table(spark, sf, "orders"), n_customers="o_custkey", n_years=F.year("o_orderdate"))


def transform_features(spark, sf):
    out = rescale.transform_features(_part(spark, sf), log=("p_retailprice", "absent"), signed=("offset_size",), minmax=("p_size",))
    return out.select("p_partkey", *[r6(c).alias(c) for c in ("p_retailprice", "offset_size", "p_size")])


def mean_positions(spark, sf):
    """Mean position of all users by day."""
    t = _trajectories(spark, sf)
    return t.groupBy("end_time").agg(F.count("*").alias("n"), r6(F.avg("x")).alias("mean_x"), r6(F.avg("y")).alias("mean_y"))
