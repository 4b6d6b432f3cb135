"""Evaluation of clusters against classes, from the contingency table; one aggregation over the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from growmap.functions import vectors


def contingency(rows: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """(cluster, label, n)."""
    return rows.groupBy(F.col(cluster).alias("cluster"), F.col(label).alias("label")).agg(F.count("*").alias("n"))


def crosstab(rows: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """One row per cluster, a column per class."""
    return contingency(rows, cluster, label).groupBy("cluster").pivot("label").agg(F.sum("n")).na.fill(0)


def _sums(table: DataFrame) -> DataFrame:
    """One row: n, and sums over cells, clusters and classes of n ln n and of pairs."""
    cells = table.withColumn("n", F.col("n").cast("double"))
    entropy, pairs = F.sum(F.col("n") * F.log("n")), F.sum(F.col("n") * (F.col("n") - 1) / 2)
    total = cells.agg(F.sum("n").alias("n"), entropy.alias("e_ij"), pairs.alias("p_ij"), F.count_distinct("cluster").alias("k"), F.count_distinct("label").alias("c"))
    by = lambda c, s: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(entropy.alias(f"e_{s}"), pairs.alias(f"p_{s}"))
    return total.join(by("cluster", "i"), F.lit(True)).join(by("label", "j"), F.lit(True))


def nmi(table: DataFrame) -> DataFrame:
    """One row: nmi, normalised by the mean of both entropies; a single cluster and class: 1."""
    s = _sums(table)
    hu, hv = F.log("n") - F.col("e_i") / F.col("n"), F.log("n") - F.col("e_j") / F.col("n")
    mutual = F.log("n") + (F.col("e_ij") - F.col("e_i") - F.col("e_j")) / F.col("n")
    return s.select(F.when((F.col("k") == 1) & (F.col("c") == 1), 1.0).otherwise(2 * mutual / (hu + hv)).alias("nmi"))


def ari(table: DataFrame) -> DataFrame:
    """One row: ari; 1 where the index can't vary."""
    s = _sums(table)
    expected = F.coalesce(F.try_divide(F.col("p_i") * F.col("p_j"), F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))
    span = (F.col("p_i") + F.col("p_j")) / 2 - expected
    return s.select(F.coalesce(F.try_divide(F.col("p_ij") - expected, span), F.lit(1.0)).alias("ari"))


def purity(table: DataFrame) -> DataFrame:
    """One row: purity, the share of rows in their cluster's largest class."""
    best = table.groupBy("cluster").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    return best.agg(F.try_divide(F.sum("most"), F.sum("n")).alias("purity"))


def cluster_purity(table: DataFrame) -> DataFrame:
    """(cluster, dominant, purity, size); ties: the least class."""
    best = table.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("b"), F.sum("n").alias("size"))
    return best.select("cluster", F.col("b.label").alias("dominant"), (-F.col("b.m") / F.col("size")).alias("purity"), "size")


def count_clusters(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    return rows.agg(F.count_distinct(cluster).alias("n_clusters"))


def distribution(table: DataFrame) -> DataFrame:
    """(cluster, label, n, percent of all rows, percent of its cluster)."""
    size = table.groupBy("cluster").agg(F.sum("n").alias("size"))
    total = size.agg(F.sum("size").alias("total"))
    both = table.join(size, "cluster").join(F.broadcast(total), F.lit(True))
    return both.select("cluster", "label", "n", (F.col("n") * 100 / F.col("total")).alias("percent"), (F.col("n") * 100 / F.col("size")).alias("percent_of_cluster"))


def neuron_classes(neurons: DataFrame, assigned: DataFrame, label: str = "label") -> DataFrame:
    """(neuron_id, n_classes, dominant, purity, kind): pure, mixed or empty; an empty neuron is class -1."""
    t = contingency(assigned, "neuron_id", label).withColumnRenamed("cluster", "id")
    best = t.groupBy("id").agg(F.count("*").alias("n_classes"), F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("b"), F.sum("n").alias("size"))
    met = neurons.join(best, neurons["neuron_id"] == best["id"], "left")
    kind = F.when(F.col("id").isNull(), "empty").when(F.col("n_classes") == 1, "pure").otherwise("mixed")
    return met.select("neuron_id", F.coalesce("n_classes", F.lit(0)).cast("long").alias("n_classes"), F.coalesce("b.label", F.lit(-1)).alias("dominant"), F.coalesce(-F.col("b.m") / F.col("size"), F.lit(0.0)).alias("purity"), kind.alias("kind"))


def class_stats(assigned: DataFrame, label: str = "label") -> DataFrame:
    """(label, n_rows, n_neurons, n_pure): where each class lies on the map."""
    t = contingency(assigned, "neuron_id", label)
    classes = Window.partitionBy("cluster")
    return t.withColumn("k", F.count("*").over(classes)).groupBy("label").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_neurons"), F.count_if(F.col("k") == 1).alias("n_pure"))


def davies_bouldin_sql(rows: DataFrame, cluster: str = "cluster", features: str = "features") -> DataFrame:
    """One row: davies_bouldin of any number of rows: centroids by dimension, spreads, then pairs of
    clusters, met by an equi-join on the dimension and summed. Equal centroids count 0, as does a single
    cluster. Rows only meet the centroid of their own cluster."""
    long = rows.select(F.col(cluster).alias("c"), F.posexplode(F.col(features).cast("array<double>")).alias("k", "v"))
    mean = long.groupBy("c", "k").agg(F.avg("v").alias("m"))
    centers = mean.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("center"))
    met = rows.select(F.col(cluster).alias("c"), F.col(features).cast("array<double>").alias("f")).join(centers, "c")
    spread = met.groupBy("c").agg(F.avg(vectors.euclidean(F.col("f"), F.col("center"))).alias("s"))
    own = mean.join(spread, "c")
    other = own.select(F.col("c").alias("oc"), "k", F.col("m").alias("om"), F.col("s").alias("os"))
    apart = own.join(other, "k").filter("c <> oc").groupBy("c", "oc", "s", "os").agg(F.sqrt(F.sum((F.col("m") - F.col("om")) ** 2)).alias("d"))
    worst = apart.groupBy("c").agg(F.max(F.coalesce(F.try_divide(F.col("s") + F.col("os"), F.col("d")), F.lit(0.0))).alias("w"))
    return worst.agg(F.coalesce(F.avg("w"), F.lit(0.0)).alias("davies_bouldin"))


def silhouette_sql(points: DataFrame, cluster: str = "cluster", features: str = "weights", row_id: str = "neuron_id") -> DataFrame:
    """One row: silhouette of a small table such as a map's neurons, which travels as one array."""
    p = points.select(F.col(row_id).alias("i"), F.col(cluster).alias("c"), F.col(features).cast("array<double>").alias("f"))
    far = p.join(F.broadcast(p.agg(F.collect_list(F.struct("i", "c", "f")).alias("o"))), F.lit(True)).select("i", "c", "f", F.explode("o").alias("o"))
    d = far.select("i", "c", F.col("o.c").alias("oc"), F.when(F.col("o.i") != F.col("i"), vectors.euclidean(F.col("f"), F.col("o.f"))).alias("d"))
    means = d.groupBy("i", "c", "oc").agg(F.avg("d").alias("m"))
    ab = means.groupBy("i", "c").agg(F.max(F.when(F.col("oc") == F.col("c"), F.col("m"))).alias("a"), F.min(F.when(F.col("oc") != F.col("c"), F.col("m"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
    return ab.agg(F.coalesce(F.avg(s), F.lit(0.0)).alias("silhouette"))


def all_metrics(rows: DataFrame, cluster: str = "cluster", label: str = "label") -> dict[str, float]:
    """nmi, ari, purity, n_clusters; a row without a cluster is an error."""
    if rows.filter(F.col(cluster).isNull()).limit(1).count():
        raise KeyError("rows without a cluster")
    t = contingency(rows, cluster, label).cache()
    out = {"nmi": nmi(t).first()[0], "ari": ari(t).first()[0], "purity": purity(t).first()[0], "n_clusters": t.select("cluster").distinct().count()}
    t.unpersist()
    return out
