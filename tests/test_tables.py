import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from growmap.functions import rescale
from growmap.model import GrowingMap
from growmap.operators import cluster, metrics, panel, relational, update
from growmap.operators.bmu import Codebook, assign, find_bmu
from growmap.operators.preprocess import ColumnType, Normalization, Scaler, entity_zscore
from growmap.sources import files, indicators


def test_scaler(spark):
    df = spark.createDataFrame([(0.0, 1.0, 5.0), (1.0, 3.0, 5.0), (1.0, None, 5.0)], "b double, v double, c double")
    s = Scaler(Normalization.ZSCORE).fit(df)
    assert s.types == {"b": ColumnType.BINARY, "v": ColumnType.CONTINUOUS, "c": ColumnType.CONTINUOUS}
    got = s.transform(df).collect()
    assert [r.v for r in got] == [-1, 1, None] and [r.c for r in got] == [0, 0, 0] and [r.b for r in got] == [0, 1, 1]
    assert [r.v for r in s.inverse_transform(s.transform(df)).collect()] == [1, 3, None]
    m = Scaler(Normalization.MINMAX).fit(df)
    assert [r.c for r in m.transform(df).collect()] == [0, 0, 0]
    with pytest.raises(ValueError):
        s.transform(df.drop("v"))


def test_rescale(spark):
    df = spark.createDataFrame([(1.0, -1.0, 2.0), (math.e, 0.0, 2.0), (math.e**2, 1.0, 2.0)], "p double, s double, c double")
    got = rescale.transform_features(df, log=("p", "absent"), signed=("s",), minmax=("c",)).collect()
    assert [round(r.p, 6) for r in got] == [0, 50, 100] and [round(r.s, 6) for r in got] == [0, 50, 100] and [r.c for r in got] == [2, 2, 2]
    assert [r.s for r in rescale.log_rescale(df, "s").collect()] == [-1, 0, 1]


def test_entity_zscore(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("c", 4.0), ("c", 4.0)], "e string, v double")
    got = sorted((r.e, r.v) for r in entity_zscore(df, "e", ["v"]).filter("v is not null").collect())
    assert [(e, round(v, 6)) for e, v in got] == [("a", -0.707107), ("a", 0.707107), ("c", 0.0), ("c", 0.0)]


def test_windows_and_summary(spark):
    rows = [("a", t, float(t), None if t == 2 else 10.0 * t) for t in (1, 2, 4, 5, 9)] + [("b", 1, 0.0, 0.0)]
    p = panel.from_columns(spark.createDataFrame(rows, "e string, t int, u double, v double"), "e", "t", ["u", "v"])
    w = panel.sliding_windows(p, 3, 2).orderBy("time_index").collect()
    assert [(r.entity, r.time_index, r.end_time) for r in w] == [("a", 3, 4), ("a", 5, 9)]
    assert w[0].features == [1, 10, 2, None, 4, 40]
    assert panel.window_feature_names(["u"], 1, 3) == ["u_t-2", "u_t-1", "u_t0"] and panel.window_dim(2, 3) == 6
    m = panel.from_matrices(spark, {"a": [[1, 2], [3, 4]], "b": [[5, 6], [7, 8]]})
    assert m.features == ("f1", "f2") and m.df.count() == 4
    with pytest.raises(ValueError):
        panel.from_matrices(spark, {})
    s = spark.createDataFrame([("a", 1, 5, 2, 0), ("a", 2, 6, 3, 0), ("a", 3, 7, 2, 1)], "entity string, time_index int, neuron_id int, cluster int, era int")
    r = panel.entity_summary(s, era="era").first()
    assert (r.first_neuron, r.last_neuron, r.main_cluster, r.n_changes) == (5, 7, 2, 1)


def test_names_repeat_with_the_same_suffix(spark):
    c = spark.createDataFrame([(k, float(k)) for k in range(6)], "cluster int, v double")
    got = {r.cluster: r.name for r in panel.name_clusters(c, "v", ["low", "high"]).collect()}
    assert got == {0: "low", 1: "low (2)", 2: "low (2)", 3: "high", 4: "high (2)", 5: "high (2)"}


def test_relational(spark):
    a = spark.createDataFrame([("x", 1, 1.0)], "k string, y int, a double")
    b = spark.createDataFrame([("x", 1, 2.0), ("z", 1, 3.0)], "k string, y int, b double")
    m = relational.outer_merge([a, b], ["k", "y"])
    assert sorted(map(tuple, m.collect()), key=str) == [("x", 1, 1.0, 2.0), ("z", 1, None, 3.0)]
    assert [r.k for r in relational.drop_sparse_groups(m, "k", ["a", "b"], 30).collect()] == ["x"]
    assert [r.k for r in relational.exclude(m, "k", ["x"]).collect()] == ["z"]
    e = relational.label_encode(b, "k", "code")
    assert {r.k: r.code for r in e.collect()} == {"x": 0, "z": 1}


def test_ward_by_hand():
    x = np.array([[0.0], [1], [10], [12]])
    m = cluster.ward(x)
    assert m[:, :2].tolist() == [[0, 1], [2, 3], [4, 5]]
    assert m[:2, 2].tolist() == pytest.approx([1, 2]) and m[2, 2] == pytest.approx(math.sqrt(2 * 2 * 2 / 4 * 10.5**2))
    assert cluster.cut_tree(m, 4, 2).tolist() == [1, 1, 2, 2] and cluster.cut_tree(m, 4, 4).tolist() == [1, 2, 3, 4]
    same = cluster.ward(np.array([[0.0], [1], [10], [11]]))
    assert len(set(cluster.cut_tree(same, 4, 3).tolist())) == 2


def test_internal_metrics_by_hand(spark):
    x, y = np.array([[0.0], [2], [10], [12]]), np.array([1, 1, 2, 2])
    assert cluster.silhouette(x, y) == pytest.approx(np.mean([1 - 2 / 11, 1 - 2 / 9, 1 - 2 / 9, 1 - 2 / 11]))
    assert cluster.davies_bouldin(x, y) == pytest.approx(0.2)
    df = spark.createDataFrame([(i, int(c), [float(v)]) for i, (v, c) in enumerate(zip(x[:, 0], y))], "neuron_id int, cluster int, weights array<double>")
    assert metrics.silhouette_sql(df).first()[0] == pytest.approx(cluster.silhouette(x, y))
    assert metrics.davies_bouldin_sql(df, features="weights").first()[0] == pytest.approx(0.2)
    assert cluster.silhouette(x, np.ones(4)) == 0


def test_external_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (2, "b"), (2, "b")], "cluster int, label string")
    got = metrics.all_metrics(df)
    assert got["purity"] == pytest.approx(5 / 6) and got["n_clusters"] == 2
    pairs, a, b, n = 1 + 3, 6, 1 + 6, 15
    assert got["ari"] == pytest.approx((pairs - a * b / n) / ((a + b) / 2 - a * b / n))
    one = spark.createDataFrame([(1, "a"), (1, "a")], "cluster int, label string")
    assert metrics.nmi(metrics.contingency(one)).first()[0] == 1 and metrics.ari(metrics.contingency(one)).first()[0] == 1
    with pytest.raises(KeyError):
        metrics.all_metrics(spark.createDataFrame([(None, "a")], "cluster int, label string"))


def test_choice_of_k(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (5, 2)) for c in ((0, 0), (5, 5), (9, 0))])
    book = Codebook.of([(k % 5, k // 5) for k in range(15)], x)
    for criterion in ("davies_bouldin", "silhouette"):
        got = cluster.NeuronClustering(criterion=criterion, max_clusters=6).fit(book)
        assert got.k == 3 and got.labels.tolist() == [1] * 5 + [2] * 5 + [3] * 5
    assert cluster.NeuronClustering("kmeans", n_clusters=3).fit(book, spark).labels.tolist() == got.labels.tolist()
    assert cluster.NeuronClustering().fit(Codebook.of([(0, 0)], [[1.0]])).labels.tolist() == [1]
    with pytest.raises(ValueError):
        cluster.NeuronClustering(method="other")


def test_valleys():
    book = Codebook.of([(k, 0) for k in range(6)], np.arange(6.0)[:, None])
    u = np.array([0, 0, 9, 0, 0, 8.0])
    assert cluster.umatrix_clusters(book, u).tolist() == [1, 1, 2, 2, 2, 2]
    assert len(set(cluster.umatrix_clusters_n(book, u, 2, strict=True).tolist())) == 2


def test_sinks(spark, tmp_path):
    n = spark.createDataFrame([(0, 0, 0, [1.0, 2.0]), (1, 1, 0, [3.0, 4.0])], "neuron_id int, x int, y int, weights array<double>")
    s = spark.createDataFrame([("a", 1, [1.0, 2.0], 0, 0, 0, 0.0, 1)], "entity string, time_index int, features array<double>, neuron_id int, x int, y int, distance double, label int")
    c = n.select("neuron_id", "x", "y", F.lit(1).alias("cluster"))
    files.save_all(n, s, str(tmp_path / "all"), c, "label")
    files.save_trajectories(s, str(tmp_path / "t"))
    files.save_panel(str(tmp_path / "p"), n, s, s.select("entity", "label"), c)
    assert spark.read.csv(str(tmp_path / "p/snapshots"), header=True).columns[-1] == "time_index"
    assert spark.read.csv(str(tmp_path / "all/weights"), header=True).columns == ["neuron_id", "x", "y", "f1", "f2"]
    assert spark.read.csv(str(tmp_path / "t"), header=True).count() == 1


def test_indicator_source(spark, tmp_path):
    def page(name, pages, rows):
        (tmp_path / name).write_text(json.dumps([{"pages": pages}, rows]))

    row = lambda code, year, v: {"countryiso3code": code, "country": {"value": code.lower()}, "date": str(year), "value": v}
    page("country_AAA-BBB_indicator_I_p1.json", 2, [row("AAA", 2000, 1.0), row("BBB", 2000, None)])
    page("country_AAA-BBB_indicator_I_p2.json", 2, [row("BBB", 2001, 2.0)])
    page("country_AAA-BBB_indicator_J_p1.json", 1, [row("AAA", 2000, 5.0)])
    page("country_p1.json", 1, [{"id": "AAA", "name": "a", "region": {"value": "R"}}, {"id": "XXX", "name": "x", "region": {"value": "Aggregates"}}])
    got = indicators.read_indicators(spark, str(tmp_path), ["AAA", "BBB"], {"I": "i", "J": "j"}).collect()
    assert [tuple(r) for r in got] == [("AAA", "aaa", 2000, 1.0, 5.0), ("BBB", "bbb", 2001, 2.0, None)]
    assert [r.code for r in indicators.read_countries(spark, str(tmp_path)).collect()] == ["AAA"]


def test_ragged_vectors_are_an_error(spark):
    rows = spark.createDataFrame([([0.0, 0.0, 5.0],), ([9.0],)], "features array<double>")
    book = Codebook.of([(0, 0), (1, 0)], [[0.0, 0.0], [5.0, 9.0]])
    for run in (lambda: assign(rows, book, nan=False).collect(), lambda: update.bmu_sums(rows, book), lambda: update.accumulate_errors(rows, book, book)):
        with pytest.raises(Exception, match="features must have 2 values"):
            run()
    with pytest.raises(Exception, match="features must have 3 values"):
        GrowingMap(n_iter=2).fit(rows)
    with pytest.raises(ValueError, match="2 values"):
        find_bmu([1.0], book)
    assert find_bmu([4.0, 9.0], book) == (1, 1.0)


def test_metrics_of_degenerate_tables(spark):
    one = spark.createDataFrame([(1, 1)], "cluster int, label int")
    assert metrics.all_metrics(one) == {"nmi": 1.0, "ari": 1.0, "purity": 1.0, "n_clusters": 1}
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [4.0, 2.0])], "cluster int, features array<double>")
    assert metrics.davies_bouldin_sql(same).first()[0] == 0.0
    assert metrics.davies_bouldin_sql(same.filter("cluster = 1")).first()[0] == 0.0
    assert metrics.davies_bouldin_sql(same.limit(0)).first()[0] == 0.0
    assert metrics.ari(metrics.contingency(one.limit(0))).first()[0] == 1.0


def test_label_codes_beyond_the_broadcast_bound(spark, monkeypatch):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    want = sorted(relational.label_encode(df, "c", "code").collect(), key=repr)
    monkeypatch.setattr(relational, "BROADCAST_CLASSES", -1)
    assert sorted(relational.label_encode(df, "c", "code").collect(), key=repr) == want == [("a", 0), ("b", 1), ("b", 1), (None, None)]
