import numpy as np
import pytest
from pyspark.sql import functions as F

from growmap.functions import vectors
from growmap.model import GrowingMap
from growmap.operators import growth, maps, update
from growmap.operators.bmu import Codebook, assign, assign_sql, distances2

NAN = float("nan")


def rows(spark, values):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(values)], "row_id int, features array<double>")


def book(cells):
    return Codebook.of(list(cells), np.array(list(cells.values()), float))


def qe_te(spark, cells, values):
    b = book(cells)
    return maps.quality(rows(spark, values), b, b.dataframe(spark))


def test_quantization_error_by_hand(spark):
    assert qe_te(spark, {(0, 0): [1, 0], (1, 0): [5, 0]}, [[0, 0], [2, 0], [6, 0]])[0] == pytest.approx(1.0)
    assert qe_te(spark, {(0, 0): [3, 4]}, [[1, 1], [5, 7], [3, 4], [0, 0]])[0] == pytest.approx((2 * 13**0.5 + 5) / 4)
    assert qe_te(spark, {(0, 0): [0, 0, 0], (1, 0): [10, 10, 10]}, [[1, 1, 1], [9, 9, 9]])[0] == pytest.approx(3**0.5)
    assert qe_te(spark, {(i, 0): [i] for i in range(20)}, [[i + 0.5] for i in range(19)])[0] == pytest.approx(0.5)


def test_topographic_error_by_hand(spark):
    assert qe_te(spark, {(0, 0): [0, 0], (1, 0): [10, 0]}, [[1, 2], [7, 7]])[1] == 0
    assert qe_te(spark, {(0, 0): [0], (5, 5): [100]}, [[50], [20], [80]])[1] == 1
    assert qe_te(spark, {(0, 0): [0], (1, 0): [5], (5, 5): [100]}, [[1], [90]])[1] == pytest.approx(0.5)
    assert qe_te(spark, {(0, 0): [0]}, [[1], [90]])[1] == 0


def test_two_best_and_ties(spark):
    b = book({(0, 0): [0], (1, 0): [5], (2, 0): [10]})
    r = assign(rows(spark, [[1]]), b, two=True).first()
    assert (r.neuron_id, r.distance, r.neuron_id2, r.distance2) == (0, 1, 1, 4)
    assert assign(rows(spark, [[7.5]]), b).first().neuron_id == 1


def test_missingness_and_distances(spark):
    df = rows(spark, [[NAN, 1, 1], [NAN, 1, 1], [1, NAN, 1], [1, 1, 1]])
    info = update.missingness(df, 3)
    assert info.rates.tolist() == [0.5, 0.25, 0] and info.weights.tolist() == [0.25, 0.5625, 1]
    assert distances2(np.array([[1, NAN, 3]]), np.array([[4.0, 5, 6]]), np.ones(3), True)[0, 0] == pytest.approx(27)
    assert distances2(np.array([[1, NAN]]), np.array([[3.0, 5]]), np.array([1.0, 0]), True)[0, 0] == pytest.approx(4)
    assert np.isinf(distances2(np.full((1, 2), NAN), np.ones((1, 2)), None, True)[0, 0])
    with pytest.raises(ValueError):
        update.missingness(df.limit(0), 3)
    b = book({(0, 0): [0, 0, 0], (1, 0): [1, 1, 1]})
    got = {r.row_id: r for r in assign(rows(spark, [[NAN, NAN, NAN], [NAN, 1, 1]]), b).collect()}
    assert got[0].neuron_id == 0 and np.isinf(got[0].distance) and got[1].neuron_id == 1


def test_kernel_and_builtin_functions_agree(spark):
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(40, 5)), rng.normal(size=(7, 5))
    x[rng.random(x.shape) < 0.3] = NAN
    b = Codebook.of([(k, 0) for k in range(7)], w)
    weights = np.array([1, 0.5, 0, 0.2, 1])
    for v in (None, weights):
        one = {r.row_id: (r.neuron_id, r.distance) for r in assign(rows(spark, x), b, dim_weights=v, nan=True).collect()}
        col = None if v is None else F.array(*[F.lit(float(t)) for t in v])
        two = {r.row_id: (r.neuron_id, r.distance) for r in assign_sql(rows(spark, x), b.dataframe(spark), weights=col, nan=True).collect()}
        for k in one:
            assert one[k][0] == two[k][0] and one[k][1] == pytest.approx(two[k][1])


def test_null_features_and_kept_columns(spark):
    df = spark.createDataFrame([(1, [2.0]), (2, None), (3, [None]), (4, [NAN])], "row_id int, features array<double>")
    b = book({(0, 0): [0], (1, 0): [2]})
    got = {r.row_id: (r.neuron_id, r.distance) for r in assign(df, b, keep=["row_id"]).collect()}
    assert got == {1: (1, 0), 2: (0, float("inf")), 3: (0, float("inf")), 4: (0, float("inf"))}
    assert assign(df.filter("row_id = 1"), b, keep=[]).columns == ["neuron_id", "x", "y", "distance"]
    sums, counts = update.bmu_sums(df, b, nan=True)
    assert counts.tolist() == [[0], [1]] and sums.tolist() == [[0], [2]]


def test_imputation():
    b = book({(0, 0): [10, 20, 30], (1, 0): [0, 0, 0], (2, 0): [12, 22, 32]})
    update.impute(b, 1, np.array([0.0, 1, 100]))
    assert b.weights[1].tolist() == [11, 21, 0]
    for far, want in ((2, 42), (3, 7)):
        b = book({(0, 0): [7], (far, 0): [42]})
        update.impute(b, 0, np.array([0.0]))
        assert b.weights[0, 0] == want
    b = book({(0, 0): [99]})
    update.impute(b, 0, np.array([0.0]))
    assert b.weights[0, 0] == 99


def test_batch_update_is_the_weighted_mean_of_all_rows(spark):
    rng = np.random.default_rng(1)
    x, b = rng.normal(size=(30, 3)), Codebook.of([(0, 0), (1, 0), (0, 1), (2, 2)], rng.normal(size=(4, 3)))
    w0 = b.weights.copy()
    update.update(rows(spark, x), b, 0.9)
    best = distances2(x, w0).argmin(1)
    h = update.neighborhood(b.xy, 0.9)[:, best]
    assert np.allclose(b.weights, (h @ x) / h.sum(1, keepdims=True))


def test_errors_are_distances_to_new_weights(spark):
    old = book({(0, 0): [0], (1, 0): [10]})
    new = book({(0, 0): [1], (1, 0): [10]})
    update.accumulate_errors(rows(spark, [[0], [2], [9], [NAN]]), old, new, nan=True)
    assert new.errors.tolist() == [2, 1] and new.hits.tolist() == [2, 1]


def test_distribution_of_errors():
    from growmap.functions import grid

    cells = {(0, 0): [0.0]} | {p: [1.0] for p in grid.neighbors(0, 0)}
    b = book(cells)
    b.errors[0] = 12
    growth.distribute_errors(b, 12)
    assert b.errors.tolist() == [6] + [1] * 6
    growth.distribute_errors(b, 12)
    assert b.errors.tolist() == [6] + [1] * 6


def test_growth_by_number_of_neighbours():
    rng = np.random.default_rng(0)
    alone = book({(0, 0): [1.0]})
    alone.errors[0] = 5
    grown = growth.grow(alone, 1, 10, rng)
    assert grown.xy.tolist() == [[0, 0], [1, 0]] and abs(grown.weights[1, 0] - 1) < 0.1 and grown.errors[0] == 0
    pair = book({(0, 0): [1.0], (1, 0): [3.0]})
    pair.errors[:] = [5, 0]
    grown = growth.grow(pair, 1, 10, rng)
    assert grown.xy[2].tolist() == [-1, -1] and grown.weights[2, 0] == -1
    row = book({(0, 0): [1.0], (1, 0): [3.0], (1, 1): [7.0]})
    row.errors[:] = [5, 0, 0]
    grown = growth.grow(row, 1, 10, rng)
    assert grown.weights[3, 0] == 4 and grown.xy[3].tolist() == [0, 1]
    assert len(growth.grow(row, 1, 3, rng)) == 3


def test_prune_keeps_a_minimum():
    b = book({(k, 0): [k] for k in range(6)})
    b.hits = np.array([0, 1, 0, 0, 0, 2])
    assert len(growth.prune(b)) == 4
    assert growth.prune(b, min_neurons=1).xy[:, 0].tolist() == [1, 5]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(7)
    return np.concatenate([rng.normal(c, 0.3, size=(60, 2)) for c in ((0, 0), (6, 0), (0, 6))])


def test_fit_and_score(spark, blobs):
    df = rows(spark, blobs)
    model = GrowingMap(max_neurons=20, n_iter=12, error_factor=0.5, seed=1).fit(df)
    assert 4 <= model.n_neurons <= 20 and np.isfinite(model.book.weights).all() and model.missing is None
    again = GrowingMap(max_neurons=20, n_iter=12, error_factor=0.5, seed=1).fit(df)
    assert np.allclose(again.book.weights, model.book.weights)
    spread = GrowingMap(max_neurons=20, n_iter=12, error_factor=0.5, seed=1, local_cells=0).fit(df)
    assert spread.positions == model.positions and np.allclose(spread.book.weights, model.book.weights)
    qe, te = model.quality(df)
    assert qe < 1.5 and 0 <= te <= 1
    assert model.hit_counts(df).agg(F.sum("hits")).first()[0] == 180
    assert model.cluster_n(df, 2).count() == model.n_neurons
    labels, got = model.cluster_two_level(n_clusters=3)
    scored = df.withColumn("label", F.floor(F.col("row_id") / 60))
    assert model.evaluate(scored, labels, "label")["purity"] > 0.9
    assert got.k == 3 and "neurons" in model.summary()
    assert model.geodesic(model.positions[0], (99, 99)) == -1


def test_fit_with_missing_values(spark, blobs):
    x = blobs.copy()
    x[::7, 0] = NAN
    x[::11, 1] = NAN
    df = rows(spark, x)
    model = GrowingMap(max_neurons=12, n_iter=8, seed=2).fit(df)
    assert np.isfinite(model.book.weights).all() and model.missing.rates.max() < 0.2
    spread = GrowingMap(max_neurons=12, n_iter=8, seed=2, local_cells=0).fit(df)
    assert spread.positions == model.positions and np.allclose(spread.book.weights, model.book.weights)
    both = model.predict(df)
    assert both.count() == len(x) and both.filter("distance is null").count() == 0


def test_parameters_are_checked():
    for bad in ({"spread": 0.0}, {"spread": 1.5}, {"error_factor": -1.0}, {"init_size": (0, 2)}):
        with pytest.raises(ValueError):
            GrowingMap(**bad)
    with pytest.raises(ValueError):
        GrowingMap().summary()


def test_ascii(spark):
    b = book({(0, 0): [0], (1, 0): [1], (1, 1): [2]})
    assert maps.grid_ascii(b) == "● ●\n · ●"
    assert maps.grid_ascii(b, {0: 3, 1: 12}) == "3 +\n · 0"
    assert len(maps.umatrix_ascii(b, {0: 0.0, 1: 1.0, 2: 2.0}).splitlines()) == 2


def test_stream_scoring(spark, blobs, tmp_path):
    from growmap.streaming.scoring import drift, score

    model = GrowingMap(max_neurons=8, n_iter=4, seed=1).fit(rows(spark, blobs))
    df = rows(spark, blobs).withColumn("ts", F.timestamp_seconds(F.col("row_id") * 3600))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = drift(score(stream, model), "ts").writeStream.format("memory").queryName("drift").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("drift").agg(F.sum("n")).first()[0] == len(blobs)


def test_has_nan_and_sigma(spark):
    assert vectors.has_nan(rows(spark, [[1, NAN]])) and not vectors.has_nan(rows(spark, [[1, 2]]))
    assert vectors.sigma_range(2) == (1.0, 0.5) and vectors.decay_sigma(1, 1, 3, 1) == 3
    assert [vectors.decay_sigma(e, 3, 3, 1) for e in (1, 2, 3)] == [3, 2, 1]
