import math

import numpy as np
import pytest

from quilt.operators.metrics import accuracy, auc
from quilt.operators.score import predict_global, predict_routed, predict_vote
from quilt.operators.train import Models, fit


def numpy_gd(x, y, iters, step=1.0):
    w = np.zeros(x.shape[1])
    for t in range(1, iters + 1):
        p = 1.0 / (1.0 + np.exp(-(x @ w)))
        g = ((p - y)[:, None] * x).sum(axis=0) / len(y)
        w = w - (step / math.sqrt(t)) * g
    return w


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(5)
    n = 400
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] - 0.5 * x[:, 2] + rng.normal(scale=0.5, size=n) > 0).astype(float)
    grp = rng.integers(0, 3, size=n)
    rows = [(str(i), float(y[i]), *map(float, x[i]), int(grp[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, label double, x0 double, x1 double, x2 double, g bigint")
    return df, x, y, grp


def test_single_model_matches_numpy(spark, toy):
    df, x, y, _ = toy
    m = fit(df, ["x0", "x1", "x2"], None, iterations=7)
    assert np.allclose(m.weights[0], numpy_gd(x, y, 7), rtol=1e-12, atol=1e-14)
    assert m.counts[0] == len(y)


def test_one_model_per_group_in_one_job_per_step(spark, toy):
    df, x, y, grp = toy
    m = fit(df, ["x0", "x1", "x2"], "g", iterations=5)
    assert m.ids == [0, 1, 2] and len(m.history) == 5
    for gid in range(3):
        sel = grp == gid
        assert np.allclose(m.weights[gid], numpy_gd(x[sel], y[sel], 5), rtol=1e-12, atol=1e-14)


def test_one_class_and_zero_features(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0, 0.0), ("b", 1.0, 0.0, 0.0)], "key string, label double, x0 double, x1 double")
    m = fit(df, ["x0", "x1"], None, iterations=3)
    assert m.weights[0] == [0.0, 0.0]
    p = predict_global(df, m, 0.5).collect()
    assert all(r.probability == 0.5 and r.prediction == 0.0 for r in p)  # 0.5 is not > 0.5


def test_routed_rows_without_model_get_null(spark):
    m = Models(["x0"], {0: [1.0]}, {0: 1}, 1)
    df = spark.createDataFrame([("a", 1.0, 2.0, 0), ("b", 0.0, 2.0, 5)], "key string, label double, x0 double, g bigint")
    out = {r.key: r for r in predict_routed(df, m, "g", 0.5).collect()}
    assert out["a"].prediction == 1.0 and out["b"].prediction is None and out["b"].probability is None


@pytest.mark.parametrize(
    "signs,expect",
    [([1, -1], 0.0), ([1, 1, -1], 1.0), ([-1, -1, 1], 0.0), ([-1, -1], 0.0), ([1, 1], 1.0), ([1, -1, 1, -1], 0.0)],
)
def test_vote_ties_go_to_zero(spark, signs, expect):
    m = Models(["x0"], {i: [float(s)] for i, s in enumerate(signs)}, {i: 1 for i in range(len(signs))}, 1)
    df = spark.createDataFrame([("a", 1.0, 3.0)], "key string, label double, x0 double")
    assert predict_vote(df, m, 0.5).first().prediction == expect


def brute_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y > 0]
    neg = [s for s, y in zip(scores, labels) if y <= 0]
    if not pos or not neg:
        return None
    win = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return win / (len(pos) * len(neg))


def test_auc_and_accuracy(spark):
    rng = np.random.default_rng(1)
    s = rng.integers(0, 20, size=300) / 19.0
    y = (rng.random(300) < s).astype(float)
    pred = (s > 0.5).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(s, y, pred)], "score double, label double, prediction double")
    got = auc(df, score="score").first()
    assert got.auc == pytest.approx(brute_auc(s, y), abs=1e-15)
    got_c = auc(df).first()
    assert got_c.auc == pytest.approx(brute_auc(pred, y), abs=1e-15)
    a = accuracy(df).first()
    assert a.n == 300 and a.accuracy_pct == pytest.approx(100.0 * float((pred == y).sum()) / 300)


def test_metrics_edge_cases(spark):
    empty = spark.createDataFrame([], "score double, label double, prediction double")
    assert accuracy(empty).first().accuracy_pct is None
    one = spark.createDataFrame([(0.3, 1.0, 1.0), (0.7, 1.0, 1.0)], "score double, label double, prediction double")
    assert auc(one, score="score").first().auc is None
    same = spark.createDataFrame([(0.5, 1.0, 1.0), (0.5, 0.0, 1.0)], "score double, label double, prediction double")
    assert auc(same, score="score").first().auc == 0.5


def test_class_summary_equals_separate_metrics(spark):
    from quilt.operators.metrics import class_summary

    rng = np.random.default_rng(9)
    y = (rng.random(500) < 0.3).astype(float)
    p = (rng.random(500) < 0.4).astype(float)
    rows = [(float(a), float(b)) for a, b in zip(y, p)] + [(1.0, None)]
    df = spark.createDataFrame(rows, "label double, prediction double")
    s = class_summary(df).first()
    a = accuracy(df).first()
    u = auc(df).first()
    assert (s.n, s.correct, s.accuracy_pct) == (a.n, a.correct, a.accuracy_pct)
    assert (s.positives, s.negatives, s.auc) == (u.positives, u.negatives, u.auc)


def test_a_long_vote(spark):
    ids = range(100)
    m = Models(["x0"], {i: [1.0 if i % 3 else -1.0] for i in ids}, dict.fromkeys(ids, 1), 1)
    r = predict_vote(spark.createDataFrame([("a", 2.0)], "key string, x0 double"), m, 0.5).first()
    assert (r.ones, r.prediction) == (66, 1.0)


NAN, INF = float("nan"), float("inf")


def test_rows_that_are_not_usable_do_not_train(spark):
    good = [("a", 1.0, 1.0, 0.5, 0), ("b", 0.0, -1.0, 0.25, 0), ("c", 1.0, 2.0, -0.5, 0), ("d", 0.0, -0.5, 1.0, 0)]
    bad = [(str(i), float(i % 2), *x, 0) for i, x in enumerate([(None, 1.0), (1.0, None), (NAN, 1.0), (1.0, NAN), (INF, 1.0), (1.0, -INF)] * 2)]
    schema = "key string, label double, x0 double, x1 double, g bigint"
    for how in (False, True):
        clean = fit(spark.createDataFrame(good, schema), ["x0", "x1"], "g", iterations=4, vectorized=how)
        mixed = fit(spark.createDataFrame(good + bad, schema), ["x0", "x1"], "g", iterations=4, vectorized=how)
        assert np.allclose(clean.weights[0], mixed.weights[0], rtol=1e-13) and mixed.counts == {0: 4}


def test_rows_that_are_not_usable_score_null_everywhere(spark):
    df = spark.createDataFrame(
        [("ok", 1.0, 0), ("null", None, 0), ("nan", NAN, 0), ("inf", INF, 0)], "key string, x0 double, g bigint"
    )
    one = Models(["x0"], {0: [1.0]}, {0: 1}, 1)
    three = Models(["x0"], {i: [1.0] for i in range(3)}, dict.fromkeys(range(3), 1), 1)
    for out in (predict_global(df, one), predict_routed(df, one, "g"), predict_vote(df, three)):
        got = {r.key: r.prediction for r in out.collect()}
        assert got == {"ok": 1.0, "null": None, "nan": None, "inf": None}


def test_without_models_every_scorer_gives_null(spark):
    none = Models(["x0"], {}, {}, 1)
    df = spark.createDataFrame([("a", 1.0, 0)], "key string, x0 double, g bigint")
    for out in (predict_global(df, none), predict_routed(df, none, "g"), predict_vote(df, none)):
        assert out.first().prediction is None


def test_auc_of_scores_that_lie_close(spark):
    s = [i * 1e-9 for i in range(100)]
    y = [float(i % 5 != 0 and i > 20) for i in range(100)]
    df = spark.createDataFrame(list(zip(s, y)), "score double, label double")
    assert auc(df, score="score").first().auc == pytest.approx(brute_auc(s, y), abs=1e-15)


def test_auc_by_group_over_many_partitions(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g) if g else None, float(a), float(a + rng.normal() > 0.5)) for g, a in zip(rng.integers(0, 3, 600), rng.random(600).round(2))]
    rows += [(1, float("nan"), 1.0), (1, None, 0.0)]
    df = spark.createDataFrame(rows, "g bigint, score double, label double").repartition(9)
    got = {r.g: r.auc for r in auc(df, score="score", by=["g"]).collect()}
    for g in (None, 1, 2):
        part = [(a, y) for k, a, y in rows if k == g and a is not None and a == a]
        assert got[g] == pytest.approx(brute_auc(*zip(*part)), abs=1e-14)


def test_labels_must_be_binary(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0), ("b", 0.0, 1.0)], "key string, label double, x0 double")
    with pytest.raises(ValueError):
        fit(df, ["x0"], None, iterations=2)


def test_generated_and_vectorized_steps_agree(spark, toy):
    df, x, y, grp = toy
    a, b = (fit(df, ["x0", "x1", "x2"], "g", iterations=5, vectorized=how, partitions=3) for how in (False, True))
    for m in a.ids:
        assert np.allclose(a.weights[m], b.weights[m], rtol=1e-12, atol=1e-14)
    assert a.counts == b.counts


def test_model_ids_with_gaps(spark, toy):
    df, x, y, grp = toy
    far = df.withColumn("g", df.g * 10**12 - 5)
    m = fit(far, ["x0", "x1", "x2"], "g", iterations=5)
    for i in range(3):
        assert np.allclose(m.weights[i * 10**12 - 5], numpy_gd(x[grp == i], y[grp == i], 5), rtol=1e-12, atol=1e-14)


def test_the_registered_models_predict_something(spark):
    """Both classes by every strategy, and probabilities that differ."""
    from conftest import SF01
    from quilt.plans.catalog import wb

    w = wb(spark, SF01)
    for scored in (w.scored_global(), w.scored_routed(), w.scored_vote()):
        assert {r[0] for r in scored.select("prediction").distinct().collect()} == {0.0, 1.0}
    assert w.scored_global().select("probability").distinct().count() > 1000
    n = w.points().count()
    assert w.train().count() + w.held_out().count() == n and w.held_out().count() > 0.2 * n


def test_no_rows_no_models(spark):
    df = spark.createDataFrame([], "key string, label double, x0 double, g bigint")
    m = fit(df, ["x0"], "g", iterations=3)
    assert m.weights == {} and m.counts == {}


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(11)
    n, k = 300, 64
    x = rng.normal(size=(n, k))
    y = (x[:, :5].sum(axis=1) > 0).astype(float)
    rows = [(str(i), float(y[i]), [float(v) for v in x[i]], int(i % 3)) for i in range(n)]
    rows += [("null", 1.0, None, 0), ("short", 1.0, [1.0] * 63, 0), ("nan", 0.0, [NAN] + [1.0] * 63, 1), ("hole", 0.0, [None] + [1.0] * 63, 1)]
    return spark.createDataFrame(rows, "key string, label double, x array<double>, g bigint"), x, y


def test_one_array_column_is_as_good_as_many_columns(spark, wide):
    df, x, y = wide
    names = [f"x{j}" for j in range(64)]
    m = fit(df, names, "g", iterations=4, array="x")
    assert m.counts == {0: 100, 1: 100, 2: 100}
    for i in range(3):
        assert np.allclose(m.weights[i], numpy_gd(x[np.arange(300) % 3 == i], y[np.arange(300) % 3 == i], 4), rtol=1e-11)
    one = fit(df, names, None, iterations=4, array="x")
    w = np.array([m.weights[i % 3] for i in range(300)])
    for out, want in (
        (predict_routed(df, m, "g"), 1 / (1 + np.exp(-(x * w).sum(axis=1)))),
        (predict_global(df, one), 1 / (1 + np.exp(-(x @ np.array(one.weights[0]))))),
    ):
        got = {r.key: (r.probability, r.prediction) for r in out.collect()}
        assert np.allclose([got[str(i)][0] for i in range(300)], want, rtol=1e-11)
        assert all(got[k] == (None, None) for k in ("null", "short", "nan", "hole"))
    plan = predict_routed(df, m, "g")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 5000  # as large for 64 features as for two


@pytest.mark.parametrize("block", [32 << 20, 50_000])
def test_a_vote_of_two_thousand_models(spark, wide, monkeypatch, block):
    from quilt.operators import score

    monkeypatch.setattr(score, "VOTE_BLOCK_BYTES", block)
    monkeypatch.setattr(score, "VOTE_CELLS", 10_000)
    df, x, _ = wide
    weights = np.random.default_rng(3).normal(size=(2000, 64))
    if block < 1 << 20:
        weights = weights[:500]  # six blocks of 97: three passes over the rows
    m = Models([f"x{j}" for j in range(64)], {7 * i: w.tolist() for i, w in enumerate(weights)}, {}, 1, array="x")
    got = {r.key: (r.ones, r.prediction) for r in predict_vote(df, m, 0.499999).collect()}
    want = (1 / (1 + np.exp(-(x @ weights.T))) > 0.499999).sum(axis=1)
    assert [got[str(i)] for i in range(300)] == [(int(v), float(2 * v > len(weights))) for v in want]
    assert got["nan"] == (None, None) and got["null"] == (None, None)


def test_votes_by_expression_and_by_matrix_agree(spark, toy):
    df, *_ = toy
    m = fit(df, ["x0", "x1", "x2"], "g", iterations=5)
    a, b = ({r.key: (r.ones, r.prediction) for r in predict_vote(df, m, 0.4, matrix=how).collect()} for how in (False, True))
    assert a == b


def test_the_least_margin_of_a_class():
    from quilt.operators.score import _margin_above

    for t in (0.5, 0.499999, 0.1, 0.999, 1e-9):
        m = _margin_above(t)
        assert 1 / (1 + np.exp(-m)) > t and not 1 / (1 + np.exp(-np.nextafter(m, -np.inf))) > t
    assert _margin_above(-1) == -np.inf and _margin_above(1.0) == np.inf


def test_several_summaries_equal_single_ones(spark):
    from quilt.operators.metrics import class_summaries, class_summary

    rows = [(float(i % 2), float(i % 3 == 0), None if i % 7 == 0 else float(i % 5 > 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "label double, p double, q double")
    both = {r["name"]: tuple(r)[1:] for r in class_summaries(df, {"a": "p", "b": "q"}).collect()}
    assert both == {"a": tuple(class_summary(df, "p").first()), "b": tuple(class_summary(df, "q").first())}
    empty = class_summaries(df.where("false"), {"a": "p"}).first()
    assert (empty["n"], empty["correct"], empty["auc"]) == (0, 0, None)
