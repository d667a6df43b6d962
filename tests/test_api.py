from dataclasses import replace

from conftest import SF001
from quilt import HistogramEnsemble, RandomEnsemble, SingleModel, evaluate
from quilt.plans.ensembles import Config, Workbench


def test_api_matches_workbench(spark):
    cfg = replace(Config(), iter_ensemble=6, iter_global=4)
    wb = Workbench(spark, SF001, cfg)
    pts = wb.points()
    feats = list(cfg.features)
    h = HistogramEnsemble(cfg.grid, cfg.n_groups, cfg.threshold, cfg.iter_ensemble).fit(pts, feats)
    r = RandomEnsemble(cfg.n_parts, cfg.threshold, cfg.iter_ensemble, cfg.seed).fit(pts, feats)
    s = SingleModel(cfg.threshold, cfg.iter_global).fit(pts, feats)
    assert h.models.weights == wb.models_group().weights
    assert r.models.weights == wb.models_part().weights
    assert s.models.weights == wb.models_global().weights
    for mine, theirs in ((h.predict(pts), wb.scored_routed()), (r.predict(pts), wb.scored_vote()), (s.predict(pts), wb.scored_global())):
        assert evaluate(mine).first() == evaluate(theirs).first()


def test_null_policy_end_to_end(spark):
    from quilt import Grid

    rows = [(str(i), float(i % 2), float(i % 10) / 10.0, float((i * 7) % 10) / 10.0) for i in range(200)]
    rows += [("out", 1.0, 5.0, 0.5), ("nan", 0.0, float("nan"), 0.5)]
    df = spark.createDataFrame(rows, "key string, label double, x0 double, x1 double")
    grid = Grid.of(("x0", 0.0, 1.0, 4), ("x1", 0.0, 1.0, 4))
    h = HistogramEnsemble(grid, 4, iterations=3, policy="null").fit(df, ["x0", "x1"])
    assert h.counts.agg({"n": "sum"}).first()[0] == 200  # the two unroutable rows are not counted
    got = {r.key: r for r in h.predict(df).collect()}
    assert got["out"].group_id is None and got["out"].prediction is None
    assert got["nan"].group_id is None and got["nan"].prediction is None
    assert all(got[str(i)].prediction is not None for i in range(200))
