import tempfile

from conftest import SF001
from quilt.functions.grid import Grid
from quilt.plans.harness import run_text_flow
from quilt.sources.points import points
from quilt.sources.text import render_lines


def test_text_flows_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="quilt-text-", dir="/tmp")
    pts = points(spark, SF001, "points_li")
    lines = render_lines(pts, 4)
    header = spark.createDataFrame([("Id,a,b,c,d",)], "line string")
    header.unionByName(lines).write.mode("overwrite").text(f"{d}/train")
    lines.write.mode("overwrite").text(f"{d}/test")
    grid = Grid.of(("x0", 0.0, 51.0, 4), ("x1", 900.0, 105000.0, 4))
    for strategy in ("histogram", "random", "single"):
        summary, times = run_text_flow(
            spark, f"{d}/train", f"{d}/test", 4, strategy, grid=grid, n_pieces=4, iterations=3, fraction=None
        )
        r = summary.first()
        assert r.n == pts.count() and 0.0 <= r.accuracy_pct <= 100.0 and times["train_sec"] > 0


def test_empty_random_parts_get_no_model(spark):
    from quilt import RandomEnsemble

    df = spark.createDataFrame([(str(i), float(i % 2), float(i)) for i in range(6)], "key string, label double, x0 double")
    r = RandomEnsemble(n_parts=50, iterations=2).fit(df, ["x0"])
    assert 0 < len(r.models.weights) <= 6
    assert r.predict(df).where("prediction IS NULL").count() == 0
