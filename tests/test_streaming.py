import tempfile

from conftest import SF001
from quilt.operators.metrics import class_summary
from quilt.plans.ensembles import Config, Workbench
from quilt.streaming.scoring import read_points_stream, running_summary, score_stream, start


def test_stream_scoring_matches_batch(spark):
    from dataclasses import replace

    wb = Workbench(spark, SF001, replace(Config(), iter_ensemble=5, iter_global=3))
    src = tempfile.mkdtemp(prefix="quilt-stream-src-", dir="/tmp")
    pts = wb.points()
    # the points arrive as several files
    for i in range(3):
        pts.where(f"pmod(hash(key), 3) = {i}").write.mode("append").parquet(src)
    schema = ", ".join(f"{c} {t}" for c, t in pts.dtypes)
    for kind, models, batch in (
        ("random", wb.models_part(), wb.scored_vote()),
        ("histogram", wb.models_group(), wb.scored_routed()),
    ):
        stream = read_points_stream(spark, src, schema, max_files=1)
        scored = score_stream(stream, models, kind, wb.cfg.threshold, wb.grouping(), wb.cfg.grid)
        q = start(running_summary(scored), f"sum_{kind}", "memory", checkpoint=tempfile.mkdtemp(prefix="quilt-ck-", dir="/tmp"), mode="complete")
        q.processAllAvailable()
        got = spark.sql(f"SELECT * FROM sum_{kind}").first()
        q.stop()
        want = class_summary(batch).first()
        assert (got.n, got.correct, got.auc) == (want.n, want.correct, want.auc)
