"""Benchmark of the three strategies at one scale factor.

Runs, on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` (default sf0.1), the
reference harness's configuration on the lineitem points: per-feature min/max,
a grid of 10 splits per axis over the measured bounds, 32 equi-depth groups,
one model per group (100 steps), 32 random parts (100 steps each, one vote per
row), and the single model (10 steps); threshold 0.499999. Every phase is
timed separately; prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from quilt.operators import stats  # noqa: E402
from quilt.operators.metrics import class_summary  # noqa: E402
from quilt.plans.ensembles import Config, Workbench  # noqa: E402
from quilt.session import build_session  # noqa: E402
from quilt.sources.points import points  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", app="quilt-bench")
    feats = ["x0", "x1", "x2", "x3"]
    times: dict[str, float] = {}

    def timed(name, fn):
        t = time.time()
        out = fn()
        times[name] = round(time.time() - t, 3)
        return out

    pts = points(spark, sf_dir, "points_li")
    n_rows = timed("count_points", lambda: pts.count())
    mm = timed("feature_min_max", lambda: stats.feature_min_max(pts, feats).collect())
    grid = stats.grid_from_min_max(mm, feats, [10, 10, 10, 10])
    cfg = Config(grid=grid, n_groups=32, n_parts=32, iter_global=10, iter_ensemble=100, partitions=int(cpus))
    wb = Workbench(spark, sf_dir, cfg)

    timed("bin_histogram", lambda: wb.counts().count())
    g = timed("equi_depth_groups", wb.grouping)
    timed("assign_bin_group", lambda: wb.routed().agg(F.count(F.lit(1))).collect())
    timed("train_per_group", wb.models_group)
    timed("predict_routed_metrics", lambda: class_summary(wb.scored_routed()).collect())
    timed("train_per_part", wb.models_part)
    timed("predict_vote_metrics", lambda: class_summary(wb.scored_vote()).collect())
    timed("train_global", wb.models_global)
    timed("predict_global_metrics", lambda: class_summary(wb.scored_global()).collect())
    timed("strategy_report", lambda: wb.report().collect())

    total = round(sum(times.values()), 3)

    def median_step(m):
        h = sorted(m.history)
        return round(h[len(h) // 2], 3) if h else None

    print(
        json.dumps(
            {
                "metric": "total_sec",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "rows": n_rows,
                "groups": g.n_groups,
                "cpus": int(cpus),
                "train_step_median_sec": {
                    "per_group": median_step(wb.models_group()),
                    "per_part": median_step(wb.models_part()),
                    "global": median_step(wb.models_global()),
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
