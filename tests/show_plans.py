"""Write PLANS.md: the physical plans (operator trees) of headline queries.

Usage: python tests/show_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEYS = {
    "bin_histogram": "points -> cells: partial count per task, one shuffle of cell rows",
    "assign_bin_group": "routing every point: broadcast lookups pipelined in one stage, no shuffle",
    "predict_routed": "routed scoring: routing plus a broadcast model table, no shuffle",
    "predict_vote": "vote of all models inside one projection; the round-robin exchange is the small-input "
    "spread (one row group locally), absent when the input has at least one partition per core",
    "auc_class": "exact AUC: per-score counts, cumulative window over the score levels only",
    "feature_min_max_array": "min/max over a 64-wide array: posexplode + partial aggregate",
}


def tree(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    keep = []
    for line in text.splitlines():
        cut = line.find("[")
        keep.append((line[:cut] if cut > 0 else line).rstrip())
    return "\n".join(keep)


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from quilt.operators.train import gradient_sql_dense
    from quilt.session import build_session

    import __spark_entry__ as E

    spark = build_session()
    out = ["# PLANS", "", f"Physical plans at {os.path.basename(sf)} (AQE initial plans, operator names only),",
           "generated by `python tests/show_plans.py`.", ""]
    q = E.queries()
    from quilt.operators.histogram import bin_histogram
    from quilt.plans.ensembles import Config
    from quilt.sources.points import points

    for key, why in KEYS.items():
        # the registered histogram reads its checkpoint; show the operator's own plan
        df = bin_histogram(points(spark, sf, "points_li"), Config().grid) if key == "bin_histogram" else q[key](spark, sf)
        out += [f"## {key}", "", why, "", "```", tree(df), "```", ""]
    df = spark.createDataFrame([(0, 0, 1.0, 0.5), (0, 1, 0.0, 1.5)], "family int, model_id bigint, label double, x0 double")
    df.createOrReplaceTempView("train_rows")
    step = spark.sql(gradient_sql_dense("train_rows", 1, {(0, 0): [0.1], (0, 1): [0.2]}, {0: 0}, 2))
    out += ["## one training step (all models)", "",
            "gradient sums of every model in one aggregate; weights are literal arrays", "",
            "```", tree(step), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main(sys.argv)
