import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SF001
from pyspark.sql import functions as F

from quilt.llm import permutation_index as P


def exact(rows, queries, k):
    """{query: [(id, score)]} over valid rows."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if queries(q):
            found = sorted(((-float(y @ x), i) for i, y in good if i != q))[:k]
            out.setdefault(q, []).append([(i, -s) for s, i in found])
    return out


def test_recall_and_exact_scores(spark):
    df = spark.read.parquet(f"{SF001}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = {}
    for r in P.permutation_search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = exact(rows, lambda q: q % 20 == 0, 20)
    assert got.keys() == want.keys()
    vectors = dict(rows)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 21))
        order = [(-x[2], x[1]) for x in found]
        assert order == sorted(order)
        for _, i, s in found:
            assert math.isclose(s, float(np.dot(np.array(vectors[i], float), np.array(vectors[q], float))), abs_tol=1e-12)
        hits += len({x[1] for x in found} & {i for i, _ in want[q][0]})
    assert hits / (20 * len(want)) >= 0.9


def test_recall_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "VECTOR_BLOCK", 500)
    monkeypatch.setattr(P, "QUERY_BLOCK", 30)  # two copies of each block
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(3000, 16)))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = exact(rows, lambda q: q % 50 == 0, 20)
    hits = 0
    for r in P.permutation_search(df, F.col("vec_id") % 50 == 0, share=0.2, least=60).collect():
        hits += r["vec_id"] in {i for i, _ in want[r["query_id"]][0]}
    assert hits / (20 * len(want)) >= 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]),
        (6, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [-1.0, 0.5]), (None, [1.0, 1.0]), (9, [0.5, 0.0]), (9, [0.5, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("_v", F.lit(1)).withColumn("score", F.lit("s"))
    got = {}
    for r in P.permutation_search(df, F.col("vec_id") % 20 == 0, k=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {k: sorted(v) for k, v in got.items()} == {0: [(1, 6, 1.0), (2, 7, 1.0), (3, 9, 0.5), (4, 9, 0.5)]}


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    assert P.permutation_search(df, F.lit(True)).count() == 0
    one = spark.createDataFrame([(20, [1.0])], "vec_id bigint, embedding array<double>")
    assert P.permutation_search(one, F.lit(True)).count() == 0


@pytest.mark.parametrize("sigma", [0.0, 0.25, 0.5])
def test_recall_on_full_blocks_of_varying_norms(spark, tmp_path, sigma):
    """The production parameters and block size; the largest inner product."""
    rng = np.random.default_rng(4)
    n = 2 * P.VECTOR_BLOCK + 4000  # three blocks, none so small that ``least`` decides
    x = rng.normal(size=(n, 64))
    x *= np.exp(sigma * rng.normal(size=(n, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    table = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float64()))})
    pq.write_table(table, tmp_path / "v.parquet")
    asked = np.arange(0, n, 400)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    want = {int(q): set(np.argsort(-s)[:20].tolist()) for q, s in zip(asked, scores)}
    got = P.permutation_search(spark.read.parquet(str(tmp_path / "v.parquet")), F.col("vec_id") % 400 == 0).collect()
    hits = sum(r["vec_id"] in want[r["query_id"]] for r in got)
    assert hits >= 0.9 * 20 * len(want), hits / (20 * len(want))


def test_repeated_query_ids_have_answers_of_their_own(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(60, 8)))]
    rows.append((20, [float(v) for v in rng.normal(size=8)]))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = {}
    for r in P.permutation_search(df, F.col("vec_id") % 20 == 0, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = np.array([v for _, v in rows])

    def nearest(at):
        found = sorted((-float(y @ x[at]), rows[j][0]) for j, y in enumerate(x) if j != at)[:5]
        return [(k, i, -s) for k, (s, i) in enumerate(found, 1)]

    for q, ats in {0: [0], 20: [20, 60], 40: [40]}.items():
        want = sorted(r for at in ats for r in nearest(at))
        assert [(a, b) for a, b, _ in sorted(got[q])] == [(a, b) for a, b, _ in want]
        assert np.allclose([c for *_, c in sorted(got[q])], [c for *_, c in want], atol=1e-12)


def test_the_footrule_orders_candidates():
    """The candidates of a block are those at the least footrule distance."""
    rng = np.random.default_rng(2)
    n, pivots, length = 300, 20, 7
    perms = np.argsort(rng.random((n, pivots)), axis=1)
    block = P.Block(np.arange(n), np.arange(n), rng.normal(size=(n, 3)), perms[:, :length].astype(np.int16), pivots)
    own = np.argsort(rng.random(pivots))[:length].astype(np.int16)

    def rank(prefix):
        return [list(prefix).index(p) if p in prefix else length for p in range(pivots)]

    mine = np.array(rank(own))
    distance = [np.abs(np.array(rank(p[:length])) - mine).sum() for p in perms]
    want = set(sorted(range(n), key=lambda i: (distance[i], i))[:40])
    rows, _ = block.search(-1, np.ones(3), own, 40, 0.0, 40)
    assert set(rows.tolist()) == want
