import math
import random

import duckdb
import numpy as np
import pytest
from conftest import SF001, SF01
from pyspark.sql import functions as F

from quilt.llm import hard_negatives as H
from quilt.llm.queries import QUERIES, SQL

KINDS = "vec_id bigint, embedding array<double>, label int, uid string, page int, w int"


def brute(rows, positives=5, negatives=5, is_anchor=lambda i: i % 10 == 0):
    """[(anchor, positive, rank, negative, positive score, negative score)], by
    plain loops; rows that repeat an id are told apart by position."""
    good = []
    for i, v, lab, *_ in rows:
        if i is None or v is None or lab is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [math.floor(256 * x) for x in v], lab))
    out = []
    for at, (i, q, lab) in enumerate(good):
        if not is_anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(q, v)), j, k) for k, (j, v, _) in enumerate(good) if k != at]
        near = sorted(s for s in scored if good[s[2]][2] == lab)[:positives]
        far = sorted(s for s in scored if good[s[2]][2] != lab)
        for p, j, _ in near:
            inside = [s for s in far if 80 * -p <= 100 * -s[0] <= 100 * -p][:negatives]
            out += [(i, j, r, m, -p, -s) for r, (s, m, _) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], KINDS)
    return sorted(map(tuple, H.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label")).collect()))


@pytest.mark.parametrize("seed,n,width,labels", [(1, 700, 6, 3), (2, 400, 3, 2), (3, 900, 16, 7)])
def test_against_brute_force(spark, monkeypatch, seed, n, width, labels):
    """Many pages and leaves, ties (few values), several copies of each page."""
    monkeypatch.setattr(H, "PAGE_ROWS", 64)
    monkeypatch.setattr(H, "LEAF_ROWS", 8)
    monkeypatch.setattr(H, "ANCHOR_BLOCK", 20)
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(9, width))
    rows = [
        (i, [float(round(x, 1 if i % 2 else 3)) for x in centre[rng.integers(9)] + rng.normal(size=width) * 0.2], int(rng.integers(labels)))
        for i in range(n)
    ]
    assert mined(spark, rows) == brute(rows)


def test_copies_of_one_vector_spread_over_pages(spark, monkeypatch):
    monkeypatch.setattr(H, "PAGE_ROWS", 50)
    monkeypatch.setattr(H, "LEAF_ROWS", 8)
    rng = random.Random(4)
    rows = [(i, [0.5, 0.25, 0.125] if i % 3 == 0 else [rng.random() for _ in range(3)], i % 4) for i in range(600)]
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (0, [1.0, 2.0], 1), (1, [1.0, 1.5], 1), (2, [1.0, 1.4], 2), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 2),
        (6, [None, 1.0], 2), (7, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (2, [1.0, 1.4], 2), (10, [0.0, 0.0], 2),
        (10, [0.0, 0.0], 2), (20, [-1.0, -2.0], 1), (30, [0.5], 2), (31, [], 1), (40, [3.0, -1.0], 9),
    ]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(10, [1.0], 1)]) == []


def test_scores_beyond_the_doubles_whole_numbers(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 2.0**21 for _ in range(4)], i % 2) for i in range(60)]
    assert mined(spark, rows) == brute(rows)


def test_tiles_hold_every_row_once():
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(5000, 8)), 1)
    tree, n = H.fit_tiles(x[:1000], 40)
    tile = H.tile_of(x, tree)
    assert tile.min() >= 0 and tile.max() < n and 20 <= n <= 200
    assert np.bincount(tile).max() < 1000
    order = H.str_order(x, 64)
    assert sorted(order) == list(range(len(x)))


def test_boxes_hold_their_rows_and_prune():
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(20, 5)) * 400
    x = np.floor(np.repeat(centre, 100, axis=0) + rng.normal(size=(2000, 5)) * 8)
    page = H.Page.pack(np.arange(2000), np.arange(2000), np.arange(2000) % 3, x)
    opened = []
    plain = H.Page.scores
    q = x[17]
    page.scores = lambda rows, v: (opened.append(len(rows)), plain(page, rows, v))[1]
    (rows, scores), = page.search(q, 2, 17, True, [(H.LEAST, H.MOST)], 5)
    want = sorted(((-int(x[i] @ q), i) for i in range(2000) if i % 3 == 2 and i != 17))[:5]
    assert [(-int(s), int(page.ids[r])) for r, s in zip(rows, scores)] == want
    assert sum(opened) < 400  # clustered rows: most boxes stay shut


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.execute(SQL["op11_hard_negatives"]).fetchall())
    got = sorted(map(tuple, QUERIES["op11_hard_negatives"](spark, sf).collect()))
    assert got and got == want
