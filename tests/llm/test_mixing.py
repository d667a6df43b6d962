import math

import numpy as np
import pytest
from conftest import SF001
from pyspark.sql import functions as F

from quilt.llm import mixing as M


def brute_rake(cells, targets, sweeps=60):
    """cells: {(s, l, t): tokens} -> weights."""
    w = {k: v / sum(cells.values()) for k, v in cells.items()}
    for _ in range(sweeps):
        for d in range(3):
            margin = {}
            for k, v in w.items():
                margin[k[d]] = margin.get(k[d], 0) + v
            w = {k: v * targets[d][k[d]] / margin[k[d]] if margin[k[d]] else 0.0 for k, v in w.items()}
    return w


def brute_probability(cells, w, budget):
    """Scale so that expected tokens meet the budget, none above 1."""
    whole = set()
    while True:
        rest = [k for k in cells if k not in whole and w[k] > 0]
        left = budget * sum(cells.values()) - sum(cells[k] for k in whole)
        scale = max(0.0, left / math.fsum(w[k] for k in rest)) if rest else 0.0
        more = {k for k in rest if scale * w[k] >= cells[k]}
        if not more:
            return {k: 1.0 if k in whole else scale * w[k] / cells[k] for k in cells}
        whole |= more


def tempered(cells, exponent):
    out = []
    for d in range(3):
        m = {}
        for k, v in cells.items():
            m[k[d]] = m.get(k[d], 0) + v
        raised = {k: v**exponent for k, v in m.items()}
        out.append({k: v / sum(raised.values()) for k, v in raised.items()})
    return out


def check(rows, budget, exponent):
    cells = {}
    for r in rows:
        k = (r["source"], r["lang"], r["topic"])
        cells[k] = cells.get(k, 0) + r["n_tokens"]
    want = brute_probability(cells, brute_rake(cells, tempered(cells, exponent)), budget)
    for r in rows:
        assert r["probability"] == pytest.approx(want[(r["source"], r["lang"], r["topic"])], abs=2e-4)


@pytest.mark.parametrize(("budget", "exponent"), [(0.8, 0.5), (0.3, 0.0), (1.0, 1.0)])
def test_documents_against_plain_raking(spark, budget, exponent):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = M.mix_to_targets(docs, budget=budget, exponent=exponent).collect()
    assert len(rows) == docs.count()
    check(rows, budget, exponent)


def test_hot_source_nulls_and_repeats(spark):
    rng = np.random.default_rng(2)
    rows = [
        (int(i % 900) if i % 11 else None, "w " * int(rng.integers(1, 60)) if i % 13 else None, None if i % 3 == 0 else f"s{i % 7}", "en" if i % 4 else None)
        for i in range(1500)
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").withColumn("_cell", F.lit(1)).withColumn("weight", F.lit("x"))
    got = M.mix_to_targets(df, budget=0.5).collect()
    assert len(got) == 1500
    check(got, 0.5, 0.5)
    kept = sum(r["n_tokens"] for r in got if r["kept"]) / sum(r["n_tokens"] for r in got)
    assert abs(kept - 0.5) < 0.08
    sample = M.sample_mix(df, budget=0.5)
    assert sample.columns == df.columns and sample.count() == sum(r["kept"] for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault((r["doc_id"], r["probability"]), set()).add(r["kept"])
    assert all(len(v) == 1 for v in by_id.values())


def test_given_shares(spark):
    rows = [(i, "a b c", "x" if i % 4 else "y", "en") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    got = M.mix_to_targets(df, budget=0.4, shares={"source": {"x": 1, "y": 1}}).collect()
    share = {s: sum(r["kept"] for r in got if r["source"] == s) for s in "xy"}
    assert abs(share["x"] - share["y"]) < 0.15 * share["x"]
    none = M.mix_to_targets(df, budget=0.4, shares={"source": {"y": 1}}).collect()
    assert not any(r["kept"] for r in none if r["source"] == "x") and all(r["kept"] for r in none if r["source"] == "y")


def test_draw_is_even(spark):
    u = [r[0] for r in spark.range(20000).select(M.draw("id", 3)).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.01


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string, lang string")
    assert M.mix_to_targets(df).count() == 0 and M.sample_mix(df).count() == 0


def test_the_draw_sends_texts_alone(spark):
    """A document goes to Python once, as its text, and does not come back."""
    from quilt.llm import topics
    from quilt.llm.tokens import public_path

    rows = [(i, ["red apple pie", "blue sea wave", None, ""][i % 4], f"s{i % 2}", "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    path = public_path("word_bpe_49k.json")
    kept = M.sample_mix(df, tokenizer=path)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan
    decided = {r["doc_id"] for r in M.mix_to_targets(df, tokenizer=path).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == decided
    assert "text" not in M.describe(df, path, None, None, "text").columns
    learnt = topics.fit_topics(df, 2)
    got = df.coalesce(1).select("doc_id", M.topic_of(F.col("text"), learnt).alias("topic")).orderBy("doc_id")
    assert [r["topic"] for r in got.collect()] == learnt.of([r[1] for r in rows])


def test_encoders_are_let_go():
    from quilt.llm import tokens

    tokens.encoder(tokens.public_path("word_bpe_49k.json"))
    tokens.forget()
    assert not tokens._ENCODERS
