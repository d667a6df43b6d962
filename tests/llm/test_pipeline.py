import re

import pytest
from conftest import SF001, SF01
from pyspark.sql import functions as F

import corpus_pipeline as P
from quilt.llm.common import shared_folder


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        path = shared_folder(spark, "step")
        stage(spark, out[-1], SF01).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def test_stages_return_the_columns_of_documents(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:-1])
    for a, b in zip(steps, steps[1:]):
        assert ids(b) <= ids(a)
    # rows are those of documents, unchanged
    assert steps[4].exceptAll(steps[0]).count() == 0


def test_toxic_documents_go(spark, steps):
    from quilt.llm import toxicity as T

    scored = T.score(steps[0], T.fit(steps[0], spark.read.parquet(f"{SF01}/labels.parquet"), T.fold() != 0))
    assert ids(steps[1]) == ids(scored.where("predicted = 0"))


def test_one_of_equal_texts_stays(steps):
    best = {}
    for x, t in steps[1].select("doc_id", "text").collect():
        n = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        best[n] = max(best.get(n, x), x)
    assert ids(steps[2]) == set(best.values())


def test_one_of_each_near_group_stays(steps):
    from test_ngram_join import brute

    rows = [tuple(r) for r in steps[2].select("doc_id", "text").collect()]
    assert ids(steps[3]) == {x for x, _, c in brute(rows, 5, 80, 100) if x == c}


def test_mixing_and_packing(steps):
    from quilt.llm.mixing import mix_to_targets

    assert ids(steps[4]) == ids(mix_to_targets(steps[3], tokenizer=P.public_path(P.TOKENIZER)).where("kept"))
    total = steps[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("m"))
    assert ids(steps[5]) == ids(steps[4]) and total.where("n != m").count() == 0


def test_run_equals_the_stages(spark, steps):
    got = P.run(spark, SF01)
    assert got.columns == steps[5].columns and got.count() == steps[5].count()


def test_odd_rows_through_all_stages(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [
        (1, None, "en", None, None), (2, "", None, "s", 0), (3, text, "en", "s", 1), (3, text, "en", "s", 1), (4, text.upper(), "en", "s", 1),
        (5, text + " more", "en", "s", 1), (None, "unique words here", "en", "s", 1), (None, "Unique words here", "en", "s", 1), (7, "x " * 50000, "de", "t", 2),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("_key", F.lit(1))
    path = shared_folder(spark, "odd")
    docs.write.parquet(path)
    docs = spark.read.parquet(path)
    exact = P.drop_exact(spark, docs, SF001)
    assert exact.columns == docs.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in exact.collect()) == [(False, 0), (True, 2), (True, 4), (True, 5), (True, 7)]
    near = P.drop_near(spark, exact, SF001)
    assert sorted(r["doc_id"] or 0 for r in near.collect()) == [0, 2, 4, 7]
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF001).count() > 0
        assert stage(spark, docs.where("false"), SF001).count() == 0


def test_oracle_is_declared():
    assert P.ORACLE_SQL is None and [n for n, _ in P.STAGES] and re.fullmatch(r"[a-z -]+", P.STAGES[0][0])


def test_near_copies_with_repeated_ids(spark):
    text, other, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [
        (1, text), (2, text + " more"), (2, "a clean text of its own that has the id of a copy"),
        (5, other), (5, other + " more"), (None, third), (None, third + " more"), (None, text + " less"), (None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(((r["doc_id"], (r["text"] or "")[:2]) for r in P.drop_near(spark, docs, SF001).collect()), key=repr)
    assert got == sorted([(1, "x0"), (2, "a "), (5, "y0"), (None, "z0"), (None, "")], key=repr)
