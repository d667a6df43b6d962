import zlib

import pytest
from conftest import SF001
from pyspark.sql import functions as F

from quilt.llm.hilbert import hilbert_index, hilbert_shards
from quilt.llm.queries import QUERIES


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_in_unit_steps(spark, n, bits):
    side = 1 << bits
    df = spark.range(side**n).select(*[
        (F.floor(F.col("id") / side**k) % side).cast("int").alias(f"c{k}") for k in range(n)
    ])
    cols = [f"c{k}" for k in range(n)]
    rows = df.select(*cols, hilbert_index([F.col(c) for c in cols], bits).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(side**n))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(a[c] - b[c]) for c in cols) == 1


def check_law(got, n, shards):
    sizes = {}
    for r in got:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == n and all(0 <= s < shards for s in sizes)
    assert all(sorted(v) == list(range(len(v))) for v in sizes.values())
    counts = [len(sizes.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    cells = [(r["shard"], r["slot"], r["cell"]) for r in got]
    assert [c for *_, c in sorted(cells)] == sorted(c for *_, c in cells)


@pytest.mark.parametrize(("rows", "shards"), [(0, 4), (3, 7), (100, 7), (101, 1)])
def test_even_shards_with_a_hot_cell_nulls_and_repeats(spark, rows, shards):
    data = [(i % 50 if i % 9 else None, "hot" if i % 3 else None, i % 4, "t") for i in range(rows)]
    df = spark.createDataFrame(data, "doc_id bigint, source string, kind int, _rank string").withColumn("cell", F.lit("x"))
    got = hilbert_shards(df, ["source", "kind"], shards, "doc_id", ties=["_rank"], carry=["_rank"]).collect()
    check_law(got, rows, shards)


def test_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    df = QUERIES["op4_hilbert_shards"](spark, SF001)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = df.collect()
    check_law(got, len(docs), 40)
    for r in got:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)


def test_rejects_what_it_cannot_do(spark):
    df = spark.range(3).withColumn("a", F.lit(1))
    with pytest.raises(ValueError):
        hilbert_shards(df, ["a"], 2, "id", ties=[])
