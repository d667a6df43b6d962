import hashlib

import pytest
from compare import compare, duck
from conftest import SF001
from pyspark.sql import functions as F

from quilt.llm import chunk_dedup as C
from quilt.llm.queries import QUERIES, SQL

LONG = "Word " * 9000 + "x" * 5000

ROWS = [
    (1, "Hello\nWorld"), (2, "hello\nworld"), (3, "hello world"), (4, None), (5, ""), (6, "\n"), (7, "É a"), (8, "é a"),
    (9, LONG), (10, LONG.upper()), (11, LONG + "y"), (12, "hello\nworld\n"), (2, "HELLO\nWORLD"), (None, "n"), (None, "N"),
    (13, "ab"), (14, "a\nb"), (15, "İ"), (16, "i̇"),
]


def norm(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def check(rows, got):
    groups = {}
    for x, t in rows:
        groups.setdefault(norm(t), []).append(x)
    want = []
    for x, t in rows:
        ids = groups[norm(t)]
        known = [i for i in ids if i is not None]
        want.append((x, max(known) if known else None, len(ids), hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == sorted(want, key=repr)
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


@pytest.mark.parametrize("weak", [False, True])
def test_odd_rows(spark, weak):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumn("_recipe", F.lit(1)).withColumn("kept", F.lit(2))
    fn = (lambda c: F.pmod(F.xxhash64(c), F.lit(3))) if weak else F.xxhash64
    check(ROWS, C.exact_dedup(df.repartition(3), chunk_hash=fn).collect())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert C.exact_dedup(df).count() == 0


def test_chunks_put_together_are_the_text(spark):
    df = spark.createDataFrame([(t,) for _, t in ROWS if t is not None], "text string")
    rows = df.select("text", F.array_join(C.chunks(F.col("text")), "").alias("again"), C.chunks(F.col("text")).alias("c")).collect()
    assert all(r["again"] == r["text"] + "\n" for r in rows)
    assert max(len(x) for r in rows for x in r["c"]) <= C.LONG_LINE


def test_documents_equal_sql_and_plan_has_no_python(spark):
    assert compare(spark, duck(SF001), "op9", QUERIES["op9_chunk_recipes"], SQL["op9_chunk_recipes"], SF001)[1] == "ok"
    plan = QUERIES["op9_chunk_recipes"](spark, SF001)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
