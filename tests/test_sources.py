import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from quilt.operators import stats
from quilt.operators.partition import assign_random_part, random_part_sizes, sample_hash
from quilt.sources.points import VIEWS, points
from quilt.sources.text import drop_marker_lines, parse_points, read_lines


def test_text_file_marker_and_parse(spark):
    d = tempfile.mkdtemp(prefix="quilt-lines-", dir="/tmp")
    path = os.path.join(d, "points.csv")
    with open(path, "w") as f:
        f.write("Id,a,b\n1,0.5,2\n0, 1.5 ,3,,\n1,NaN,Infinity\nId-like 1,2,3\n")
    lines = drop_marker_lines(read_lines(spark, path), "Id")
    assert lines.count() == 3
    rows = parse_points(lines, 2).collect()
    assert [(r.label, r.x0) for r in rows][:2] == [(1.0, 0.5), (0.0, 1.5)]
    assert rows[2].x1 == float("inf") and rows[2].x0 != rows[2].x0
    assert drop_marker_lines(read_lines(spark, path), None).count() == 5


def test_parse_strict_and_permissive(spark):
    df = spark.createDataFrame([("1,2,x",), ("0,,3",), ("1,2,3",)], "line string")
    perm = parse_points(df, 2, mode="permissive").collect()
    assert [r.bad for r in perm] == [True, True, False]
    with pytest.raises(Exception):
        parse_points(df, 2, mode="strict").collect()


def test_views_have_the_contract(spark):
    for v in VIEWS:
        df = points(spark, SF001, v)
        assert df.columns[:2] == ["key", "label"]
        assert df.count() == df.select("key").distinct().count()
        assert {r.label for r in df.select("label").distinct().collect()} <= {0.0, 1.0}


def test_min_max_skips_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (-2.0,)], "x0 double")
    r = stats.feature_min_max(df, ["x0"]).first()
    assert (r.min_value, r.max_value) == (-2.0, 1.0)
    e = stats.feature_min_max(df.where("false"), ["x0"]).first()
    assert (e.min_value, e.max_value) == (float("inf"), float("-inf"))


def test_random_parts_are_stable_and_whole(spark):
    pts = points(spark, SF001, "points_li")
    a = assign_random_part(pts, 32).select("key", "part_id")
    b = assign_random_part(pts.repartition(7), 32).select("key", F.col("part_id").alias("p2"))
    assert a.join(b, "key").where("part_id != p2").count() == 0
    sizes = random_part_sizes(assign_random_part(pts, 32)).collect()
    assert sum(r.n for r in sizes) == pts.count() and {r.part_id for r in sizes} <= set(range(32))
    s1 = sample_hash(pts, 0.1).count()
    assert s1 == sample_hash(pts.repartition(5), 0.1).count() and 0 < s1 < pts.count()


def test_lines_with_too_few_or_too_many_fields(spark):
    df = spark.createDataFrame([("1,2",), ("0,2,3,4,5",), ("1,2,3",), (None,)], "line string")
    assert [r.bad for r in parse_points(df, 2, mode="permissive").collect()] == [True, True, False, True]
    for line in ("1,2", "0,2,3,4,5"):
        with pytest.raises(Exception):
            parse_points(df.where(F.col("line") == line), 2).collect()
    assert [tuple(r) for r in parse_points(df.where("line = '1,2,3'"), 2).collect()] == [(1.0, 2.0, 3.0)]


def test_equal_lines_are_drawn_apart(spark):
    from quilt.plans.harness import load_points

    path = tempfile.mkdtemp(prefix="quilt-equal-", dir="/tmp") + "/lines"
    spark.range(1000).select(F.lit("1,2").alias("value")).write.text(path)
    parts = assign_random_part(load_points(spark, path, 1), 32)
    assert parts.select("part_id").distinct().count() > 20


def test_embeddings_of_another_width_fail(spark, tmp_path):
    spark.createDataFrame([(1, [1.0] * 65, 3)], "vec_id bigint, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    with pytest.raises(Exception):
        points(spark, str(tmp_path), "points_vec").collect()


def test_lines_are_numbered_per_file_whatever_the_splits(spark, tmp_path):
    from quilt.sources.text import scan_lines

    texts = {"a": [f"line {i} " + "x" * (i % 50) for i in range(3000)], "b": ["", "only\r", ""], "c": []}
    for name, lines in texts.items():
        (tmp_path / f"part={name}").mkdir()
        (tmp_path / f"part={name}" / "f.txt").write_bytes("\n".join(lines).encode() + (b"\n" if lines else b""))
    (tmp_path / "part=d").mkdir()
    (tmp_path / "part=d" / "f.txt").write_bytes(b"ok\n\xff\xfebad\nno newline at the end")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", held):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            out = scan_lines(spark, str(tmp_path))
            if size == "4k":
                assert out.rdd.getNumPartitions() > 10
            got = {}
            for r in out.collect():
                got.setdefault(r["part"], {})[r["line_no"]] = (r["line"], r["bad_encoding"])
            for name, lines in texts.items():
                assert got.get(name, {}) == {i: (x, False) for i, x in enumerate(lines)}
            assert got["d"] == {0: ("ok", False), 1: ("��bad", True), 2: ("no newline at the end", False)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
