from quilt.session import broadcast_if_small, spread


def test_spread_runs_nothing_and_is_asked_for(spark):
    few = spark.range(10_000, numPartitions=1)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("spread", "no job may run")
    assert spread(few, None) is few
    dealt = spread(few.groupBy("id").count(), 5)
    assert list(tracker.getJobIdsForGroup("spread")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "RoundRobinPartitioning(5)" in dealt._jdf.queryExecution().executedPlan().toString()


def test_broadcast_only_below_the_bound(spark):
    small = spark.range(10)
    big = spark.range(10)
    p1 = spark.range(100).join(broadcast_if_small(small, 10), "id")._jdf.queryExecution().optimizedPlan().toString()
    p2 = spark.range(100).join(broadcast_if_small(big, 10**9), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in p1.lower() and "broadcast" not in p2.lower()


def test_weight_literals_round_trip(spark):
    from quilt.operators.train import spark_double

    vals = [1e-05, 1.5e20, -0.0, 5e-324, -123456.789, 0.1 + 0.2, 1e300, -2.5e-10, float("inf")]
    r = spark.sql("SELECT " + ", ".join(f"{spark_double(v)} AS c{i}" for i, v in enumerate(vals))).first()
    assert [repr(r[i]) for i in range(len(vals))] == [repr(v) for v in vals]
