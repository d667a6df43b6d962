"""E5 on axes of any length: the greedy cut without a task that walks an axis.

The walk of ``grouping.cut_axis`` closes a run after coordinate i when its total
exceeds q, or when the next coordinate would overshoot q by more than the total
falls short of it. Both depend on where the run started alone, through prefix
sums: with ``before`` the total before the run's first occupied coordinate, the
first coordinate whose cumulated total exceeds ``q + before`` decides, and the run
ends with it or just before it. So every possible start has one successor, and
the runs of an axis are the chain of successors from its first coordinate.

1. The occupied coordinates are range-partitioned; prefix sums and places are
   counted in each partition and shifted by those before it.
2. Thresholds ``floor(q) + before`` and cumulated totals are merged in one sorted,
   range-partitioned order: the next cumulated total is the deciding coordinate.
3. Coordinates are dealt to blocks of successive places. In a block each start is
   followed to the first start beyond the block (its exit); the chain of exits
   from the axis' start is reached by doubling: each round joins the hops with
   themselves and what is reached with the hops.
4. Each block that is reached is walked from where it is entered.

A start is the place j of the first occupied coordinate at or after it, and
whether it follows the coordinate before (then empty coordinates may lie in
between, and a run of them alone may close, as in ``cut_axis``).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quilt.session import broadcast_if_small, cut_lineage

BLOCK = 65_536  # places of one block: rows that a task holds
ROUNDS = 64


def _placed(per: DataFrame, coord: str) -> DataFrame:
    """``(path, j, c, w, before, gap)`` of the coordinates with weight: place and
    total before it, and whether empty coordinates lie just before it."""
    ranged = cut_lineage(
        per.where("w != 0").select("path", F.col(coord).cast("bigint").alias("c"), F.col("w").cast("bigint").alias("w"))
        .repartitionByRange("path", "c").withColumn("__pid", F.spark_partition_id())
    )
    parts = ranged.groupBy("path", "__pid").agg(F.count(F.lit(1)).alias("__n"), F.sum("w").alias("__w"), F.max("c").alias("__c"))
    before = Window.partitionBy("path").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per path and partition that holds some of it
    shift = cut_lineage(parts.select(
        "path", "__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__j0"),
        F.coalesce(F.sum("__w").over(before), F.lit(0)).alias("__w0"), F.coalesce(F.max("__c").over(before), F.lit(-1)).alias("__c0"),
    ))
    own = Window.partitionBy("path", "__pid").orderBy("c")
    sofar = own.rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(broadcast_if_small(shift, shift.count(), 5), ["path", "__pid"]).select(
        "path", (F.row_number().over(own) - 1 + F.col("__j0")).cast("bigint").alias("j"), "c", "w",
        (F.coalesce(F.sum("w").over(sofar), F.lit(0)) + F.col("__w0")).cast("bigint").alias("before"),
        (F.coalesce(F.lag("c").over(own), F.col("__c0")) + 1).alias("after_last"),
    )


def _deciding(placed: DataFrame, q: float) -> DataFrame:
    """For each place the place, coordinate, total before and weight of the first
    coordinate whose cumulated total exceeds the threshold; nulls if none does."""
    bar = F.col("before") + F.lit(math.floor(q))
    hit = F.struct("j", "c", "before", "w")
    totals = placed.select("path", (F.col("before") + F.col("w")).alias("v"), F.lit(0).alias("kind"), hit.alias("hit"), F.lit(None).cast("bigint").alias("j"))
    asked = placed.select("path", bar.alias("v"), F.lit(1).alias("kind"), F.lit(None).cast(totals.schema["hit"].dataType).alias("hit"), "j")
    # an equal total stands before the threshold: it does not exceed it
    merged = cut_lineage(
        totals.unionByName(asked).repartitionByRange("path", "v", "kind").withColumn("__pid", F.spark_partition_id())
    )
    backwards = Window.partitionBy("path", "__pid").orderBy(F.desc("v"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    found = merged.withColumn("own", F.last("hit", ignorenulls=True).over(backwards)).where("kind = 1")
    firsts = merged.where("kind = 0").groupBy("path", "__pid").agg(F.min_by("hit", "v").alias("__first"))
    # every partition of a path, with the first total of those after it
    parts = merged.select("path", "__pid").distinct().join(firsts, ["path", "__pid"], "left")
    later = Window.partitionBy("path").orderBy(F.desc("__pid")).rowsBetween(Window.unboundedPreceding, -1)
    carry = cut_lineage(parts.select("path", "__pid", F.last("__first", ignorenulls=True).over(later).alias("__later")))
    return found.join(broadcast_if_small(carry, carry.count(), 7), ["path", "__pid"]).select(
        "path", "j", F.coalesce("own", "__later").alias("hit")
    )


def _successors(placed: DataFrame, q: float, splits: int) -> DataFrame:
    """Per start ``(path, j, came)``: its run ``(s, e, tot)`` and the next start
    ``(nj, ncame)``, null after the last."""
    ends = placed.groupBy("path").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("places"))
    rows = placed.join(_deciding(placed, q), ["path", "j"]).join(ends, "path")
    came = F.explode(F.array(F.lit(0), F.lit(1))).alias("came")
    rows = rows.select("*", came).withColumn("s", F.when(F.col("came") == 1, F.col("after_last")).otherwise(F.col("c")))
    t = (F.col("hit.before") - F.col("before")).cast("double")
    room = (F.col("hit.j") > F.col("j")) | (F.col("s") < F.col("c"))
    short = room & ((F.lit(float(q)) - t) < (t + F.col("hit.w") - F.lit(float(q))))
    last = F.col("hit").isNull()
    e = F.when(last, F.lit(splits - 1)).when(short, F.col("hit.c") - 1).otherwise(F.col("hit.c"))
    tot = F.when(last, F.col("total") - F.col("before")).when(short, F.col("hit.before") - F.col("before")).otherwise(
        F.col("hit.before") + F.col("hit.w") - F.col("before")
    )
    nj = F.when(last, None).when(short, F.col("hit.j")).otherwise(F.col("hit.j") + 1)
    return rows.select(
        "path", "j", "came", "s", e.cast("bigint").alias("e"), tot.cast("bigint").alias("tot"),
        F.when(nj < F.col("places"), nj).cast("bigint").alias("nj"), F.when(short, 0).otherwise(1).alias("ncame"),
    )


def _states(batch: pa.Table):
    """Starts of a block in order, 2 * j + came, and their successors (-1: none)."""
    state = 2 * batch["j"].to_numpy() + batch["came"].to_numpy()
    order = np.argsort(state, kind="stable")
    nj = batch["nj"].fill_null(-1).to_numpy()
    after = np.where(nj < 0, -1, 2 * nj + batch["ncame"].to_numpy())
    return state[order], after[order], order


def _exits(group: pa.Table) -> pa.Table:
    """The first start beyond the block that each of its starts leads to."""
    group = group.combine_chunks()
    state, after, _ = _states(group)
    first, end = int(state[0]), int(state[-1]) + 1
    out = after.copy()
    inside = lambda x: (x >= first) & (x < end)
    while (at := np.flatnonzero(inside(out))).size:  # each round follows twice as far
        out[at] = out[out[at] - first]
    n = len(state)
    return pa.table({"path": pa.array(np.full(n, group["path"][0].as_py())), "a": pa.array(state), "b": pa.array(out)})


def _walk(group: pa.Table) -> pa.Table:
    """The runs of a block from the start where it is entered."""
    group = group.combine_chunks()
    state, after, order = _states(group)
    first, at, taken = int(state[0]), int(group["entry"][0].as_py()), []
    while first <= at < first + len(state):
        taken.append(at - first)
        at = int(after[at - first])
    rows = group.take(pa.array(order[taken]))
    return rows.select(["path", "s", "e", "tot"])


def long_axis_runs(per: DataFrame, coord: str, splits: int, target: float, block: int | None = None) -> DataFrame:
    """Runs ``(path, s, e, tot)`` from the totals ``(path, coord, w)``, as
    ``cut_axis`` gives them for each path; weights are at least 0."""
    block = block or BLOCK
    steps = cut_lineage(
        _successors(_placed(per, coord), target, splits)
        .withColumn("block", F.expr(f"j div {block}")).repartition("path", "block")
    )
    hops = cut_lineage(steps.groupBy("path", "block").applyInArrow(_exits, "path bigint, a bigint, b bigint"))
    start = F.lit(1).cast("bigint")  # place 0, after coordinate -1
    reached = steps.select("path").distinct().select("path", start.alias("at"))
    # only starts that some block is entered at can lie on a chain of exits
    entries = hops.where("b >= 0").select("path", F.col("b").alias("a")).union(reached.select("path", F.col("at").alias("a"))).distinct()
    hops = cut_lineage(hops.where("b >= 0").join(entries, ["path", "a"], "left_semi"))
    reached, known = cut_lineage(reached), 0
    for _ in range(ROUNDS):
        count = reached.count()
        if count == known:
            break
        known = count
        onward = reached.join(hops, (reached["path"] == hops["path"]) & (reached["at"] == hops["a"])).select(reached["path"], F.col("b").alias("at"))
        reached = cut_lineage(reached.union(onward).distinct())
        far = hops.select("path", F.col("a").alias("b"), F.col("b").alias("c"))
        hops = cut_lineage(hops.join(far, ["path", "b"]).select("path", "a", F.col("c").alias("b")))
    entered = reached.select("path", F.expr(f"at div {2 * block}").alias("block"), F.col("at").alias("entry"))
    return steps.join(entered, ["path", "block"]).groupBy("path", "block").applyInArrow(_walk, "path bigint, s bigint, e bigint, tot bigint")
