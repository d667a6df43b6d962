"""Sharding along a Hilbert curve, with DataFrame operations only.

Several metadata columns are quantised into cells by equi-depth bins, cells are
ordered by their index on a Hilbert curve (neighbours on the curve are
neighbours in every dimension), rows are sorted by that index, and the order is
cut into runs of equal row counts. A shard therefore covers a compact box of
metadata, and a file's minima and maxima let a reader skip it on any of the
dimensions. Only ids, sizes and hashes are sorted; texts do not move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quilt.llm.common import join_ids, prefix_sums, running_offsets, save


def hilbert_index(cell: Sequence[Column], bits: int) -> Column:
    """Index of a cell on the Hilbert curve. Walks the bit planes from the top,
    carrying the running orientation of the subcube (its entry corner and the
    axis it leaves by) in one fold, so the expression does not grow with bits."""
    n = len(cell)
    mask = (1 << n) - 1
    axes = F.array(*[c.cast("int") for c in cell])

    def turn(x: Column, by: Column) -> Column:
        """x rotated left by ``by`` of n bits."""
        return F.pmod(F.call_function("shiftleft", x, by), F.lit(1 << n)).bitwiseOR(
            F.call_function("shiftright", x, F.lit(n) - by)
        ).bitwiseAND(F.lit(mask)).cast("int")

    def step(state: Column, plane: Column) -> Column:
        corner = F.aggregate(
            F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0),
            lambda acc, k: acc.bitwiseOR(F.call_function(
                "shiftleft",
                F.call_function("shiftright", F.element_at(axes, k + 1), plane).bitwiseAND(F.lit(1)), k,
            )),
        )
        # the corner as seen from the subcube's own orientation
        seen = turn(corner.bitwiseXOR(state["entry"]), F.pmod(F.lit(n) - state["axis"] - 1, F.lit(n)))
        # its place in Gray-code order: the running xor of its bits from the top
        rank = F.aggregate(
            F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0),
            lambda acc, k: acc.bitwiseXOR(F.call_function("shiftright", seen, k)),
        )
        even = F.when(rank == 0, 0).otherwise(F.lit(2) * F.floor((rank - 1) / 2)).cast("int")
        entry = even.bitwiseXOR(F.call_function("shiftright", even, F.lit(1)))
        odd = F.when(rank % 2 == 1, rank).otherwise(rank - 1)
        axis = F.when(rank == 0, 0).otherwise(_trailing_ones(odd, n) % n)
        return F.struct(
            (state["index"] * F.lit(1 << n) + rank).cast("long").alias("index"),
            state["entry"].bitwiseXOR(turn(entry, F.pmod(state["axis"] + 1, F.lit(n)))).cast("int").alias("entry"),
            F.pmod(state["axis"] + axis + 1, F.lit(n)).cast("int").alias("axis"),
        )

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("entry"), F.lit(0).alias("axis"))
    planes = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    return F.aggregate(planes, start, step, lambda s: s["index"])


def _trailing_ones(x: Column, n: int) -> Column:
    """How many of the lowest bits of x are set."""
    out = F.lit(0)
    for k in range(n, 0, -1):
        low = (1 << k) - 1
        out = F.when(out > 0, out).otherwise(F.when(x.bitwiseAND(F.lit(low)) == low, F.lit(k)).otherwise(F.lit(0)))
    return out


def _quantise(values: DataFrame, column: str, bits: int) -> DataFrame:
    """(value, bin): equi-depth bins over the rows, in the order of the values.
    ``values`` has a row per distinct value, with its rows as ``n``."""
    total = values.agg(F.sum("n")).first()[0] or 1
    values = prefix_sums(values, [F.asc_nulls_first(column)], {"_before": "n"})
    share = F.col("_before") / F.lit(total)
    return values.select(
        F.struct(column).alias(f"_v_{column}"),
        F.least(F.floor(share * (1 << bits)), F.lit((1 << bits) - 1)).cast("int").alias(f"_b_{column}"),
    )


def hilbert_shards(
    docs: DataFrame, dimensions: Sequence[str], n_shards: int, id_col: str, ties: Sequence[str],
    carry: Sequence[str] = (), bits: int = 5,
) -> DataFrame:
    """One row per row of ``docs``: the id, the columns ``carry``, ``cell`` (the
    Hilbert index), ``shard`` and ``slot`` (from 0 without gaps). Row counts of
    shards differ by at most one. Rows of one cell are ordered by ``ties``, then
    the id, so a cell with any share of the rows is still cut evenly.

    Dimensions should have few distinct values (round continuous ones); nulls
    are a value below all others; rows that repeat in everything get slots of
    their own; with fewer rows than shards the last shards stay empty; texts are
    not read, however long; an empty table gives an empty result; other columns
    are not read."""
    if len(dimensions) < 2 or len(dimensions) * bits > 62:
        raise ValueError("two dimensions at least, and 62 bits at most")
    rows = docs.select(
        F.col(id_col).alias("_id"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(ties)],
        *[F.col(c).alias(f"_c_{c}") for c in carry],
        *[F.struct(F.col(d).alias(d)).alias(f"_v_{d}") for d in dimensions],
    )
    for d in dimensions:
        values = save(rows.groupBy(F.col(f"_v_{d}")[d].alias(d)).agg(F.count(F.lit(1)).alias("n")))
        rows = join_ids(rows, _quantise(values, d, bits), [f"_v_{d}"], values.count())
    codes = [f"_b_{d}" for d in dimensions]
    cells = save(rows.select(*codes).distinct()).withColumn("cell", hilbert_index([F.col(c) for c in codes], bits))
    rows = rows.join(F.broadcast(cells), codes)  # at most 2**(bits * dimensions) cells
    order = ["cell", *[f"_t{i}" for i in range(len(ties))], "_id", "_salt"]
    keep = ["_id", "cell", *[f"_c_{c}" for c in carry]]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = save(rows.select(*keep, *[c for c in order if c not in (*keep, "_salt")]))
    placed = save(
        slim.withColumn("_salt", F.monotonically_increasing_id())
        .repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .select(*keep, F.monotonically_increasing_id().alias("_at"))
    )
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    starts = running_offsets(sizes, "_part", "_rows", "_before")
    starts = starts.withColumn("_all", F.sum("_rows").over(Window.partitionBy(F.lit(1)))).drop("_rows")
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # the first ``more`` shards hold one row more
    few, more = F.floor(F.col("_all") / n_shards), F.col("_all") % n_shards
    edge = more * (few + 1)
    shard = F.when(F.col("_rank") < edge, F.floor(F.col("_rank") / (few + 1))).otherwise(
        more + F.floor((F.col("_rank") - edge) / F.greatest(few, F.lit(1)))
    )
    first = F.when(F.col("shard") <= more, F.col("shard") * (few + 1)).otherwise(edge + (F.col("shard") - more) * few)
    return (
        placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("_rank", rank)
        .withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_rank") - first).cast("long"))
        .select(F.col("_id").alias(id_col), *[F.col(f"_c_{c}").alias(c) for c in carry], "cell", "shard", "slot")
    )
