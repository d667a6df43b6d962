"""Links among the members of shared segments (buckets), without all pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilt.llm.common import join_ids, let_go, save
from quilt.llm.components import connected_components

# Members of one segment that a task compares at a time are about twice this.
BLOCK = 512

#: (nodes, roots, loads) of a block -> pairs of nodes with different roots
Find = Callable[[list, list, list], Sequence[tuple[int, int]]]
#: (nodes, roots, loads) of a block -> nodes that can be links with one of another root
Thin = Callable[[list, list, list], Sequence[int]]


def _across(members: DataFrame, find: Find) -> DataFrame:
    """Pairs that ``find`` gives among the members (_sig, _blocks, _node, _root,
    _load) of each segment; only pairs leave the task."""

    def pairs_of(sig, *block):
        pairs = find(*block)
        return {"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())}

    return _in_blocks(members, pairs_of, "a bigint, b bigint").distinct()


def _thinned(members: DataFrame, thin: Thin) -> DataFrame:
    """``(_sig, _node)`` of the members that ``thin`` leaves of each segment."""

    def rest(sig, *block):
        nodes = thin(*block)
        return {"_sig": pa.array([sig] * len(nodes), pa.int64()), "_node": pa.array(nodes, pa.int64())}

    return _in_blocks(members, rest, "_sig bigint, _node bigint").distinct()


def _in_blocks(members: DataFrame, work: Callable[..., dict], schema: str) -> DataFrame:
    """What ``work`` makes of the members of each segment (its number, nodes, roots
    and loads). Members of a large segment are dealt to blocks, and every two blocks
    meet in a group of their own."""
    own = F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    dealt = members.withColumn("_own", own).withColumn("_other", other).select(
        "_sig", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"),
        "_node", "_root", "_load",
    )
    keys = ["_sig", "_i", "_j"]

    def run(batches):
        key, held = None, []

        def flush():
            if len({r[4] for r in held}) > 1:
                (sig, *_), _, _, nodes, roots, loads = zip(*held, strict=True)
                out = pa.RecordBatch.from_pydict(work(sig, list(nodes), list(roots), list(loads)))
                if out.num_rows:
                    yield out

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "_node", "_root")]
            load = batch.column("_load")
            if pa.types.is_list(load.type):
                flat = load.values.to_numpy(zero_copy_only=False)
                ends = load.offsets.to_numpy(zero_copy_only=False)
                loads = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            else:
                loads = load.to_pylist()
            for row in zip(*columns, loads, strict=True):
                if row[:3] != key:
                    yield from flush()
                    key, held = row[:3], []
                held.append(row)
        yield from flush()

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _still_open(placed: DataFrame) -> DataFrame:
    """The members (_sig, _node, _root, and _blocks, into how many blocks to deal
    them) of segments with several components; of those with the same members, one
    is enough."""
    mixed = save(
        placed.groupBy("_sig").agg(
            F.min("_root").alias("lo"), F.max("_root").alias("hi"), F.count(F.lit(1)).alias("_size"),
            F.bit_xor(F.xxhash64("_node")).alias("f1"), F.bit_xor(F.xxhash64("_node", F.lit(1))).alias("f2"),
        )
        .where("lo < hi").groupBy("f1", "f2", "_size").agg(F.min("_sig").alias("_sig"))
        .select("_sig", F.ceil(F.col("_size") / BLOCK).cast("int").alias("_blocks"))
    )
    return save(join_ids(placed.select("_sig", "_node", "_root"), mixed, ["_sig"], mixed.count()))


def hub_pairs(members: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of each member and the hubs of its segments, and ``more``."""
    pairs = members.where("_node > _hub").select(F.col("_hub").alias("a"), F.col("_node").alias("b"))
    return (pairs if more is None else pairs.unionByName(more)).distinct()


def links_within(
    members: DataFrame, loads: DataFrame | Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame], find: Find,
    more: DataFrame | None = None, verify_found: Callable[[DataFrame], DataFrame] | None = None,
    tried: DataFrame | None = None, thin: tuple[DataFrame, Thin] | None = None,
) -> DataFrame:
    """Links (a, b) that connect what all links would connect.

    ``members``: _sig, _node and the segment's _hub, its least node; ``more``:
    further candidate pairs (a, b); ``tried``: those of ``hub_pairs`` that can be
    links, where the caller has told them (saved). Each member is first verified against its
    hubs, where these lie in another component by then. Members of one segment that the links so far leave in different
    components are then compared in blocks by ``find`` on their ``_load``
    (``loads``: _node, _load, or what makes it of the members that are still open),
    and what it finds passes ``verify_found``. ``thin`` (small loads and a function)
    first leaves out, in blocks as well, the members that cannot be links."""
    if tried is None:
        tried = save(hub_pairs(members, more))
    # a member is first verified against the least of its hubs alone: members of a
    # group of copies share many segments, and that joins most of them
    least = save(tried.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    first = save(verify(least))
    place = connected_components(first, "a", "b")
    ends = [place.select(F.col("node").alias(c), F.col("root").alias(f"_r{c}")) for c in ("a", "b")]
    rest = tried.join(least, ["a", "b"], "left_anti").join(ends[0], "a", "left").join(ends[1], "b", "left")
    apart = F.coalesce("_ra", "a") != F.coalesce("_rb", "b")
    links = save(first.unionByName(verify(save(rest.where(apart).select("a", "b")))))
    roots = connected_components(links, "a", "b").withColumnRenamed("node", "_node")
    # (the hub has met everybody: only the others can still be apart)
    others = members.where("_node > _hub").select("_sig", "_node")
    placed = save(
        join_ids(others, roots, ["_node"], roots.count(), "left")
        .select("_sig", "_node", F.coalesce("root", "_node").alias("_root"))
    )
    open_ = _still_open(placed)
    del placed, others, rest, first, least
    let_go(members.sparkSession)
    if thin:
        stay = save(_thinned(open_.join(thin[0], "_node"), thin[1]))
        open_ = _still_open(save(open_.join(stay, ["_sig", "_node"], "left_semi")))
    loads = loads(open_) if callable(loads) else loads
    found = save(_across(open_.join(loads, "_node"), find))
    del open_
    let_go(members.sparkSession)
    return links.unionByName(verify_found(found) if verify_found else found)
