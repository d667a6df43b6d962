"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order (a prefix of its
permutation). Every vector is posted, with the pivot's rank, in the inverted
file of each pivot of its prefix. A query adds up, over the files of its own
pivots, what each posting takes off the footrule distance between the two
permutations (a pivot missing from a prefix counts as ranked just after it);
the vectors at the least distance are reranked by exact inner product.

Pivots order by direction, but nearness is the inner product, which favours
long vectors. So vectors are ordered as points of one sphere: with M the largest
norm, a vector v gets the further component sqrt(M^2 - |v|^2) and a query 0;
angles between these are in the order of the inner products. Where all norms
are alike the component is zero and nothing changes.

The index is cut by document into blocks of bounded size, each packed into one
row with inverted files of its own. A block is sent out once for each QUERY_BLOCK
queries, and a task streams the queries past it: vectors are not copied for each
query, and no task holds more than a block and a batch of queries. With a fixed
share of each block to rerank, the work still grows as queries times vectors.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quilt.llm.common import map_batches, save

PIVOT_SAMPLE = 4096  # rows that the pivots are chosen from
VECTOR_BLOCK, QUERY_BLOCK = 8192, 65_536


def valid_vector(v: Column) -> Column:
    """Not null, of finite components, not all zero."""
    wrong = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~wrong & F.exists(v, lambda x: x != 0)


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    """Rows of norm 1: x / largest and the component that is missing to 1. Norms
    within rounding of the largest one miss nothing."""
    x = x / largest
    missing = 1 - np.einsum("ij,ij->i", x, x)
    return np.column_stack((x, np.sqrt(np.where(missing > 1e-6, missing, 0.0))))


def as_queries(x: np.ndarray) -> np.ndarray:
    """Rows of norm 1 without the further component."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.column_stack((x, np.zeros(len(x))))


def choose_pivots(vectors: DataFrame, n_pivots: int, largest: float) -> np.ndarray:
    """Pivots of unit length from a bounded sample (the rows of least hash),
    each next one the farthest from those before among a few hundred."""
    sample = vectors.orderBy(F.xxhash64("_vid"), "_vid").limit(PIVOT_SAMPLE).select("_v").collect()
    if not sample:
        return np.zeros((0, 0))
    x = np.unique(lifted(np.array([r[0] for r in sample], float), largest), axis=0)
    near, picked = np.full(len(x), -np.inf), []
    for _ in range(min(n_pivots, len(x))):
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[picked[-1]])
        near[picked[-1]] = np.inf
    return x[picked]


def permutation_prefixes(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Indices of the nearest pivots of each row, nearest first."""
    sim = x @ pivots.T
    length = min(length, len(pivots))
    top = np.argpartition(-sim, length - 1, axis=1)[:, :length] if length < len(pivots) else np.argsort(-sim, axis=1)
    order = np.argsort(-np.take_along_axis(sim, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1).astype(np.int16)


class Block:
    """Vectors of one block with the inverted files of the pivots: for a pivot the
    rows that have it in their prefix, and its rank there."""

    def __init__(self, ids, uids, vectors, prefixes, n_pivots: int):
        order = np.lexsort((uids, ids))  # ties in distance go to the smaller id
        self.ids, self.uids, self.vectors, self.prefixes = ids[order], uids[order], vectors[order], prefixes[order]
        n, self.length = prefixes.shape
        pivot = self.prefixes.ravel()
        order = np.argsort(pivot, kind="stable")
        self.rows, self.ranks = order // self.length, (order % self.length).astype(np.int16)
        self.start = np.searchsorted(pivot[order], np.arange(n_pivots + 1))
        self.places = np.arange(n)

    def blob(self) -> bytes:
        out = io.BytesIO()
        for a in (self.ids, self.uids, self.vectors, self.prefixes):
            np.save(out, a, allow_pickle=False)
        return out.getvalue()

    @staticmethod
    def load(blob: bytes, n_pivots: int) -> Block:
        data = io.BytesIO(blob)
        return Block(*(np.load(data, allow_pickle=False) for _ in range(4)), n_pivots)

    def search(self, uid: int, query: np.ndarray, own: np.ndarray, k: int, share: float, least: int):
        """Rows and scores of the best ``k`` of those at the least footrule
        distance, the query's own row left out."""
        n = len(self.ids)
        files = [slice(a, b) for a, b in zip(self.start[own], self.start[own + 1])]
        at = np.concatenate([self.rows[f] for f in files])
        rank = np.concatenate([self.ranks[f] for f in files])
        mine = np.repeat(np.arange(self.length, dtype=np.int16), [f.stop - f.start for f in files])
        # footrule = a constant - 2 * sum over shared pivots of (length - larger rank)
        near = np.bincount(at, weights=self.length - np.maximum(rank, mine), minlength=n) * n - self.places
        take = min(n, max(least, int(np.ceil(n * share))))
        cand = np.argpartition(-near, take - 1)[:take] if take < n else self.places
        cand = cand[self.uids[cand] != uid]
        score = self.vectors[cand] @ query
        if len(cand) > 4 * k:  # (with all ties of the k-th)
            kept = score >= -np.partition(-score, k - 1)[k - 1]
            cand, score = cand[kept], score[kept]
        best = np.lexsort((self.uids[cand], self.ids[cand], -score))[:k]
        return cand[best], score[best]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def permutation_search(
    table: DataFrame, is_query: Column, k: int = 20, n_pivots: int = 512, prefix: int = 48,
    share: float = 0.15, least: int = 400, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), the id and ``score`` of the nearest rows found
    for every row where ``is_query``; ties go to the smaller id.

    ``share`` of a block (at least ``least`` rows) is reranked. Vectors that are
    null, zero or hold null or non-finite components take no part, nor do null
    ids. Rows that repeat an id are rows of their own: each query row has its own
    answers (so a repeated query id has as many lists), and only the query's own
    row is no candidate. An empty table gives an empty result; other columns are
    not read. All vectors must have one width."""
    spark = table.sparkSession
    rows = table.select(
        F.col(id_col).cast("bigint").alias("_vid"), F.col(vector_col).cast("array<double>").alias("_v"),
        F.coalesce(is_query, F.lit(False)).alias("_query"),
    ).where(F.col("_vid").isNotNull() & valid_vector(F.col("_v")))
    top = F.array_max(F.transform("_v", F.abs))
    norm = top * F.sqrt(F.aggregate(F.transform("_v", lambda x: x / top), F.lit(0.0), lambda a, x: a + x * x))
    largest = rows.agg(F.max(norm)).first()[0] or 1.0
    pivots = choose_pivots(rows, n_pivots, largest)
    if not len(pivots):
        return spark.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score double")
    made = len(pivots)

    def represent(batch):
        x = _matrix(batch.column("_v"))
        asks = batch.column("_query").to_numpy(zero_copy_only=False)
        p = permutation_prefixes(lifted(x, largest), pivots, prefix)
        own = permutation_prefixes(as_queries(x[asks]), pivots, prefix) if asks.any() else p[:0]

        def nested(prefixes, counts):
            ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32) * np.int32(p.shape[1])
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(prefixes.ravel()))

        return {
            "_vid": batch.column("_vid"), "_uid": batch.column("_uid"), "_query": batch.column("_query"), "_v": batch.column("_v"),
            "_p": nested(p, np.ones(len(p), np.int32)), "_own": nested(own, asks.astype(np.int32)),
        }

    kind = "_vid bigint, _uid bigint, _query boolean, _v array<double>, _p array<smallint>, _own array<smallint>"
    indexed = save(map_batches(rows.withColumn("_uid", F.monotonically_increasing_id()), represent, kind))
    n, n_queries = indexed.agg(F.count(F.lit(1)), F.count(F.when(F.col("_query"), 1))).first()
    blocks, copies = max(1, -(-n // VECTOR_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    partitions = min(blocks * copies, 8 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = F.pmod(F.xxhash64("_uid"), F.lit(blocks)).cast("int")

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        parts = [group[c].combine_chunks() for c in ("_v", "_p")]
        block = Block(group["_vid"].to_numpy(), group["_uid"].to_numpy(), *map(_matrix, parts), made)
        return pa.table({"vb": group["vb"][:1], "blob": pa.array([block.blob()], pa.binary())})

    packed = (
        indexed.select(dealt.alias("vb"), "_vid", "_uid", "_v", "_p").repartition(min(blocks, partitions), "vb")
        .groupBy("vb").applyInArrow(pack, "vb int, blob binary")
    )
    none = F.lit(None)
    held = packed.select(
        "vb", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("slot"), F.lit(0).alias("kind"),
        none.cast("bigint").alias("uid"), none.cast("bigint").alias("query_id"), none.cast("array<double>").alias("v"),
        none.cast("array<smallint>").alias("own"), "blob",
    )
    asked = indexed.where("_query").select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("vb"), F.pmod(F.xxhash64("_uid", F.lit(1)), F.lit(copies)).cast("int").alias("slot"),
        F.lit(1).alias("kind"), F.col("_uid").alias("uid"), F.col("_vid").alias("query_id"), F.col("_v").alias("v"), F.col("_own").alias("own"),
        none.cast("binary").alias("blob"),
    )
    met = held.unionByName(asked).repartition(partitions, "vb", "slot").sortWithinPartitions("vb", "slot", "kind", "uid")

    def run(batches):
        at = block = None
        for batch in batches:
            keys = list(zip(batch.column("vb").to_pylist(), batch.column("slot").to_pylist()))
            kinds, uids, names = (batch.column(c).to_pylist() for c in ("kind", "uid", "query_id"))
            out: list[list] = [[] for _ in range(5)]
            for i, kind in enumerate(kinds):
                if kind == 0:
                    at, block = keys[i], batch.column("blob")[i].as_py()
                    continue
                if at != keys[i]:
                    raise RuntimeError("a query without its block")
                if isinstance(block, bytes):
                    block = Block.load(block, made)
                query, own = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("v", "own"))
                rows, scores = block.search(uids[i], query, own, k, share, least)
                for held_, values in zip(out, ([uids[i]] * len(rows), [names[i]] * len(rows), block.ids[rows].tolist(), block.uids[rows].tolist(), scores.tolist())):
                    held_.extend(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, (*[pa.int64()] * 4, pa.float64()))], names=["uid", "query_id", id_col, "found", "score"]
            )

    found = met.mapInArrow(run, f"uid bigint, query_id bigint, {id_col} bigint, found bigint, score double")
    # k rows from each block of vectors meet here
    order = Window.partitionBy("uid").orderBy(F.desc("score"), id_col, "found")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", id_col, "score")
    )
