"""N-gram Jaccard self-join by universe partitioning and pigeonhole.

A document is the set of its distinct word shingles. For a size band, the
universe of shingle hashes is cut into m segments. Two sets of the band with
Jaccard similarity >= num/den differ in at most H shingles, so

* *exact* scheme: m > H segments, of which at least m - H have the same content
  in both. Each set needs only its H + 1 rarest contents (rarity is counted
  over all sets): of the contents that two linked sets share, the rarest is
  beaten, in either set, only by segments that differ, at most H of them. So a
  set drops its m - H - 1 commonest contents, and a set that shares no more
  contents than that with anybody has no partner at all.
* *one-deletion* scheme: with floor(H / 2) + 1 segments, at least one segment
  differs by at most one shingle; every set posts each segment's content and
  each content with one shingle deleted, and such segments meet.

Cost-based allocation: for every band the scheme with the lower expected cost
is taken, posted rows x (1 + accidental partners), from the number of sets in
the band: larger corpora move to the larger, more selective segments.

Candidates are then compared by sketches, how many shingles fall on each of some
places: these differ in no more than the sets do, so that no link is lost and sets
that only have a few shingles in common are told apart by a few dozen bytes. What
is left is verified on the whole shingle sets. Groups are not
expanded into pairs: equal sets are one node; the nodes that share a posted
segment are first compared with the least of them, and only nodes which the
links found so far leave in different components are compared with each other,
in blocks, inside a task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quilt.llm.common import join_ids, let_go, map_batches, save, save_arrays, slices
from quilt.llm.components import connected_components
from quilt.llm.segments import hub_pairs, links_within
from quilt.llm.shingles import mix, shingle_sets

# Chance that a shingle of one text is found in another, unrelated text of the
# band. Only the cost estimate uses it, never the result.
COMMON_SHINGLE = 0.05
# Signatures of one range, about: what a task sorts at a time.
RANGE_SIGNATURES = 2_000_000
# Bytes of shared signatures, or of their hubs, that every task may read as arrays.
SIGNATURE_BYTES = 64 << 20
# Upper bits of a signature that tell its place among 64 bits of a word, when the
# shared ones are too many for that: bits of 32 MB at most.
WORD_BITS = 22
# Places of a sketch, at least; else a quarter to a half of the shingles.
SKETCH_PLACES = 64
# Cells (pairs x places) of sketches that are compared at a time.
SKETCH_CELLS = 1 << 20
# Cells (sets x images) that are compared at a time in a block of a segment.
FINDER_CELLS = 1 << 22
# Pairs of a block that are counted one by one; more are counted together.
FINDER_PAIRS = 20_000


def _band_bounds() -> list[int]:
    out = [1]
    while out[-1] < 2**40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


BOUNDS = _band_bounds()


@dataclass(frozen=True)
class Jaccard:
    """Shingle width in words and the similarity num/den that makes a link."""

    width: int = 5
    num: int = 80
    den: int = 100

    def __post_init__(self):
        if self.width < 1 or not (2 * self.den <= 3 * self.num <= 3 * self.den):
            raise ValueError("width >= 1 and 2/3 <= num/den <= 1")

    def most_differences(self, n: np.ndarray) -> np.ndarray:
        """Of a set of n shingles against any partner."""
        return n * (self.den - self.num) // self.num

    def band_differences(self, band: int) -> int:
        """Of two sets whose larger one lies in the band."""
        return 2 * (BOUNDS[band + 1] - 1) * (self.den - self.num) // (self.den + self.num)

    def segments(self, band: int, deletion: bool) -> int:
        h = self.band_differences(band)
        return h // 2 + 1 if deletion else h + 3 + h // 8

    def dropped(self, n: np.ndarray, band: int, deletion: bool) -> np.ndarray:
        """How many of its segments a set of n shingles may leave out."""
        if deletion:
            return np.zeros_like(n)
        most = np.minimum(self.most_differences(n), self.band_differences(band))
        return self.segments(band, deletion) - most - 1

    def is_link(self, inter: Column, a: Column, b: Column) -> Column:
        return self.den * inter >= self.num * (a + b - inter)


def band_of(n: int) -> int:
    return bisect_right(BOUNDS, n) - 1


def allocate(spec: Jaccard, sets_by_band: dict[int, int]) -> frozenset[int]:
    """The bands that take the one-deletion scheme."""
    chosen = set()
    for band in range(len(BOUNDS) - 1):
        n = (BOUNDS[band] + BOUNDS[band + 1]) / 2
        others = sets_by_band.get(band, 0) + sets_by_band.get(band - 1, 0)
        cost = {}
        for deletion in (False, True):
            m = spec.segments(band, deletion)
            rows = n + m if deletion else spec.band_differences(band) + 1
            same = max(n / m - deletion, 0.0)
            cost[deletion] = rows * (1 + others * COMMON_SHINGLE**same)
        if cost[True] < cost[False]:
            chosen.add(band)
    return frozenset(chosen)


def _post(spec: Jaccard, flat, n, band, deletion):
    """Signatures of sets that all use one band: a list for each set."""
    m = spec.segments(band, deletion)
    text = np.repeat(np.arange(len(n)), n)
    salt = 1000 + band * 2 + deletion
    seg = ((mix(flat, 11) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    cell = text * m + seg
    weight = mix(flat, 12)
    content = np.zeros(len(n) * m, np.uint64)
    np.add.at(content, cell, weight)
    seg_salt = mix(np.arange(m, dtype=np.uint64), salt)
    sig = mix(content ^ np.tile(seg_salt, len(n))).reshape(len(n), m)
    if not deletion:
        return list(sig)
    less = mix((content[cell] - weight) ^ seg_salt[seg])
    ends = np.cumsum(n)
    return [np.concatenate((own, less[e - k : e])) for own, e, k in zip(sig, ends, n, strict=True)]


def postings(spec: Jaccard, deletions: frozenset[int], flat, n) -> list[list[dict]]:
    """For each set, and each of the one or two bands where its partners can
    be: how many segments it may drop, and its signatures."""
    first = np.cumsum(n) - n
    own = np.array([band_of(int(x)) for x in n], np.int64)
    reach = np.array([band_of(int(x) * spec.den // spec.num) for x in n], np.int64)
    out: list[list[dict]] = [[] for _ in n]
    for band in np.unique(np.concatenate((own, reach))).tolist():
        at = np.flatnonzero((n > 0) & ((own == band) | (reach == band)))
        if not len(at):
            continue
        part = np.concatenate([flat[first[i] : first[i] + n[i]] for i in at])
        drop = spec.dropped(n[at], band, band in deletions)
        for i, k, sig in zip(at, drop, _post(spec, part, n[at], band, band in deletions), strict=True):
            out[i].append({"_band": band, "_drop": int(k), "_sigs": sig.view(np.int64)})
    return out


def shared_signatures(base: DataFrame, spec: Jaccard, deletions: frozenset[int], ranges: int) -> DataFrame:
    """``(_sig, _rows)`` of the signatures that several rows post, and how many do.

    There are hundreds of signatures for each text, so they travel packed: a task
    counts those of some texts at a time and sends each of ``ranges`` (by the
    signature's upper bits) its part in one row. A signature of very many texts is
    one entry of each such part."""
    bounds = ((np.arange(1, ranges, dtype=object) << 64) // ranges).astype(np.uint64)

    def post(batches):
        for batch in slices(batches):
            flat, n = shingle_sets(_texts(batch, "_text"), spec.width)
            posts = [p["_sigs"].view(np.uint64) for of in postings(spec, deletions, flat, n) for p in of]
            if not posts:
                continue
            sigs, times = np.unique(np.concatenate(posts), return_counts=True)
            ends = np.concatenate(([0], np.searchsorted(sigs, bounds), [len(sigs)]))
            at = np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_pydict({
                "range": pa.array(at, pa.int32()),
                "sigs": pa.array([sigs[ends[i] : ends[i + 1]].tobytes() for i in at], pa.binary()),
                "times": pa.array([times[ends[i] : ends[i + 1]].astype(np.uint32).tobytes() for i in at], pa.binary()),
            })

    def count(group: pa.Table) -> pa.Table:
        sigs = np.frombuffer(b"".join(group["sigs"].to_pylist()), np.int64)
        times = np.frombuffer(b"".join(group["times"].to_pylist()), np.uint32)
        order = np.argsort(sigs)
        sigs = sigs[order]
        first = np.flatnonzero(np.concatenate(([True], sigs[1:] != sigs[:-1])))
        rows = np.add.reduceat(times[order].astype(np.int64), first)
        return pa.table({"_sig": pa.array(sigs[first][rows > 1]), "_rows": pa.array(rows[rows > 1])})

    parts = base.select("_text").mapInArrow(post, "range int, sigs binary, times binary")
    return parts.groupBy("range").applyInArrow(count, "_sig bigint, _rows bigint")


def _looked_up(read: Callable[[], list[np.ndarray]]) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """For a task: which keys the table (keys and values) holds, and their values.
    The table is read at the first call."""
    held: list[np.ndarray] = []

    def look_up(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not held:
            held.extend(read())
        known, values = held
        if not len(known):
            return np.zeros(len(keys), bool), values
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        return hit, values[at[hit]]

    return look_up


def _may_be_shared(shared: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """For a task: which signatures may be among the shared ones (none of these is
    missed). Read at the first call, 32 MB whatever their number."""
    word = F.shiftrightunsigned("_sig", 64 - WORD_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_sig, {58 - WORD_BITS}) & 63 as int))")
    _, read = save_arrays(shared.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits")), "signature-bits")
    held: list[np.ndarray] = []

    def look_up(sigs: np.ndarray) -> np.ndarray:
        if not held:
            words, bits = read()
            held.append(np.zeros(1 << WORD_BITS, np.uint64))
            held[0][words] = bits.view(np.uint64)
        sigs = sigs.view(np.uint64)
        found = held[0][(sigs >> np.uint64(64 - WORD_BITS)).astype(np.int64)]
        return (found >> ((sigs >> np.uint64(58 - WORD_BITS)) & np.uint64(63)) & np.uint64(1)).astype(bool)

    return look_up


def _rarest(each: np.ndarray, sig: np.ndarray, rows: np.ndarray, drop: np.ndarray) -> np.ndarray:
    """Which signatures stay, of groups numbered by ``each``: all but the ``drop``
    commonest of the group (of equally common ones the lesser are dropped first)."""
    order = np.lexsort((sig, -rows, each))
    of, s = each[order], sig[order]
    once = np.ones(len(of), bool)
    once[1:] = (of[1:] != of[:-1]) | (s[1:] != s[:-1])
    order, of = order[once], of[once]
    start = np.searchsorted(of, of)
    return order[np.arange(len(of)) - start >= drop[of]]


def _kept(
    base: DataFrame, spec: Jaccard, deletions: frozenset[int], shared: DataFrame, read: Callable[[], list[np.ndarray]],
    with_node: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``(_node, _sig)``: of the shared signatures of each row and band, all but the
    commonest that it may drop. Signatures are many times the ids: they are worked
    out again here, not kept, and those that nobody shares go before they leave the
    task, with all of a row that has no more than it may drop. Commonness is looked
    up in the task as long as the shared ones (two longs each) are few enough to be
    read there; else a few bits tell those that may be shared, and a join the rest."""
    small = shared.count() * 16 <= SIGNATURE_BYTES
    look_up = _looked_up(read) if small else _may_be_shared(shared)

    def post(batch):
        flat, n = shingle_sets(_texts(batch, "_text"), spec.width)
        k1, k2 = _keys(flat, n)
        posts = postings(spec, deletions, flat, n)
        of = [(i, p["_band"], p["_drop"], p["_sigs"].view(np.int64)) for i, row in enumerate(posts) for p in row]
        if not of:
            return None
        owner, band, drop, sigs = zip(*of, strict=True)
        each = np.repeat(np.arange(len(of)), [len(s) for s in sigs])
        sig, drop = np.concatenate(sigs), np.array(drop, np.int32)
        if small:
            hit, rows = look_up(sig)
            each, sig = each[hit], sig[hit]
            at = _rarest(each, sig, rows, drop)
        else:
            hit = look_up(sig)
            each, sig = each[hit], sig[hit]
            some = np.bincount(each, minlength=len(of)) > drop
            at = np.flatnonzero(some[each])
        each, sig = each[at], sig[at]
        row = np.array(owner)[each]
        out = {"_k1": pa.array(k1[row]), "_k2": pa.array(k2[row]), "_sig": pa.array(sig)}
        if not small:
            out |= {"_band": pa.array(np.array(band, np.int32)[each]), "_drop": pa.array(drop[each])}
        return out

    found = with_node(map_batches(
        base.select("_text"), post, "_k1 bigint, _k2 bigint, _sig bigint" + ("" if small else ", _band int, _drop int")
    ))
    if small:
        return found.select("_node", "_sig").distinct()
    # (dealt once for both: a node has few signatures)
    found = found.select("_node", "_band", "_drop", "_sig").join(shared, "_sig").repartition("_node", "_band")
    own = Window.partitionBy("_node", "_band").orderBy(F.desc("_rows"), "_sig")
    return (
        found.distinct().withColumn("_rank", F.row_number().over(own))
        .where("_rank > _drop").select("_node", "_sig").distinct()
    )


def _with_hub(kept: DataFrame, hubs: DataFrame, read: Callable[[], list[np.ndarray]]) -> DataFrame:
    """``(_sig, _node, _hub)`` of the kept contents that several nodes share."""
    n = hubs.count()
    if n * 16 > SIGNATURE_BYTES:
        return join_ids(kept, hubs, ["_sig"], n)
    look_up = _looked_up(read)

    def find(batches):
        for batch in batches:
            hit, hub = look_up(batch.column("_sig").to_numpy())
            some = batch.filter(pa.array(hit))
            yield pa.RecordBatch.from_pydict({"_sig": some.column("_sig"), "_node": some.column("_node"), "_hub": pa.array(hub)})

    return kept.select("_sig", "_node").mapInArrow(find, "_sig bigint, _node bigint, _hub bigint")


def _keys(flat, n):
    """128 bits that identify each set."""
    first = np.cumsum(n) - n
    out = []
    for salt in (21, 22):
        k = np.zeros(len(n), np.uint64)
        full = n > 0
        if full.any():
            k[full] = np.add.reduceat(mix(flat, salt), first[full])
        out.append(mix(k).view(np.int64))
    return out


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def _sizes(docs: DataFrame, text: str) -> dict[int, int]:
    """Estimated number of sets by size band, from the length of the texts (six
    characters a word). It only steers the allocation."""
    words = F.length(text) / F.lit(6.0) + 1
    step = F.floor(F.log(1.1, words)).cast("int")
    out: dict[int, int] = {}
    for k, n in docs.where(F.length(text) > 0).groupBy(step.alias("step")).count().collect():
        band = band_of(int(1.1**k))
        out[band] = out.get(band, 0) + n
    return out


def _with_node(df: DataFrame, clashes: DataFrame, n_clashes: int) -> DataFrame:
    """The node is the first half of the key, except where two sets share it."""
    return (
        join_ids(df, clashes, ["_k1"], n_clashes, "left")
        .withColumn("_node", F.when(F.col("_clash"), F.xxhash64("_k1", "_k2")).otherwise(F.col("_k1")))
        .drop("_clash")
    )


def _verify(pairs: DataFrame, sets: DataFrame, spec: Jaccard) -> DataFrame:
    """The pairs (a, b) that are links."""
    one = sets.select(F.col("_node").alias("a"), F.col("_set").alias("sa"))
    two = sets.select(F.col("_node").alias("b"), F.col("_set").alias("sb"))
    inter = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(one, "a").join(two, "b")
        .where(spec.is_link(inter, F.size("sa"), F.size("sb")))
        .select("a", "b")
    )


def sketches(flat: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Of each set its size (4 bytes) and how many of its shingles fall on each of
    some places (a byte each, 255 for more). The places of a larger set are those
    of a smaller one, cut in two, four and so on."""
    places = np.maximum(SKETCH_PLACES, 1 << (np.maximum(np.frexp(n)[1], 2) - 2).astype(np.int64))
    first, out = np.cumsum(n) - n, [b""] * len(n)
    where = mix(flat, 31)
    for k in np.unique(places).tolist():
        at = np.flatnonzero(places == k)
        part = np.concatenate([where[first[i] : first[i] + n[i]] for i in at])
        cell = (part >> np.uint64(65 - k.bit_length())).astype(np.int64) + np.repeat(np.arange(len(at)), n[at]) * k
        counts = np.minimum(np.bincount(cell, minlength=len(at) * k), 255).astype(np.uint8).reshape(-1, k)
        for i, row in zip(at.tolist(), counts, strict=True):
            out[i] = int(n[i]).to_bytes(4, "little") + row.tobytes()
    return out


def _folded(loads: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and counts of sketches, on the same ``k`` places for all."""
    n = np.array([int.from_bytes(x[:4], "little") for x in loads], np.int64)
    counts = np.zeros((len(loads), k), np.int16)
    length = np.array([len(x) - 4 for x in loads])
    for own in np.unique(length).tolist():
        at = np.flatnonzero(length == own)
        x = np.frombuffer(b"".join([loads[i][4:] for i in at]), np.uint8).reshape(len(at), k, own // k)
        counts[at] = np.minimum(x.sum(axis=2, dtype=np.int32), 255)
    return n, counts


def _can_link(spec: Jaccard, x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Of pairs of sketches: False where the sets differ in more shingles than
    linked ones do."""
    k = np.minimum([len(s) for s in x], [len(s) for s in y]) - 4
    out = np.zeros(len(k), bool)
    for own in np.unique(k).tolist():
        at = np.flatnonzero(k == own)
        for some in np.array_split(at, -(-len(at) * own // SKETCH_CELLS)):
            (a, one), (b, two) = (_folded([of[i] for i in some], own) for of in (x, y))
            apart = np.maximum(np.abs(one - two).sum(axis=1, dtype=np.int64), np.abs(a - b))
            out[some] = (spec.den + spec.num) * apart <= (spec.den - spec.num) * (a + b)
    return out


def _within(pairs: DataFrame, loads: DataFrame, spec: Jaccard) -> DataFrame:
    """The pairs (a, b) that can be links by their sketches."""
    one = loads.select(F.col("_node").alias("a"), F.col("_load").alias("x"))
    two = loads.select(F.col("_node").alias("b"), F.col("_load").alias("y"))

    def keep(batch):
        near = _can_link(spec, batch.column("x").to_pylist(), batch.column("y").to_pylist())
        return batch.select(["a", "b"]).filter(pa.array(near))

    return map_batches(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y"), keep, "a bigint, b bigint")


def _thinner(spec: Jaccard):
    """The sets of a block that can be links, by their sketches, with one of
    another component."""

    def thin(nodes, roots, loads):
        k = min(map(len, loads)) - 4
        n, x = _folded(loads, k)
        order = np.argsort(n, kind="stable")
        n, x, r = n[order], x[order], np.asarray(roots)[order]
        # (a partner that is not smaller has at most n * den / num shingles)
        last = np.searchsorted(n, n * spec.den // spec.num, "right")
        stays, a = np.zeros(len(n), bool), 0
        while a < len(n):
            b = a + max(1, min(len(n) - a, SKETCH_CELLS // ((int(last[a]) - a) * k)))
            end = int(last[b - 1])
            apart = np.abs(x[a:b, None] - x[None, a:end]).sum(axis=2, dtype=np.int64)
            near = (spec.den + spec.num) * apart <= (spec.den - spec.num) * (n[a:b, None] + n[None, a:end])
            near &= r[a:b, None] != r[None, a:end]
            stays[a:b] |= near.any(axis=1)
            stays[a:end] |= near.any(axis=0)
            a = b
        return np.asarray(nodes)[order][stays].tolist()

    return thin


def _finder(spec: Jaccard):
    """Pairs of sets of different components that can be links, within a block.

    Two linked sets share one of the rarest n - ceil(n * num / den) + 1 shingles
    of each (rarity in the block): only pairs that do are counted, so sets that
    have a passage in common, and little else, cost next to nothing. The sets come
    as 32-bit images, half the bytes; each image that a set holds twice hides one
    shingle at most, which the bound allows for."""

    def shared(owner, column, sets):
        """Products of 0/1 matrices of the columns that several sets have."""
        columns, back, times = np.unique(column, return_inverse=True, return_counts=True)
        keep = times[back] > 1
        place = np.cumsum(times > 1) - 1
        owner, column = owner[keep], place[back[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((sets, sets), np.float32)  # (counts stay far below 2^24)
        width = max(64, FINDER_CELLS // sets)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, (at, at + width))
            table = np.zeros((sets, min(width, int(column[-1]) + 1 - at)), np.float32)
            table[owner[lo:hi], column[lo:hi] - at] = 1
            both += table @ table.T
        return both

    def find(nodes, roots, sets):
        n = np.array([len(s) for s in sets], np.int64)
        images = [np.unique(s) for s in sets]
        sizes = np.array([len(s) for s in images])
        hidden = n - sizes
        # (arrays of all images are as narrow as they can be: several tasks share a memory)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        _, column, times = np.unique(np.concatenate(images), return_inverse=True, return_counts=True)
        column, times = column.astype(np.int32), times.astype(np.int32)
        rarest = np.lexsort((column, times[column], owner)).astype(np.int32)
        most, start = n + (-n * spec.num // spec.den) + 1, np.cumsum(sizes) - sizes
        first = np.concatenate([rarest[a : a + k] for a, k in zip(start, np.minimum(most, sizes))])
        del rarest
        r, x = np.asarray(roots), np.asarray(nodes)
        met = (shared(owner[first], column[first], len(sets)) > 0) & (r[:, None] != r[None, :]) & (x[:, None] < x[None, :])
        pairs = np.argwhere(met)
        if len(pairs) <= FINDER_PAIRS:
            both = np.array([len(np.intersect1d(images[i], images[j], assume_unique=True)) for i, j in pairs], np.int64)
        else:
            both = shared(owner, column, len(sets))[pairs[:, 0], pairs[:, 1]].astype(np.int64)
        i, j = pairs[:, 0], pairs[:, 1]
        both = both + np.minimum(hidden[i], hidden[j])
        found = spec.den * both >= spec.num * (n[i] + n[j] - both)
        return [(int(a), int(b)) for a, b in zip(x[i[found]], x[j[found]])]

    return find


def jaccard_components(
    docs: DataFrame, spec: Jaccard = Jaccard(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_shingles`` and ``component_id``,
    the least id reachable over links (its own included).

    * null and empty texts and texts without words: no shingles, no links;
    * equal sets are linked; rows that repeat an id are separate documents;
    * a null id takes part in links but is never a component's id unless the
      component has no other;
    * long texts are read whole: their sets fall into size bands of their own;
    * an empty table gives an empty result; other columns are not read.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    sizes = _sizes(base, "_text")
    deletions = allocate(spec, sizes)

    def describe(batch):
        flat, n = shingle_sets(_texts(batch, "_text"), spec.width)
        k1, k2 = _keys(flat, n)
        return {
            "_id": batch.column("_id"), "_n": pa.array(n), "_k1": pa.array(k1), "_k2": pa.array(k2),
            "_load": pa.array(sketches(flat, n), pa.binary()),
        }

    kind = base.schema["_id"].dataType.simpleString()
    described = save(map_batches(base, describe, f"_id {kind}, _n bigint, _k1 bigint, _k2 bigint, _load binary"))
    clashes = save(
        described.where("_n > 0").groupBy("_k1")
        .agg((F.min("_k2") != F.max("_k2")).alias("_clash")).where("_clash")
    )
    n_clashes = clashes.count()

    def with_node(df: DataFrame) -> DataFrame:
        return _with_node(df, clashes, n_clashes)

    described = with_node(described)

    # contents that several rows have, with how many do (those of equal sets alone
    # among them: a content more only makes the choice below keep no less)
    expected = sum(c * 2 * (spec.segments(band, band in deletions) + (BOUNDS[band + 1] if band in deletions else 0)) for band, c in sizes.items())
    shared, counts = save_arrays(shared_signatures(base, spec, deletions, max(1, -(-expected // RANGE_SIGNATURES))), "signatures")
    let_go(docs.sparkSession)
    # the rarest contents of each node (a node has at most one row per segment)
    kept = save(_kept(base, spec, deletions, shared, counts, with_node))
    hubs, least_of = save_arrays(
        kept.groupBy("_sig").agg(F.min("_node").alias("_hub"), F.max("_node").alias("_hi"))
        .where("_hub < _hi").select("_sig", "_hub"), "hubs"
    )
    members = save(_with_hub(kept, hubs, least_of))
    del kept, hubs, shared
    let_go(docs.sparkSession)
    wanted = save(members.select("_node").distinct())
    loads = save(
        join_ids(described.where("_n > 0").select("_node", "_load"), wanted, ["_node"], wanted.count())
        .groupBy("_node").agg(F.first("_load").alias("_load"))
    )

    def sets_of(batch):
        flat, n = shingle_sets(_texts(batch, "_text"), spec.width)
        k1, k2 = _keys(flat, n)
        offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
        return {
            "_k1": pa.array(k1), "_k2": pa.array(k2),
            "_set": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64))),
        }

    every = with_node(map_batches(base, sets_of, "_k1 bigint, _k2 bigint, _set array<bigint>"))

    def sets(nodes: DataFrame) -> DataFrame:
        nodes = save(nodes.select("_node").distinct())
        return save(
            join_ids(every, nodes, ["_node"], nodes.count()).groupBy("_node").agg(F.first("_set").alias("_set"))
        )

    tried = save(_within(hub_pairs(members), loads, spec))
    ready = sets(tried.select(F.explode(F.array("a", "b")).alias("_node")))
    let_go(docs.sparkSession)
    opened: list[DataFrame] = []

    def images(open_: DataFrame) -> DataFrame:
        opened.append(sets(open_))
        return opened[0].select("_node", F.transform("_set", lambda x: F.shiftright(x, 32).cast("int")).alias("_load"))

    links = links_within(
        members, images, lambda pairs: _verify(pairs, ready, spec), _finder(spec), tried=tried,
        thin=(loads, _thinner(spec)), verify_found=lambda pairs: _verify(pairs, opened[0], spec),
    )
    roots = save(connected_components(links, "a", "b"))
    del members, loads, tried, ready, opened, links
    let_go(docs.sparkSession)

    # the least id of a component; a row without links is its own
    n_roots = roots.count()
    nodes = described.where("_n > 0").groupBy("_node").agg(F.min("_id").alias("_least"))
    nodes = (
        join_ids(nodes, roots.withColumnRenamed("node", "_node"), ["_node"], n_roots, "left")
        .withColumn("_root", F.coalesce("root", "_node"))
    )
    least = nodes.groupBy("_root").agg(F.min("_least").alias("_component"))
    nodes = save(nodes.join(least, "_root").select("_node", "_component"))
    return described.join(nodes, "_node", "left").select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"),
        F.when(F.col("_n") > 0, F.col("_component")).otherwise(F.col("_id")).alias("component_id"),
    )
