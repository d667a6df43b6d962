"""Hard-negative mining over an STR-packed R-tree.

The rows are packed by sort-tile-recursive order: quantiles of the coordinates
of the largest variance (fitted on a bounded sample; every row is then dealt by
them) cut the space into tiles, tiles into pages of bounded size, and a page
sorts its rows by label and the same way again into leaves. Over a leaf's rows,
minimum and maximum of each coordinate are its bounding box; with an anchor q, a
coordinate contributes between q * lo and q * hi, so a box gives an interval that
holds the inner products of all its rows. Boxes are exact over all rows, so the
sample moves work about but no result.

An anchor visits the tiles whose interval can hold a result. In a page its leaves
wait in a queue by the upper end of their interval; leaves outside the score
windows, and those strictly below the k-th best so far, are never opened. First
each anchor's positives are found (the k-th best of its home page bounds the
other pages), then the negatives of all windows that these open.

Pages travel as one row each, in a copy for every ANCHOR_BLOCK anchors, and a
task streams the anchors that visit them: a task holds one page and one batch.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quilt.llm.common import save

SAMPLE_ROWS = 8192  # that the tiles are fitted on
MAX_TILES = 1024
PAGE_ROWS, LEAF_ROWS = 2048, 64
ANCHOR_BLOCK = 65_536  # anchors that one copy of a page serves
EXACT = float(2**53)  # integers below are exact in a double
LEAST, MOST = -(2**63) + 1, 2**63 - 1


# ------------------------------------------------------------------ packing


def tile_order(x: np.ndarray) -> np.ndarray:
    """Coordinates, the one of the largest variance first."""
    return np.argsort(-x.var(axis=0), kind="stable")


def fit_tiles(x: np.ndarray, tiles: int) -> tuple:
    """A tree of cuts by sort-tile-recursive: (coordinate, cuts, children), or the
    number of a tile. Equal values never part, so there may be fewer tiles."""
    order, made = tile_order(x), [0]
    levels = max(1, min(x.shape[1], int(np.log2(max(tiles, 1)))))

    def cut(rows: np.ndarray, wanted: int, level: int):
        if wanted > 1 and level < levels and len(rows) > 1:
            slabs = int(np.ceil(wanted ** (1 / (levels - level)) - 1e-9))
            axis = int(order[level])
            cuts = np.unique(np.quantile(rows[:, axis], np.arange(1, slabs) / slabs, method="lower"))
            slab = np.searchsorted(cuts, rows[:, axis], side="left")
            rest = -(-wanted // slabs)
            return axis, cuts, [cut(rows[slab == s], rest, level + 1) for s in range(len(cuts) + 1)]
        made[0] += 1
        return made[0] - 1

    tree = cut(x, tiles, 0)
    return tree, made[0]


def tile_of(x: np.ndarray, tree) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree, np.int64)
    axis, cuts, children = tree
    slab = np.searchsorted(cuts, x[:, axis], side="left")
    out = np.zeros(len(x), np.int64)
    for s, child in enumerate(children):
        here = slab == s
        if here.any():
            out[here] = tile_of(x[here], child)
    return out


def str_order(x: np.ndarray, leaf: int) -> np.ndarray:
    """Row order of one label: sort-tile-recursive into runs of ``leaf`` rows."""
    axes = tile_order(x) if len(x) else []
    levels = max(1, min(x.shape[1], int(np.log2(max(1, len(x) // leaf)))))

    def tile(rows: np.ndarray, level: int) -> list:
        leaves = -(-len(rows) // leaf)
        if level >= levels or leaves <= 1:
            return [rows]
        rows = rows[np.argsort(x[rows, axes[level]], kind="stable")]
        slabs = int(np.ceil(leaves ** (1 / (levels - level)) - 1e-9))
        size = -(-leaves // slabs) * leaf
        return [r for i in range(0, len(rows), size) for r in tile(rows[i : i + size], level + 1)]

    return np.concatenate(tile(np.arange(len(x)), 0)) if len(x) and x.shape[1] else np.arange(len(x))


@dataclass
class Page:
    """A page's rows in leaf order, its leaves' boxes and label ranges."""

    ids: np.ndarray
    uids: np.ndarray
    labels: np.ndarray
    x: np.ndarray  # integers as doubles

    def __post_init__(self):
        self.start = np.arange(0, len(self.ids), LEAF_ROWS)
        self.end = np.append(self.start[1:], len(self.ids))
        self.lo = np.minimum.reduceat(self.x, self.start, axis=0)
        self.hi = np.maximum.reduceat(self.x, self.start, axis=0)
        self.least_label = np.minimum.reduceat(self.labels, self.start)
        self.most_label = np.maximum.reduceat(self.labels, self.start)
        self.top = float(np.abs(self.x).max(initial=0))

    @staticmethod
    def pack(ids, uids, labels, x) -> Page:
        order = np.lexsort((uids, ids, labels))
        labels = labels[order]
        edges = np.concatenate(([0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]))
        order = np.concatenate([order[a:b][str_order(x[order[a:b]], LEAF_ROWS)] for a, b in zip(edges[:-1], edges[1:])])
        return Page(ids[order], uids[order], labels, x[order])

    def blob(self) -> bytes:
        out = io.BytesIO()
        top = int(self.top)
        kind = np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.float64
        for a in (self.ids, self.uids, self.labels, self.x.astype(kind)):
            np.save(out, a, allow_pickle=False)
        return out.getvalue()

    @staticmethod
    def load(blob: bytes) -> Page:
        data = io.BytesIO(blob)
        ids, uids, labels, x = (np.load(data, allow_pickle=False) for _ in range(4))
        return Page(ids, uids, labels, x.astype(np.float64))

    def exact(self, q: np.ndarray) -> bool:
        return self.top * float(np.abs(q).max(initial=0)) * max(1, len(q)) < EXACT

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Integer inner products, held at the ends of a long."""
        if self.exact(q):
            return (self.x[rows] @ q).astype(np.int64)
        wide = [int(v) for v in q]
        return np.array([min(max(sum(int(a) * b for a, b in zip(r, wide)), LEAST), MOST) for r in self.x[rows]], np.int64)

    def search(self, q, label, uid, same, windows, k, floor=LEAST):
        """For each (least, most) score window the first ``k`` rows of the same
        label (not the anchor's own row) or of another: arrays of rows and scores."""
        fits = (self.least_label <= label) & (label <= self.most_label) if same else ~(
            (self.least_label == label) & (self.most_label == label)
        )
        bars = [max(lo, floor) for lo, _ in windows]  # below: cannot be returned
        if self.exact(q):
            up, down = np.maximum(q, 0), np.minimum(q, 0)
            high, low = self.hi @ up + self.lo @ down, self.lo @ up + self.hi @ down
        else:
            high, low = np.full(len(self.start), np.inf), np.full(len(self.start), -np.inf)
        queue = np.flatnonzero(fits)
        queue = queue[np.argsort(-high[queue], kind="stable")]
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(windows)
        at, size = 0, 2
        while at < len(queue):
            part = queue[at : at + size]
            at, size = at + size, size * 2
            open_ = np.zeros(len(part), bool)
            for bar, (_, most) in zip(bars, windows):
                open_ |= (high[part] >= bar) & (low[part] <= most)
            if not open_.any():
                if not (high[part] >= min(bars)).any():
                    break  # the rest of the queue lies lower still
                continue
            rows = np.concatenate([np.arange(self.start[i], self.end[i]) for i in part[open_]])
            keep = (self.labels[rows] == label) & (self.uids[rows] != uid) if same else self.labels[rows] != label
            rows = rows[keep]
            got = self.scores(rows, q)
            for w, (_, most) in enumerate(windows):
                inside = (got >= bars[w]) & (got <= most)
                if not inside.any():
                    continue
                r = np.concatenate((held[w][0], rows[inside]))
                s = np.concatenate((held[w][1], got[inside]))
                best = np.lexsort((self.uids[r], self.ids[r], -s))[:k]
                held[w] = r[best], s[best]
                if len(best) == k:
                    bars[w] = max(bars[w], int(s[best[-1]]))
        return held


# ------------------------------------------------------------------ the jobs


def _matrix(column: pa.Array, width: int, scale: float) -> np.ndarray:
    """Floored components as doubles; a shorter vector is filled up with zeros."""
    ends = np.asarray(column.offsets)
    flat = column.values.to_numpy(zero_copy_only=False)
    if len(column) and (np.diff(ends) == width).all():
        x = flat[ends[0] : ends[-1]].reshape(len(column), width)
    else:
        x = np.zeros((len(column), width))
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            x[i, : b - a] = flat[a:b]
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * scale), -EXACT, EXACT)


def _salt(uids: np.ndarray, salts: np.ndarray) -> np.ndarray:
    mixed = (uids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (mixed % salts.astype(np.uint64)).astype(np.int64)


_PACKED = (
    "tile bigint, page bigint, kind int, uid bigint, id bigint, label bigint, vec binary, floor bigint, "
    "blob binary, lo array<double>, hi array<double>"
)
_VISIT = "page bigint, slot int, kind int, uid bigint, id bigint, label bigint, vec binary, floor bigint, blob binary, windows array<struct<least:bigint,most:bigint>>"


def _packed(pages: DataFrame, k: int) -> DataFrame:
    """One row for each page, and one for each of its anchors with the k-th best
    score of its own page (the least long, if there are fewer)."""
    schema = pa.schema([
        ("tile", pa.int64()), ("page", pa.int64()), ("kind", pa.int32()), ("uid", pa.int64()), ("id", pa.int64()),
        ("label", pa.int64()), ("vec", pa.binary()), ("floor", pa.int64()), ("blob", pa.binary()),
        ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())),
    ])

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        arrays = [group[c].to_numpy() for c in ("id", "uid", "label")]
        width = group["width"][0].as_py()
        x = np.frombuffer(b"".join(group["vec"].to_pylist()), np.float64).reshape(len(arrays[0]), width)
        page = Page.pack(*arrays, x)
        tile, number = group["tile"][0].as_py(), group["page"][0].as_py()
        rows = [{"tile": tile, "page": number, "kind": 0, "blob": page.blob(), "lo": page.x.min(0).tolist(), "hi": page.x.max(0).tolist()}]
        for i in np.flatnonzero(group["anchor"].to_numpy(zero_copy_only=False)):
            uid, label = int(arrays[1][i]), int(arrays[2][i])
            _, s = page.search(x[i], label, uid, True, [(LEAST, MOST)], k)[0]
            rows.append({
                "tile": tile, "page": number, "kind": 1, "uid": uid, "id": int(arrays[0][i]), "label": label,
                "vec": x[i].tobytes(), "floor": int(s[-1]) if len(s) == k else LEAST,
            })
        return pa.Table.from_pylist(rows, schema)

    return pages.groupBy("page").applyInArrow(pack, _PACKED)


@dataclass
class Index:
    packed: DataFrame  # saved: pages (kind 0) and anchors (kind 1)
    lo: np.ndarray  # of each tile
    hi: np.ndarray
    first: np.ndarray  # page of each tile
    salts: np.ndarray  # pages of each tile
    copies: int
    partitions: int

    def visits(self, anchors: DataFrame) -> DataFrame:
        """The anchors, once for each page of a tile that can hold a result, and
        the pages themselves (kind 0), dealt by page and page first."""
        lo, hi, first, salts, copies = self.lo, self.hi, self.first, self.salts, self.copies

        def route(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = np.frombuffer(b"".join(batch.column("vec").to_pylist()), np.float64).reshape(batch.num_rows, lo.shape[1])
                sure = np.abs(q).max(initial=0) * max(np.abs(lo).max(initial=0), np.abs(hi).max(initial=0)) * max(1, lo.shape[1]) < EXACT
                up, down = np.maximum(q, 0), np.minimum(q, 0)
                high, low = up @ hi.T + down @ lo.T, up @ lo.T + down @ hi.T
                pages, windows = [], batch.column("windows").to_pylist()
                for i, floor in enumerate(batch.column("floor").to_pylist()):
                    least = max(floor, min(w["least"] for w in windows[i]))
                    most = max(w["most"] for w in windows[i])
                    tiles = np.flatnonzero((high[i] >= least) & (low[i] <= most)) if sure else np.arange(len(first))
                    pages.append(np.concatenate([np.arange(first[t], first[t] + salts[t]) for t in tiles] or [first[:0]]).tolist())
                slot = _salt(batch.column("uid").to_numpy(), np.full(batch.num_rows, copies)).astype(np.int32)
                columns = dict(zip(batch.schema.names, batch.columns))
                yield pa.RecordBatch.from_pydict(columns | {"slot": pa.array(slot), "pages": pa.array(pages, pa.list_(pa.int64()))})

        asked = anchors.select("uid", "id", "label", "vec", "floor", "windows").mapInArrow(
            route, "uid bigint, id bigint, label bigint, vec binary, floor bigint, "
            "windows array<struct<least:bigint,most:bigint>>, slot int, pages array<bigint>",
        )
        none = F.lit(None)
        asked = asked.select(
            F.explode("pages").alias("page"), "slot", F.lit(1).alias("kind"), "uid", "id", "label", "vec", "floor",
            none.cast("binary").alias("blob"), "windows",
        )
        held = self.packed.where("kind = 0").select(
            "page", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("slot"), F.lit(0).alias("kind"),
            *[none.cast(t).alias(c) for c, t in (("uid", "bigint"), ("id", "bigint"), ("label", "bigint"), ("vec", "binary"), ("floor", "bigint"))],
            "blob", none.cast("array<struct<least:bigint,most:bigint>>").alias("windows"),
        )
        return held.unionByName(asked).repartition(self.partitions, "page", "slot").sortWithinPartitions("page", "slot", "kind", "uid")


def _search(visits: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor uid and id, window, the row found, score): at most ``k`` of a
    window from each page."""

    def run(batches):
        at = page = None
        for batch in batches:
            keys = list(zip(batch.column("page").to_pylist(), batch.column("slot").to_pylist()))
            kinds = batch.column("kind").to_pylist()
            out: list[list] = [[] for _ in range(6)]
            for i, kind in enumerate(kinds):
                if kind == 0:
                    at, page = keys[i], batch.column("blob")[i].as_py()
                    continue
                if at != keys[i]:
                    raise RuntimeError("an anchor without its page")
                if isinstance(page, bytes):
                    page = Page.load(page)
                q = np.frombuffer(batch.column("vec")[i].as_py(), np.float64)
                uid, label = batch.column("uid")[i].as_py(), batch.column("label")[i].as_py()
                windows = [(w["least"], w["most"]) for w in batch.column("windows")[i].as_py()]
                found = page.search(q, label, uid, same, windows, k, batch.column("floor")[i].as_py())
                for w, (rows, scores) in enumerate(found):
                    if len(rows):
                        n = len(rows)
                        for list_, values in zip(out, ([uid] * n, [batch.column("id")[i].as_py()] * n, [w] * n, page.ids[rows].tolist(), page.uids[rows].tolist(), scores.tolist())):
                            list_.extend(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["uid", "id", "w", "found", "found_uid", "score"],
            )

    found = visits.mapInArrow(run, "uid bigint, id bigint, w int, found bigint, found_uid bigint, score bigint")
    order = Window.partitionBy("uid", "w").orderBy(F.desc("score"), "found", "found_uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    table: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5,
    share: tuple[int, int] = (80, 100), scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components are floored after multiplying by ``scale``; a score is the integer
    inner product. An anchor's positives are its first ``positives`` other rows
    of its label, by score, then smaller id; for each, the first ``negatives``
    rows of other labels whose score is at least the share of the positive's
    score and at most that score (rank from 1; a positive without any is left
    out). Exact.

    Rows with a null id, label or vector, or with a null or non-finite component,
    take no part. Rows that repeat an id are rows of their own: each may be an
    anchor, and they may be each other's positives. A vector shorter than the
    longest counts as filled up with zeros. Floored components are held within
    2^53 and scores within a long. Equal vectors and hot labels spread over pages
    of bounded size. An empty table gives an empty result; other columns are not
    read."""
    num, den = share
    vector = F.col(vector_col).cast("array<double>")
    wrong = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (
        table.select(
            F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"),
            F.coalesce(is_anchor, F.lit(False)).alias("anchor"), vector.alias("_v"),
        )
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("_v").isNotNull() & ~wrong)
        .withColumn("uid", F.monotonically_increasing_id())
    )
    rows = save(rows)  # the numbers above stay as they are
    spark = table.sparkSession
    n, anchors, width = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("anchor"), 1)), F.max(F.size("_v"))).first()
    if not n or not anchors:
        return spark.createDataFrame(
            [], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        )
    drawn = rows.where(F.pmod(F.xxhash64("uid"), F.lit(-(-n // SAMPLE_ROWS))) == 0).limit(2 * SAMPLE_ROWS)
    sample = pa.array([r[0] for r in drawn.select("_v").collect()] or [[0.0] * width], pa.list_(pa.float64()))
    tree, tiles = fit_tiles(_matrix(sample, width, scale), min(MAX_TILES, -(-n // PAGE_ROWS)))

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("_v"), width, scale)
                columns = {c: batch.column(c) for c in ("id", "uid", "label", "anchor")}
                yield pa.RecordBatch.from_pydict(columns | {
                    "tile": pa.array(tile_of(x, tree)), "width": pa.array(np.full(len(x), width, np.int32)),
                    "vec": pa.array([r.tobytes() for r in x], pa.binary()),
                })

    dealt = rows.mapInArrow(deal, "id bigint, uid bigint, label bigint, anchor boolean, tile bigint, width int, vec binary")
    sizes = np.zeros(tiles, np.int64)
    for tile, size in dealt.groupBy("tile").count().collect():  # at most MAX_TILES and rounding
        sizes[tile] = size
    salts = np.maximum(1, -(-sizes // PAGE_ROWS))
    first = np.concatenate(([0], np.cumsum(salts)[:-1]))

    def page_of(batches):
        for batch in batches:
            if batch.num_rows:
                tile = batch.column("tile").to_numpy()
                page = first[tile] + _salt(batch.column("uid").to_numpy(), salts[tile])
                yield pa.RecordBatch.from_pydict(dict(zip(batch.schema.names, batch.columns)) | {"page": pa.array(page)})

    pages = int(salts.sum())
    parallel = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    paged = dealt.mapInArrow(page_of, "id bigint, uid bigint, label bigint, anchor boolean, tile bigint, width int, vec binary, page bigint")
    packed = save(_packed(paged.repartition(min(pages, 8 * parallel), "page"), positives))
    lo, hi = np.full((tiles, width), 0.0), np.full((tiles, width), 0.0)
    ends = (
        packed.where("kind = 0").select("tile", F.posexplode(F.arrays_zip("lo", "hi")).alias("at", "b"))
        .groupBy("tile", "at").agg(F.min("b.lo").alias("lo"), F.max("b.hi").alias("hi"))
    )
    for tile, at, a, b in ends.collect():  # tiles x width
        lo[tile, at], hi[tile, at] = a, b
    copies = -(-anchors // ANCHOR_BLOCK)
    index = Index(packed, lo, hi, first, salts, copies, min(pages * copies, 8 * parallel))

    everything = F.array(F.struct(F.lit(LEAST).alias("least"), F.lit(MOST).alias("most")))
    asks = packed.where("kind = 1").select("uid", "id", "label", "vec", "floor")
    near = save(_search(index.visits(asks.withColumn("windows", everything)), True, positives).select(
        "uid", F.col("rank").alias("p"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")
    ))
    # least score with den * score >= num * positive score, in whole numbers
    whole = F.col("positive_score").cast("decimal(38,0)") * num
    least = F.ceil(whole / F.lit(den).cast("decimal(10,0)")).cast("bigint")
    windows = near.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("p", least.alias("least"), F.col("positive_score").alias("most")))).alias("all"))
    windows = windows.select("uid", F.transform("all", lambda w: F.struct(w["least"].alias("least"), w["most"].alias("most"))).alias("windows"))
    asks = asks.join(windows, "uid").withColumn("floor", F.lit(LEAST))
    found = _search(index.visits(asks), False, negatives)
    return found.withColumn("p", F.col("w") + 1).join(near, ["uid", "p"]).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
