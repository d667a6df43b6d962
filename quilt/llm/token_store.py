"""Token ids in binary shards, with a minimal perfect hash index by document.

Files of a store, all in one folder of a store that every executor reaches:

* ``shard-NNNNN.ids``: the ids of its documents one after the other, raw, as
  little-endian unsigned 16- or 32-bit integers (16 where the vocabulary
  allows); then a footer: for each document the place of its first id (and the
  end) as 64-bit integers, the number of documents, and 8 bytes of magic.
  Shards hold documents in ascending order of id, shard after shard;
* ``index-NNNNN.npz``: the keys of one bucket (by a hash of the id). Each key is
  an edge of three vertices of a random 3-partite hypergraph that can be peeled;
  a byte a vertex tells which of its three a key owns, and an 8-byte rank of that
  vertex is the key's slot: 0 to n - 1, no gaps, nothing else stored of the key
  but a 32-bit fingerprint. The slot holds the document's first row and its
  number of rows. A look-up reads one bucket, three bits fields and one slot;
* ``manifest.json``: id width, number of buckets, and for every shard its rows
  and ids and those before it.

Tasks write under a name of their own attempt and rename, so a repeated task
replaces a file by the same bytes.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import asdict, dataclass
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quilt.llm.common import file_system, map_batches, save, shared_folder, utf8
from quilt.llm.shingles import mix
from quilt.llm.tokens import encoder

MAGIC = b"QTOKIDS1"
SHARD_TEXT_BYTES = 32 << 20  # of text in a shard, about
KEYS_PER_BUCKET = 100_000  # about
READ_AHEAD = 4 << 20


def _publish(files: fs.FileSystem, root: str, name: str, attempt: int, data: bytes) -> None:
    own = f"{root}/_{name}.{attempt}"
    with files.open_output_stream(own) as out:
        out.write(data)
    files.move(own, f"{root}/{name}")


@dataclass
class TokenStore:
    folder: str
    width: int
    n_buckets: int
    #: [shard, rows before, rows, ids before, ids] in order
    shards: list[list[int]]

    @property
    def n_rows(self) -> int:
        return sum(s[2] for s in self.shards)


def open_store(folder: str) -> TokenStore:
    files, root = file_system(folder)
    with files.open_input_stream(f"{root}/manifest.json") as f:
        return TokenStore(folder=folder, **json.loads(f.read()))


def _key(column: str):
    """128 bits of the id; a null id is a key as well."""
    told = F.coalesce(F.concat(F.lit("v"), F.col(column).cast("string")), F.lit("null"))
    return [F.xxhash64(told, F.lit(1)).alias("_k1"), F.xxhash64(told, F.lit(2)).alias("_k2")]


def _bucket(n: int):
    return F.pmod(F.xxhash64("_k1", "_k2"), F.lit(n)).cast("int").alias("_bucket")


# --- minimal perfect hashing ---------------------------------------------------


def _vertices(k1: np.ndarray, k2: np.ndarray, seed: int, part: int) -> np.ndarray:
    """The three vertices of each key, one in each third of the table."""
    a = mix(k1.view(np.uint64) ^ mix(k2.view(np.uint64), seed), seed)
    out = [((mix(a, 31 + j) >> np.uint64(32)) * np.uint64(part) >> np.uint64(32)).astype(np.int64) + j * part for j in range(3)]
    return np.stack(out, 1)


def build_mph(k1: np.ndarray, k2: np.ndarray) -> dict[str, np.ndarray]:
    """A minimal perfect hash function of the (distinct) keys."""
    n = len(k1)
    part = int(np.ceil(1.23 * n / 3)) + 2
    for seed in range(1, 1000):
        v = _vertices(k1, k2, seed, part)
        flat, edge = v.ravel(), np.repeat(np.arange(n), 3)
        degree = np.bincount(flat, minlength=3 * part)
        held = np.zeros(3 * part, np.int64)  # xor of a vertex's edges
        np.bitwise_xor.at(held, flat, edge)
        layers, left = [], n
        while left:
            free = np.flatnonzero(degree == 1)
            if not len(free):
                break
            edges, at = np.unique(held[free], return_index=True)
            layers.append((edges, free[at]))
            ends = v[edges].ravel()
            np.subtract.at(degree, ends, 1)
            np.bitwise_xor.at(held, ends, np.repeat(edges, 3))
            left -= len(edges)
        if left:
            continue
        which = np.zeros(3 * part, np.uint8)
        used = np.zeros(3 * part, bool)
        for edges, own in reversed(layers):
            ends = v[edges]
            others = which[ends].astype(np.int64).sum(1) - which[own]
            which[own] = (own // part - others) % 3
            used[own] = True
        return {"seed": np.int64(seed), "part": np.int64(part), "which": which, "rank": np.cumsum(used) - used}
    raise RuntimeError("no seed makes the keys peelable")


def mph_slots(mph, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """The slot of each key; keys that were not built in get an arbitrary one."""
    v = _vertices(k1, k2, int(mph["seed"]), int(mph["part"]))
    j = mph["which"][v].astype(np.int64).sum(1) % 3
    n = int(mph["rank"][-1]) + 1
    return np.minimum(mph["rank"][v[np.arange(len(v)), j]], n - 1)


def _fingerprint(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    return (mix(k1.view(np.uint64) + mix(k2.view(np.uint64), 77), 78) >> np.uint64(32)).astype(np.uint32)


def _runs(batches, key: str):
    """(key, table) for the runs of equal keys of sorted batches."""
    held, now = [], None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else []
        for a, b in zip(edges, [*edges[1:], len(keys)], strict=True):
            if held and keys[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


# --- writing -------------------------------------------------------------------


def write_store(
    docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    folder: str | None = None,
) -> TokenStore:
    """Encode every whole text of ``docs``, append ``end_id``, and write the
    store to ``folder`` (a fresh one under spark.checkpoint.dir if not given).

    Null and empty texts hold the end id alone. Rows that repeat an id lie next
    to each other and are found together; a null id is a key too and comes
    first; long texts are encoded whole and lie in one shard. An empty table gives
    a store without shards. Other columns are not read."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-store")
    files, root = file_system(folder)
    files.create_dir(root, recursive=True)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*_key(id_col), F.col(id_col).alias("_id"), text.alias("_text"))
    total = rows.agg(F.sum(F.octet_length(utf8(F.col("_text"))) + 1)).first()[0] or 0
    width = 2 if max(encoder(tokenizer).vocabulary, end_id + 1) <= 1 << 16 else 4
    end = end_id.to_bytes(width, "little")

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        files, root = file_system(folder)
        own, out, places = f"{root}/_shard-{shard}.{attempt}", None, [0]
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or files.open_output_stream(own)
            first, counts = len(places) - 1, []
            for ids in encoder(tokenizer).encode(batch.column("_text").to_pylist()):
                if width == 2:
                    ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
                out.write(ids + end)
                counts.append(len(ids) // width + 1)
                places.append(places[-1] + counts[-1])
            n = batch.num_rows
            yield pa.RecordBatch.from_pydict({
                "_k1": batch.column("_k1"), "_k2": batch.column("_k2"),
                "_shard": pa.array(np.full(n, shard, np.int32)),
                "_row": pa.array(np.arange(first, first + n, dtype=np.int64)), "_n": pa.array(counts, pa.int64()),
            })
        if out is not None:
            out.write(np.array(places, "<i8").tobytes() + np.array([len(places) - 1], "<i8").tobytes() + MAGIC)
            out.close()
            files.move(own, f"{root}/shard-{shard:05d}.ids")

    order = ["_id", F.xxhash64("_text")]
    entries = save(
        rows.repartitionByRange(max(1, -(-total // SHARD_TEXT_BYTES)), *order).sortWithinPartitions(*order)
        .select("_k1", "_k2", "_text")
        .mapInArrow(write, "_k1 bigint, _k2 bigint, _shard int, _row bigint, _n bigint")
    )
    shards, rows_before, ids_before = [], 0, 0
    sums = entries.groupBy("_shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("_n").alias("ids"))
    for s in sorted(sums.collect()):  # one row per shard
        shards.append([s[0], rows_before, s[1], ids_before, s[2]])
        rows_before, ids_before = rows_before + s[1], ids_before + s[2]
    n_buckets = max(1, -(-rows_before // KEYS_PER_BUCKET))
    store = TokenStore(folder, width, n_buckets, shards)
    _write_index(entries, store)
    told = {k: v for k, v in asdict(store).items() if k != "folder"}
    _publish(files, root, "manifest.json", 0, json.dumps(told).encode())
    return store


def _write_index(entries: DataFrame, store: TokenStore) -> None:
    folder, before = store.folder, {s[0]: s[1] for s in store.shards}

    def build(batches):
        from pyspark import TaskContext

        files, root = file_system(folder)
        for bucket, t in _runs(batches, "_bucket"):
            k1, k2, first, rows = (t[c].to_numpy() for c in ("_k1", "_k2", "_first", "_rows"))
            start = np.array([before[x] for x in first >> 40], np.int64) + (first & ((1 << 40) - 1))
            mph = build_mph(k1, k2)
            slot = mph_slots(mph, k1, k2)
            by_slot = np.argsort(slot)
            out = BytesIO()
            np.savez(out, **mph, mark=_fingerprint(k1, k2)[by_slot], first=start[by_slot], rows=rows[by_slot])
            _publish(files, root, f"index-{bucket:05d}.npz", TaskContext.get().taskAttemptId(), out.getvalue())
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "keys": pa.array([len(k1)], pa.int64())})

    place = F.shiftleft(F.col("_shard").cast("long"), 40) + F.col("_row")
    keys = entries.groupBy("_k1", "_k2").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    save(
        keys.withColumn("_bucket", _bucket(store.n_buckets)).repartition(store.n_buckets, "_bucket")
        .sortWithinPartitions("_bucket").mapInArrow(build, "bucket int, keys bigint")
    )


# --- reading -------------------------------------------------------------------


class _Shard:
    """One open shard file, read ahead."""

    def __init__(self, files, root: str, shard: int, width: int):
        self.file = files.open_input_file(f"{root}/shard-{shard:05d}.ids")
        self.width = width
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"shard {shard} is not complete")
        n = int(np.frombuffer(tail[:8], "<i8")[0])
        self.places = np.frombuffer(self.file.read_at(8 * (n + 1), size - 16 - 8 * (n + 1)), "<i8")
        self.at, self.buffer = 0, b""

    def row(self, i: int) -> bytes:
        a, b = int(self.places[i]) * self.width, int(self.places[i + 1]) * self.width
        if not self.at <= a <= b <= self.at + len(self.buffer):
            end = int(self.places[-1]) * self.width
            self.at, self.buffer = a, self.file.read_at(min(max(b - a, READ_AHEAD), end - a), a)
        return self.buffer[a - self.at : b - self.at]


def read_documents(
    spark: SparkSession, store: TokenStore, keys: DataFrame, id_col: str = "doc_id", with_ids: bool = False,
) -> DataFrame:
    """For every distinct id of ``keys`` that the store holds, each of its rows:
    the id, ``start`` (ids of all documents before), ``n_tokens``, ``ids_crc32``
    and, with ``with_ids``, the ``ids`` as little-endian unsigned 32-bit
    integers. Ids that the store does not hold give no row (an unknown id passes
    the fingerprint with a chance of 2**-32)."""
    folder, width, shards = store.folder, store.width, np.array(store.shards, np.int64).reshape(-1, 5)
    wanted = keys.select(F.col(id_col).alias("_id")).distinct().select("_id", *_key("_id"))
    kind = wanted.schema["_id"].dataType.simpleString()

    def look_up(batches):
        files, root = file_system(folder)
        for bucket, t in _runs(batches, "_bucket"):
            name = f"{root}/index-{bucket:05d}.npz"
            if files.get_file_info(name).type == fs.FileType.NotFound:
                continue
            with files.open_input_stream(name) as f:
                index = dict(np.load(BytesIO(f.read()), allow_pickle=False))
            k1, k2 = t["_k1"].to_numpy(), t["_k2"].to_numpy()
            slot = mph_slots(index, k1, k2)
            hit = np.flatnonzero(index["mark"][slot] == _fingerprint(k1, k2))
            at, shard, lo, hi = [], [], [], []
            for i in hit.tolist():
                a, b = int(index["first"][slot[i]]), int(index["first"][slot[i]] + index["rows"][slot[i]])
                s = int(np.searchsorted(shards[:, 1], a, "right")) - 1
                while a < b:  # rows of one id may go on in the next shard
                    upto = min(b, int(shards[s, 1] + shards[s, 2]))
                    at.append(i)
                    shard.append(int(shards[s, 0]))
                    lo.append(a - int(shards[s, 1]))
                    hi.append(upto - int(shards[s, 1]))
                    a, s = upto, s + 1
            ids = t["_id"].combine_chunks()
            yield pa.RecordBatch.from_pydict({
                "_id": ids.take(pa.array(at, pa.int64())), "_shard": pa.array(shard, pa.int32()),
                "_lo": pa.array(lo, pa.int64()), "_hi": pa.array(hi, pa.int64()),
            })

    places = (
        wanted.withColumn("_bucket", _bucket(store.n_buckets)).repartition(store.n_buckets, "_bucket")
        .sortWithinPartitions("_bucket").mapInArrow(look_up, f"_id {kind}, _shard int, _lo bigint, _hi bigint")
    )
    before = {int(s[0]): int(s[3]) for s in shards}

    def read(batches):
        files, root = file_system(folder)
        now, shard = None, None
        for batch in batches:
            at, start, n, crc, payload = [], [], [], [], []
            told = [batch.column(c).to_pylist() for c in ("_shard", "_lo", "_hi")]
            for i, (s, lo, hi) in enumerate(zip(*told, strict=True)):
                if s != now:
                    now, shard = s, _Shard(files, root, s, width)
                for row in range(lo, hi):
                    ids = shard.row(row)
                    if width == 2:
                        ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                    at.append(i)
                    start.append(before[s] + int(shard.places[row]))
                    n.append(len(ids) // 4)
                    crc.append(zlib.crc32(ids))
                    if with_ids:
                        payload.append(ids)
            out = {
                "_id": batch.column("_id").take(pa.array(at, pa.int64())), "start": pa.array(start, pa.int64()),
                "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(payload, pa.binary())} if with_ids else {}))

    got = (
        places.repartition(max(1, len(shards)), "_shard").sortWithinPartitions("_shard", "_lo")
        .mapInArrow(read, f"_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint{', ids binary' if with_ids else ''}")
    )
    return got.withColumnRenamed("_id", id_col)
