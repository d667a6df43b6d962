"""Topics of texts, learnt from the texts: spherical k-means over their words.

A text is the counts of its words, dampened by their square root and hashed to
WIDTH columns, each weighted by how few texts hold it, at length 1. Weights and
centres are learnt from every text with words: the vectors are written before, and
each round is one job over their files, of which a sum per centre and column comes back.
Vectors of length 1 are whole numbers of 1 / UNIT, so that products and sums are
exact and no result depends on how the rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilt.llm.common import SLICE_ROWS, file_system, save_files, shared_folder, slices
from quilt.llm.shingles import mix, word_hashes

WIDTH = 512
UNIT = 2048  # (products of two vectors stay below 2^24, exact in float32)
BLOCK = 8  # vectors of one row of the table that the rounds read
ROUNDS = 25
CHARS = 1 << 18  # of texts hashed at a time (a longer one by itself): some 40 bytes of arrays for each
EMPTY = "empty"  # the topic of a text without words


def word_counts(texts: list[str | None]) -> np.ndarray:
    """A row of hashed word counts for each text."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < CHARS):
            size += len(texts[j] or "")
            j += 1
        h, n = word_hashes([t or "" for t in texts[i:j]])
        at = np.repeat(np.arange(j - i), n) * WIDTH + (mix(h, 61) % np.uint64(WIDTH)).astype(np.int64)
        out[i:j] = np.bincount(at, minlength=(j - i) * WIDTH).reshape(j - i, WIDTH)
        i = j
    return out


def packed(texts: list[str | None]) -> pa.Array:
    """The dampened counts of each text, as half floats; null without words."""
    x = np.sqrt(word_counts(texts)).astype(np.float16)
    return pa.array([row.tobytes() if some else None for row, some in zip(x, x.any(axis=1))], pa.binary())


def _values(column: pa.Array, kind: type) -> np.ndarray:
    """The vectors of a column of binary values without nulls, read where they lie."""
    _, ends, data = column.buffers()
    kept = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[kept[0] : kept[-1]].view(kind).reshape(-1, WIDTH).astype(np.float32)


def _unpacked(column: pa.Array) -> np.ndarray:
    return _values(column, np.float16)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, in whole numbers of 1 / UNIT."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.rint(np.divide(x, norm, out=np.zeros_like(x), where=norm > 0) * UNIT).astype(np.float32)


@dataclass
class Topics:
    weight: np.ndarray  # of each column
    centres: np.ndarray

    def of(self, texts: list[str | None]) -> list[str]:
        return self.of_packed(packed(texts))

    def of_packed(self, column: pa.Array) -> list[str]:
        out, some = np.full(len(column), EMPTY, object), np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        if len(some) and len(self.centres):
            near = np.argmax(_unit(_unpacked(column.drop_null()) * self.weight) @ self.centres.T, axis=1)
            out[some] = [f"topic{t}" for t in near.tolist()]
        return out.tolist()


def with_topic(rows: DataFrame, topics: Topics, column: str = "_vec") -> DataFrame:
    """``rows`` with ``topic`` in place of the packed vector."""
    names = [c for c in rows.columns if c != column]

    def run(batches):
        for batch in slices(batches):
            topic = pa.array(topics.of_packed(batch.column(column)), pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], topic], [*names, "topic"])

    out = rows.select(*names, F.lit(None).cast("string").alias("topic"))
    return rows.mapInArrow(run, out.schema)


#: what a task makes of the rows it is given: some vectors at a time
Read = Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in slices(batches, SLICE_ROWS // BLOCK):
        if batch.num_rows:
            yield _unpacked(batch.column(0))


def _in_files(units: DataFrame) -> tuple[DataFrame, Read]:
    """``units`` written to files, as one row a file, and what reads the vectors of
    such rows. The rounds are many: the tasks take the vectors from the shared
    folder, which costs a part of passing them through the executor each time."""
    spark, path = units.sparkSession, shared_folder(units.sparkSession, "units")
    units.write.parquet(path)
    files, root = file_system(path)
    names = sorted(f.path for f in files.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        files, _ = file_system(path)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                with files.open_input_file(names[k]) as f:
                    for some in pq.ParquetFile(f).iter_batches(SLICE_ROWS // BLOCK, use_threads=False):
                        if some.num_rows:
                            yield _units(some.column(0))

    return spark.range(0, len(names), 1, max(1, len(names))), read


def _sums(rows: DataFrame, read: Read, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all vectors of ``part`` (of some vectors: ``size`` whole numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for x in read(batches):
            total += part(x).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "v": pa.array(total[at])})

    out = np.zeros(size, np.int64)
    for at, v in rows.mapInArrow(run, "at int, v bigint").groupBy("at").agg(F.sum("v")).collect():
        out[at] = v
    return out


def _units(column: pa.Array) -> np.ndarray:
    return _values(column, np.int16)


def _most(rows: DataFrame, read: Read, score: Callable[[np.ndarray], np.ndarray]) -> tuple[int, np.ndarray]:
    """The largest score, and the vector that has it (of several the last in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for x in read(batches):
            s = score(x)
            if best is None or s.max() >= best[0]:
                top = max(row.tobytes() for row in np.unique(x[s == s.max()], axis=0).astype(">i2"))
                best = max(best or (-1, b""), (int(s.max()), top))
        if best:
            yield pa.RecordBatch.from_pydict({"s": pa.array([best[0]], pa.int64()), "x": pa.array([best[1]], pa.binary())})

    m = rows.mapInArrow(run, "s bigint, x binary").agg(F.max(F.struct("s", "x")).alias("m")).first()["m"]
    return m["s"], np.frombuffer(bytes(m["x"]), ">i2").astype(np.float32)


def fit_packed(rows: DataFrame, k: int = 8, column: str = "_vec") -> Topics:
    """Weights and centres from the packed vectors of all rows: each first centre
    the farthest from those before, then rounds of means until none moves."""
    vectors = rows.select(column).where(F.col(column).isNotNull())
    held = _sums(vectors, _halves, lambda x: np.append((x > 0).sum(axis=0), len(x)), WIDTH + 1)
    n = int(held[-1])
    # (a word of every text still counts a little)
    weight = (np.log((n + 1) / (held[:-1] + 1)) + 0.1).astype(np.float32)
    if not n:
        return Topics(weight, np.zeros((0, WIDTH), np.float32))

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = _unit(_unpacked(batch.column(0)) * weight).astype(np.int16)
            yield pa.RecordBatch.from_arrays([pa.array([x[i : i + BLOCK].tobytes() for i in range(0, len(x), BLOCK)], pa.binary())], ["x"])

    units, read = _in_files(vectors.mapInArrow(weighted, "x binary"))
    middle = _unit(_sums(units, read, lambda x: x.sum(axis=0), WIDTH).astype(float)[None])[0]
    centres = _most(units, read, lambda x: x @ middle)[1][None]
    while len(centres) < min(k, n):

        def apart(x: np.ndarray, c=centres) -> np.ndarray:
            return ((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (x @ c.T)).min(axis=1)

        far, x = _most(units, read, apart)
        if not far:
            break  # every text stands on a centre
        centres = np.concatenate((centres, x[None]))
    before = None
    for _ in range(ROUNDS):

        def means(x: np.ndarray, c=centres) -> np.ndarray:
            own = np.argmax(x @ c.T, axis=1)
            return ((own == np.arange(len(c))[:, None]).astype(np.float32) @ x).ravel()

        sums = _sums(units, read, means, centres.size).reshape(centres.shape)
        if before is not None and (sums == before).all():
            break
        before = sums
        centres = np.where(sums.any(axis=1)[:, None], _unit(sums.astype(float)), centres)
    return Topics(weight, centres)


def fit_topics(docs: DataFrame, k: int = 8, text_col: str = "text") -> Topics:
    """Topics learnt from every text of ``docs``."""

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([packed(batch.column(0).to_pylist())], ["_vec"])

    return fit_packed(save_files(docs.select(text_col).mapInArrow(run, "_vec binary"), "topics"), k)
