"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quilt.session import cut_lineage, ensure_checkpoint_dir

# A table of ids may be broadcast up to this size of its values (a hash table of
# it takes about twice as much in an executor); beyond it the join is shuffled.
BROADCAST_BYTES = 64 << 20
TEXT_BYTES = 80  # of a string or binary value, as counted

SLICE_ROWS = 1024


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame) -> DataFrame:
    """Compute once into ``spark.checkpoint.dir`` and read from there: cuts the
    lineage and survives the loss of an executor."""
    return cut_lineage(df)


def let_go(spark: SparkSession) -> None:
    """Shuffle files and checkpoints that no table refers to any more leave the disks
    when the driver collects garbage, which may be long after: ask for it now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name under ``spark.checkpoint.dir``."""
    import uuid

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save_files(df: DataFrame, name: str) -> DataFrame:
    """As ``save``, in Parquet: for rows that compress well and are read many times."""
    return _written(df, shared_folder(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder as Spark names it."""
    if not re.match(r"^[a-z0-9+.-]+:", folder):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def save_arrays(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], list[np.ndarray]]]:
    """As ``save_files``, for a table of longs, and what reads it inside a task: its
    columns as arrays, in the order of the first. Tasks take them from the shared
    folder, so that nothing of them passes through the driver."""
    path, names = shared_folder(df.sparkSession, name), df.columns

    def read() -> list[np.ndarray]:
        files, root = file_system(path)
        source = dataset.dataset(root, pa.schema([(c, pa.int64()) for c in names]), format="parquet", filesystem=files)
        table = source.to_table(use_threads=False)
        order = np.argsort(table[names[0]].to_numpy())
        out = [table[c].to_numpy()[order] for c in names]
        del table
        pa.default_memory_pool().release_unused()
        return out

    return _written(df, path), read


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: str
) -> DataFrame:
    """``fn`` over Arrow batches, cut to SLICE_ROWS rows, so that what a worker
    holds beside a batch is a small part of it; no rows, no call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = fn(batch)
            if out is not None:
                yield pa.RecordBatch.from_pydict(out) if isinstance(out, dict) else out

    return df.mapInArrow(run, schema)


def row_bytes(kind: T.DataType) -> int:
    """Bytes of a value of fixed-size fields and short texts, roughly."""
    if isinstance(kind, T.StructType):
        return sum(row_bytes(f.dataType) for f in kind) + 8
    return TEXT_BYTES if isinstance(kind, (T.StringType, T.BinaryType)) else 8


def join_ids(left: DataFrame, ids: DataFrame, on: list[str], n_ids: int, how: str = "inner") -> DataFrame:
    """Join with a table of ids whose row count is known: broadcast when its bytes
    are few, otherwise a shuffled join (AQE splits hot keys)."""
    small = n_ids * row_bytes(ids.schema) <= BROADCAST_BYTES
    return left.join(F.broadcast(ids) if small else ids, on, how)


def running_offsets(parts: DataFrame, key: str, size: str, out: str) -> DataFrame:
    """Sum of ``size`` over the rows before, in the order of ``key``. ``parts``
    has one row per partition, shard or cell (never one per document)."""
    from pyspark.sql import Window

    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(out, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def prefix_sums(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``rows`` with the sums over the rows before, in ``order`` (``sums``: name of
    the sum to the column summed). Rows are range-
    partitioned and summed inside each partition, then shifted by the partitions
    before: no task sees more than its range."""
    from pyspark.sql import Window

    ranged = save(rows.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    own = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_pid").agg(*[F.sum(c).alias(f"_s_{name}") for name, c in sums.items()])
    shift = parts.select("_pid", *[F.coalesce(F.sum(f"_s_{name}").over(before), F.lit(0)).alias(f"_b_{name}") for name in sums])
    out = ranged.withColumns({f"_o_{name}": F.coalesce(F.sum(c).over(own), F.lit(0)) for name, c in sums.items()})
    out = out.join(F.broadcast(shift), "_pid")  # a row per partition
    return out.select(*rows.columns, *[(F.col(f"_o_{name}") + F.col(f"_b_{name}")).alias(name) for name in sums])


def utf8(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")
