"""Exact column picking, tables in the shared folder, and slices of Arrow text columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorium.session import shared_folder

#: Most bytes of text that a task works on at once; a longer single row is one slice.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """``new=old`` columns by exact name, whatever other columns there are."""
    columns = df.columns
    lost = [old for old in names.values() if old not in columns]
    if lost:
        raise ValueError(f"no column {lost[0]!r} among {columns}")
    plain = df.toDF(*[f"_{i}" for i in range(len(columns))])
    return plain.select(*[F.col(f"_{columns.index(old)}").alias(new) for new, old in names.items()])


class Scratch:
    """Tables written to the folder that driver and executors share.

    They outlive lost executors; ``drop`` removes those that nothing reads any more.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.made = 0

    def keep(self, df: DataFrame, **options: str) -> DataFrame:
        path = f"{self.folder}/{self.made}"
        self.made += 1
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        context = self.spark.sparkContext
        for df in frames:
            path = context._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and len + 1 row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``size`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_bytes(batch.column(column))[1][1:]
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
