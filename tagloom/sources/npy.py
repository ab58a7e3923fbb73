"""NumPy array files as a table: ``row_id, value`` or ``row_id, values``.

A Python data source that splits the file by row ranges. Every task maps the
file and touches only its own rows; the file must be on a file system all
executors see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS_PER_TASK = 1_000_000
ROWS_PER_BATCH = 10_000


class RowRange(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        super().__init__((start, stop))


class NpyReader(DataSourceReader):
    def __init__(self, path: str, vector: bool, rows_per_task: int) -> None:
        self.path, self.vector, self.rows_per_task = path, vector, rows_per_task

    def _map(self) -> np.ndarray:
        return np.load(self.path, mmap_mode="r", allow_pickle=False)

    def partitions(self) -> list[InputPartition]:
        rows, step = self._map().shape[0], self.rows_per_task
        return [RowRange(i, min(i + step, rows)) for i in range(0, max(rows, 1), step)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        start, stop = partition.value
        data = self._map()
        for low in range(start, stop, ROWS_PER_BATCH):
            high = min(low + ROWS_PER_BATCH, stop)
            block = np.asarray(data[low:high], dtype=np.float64)
            ids = pa.array(np.arange(low, high, dtype=np.int64))
            if self.vector:
                width = block.shape[1]
                offsets = pa.array(np.arange(0, block.size + 1, width, dtype=np.int32))
                values = pa.ListArray.from_arrays(offsets, pa.array(block.ravel()))
            else:
                values = pa.array(block)
            yield pa.RecordBatch.from_arrays([ids, values], [self._names()[0], self._names()[1]])

    def _names(self) -> tuple[str, str]:
        return "row_id", "values" if self.vector else "value"


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def _vector(self) -> bool:
        shape = np.load(self.options["path"], mmap_mode="r", allow_pickle=False).shape
        if len(shape) not in (1, 2):
            raise ValueError(f"expected a vector or a matrix, got shape {shape}")
        return len(shape) == 2

    def schema(self) -> T.StructType:
        row_id = T.StructField("row_id", T.LongType(), False)
        if self._vector():
            return T.StructType([row_id, T.StructField("values", T.ArrayType(T.DoubleType()))])
        return T.StructType([row_id, T.StructField("value", T.DoubleType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        rows = int(self.options.get("rowsPerTask", ROWS_PER_TASK))
        return NpyReader(self.options["path"], self._vector(), rows)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").load(path)


def read_scores(spark: SparkSession, run_dir: str, split: str) -> DataFrame:
    """``row_id, y, score`` of a finished detection run; both arrays needed."""
    base = run_dir.rstrip("/")
    probs = read_npy(spark, f"{base}/probs_{split}.npy").withColumnRenamed("value", "score")
    labels = read_npy(spark, f"{base}/labels_{split}.npy")
    return labels.select("row_id", labels["value"].cast("int").alias("y")).join(probs, "row_id")
