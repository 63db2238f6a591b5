"""Arrow IPC files of vectors (id, vector) as a Spark data source named ``arrow_vectors``.

Reading makes one partition per record batch; writing makes one file per task.  Paths are local or mounted;
on other stores read Parquet.
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "id long, vector array<float>"
_ARROW = pa.schema([("id", pa.uint64()), ("vector", pa.list_(pa.float32()))])


class _Part(InputPartition):
    def __init__(self, path: str, batch: int):
        self.path, self.batch = path, batch


def files_of(path: str) -> list[str]:
    return sorted(glob.glob(f"{path}/*.arrow")) if os.path.isdir(path) else [path]


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        out = []
        for f in files_of(self.path):
            with pa.memory_map(f) as source:
                out += [_Part(f, i) for i in range(pa.ipc.open_file(source).num_record_batches)]
        return out

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        with pa.memory_map(partition.path) as source:
            b = pa.ipc.open_file(source).get_batch(partition.batch)
            ids = b.column(0)
            if pa.types.is_unsigned_integer(ids.type) and len(ids) and pa.compute.max(ids).as_py() >= 1 << 63:
                raise ValueError("ids of 2^63 and more do not fit a signed long")
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), b.column(1).cast(pa.list_(pa.float32()))], ["id", "vector"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        with pa.OSFile(f"{self.path}/part-{uuid.uuid4().hex}.arrow", "wb") as sink, pa.ipc.new_file(sink, _ARROW) as out:
            for b in iterator:
                out.write_batch(pa.RecordBatch.from_arrays([b.column(0).cast(pa.uint64()), b.column(1).cast(pa.list_(pa.float32()))], schema=_ARROW))
        return WriterCommitMessage()


class ArrowVectors(DataSource):
    """spark.dataSource.register(ArrowVectors), then format("arrow_vectors") with option path."""

    @classmethod
    def name(cls) -> str:
        return "arrow_vectors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)
