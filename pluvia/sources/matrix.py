"""Training dumps as a Spark data source: raw matrices of 32-bit little-endian floats, row by row, with a JSON sidecar.

A dump is a folder of parts, each with its sidecar (the part's name and .json: columns, and rows if known), so tasks write and
read by themselves; a lone matrix of another program is a folder of one part. Reading splits parts into byte ranges of whole
rows and turns only the columns asked for (option `columns`, comma-separated; default: all) into Arrow arrays. NaN is a value, not
NULL; on writing NULL becomes NaN.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import FloatType, StructField, StructType

#: Bytes of a partition, about, and rows of a batch.
SPLIT, BATCH = 64 << 20, 1 << 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _sidecars(path: str) -> list[tuple[str, list[str], int]]:
    """(matrix file, columns, rows) of every part; a file that isn't whole rows, or not as many as told, is an error."""
    store, root = opened(path)
    out = []
    for info in sorted(store.get_file_info(fs.FileSelector(root, recursive=False)), key=lambda i: i.path):
        if not info.path.endswith(".json"):
            continue
        with store.open_input_stream(info.path) as f:
            side = json.loads(f.read())
        data, width = info.path.removesuffix(".json"), 4 * len(side["columns"])
        size = store.get_file_info(data).size or 0
        if size % width or side.get("rows", size // width) != size // width:
            raise ValueError(f"{data}: {size} bytes, but {side.get('rows', 'whole')} rows of {len(side['columns'])} columns")
        out.append((data, side["columns"], size // width))
    if any(columns != out[0][1] for _, columns, _ in out):
        raise ValueError(f"{path}: parts of different columns")
    return out


@dataclass
class Rows(InputPartition):
    file: str
    first: int
    rows: int
    columns: list[str]


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, wanted: list[str]):
        self.path, self.wanted = path, wanted

    def partitions(self) -> list[Rows]:
        out = []
        for file, columns, rows in _sidecars(self.path):
            step = max(1, SPLIT // (4 * len(columns)))
            out += [Rows(file, at, min(step, rows - at), columns) for at in range(0, rows, step)]
        return out or [Rows("", 0, 0, [])]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        store, _ = opened(self.path)
        at, width = [partition.columns.index(c) for c in self.wanted], len(partition.columns)
        with store.open_input_file(partition.file) as f:
            f.seek(4 * width * partition.first)
            for begin in range(0, partition.rows, BATCH):
                n = min(BATCH, partition.rows - begin)
                m = np.frombuffer(f.read(4 * width * n), "<f4").reshape(n, width)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(m[:, i]), pa.float32()) for i in at], names=self.wanted)


@dataclass
class Part(WriterCommitMessage):
    file: str
    rows: int


class MatrixWriter(DataSourceArrowWriter):
    """Each task writes a part under a name of its own; only parts that were committed get a sidecar, so what a lost or
    repeated task left behind is never read."""

    def __init__(self, path: str, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite, self.run = path, columns, overwrite, uuid.uuid4().hex[:8]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        file, rows = f"{root}/part-{self.run}-{uuid.uuid4().hex}.f32", 0
        with store.open_output_stream(file) as f:
            for batch in iterator:
                columns = [batch.column(i).cast(pa.float32()).fill_null(float("nan")).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
                f.write(np.stack(columns, 1).astype("<f4").tobytes() if columns else b"")
                rows += batch.num_rows
        return Part(file, rows)

    def commit(self, messages: list[Part | None]) -> None:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        old = [i.path for i in store.get_file_info(fs.FileSelector(root)) if i.path.endswith(".json")] if self.overwrite else []
        for m in messages:
            if m is None:
                continue
            with store.open_output_stream(f"{m.file}.json") as f:
                f.write(json.dumps({"columns": self.columns, "rows": m.rows}).encode())
        for path in old:
            store.delete_file(path)
            store.delete_file(path.removesuffix(".json"))

    def abort(self, messages: list[Part | None]) -> None:
        store, _ = opened(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.file)


class MatrixSource(DataSource):
    """spark.read.format("f32matrix").option("columns", "a,b").load(path), and df.write.format("f32matrix")."""

    @classmethod
    def name(cls) -> str:
        return "f32matrix"

    def _path(self) -> str:
        return self.options["path"]

    def schema(self) -> StructType:
        found = _sidecars(self._path())
        known = found[0][1] if found else []
        asked = self.options.get("columns")
        wanted = [c.strip() for c in asked.split(",")] if asked else known
        strange = [c for c in wanted if c not in known]
        if strange:
            raise ValueError(f"{self._path()} has no columns {strange}")
        return StructType([StructField(c, FloatType()) for c in wanted])

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(self._path(), schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self._path(), schema.names, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MatrixSource)
