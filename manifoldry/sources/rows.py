"""Rows of unsigned bytes as a data source of Spark's: batches and streams, read by ranges of rows, so a file of any size is many tasks.

    spark.dataSource.register(ByteRows)
    spark.read.format("byterows").option("path", folder).option("features", 784).load()        # id long, x array<double>
    spark.readStream.format("byterows").option("path", folder).option("features", 784).load()
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "id long, x array<double>"
#: Bytes that a task reads, and rows of a batch.
PART, BATCH = 32 << 20, 4096


def row_batch(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x, dtype=np.float64).ravel()))], names=["id", "x"])


class Range(InputPartition):
    """Rows first to first + n of a file, numbered from `number`."""

    def __init__(self, path: str, first: int, n: int, number: int):
        self.path, self.first, self.n, self.number = path, first, n, number


class _Files:
    """The files under a path, in order of their names, each of whole rows; a growing one counts as far as its last whole row."""

    def __init__(self, options: dict, growing: bool):
        self.features = int(options["features"])
        self.part = max(1, int(options.get("part", PART)) // self.features)
        fs, root = self.open(options["path"])
        found = fs.get_file_info(root)
        files = [found] if found.is_file else fs.get_file_info(pyarrow.fs.FileSelector(root))
        self.scheme = options["path"].split("://")[0] + "://" if "://" in options["path"] else ""
        self.files = sorted((f.path, f.size) for f in files if f.is_file and not f.base_name.startswith((".", "_")))
        if not growing and any(size % self.features for _, size in self.files):
            raise ValueError("a file doesn't hold whole rows")

    @staticmethod
    def open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)

    def rows(self) -> int:
        return sum(size // self.features for _, size in self.files)

    def ranges(self, start: int, end: int) -> list[Range]:
        """What lies between two row numbers, in parts."""
        out, number = [], 0
        for path, size in self.files:
            n = size // self.features
            lo, hi = max(start, number), min(end, number + n)
            out += [Range(f"{self.scheme}{path}", at - number, min(self.part, hi - at), at) for at in range(lo, hi, self.part)]
            number += n
        return out


def _read(part: Range, features: int) -> Iterator[pa.RecordBatch]:
    fs, path = _Files.open(part.path)
    with fs.open_input_file(path) as f:
        f.seek(part.first * features)
        for at in range(0, part.n, BATCH):
            n = min(BATCH, part.n - at)
            raw = f.read(n * features)
            yield row_batch(part.number + at + np.arange(n), np.frombuffer(raw, dtype=np.uint8).reshape(n, features) / 255.0)


class ByteRows(DataSource):
    """(id, x): unsigned bytes, `features` a row, scaled to 0..1, numbered through the files in order of their names. `path`: a file or folder that the driver and all executors reach. `part`: bytes a task."""

    @classmethod
    def name(cls) -> str:
        return "byterows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.features = options, int(options["features"])

    def partitions(self) -> Sequence[InputPartition]:
        files = _Files(self.options, False)
        # a source of no rows still has a task
        return files.ranges(0, files.rows()) or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.n:
            yield from _read(partition, self.features)


class _StreamReader(DataSourceStreamReader):
    """The offset is how many rows were read. New files must come after the old ones in order of names, and only the last may grow."""

    def __init__(self, options: dict):
        self.options, self.features = options, int(options["features"])

    def initialOffset(self) -> dict:  # noqa: N802
        return {"rows": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"rows": _Files(self.options, True).rows()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return _Files(self.options, True).ranges(start["rows"], end["rows"])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from _read(partition, self.features)

    def commit(self, end: dict) -> None:
        pass


def byte_rows(spark: SparkSession, path: str, n_features: int, part: int = PART, stream: bool = False) -> DataFrame:
    spark.dataSource.register(ByteRows)
    source = (spark.readStream if stream else spark.read).format("byterows")
    return source.option("path", path).option("features", n_features).option("part", part).load()


def from_loaders(spark: SparkSession, pieces: int, load: Callable[[int], np.ndarray | tuple]) -> DataFrame:
    """(id, x) from pieces that tasks load by themselves: load(k) gives the k-th, a matrix or a tuple that starts with one, the same each time it is asked. Pieces are counted in a first pass, a number a piece."""

    def matrix_of(k: int) -> np.ndarray:
        piece = load(k)
        x = piece[0] if isinstance(piece, (tuple, list)) else piece
        if not isinstance(x, np.ndarray) or x.ndim != 2:
            raise TypeError("every piece must be a matrix, or a tuple that starts with one")
        return x

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks = batch.column(0)
            yield pa.RecordBatch.from_arrays([ks, pa.array([len(matrix_of(k)) for k in ks.to_pylist()], pa.int64())], names=["id", "n"])

    # one task a piece
    numbers = spark.range(0, pieces, 1, max(1, pieces))
    sizes = {r.id: r.n for r in numbers.mapInArrow(count, "id long, n long").collect()}
    first = np.concatenate([[0], np.cumsum([sizes[k] for k in range(pieces)])]).astype(int)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                x = matrix_of(k)
                for lo in range(0, len(x), BATCH):
                    yield row_batch(first[k] + lo + np.arange(len(x[lo : lo + BATCH])), x[lo : lo + BATCH])

    return numbers.mapInArrow(rows, SCHEMA)
