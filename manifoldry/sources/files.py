"""Point sets from files: fixed-width byte rows, LIBSVM, CSV, arrays; and region-wise output."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manifoldry.operators.points import renumbered

from .rows import BATCH, PART, SCHEMA, byte_rows, row_batch

#: Larger files are read in parts, as they would be too much for one row.
WHOLE = 256 << 20


def fixed_width(spark: SparkSession, path: str, n_features: int, whole: int = WHOLE) -> DataFrame:
    """(id, x) from files of unsigned bytes, n_features a row, scaled to 0..1. Rows are numbered through the files in order of their names. Files of up to `whole` bytes are read at once, larger ones by ranges of rows."""
    files = spark.read.format("binaryFile").load(path)
    sizes = files.select("path", "length").orderBy("path").collect()  # one row a file
    if any(r.length % n_features for r in sizes):
        raise ValueError("a file doesn't hold whole rows")
    first = dict(zip((r.path for r in sizes), np.concatenate([[0], np.cumsum([r.length // n_features for r in sizes])]).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(content.as_buffer(), dtype=np.uint8).reshape(-1, n_features)
                for lo in range(0, len(x), BATCH):
                    part = x[lo : lo + BATCH] / 255.0
                    yield row_batch(first[name] + lo + np.arange(len(part)), part)

    out = files.where(F.col("length") <= whole).select("path", "content").mapInArrow(run, SCHEMA)
    for r in sizes:
        if r.length > whole:
            # Hadoop writes file:/ with one slash
            uri = r.path.replace("file:/", "file:///", 1) if r.path.startswith("file:/") and not r.path.startswith("file:///") else r.path
            out = out.union(byte_rows(spark, uri, n_features, min(whole, PART)).select((F.col("id") + first[r.path]).alias("id"), "x"))
    return out


def libsvm(spark: SparkSession, path: str, n_features: int) -> DataFrame:
    """(id, x, label) from LIBSVM text. Lines are numbered through the files in order of their names, whatever the partitions: by file, then by place in it."""
    from pyspark.ml.functions import vector_to_array

    df = spark.read.format("libsvm").option("numFeatures", str(n_features)).load(path)
    placed = df.select(F.input_file_name().alias("__file"), F.input_file_block_start().alias("__start"), F.monotonically_increasing_id().alias("__row"), vector_to_array("features").alias("x"), F.col("label").cast("int").alias("label"))
    return renumbered(placed, F.col("__file"), F.col("__start"), F.col("__row"), name="id").select("id", "x", "label")


def csv(spark: SparkSession, path: str, id_col: str, columns: list[str]) -> DataFrame:
    schema = ", ".join([f"`{id_col}` long", *(f"`{c}` double" for c in columns)])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.select(F.col(id_col).alias("id"), F.array(*columns).alias("x"))


def from_array(spark: SparkSession, x: np.ndarray) -> DataFrame:
    """(id, x) from a matrix; rows are numbered in order."""
    x = np.asarray(x)
    if x.ndim != 2:
        raise ValueError(f"a matrix is needed, not {x.ndim} dimensions")
    return from_chunks(spark, [x]) if len(x) else spark.createDataFrame([], "id long, x array<double>")


def from_chunks(spark: SparkSession, chunks: Iterable) -> DataFrame:
    """(id, x) from pieces, each a matrix or a tuple that starts with one. An iterator, which can be read only once, is refused."""
    if iter(chunks) is chunks:
        raise TypeError("an iterator can be read only once; give a list or another re-iterable")
    pieces, at = [], 0
    for piece in chunks:
        x = piece[0] if isinstance(piece, (tuple, list)) else piece
        if not isinstance(x, np.ndarray) or x.ndim != 2:
            raise TypeError("every piece must be a matrix, or a tuple that starts with one")
        if len(x):
            pieces.append(row_batch(at + np.arange(len(x)), x))
        at += len(x)
    # one table of the driver's, whatever the number of pieces; from_loaders leaves loading to the tasks
    return spark.createDataFrame(pa.Table.from_batches(pieces), SCHEMA) if pieces else spark.createDataFrame([], SCHEMA)


def write_regions(df: DataFrame, path: str, region: str = "region") -> None:
    """One folder a region."""
    df.write.mode("overwrite").partitionBy(region).parquet(path)
