"""Scratch tables in the folder that the driver and all executors share: where lineage ends, and lost executors take nothing with them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Scratch folders made by this process and not deleted yet.
_MADE: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session gets a temporary one; a cluster is refused."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="manifoldry-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def scratch_path(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark)}/manifoldry-{uuid.uuid4().hex}"
    _MADE.add(folder)
    return f"{folder}/{name}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files behind frames made by cut() that no later frame reads."""
    for df in frames:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if "/manifoldry-" in f:
                _delete(spark, f)


def clear_scratch(spark: SparkSession) -> int:
    """Delete all scratch that this process has written, once no result that reads it is needed any more; how many folders there were."""
    n = len(_MADE)
    while _MADE:
        _delete(spark, _MADE.pop())
    return n
