"""What is written: accumulators by block, reports, training rows, and how they are read back.

Spark's commit protocol makes a write whole or nothing. Retention drops blocks by their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK_S = 21600


def _runs(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """The numbers of the runs saved under a path: of all that began, and of those that are whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    begun = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("run=")] if fs.exists(at) else []
    number = lambda p: int(p.getName().removeprefix("run="))
    return [number(p) for p in begun], [number(p) for p in begun if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def save_state(blocks: DataFrame, path: str) -> None:
    """Write accumulators (region, block, ...) as one more run; of a block that an earlier run has too, only the new rows count.
    A folder is a run and its files are ranges of blocks, so their number does not grow with the blocks."""
    run = max(_runs(blocks.sparkSession, path)[0], default=0) + 1
    blocks.repartitionByRange("block").sortWithinPartitions("block").write.parquet(f"{path}/run={run}")


def load_state(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """What was saved, of each block the rows of its newest run; without rows where nothing is there."""
    whole = _runs(spark, path)[1]
    if not whole:
        return spark.createDataFrame([], schema)
    read = spark.read.schema(schema)
    runs = [read.parquet(f"{path}/run={n}").withColumn("_run", F.lit(n)) for n in sorted(whole)]
    found = runs[0]
    for r in runs[1:]:
        found = found.unionByName(r)
    newest = F.max("_run").over(W.partitionBy("block"))  # a block is a few rows a run
    return found.withColumn("_newest", newest).where("_run = _newest").drop("_run", "_newest")


def retained(blocks: DataFrame, cutoff: int) -> DataFrame:
    """Accumulators of blocks that end at the cutoff or later; the scan skips the row groups of others."""
    return blocks.where(F.col("block") >= -(-(cutoff - BLOCK_S) // BLOCK_S))


def save_report(report: DataFrame, path: str) -> None:
    """A report, one JSON object a row, in one file: a few rows for each variant."""
    report.coalesce(1).write.mode("overwrite").json(path)


def save_training(rows: DataFrame, path: str) -> None:
    """Training rows, a folder for each region."""
    rows.repartition("region").write.mode("overwrite").partitionBy("region").parquet(path)
