"""What the text operators share: tables, shared storage, hot-path hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, from spark.checkpoint.dir.

    It is set here only where the session has none and runs in one process (tests).
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = "file://" + tempfile.mkdtemp(prefix="pluvia-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/pluvia"


#: Folders that materialise wrote and that are not deleted.
_left: set[str] = set()


def left() -> set[str]:
    return set(_left)


#: Lets Spark delete the shuffle files of a write as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost
    executor costs a re-read, and ids given to its rows stay the same.

    The shuffle files of what led to it are deleted with it, not when the driver happens to
    collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    _left.add(path)
    return out


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _left.discard(folder)


def release(*frames: DataFrame) -> None:
    """Delete what materialise wrote for frames that nothing reads any more: all that was made
    of them must itself be written or collected."""
    for df in frames:
        remove(df.sparkSession, df._scratch)


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Words are runs without these code points (space and TAB to CR): a pattern and a list.
GAP = r"[\x20\x09-\x0D]"
SPACE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(F.length(bare) > 0, F.split(bare, GAP + "+", -1)).otherwise(F.array().cast("array<string>"))


def stable_long(*parts: Column | str, seed: str = "") -> Column:
    """60 bits of the MD5 of the parts joined by '|': the same in any SQL engine."""
    cols = [F.coalesce(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *cols)), 1, 15), 16, 10).cast("long")


def small(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that little of it is unpacked at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (A-Z lowered, cut at SPACE), one after another, as bytes, and the
    place where each text's begin (and the end); null texts have none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    sizes = pc.fill_null(pc.list_value_length(split), 0).to_numpy()
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0)  # a space at an end leaves an empty word
    ends = np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return flat.filter(full).cast(pa.binary()), np.concatenate([[0], ends])[bounds]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's begin; a word that occurs
    often is hashed once."""
    words_, bounds = split_words(texts)
    coded = words_.dictionary_encode()
    known = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
    return hashes[coded.indices.to_numpy()] if len(known) else np.empty(0, np.uint64), bounds


def lower_words(text: str | None) -> list[bytes]:
    """Words with A-Z lowered; bytes.split and bytes.lower are ASCII only, as is the rule."""
    return (text or "").encode().lower().split()


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (wraps)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
