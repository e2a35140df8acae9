"""Vector bin packing of groups into shards.

A group is a set of rows with equal text. Groups heavier than a small share of the input are
items of their own; the rest fall into a fixed number of hash buckets, which are items too,
so the packer sees a bounded list whatever the input's size. Only a group that no shard could
hold is cut into pieces, by the numbers that its rows got when they were written. Items go, heaviest first, to the shard where the dot product
of their (bytes, tokens, rows) with its residual capacity is highest.

Defined results: null texts count as empty (size: the fixed overhead); repeated rows are
placed one by one; null ids are placed like others; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvia.llm.common import materialise, words

SHARDS = 24
#: Bytes that a row takes besides its text.
OVERHEAD = 8
#: Hash buckets of the light groups; a group above 1/BUCKETS of all bytes is its own item.
BUCKETS = 4096
#: Pieces of a shard's capacity into which a group beyond it is cut.
CUTS = 8
#: Rows that get their slot in one window partition, about.
RUN = 500


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item; items: (n, 3) of bytes, tokens, rows.

    Where shards' dot products tie, the emptier shard in bytes takes the item. The bytes
    dimension decides whether an item still fits, as sizes are to come out near equal.
    """
    totals = np.maximum(items.sum(axis=0), 1)
    sizes = items / totals * shards  # in shares of a shard's capacity
    residual = np.ones((shards, items.shape[1]))
    placed = np.zeros(len(items), np.int32)
    for i in np.lexsort((np.arange(len(items)), -sizes.max(axis=1))):
        score = residual @ sizes[i]
        fits = residual[:, 0] >= sizes[i, 0]
        if fits.any():
            score = np.where(fits, score, -np.inf)
        best = int(np.argmax(score))
        placed[i] = best
        residual[best] -= sizes[i]
    return placed


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null), n_words.

    Two aggregations before the shuffle of rows without texts; the driver gets at most
    BUCKETS heavy groups and BUCKETS buckets.
    """
    text = F.coalesce("text", F.lit(""))
    raw = F.encode(text, "UTF-8")
    rows = materialise(
        docs.select(
            "doc_id",
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            # The text's digest names its group; 128 bits of it.
            F.substring(F.sha2(raw, 256), 1, 32).alias("digest"),
            F.size(words(F.col("text"))).cast("long").alias("n_words"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "rows",
    )
    spark = docs.sparkSession
    total = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    all_bytes, all_rows = (total["b"] or 0), total["n"]
    light = max(1, all_bytes // BUCKETS)
    most = max(1, all_bytes // shards)
    sums = (F.sum("size").alias("b"), F.sum("n_words").alias("w"), F.count("*").alias("n"))
    heavy = rows.groupBy("digest").agg(*sums).where(F.col("b") > light)
    # Fewer than BUCKETS groups can each hold more than 1/BUCKETS of the bytes.
    pieces = heavy.select("digest", F.when(F.col("b") > most, F.ceil(F.col("b") * CUTS / most)).otherwise(1).cast("int").alias("pieces")).collect()
    named = spark.createDataFrame([(r["digest"], r["pieces"]) for r in pieces], "digest string, pieces int")
    spread = F.pmod(F.xxhash64("row", F.lit(7)), F.col("pieces").cast("long"))
    bucket = F.pmod(F.xxhash64("digest", F.lit(3)), F.lit(BUCKETS)).cast("string")
    keyed = rows.join(F.broadcast(named), "digest", "left").select(
        "row", "doc_id", "size", "text_crc32", "n_words", F.when(F.col("pieces").isNull(), bucket).otherwise(F.concat_ws(":", "digest", spread.cast("string"))).alias("item")
    )
    items = keyed.groupBy("item").agg(*sums).orderBy("item").collect()
    where = pack(np.array([(r["b"], r["w"], r["n"]) for r in items], float).reshape(len(items), 3), shards)
    home = spark.createDataFrame([(r["item"], int(s)) for r, s in zip(items, where, strict=True)], "item string, shard int")
    placed = keyed.join(F.broadcast(home), "item")
    # Slots: runs of a shard get their first slot from a running sum over run counts.
    runs = max(1, all_rows // (RUN * shards))
    placed = placed.withColumn("run", F.pmod(F.xxhash64("row", F.lit(11)), F.lit(runs)).cast("int"))
    counts = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    base = counts.select("shard", "run", (F.sum("n").over(W.partitionBy("shard").orderBy("run")) - F.col("n")).alias("base"))
    in_run = F.row_number().over(W.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "row")) - 1
    return (
        placed.withColumn("at", in_run)
        .join(base, ["shard", "run"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "n_words")
    )
