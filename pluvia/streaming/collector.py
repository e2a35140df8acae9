"""Streams of live frames: windowed loads and the rain state of regions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

#: Dry checks after which a region that had rain is given up; seconds without rain.
DRY_CHECKS = 2
RAIN_MEMORY = 6 * 3600
STATE = "last_rain long, dry int"
OUT = "region int, t long, rainy boolean, last_rain long, dry int, given_up boolean"


def windowed_load(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Requests and their weight for each source and window; state ends behind the watermark.

    In append mode windows that end later than the newest event less `late` are not given yet;
    latest_rows has every window.
    """
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "source").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).select(F.col("w.start").alias("start"), "source", "n", "weight")


def latest_rows(stream: DataFrame, keys: list[str], base: str) -> DataFrame:
    """The newest row of each key of a stream in update mode, drained of all that is there now.

    Each batch's rows are written with its number under base, over what a failed try left.
    """
    path, schema = f"{base}/updates", stream.schema

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{_ddl(schema)}, batch long").parquet(path)
    values = [f.name for f in schema if f.name not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return newest.select(*[F.col(f"_v.{f.name}").alias(f.name) if f.name in values else F.col(f.name) for f in schema])


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def rain_state(frames: DataFrame) -> DataFrame:
    """frames (region, t, rainy) -> a row a frame: when it last rained, dry checks since, and
    whether the region is given up. State is two numbers a region; late frames change nothing."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, dry = state.get if state.exists else (-1, 0)
        rows = []
        for t, rainy in sorted((int(t), bool(r)) for b in batches for t, r in zip(b["t"], b["rainy"], strict=True)):
            if rainy:
                last, dry = max(last, t), 0
            else:
                dry += 1
            rows.append((key[0], t, rainy, last, dry, dry >= DRY_CHECKS or (last >= 0 and t - last > RAIN_MEMORY)))
        state.update((last, dry))
        yield pd.DataFrame(rows, columns=["region", "t", "rainy", "last_rain", "dry", "given_up"])

    return frames.groupBy("region").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


#: Rows of a region that leave a task together.
ROWS = 50_000
#: What region_state keeps and gives.
REGION_STATE = "newest long, last_rain long, checked long"
REGION_OUT = "region int, t long, rainy boolean, last_rain long, checked long, given_up boolean"


def region_state(frames: DataFrame, hold: int = RAIN_MEMORY, keep: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """frames (region, t, rainy, ts) -> a row for each frame in order of t: when it last rained (-1:
    never), how many frames were looked at, and whether the region is given up: after DRY_CHECKS
    frames without any rain, or when its rain is more than `hold` past.

    A frame no newer than one seen before changes nothing and gives no row. A region's state ends
    when the watermark of ts is `keep` past its newest frame.
    """
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest, last, checked = state.get if state.exists else (-1, -1, 0)
        parts = [(b["t"].astype("int64").to_numpy(), b["rainy"].to_numpy(bool), b["ts"].max().value // 10**6) for b in batches]
        until = max([0, *(p[2] for p in parts)])
        t, rainy = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        del parts
        # Of frames of one time the dry one came first and is the one that counts.
        t, rainy = (a[np.lexsort((rainy, t))] for a in (t, rainy))
        fresh = t > np.concatenate([[newest], t[:-1]])
        t, rainy = t[fresh & (t > newest)], rainy[fresh & (t > newest)]
        for start in range(0, len(t), ROWS):
            now, wet = t[start : start + ROWS], rainy[start : start + ROWS]
            rained = np.maximum.accumulate(np.concatenate([[last], np.where(wet, now, -1)]))[1:]
            seen = checked + 1 + np.arange(len(now))
            last, checked, newest = int(rained[-1]), int(seen[-1]), int(now[-1])
            yield pd.DataFrame({"region": key[0], "t": now, "rainy": wet, "last_rain": rained, "checked": seen, "given_up": np.where(rained < 0, seen >= DRY_CHECKS, now - rained > hold)})
        state.update((newest, last, checked))
        state.setTimeoutTimestamp(max(until + keep_ms, state.getCurrentWatermarkMs() + 1))

    return frames.withWatermark("ts", late).groupBy("region").applyInPandasWithState(step, REGION_OUT, REGION_STATE, "append", GroupStateTimeout.EventTimeTimeout)
