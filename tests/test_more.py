"""File sources, streams and cell labels on small fixtures."""

import json

import pandas as pd
from pyspark.sql import functions as F

from pluvia.functions import text
from pluvia.operators import cells, nowcast
from pluvia.plans import registry
from pluvia.sources import files
from pluvia.streaming import collector


def test_frame_index_and_stations(spark, tmp_path):
    (tmp_path / "maps.json").write_text(json.dumps({"generated": 5, "host": "h", "radar": {"past": [{"time": 1, "path": "/a"}, {"time": 2, "path": "/b"}], "nowcast": [{"time": 3, "path": "/c"}]}}))
    assert [(r["t"], r["path"]) for r in files.frame_index(spark, f"file://{tmp_path}/maps.json").orderBy("t").collect()] == [(1, "/a"), (2, "/b")]
    (tmp_path / "s.json").write_text(json.dumps([{"id": "a", "lat": 1.0, "lon": 2.0}, {"id": "a", "lat": 99.0, "lon": 2.0}]))
    rows, faults = files.stations(spark, f"file://{tmp_path}/s.json")
    assert rows.count() == 2 and {r["fault"] for r in faults.collect()} == {"lat", "id is repeated"}


def test_tiles_and_palette(spark, tmp_path):
    (tmp_path / "f1").mkdir()
    (tmp_path / "f1" / "7_3_4.png").write_bytes(b"x")
    r = files.tiles(spark, f"file://{tmp_path}/f1").first()
    assert (r["frame"], r["z"], r["x"], r["y"], bytes(r["content"])) == ("f1", 7, 3, 4, b"x")
    p = spark.createDataFrame([(0, 1.0, "#000000ff"), (1, 2.0, "#000000ff"), (2, 3.0, "#11111100"), (3, 2.5, "#222222ff")], "ord int, dbz double, colour string")
    assert [tuple(r) for r in files.palette(p).collect()] == [("#000000ff", 1.0)]


def test_labels_of_a_spiral_and_an_empty_frame(spark):
    art = ["#####", "....#", "###.#", "#...#", "#####"]
    rows = [(0, x, y, 40.0) for y, line in enumerate(art) for x, c in enumerate(line) if c == "#"] + [(1, 0, 0, 40.0), (1, 1, 1, 40.0), (2, 0, 0, 5.0)]
    got = cells.labelled(spark.createDataFrame(rows, "k long, x int, y int, dbz double")).groupBy("k").agg({"cell": "max"}).collect()
    assert {tuple(r) for r in got} == {(0, 0), (1, 1)}


def test_rain_state_over_two_batches(spark, tmp_path):
    def batch(name, rows):
        pd.DataFrame(rows, columns=["region", "t", "rainy"]).astype({"region": "int32"}).to_parquet(tmp_path / f"in/{name}.parquet")

    (tmp_path / "in").mkdir()
    stream = collector.rain_state(spark.readStream.schema("region int, t long, rainy boolean").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in"))
    batch("a", [(1, 0, True), (1, 600, False)])
    for name, rows in ((None, None), ("b", [(1, 1200, False), (2, 1200, False)])):
        if name:
            batch(name, rows)
        stream.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").option("path", f"file://{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    got = {(r["region"], r["t"]): (r["last_rain"], r["dry"], r["given_up"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {(1, 0): (0, 0, False), (1, 600): (0, 1, False), (1, 1200): (0, 2, True), (2, 1200): (-1, 1, False)}


def test_text_and_series_edges(spark):
    t = spark.createDataFrame([(" 10.5 , -20 ",), ("91 0",), ("a",), (None,)], "s string")
    lat, lon = text.coordinates(t["s"])
    assert [tuple(r) for r in t.select(lat, lon).collect()] == [(10.5, -20.0), (None, None), (None, None), (None, None)]
    s = spark.createDataFrame([(1, 0, None), (1, 1, 45.0)], "id int, minute int, dbz double")
    r = nowcast.summary(s, ["id"]).first()
    assert (r["arrival"], r["heavy_arrival"], r["raining_now"]) == (1, 1, False)
    assert nowcast.summary(s.limit(0), ["id"]).count() == 0


def test_windowed_load_has_every_window(spark, tmp_path):
    (tmp_path / "in").mkdir()
    at = pd.to_datetime([f"2024-01-01 {h:02}:{m:02}:00" for h, m in ((0, 5), (1, 10), (1, 50), (2, 30), (1, 40), (2, 59))])
    for name, part in (("a", slice(0, 4)), ("b", slice(4, 6))):
        pd.DataFrame({"ts": at[part].astype("datetime64[us]"), "source": "s", "weight": 1.5}).to_parquet(tmp_path / f"in/{name}.parquet")
    stream = spark.readStream.schema("ts timestamp, source string, weight double").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    rows = collector.latest_rows(collector.windowed_load(stream), ["start", "source"], f"file://{tmp_path}/s").collect()
    assert sorted((r["start"].hour, r["n"], r["weight"]) for r in rows) == [(0, 1, 1.5), (1, 3, 4.5), (2, 2, 3.0)]


def test_registered_windowed_load_equals_a_group_by(spark):
    directory = "/root/testdata/sf0.001"
    got = registry.QUERIES["stm_windowed_load"](spark, directory)
    e = spark.read.parquet(f"{directory}/events.parquet")
    want = e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("start"), F.col("event_type").alias("source")).agg(F.count("*").alias("n"), F.sum("value").alias("weight"))
    plain = lambda rows: sorted((r["start"], r["source"], r["n"], round(r["weight"], 6)) for r in rows)
    assert plain(got.collect()) == plain(want.collect())


def test_lag_and_insert_take_every_event(spark):
    directory = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{directory}/events.parquet")
    assert registry.QUERIES["pip_publish_lag_all"](spark, directory).count() == events.count()
    rest = {r["k"]: r["id"] for r in events.where("event_id % 3 <> 0").groupBy((F.col("user_id") % 70).alias("k")).agg(F.min("event_id").alias("id")).collect()}
    there = {r["k"]: r["id"] for r in events.where("event_id % 3 = 0").groupBy((F.col("user_id") % 50).alias("k")).agg(F.min("event_id").alias("id")).collect()}
    assert {r["k"]: r["id"] for r in registry.QUERIES["snk_insert_if_absent_all"](spark, directory).collect()} == rest | there
