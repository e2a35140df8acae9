"""Pictures, saved state, collector state, archive and place operators on small fixtures."""

import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pluvia.functions import trees
from pluvia.operators import archive, models, places, scores
from pluvia.sources import images, sinks
from pluvia.streaming import collector


def png(rgba):
    h, w, _ = rgba.shape
    raw = b"".join(b"\0" + row.tobytes() for row in rgba.astype(np.uint8))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


PALETTE = [(10.0, 1, 2, 3, 255), (20.0, 200, 0, 0, 255)]


def test_tiles_are_decoded_and_stitched(spark, tmp_path):
    folder = tmp_path / "f1"
    folder.mkdir()
    for x in range(3):
        for y in range(3):
            a = np.zeros((256, 256, 4), np.uint8)
            a[10, 20:30] = (200, 0, 0, 255)
            a[11, 20] = (1, 2, 4, 255)  # near the first colour
            if (x, y) == (1, 1):
                a[:100] = (9, 99, 9, 255)
            (folder / f"7_{x}_{y}.png").write_bytes(png(a))
    got = images.radar_tiles(images.pictures(spark, f"file://{tmp_path}"), PALETTE)
    rows = {(r["x"], r["y"]): r for r in got.collect()}
    assert len(rows) == 9 and rows[1, 1]["fault"] == "not radar" and rows[1, 1]["dbz"] is None
    g = np.frombuffer(rows[0, 2]["dbz"], "<f4").reshape(256, 256)
    assert rows[0, 2]["fault"] is None and (g[10, 20], g[11, 20], g[0, 0]) == (20, 10, -32)


def test_mosaics_want_nine_tiles(spark, tmp_path):
    (tmp_path / "f1").mkdir()
    for x in range(3):
        for y in range(3):
            a = np.zeros((256, 256, 4), np.uint8)
            a[x, y] = (200, 0, 0, 255)
            (tmp_path / "f1" / f"7_{x}_{y}.png").write_bytes(png(a))
    tiles = images.radar_tiles(images.pictures(spark, f"file://{tmp_path}"), PALETTE)
    centres = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "region string, x int, y int")
    r = images.mosaics(tiles, centres).collect()
    assert [x["region"] for x in r] == ["a"]
    g, c = np.frombuffer(r[0]["dbz"], "<f4").reshape(768, 768), np.frombuffer(r[0]["covered"], np.uint8).reshape(768, 768)
    assert (g == 20).sum() == 9 and g[256 + 2, 1] == -32 and g[512 + 1, 2] == -32 and g[1, 256 + 1] == -32 and g[256 * 2 + 0, 256 * 0 + 2] == 20
    assert c.sum() == 768 * 768 - 9
    assert images.mosaics(tiles, centres, every=False).count() == 2
    grey = images.grey_tiles(images.pictures(spark, f"file://{tmp_path}")).first()
    assert len(grey["grey"]) == 256 * 256


def test_saved_state(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    schema = "region int, n long, block long"
    assert sinks.load_state(spark, path, schema).count() == 0
    sinks.save_state(spark.createDataFrame([(1, 5, 0), (1, 6, 1)], schema), path)
    sinks.save_state(spark.createDataFrame([(2, 7, 1)], schema), path)
    assert {tuple(r) for r in sinks.load_state(spark, path, schema).collect()} == {(1, 5, 0), (2, 7, 1)}
    assert [r["block"] for r in sinks.retained(sinks.load_state(spark, path, schema), 21601).collect()] == [1]
    sinks.save_report(spark.createDataFrame([("a", 0.5)], "variant string, csi double"), f"file://{tmp_path}/report")
    assert spark.read.json(f"file://{tmp_path}/report").first()["csi"] == 0.5
    sinks.save_training(spark.createDataFrame([(1, 0.5), (2, None)], "region int, x float"), f"file://{tmp_path}/rows")
    assert spark.read.parquet(f"file://{tmp_path}/rows").where("region = 2").count() == 1


def test_collector_state_ignores_late_frames(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda name, rows: pd.DataFrame(rows, columns=["region", "t", "rainy"]).astype({"region": "int32"}).assign(ts=lambda f: pd.to_datetime(f["t"], unit="s").astype("datetime64[us]")).to_parquet(tmp_path / f"in/{name}.parquet")
    put("a", [(1, 600, True), (1, 1200, False), (2, 600, False)])
    source = spark.readStream.schema("region int, t long, rainy boolean, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    for name in ("a", "b"):
        if name == "b":
            put("b", [(1, 900, False), (1, 30000, False), (2, 1200, False)])
        collector.region_state(source).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/s").option("path", f"file://{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    got = {(r["region"], r["t"]): (r["last_rain"], r["checked"], r["given_up"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {(1, 600): (600, 1, False), (1, 1200): (600, 2, False), (1, 30000): (600, 3, True), (2, 600): (-1, 1, False), (2, 1200): (-1, 2, True)}


def test_archive_edges(spark):
    f = spark.createDataFrame([(1, 600 * i) for i in range(5)] + [(2, 0), (None, 0)], "region int, t long")
    assert [tuple(r) for r in archive.usable(f, ["region"], 1, [10]).orderBy("t").collect()] == [(1, 600), (1, 1200), (1, 1800)]
    assert archive.usable(f.limit(0), ["region"], 1, [10]).count() == 0
    c = spark.createDataFrame([(0, 0, 5.0, "a"), (1, 0, 4.0, "a"), (5, 0, 3.0, "a"), (9, 0, 2.0, "b")], "x int, y int, score double, climate string")
    assert archive.filled_regions(c, c.select("x", "y").limit(0), 3) == [(0, 0), (9, 0), (5, 0)]
    seen = spark.createDataFrame([("s", 100, 0), ("s", 700, 600), ("s", 1500, 1200), ("s", 4000, 1800)], "source string, seen long, newest long")
    assert [(r["seen"], r["delay"], r["lag"]) for r in archive.publish_delays(seen, close=1000).orderBy("seen").collect()] == [(700, 100, 100), (1500, 300, 100)]


def test_scores_edges(spark):
    m = spark.createDataFrame([(1, 0, 1, 10, "a", 30.0, None, 0.5), (1, 0, 1, 10, "b", None, 25.0, 0.5)], "region int, t long, point long, lead int, variant string, fc double, obs double, prob double")
    r = {x["variant"]: x for x in scores.results(m, "b").where("lead IS NOT NULL").collect()}
    assert r["a"]["hits"] == 0 and r["a"]["csi"] is None
    assert scores.results(m.limit(0), "b").count() == 0
    b = scores.bootstrap(spark.createDataFrame([(1, i, v, 1, 1, 0) for i in range(3) for v in "ab"], "region int, block long, variant string, hits long, misses long, false_alarms long"), ["a", "b"], "a", 50).collect()
    assert all(x["low"] is None and x["csi"] == 0.5 for x in b)
    mean = scores.draws(np.arange(2000), np.arange(50)).mean()
    assert 0.97 < mean < 1.03


def test_trees_and_fnv(spark):
    with pytest.raises(ValueError):
        trees.checked([trees.Node(feature=0, left=0, right=0)], 1)
    with pytest.raises(ValueError):
        trees.checked([trees.Node(feature=3, left=1, right=2), trees.Node(), trees.Node()], 1)
    leaf = [trees.Node(value=-2.0), trees.Node(value=2.0)]
    rows = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,), (float("nan"),)], "x double")
    want = {trees.NONE: [-2, -2, 2, -2, -2], trees.ZERO: [2, -2, 2, 2, 2], trees.NAN: [-2, -2, 2, 2, 2]}
    for kind, values in want.items():
        stump = [trees.Node(feature=0, threshold=1.0, left=1, right=2, default_left=False, missing=kind), *leaf]
        assert [r[0] for r in rows.select(trees.value_of(stump, [F.col("x")])).collect()] == values
    h = spark.createDataFrame([("",), ("a",)], "k string").select(models.fnv1a("k").alias("h")).collect()
    assert [int(r["h"]) for r in h] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C]


def test_places_edges(spark):
    rows = [(1, 1, "Pho", 21.0, 105.0), (1, 2, "pho ", 21.001, 105.0), (1, 3, "PHO", 21.004, 105.0), (1, 4, "x", 21.0, 105.0)]
    kept = places.without_near_duplicates(spark.createDataFrame(rows, "answer int, ord int, name string, lat double, lon double"), ["answer"])
    assert sorted(r["ord"] for r in kept.collect()) == [1, 3, 4]
    ip = spark.createDataFrame([("10.0.0.1", "1.1.1.1, 2.2.2.2"), ("8.8.8.8", "1.1.1.1"), ("bad", None), ("10.0.0.1", "junk")], "p string, x string")
    assert [r[0] for r in ip.select(places.client_address(F.col("p"), F.col("x"))).collect()] == ["2.2.2.2", "8.8.8.8", "bad", "10.0.0.1"]


def test_eligible_issues_ask_for_each_lead(spark):
    from pluvia.operators import series

    f = spark.createDataFrame([("a", t) for t in (0, 600, 1200, 1800, 4800)] + [("a", 1200), ("b", 1200)], "region string, t long")
    assert [tuple(r) for r in series.eligible_issues(f, ["region"], 2, [10, 60]).collect()] == [("a", 1200)]
    assert series.eligible_issues(f.limit(0), ["region"], 2, [10, 60]).count() == 0
    times = [600 * i for i in range(40) if i % 7]
    g = spark.createDataFrame([(i % 2, t) for i in range(2) for t in times], "region int, t long")
    for pairs, leads in ((1, [10]), (3, [10, 20]), (2, [30, 50])):
        want = {(r, t) for r in (0, 1) for t in times if all(t + o in times for o in [-600 * k for k in range(1, pairs + 1)] + [60 * m for m in leads])}
        assert {tuple(r) for r in series.eligible_issues(g, ["region"], pairs, leads).collect()} == want


def test_filled_regions_equal_a_greedy_scan(spark):
    import random

    for seed in range(4):
        rng = random.Random(seed)
        spots = [(x, y) for x in range(30) for y in range(30)]
        rows = [(x, y, float(rng.randrange(6)), rng.choice("abc" if seed else "a")) for x, y in rng.sample(spots, 500)]
        held = rng.sample(spots, 3)
        taken, climates = list(held), {}
        for quota in (2, 8):
            for x, y, _, c in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
                if len(taken) < 8 and climates.get(c, 0) < (3 if quota == 2 else 8) and all(max(abs(x - a), abs(y - b)) >= 3 for a, b in taken):
                    taken.append((x, y))
                    climates[c] = climates.get(c, 0) + 1
        c = spark.createDataFrame(rows, "x int, y int, score double, climate string")
        assert archive.filled_regions(c, spark.createDataFrame(held, "x int, y int"), 8) == taken[3:]
