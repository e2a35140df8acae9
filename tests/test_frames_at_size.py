"""Work of frames at size: each thing once, many at a time, in tasks that are not joined."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.operators import histories, kernels, points, storms
from pluvia.operators.histories import Frames, Motion
from pluvia.sources import driver_tables as src

MOTION = Motion(size=8, search=2, flow_size=8, gap=600, pairs=2)
DIR = "/root/testdata/sf0.001"


def frames_of(n, seed=1, size=24):
    rng = np.random.default_rng(seed)
    return [np.where(rng.random((size, size)) < 0.5, rng.integers(5, 60, (size, size)), -32).astype(float) for _ in range(n)]


def test_scenes_shuffle_squares_and_not_their_pixels(spark, capsys):
    histories.images(src.scenes(spark, DIR), src.SCENE, src.SCENE).explain("formatted")
    plan = capsys.readouterr().out
    # Squares by their begin, then by frame; pixels and frames are grouped where they are.
    assert plan.split("(1) ")[0].count("Exchange") == 2
    assert "hashpartitioning(region" in plan and not re.search(r"hashpartitioning\([^)]*\by#", plan)


def test_squares_without_value_are_as_strong_as_can_be(spark, tmp_path):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    rows = [(0, at, 1, "a", None), (576, at, 1, "a", 40.0), (7, at, 3, "a", 90.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    import duckdb

    got = sorted(tuple(r) for r in src.scenes(spark, str(tmp_path)).select("region", "t", "x", "y", "dbz").collect())
    duckdb.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(duckdb.sql(f"SELECT region, t, x, y, dbz FROM ({src.SCENES_SQL})").fetchall())
    assert max(r[4] for r in got) == 65.0
    assert sorted(r[0] for r in src.crowds(spark, str(tmp_path)).collect()) == sorted({r[0] for r in got})


def test_cells_of_a_frame_are_worked_out_once(monkeypatch):
    seen, real = [], storms.segments
    monkeypatch.setattr(storms, "segments", lambda g, *a: seen.append(1) or real(g, *a))
    held = Frames(MOTION)
    for i, g in enumerate(frames_of(4)):
        held.put(i * 600, g)
        for u in range(max(0, i - 1), i + 1):
            storms.cells_of(held, u * 600, 30.0, 4)
    assert len(seen) == 4
    held.evict(1200)
    assert sorted(k[1] for k in held.kept) == [1200, 1800]


def test_gains_of_many_points_equal_those_of_each():
    prev, cur = frames_of(2, size=40)
    rng = np.random.default_rng(3)
    x, y, v = rng.uniform(-9, 50, 80), rng.uniform(-9, 50, 80), rng.normal(0, 1, (80, 2))
    for r in (3, 24):
        got = kernels.translation_gains(prev, cur, v, 10.0, x, y, r)
        want = [kernels.translation_gain(prev, cur, v[i], 10.0, x[i], y[i], r) for i in range(80)]
        assert [None if np.isnan(q) else q for q in got] == [None if q is None else pytest.approx(q) for q in want]


def test_points_are_dealt_to_tasks_that_are_not_joined(spark):
    cells = [(r, k * 600, x, y, 30.0 + x) for r in range(6) for k in range(3) for x in range(k, 12 + k) for y in range(12)]
    frames = histories.images(spark.createDataFrame(cells, "region int, t long, x int, y int, dbz double"), 24, 24)
    asked = spark.createDataFrame([(i, i % 6, float(i % 24), float(i // 24)) for i in range(120)], "id long, region int, x double, y double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = points.forecast(asked, frames, points.Model(methods=("TREC",), weights=(1.0,), trend=False, horizon=5), MOTION)
        used = got.where("t IS NOT NULL").select(F.spark_partition_id().alias("p")).distinct().count()
        assert got.where("t = 1200").count() == 120
        assert used > 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
