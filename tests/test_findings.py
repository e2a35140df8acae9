"""Results that differ only on odd inputs or larger tables, and steps whose cost must not grow faster than the input."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from pluvia.operators import archive, cells, histories, issues, kernels, models, motion, places, scores
from pluvia.plans import issues as plans
from pluvia.sources import driver_tables, sinks
from pluvia.streaming import collector


def test_an_id_with_two_colours_has_one_row(spark):
    palette = spark.createDataFrame([(1.0, 10, 10, 10, 255, 1), (2.0, 200, 200, 200, 255, 2)], "dbz double, r int, g int, b int, a int, ord int")
    colours = spark.createDataFrame([(7, 12, 10, 10, 255), (7, 200, 200, 200, 255), (8, 11, 11, 11, 0)], "id long, r int, g int, b int, a int")
    got = sorted(tuple(r) for r in models.palette_reads(colours, palette).collect())
    assert got == [(7, 200, 200, 200, 255, 2.0, True), (8, 11, 11, 11, 0, -32.0, True)]


def test_costs_round_as_the_sql_does(spark):
    """Values a hair under a half, where the shortest decimal text says a half."""
    values = [n / 1e6 + 5e-7 for n in range(0, 1_500_000, 37)]
    given = spark.createDataFrame([(v,) for v in values], "v double")
    db = duckdb.connect()
    want = [r[0] for r in db.execute("SELECT round(unnest(?::DOUBLE[]), 6)", [values]).fetchall()]
    assert [r[0] for r in given.select(cells.half_up(F.col("v"), 6)).collect()] == want
    assert [r[0] for r in given.select(F.round("v", 6)).collect()] != want


def test_cells_meet_only_those_near_and_every_one_of_them(spark):
    """Joined by frame alone, a frame with many cells made the square of their number of rows."""
    rng = random.Random(3)
    a = [(1, i, rng.uniform(-9, 20), rng.uniform(-9, 900)) for i in range(600)]
    b = [(1, i, rng.uniform(-9, 20), rng.uniform(-9, 900)) for i in range(600)]
    met = cells.near(spark.createDataFrame(a, "k long, cell int, cx double, cy double"), spark.createDataFrame(b, "k long, a_cell int, a_cx double, a_cy double"), 6)
    pairs = {(r["cell"], r["a_cell"]): math.hypot(r["cx"] - r["a_cx"], r["cy"] - r["a_cy"]) for r in met.collect()}
    want = {(i, j) for _, i, x, y in a for _, j, u, v in b if math.hypot(x - u, y - v) <= 6}
    assert want and {p for p, d in pairs.items() if d <= 6} == want and len(pairs) < 600 * 600 / 10


def test_every_kernel_of_an_issue_is_called_a_bounded_number_of_times():
    """An issue's forecasts and scores are worked out for all variants, leads and spots at once: calls per variant, lead, threshold
    and spot were what the issue loop spent its time on."""
    calls = Counter()
    real = {n: getattr(kernels, n) for n in ("box_sum", "point_echo", "reads", "rain_share")}

    def counted(name):
        def call(*args):
            calls[name] += 1
            return real[name](*args)

        return call

    rng = np.random.default_rng(1)
    held = histories.Frames(plans.MOTION)
    for i in range(9):
        held.put(600 * i, np.where(rng.random((24, 24)) < 0.3, 40.0, kernels.NO_ECHO))
    for m in ("HS", "LK", "TREC"):
        held.field(m, 2400, 2)
    try:
        for n in real:
            setattr(kernels, n, counted(n))
        issues.Tally().issue(held, 2400, None, plans.ALL)
    finally:
        for n, f in real.items():
            setattr(kernels, n, f)
    leads = len(plans.ALL.leads)
    assert calls["rain_share"] == leads and calls["point_echo"] == leads + 1 and calls["reads"] == 2 * leads + 1
    assert calls["box_sum"] == 3 * len(plans.ALL.fss_thresholds) * len(plans.ALL.fss_windows)


def test_nearest_storms_near_and_very_far(spark):
    """Joined by frame alone, a frame's points and storms made the product of their numbers."""
    rng = random.Random(5)
    points = [(k, i, rng.randrange(12), rng.randrange(9000)) for k in (1, 2, 3) for i in range(150)]
    storms = [(k, i + 1, rng.randrange(12) + 0.25, rng.randrange(most) + 0.5, i % 2 == 0) for k, most in ((1, 9000), (2, 300)) for i in range(40)]
    given = spark.createDataFrame(points, "k long, id int, x int, y int"), spark.createDataFrame(storms, "k long, cell int, cx double, cy double, growing boolean")
    got = {(r["k"], r["id"]): (r["cell"], r["distance"], r["building"]) for r in models.nearest_storm(*given, 4.0).collect()}
    for k, i, x, y in points:
        d = sorted((math.sqrt((x - cx) ** 2 + (y - cy) ** 2), cell, g) for q, cell, cx, cy, g in storms if q == k)
        want = (d[0][1], round(d[0][0], 6), sum(v <= 4 and g for v, _, g in d)) if d else (None, None, 0)
        assert got[k, i][0] == want[0] and got[k, i][2] == want[2] and (not d or abs(got[k, i][1] - want[1]) < 2e-6)
    assert len(got) == len(points)
    twice = spark.createDataFrame([(1, 0, 5, 10), (1, 0, 5, 8000)], "k long, id int, x int, y int")
    one = spark.createDataFrame([(1, 3, 5.0, 8001.0, True)], "k long, cell int, cx double, cy double, growing boolean")
    assert [tuple(r) for r in models.nearest_storm(twice, one, 4.0).collect()] == [(1, 0, 3, 1.0, 1)]


def test_saved_state_makes_no_folder_a_block(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    blocks = spark.range(2000).select((F.col("id") % 2).alias("region"), F.floor(F.col("id") / 2).alias("block"), F.lit(1).alias("hits"))
    sinks.save_state(blocks.withColumn("hits", F.lit(9)).where("block < 600"), path)
    sinks.save_state(blocks.where("block >= 400 AND NOT (block = 500 AND region = 0)"), path)
    files = [f for f in (tmp_path / "state").rglob("*.parquet")]
    assert len(files) < 50
    got = {(r["block"], r["region"]): r["hits"] for r in sinks.load_state(spark, path, blocks.schema).collect()}
    assert got == {(b, r): 9 if b < 400 else 1 for b in range(1000) for r in (0, 1) if (b, r) != (500, 0)}
    (next((tmp_path / "state" / "run=2").glob("_SUCCESS"))).unlink()  # a run that failed does not count
    assert {r["hits"] for r in sinks.load_state(spark, path, blocks.schema).collect()} == {9}


def test_pixels_around_are_those_of_joins_without_a_join(spark):
    """every look by a join of its own had the pixels broadcast through the driver."""
    rng = random.Random(3)
    rows = [(r, (k * 600) + (histories.SPAN if k > 5 else 0), x, y, float(rng.randint(0, 60))) for r in (0, 1) for k in range(12) for x in range(6) for y in range(6) if rng.random() < 0.5 and (r, k) != (1, 4)]
    given = spark.createDataFrame([*rows, (None, 600, 1, 1, 5.0)], "region int, t long, x int, y int, dbz double")
    got = histories.around(histories.images(given, 6, 6), {"now": (0, 0), "west": (1, 0), "before": (-1, 600)}, (10, 20))
    value, there = {(r, t, x, y): v for r, t, x, y, v in rows}, {(r, t) for r, t, *_ in rows}
    want = [
        (r, t, x, y, n, v, value.get((r, t, x - 1, y)), value.get((r, t - 600, x + 1, y)), value.get((r, t + 60 * n, x, y)))
        for r, t, x, y, v in rows for n in (10, 20) if (r, t + 60 * n) in there
    ]
    assert Counter(tuple(r) for r in got.select("region", "t", "x", "y", "lead", "now", "west", "before", "obs").collect()) == Counter(want)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_nearest_places_meet_few_others(spark):
    """points and places met all others of nine cells, copies of one place too."""
    rng = random.Random(5)
    spot = lambda: (round(rng.uniform(50, 53), 3), round(rng.uniform(-1, 2), 3))
    gaz = [(f"g{i % 40}", *spot()) for i in range(60)] + [("b", 70.0, 4.9), ("c", 70.0, 9.9)]
    gaz += [(f"z{i}", *gaz[0][1:]) for i in range(30)]
    asked = [(i, *spot()) for i in range(80)] + [(100 + i, *gaz[0][1:]) for i in range(30)] + [(200, 70.0, 5.1), (201, -60.0, 0.0), (202, 89.9, 3.0)]
    metres = lambda a, b: round(2 * 6_371_000 * math.asin(min(1, math.sqrt(math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2))), 3)
    near = lambda a, b: abs(a[1] // 5 - b[1] // 5) <= 1 and abs(a[2] // 5 - b[2] // 5) <= 1
    want = {}
    for a in asked:
        all_ = sorted((metres(a, g), g[0]) for g in gaz if near(a, g))
        want[a[0]] = (all_[0][1], all_[0][0]) if all_ else (f"{a[1]:.5f}, {a[2]:.5f}", None)
    got = places.nearest(spark.createDataFrame(asked, "id int, lat double, lon double"), spark.createDataFrame(gaz, "name string, lat double, lon double")).collect()
    assert {r.id: (r.name, r.metres) for r in got} == want and len(got) == len(asked)
    crowd = spark.range(300).select("id", F.lit(50.0).alias("lat"), F.lit(1.0).alias("lon"))
    one = places.nearest(crowd, crowd.select(F.lit("a").alias("name"), "lat", "lon"))
    assert one.count() == 300


def test_sparse_assignment_is_the_dense_one_without_the_matrix():
    """all cells of a frame met all others in a square matrix."""
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, m = rng.integers(1, 25, 2)
        a, b = rng.uniform(0, 40, (n, 2)), rng.uniform(0, 40, (m, 2))
        i, j = kernels.near_pairs(a, b, 12.0)
        d = np.linalg.norm(a[i] - b[j], axis=1)
        i, j, d = i[d <= 12], j[d <= 12], d[d <= 12]
        assert len(i) == (np.linalg.norm(a[:, None] - b[None], axis=2) <= 12).sum()
        cost = d / 12 + 0.5 * rng.random(len(d))
        whole = np.full((n + m, n + m), 1.51)
        whole[n:, m:], whole[:n, :m] = 0.0, 1e6
        whole[i, j] = cost
        to = kernels.assignment(whole)[:n]
        got = kernels.sparse_assignment(n, m, i, j, cost, 3.02)
        assert [(i[e], j[e]) for e in got if e >= 0] == [(r, c) for r, c in enumerate(to) if c < m and whole[r, c] < 1e6]
    tall = rng.uniform(0, 1, (5000, 2)) * [12, 10_000]
    i, j = kernels.near_pairs(tall, tall, 12.0)
    assert len(i) < 40 * len(tall)
    assert (kernels.sparse_assignment(5000, 5000, i, j, np.linalg.norm(tall[i] - tall[j], axis=1) / 12, 3.02) >= 0).all()


def test_a_frame_s_forecasts_leave_in_parts(spark, monkeypatch):
    """the forecasts of all points of a frame were one table, however tall the frame."""
    rng = np.random.default_rng(2)
    given = [(k, x, y, float(rng.integers(0, 60))) for k in range(3) for x in range(12) for y in range(40) if rng.random() < 0.6]
    paired = motion.pairs(motion.frames(spark.createDataFrame(given, "k long, x int, y int, dbz double"), 12, 40))
    parts = []
    monkeypatch.setattr(motion, "per_pair", lambda p, kernel, schema: parts.append(kernel))
    asked = {"horizon": 20, "size": 4, "search": 2, "at": (0, 10, 20)}
    prev, cur = (np.frombuffer(paired.orderBy("k").first()[c], "<f4").reshape(40, 12).astype(float) for c in ("was", "dbz"))
    motion.forecast(paired, None, **asked)
    whole = list(parts[0](1, prev, cur))
    monkeypatch.setattr(motion, "POINTS", 100)
    some = list(parts[0](1, prev, cur))
    assert len(whole) == 1 and len(some) == 5 and max(map(len, some)) <= 300
    joined = np.concatenate([f.to_numpy() for f in some])
    assert (joined == whole[0].to_numpy()).all()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_members_are_dealt_by_order_once(spark):
    """most groups are one row, so sums kept before a shuffle only grew, and points were dealt again."""
    one = _plan(models.member_features(driver_tables.members(spark, "/root/testdata/sf0.001"), ["point", "lead"]))
    assert one.count("Exchange ") == 1
    schema = "region int, t long, variant string, fc double, obs double"
    given = [(1, 600, "HS", 5.0, 3.0), (1, 600, "LK", 9.0, 3.0), (1, 1200, "HS", 30.0, 30.0), (1, 1200, "HS", 30.0, 5.0), (1, 1200, "LK", 0.0, 30.0), (None, 600, "HS", 50.0, 50.0)]
    dry = scores.with_dry_issues(spark.createDataFrame(given, schema))
    assert sorted(tuple(r) for r in dry.collect()) == [("HS", 2, 1, 1, 0, 1, 1), ("LK", 2, 1, 0, 1, 0, 1)]
    assert "Join" not in _plan(dry)


def test_uploads_are_counted_without_a_join(spark):
    """F28, with null ids and keys, which match nothing."""
    plan = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (3, None), (None, 1)], "id int, n int")
    given = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (2, 7), (2, 7), (3, None), (None, 1)], "id int, n int")
    got = archive.checked_upload(plan, given, ["n"])
    assert {tuple(r) for r in got.collect()} == {(1, 2, 0, "incomplete"), (2, 0, 1, "stale"), (3, 1, 1, "stale"), (None, 1, 1, "stale")}
    assert "Join" not in _plan(got)


def test_a_region_s_states_leave_in_parts(monkeypatch):
    """a region's frames of one batch were rows of Python objects, sorted and given at once."""
    import types

    import pandas as pd

    class Frames_:
        def withWatermark(self, *_):
            return self

        def groupBy(self, *_):
            return self

        def applyInPandasWithState(self, step, *_):
            return step

    class State(types.SimpleNamespace):
        def update(self, v):
            self.get, self.exists = v, True

    rng = random.Random(4)
    monkeypatch.setattr(collector, "ROWS", 7)
    step = collector.region_state(Frames_(), hold=50)
    state = State(exists=False, hasTimedOut=False, get=None, setTimeoutTimestamp=lambda _: None, getCurrentWatermarkMs=lambda: 0)
    newest, last, checked, want, got, sizes = -1, -1, 0, [], [], []
    for batch in range(3):
        rows = [(rng.randint(0, 200 * (batch + 1)), rng.random() < 0.1) for _ in range(60)]
        for t, rainy in sorted(rows):
            if t > newest:
                newest, checked, last = t, checked + 1, t if rainy else last
                want.append((5, t, rainy, last, checked, checked >= 2 if last < 0 else t - last > 50))
        frame = pd.DataFrame(rows, columns=["t", "rainy"]).assign(ts=pd.Timestamp("2024-01-01"))
        for part in step((5,), iter([frame[:20], frame[20:]]), state):
            sizes.append(len(part))
            got += part.itertuples(index=False, name=None)
    assert got == want and max(sizes) == 7
