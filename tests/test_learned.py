"""Learned forecasts: calibration and thresholds against plain loops, exported trees against columns, folds left out, and
the issue loop against the same forecasts row by row."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pluvia.functions import geo, trees
from pluvia.operators import boosting, features, histories, issues, learned
from pluvia.operators.nowcast import move_into_band
from pluvia.sources import bundles
from test_issues import band  # beside this file

SMALL = boosting.Settings(rounds=3, leaves=8, depth=3, rate=0.8, patience=2, least_rows=5)


def test_isotonic_is_the_best_rising_function(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(400), 2)  # ties
    y, w = rng.random(400) < p**2, 1.0 + rng.integers(0, 3, 400)
    rows = spark.createDataFrame([(float(a), bool(b), float(c)) for a, b, c in zip(p, y, w)] + [(None, True, 1.0), (0.5, None, 1.0), (0.5, True, 0.0)], "p double, event boolean, w double").repartition(3)
    knots = learned.isotonic(rows)
    at = np.unique(p)
    cw, cy = (np.array([(v * (p == a)).sum() for a in at]) for v in (w, w * y))
    mean = lambda i, j: cy[i : j + 1].sum() / cw[i : j + 1].sum()
    want = [max(min(mean(j, k) for k in range(i, len(at))) for j in range(i + 1)) for i in range(len(at))]
    assert np.allclose(np.interp(at, *knots), want) and list(knots[0]) == sorted(knots[0]) and list(knots[1]) == sorted(knots[1])
    got = learned.calibrated(rows, knots).where("p IS NULL").first()
    assert got["prob"] is None
    assert learned.isotonic(rows.limit(0)) == ([], []) and learned.calibrated(rows, ([], [])).where("p = 0.5").first()["prob"] == 0.5


def test_lead_thresholds_equal_a_plain_search(spark):
    rng = np.random.default_rng(5)
    rows = []
    for lead in (10, 20, 30, 60):
        for _ in range(60):
            event = bool(rng.random() < 0.4)
            rows.append((lead, float(np.clip(rng.normal(0.6 if event else 0.3, 0.2), 0, 1)), event, float(1 + rng.integers(0, 2)), bool(rng.random() < (0.7 if event else 0.2))))
    rows += [(90, 0.7, False, 1.0, False)]  # after 60, so pooled with it
    got = {r["lead"]: r["p"] for r in learned.lead_thresholds(spark.createDataFrame(rows, "lead int, prob double, event boolean, w double, said boolean"), []).collect()}
    leads = sorted({r[0] for r in rows})
    for i, lead in enumerate(leads):
        near = [r for r in rows if r[0] in leads[max(0, i - 1) : i + 2]]

        def rates(says):
            h, m, f = (sum(r[3] for r in near if r[2] is e and says(r) is s) for e, s in ((True, True), (True, False), (False, True)))
            part = lambda a, b: a / b if b else float("nan")
            return part(h, h + m), part(f, h + f), part(h, h + m + f), part(h + f, h + m)

        pod, far, _, bias = rates(lambda r: r[4])
        each = [(k / 100, rates(lambda r, k=k: int(np.floor(round(r[1] * 100, 6))) >= k)) for k in range(5, 96)]
        fit = [(-round(s[2], 9), p) for p, s in each if s[0] >= pod and s[1] <= far]
        off = [(round(abs(s[3] - bias), 9), p) for p, s in each if np.isfinite(s[3]) and np.isfinite(bias)]
        assert got[lead] == pytest.approx(min(fit)[1] if fit else min(off)[1] if off else 0.5), lead


def tree(feature, threshold, left, right, default, missing, value):
    return {"feature": feature, "threshold": threshold, "left": left, "right": right, "default_left": default, "missing": missing, "value": value}


def test_flat_trees_equal_columns(spark, tmp_path):
    leaf = lambda n: ([-1] * n, [0.0] * n, [0] * n, [0] * n)
    ts = []
    for missing in (trees.NONE, trees.ZERO, trees.NAN):
        for default in (True, False):
            f, t, a, b = (x + y for x, y in zip(([0, 1], [0.5, -0.1], [1, 3], [2, 4]), leaf(3)))
            ts.append(tree(f, t, a, b, [default] * 5, [missing] * 5, [0, 0, 0.7, -0.4, 0.2 + missing]))
    text = json.dumps({"set": "s", "fold": 0, "features": ["a", "b"], "classes": [
        {"dbz": 20.0, "trees": ts, "calib_x": [0.2, 0.5, 0.9], "calib_y": [0.1, 0.5, 1.0], "pstar": {"10": 0.3, "30": 0.6}},
        {"dbz": 40.0, "trees": ts[:2], "calib_x": [], "calib_y": [], "pstar": {}},
    ]})
    model = learned.Model(text)
    values = [None, float("nan"), 0.0, -1.0, 0.4, 0.6, 2.0]
    rows = [(a, b, e) for a in values for b in values for e in (-32.0, 15.0, 25.0, 55.0)]
    table = spark.createDataFrame(rows, "a double, b double, e double")
    path = f"file://{tmp_path}"
    bundles.save({("s", 0): text, ("s", 1): text, ("s", -1): text}, path)
    found = bundles.bundles(spark, path)
    assert bundles.sets(found).collect() == [("s", True)] and bundles.faults(found, ["a", "b"]).count() == 0
    ps = bundles.probabilities(found.where("name = 's_fold0'").first())
    x = np.array([[np.nan if v is None else v for v in r[:2]] for r in rows])
    p = model.probabilities(x)
    for lead in (10, 20, 21, 90):
        cuts = [trees.cut_at(F.lit(lead), {10: 0.3, 30: 0.6}), trees.cut_at(F.lit(lead), {})]
        want = table.select(*[c.alias(f"p{i}") for i, c in enumerate(ps)], move_into_band(F.col("e"), ps, cuts, [20.0, 40.0]).alias("dbz")).toPandas()
        assert np.allclose(p, want[["p0", "p1"]]) and np.allclose(model.moved(np.array([r[2] for r in rows]), lead, p), want["dbz"])


def made_up(spark, garble=None):
    """Feature rows of 30 regions: what comes is the members' mean, more or less as their probability says. garble: the observations of that
    fold are turned round."""
    rng = np.random.default_rng(8)
    out = []
    for region in range(30):
        lat, lon = region * 1.7, region * 5.1
        for i in range(60):
            mean = float(rng.uniform(5, 50))
            prob = float(rng.random())
            obs = mean + 24 * (prob - 0.5) + float(rng.normal(0, 2))
            if garble is not None and learned.fold_at(lat, lon) == garble:
                obs = 50 - obs
            out.append((region, f"r{region}", lat, lon, 600 * i, (10.0, 20.0)[i % 2], obs, mean, prob))
    t = spark.createDataFrame(out, "region int, name string, lat double, lon double, t long, lead double, obs double, m_mean double, m_prob double")
    filled = t.select("region", "name", "t", "obs", F.lit(1.0).alias("weight"), geo.fold(F.col("lat"), F.col("lon")).alias("fold"), *[F.col(n) if n in ("lead", "m_mean", "m_prob") else F.lit(None).cast("double").alias(n) for n in features.NAMES])
    return filled.repartition(3)


def test_models_never_see_their_fold_and_beat_the_mean(spark, tmp_path):
    rows = made_up(spark)
    fits = learned.left_out(rows, ["ens"], (0, 1, -1), classes=(20.0,), settings=SMALL)
    assert set(fits) == {("ens", 0), ("ens", 1), ("ens", -1)}
    for one in fits.values():
        assert {r[:2] for r in one.report} == {(20.0, 10), (20.0, 20)}
        for _, _, pstar, _, _, csi, _, _, ens_csi in one.report:
            assert 0.05 <= pstar <= 0.95 and csi > ens_csi, one.report
    assert learned.left_out(made_up(spark, garble=1), ["ens"], (1,), classes=(20.0,), settings=SMALL)["ens", 1].model.bundle == fits["ens", 1].model.bundle
    assert fits["ens", 0].model.bundle != fits["ens", 1].model.bundle != fits["ens", -1].model.bundle
    cut = learned.left_out(rows, ["ens"], (0,), until=0, classes=(20.0,), settings=SMALL)["ens", 0]  # nothing is known yet
    assert cut.report == [] and cut.model.cut(0, 10) == 0.5
    model = fits["ens", -1].model
    told = learned.parity(rows, model, 7)
    assert len(told) == 7 and told == learned.parity(rows.repartition(5), model, 7) and learned.parity(rows.limit(0), model) == []
    path = f"file://{tmp_path}"
    bundles.save({("ens", -1): model.bundle}, path)
    table = spark.createDataFrame([[*r["row"]] for r in told], StructType.fromDDL(", ".join(f"{n} double" for n in model.names)))
    ps = bundles.probabilities(bundles.bundles(spark, path).first())
    assert np.allclose([tuple(r) for r in table.select(*ps).collect()], [r["probs"] for r in told])


def test_sets_and_comparisons():
    assert len(learned.names_of("all")) == 47 and learned.names_of("ens")[0] == "lead" and len(learned.names_of("radar")) == 34
    assert learned.usable(["radar", "all", "no_sat", "no_nwp", "ens"], nwp=False, sat=True) == ["radar", "no_nwp", "ens"]
    assert learned.usable(["radar", "all"], nwp=True, sat=True) == ["radar", "all"]
    v = issues.default_variants(4)
    assert learned.comparisons(v, ["ens", "radar"]) == [("mean+trend", "ml-radar"), ("ml-ens", "ml-radar")] and learned.comparisons(v, ["ens"]) == []
    assert learned.member_names(issues.Rules(), 4) == ["LK+trend", "HS+trend", "TREC+trend"] and learned.member_names(issues.Rules(), 2) == [None] * 3


def test_folds_equal_the_columns(spark):
    places = [(21.0, 105.8, 0), (-33.9, 151.2, 1), (40.7, -74.0, 0), (10.8, 106.7, 1)]
    got = spark.createDataFrame(places, "lat double, lon double, f int").select("f", geo.fold(F.col("lat"), F.col("lon")).alias("g")).collect()
    assert all(r["f"] == r["g"] == learned.fold_at(*p[:2]) for r, p in zip(got, places))


def test_the_issue_loop_scores_learned_forecasts_as_rows_would(spark):
    """Two regions of either fold, with weather; against forecasts of the feature rows, one by one."""
    rows = []
    for name in "ab":
        for k in range(12):
            g = band(k)
            at = np.flatnonzero(g > -32)
            rows.append((name, 21_600 - 3600 + 600 * k, 192, 192, at.tolist(), g.ravel()[at].tolist()))
    frames = spark.createDataFrame(rows, "region string, t long, w int, h int, at array<int>, dbz array<float>")
    places = {"a": (21.0, 105.8), "b": (-33.9, 151.2)}
    regions = spark.createDataFrame([(k, *v) for k, v in places.items()], "region string, lat double, lon double")
    weather = spark.createDataFrame([(r, 3600 * h, [float(h)] * 7) for r in "ab" for h in range(3, 12)], "region string, t long, values array<double>")
    motion = histories.Motion(pairs=3)
    rules = issues.Rules(variants=issues.default_variants(3), leads=(10, 30), every=16, radius=1, strong=0.0)
    feature = features.NAMES.index
    split = lambda n, cut, low, high: tree([feature(n), -1, -1], [cut, 0, 0], [1, 0, 0], [2, 0, 0], [True] * 3, [2, 0, 0], [0.0, low, high])

    def model(fold, low):
        cls = lambda dbz, ts: {"dbz": dbz, "trees": ts, "calib_x": [], "calib_y": [], "pstar": {"10": 0.4, "30": 0.5}}
        return learned.Model(json.dumps({"set": "all", "fold": fold, "features": list(features.NAMES), "classes": [cls(20.0, [split("m_mean", 28.0, low, 2.0), split("nwp_cape", 6.2, -0.3, 0.3)]), cls(40.0, [split("up_max", 38.0, -2.0, 0.1)])]}))

    models = {("all", 0): model(0, -2.0), ("all", 1): model(1, 0.8)}
    sources = features.sources(frames, regions, weather)
    got = {(r["variant"], r["lead"]): r for r in issues.lead_scores(learned.scored(sources, rules, models, motion)).collect()}
    want = {}
    for r in features.issue_rows(sources, rules, motion).collect():
        one = models["all", learned.fold_at(*places[r["region"]])]
        x = np.array([[[np.nan if r[n] is None else r[n] for n in features.NAMES]]])
        dbz, prob = learned.forecast_row(one, x, (int(r["lead"]),))
        c = want.setdefault(int(r["lead"]), [0, 0, 0, 0, 0.0, 0])
        said, came = int(dbz[0, 0] >= 20), int(r["obs"] >= 20)
        c[[[3, 1], [2, 0]][said][came]] += 1
        c[4] += (prob[0, 0] - came) ** 2
        c[5] += 1
    for lead, (h, m, f, n, brier, count) in want.items():
        r = got["ml-all", lead]
        assert (r["hits"], r["misses"], r["false_alarms"], r["negatives"]) == (h, m, f, n) and r["brier"] == pytest.approx(brier / count, abs=1e-6)
        assert r["accumulated_mae"] is not None and got["mean+trend", lead]["hits"] > 0 and f > 0
    names = {v for v, _ in got}
    assert names == {"persistence", "ml-all", *(v.name for v in rules.variants)}
    before = {(r["variant"], r["lead"]): r for r in issues.lead_scores(issues.scored(frames, rules, motion)).collect()}
    assert all(got[k] == r for k, r in before.items())  # what was scored before is as it was
    with pytest.raises(ValueError, match="either fold"):
        learned.scored(sources, rules, {("all", 0): models["all", 0]}, motion)
