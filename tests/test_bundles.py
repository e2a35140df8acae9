"""Model bundles from files."""

import gzip
import json

from pluvia.sources import bundles

TREE = {"feature": [0, -1, -1], "threshold": [1.0, 0, 0], "left": [1, -1, -1], "right": [2, -1, -1], "default_left": [True, False, False], "missing": [2, 0, 0], "value": [0.0, -2.0, 2.0]}


def bundle(**more):
    return {"set": "radar", "fold": 0, "features": ["lead", "nwp_cape"], "classes": [{"dbz": 20.0, "trees": [TREE], "calib_x": [0.0, 1.0], "calib_y": [0.1, 0.9], "pstar": {"10": 0.4}}, {"dbz": 30.0, "trees": [TREE, TREE], "pstar": {}}]} | more


def test_bundles_are_read_checked_and_scored(spark, tmp_path):
    broken = {**TREE, "left": [0, -1, -1]}
    for name, b in {"radar_fold0": bundle(), "radar_fold1": bundle(fold=1), "all_fold0": bundle(), "bad": bundle(classes=[{"dbz": 20.0, "trees": [broken]}]), "odd": bundle(features=["what"]), "none": bundle(classes=[])}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(b))
    (tmp_path / "radar.json.gz").write_bytes(gzip.compress(json.dumps(bundle(fold=-1)).encode()))
    found = bundles.bundles(spark, f"file://{tmp_path}")
    assert {tuple(r) for r in bundles.faults(found, ["lead", "nwp_cape"]).collect()} == {("bad", "malformed tree"), ("odd", "unknown feature"), ("none", "no classes")}
    assert [tuple(r) for r in bundles.sets(found).collect()] == [("radar", True)]
    assert found.where("name = 'odd'").select(bundles.uses("nwp_")).first()[0] is False and found.where("name = 'radar'").select(bundles.uses("nwp_")).first()[0] is True
    rows = spark.createDataFrame([(0.0, None), (5.0, 1.0), (None, None)], "lead double, nwp_cape double")
    got = [tuple(round(x, 4) for x in r) for r in rows.select(*bundles.probabilities(found.where("name = 'radar'").first())).collect()]
    low, high = 1 / (1 + 2.718281828459045**2), 1 / (1 + 2.718281828459045**-2)
    assert got == [(round(0.1 + 0.8 * low, 4), round(1 / (1 + 2.718281828459045**4), 4)), (round(0.1 + 0.8 * high, 4), round(0.1 + 0.8 * high, 4)), got[0]]
