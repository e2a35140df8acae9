"""Weather answers of both shapes, and the store of past days."""

import json

from pluvia.sources import weather as W


def place(hours, lat=21.0, **more):
    return {"latitude": lat, "longitude": 105.75, "hourly": {"time": [3600 * h for h in hours], "cape": [100.0 * h for h in hours]} | more}


def test_answers_of_both_shapes(spark):
    bodies = [
        (1, 1, json.dumps(place(range(24), showers=[None] * 24))),
        (2, 2, json.dumps([place(range(3)), place(range(2), lat=5.5, cape=[7.0], lifted_index=[1, 2, 3])])),
        (3, 1, json.dumps([place([0])])),
        (4, 1, json.dumps({"error": True, "reason": "limit"})),
        (5, 2, json.dumps([place([0])])),
        (6, 2, json.dumps(place([0]))),
        (7, 1, "not json"),
        (8, 1, None),
        (9, 1, json.dumps({"hourly": {"cape": [1]}})),
        (10, 1, json.dumps(place([0, 1], cape=["x", "y"]))),
        (11, 1, json.dumps(place([]))),
    ]
    t = spark.createDataFrame(bodies, "request int, asked int, body string")
    got = {(r["request"], r["place"], r["t"]): r for r in W.hourly(t).collect()}
    assert sorted(got) == [(1, 0, 3600 * h) for h in range(24)] + [(2, 0, 0), (2, 0, 3600), (2, 0, 7200), (2, 1, 0), (2, 1, 3600), (3, 0, 0)]
    assert got[1, 0, 7200]["cape"] == 200 and got[1, 0, 7200]["showers"] is None and got[1, 0, 0]["lat"] == 21.0
    assert [got[2, 1, h]["cape"] for h in (0, 3600)] == [7.0, None] and got[2, 1, 3600]["lifted_index"] == 2 and got[2, 1, 0]["lat"] == 5.5
    assert {r["request"]: r["fault"] for r in W.faults(t).collect()} == {4: "refused", 5: "another number of answers", 6: "not a list of answers", 7: "not a list of answers", 8: "not a list of answers", 9: "no times", 10: "no numbers"}
    assert W.hourly(t.limit(0)).count() == 0


def test_days_are_stored_once_and_never_today(spark, tmp_path):
    path, now = f"file://{tmp_path}/days", 3 * W.DAY + 500
    names = "point string, t long, " + ", ".join(f"{v} double" for v in W.VARIABLES)
    row = lambda p, t, cape=1.0: (p, t, cape, *[None] * 6)
    first = spark.createDataFrame([row("a", 100), row("a", 100), row("a", W.DAY), row("b", 2 * W.DAY + 5), row("a", 3 * W.DAY), row("a", 9 * W.DAY)], names)
    none = spark.createDataFrame([], "point string, day long")
    W.store_days(W.fresh_days(first, none, now), path)
    stored = W.read_days(spark, path, 0, 9 * W.DAY)
    assert sorted((r["point"], r["t"], r["day"]) for r in stored.collect()) == [("a", 100, 0), ("a", W.DAY, 1), ("b", 2 * W.DAY + 5, 2)]
    again = spark.createDataFrame([row("a", 200, 5.0), row("b", 300, 5.0)], names)
    fresh = W.fresh_days(again, stored, now)
    assert [(r["point"], r["t"]) for r in fresh.collect()] == [("b", 300)]
    W.store_days(fresh, path)
    one = W.read_days(spark, path, 0, 10)
    assert sorted((r["point"], r["t"], r["cape"]) for r in one.collect()) == [("a", 100, 1.0), ("b", 300, 5.0)]
    assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().toString()
