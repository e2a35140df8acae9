"""What the issue loop and the feature rows do on large tables (findings of round 4)."""

import numpy as np

from pluvia.operators import boosting, features, histories, issues, kernels
from pluvia.plans import issues as plans


def moving(n, side=24, seed=3):
    rng = np.random.default_rng(seed)
    g = np.where(rng.random((side, side)) < 0.4, rng.uniform(10, 60, (side, side)).round(), kernels.NO_ECHO)
    return {600 * k: np.roll(g, k, axis=1) + (rng.random(g.shape) < 0.05) for k in range(n)}


def test_flow_of_many_pairs_is_measured_at_once(monkeypatch):
    frames, calls, flow = moving(12), [], kernels.horn_schunck
    frames[600 * 40] = frames[0]  # across a gap
    alone = {}
    for method in ("HS", "LK"):
        for t in list(frames)[1:]:
            two = histories.Frames(plans.MOTION)
            for u in (t - 600, t):
                if u in frames:
                    two.put(u, frames[u])
            alone[method, t] = two.pair(method, t)
    monkeypatch.setattr(kernels, "horn_schunck", lambda *a: calls.append(len(a[0])) or flow(*a))
    held = histories.Frames(plans.MOTION)
    for t in list(frames)[:5]:
        held.put(t, frames[t])
    held.coming = lambda: ((t, g) for t, g in frames.items() if t not in held.grids)
    held.pair("HS", 600)
    assert calls == [11]
    for t in list(frames)[5:]:
        held.put(t, frames[t])
    for (method, t), want in alone.items():
        got = held.pair(method, t)
        assert (got is None) == (want is None)
        if want:
            assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
    assert calls == [11] and alone["HS", 600 * 40] is None


def test_issues_are_worked_out_at_once(monkeypatch):
    frames, calls, follow = moving(14), [], kernels.followed
    for rules in (plans.MATCHED, plans.ALL):
        held, alone, met = histories.Frames(plans.MOTION), issues.Tally(), issues.Tally()
        for t, g in frames.items():
            held.put(t, g)
        held.put(4800, np.full((24, 24), kernels.NO_ECHO))
        cover = np.zeros((24, 24), bool)
        cover[8:14, 8:16] = True
        times = [t for t in frames if issues.eligible(held, t, rules)]
        for mask in (None, cover):
            for t in times:
                alone.issue(held, t, mask, rules)
            some = [one for t in times if (one := met.taken(held, t, mask, rules))]
            monkeypatch.setattr(kernels, "followed", lambda *a: calls.append(1) or follow(*a))
            met.several(some, rules)
            monkeypatch.setattr(kernels, "followed", follow)
        assert alone.sums.keys() == met.sums.keys()
        for key, value in alone.sums.items():
            assert abs(value - met.sums[key]) <= 1e-9 * max(1, abs(value)), key
    assert len(calls) == 4


def test_the_issue_loop_runs_once_for_the_correlation(spark):
    rows = [("error", "a", 0.0, 3.0), ("error", "b", 0.0, 1.0), ("n_joint", "a", 0.0, 4.0), ("n_joint", "b", 0.0, 4.0)]
    rows += [("error_product", "a", 0.0, 9.0), ("error_product", "a", 1.0, 2.0), ("error_product", "b", 1.0, 5.0)]
    runs = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    tallied = spark.createDataFrame(rows, "measure string, variant string, at double, value double").mapInArrow(told, "measure string, variant string, at double, value double")
    got = {(r["a"], r["b"]): (r["n"], r["correlation"]) for r in issues.error_correlation(tallied, ["a", "b"]).collect()}
    want = (2 / 4 - 3 / 4 * 1 / 4) / ((9 / 4 - (3 / 4) ** 2) * (5 / 4 - (1 / 4) ** 2)) ** 0.5
    assert got == {("a", "a"): (4, 1.0), ("a", "b"): (4, round(want, 9)), ("b", "b"): (4, 1.0)}
    assert runs.value == len(rows)
    assert issues.error_correlation(tallied.where("measure = 'none'"), ["a", "b"]).collect() == []


def test_rain_of_many_scenes_is_followed_at_once(monkeypatch):
    frames, calls, carry = moving(9), [], kernels.carried
    held = histories.Frames(plans.MOTION)
    for t, g in frames.items():
        held.put(t, g)
    scenes = [features.scene_of(held, t, 10.5, 20.5, 2) for t in list(frames)[2:]]
    scenes.insert(1, features.bare(held, 600, 10.5, 20.5))
    rng = np.random.default_rng(5)
    x, y = rng.integers(8, 16, (2, len(scenes), 6)).astype(float)
    alone = [features.upstream([s], x[i : i + 1], y[i : i + 1], (10, 20, 30))[0] for i, s in enumerate(scenes)]
    monkeypatch.setattr(kernels, "carried", lambda *a: calls.append(1) or carry(*a))
    met = features.upstream(scenes, x, y, (10, 20, 30))
    assert len(calls) == 1 and met[1] is None
    for s, one, other, i in zip(scenes, alone, met, range(len(scenes)), strict=True):
        assert one is None and other is None or all(np.array_equal(a, b) for a, b in zip(one, other, strict=True))
        members, prob = rng.uniform(0, 60, (6, 3, 3)), rng.random((6, 3))
        assert np.array_equal(features.rows(s, x[i], y[i], (10, 20, 30), members, prob), features.rows(s, x[i], y[i], (10, 20, 30), members, prob, other), equal_nan=True)


def test_issues_wait_for_those_that_are_alike():
    went = []
    waiting = issues.Waiting(plans.ALL, lambda some: went.append(len(some)))
    grid, x = np.zeros((24, 24)), np.arange(16.0)
    one = issues.Issue(grid, x, x, np.ones((4, 4), bool), [grid] * 3, {str(i): None for i in range(7)})
    for _ in range(40):
        waiting.add(one)
    waiting.add(issues.Issue(grid, x[:8], x[:8], np.ones((4, 2), bool), [grid] * 3, one.carriers))
    waiting.settle()
    assert went == [36, 4, 1]
    large = np.zeros((768, 768))
    waiting.add(issues.Issue(large, x, x, np.ones((4, 4), bool), [large] * 3, one.carriers))
    assert went == [36, 4, 1, 1]


class Columns(np.ndarray):
    """Bins of which no single places are read."""

    def __getitem__(self, at):
        assert not (isinstance(at, tuple) and any(isinstance(a, np.ndarray) for a in at))
        return super().__getitem__(at)


def test_trees_compare_columns_and_no_row_walks_down():
    rng = np.random.default_rng(8)
    for depth in (0, 1, 3, 6):
        tree = boosting.Tree()
        level = [tree.leaf(0.5)]
        for _ in range(depth):
            some = [n for n in level if rng.random() < 0.8] or level[:1]
            level = [c for n in some for c in tree.split(n, int(rng.integers(3)), int(rng.integers(63)), bool(rng.integers(2)))]
        tree.value = rng.normal(size=len(tree.value)).tolist()
        bins = rng.integers(0, boosting.SLOTS, (500, 3)).astype(np.uint8)
        want = []
        for row in bins:
            at = 0
            while tree.feature[at] >= 0:
                b = row[tree.feature[at]]
                at = tree.left[at] if (tree.default_left[at] if b == boosting.GONE else b <= tree.cut[at]) else tree.right[at]
            want.append(at)
        assert tree.reached(bins.view(Columns)).tolist() == want
        assert tree.scores(bins.view(Columns)).tolist() == [tree.value[a] for a in want]
        assert tree.scores(bins[:0]).shape == (0,)
