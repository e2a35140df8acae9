"""Frame kernels against plain loops and frames whose motion is known."""

import itertools

import numpy as np
import pytest

from pluvia.operators import kernels as K


def cells(shape, centres, shift=(0, 0), peak=50.0, slope=25.0):
    y, x = np.indices(shape)
    g = np.full(shape, -32.0)
    for cx, cy, r in centres:
        d = np.hypot(x - cx - shift[0], y - cy - shift[1])
        g = np.maximum(g, np.where(d < 1.5 * r, peak - slope * d / r, -32.0))
    return g


CENTRES = [(80, 90, 18), (150, 70, 12), (110, 160, 22), (170, 170, 10)]


def test_matching_recovers_a_shift():
    prev, cur = cells((256, 256), CENTRES), cells((256, 256), CENTRES, (5, -3))
    v, valid = K.match_blocks(prev, cur)
    assert valid.any() and np.abs(np.median(v[valid], axis=0) - (5, -3)).max() < 1
    full = K.finish(v / 10, valid)
    assert np.isfinite(full).all() and np.abs(full.mean((0, 1)) * 10 - (5, -3)).max() < 1
    assert not K.match_blocks(np.full((64, 64), -32.0), np.full((64, 64), -32.0))[1].any()


def test_matching_equals_plain_loops():
    rng = np.random.default_rng(0)
    prev = np.where(rng.random((24, 32)) < 0.5, rng.integers(5, 60, (24, 32)), -32).astype(float)
    cur = np.roll(prev, (1, 2), (0, 1)) + rng.integers(0, 3, (24, 32))
    got, ok = K.match_blocks(prev, cur, 8, 3)
    p, c = np.pad(K.signal(prev), 3), K.signal(cur)
    for by, bx in itertools.product(range(3), range(4)):
        t = c[by * 8 : by * 8 + 8, bx * 8 : bx * 8 + 8]
        best = None
        for j, i in itertools.product(range(-3, 4), repeat=2):
            w = p[by * 8 - j + 3 : by * 8 - j + 11, bx * 8 - i + 3 : bx * 8 - i + 11]
            r = -2.0 if w.std() == 0 or t.std() == 0 else ((t - t.mean()) * (w - w.mean())).mean() / t.std() / w.std()
            if best is None or r > best[0] + 1e-12 or (abs(r - best[0]) <= 1e-12 and i * i + j * j < best[1] ** 2 + best[2] ** 2):
                best = (r, i, j)
        if ok[by, bx]:
            assert np.abs(got[by, bx] - best[1:]).max() <= 0.5 and best[0] >= 0.5


@pytest.mark.parametrize("shift", [(5, -3), (3, 2)])
def test_dense_flow_recovers_a_shift(shift):
    prev, cur = cells((192, 192), CENTRES), cells((192, 192), CENTRES, shift)
    v, valid = K.flow_field(K.horn_schunck(prev, cur), prev, cur, None, 16, 10)
    assert np.abs(np.median(v[valid], axis=0) * 10 - shift).max() < 0.8
    flow, solved = K.lucas_kanade(prev, cur)
    v, valid = K.flow_field(flow, prev, cur, solved, 16, 10)
    assert np.abs(np.median(v[valid], axis=0) * 10 - shift).max() < 0.8


def test_box_sums_and_pyramid():
    a = np.random.default_rng(1).random((9, 17))
    want = [[a[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].sum() for x in range(17)] for y in range(9)]
    assert np.allclose(K.box_sum(a, 2), want)
    assert [p.shape for p in K.pyramid(np.zeros((64, 64)), 4)] == [(64, 64), (32, 32), (16, 16)]


def test_trend_and_gain():
    prev, cur = cells((256, 256), CENTRES), cells((256, 256), CENTRES, (5, 0))
    v = np.full((8, 8, 2), (0.5, 0.0))
    assert np.abs(K.trend(prev, cur, v, 32, 10, 15)).max() < 0.15
    grown = np.where(cur >= 10, cur + 6, cur)
    assert 0.3 < K.field_at(K.trend(prev, grown, v, 32, 10, 15), 32, np.array([110.0]), np.array([160.0]))[0] < 0.7
    a, b = cells((128, 128), [(60, 64, 12)]), cells((128, 128), [(65, 64, 12)])
    assert K.translation_gain(a, b, (0.5, 0), 10, 62, 64, 20) > 0.5
    assert K.translation_gain(a, b, (0, 0), 10, 62, 64, 20) == 0
    assert K.translation_gain(a, b, (-0.5, 0), 10, 62, 64, 20) <= 0
    dry = np.full((128, 128), -32.0)
    assert K.translation_gain(dry, dry, (0.5, 0), 10, 62, 64, 20) is None


def test_trajectories_follow_a_rotation():
    """A full turn in 120 minutes about the middle; the rain lies a quarter of a turn upstream."""
    size, n = 8, 32
    y, x = (a.astype(float) * size + size / 2 - 128 for a in np.indices((n, n)))
    w = 2 * np.pi / 120
    v = np.stack([-w * y, w * x], -1)
    rain = cells((256, 256), [(128, 68, 8)], peak=45, slope=10)
    dbz, prob = K.trajectories(rain, v, size, np.array([188.0]), np.array([128.0]), 60)
    first = int(np.argmax(dbz[0] >= 20))
    assert 24 <= first <= 31 and dbz[0][30] >= 40 and 0 <= prob.min() <= prob.max() <= 1


def test_assignment_is_the_cheapest():
    rng = np.random.default_rng(2)
    for n in (1, 2, 4, 6):
        for _ in range(20):
            cost = np.round(rng.random((n, n)) * 10, 1)
            got = K.assignment(cost)
            assert sorted(got) == list(range(n))
            assert abs(cost[np.arange(n), got].sum() - min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))) < 1e-9


def test_labels():
    g = np.array([[40, 40, 0], [0, 40, 0], [40, 0, 40]], float)
    assert K.labels(g, 30).tolist() == [[0, 0, -1], [-1, 0, -1], [6, -1, 8]]


def test_averages_and_point_echo():
    a, b = np.full((2, 2, 2), 1.0), np.full((2, 2, 2), 3.0)
    one, none = np.ones((2, 2), bool), np.array([[True, False], [False, False]])
    v, ok = K.averaged([a, b], [one, none], [3, 1])
    assert v[0, 0].tolist() == [1.5, 1.5] and v[1, 1].tolist() == [1, 1] and ok.all()
    g = np.full((5, 5), -32.0)
    g[2, 2] = 50.0
    at = np.array([2.0])
    assert K.point_echo(g, at, at, 1, 40)[0] == 50 and K.point_echo(g, at, at, 1, 0)[0] == -32


def test_mean_field_over_different_blocks():
    a, b = np.full((4, 4, 2), (1.0, 2.0)), np.full((2, 2, 2), (4.0, 8.0))
    assert np.allclose(K.mean_field([a, b], [8, 16], [2, 1]), (2, 4))
    ramp = np.stack(np.meshgrid(np.arange(4.0), np.zeros(4)), -1)
    assert np.allclose(K.mean_field([ramp], [8], [1]), ramp)


def test_gain_equals_reads_of_the_whole_frame():
    rng = np.random.default_rng(5)
    prev, cur = (np.where(rng.random((40, 50)) < 0.6, rng.integers(5, 60, (40, 50)), -32).astype(float) for _ in range(2))
    y, x = np.indices(cur.shape)
    for _ in range(60):
        v, (px, py), r = rng.normal(0, 1.5, 2), rng.uniform(-6, 55, 2), int(rng.integers(1, 14))
        disc = (x - round(px)) ** 2 + (y - round(py)) ** 2 <= r * r
        c, p = K.signal(cur)[disc], K.signal(prev)[disc]
        s = K.sample(K.signal(prev), x[disc] - v[0] * 10, y[disc] - v[1] * 10, 0.0)
        got = K.translation_gain(prev, cur, v, 10, px, py, r)
        if len(c) and ((c - p) ** 2).sum() >= len(c) and ((c > 0) | (p > 0)).sum() >= 0.02 * len(c):
            assert got == pytest.approx(1 - ((c - s) ** 2).sum() / ((c - p) ** 2).sum())
        else:
            assert got is None
