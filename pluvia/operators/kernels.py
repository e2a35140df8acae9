"""Numpy kernels over whole frames: matching, dense flow, trends, trajectories, rain cells.

Spark deals frames (or pairs of them) to tasks; a frame is a bounded array of (rows, columns) and a
kernel sees one pair at a time. Fields are arrays of (block rows, block columns, 2) in pixels a
minute, x before y, with a mask of the blocks that were measured.
"""

from __future__ import annotations

import heapq
from functools import cache

import numpy as np

NO_ECHO = -32.0
#: Least share of rainy pixels in a matched block, least correlation, blocks within
#: which measured neighbours outweigh the whole field.
MIN_FRAC, MIN_CORR, REACH = 0.05, 0.5, 4.0
#: Floor of echoes in trends and the fastest trend (dBZ a minute); ceiling of echoes.
TREND_FLOOR, TREND_MAX, CEILING = 10.0, 1.0, 60.0


def signal(g: np.ndarray) -> np.ndarray:
    """The matching signal: nothing below 10 dBZ, then the excess up to 65."""
    return np.where(g >= 10, np.minimum(g, 65) - 10, 0.0)


def shifted(a: np.ndarray, dx: int, dy: int, fill: float = 0.0) -> np.ndarray:
    """out[y, x] = a[y + dy, x + dx], fill outside; of every frame of a stack."""
    h, w = a.shape[-2:]
    out = np.full(a.shape, fill, a.dtype)
    y0, y1, x0, x1 = max(0, -dy), min(h, h - dy), max(0, -dx), min(w, w - dx)
    if y0 < y1 and x0 < x1:
        out[..., y0:y1, x0:x1] = a[..., y0 + dy : y1 + dy, x0 + dx : x1 + dx]
    return out


def _pixels(a: np.ndarray, i: np.ndarray, j: np.ndarray, fill: float, of: np.ndarray | int = 0) -> np.ndarray:
    """a[j, i], fill outside. of: the frame of a stack that each is read from."""
    h, w = a.shape[-2:]
    ok = (i >= 0) & (i < w) & (j >= 0) & (j < h)
    return np.where(ok, a.ravel().take((of * h + j) * w + i, mode="clip"), fill)


def sample(a: np.ndarray, x: np.ndarray, y: np.ndarray, fill: float, of: np.ndarray | int = 0) -> np.ndarray:
    """Bilinear reads between pixel centres; pixels outside read fill. of: as for single pixels."""
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    tx, ty = x - x0, y - y0
    at = lambda i, j: _pixels(a, x0 + i, y0 + j, fill, of)
    return (at(0, 0) * (1 - tx) + at(1, 0) * tx) * (1 - ty) + (at(0, 1) * (1 - tx) + at(1, 1) * tx) * ty


def blocks(a: np.ndarray, size: int) -> np.ndarray:
    """(block rows, block columns, size * size) of the whole blocks of a frame."""
    bh, bw = a.shape[0] // size, a.shape[1] // size
    return a[: bh * size, : bw * size].reshape(bh, size, bw, size).swapaxes(1, 2).reshape(bh, bw, size * size)


def match_blocks(prev: np.ndarray, cur: np.ndarray, size: int = 32, search: int = 16, rain: float = 15.0) -> tuple[np.ndarray, np.ndarray]:
    """(displacement in pixels of each block of cur against prev, whether it was matched) by normalised
    cross-correlation over all whole-pixel shifts, then a parabola through the peak.

    All blocks are matched at once, a row of shifts at a time; equal peaks go to the shorter shift.
    """
    n, span, shifts = size * size, range(-search, search + 1), 2 * search + 1
    t = blocks(signal(cur), size)
    rainy = (blocks(cur, size) >= rain).sum(2) >= MIN_FRAC * n
    t_sum, t_spread = t.sum(2), n * (t * t).sum(2) - t.sum(2) ** 2
    (bh, bw), p = rainy.shape, np.pad(signal(prev), search)
    # Window sums for every shift are four reads of an integral image each; only products are summed anew.
    w_sum, w_squares = (_corners(np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))), size, shifts, bh, bw) for a in (p, p * p))
    w_spread = n * w_squares - w_sum**2
    ok = (w_spread > 1e-9 * n * n) & (t_spread > 0)
    square, products = t.reshape(bh, bw, size, size), np.zeros((shifts, shifts, bh, bw))
    rows, columns = p.strides
    # A row of shifts at a time, so that what is read at once does not grow with the square of the search.
    for y in np.flatnonzero(ok.any((1, 2, 3))):
        w = np.lib.stride_tricks.as_strided(p[y:], (shifts, bh, bw, size, size), (columns, rows * size, columns * size, rows, columns), writeable=False)
        np.einsum("abyx,iabyx->iab", square, w, out=products[y])
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.where(ok, (n * products - t_sum * w_sum) / np.sqrt(t_spread * w_spread), -np.inf)
    corr = corr[::-1, ::-1]  # reads further down are shifts further up
    order = sorted(((i * i + j * j, j, i) for j in span for i in span))
    flat = np.stack([corr[j + search, i + search] for _, j, i in order])
    best = flat.argmax(0)
    peak = flat.max(0)
    valid = rainy & (t_spread > 0) & (peak >= MIN_CORR)
    steps = np.array([(i, j) for _, j, i in order])[best]
    out = np.zeros((*rainy.shape, 2))
    edge = np.pad(corr, ((1, 1), (1, 1), (0, 0), (0, 0)), constant_values=-np.inf)
    rows, columns = np.indices(rainy.shape)
    for axis, (di, dj) in enumerate(((1, 0), (0, 1))):
        near = [edge[steps[..., 1] + search + 1 + s * dj, steps[..., 0] + search + 1 + s * di, rows, columns] for s in (-1, 1)]
        out[..., axis] = steps[..., axis] + subpixel(near[0], peak, near[1])
    return np.where(valid[..., None], out, 0.0), valid


def _corners(a: np.ndarray, size: int, shifts: int, bh: int, bw: int) -> np.ndarray:
    """(rows read down, columns read across, block rows, block columns): sums over adjoining squares by an integral image."""
    rows, columns = a.strides
    c = np.lib.stride_tricks.as_strided(a, (shifts, shifts, bh + 1, bw + 1), (rows, columns, rows * size, columns * size), writeable=False)
    return c[..., 1:, 1:] - c[..., :-1, 1:] - c[..., 1:, :-1] + c[..., :-1, :-1]


def subpixel(left: np.ndarray, centre: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        d = left - 2 * centre + right
        return np.where(np.isfinite(left) & np.isfinite(right) & (d < 0), np.clip(0.5 * (left - right) / d, -0.5, 0.5), 0.0)


def _medians(a: np.ndarray) -> np.ndarray:
    """The median along the first axis, NaN left out."""
    a = np.sort(a, axis=0)  # NaN last
    n = (~np.isnan(a)).sum(0)[None]
    return (np.take_along_axis(a, (n - 1) // 2, 0)[0] + np.take_along_axis(a, n // 2, 0)[0]) / 2


def finish(v: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """A field without gaps: measured blocks take the median of the measured ones around, the others
    those by inverse square distance, against the median of all."""
    if not valid.any():
        return np.zeros_like(v)
    whole = _medians(v[valid])
    h, w = valid.shape
    wide = np.full((h + 2, w + 2, v.shape[2]), np.nan)
    wide[1:-1, 1:-1][valid] = v[valid]
    around = np.stack([wide[j : j + h, i : i + w] for j in range(3) for i in range(3)])
    smooth = np.where(valid[..., None], v, 0.0)
    smooth[valid] = _medians(around[:, valid])
    at, out = np.argwhere(valid), smooth.copy()
    for y, x in np.argwhere(~valid):
        weight = 1 / ((at[:, 0] - y) ** 2 + (at[:, 1] - x) ** 2)
        prior = 1 / REACH**2
        out[y, x] = (whole * prior + (smooth[at[:, 0], at[:, 1]] * weight[:, None]).sum(0)) / (prior + weight.sum())
    return out


def averaged(fields: list[np.ndarray], valids: list[np.ndarray], weights: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Weighted mean of fields over the blocks that each of them measured (not yet finished)."""
    w = np.stack([v * k for v, k in zip(valids, weights, strict=True)])
    total = w.sum(0)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = (np.stack(fields) * w[..., None]).sum(0) / total[..., None]
    return np.where(total[..., None] > 0, mean, 0.0), total > 0


def field_at(v: np.ndarray, size: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The field (or trend) at pixels, bilinear between block centres and flat beyond them."""
    h, w = v.shape[:2]
    fx, fy = np.clip(x / size - 0.5, 0, w - 1), np.clip(y / size - 0.5, 0, h - 1)
    x0, y0 = fx.astype(int), fy.astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    tx, ty = fx - x0, fy - y0
    if v.ndim == 3:
        tx, ty = tx[..., None], ty[..., None]
    return (v[y0, x0] * (1 - tx) + v[y0, x1] * tx) * (1 - ty) + (v[y1, x0] * (1 - tx) + v[y1, x1] * tx) * ty


def mean_field(fields: list[np.ndarray], sizes: list[int], weights: list[float]) -> np.ndarray:
    """Weighted mean of fields of different blocks, on the blocks of the first."""
    h, w = fields[0].shape[:2]
    y, x = ((a + 0.5) * sizes[0] for a in np.indices((h, w)))
    total = sum(weights)
    return sum(field_at(f, s, x, y) * (k / total) for f, s, k in zip(fields, sizes, weights, strict=True))


def trend(prev: np.ndarray, cur: np.ndarray, v: np.ndarray, size: int, minutes: float, rain: float) -> np.ndarray:
    """dBZ a minute of each block along the motion, smoothed over the blocks that rain enough."""
    h, w = v.shape[0] * size, v.shape[1] * size
    y, x = np.indices((h, w))
    move = field_at(v, size, x.astype(float), y.astype(float)) * minutes
    half_up = lambda a: np.copysign(np.floor(np.abs(a) + 0.5), a).astype(int)  # noqa: E731  halves away from zero
    px, py = half_up(x - move[..., 0]), half_up(y - move[..., 1])
    inside = (px >= 0) & (py >= 0) & (px < prev.shape[1]) & (py < prev.shape[0])
    was = np.where(inside, prev[np.clip(py, 0, prev.shape[0] - 1), np.clip(px, 0, prev.shape[1] - 1)], NO_ECHO)
    now = cur[:h, :w]
    wet = (now >= rain) | (was >= rain)
    change = np.where(wet, np.maximum(now, TREND_FLOOR) - np.maximum(was, TREND_FLOOR), 0.0)
    n = blocks(wet.astype(float), size).sum(2)
    ok = n >= MIN_FRAC * size * size
    raw = np.where(ok, blocks(change, size).sum(2) / np.maximum(n, 1) / minutes, 0.0)
    spread = lambda a: sum(shifted(a, i, j) for i in (-1, 0, 1) for j in (-1, 0, 1))
    count = spread(ok.astype(float))
    return np.where(count > 0, np.clip(spread(raw) / np.maximum(count, 1), -TREND_MAX, TREND_MAX), 0.0)


#: Pixels of discs that are held at once.
HELD = 1 << 18


def translation_gains(prev: np.ndarray, cur: np.ndarray, v: np.ndarray, minutes: float, x: np.ndarray, y: np.ndarray, r: int) -> np.ndarray:
    """How much better moving the rain by a point's own v explains the disc around it than leaving it; NaN with too little
    rain or change. Points go many at a time, over their discs or, where that is less, over the whole frame."""
    h, w = cur.shape
    now, was = signal(cur), signal(prev)
    cx, cy = (np.copysign(np.floor(np.abs(a) + 0.5), a).astype(int) for a in (x, y))
    i, j = spots(r)
    whole = h * w <= len(i)
    out = np.full(len(x), np.nan)
    n = max(1, HELD // (h * w if whole else len(i)))
    for part in (slice(at, at + n) for at in range(0, len(x), n)):
        if whole:
            rows, columns = (a.reshape(-1, 1) for a in np.indices((h, w)))
            inside = (columns - cx[part]) ** 2 + (rows - cy[part]) ** 2 <= r * r
            c, p = now.reshape(-1, 1), was.reshape(-1, 1)
        else:
            rows, columns = cy[part] + j, cx[part] + i
            inside = (rows >= 0) & (rows < h) & (columns >= 0) & (columns < w)
            c, p = _pixels(now, columns, rows, 0.0), _pixels(was, columns, rows, 0.0)
        s = sample(was, columns - v[part, 0] * minutes, rows - v[part, 1] * minutes, 0.0)
        size, summed = inside.sum(0), lambda a, inside=inside: np.where(inside, a, 0).sum(0)
        still = summed((c - p) ** 2)
        known = (size > 0) & (summed((c > 0) | (p > 0)) >= 0.02 * size) & (still >= size)
        out[part] = np.where(known, 1 - summed((c - s) ** 2) / np.where(known, still, 1), np.nan)
    return out


def translation_gain(prev: np.ndarray, cur: np.ndarray, v: np.ndarray, minutes: float, x: float, y: float, r: int) -> float | None:
    """The same of one point; None where it is not known."""
    found = translation_gains(prev, cur, np.asarray(v, float)[None], minutes, np.array([x], float), np.array([y], float), r)[0]
    return None if np.isnan(found) else float(found)


def halved(a: np.ndarray) -> np.ndarray:
    """Blurred by [1 2 1] / 4 both ways, every other pixel kept; nothing outside. Of every frame of a stack."""
    p = np.pad(a, [(0, 0)] * (a.ndim - 2) + [(1, 1)] * 2)
    rows = (p[..., :-2, :] + 2 * p[..., 1:-1, :] + p[..., 2:, :]) / 4
    both = (rows[..., :-2] + 2 * rows[..., 1:-1] + rows[..., 2:]) / 4
    return both[..., ::2, ::2]


def pyramid(a: np.ndarray, levels: int) -> list[np.ndarray]:
    """Finest first, until a level is 16 wide or less."""
    out = [a]
    while len(out) < levels and out[-1].shape[-1] > 16:
        out.append(halved(out[-1]))
    return out


def gradients(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Central differences of the two frames' mean, and their difference."""
    m = (a + b) / 2
    return (shifted(m, 1, 0) - shifted(m, -1, 0)) / 2, (shifted(m, 0, 1) - shifted(m, 0, -1)) / 2, b - a


def _finer(flow: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    y, x = (np.minimum(np.arange(n) // 2, m - 1) for n, m in zip(shape[-2:], flow.shape[-3:-1], strict=True))
    return 2 * flow[..., y[:, None], x, :]


def _warped(a: np.ndarray, flow: np.ndarray) -> np.ndarray:
    y, x = np.indices(a.shape[-2:])
    return sample(a, x + flow[..., 0], y + flow[..., 1], 0.0, np.arange(len(a))[:, None, None] if a.ndim > 2 else 0)


def horn_schunck(prev: np.ndarray, cur: np.ndarray, levels: int = 4, alpha: float = 10.0, most: int = 80, least: int = 10, warps: int = 2) -> np.ndarray:
    """Flow of every pixel under constant brightness and a smoothness penalty, coarse to fine; of one pair of frames or of a
    stack of pairs."""
    pairs = list(zip(pyramid(signal(prev), levels), pyramid(signal(cur), levels), strict=True))
    flow, steps = None, most
    for p, c in reversed(pairs):
        flow = np.zeros((*p.shape, 2)) if flow is None else _finer(flow, p.shape)
        h, w = p.shape[-2:]
        grown = np.empty((2, *p.shape[:-2], h + 2, w + 2))  # the flow, its edges repeated once around
        inner = grown[..., 1:-1, 1:-1]
        inner[:] = np.moveaxis(flow, -1, 0)
        mean, part = np.empty_like(inner), np.empty_like(inner)
        column, off = np.empty((2, *p.shape[:-1], w + 2)), np.empty(p.shape)
        for _ in range(warps):
            grad = np.empty_like(mean)
            grad[0], grad[1], it = gradients(p, _warped(c, np.moveaxis(inner, 0, -1)))
            scale = 1 / (alpha * alpha + grad[0] * grad[0] + grad[1] * grad[1])
            rest, scaled = (grad[0] * inner[0] + grad[1] * inner[1] - it) * scale, grad * scale
            for _ in range(steps):
                # Neighbours weigh a sixth, those across the corner a twelfth: [1/2 1 1/2] both ways less the middle, over three.
                grown[..., 0, :], grown[..., -1, :] = grown[..., 1, :], grown[..., -2, :]
                grown[..., 0], grown[..., -1] = grown[..., 1], grown[..., -2]
                np.add(grown[..., :-2, :], grown[..., 2:, :], out=column)
                column *= 0.5
                column += grown[..., 1:-1, :]
                np.add(column[..., :-2], column[..., 2:], out=mean)
                mean *= 0.5
                mean += column[..., 1:-1]
                mean -= inner
                mean /= 3
                np.multiply(scaled, mean, out=part)
                np.add(part[0], part[1], out=off)
                off -= rest
                np.multiply(grad, off, out=part)
                np.subtract(mean, part, out=inner)
        flow = np.moveaxis(inner, 0, -1)
        steps = max(least, steps // 2)
    return np.ascontiguousarray(flow)


@cache
def _window(n: int, r: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(n)
    return np.maximum(at - r, 0), np.minimum(at + r + 1, n)


def box_sum(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over the (2r + 1) squared window of each pixel, clipped at the edges; of every frame of a stack."""
    h, w = a.shape[-2:]
    s = np.zeros((*a.shape[:-2], h + 1, w + 1))
    np.cumsum(a.cumsum(-2), axis=-1, out=s[..., 1:, 1:])
    (y0, y1), (x0, x1) = _window(h, r), _window(w, r)
    low, high = s.take(y0, axis=-2), s.take(y1, axis=-2)
    return high.take(x1, axis=-1) - low.take(x1, axis=-1) - high.take(x0, axis=-1) + low.take(x0, axis=-1)


def lucas_kanade(prev: np.ndarray, cur: np.ndarray, levels: int = 4, r: int = 7, steps: int = 3, least_eigen: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(flow, whether it was solved) by least squares over the window of each pixel, coarse to fine, of one pair or a stack;
    windows without texture, or with a step longer than they are, stay as they were."""
    pairs = list(zip(pyramid(signal(prev), levels), pyramid(signal(cur), levels), strict=True))
    flow, ok = None, None
    for p, c in reversed(pairs):
        flow = np.zeros((*p.shape, 2)) if flow is None else _finer(flow, p.shape)
        for _ in range(steps):
            ix, iy, it = gradients(p, _warped(c, flow))
            xx, xy, yy, xt, yt = box_sum(np.stack([ix * ix, ix * iy, iy * iy, ix * it, iy * it]), r)
            small = (xx + yy) / 2 - np.sqrt((xx - yy) ** 2 / 4 + xy * xy)
            det = xx * yy - xy * xy
            with np.errstate(invalid="ignore", divide="ignore"):
                step = np.stack([(xy * yt - yy * xt) / det, (xy * xt - xx * yt) / det], -1)
            ok = (small >= least_eigen * (2 * r + 1) ** 2) & (np.abs(step) <= r).all(-1)
            flow = flow + np.where(ok[..., None], step, 0.0)
    return flow, ok


def flow_field(flow: np.ndarray, prev: np.ndarray, cur: np.ndarray, solved: np.ndarray | None, size: int, minutes: float) -> tuple[np.ndarray, np.ndarray]:
    """(field, measured) by blocks, over the pixels with echo in either frame whose flow was solved."""
    seen = (signal(prev) > 0) | (signal(cur) > 0)
    if solved is not None:
        seen &= solved
    n = blocks(seen.astype(float), size).sum(2)
    valid = n >= max(1, size * size // 20)
    sums = np.stack([blocks(np.where(seen, flow[..., i], 0.0), size).sum(2) for i in (0, 1)], -1)
    return np.where(valid[..., None], sums / np.maximum(n, 1)[..., None] / minutes, 0.0), valid


@cache
def spots(r: int) -> tuple[np.ndarray, np.ndarray]:
    """The offsets of a disc, columns to be laid over points."""
    j, i = (a.ravel() for a in np.mgrid[-r : r + 1, -r : r + 1])
    near = i * i + j * j <= r * r
    return i[near][:, None], j[near][:, None]


def reads(g: np.ndarray, x: np.ndarray, y: np.ndarray, r: int, of: np.ndarray | int = 0) -> np.ndarray:
    """(spots, points): the pixels of the disc around the pixel nearest to each point. of: the frame of a stack that each
    point is of."""
    near = lambda a: np.copysign(np.floor(np.abs(a) + 0.5), a).astype(int)
    (i, j), (h, w) = spots(r), g.shape[-2:]
    if g.size > len(i) * len(x):
        return _pixels(g, near(x) + i, near(y) + j, NO_ECHO, of)
    # With a margin around, a disc is one read a pixel; discs further out than the margin read nothing but it.
    m = 2 * r + 1
    wide = np.pad(g, [(0, 0)] * (g.ndim - 2) + [(m, m)] * 2, constant_values=NO_ECHO)
    at = (of * (h + 2 * m) + np.clip(near(y), -r - 1, h + r) + m) * (w + 2 * m) + np.clip(near(x), -r - 1, w + r) + m
    return wide.ravel().take(at + (j * (w + 2 * m) + i))


def point_echo(g: np.ndarray, x: np.ndarray, y: np.ndarray, r: int, strong: float, of: np.ndarray | int = 0) -> np.ndarray:
    """The bilinear echo where it is strong, else the upper median of the disc around."""
    here = sample(g, x, y, NO_ECHO, of)
    found = np.sort(reads(g, x, y, r, of), axis=0)
    return np.where((strong > 0) & (here >= strong), here, found[len(found) // 2])


def rain_share(g: np.ndarray, x: np.ndarray, y: np.ndarray, r: int, threshold: float, delta: np.ndarray, of: np.ndarray | int = 0) -> np.ndarray:
    """Share of a disc's pixels that rain once echoes have changed by delta."""
    found = reads(g, x, y, r, of)
    return (np.where(found >= 10, np.minimum(found + delta, CEILING), found) >= threshold).mean(0)


def carried(fields: list[np.ndarray], sizes: list[int], x: np.ndarray, y: np.ndarray, minutes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where the rain of each point was so many minutes before, by each field: two arrays (fields, points, minutes). One-minute
    steps back, whose velocity is that at their middle; all fields step at once, laid one behind the other. x, y: the same
    points for all fields, or (fields, points)."""
    col = lambda a: np.array(a)[:, None]
    h, w, size = col([v.shape[0] for v in fields]), col([v.shape[1] for v in fields]), col(sizes)
    base = np.cumsum(h * w, axis=0) - h * w
    dx, dy = np.concatenate([v.reshape(-1, 2) for v in fields]).T.copy()

    def at(px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fx, fy = (np.minimum(np.maximum(p / size - 0.5, 0), n - 1) for p, n in ((px, w), (py, h)))
        x0, y0 = fx.astype(int), fy.astype(int)
        tx, ty = fx - x0, fy - y0
        ux, uy = 1 - tx, 1 - ty
        a = base + y0 * w + x0
        b, down = a + (x0 < w - 1), (y0 < h - 1) * w
        c, d = a + down, b + down
        return tuple((v.take(a) * ux + v.take(b) * tx) * uy + (v.take(c) * ux + v.take(d) * tx) * ty for v in (dx, dy))

    shape = (len(fields), x.shape[-1])
    px, py = (np.broadcast_to(a.astype(float), shape) for a in (x, y))
    out, moving = [], bool(dx.any() or dy.any())
    for m in range(minutes[-1] + 1):
        if m in minutes:
            out.append((px, py))
        if moving and m < minutes[-1]:
            vx, vy = at(px, py)
            vx, vy = at(px - vx / 2, py - vy / 2)
            px, py = px - vx, py - vy
    return np.stack([p for p, _ in out], -1), np.stack([q for _, q in out], -1)


#: Points followed at once, which bounds the memory of wide discs.
FOLLOWED = 4096
#: What carries a forecast: field, pixels of its blocks, trend by blocks or None.
Carrier = tuple[np.ndarray, int, np.ndarray | None]


def followed(g: np.ndarray, carriers: list[Carrier], x: np.ndarray, y: np.ndarray, r: int, strong: float, threshold: float, tau: float, minutes: list[int], of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(dBZ, rain probability), both (carriers, points, minutes), of the echo upstream, with a trend that wears off after tau
    minutes. of: the frame of a stack g that each carrier is of, whose points then are rows of x and y."""
    n = max(1, FOLLOWED // len(carriers))
    if x.shape[-1] > n:
        parts = [followed(g, carriers, x[..., i : i + n], y[..., i : i + n], r, strong, threshold, tau, minutes, of) for i in range(0, x.shape[-1], n)]
        return tuple(np.concatenate(p, axis=1) for p in zip(*parts, strict=True))
    px, py = carried([c[0] for c in carriers], [c[1] for c in carriers], x, y, minutes)
    each = lambda k: 0 if of is None else np.repeat(of, k)
    echo = point_echo(g, px.ravel(), py.ravel(), r, strong, each(px[0].size)).reshape(px.shape)
    delta = np.zeros(px.shape)
    worn = np.array([tau * (1 - np.exp(-m / tau)) for m in minutes])
    for i, (_, size, rates) in enumerate(carriers):
        if rates is not None:
            delta[i] = np.where((echo[i] >= 10) & (worn > 0), field_at(rates, size, px[i], py[i]) * worn, 0.0)
            echo[i] = np.where((echo[i] >= 10) & (worn > 0), np.minimum(echo[i] + delta[i], CEILING), echo[i])
    share = [rain_share(g, px[..., i].ravel(), py[..., i].ravel(), 2 + 8 * m // 60, threshold, delta[..., i].ravel(), each(px.shape[1])).reshape(px.shape[:2]) for i, m in enumerate(minutes)]
    return echo, np.stack(share, -1)


def trajectories(g: np.ndarray, v: np.ndarray, size: int, x: np.ndarray, y: np.ndarray, horizon: int, rates: np.ndarray | None = None, r: int = 1, strong: float = 40.0, threshold: float = 20.0, tau: float = 20.0, minutes: tuple[int, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(dBZ, rain probability) of each point and minute (of those given, or all) along one field."""
    wanted = [m for m in range(horizon + 1) if minutes is None or m in minutes]
    dbz, share = followed(g, [(v, size, rates)], x, y, r, strong, threshold, tau, wanted)
    return dbz[0], share[0]


def assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row in the cheapest one-to-one assignment of a square matrix, by shortest
    augmenting paths with potentials; each path's step is taken over all columns at once."""
    n = len(cost)
    u, v, row_of = np.zeros(n), np.zeros(n), np.full(n, -1)
    for start in range(n):
        dist, via, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        row, base, last = start, 0.0, -1
        while True:
            reach = base + cost[row] - u[row] - v
            better = ~done & (reach < dist - 1e-12)
            dist[better], via[better] = reach[better], last
            last = int(np.where(done, np.inf, dist).argmin())
            base = dist[last]
            done[last] = True
            if row_of[last] < 0:
                break
            row = row_of[last]
        u[start] += base
        for c in np.flatnonzero(done):
            if c != last:
                u[row_of[c]] += base - dist[c]
            v[c] += dist[c] - base
        while last >= 0:
            back = via[last]
            row_of[last] = start if back < 0 else row_of[back]
            last = back
    out = np.empty(n, int)
    out[row_of] = np.arange(n)
    return out


def near_pairs(a: np.ndarray, b: np.ndarray, gate: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a and of b (x, y) whose squares, as wide as the gate, are the same or touch: all pairs within the gate are
    among them."""
    if not len(a) or not len(b):
        return np.empty(0, int), np.empty(0, int)
    square = lambda q: np.floor(q / gate).astype(int)
    sa, sb = square(a), square(b)
    low, width = np.minimum(sa.min(0), sb.min(0)) - 1, max(sa[:, 0].max(), sb[:, 0].max()) - min(sa[:, 0].min(), sb[:, 0].min()) + 3
    number = lambda q: (q[:, 1] - low[1]) * width + q[:, 0] - low[0]
    order = np.argsort(number(sb), kind="stable")
    have = number(sb)[order]
    out_i, out_j = [], []
    for dy in (-1, 0, 1):
        start, end = np.searchsorted(have, number(sa) + dy * width - 1, "left"), np.searchsorted(have, number(sa) + dy * width + 1, "right")
        n = end - start
        out_i.append(np.repeat(np.arange(len(a)), n))
        out_j.append(order[np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(start, n)])
    i, j = np.concatenate(out_i), np.concatenate(out_j)
    by = np.lexsort((j, i))
    return i[by], j[by]


def sparse_assignment(n: int, m: int, i: np.ndarray, j: np.ndarray, cost: np.ndarray, alone: float) -> np.ndarray:
    """The edge of each of n rows (-1: none) in the cheapest one-to-one choice of edges (i, j, cost) between n rows and m columns,
    where each row without an edge costs `alone`. Edges are sorted by row.

    Shortest augmenting paths with potentials over the edges there are: a path ends at a free column or where a row is
    cheaper left alone, so it stays among the cells nearby and the cost follows the edges, not rows x columns.
    """
    first = np.searchsorted(i, np.arange(n + 1)).tolist()
    to, price = j.tolist(), cost.tolist()
    u, v, edge, owner = [0.0] * n, [0.0] * m, [-1] * n, [-1] * m
    for start in range(n):
        dist: dict[int, float] = {}
        via: dict[int, tuple[int, int]] = {}
        done: list[int] = []
        heap: list[tuple[float, int]] = []
        row, base, best_alone, lone = start, 0.0, np.inf, -1
        end = -1
        while True:
            # A row's own place alone has potential 0 and is always free.
            if base + alone - u[row] < best_alone:
                best_alone, lone = base + alone - u[row], row
            for e in range(first[row], first[row + 1]):
                c = to[e]
                reach = base + price[e] - u[row] - v[c]
                if reach < dist.get(c, np.inf) - 1e-12:
                    dist[c], via[c] = reach, (row, e)
                    heapq.heappush(heap, (reach, c))
            while heap and heap[0][0] > dist[heap[0][1]]:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= best_alone:
                base = best_alone
                break
            base, c = heapq.heappop(heap)
            done.append(c)
            if owner[c] < 0:
                end = c
                break
            row = owner[c]
        u[start] += base
        for c in done:
            if c != end:
                u[owner[c]] += base - dist[c]
                v[c] += dist[c] - base
        if end < 0:
            row = lone
            c, edge[row] = (to[edge[row]] if row != start else -1), -1
        else:
            c = end
        # Along the path each row takes the column that led on from it.
        while c >= 0:
            row, e = via[c]
            before = to[edge[row]] if edge[row] >= 0 else -1
            edge[row], owner[c] = e, row
            c = before if row != start else -1
    return np.array(edge, int)


def labels(g: np.ndarray, threshold: float) -> np.ndarray:
    """The smallest pixel index of each 4-connected area at or above the threshold; -1 elsewhere."""
    on = g >= threshold
    h, w = g.shape
    big = h * w
    # One pixel more on each side, so neighbours are slices; the last place of flat is that of no label.
    flat = np.full(big + 1, big)
    grown = np.full((h + 2, w + 2), big)
    inner = grown[1:-1, 1:-1]
    np.copyto(inner, np.arange(big).reshape(h, w), where=on)
    sides = (grown[:-2, 1:-1], grown[2:, 1:-1], grown[1:-1, :-2], grown[1:-1, 2:])
    while True:
        low = np.minimum(inner, sides[0])
        for side in sides[1:]:
            np.minimum(low, side, out=low)
        flat[:-1] = np.where(on, low, big).ravel()
        low = flat.take(flat[:-1]).reshape(h, w)  # a label's own label is as good
        if (low == inner).all():
            return np.where(on, low, -1)
        inner[:] = low
