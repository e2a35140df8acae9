"""Histories of frames, region by region: a task reads the frames of a region in the order of their times and
holds only those that a forecast still needs.

A region's history is cut into spans of time, and a frame goes to every span that needs it as history
or as future; a region that holds a third of all frames is thus many bounded groups. Frames are keyed by
(region, t), and two frames are a pair only if no longer apart than the gap allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import islice, pairwise, takewhile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.operators import kernels

RADAR = "radar"
#: Seconds of a span, which is also a block of the bootstrap.
SPAN = 21_600
#: Pixels of the pairs whose flow is measured at once.
STACK = 1 << 14


@dataclass(frozen=True)
class Motion:
    """How motion is measured: pixels of a block and of the search for matching, of a block for flow; seconds between
    the frames of a pair at most; pairs of an average."""

    size: int = 32
    search: int = 16
    flow_size: int = 16
    gap: int = 600
    pairs: int = 4


def images(cells: DataFrame, width: int, height: int) -> DataFrame:
    """(region, t, w, h, at, dbz): the cells (region, t, x, y, dbz) of each frame as two arrays, positions row by
    row and values; absent cells have no echo, cells outside and of null value are left out."""
    inside = cells.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1) & F.col("dbz").isNotNull())
    cell = F.struct((F.col("y") * width + F.col("x")).cast("int").alias("at"), F.col("dbz").cast("float").alias("dbz"))
    packed = inside.groupBy("region", "t").agg(F.collect_list(cell).alias("c"))
    return packed.select("region", "t", F.lit(width).alias("w"), F.lit(height).alias("h"), F.col("c.at").alias("at"), F.col("c.dbz").alias("dbz"))


def grid(w: int, h: int, at: np.ndarray, dbz: np.ndarray) -> np.ndarray:
    g = np.full(w * h, kernels.NO_ECHO)
    g[at] = dbz
    return g.reshape(h, w)


def seen(row) -> np.ndarray | None:
    """The mask of the positions in a frame's cover; None without one."""
    if getattr(row, "cover", None) is None:
        return None
    mask = np.zeros(row.w * row.h, bool)
    mask[np.asarray(row.cover, int)] = True
    return mask.reshape(row.h, row.w)


class Frames:
    """The frames of one region that are still needed, and the motion measured between them, each pair once."""

    def __init__(self, motion: Motion):
        self.motion = motion
        self.grids: dict[int, np.ndarray] = {}
        self.covers: dict[int, np.ndarray] = {}
        #: Latitude and longitude of the region, by frame, where they are given.
        self.places: dict[int, tuple[float, float]] = {}
        #: What else is known of the region: kind -> time -> its row.
        self.side: dict[str, dict[int, object]] = {}
        #: What visitors keep of a frame: (kind, time, ...) -> value.
        self.kept: dict[tuple, object] = {}
        #: Frames that come next, in order of time, as far as they are known: asked for one after another.
        self.coming: Callable[[], Iterable[tuple[int, np.ndarray]]] = tuple
        self._pairs: dict[tuple[str, int], tuple[np.ndarray, np.ndarray] | None] = {}
        self._fields: dict[tuple[str, int, int], tuple[np.ndarray, np.ndarray] | None] = {}
        self._trends: dict[tuple[str, int, float, int | None], np.ndarray | None] = {}

    def put(self, t: int, g: np.ndarray, cover: np.ndarray | None = None) -> None:
        """cover: which pixels are seen; None: all."""
        self.grids[t] = g
        if cover is not None:
            self.covers[t] = cover

    def evict(self, before: int) -> None:
        for held in (self.grids, self.covers, self.places, self.kept, self._pairs, self._fields, self._trends, *self.side.values()):
            for key in [k for k in held if (k if isinstance(k, int) else k[1]) < before]:
                del held[key]

    def previous(self, t: int) -> int | None:
        """The frame that makes a pair with t; none across a gap."""
        p = max((u for u in self.grids if u < t), default=None)
        return p if p is not None and t - p <= self.motion.gap else None

    def chain(self, t: int, n: int) -> list[int]:
        """Up to n pairs back from t, newest first, to the first gap."""
        out = [t]
        while len(out) <= n and (p := self.previous(out[-1])) is not None:
            out.append(p)
        return out

    def size(self, method: str) -> int:
        return self.motion.size if method == "TREC" else self.motion.flow_size

    def pair(self, method: str, t: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(field in pixels a minute, measured blocks) of the pair that ends at t."""
        key = (method, t)
        if key not in self._pairs:
            p = self.previous(t)
            if p is None:
                self._pairs[key] = None
            else:
                self._measure(method, p, t)
        return self._pairs[key]

    def _measure(self, method: str, p: int, t: int) -> None:
        """Measure the pair (p, t), and with it those of the frames after t that are known: small frames cost little more
        as a stack. A frame that comes is a pair with the one before it, as it will be when it is visited."""
        m, frames = self.motion, [(p, self.grids[p]), (t, self.grids[t])]
        most = max(1, STACK // self.grids[t].size) if method in ("HS", "LK") else 1
        if most > 1:
            after = [(u, self.grids[u]) for u in sorted(self.grids) if u > t]
            for u, g in (*after, *islice(self.coming(), max(0, most - 1 - len(after)))):
                if len(frames) > most or u <= frames[-1][0] or g.shape != frames[0][1].shape:
                    break
                frames.append((u, g))
        pairs = [(a, b) for a, b in pairwise(frames) if b[0] == t or (b[0] - a[0] <= m.gap and (method, b[0]) not in self._pairs)]
        prev, cur = (np.stack([pair[i][1] for pair in pairs]) for i in (0, 1))
        if method == "HS":
            flows, solved = kernels.horn_schunck(prev, cur), [None] * len(pairs)
        elif method == "LK":
            flows, solved = kernels.lucas_kanade(prev, cur)
        for i, ((was, before), (now, after_)) in enumerate(pairs):
            minutes = (now - was) / 60
            if method == "TREC":
                v, valid = kernels.match_blocks(before, after_, m.size, m.search)
                v = v / minutes
            elif method in ("HS", "LK"):
                v, valid = kernels.flow_field(flows[i], before, after_, solved[i], m.flow_size, minutes)
            else:
                raise ValueError(f"no motion method {method}")
            self._pairs[method, now] = (kernels.finish(v, valid), valid)

    def field(self, method: str, t: int, pairs: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """The field that frame t is carried along: its pairs back to the first gap, newest heaviest, averaged over
        the blocks that each measured and finished; None without a pair."""
        n = self.motion.pairs if pairs is None else pairs
        key = (method, t, n)
        if key not in self._fields:
            times = self.chain(t, n)[:-1]
            found = [self.pair(method, u) for u in times]
            if len(found) > 1:
                v, valid = kernels.averaged([f[0] for f in found], [f[1] for f in found], [float(n - i) for i in range(len(found))])
                self._fields[key] = (kernels.finish(v, valid), valid)
            else:
                self._fields[key] = found[0] if found else None
        return self._fields[key]

    def trend(self, method: str, t: int, rain: float, pairs: int | None = None) -> np.ndarray | None:
        """dBZ a minute along the field of t, over two frames back or one."""
        key = (method, t, rain, pairs)
        if key not in self._trends:
            field, times = self.field(method, t, pairs), self.chain(t, 2)
            p = times[-1]
            known = field is not None and len(times) > 1
            self._trends[key] = kernels.trend(self.grids[p], self.grids[t], field[0], self.size(method), (t - p) / 60, rain) if known else None
        return self._trends[key]


#: A visitor of a time t of one region: the frames held, t, and whether the region's frame at t is there.
Visit = Callable[[Frames, object, int, int], Iterable[tuple]]


def spread(frames: DataFrame, back: int, ahead: int, span: int = SPAN) -> DataFrame:
    """frames with the spans that need them: those of the times from t - ahead to t + back."""
    spans = F.sequence(F.floor((F.col("t") - ahead) / span), F.floor((F.col("t") + back) / span))
    return frames.withColumn("span", F.explode(spans))


def walked(frames: DataFrame, motion: Motion, visit: Visit, schema: str, columns: list[str], back: int, ahead: int = 0, span: int = SPAN, close: Callable[[], Iterable[tuple]] | None = None) -> DataFrame:
    """The rows that visit(held, region, t, span) gives for every frame, visited in order of time when all frames up
    to t + ahead have come, with those from t - back on held. close() gives rows at the end of a span. Rows are
    tuples, or all of them tables.

    frames: region, t, w, h, at, dbz and maybe cover. Rows of another `kind` (a column that is optional) are not visited
    but held in `side` as long as frames are, so sources that differ meet in the same shuffle. One shuffle by region and span; of each, frames back + ahead around one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, waiting = None, Frames(motion), []
        rows: list[tuple] = []

        def visited(until: float) -> None:
            while waiting and waiting[0] + ahead <= until:
                t = waiting.pop(0)
                held.evict(t - back)
                rows.extend(visit(held, key[0], t, key[1]))

        def ended() -> None:
            visited(float("inf"))
            if close is not None and key is not None:
                rows.extend(close())

        def table() -> pd.DataFrame:
            return pd.concat(rows, ignore_index=True) if isinstance(rows[0], pd.DataFrame) else pd.DataFrame(rows, columns=columns)

        def image(r) -> np.ndarray:
            return grid(r.w, r.h, np.asarray(r.at, int), np.asarray(r.dbz, float))

        for f in batches:
            given = list(f.itertuples(index=False))
            for n, r in enumerate(given):
                if key != (r.region, r.span):
                    ended()
                    key, held, waiting = (r.region, r.span), Frames(motion), []
                visited(r.t - 1)
                if getattr(r, "kind", RADAR) != RADAR:
                    held.side.setdefault(r.kind, {})[r.t] = r
                    continue
                held.put(r.t, image(r), seen(r))
                if back >= motion.gap:
                    held.coming = lambda key=key, n=n, given=given: ((q.t, image(q)) for q in takewhile(lambda q: (q.region, q.span) == key, islice(given, n + 1, None)) if getattr(q, "kind", RADAR) == RADAR)
                if hasattr(r, "lat"):
                    held.places[r.t] = (r.lat, r.lon)
                if r.t // span == r.span:
                    waiting.append(r.t)
            if rows:
                yield table()
                rows.clear()
        ended()
        if rows:
            yield table()

    # A number of its own keeps the tasks apart: they are few bytes but much work, and would be joined by their bytes.
    tasks = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = spread(frames, back, ahead, span).repartition(tasks, "region", "span").sortWithinPartitions("region", "span", "t")
    return placed.mapInPandas(run, schema)


def fields(frames: DataFrame, method: str, motion: Motion = Motion(), averaged: bool = True) -> DataFrame:
    """(region, t, bx, by, dx, dy, valid): the field of every frame that has a pair; averaged over its pairs, or of its
    own pair alone."""

    def visit(held: Frames, region: object, t: int, span: int) -> Iterable[tuple]:
        found = held.field(method, t) if averaged else held.pair(method, t)
        if found is not None:
            v, valid = found
            for (by, bx), ok in np.ndenumerate(valid):
                yield region, t, bx, by, float(v[by, bx, 0]), float(v[by, bx, 1]), bool(ok)

    kind = frames.schema["region"].dataType.simpleString()
    columns = ["region", "t", "bx", "by", "dx", "dy", "valid"]
    return walked(frames, motion, visit, f"region {kind}, t long, bx int, by int, dx double, dy double, valid boolean", columns, back=(motion.pairs + 1) * motion.gap)


def around(frames: DataFrame, looks: dict[str, tuple[int, int]], leads: tuple[int, ...]) -> DataFrame:
    """(region, t, x, y, lead, a column for each look, obs) of every pixel with a value and every lead (minutes) whose frame is
    there: a look (dx, seconds) is the value dx pixels to the west and so long before, obs the value at the lead; NULL where
    there is none.

    A span's frames meet in one task as grids, so no pixel is joined: one shuffle of frames, whatever the number of looks.
    """
    back, ahead = max(dt for _, dt in looks.values()), max(leads) * 60

    def at(held: Frames, t: int, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        if t in held.grids:
            inside = (x >= 0) & (x < held.grids[t].shape[1])
            seen_ = np.flatnonzero(inside)[held.covers[t][y[inside], x[inside]]]
            out[seen_] = held.grids[t][y[seen_], x[seen_]]
        return out

    def visit(held: Frames, region: object, t: int, span: int) -> Iterable[tuple]:
        y, x = np.nonzero(held.covers[t])
        found = [at(held, t - dt, y, x - dx) for dx, dt in looks.values()]
        for lead in leads:
            if t + lead * 60 in held.grids:
                yield region, t, lead, x, y, *found, at(held, t + lead * 60, y, x)

    kind = frames.schema["region"].dataType.simpleString()
    names = ["x", "y", *looks, "obs"]
    schema = f"region {kind}, t long, lead int, x array<int>, y array<int>, {', '.join(f'{n} array<double>' for n in names[2:])}"
    known = frames.where("region IS NOT NULL AND t IS NOT NULL").withColumn("cover", F.col("at"))
    rows = walked(known, Motion(gap=max(back, 1)), visit, schema, ["region", "t", "lead", *names], back=back, ahead=ahead)
    flat = rows.select("region", "t", "lead", F.inline(F.arrays_zip(*names)))
    return flat.withColumns({n: F.nanvl(n, F.lit(None).cast("double")) for n in names[2:]})
