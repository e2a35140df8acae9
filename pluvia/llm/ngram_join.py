"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection.

A document is the set of its word shingles, as sorted 64-bit hashes. Equal sets are one
class. Classes are laid out in bands of set size: a class stands in its own band and, if it can
have larger partners there, in the next. Two sets in a band that are similar enough differ in at
most d members, d following from the largest size of the band. The hash space is cut into more
than d parts, so at least one part holds the same members of both: (band, part, its members) names
a tile, and every linked pair meets in one. Texts that merely share some phrases meet in none, as
a part has several members (at 90 %, eight or so). Parts that are empty in both say nothing: there
are as many more parts as a set may have empty ones, and a set with still more stands in the tiles
of its empty parts too, so nothing is lost.

Inside the tiles no set of all pairs is made at first: each class's candidates are the tile's
smallest class and its hub, the class of whose own tiles the largest share is held by others
too (an original among its edited copies), of which the nearest by the bitmaps is tried. Components of the
links found tell which tiles still hold several components, and only pairs across components
are tried there. Bit counts of the difference of two parity bitmaps bound the overlap from
above: one of about half as many places as the set has members, MIDDLE parts at most, inside
the tile join, and one of four places a member once a pair is made. What passes has its sorted
arrays intersected.

Defined results: words are cut at ASCII white space and A-Z lowered; a text of fewer words
than a shingle is one shingle; null or blank texts have an empty set and link with nothing;
rows of one doc_id are one document with several texts; null ids come out as null.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvia.llm.common import materialise, mix64, release, small, word_hashes
from pluvia.llm.components import components

#: Most 64-bit parts of the bitmap that goes to the tiles.
MIDDLE = 16
NO_ID = -(1 << 63)
#: Numbers of rows (8 bytes each) that are sent to every task at most; more are met in a shuffle.
MOST_SENT = 500_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _rolled(h: np.ndarray, span: int) -> np.ndarray:
    got = np.full(len(h) - span + 1, span, np.uint64)
    for j in range(span):
        got *= _MULTIPLIER
        got += h[j : len(h) - span + 1 + j]
    return mix64(got)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its n-word shingles."""
    h, bounds = word_hashes(texts)
    rolled = _rolled(h, n) if len(h) >= n else None
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(rolled[a : b - n + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        else:
            s = _rolled(h[a:b], b - a) if b > a else np.empty(0, np.uint64)
        out.append(s)
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(s.tobytes()))


def bitmap(s: np.ndarray, parts: int) -> np.ndarray:
    """Parity of the shingles at each of parts * 64 places: two bitmaps differ in no more
    places than the sets do in members. The halves of one, XORed, are that of half the parts."""
    odd = (np.bincount((s % np.uint64(parts * 64)).astype(np.int64), minlength=parts * 64) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def folded_to(bits: np.ndarray, parts: int) -> np.ndarray:
    """A bitmap in so many parts, which divide its own."""
    return np.bitwise_xor.reduce(bits.reshape(-1, parts), axis=0)


def wide_parts(n: int) -> int:
    """Parts of the wide bitmap of a set of n: a power of two that gives each member four places."""
    return 1 << (max(1, -(-n // 16)) - 1).bit_length()


def narrow_parts(n: int) -> int:
    """Parts of the narrow one: half a place a member, MIDDLE at most."""
    return min(MIDDLE, 1 << (max(1, -(-n // 128)) - 1).bit_length())


class Bands:
    """Bands of set size; band b holds the sizes from edge[b] to edge[b + 1] - 1."""

    def __init__(self, j: float):
        self.j = j
        self.ratio = 1 / j**2
        self.edge = [1]

    def of(self, n: int) -> int:
        while self.edge[-1] <= n:
            self.edge.append(max(self.edge[-1] + 1, math.ceil(self.edge[-1] * self.ratio)))
        return next(b for b in range(len(self.edge) - 1, -1, -1) if self.edge[b] <= n)

    def span(self, b: int) -> tuple[int, int]:
        """Least and greatest size of a band."""
        while len(self.edge) < b + 2:
            self.of(self.edge[-1])
        return self.edge[b], self.edge[b + 1] - 1

    def homes(self, n: int) -> list[int]:
        """The band of n, and those above in which a set of n can have partners."""
        b = own = self.of(n)
        largest = math.floor(n / self.j + 1e-9)
        self.of(largest)
        while b + 1 < len(self.edge) and self.edge[b + 1] <= largest:
            b += 1
        return list(range(own, b + 1))


def parts_of(low: int, high: int, percent: int) -> tuple[int, int]:
    """(parts, empty ones allowed) for sets of low to high members: linked ones differ in fewer parts
    than are left when those are taken off."""
    differ = 2 * high * (100 - percent) // (100 + percent)
    spare = 1
    for _ in range(3):
        parts = differ + 1 + spare
        empty = parts * math.exp(-low / parts)
        spare = 1 + math.ceil(empty + 3 * math.sqrt(empty))
    return differ + 1 + spare, spare


def tiles(s: np.ndarray, bands: Bands, percent: int) -> np.ndarray:
    """The hashed names of the tiles of a set."""
    mixed, out = mix64(s), []
    for b in bands.homes(len(s)):
        low, high = bands.span(b)
        parts, spare = parts_of(max(1, math.ceil(low * percent / 100)), high, percent)
        of = ((s >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        inside = np.zeros(parts, np.uint64)
        np.add.at(inside, of, mixed)
        full = np.bincount(of, minlength=parts) > 0
        named = np.arange(parts, dtype=np.uint64) if parts - np.count_nonzero(full) > spare else np.flatnonzero(full).astype(np.uint64)
        out.append(mix64(inside[named.astype(np.int64)] + mix64(named * np.uint64(1 << 20) + np.uint64(b + 1))))
    return np.concatenate(out).view(np.int64)


_SIGNATURE = "struct<n:long,hi:long,lo:long,bits:array<long>,whole:array<long>,tiles:array<long>>"


def described(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """docs with a column _set: n (set size), hi, lo (the set's key), bits and whole (a
    narrow and a wide bitmap), tiles; one pass, no shuffle. Written once, with a column _row that
    numbers the rows."""

    def signed(texts: pa.Array) -> pa.Array:
        bands, columns = Bands(percent / 100), [[] for _ in range(6)]
        for at in range(0, len(texts), 2048):
            for s in shingle_sets(texts[at : at + 2048], n):
                whole = bitmap(s, wide_parts(len(s))) if len(s) else None
                row = (len(s), *set_key(s), folded_to(whole, narrow_parts(len(s))) if len(s) else None, whole, tiles(s, bands, percent) if len(s) else None)
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 3
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["n", "hi", "lo", "bits", "whole", "tiles"])

    signature = F.arrow_udf(signed, _SIGNATURE)
    return materialise(docs.withColumns({"_set": signature("text"), "_row": F.monotonically_increasing_id()}), "shingles")


def _differ(name: str) -> Column:
    """Places in which two bitmaps differ: the sets differ in as many members at least. Linked sets'
    differ in width by one halving at most; others' are not compared."""
    a, b = F.col(f"a_{name}"), F.col(f"b_{name}")
    middle = lambda x: F.floor(F.size(x) / 2).cast("int")
    half = lambda x: F.zip_with(F.slice(x, 1, middle(x)), F.slice(x, middle(x) + 1, F.size(x)), lambda p, q: p.bitwiseXOR(q))
    differing = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), differing(a, b)).when(F.size(a) == 2 * F.size(b), differing(half(a), b)).when(F.size(b) == 2 * F.size(a), differing(a, half(b))).otherwise(F.lit(0))


def _allows(differ: Column, j: float) -> Column:
    """Whether so many differing places still allow similarity j."""
    both = (F.col("a_n") + F.col("b_n") - differ) / 2
    return both * (1 + j) >= j * (F.col("a_n") + F.col("b_n")) - F.lit(1e-6)


def _side(classes: DataFrame, s: str, *more: str) -> DataFrame:
    return classes.select(F.col("uid").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("n", *more)])


def possible(pairs: DataFrame, classes: DataFrame, j: float) -> DataFrame:
    """The pairs (a, b) that the wide bitmaps leave, and gap, the differing places for each member."""
    differ = _differ("whole")
    met = pairs.join(_side(classes, "a", "whole"), "a").join(_side(classes, "b", "whole"), "b")
    return materialise(met.where(_allows(differ, j)).select("a", "b", (differ / (F.col("a_n") + F.col("b_n"))).alias("gap")), "maybe")


def linked(maybe: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of class ids whose similarity is at least percent / 100, exactly.

    The sets are made again from the texts, and only for the classes that stand in a pair (a
    class is named by one of its rows).
    """
    named = materialise(maybe.select(F.explode(F.array("a", "b")).alias("_row")).distinct(), "wanted")
    texts = rows.select("_row", "text").join(F.broadcast(named) if named.count() <= MOST_SENT else named, "_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small(whole):
                sets = shingle_sets(batch.column(1), n)
                members = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), members], names=["uid", "members"])

    sets = materialise(texts.mapInArrow(run, "uid long, members array<long>"), "sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small(whole, 256):
                left, right = batch.column(2), batch.column(3)
                keep = []
                for i in range(batch.num_rows):
                    x, y = (c[i].values.to_numpy().view(np.uint64) for c in (left, right))
                    short, long_ = (x, y) if len(x) <= len(y) else (y, x)
                    at = np.searchsorted(long_, short)
                    both = int((long_[np.minimum(at, len(long_) - 1)] == short).sum())
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda u, m: sets.select(F.col("uid").alias(u), F.col("members").alias(m))
    paired = maybe.select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
    out = materialise(paired.mapInArrow(check, "a long, b long"), "links")
    release(named, sets)
    return out


def classes_of(rows: DataFrame) -> DataFrame:
    """uid (the row that stands for it), rep (its smallest doc, NO_ID for null), n, hi, lo, bits,
    whole of every distinct set that is not empty: exact copies end here."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    full = rows.where("_set.n > 0")
    one = full.select("_set.hi", "_set.lo", doc.alias("doc"), F.col("_row").alias("uid")).groupBy("hi", "lo").agg(F.min(F.struct("doc", "uid")).alias("at"))
    chosen = one.select("at.uid", F.col("at.doc").alias("rep"), "hi", "lo")
    return materialise(chosen.join(full.select(F.col("_row").alias("uid"), "_set.n", "_set.bits", "_set.whole"), "uid"), "classes")


def class_components(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """hi, lo, rep, c (the component's name) of every class; rows: what described gave."""
    j = percent / 100
    classes = classes_of(rows)
    # Tiles are many and most hold one class: they are counted without their rows first, and
    # copies, which have the same hi, do not make a tile shared.
    placed = rows.where("_set.n > 0").select(F.col("_row").alias("uid"), "_set.hi", F.size("_set.tiles").alias("in_all"), F.explode("_set.tiles").alias("tile"))
    shared = materialise(placed.groupBy("tile").agg(F.min("hi").alias("x"), F.max("hi").alias("y")).where("x < y").select("tile"), "shared-tiles")
    # Written before copies are left out: else Spark would do that first, and shuffle all tiles.
    met = materialise(placed.select("uid", "tile", "in_all").join(shared.hint("merge"), "tile"), "tiles-met")
    found = met.join(classes.select("uid"), "uid", "left_semi")
    # A window holds the tiles of one class.
    found = materialise(found.withColumn("share", F.count("*").over(W.partitionBy("uid")) / F.col("in_all")).drop("in_all"), "tile-rows")
    release(shared, met)
    ends = found.groupBy("tile").agg(F.min("uid").alias("first"), F.max("uid").alias("last"), F.max(F.struct("share", "uid"))["uid"].alias("hub")).where("first < last")
    members = materialise(found.drop("share").join(ends.drop("last"), "tile"), "tiles")
    release(found)
    star = members.where("first <> uid").select(F.col("first").alias("a"), F.col("uid").alias("b"))
    star = star.unionByName(members.where("uid <> hub").select(F.col("hub").alias("a"), F.col("uid").alias("b"))).distinct()
    # First each class with the nearest of its candidates by the bitmaps.
    maybe = possible(star, classes, j)
    nearest = materialise(maybe.groupBy("b").agg(F.min(F.struct("gap", "a")).alias("at")).select("at.a", "b"), "nearest")
    release(maybe)
    edges = linked(nearest, rows, n, percent)
    labels = components(edges)
    # Then the tiles in which several components remain: pairs across them.
    label = members.select("tile", "uid").join(labels, F.col("uid") == F.col("node"), "left").select("tile", "uid", F.coalesce("component", "uid").alias("c"))
    label = materialise(label, "labelled")
    mixed = label.groupBy("tile").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("tile")
    # The bitmaps' bound is part of the join, so pairs that it rules out are never rows.
    open_ = label.join(mixed, "tile").join(classes.select("uid", "n", "bits"), "uid")
    left, right = _side(open_, "a", "bits", "tile", "c"), _side(open_, "b", "bits", "tile", "c")
    near = (left["a_tile"] == right["b_tile"]) & (left["a_c"] < right["b_c"]) & _allows(_differ("bits"), j)
    across = left.join(right, near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    untried = possible(across.join(tried, ["a", "b"], "left_anti"), classes, j)
    release(members, label, nearest)
    if not untried.isEmpty():
        more = linked(untried, rows, n, percent)
        release(labels.scratch)
        labels = components(edges.unionByName(more))
        release(more)
    out = materialise(classes.select("uid", "rep", "hi", "lo").join(labels, F.col("uid") == F.col("node"), "left").select("hi", "lo", "rep", F.coalesce("component", "uid").alias("c")), "class-components")
    release(classes, untried, edges, labels.scratch)
    return out


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) of every row."""
    rows = described(docs.select("doc_id", "text"), n, percent)
    of = class_components(rows, n, percent)
    least = of.groupBy("c").agg(F.min("rep").alias("component"))
    named = materialise(of.join(least, "c").select("hi", "lo", "component"), "named")
    release(of)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    out = rows.select(doc.alias("doc"), "_set.n", "_set.hi", "_set.lo").join(named, ["hi", "lo"], "left")
    back = lambda c: F.when(c != NO_ID, c)
    return out.select(back(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.coalesce("component", "doc")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component, of its smallest doc_id (null ids last); every row
    without words stays, as it is near nothing."""
    # The other columns travel in one, so no name of theirs clashes.
    others = F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    others = others.dropFields(*[f"c{docs.columns.index(c)}" for c in ("doc_id", "text")])
    rows = described(docs.select("doc_id", "text", others.alias("_others")), n, percent)
    of = class_components(rows, n, percent)
    # Of a component that class whose smallest document is the smallest, and of its rows the first.
    last = F.when(F.col("rep") == NO_ID, 1).otherwise(0)
    best = of.groupBy("c").agg(F.min(F.struct(last.alias("none"), "rep", "hi", "lo")).alias("at")).select("at.rep", "at.hi", "at.lo")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    keys = rows.where("_set.n > 0").select(doc.alias("rep"), "_set.hi", "_set.lo", "_row")
    first = keys.join(best, ["rep", "hi", "lo"]).groupBy("rep", "hi", "lo").agg(F.min("_row").alias("_row"))
    keep = materialise(first.select("_row").unionByName(rows.where("_set.n = 0").select("_row")), "kept-rows")
    release(of)
    kept = rows.join(F.broadcast(keep) if keep.count() <= MOST_SENT else keep, "_row", "left_semi")
    return kept.select(*[F.col(c if c in ("doc_id", "text") else f"_others.c{i}").alias(c) for i, c in enumerate(docs.columns)])
