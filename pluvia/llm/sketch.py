"""Threshold-scaled document sketches.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its size
follows the document's, two sketches can be merged by union, and the share of one found
in another estimates containment however unequal the documents are. Shingles are runs
of WIDTH code points. A text may have no shingle under the threshold: its sketch is empty, and
its fingerprint then is its length and a hash of it, so that texts are told apart.

Defined results: null and empty texts have an empty sketch; a text shorter than WIDTH is
one shingle; two empty sketches are alike (1.0) if their texts are equal, else not (0.0); an
empty one and another are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import mix64, width as partitions

WIDTH = 12
FRACTION = 1 / 16
_MULTIPLIER = 0x9E3779B97F4A7C15
#: Code points hashed at once, which bounds memory for very long texts.
_STEP = 1 << 20


def shingle_hashes(text: str, shingle: int = WIDTH) -> Iterator[np.ndarray]:
    """64-bit hashes of all shingles, in parts."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = max(1, len(points) - shingle + 1)
    for at in range(0, n, _STEP):
        part = points[at : at + min(_STEP, n - at) + shingle - 1].astype(np.uint64)
        span = min(shingle, len(part))
        h = np.full(len(part) - span + 1, len(points) if len(points) < shingle else 0, np.uint64)
        for j in range(span):
            h = h * np.uint64(_MULTIPLIER) + part[j : len(part) - span + 1 + j] + np.uint64(1)
        yield mix64(h)


def sketch(text: str | None, shingle: int = WIDTH, fraction: float = FRACTION) -> np.ndarray:
    """Sorted distinct kept hashes; the low half of the bits is cut off, as the top ones decide."""
    if not text:
        return np.empty(0, np.uint64)
    limit = np.uint64(int(fraction * 2**64) - 1)
    return np.unique(np.concatenate([h[h <= limit] for h in shingle_hashes(text, shingle)]))


def merge(*sketches: np.ndarray) -> np.ndarray:
    """The sketch of all the documents together."""
    return np.unique(np.concatenate(sketches)) if sketches else np.empty(0, np.uint64)


def common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has."""
    return common(a, b) / len(a) if len(a) else float(not len(b))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity."""
    both = common(a, b)
    whole = len(a) + len(b) - both
    return both / whole if whole else 1.0


def fingerprint(s: np.ndarray, text: str | None) -> str:
    """The sketch as text, or what stands for an empty one."""
    if len(s) or not text:
        return s.astype(">u8").tobytes().hex()
    return f"~{len(text)}:{xxhash.xxh3_128_hexdigest(text.encode('utf-8', 'surrogatepass'))}"


def text_likeness(a: np.ndarray, b: np.ndarray, one: str, other: str) -> float:
    """likeness of two texts' sketches, by the texts themselves where both are empty."""
    return likeness(a, b) if len(a) or len(b) else float(one == other)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDTH, fraction: float = FRACTION) -> DataFrame:
    """(id, sketch array<long>) of every row; no shuffle. The longs hold the unsigned bits."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "sketch": [sketch(t, shingle, fraction).view(np.int64) for t in f["text"]]})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, sketch array<long>").withColumnRenamed("id", id_col)


def merged(sketched: DataFrame, by: str, sketch_col: str = "sketch") -> DataFrame:
    """One sketch for each value of by, as a set union of rows pre-aggregated before the shuffle."""
    one = sketched.select(by, F.explode_outer(sketch_col).alias("h")).distinct()
    return one.groupBy(by).agg(F.sort_array(F.collect_list("h")).alias("sketch"))


def containment_of(a: Column, b: Column) -> Column:
    """containment for two sketch columns."""
    return F.when(F.size(a) == 0, (F.size(b) == 0).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def with_successors(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows in range partitions by doc_id, each with a tail row that repeats the first row of
    the partition after it (of the last: the very first), and the number of partitions.

    Only ids are looked at to place the bounds; the driver gets one id for each partition.
    """
    least = -(1 << 63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(docs.sparkSession)
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)] if n > 1 else [0.5], 10_000).alias("q")).first()["q"] or []
    bounds = np.unique(np.asarray(cuts, np.int64))

    @F.pandas_udf("int")
    def part(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="right").astype(np.int32))

    firsts = sorted((r["p"], r["k"]) for r in rows.groupBy(part("key").alias("p")).agg(F.min("key").alias("k")).collect())
    before = {k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def homes(key: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, key.to_numpy(), side="right")
        return pd.Series([[int(p), before[k]] if k in before else [int(p)] for p, k in zip(own, key, strict=True)])

    placed = rows.select("key", "text", F.posexplode(homes("key")).alias("tail", "part"))
    return placed.repartitionByRange(n, "part").sortWithinPartitions("part", "tail", "key", "text"), n


def neighbour_sketches(docs: DataFrame, shingle: int = WIDTH, fraction: float = FRACTION) -> DataFrame:
    """doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next.

    edited: the last floor(n/2) code points give way to the first as many of the next document
    in ascending doc_id (null ids first, equal ids by text; after the last comes the first).
    One range shuffle of the texts; a task holds two documents at a time.
    """
    least = -(1 << 63)
    rows, _ = with_successors(docs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None  # part, key, text, sketch of the row that waits for its successor
        done: int | None = None  # the partition whose tail has come
        for f in frames:
            out = []
            for part, tail, key, text in zip(f["part"], f["tail"], f["key"], f["text"], strict=True):
                if tail and part == done:
                    continue  # rows with the same first id
                mine = sketch(text, shingle, fraction)
                if held is not None and held[0] == part:
                    _, k, own, s = held
                    half = len(own) // 2
                    edited = own[: len(own) - half] + text[:half]
                    e = sketch(edited, shingle, fraction)
                    out.append((None if k == least else k, len(own), edited, fingerprint(s, own), fingerprint(e, edited), text_likeness(s, e, own, edited), text_likeness(s, mine, own, text)))
                held, done = (None, part) if tail else ((part, key, text, mine), done)
            if out:
                frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
                yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    return rows.mapInPandas(run, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
