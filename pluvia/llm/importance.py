"""Importance resampling of documents towards a target text collection.

Features are runs of one and two words, hashed into buckets. Two passes over the texts: the
first counts buckets, one vector a partition, merged by a tree of reductions, so neither a task
nor the driver ever holds more than a few such vectors; from the vectors of corpus and target comes
each bucket's gain, of a fixed size, which is broadcast. The second pass gathers gains and sums them by
document. Documents are then drawn without replacement by Gumbel-perturbed weights: the highest
scores, ranked by a distributed sort (ranges, then the number of rows in the ranges before).

Defined results: null and empty texts have no words, weight 0 and no rank; ties in score go to
the smaller doc_id, null ids first; repeated rows are rows of their own (their ranks follow one another); an
empty corpus gives no rows; with an empty target all gains are those of counts of zero; other
columns are not read. A null doc_id is hashed as the empty string.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import materialise, small

BUCKETS = 10_000
#: Words a document needs to be drawn; per cent of those that are drawn; what doc_ids are hashed with.
MIN_WORDS, PERCENT, SEED = 20, 25, 7
#: Bytes of a text that are cut into words at a time.
PART = 1 << 20
#: A-Z lowered, all other ASCII but digits and a-z blank, so that bytes.split cuts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _parts(raw: bytes) -> Iterator[bytes]:
    """The folded text in parts that end between words."""
    folded, at = raw.translate(_FOLD), 0
    while at < len(folded):
        end = len(folded) if len(folded) - at <= PART else folded.find(b" ", at + PART)
        end = len(folded) if end < 0 else end
        yield folded[at:end]
        at = end


def buckets(text: str | None) -> tuple[np.ndarray, int]:
    """The bucket of every feature of a text (order does not matter), and its number of words."""
    found, n_words, last = [np.empty(0, np.uint32)], 0, b""
    for part in _parts((text or "").encode()):
        words = part.split()
        if not words:
            continue
        single = list(map(crc32, words))
        pairs = map(crc32, words[1:], map(crc32, repeat(b" "), single))
        bridge = [crc32(words[0], crc32(b" ", crc32(last)))] if n_words else []
        n_words += len(words)
        last = words[-1]
        found.append(np.fromiter((*single, *pairs, *bridge), np.uint32))
    return np.concatenate(found) % np.uint32(BUCKETS), n_words


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Counts of the buckets over all texts: a bincount vector a partition, merged in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in small(batch):
                for text in part.column(0):
                    total += np.bincount(buckets(text.as_py())[0], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = docs.select("text").mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(BUCKETS, np.int64)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of how much likelier a bucket is in the target), counts smoothed by one."""
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean gain of each document's features."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value.astype(float)
        for batch in batches:
            for part in small(batch):
                features, sums, n_words = [], [], []
                for text in part.column(1):
                    found, n = buckets(text.as_py())
                    features.append(len(found))
                    n_words.append(n)
                    # Sums of integers far below 2^53 are exact.
                    sums.append(np.bincount(np.zeros(len(found), np.int64), weights=value[found], minlength=1)[0])
                n = np.array(features, np.int64)
                weight = np.array(sums, float).astype(np.int64) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def perturbation(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 * a standard Gumbel variate) that follows from the doc_id alone."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(name, "UTF-8"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn), n_words of every document."""
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weighted(docs, gain).withColumn("score", (F.col("weight") + perturbation(F.col("doc_id"), seed)).cast("long"))
    scored = materialise(scored, "importance")
    order = (F.desc("score"), F.asc_nulls_first("doc_id"))
    # Rows that tie in both may still be dealt to several ranges; which of them comes first is open.
    spread = F.xxhash64("n_features", F.monotonically_increasing_id())
    eligible = scored.where(F.col("n_words") >= min_words).withColumn("spread", spread)
    placed = eligible.repartitionByRange(*order, "spread").sortWithinPartitions(*order, "spread")
    ranked = materialise(placed.drop("spread").withColumn("at", F.monotonically_increasing_id()), "importance-order")
    # One row a partition.
    sizes = sorted((r["p"], r["n"]) for r in ranked.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n")).collect())
    ends = np.cumsum([n for _, n in sizes])
    taken = int(ends[-1]) * percent // 100 if sizes else 0
    before = spark.createDataFrame([(p, int(e - n)) for (p, n), e in zip(sizes, ends, strict=True)], "p long, before long")
    position = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    drawn = ranked.join(F.broadcast(before), F.shiftright("at", 33) == F.col("p")).withColumn("rank", F.when(position <= taken, position))
    others = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(columns).union(others.select(columns))
