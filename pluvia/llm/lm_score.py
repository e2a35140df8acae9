"""Language-model scores of whole documents: a smoothed unigram base and a recurrent model.

Counts cover every training document. The recurrent model (gru.py) is trained on every window
of every training document: documents are dealt over shards by id and text, about SHARD_TOKENS
tokens each, so more text means more shards and not larger ones; each shard trains a copy from
the same start, in the order of the ids, and the copies are averaged by tokens in a tree. So the
score depends on the documents, not on how many tasks read them.

The vocabulary holds the words of MIN_COUNT or more, most frequent first, up to gru.SIDE squared.
All other words fall into gru.REST classes by their ending: such a word gets the model's
probability of its class times its share, by smoothed count, of the class's words. Words never
seen in training are one word of their class, which has as much weight as the class's words seen
once.

A bounded table of the most frequent words goes to every task; the other words of a document
meet their counts in a join, pre-aggregated by document and word.

Defined results: null texts count as empty; every document ends with one end token, so an
empty one has one; null ids are in no way special (their fold is that of ''); repeated rows
are counted and scored one by one; without training documents every word counts as unseen.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.llm import gru
from pluvia.llm.common import materialise, release, small, split_words

#: Words whose counts every task holds, at most.
HOT = 150_000
SMOOTH = 0.1
#: Least count of a word of the model's vocabulary.
MIN_COUNT = 8
#: Training tokens of a shard; tokens trained on together; words a task counts before it emits.
SHARD_TOKENS = 4_000_000
BATCH_TOKENS = 500_000
FLUSH_WORDS = 1_000_000
#: Rows that are cut into words together.
TOGETHER = 2048
#: Copies of the model that one task averages.
FAN_IN = 16


def held_out(doc_id: Column, folds: int = 10) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows, without the end token; counted in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit() -> pa.RecordBatch:
            words = pa.concat_arrays([w for w, _ in held]).dictionary_encode()
            c = np.bincount(words.indices.to_numpy(), np.concatenate([c for _, c in held]), len(words.dictionary)).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([words.dictionary.cast(pa.string()), pa.array(c)], names=["word", "c"])

        for whole in batches:
            for batch in small(whole, TOGETHER):
                coded = split_words(batch.column(0))[0].dictionary_encode()
                held.append((coded.dictionary, np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))))
                size += len(coded.dictionary)
                if size >= FLUSH_WORDS:
                    yield emit()
                    size = 0
        if held:
            yield emit()

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def hot_words(counts: DataFrame, most: int = HOT) -> list[tuple[str, int]]:
    """The words of count c or more, for the least c that at most `most` words reach; by falling
    count. The cut is found on a histogram of counts, so the driver gets no more than that."""
    bucket = F.floor(F.log2(F.col("c").cast("double")) * 16)
    histogram = sorted(((r["b"], r["n"]) for r in counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, None
    for b, n in histogram:
        if total + n > most:
            break
        total, least = total + n, b
    if least is None:
        return []
    return sorted(((r["word"], r["c"]) for r in counts.where(bucket >= least).collect()), key=lambda x: (-x[1], x[0]))


def rest_class(word: bytes) -> int:
    """The class of a word outside the vocabulary, by its last two bytes."""
    return zlib.crc32(word[-2:]) % gru.REST


class Codes:
    """Ids of words: hot (place in the table of counts, or -1) and model (id in the vocabulary)."""

    def __init__(self, hot: dict[bytes, int], vocabulary: int, side: int):
        self.hot, self.vocabulary, self.end, self.rest = hot, vocabulary, vocabulary, side * side

    def of(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct words, of every word of all texts: which of these, hot id, model id; bounds)."""
        words, bounds = split_words(texts)
        coded = words.dictionary_encode()
        known = coded.dictionary.to_pylist()
        at = np.fromiter((self.hot.get(w, -1) for w in known), np.int32, len(known))
        model = np.where((at >= 0) & (at < self.vocabulary), at, 0)
        outside = np.flatnonzero((at < 0) | (at >= self.vocabulary))
        model[outside] = self.rest + np.fromiter((rest_class(known[i]) for i in outside.tolist()), np.int32, len(outside))
        each = coded.indices.to_numpy()
        return coded.dictionary, each, at[each] if len(known) else at, model[each] if len(known) else model, bounds

    def documents(self, model: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """The model ids of each text, with its end."""
        end = np.array([self.end], model.dtype)
        return [np.concatenate([model[a:b], end]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def train(docs: DataFrame, codes: Codes, start: np.ndarray, tokens: int) -> np.ndarray:
    """The average, by tokens, of copies trained on the shards; flat parameters."""
    spark = docs.sparkSession
    shards = max(1, -(-tokens // SHARD_TOKENS))
    sent = spark.sparkContext.broadcast((codes, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first = sent.value
        trainer, group, size, shard = None, [], 0, None

        def close() -> pa.RecordBatch:
            nonlocal size
            if group:
                trainer.run(group, own.end)
            group.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array([trainer.seen]), pa.array([gru.flatten(trainer.p).tobytes()], pa.binary())], names=["n", "p"])

        for whole in batches:
            for batch in small(whole, TOGETHER):
                _, _, _, model, bounds = own.of(batch.column(1))
                for k, ids in zip(batch.column(0).to_pylist(), own.documents(model, bounds), strict=True):
                    if k != shard:
                        if trainer is not None:
                            yield close()
                        trainer, shard = gru.Trainer(gru.unflatten(first), expected=tokens / shards), k
                    for at in range(0, len(ids), BATCH_TOKENS):  # a very long text is trained on in parts
                        group.append(ids[at : at + BATCH_TOKENS])
                        size += len(group[-1])
                        if size >= BATCH_TOKENS:
                            trainer.run(group, own.end)
                            group.clear()
                            size = 0
        if trainer is not None:
            yield close()

    def average(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for f in frames:
            for k, p in zip(f["n"], f["p"], strict=True):
                one = np.frombuffer(p, np.float32).astype(np.float64) * k
                total, n = (one if total is None else total + one), n + k
        if n:
            yield pd.DataFrame({"n": [n], "p": [(total / n).astype(np.float32).tobytes()]})

    schema = "n long, p binary"
    # By id and text, so that rows without an id, or of one id, are not one shard.
    key, th = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text")
    rows = docs.select(F.pmod(F.xxhash64(key, th), F.lit(shards)).cast("int").alias("shard"), "text", "doc_id", th.alias("th"))
    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "th").select("shard", "text")
    copies = materialise(dealt.mapInArrow(run, schema), "lm-copies")
    while (many := copies.count()) > FAN_IN:
        # By value, so the same copies meet whatever tasks wrote them.
        groups = math.ceil(many / FAN_IN)
        more = materialise(copies.repartition(groups, F.xxhash64("p")).sortWithinPartitions("p").mapInPandas(average, schema), "lm-copies")
        release(copies)
        copies = more
    got = sorted((r["p"], r["n"]) for r in copies.collect())
    release(copies)
    total = sum(n for _, n in got)
    return sum((np.frombuffer(p, np.float32).astype(np.float64) * (n / total) for p, n in got), np.zeros(len(start))).astype(np.float32) if total else start


def class_masses(counts: DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each rest class: tokens, smoothed mass of its words, words seen once. vocabulary: the
    words that are in none, a bounded list."""
    sent = counts.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, gru.REST))
        for batch in batches:
            words, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            out = np.fromiter((w not in sent.value for w in words), bool, len(words))
            of = np.fromiter((rest_class(w.encode()) for w in words), np.int64, len(words))[out]
            c = c[out]
            for i, w in enumerate((c, c + SMOOTH, c == 1)):
                sums[i] += np.bincount(of, w, gru.REST)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(gru.REST), pa.int32()), *map(pa.array, sums)], names=["k", "tokens", "mass", "once"])

    schema = "k int, tokens double, mass double, once double"
    got = counts.select("word", "c").mapInArrow(run, schema).groupBy("k").agg(*[F.sum(c).alias(c) for c in ("tokens", "mass", "once")]).toPandas().sort_values("k")
    out = np.zeros((3, gru.REST))
    out[:, got["k"].to_numpy(int)] = got[["tokens", "mass", "once"]].to_numpy().T
    return out[0], out[1], out[2]


def scores(docs: DataFrame, folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), folds).alias("held_out"), "text")
    training = rows.where("NOT held_out")
    counts = materialise(word_counts(training), "lm-counts")
    ends = training.count()
    whole = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = (whole["n"] or 0) + ends, whole["v"] + (ends > 0)
    norm = math.log10(n + SMOOTH * (v + 1))
    hot = hot_words(counts)
    size = min(gru.SIDE**2 - 1, sum(c >= MIN_COUNT for _, c in hot))
    side = gru.side_of(size)
    tokens, mass, once = class_masses(counts, [w for w, _ in hot[:size]])
    unseen = np.maximum(once, SMOOTH)
    vocabulary = np.full(side * side, -1.0)
    vocabulary[:size] = [c for _, c in hot[:size]]
    vocabulary[size] = ends
    codes = Codes({w.encode(): i for i, (w, _) in enumerate(hot)}, size, side)
    start = gru.flatten(gru.initial(np.concatenate([vocabulary, tokens])))
    trained = train(training, codes, start, n)
    sent = spark.sparkContext.broadcast((codes, np.log10([c + SMOOTH for _, c in hot]), np.log10(mass + unseen), trained))
    end_log = math.log10(ends + SMOOTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, logs, class_logs, flat = sent.value
        p = gru.unflatten(flat)
        for whole in batches:
            texts, columns = [], []
            for batch in small(whole, TOGETHER):
                words, each, at, model, bounds = own.of(batch.column(2))
                texts += own.documents(model.astype(np.int16), bounds)
                sizes, k = np.diff(bounds), batch.num_rows
                doc = np.repeat(np.arange(k), sizes)
                seen, out = at >= 0, model >= own.rest
                summed = lambda here, values, doc=doc, k=k: np.bincount(doc[here], values, k)
                hot_log = summed(seen, logs[at[seen]])
                # Words outside the vocabulary share their class by count; those in no table meet theirs in a join.
                shared = summed(seen & out, logs[at[seen & out]]) - summed(out, class_logs[model[out] - own.rest])
                pair, times = np.unique(doc[~seen] * len(words) + each[~seen], return_counts=True)
                which = pair % max(1, len(words))
                ending = np.zeros(len(words), np.int32)
                ending[each[~seen]] = model[~seen] - own.rest
                rare = pa.StructArray.from_arrays([words.take(pa.array(which)).cast(pa.string()), pa.array(times.astype(np.int64)), pa.array(ending[which])], names=["word", "k", "class"])
                starts = np.searchsorted(pair // max(1, len(words)), np.arange(k + 1))
                columns.append([
                    *(batch.column(i) for i in (0, 1)), pa.array(sizes + 1), pa.array(summed(seen, None) + (ends > 0)), pa.array(hot_log + end_log), pa.array(shared),
                    pa.ListArray.from_arrays(pa.array(starts, pa.int32()), rare),
                ])
            like = gru.log_probabilities(p, texts, own.end) / math.log(10)
            at = 0
            for c in columns:
                yield pa.RecordBatch.from_arrays([*c[:6], pa.array(like[at : at + len(c[0])]), c[6]], names=names)
                at += len(c[0])

    names = ["doc_id", "held_out", "n_tokens", "n_hot", "hot_log", "shared", "model", "rare"]
    schema = "doc_id long, held_out boolean, n_tokens long, n_hot long, hot_log double, shared double, model double, rare array<struct<word:string,k:long,class:int>>"
    scored = materialise(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k", "r.class")
    met = rare.join(counts, "word", "left").select("row", "k", F.coalesce("c", F.lit(0)).alias("c"), "class")
    new = F.get(F.array(*[F.lit(math.log10(u)) for u in unseen]), F.col("class"))
    by_count = F.col("k") * F.log10(F.col("c") + F.lit(SMOOTH))
    sums = met.groupBy("row").agg(
        F.sum(by_count).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("k"))).alias("rare_known"), F.sum(F.when(F.col("c") > 0, by_count).otherwise(F.col("k") * new)).alias("rare_shared")
    )
    all_ = scored.drop("rare").join(sums, "row", "left")
    nothing = F.lit(0.0)
    return all_.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_hot") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("hot_log") + F.coalesce("rare_log", nothing) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("model") + F.col("shared") + F.coalesce("rare_shared", nothing)).alias("score"),
    )
