"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples stand against unlabelled text: labelled rows with their labels
hidden. With class prior p, the risk of a classifier is
p * E_pos[loss(+)] + max(0, E_unl[loss(-)] - p * E_pos[loss(-)]), whose second part is kept
from falling under zero, where a flexible classifier would only memorise the positives.
A few numpy classifiers with different seeds are trained and their logits averaged.

Features are the presence of the words that tell positives from unlabelled texts best, by
document frequency. Only texts are looked at: no label, language, source or id.

The fit takes at most MAX_LABELLED labelled rows (those of smallest hash of their id), which
bounds what reaches the driver; scores cover every whole text.

Defined results: null and empty texts score by the bias alone; without positives or without
training rows every score is the class prior (0.0 if there are no labels); repeated rows are
scored one by one; of several labels for one id the highest counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import materialise, stable_long

#: Labelled rows that the fit takes at most.
MAX_LABELLED = 20_000
FEATURES = 256
SEEDS = (0, 1, 2)
_LETTERS = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> set[str]:
    """The distinct words of letters, in lower case."""
    return set(_LETTERS.findall(text.lower())) if text else set()


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def logit(self, text: str | None) -> float:
        found = self.weights.keys() & tokens(text)
        return self.bias + sum(sorted(self.weights[w] for w in found))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(pos: np.ndarray, unl: np.ndarray, prior: float, seed: int = 0, steps: int = 500, batch: int = 512, rate: float = 0.02, shrink: float = 5e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of one linear classifier under the sigmoid loss and the nnPU risk.

    Features are centred on the unlabelled mean, so common ones do not pull all logits down
    together; the returned bias makes up for it.
    """
    rng, d = np.random.default_rng(seed), pos.shape[1]
    theta = np.concatenate([rng.normal(0, 0.01, d), [0.0]]).astype(np.float32)
    m, v = np.zeros(d + 1, np.float32), np.zeros(d + 1, np.float32)
    centre = unl.mean(0)
    with_one = lambda x: np.hstack([x - centre, np.ones((len(x), 1), np.float32)])
    for step in range(1, steps + 1):
        u, p = with_one(unl[rng.integers(0, len(unl), batch)]), with_one(pos[rng.integers(0, len(pos), batch // 4)])
        zu, zp = _sigmoid(u @ theta), _sigmoid(p @ theta)
        # loss(+) = sigmoid(-z), loss(-) = sigmoid(z); slope of loss(-): sigmoid(z) (1 - sigmoid(z))
        gu, gp = ((zu * (1 - zu))[:, None] * u).mean(0), ((zp * (1 - zp))[:, None] * p).mean(0)
        if zu.mean() - prior * zp.mean() >= 0:
            g = gu - 2 * prior * gp
        else:
            g = prior * gp - gu  # step back from the negative risk
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(0, np.abs(theta[:-1]) - shrink * rate)
    return theta[:-1], float(theta[-1] - theta[:-1] @ centre)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from the labelled rows outside the held-out fold."""
    clean = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"), folds))
    marks = clean.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    chosen = marks.orderBy(stable_long("label_id"), "label_id").limit(max_labelled)
    # Rows of one id are many texts, or one many times: ids and hashes are chosen first, so neither
    # what is sent to every task nor what is fitted on grows with them.
    keys = docs.select("doc_id", F.xxhash64("text").alias("th")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    picked = keys.select("label_id", "th", "toxic").distinct().orderBy(stable_long("label_id"), "label_id", "th").limit(max_labelled)
    found = docs.select("doc_id", "text").withColumn("th2", F.xxhash64("text")).join(F.broadcast(picked), (F.col("doc_id") == F.col("label_id")) & (F.col("th2") == F.col("th")))
    pool = found.groupBy("label_id", "th").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", (F.col("toxic") > 0).alias("pos"))

    def seen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"words": [sorted(tokens(t)) for t in f["text"]], "pos": f["pos"]})

    rows = materialise(pool.mapInPandas(seen, "words array<string>, pos boolean").withColumn("row", F.monotonically_increasing_id()), "toxic-pool")
    n = rows.agg(F.count("*").alias("u"), F.count_if("pos").alias("p")).first()
    if not n["p"]:
        return Model({}, -40.0)
    prior = n["p"] / n["u"]
    by_word = rows.select("row", "pos", F.explode("words").alias("word"))
    frequency = by_word.groupBy("word").agg(F.count("*").alias("u"), F.count_if("pos").alias("p")).where("u >= 3")
    share = F.col("u") / n["u"]
    expected = share * n["p"]
    z = F.abs(F.col("p") - expected) / F.sqrt(expected * (1 - share) + 1)
    best = frequency.orderBy(F.desc(z), "word").limit(FEATURES).select("word").collect()
    place = {r["word"]: i for i, r in enumerate(best)}

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"row": f["row"], "pos": f["pos"], "at": [[place[w] for w in ws if w in place] for ws in f["words"]]})

    got = rows.select("row", "pos", "words").mapInPandas(coded, "row long, pos boolean, at array<int>").toPandas().sort_values("row")
    x = np.zeros((len(got), len(place)), np.float32)
    for i, at in enumerate(got["at"]):
        x[i, np.asarray(at, int)] = 1
    models = [train(x[got["pos"].to_numpy(bool)], x, prior, seed) for seed in SEEDS]
    w, b = np.mean([m[0] for m in models], axis=0), float(np.mean([m[1] for m in models]))
    return Model({word: float(w[i]) for word, i in place.items() if w[i]}, b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; one pass, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "score": _sigmoid(np.array([model.logit(t) for t in f["text"]], float))})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
