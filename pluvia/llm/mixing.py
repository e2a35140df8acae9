"""Temperature mixing of sources.

Source weights are token shares raised to an exponent and normalised. The exponent is
bisected until the weights' entropy, or the largest number of times a source is repeated,
meets the target. The weights are realised as block permutations: a source's documents fall
into hash blocks, each epoch takes the blocks (and the rows in a block) in another order,
and the last epoch ends where the source's token budget does.

Without a budget the mix is the smallest in which every source appears once in full, so
no document is lost, whatever the exponent.

Defined results: a null source is the source ''; null texts have no tokens; repeated rows
are separate rows; a source without tokens has weight 0 and appears once; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvia.llm.common import materialise, stable_long, words

#: Rows of a block, about, and the most blocks that a source is cut into.
BLOCK_ROWS = 256
MAX_BLOCKS = 4096
#: Exponents are rounded to so many decimals.
DECIMALS = 6
#: Points at which one pass evaluates the bisected function; passes.
FAN, PASSES = 17, 6


@dataclass(frozen=True)
class Target:
    """Exactly one of the two: entropy in nats, or the largest number of repeats of a source."""

    entropy: float | None = None
    repeats: float | None = None


def _probe(totals: DataFrame, exponents: list[float], budget: float | None) -> list[tuple[float, float]]:
    """(entropy, largest repeats) for each exponent, in one aggregation over the sources."""
    p = F.col("tokens") / F.col("all_tokens")
    sums = []
    for i, e in enumerate(exponents):
        w = F.pow(p, F.lit(e))
        sums += [F.sum(w).alias(f"z{i}"), F.sum(w * F.log(p)).alias(f"l{i}"), F.max(w / p).alias(f"hi{i}"), F.min(w / p).alias(f"lo{i}")]
    r = totals.where("tokens > 0").agg(F.max("all_tokens").alias("all"), *sums).first()
    import math

    out = []
    for i, e in enumerate(exponents):
        entropy = math.log(r[f"z{i}"]) - e * r[f"l{i}"] / r[f"z{i}"]
        repeats = r[f"hi{i}"] / r[f"lo{i}"] if budget is None else budget / r["all"] * r[f"hi{i}"] / r[f"z{i}"]
        out.append((entropy, repeats))
    return out


def exponent(totals: DataFrame, target: Target, budget: float | None = None) -> float:
    """The exponent in [0, 1] (0: equal weights, 1: as found) that meets the target.

    Entropy and repeats both fall as it rises. Each pass splits the bracket in FAN - 1 parts,
    a bisection of several levels at once, as each costs a job. Where even 1 misses the target
    (too low an entropy asked for, or repeats that the budget alone forces) the result is 1.
    """
    if (target.entropy is None) == (target.repeats is None):
        raise ValueError("give one of entropy and repeats")
    if totals.where("tokens > 0").isEmpty():
        return 1.0
    lo, hi = 0.0, 1.0
    met = lambda v: v[0] <= target.entropy if target.entropy is not None else v[1] <= target.repeats
    for _ in range(PASSES):
        points = [lo + (hi - lo) * i / (FAN - 1) for i in range(FAN)]
        values = _probe(totals, points, budget)
        first = next((i for i, v in enumerate(values) if met(v)), None)
        if first is None:
            return 1.0
        if first == 0:
            return round(points[0], DECIMALS)
        lo, hi = points[first - 1], points[first]
    return round(hi, DECIMALS)


def plan(docs: DataFrame, target: Target, budget: float | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows, sources). rows: row_key, doc_id, source, n_tokens, block; sources: source, tokens,
    n_docs, weight, epochs (how often the source appears; fractional), blocks."""
    rows = docs.select("row_key", "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.size(words(F.col("text"))).cast("long").alias("n_tokens"))
    rows = materialise(rows, "mix-rows")
    by_source = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    whole = by_source.agg(F.sum("tokens").alias("all_tokens"))
    totals = materialise(by_source.join(F.broadcast(whole)), "mix-sources")
    e = exponent(totals, target, budget)
    p = F.col("tokens") / F.col("all_tokens")
    raw = F.when(F.col("tokens") > 0, F.pow(p, F.lit(e))).otherwise(0.0)
    z = totals.agg(F.sum(raw).alias("z"), F.min(F.when(F.col("tokens") > 0, F.pow(p, F.lit(e)) / p)).alias("least"))
    w = totals.join(F.broadcast(z)).withColumn("weight", F.coalesce(F.try_divide(raw, F.col("z")), F.lit(0.0)))
    epochs = (raw / p / F.col("least")) if budget is None else (F.col("weight") * budget / F.col("tokens"))
    blocks = F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("n_docs") / BLOCK_ROWS).cast("int"))
    sources = w.select("source", "tokens", "n_docs", "weight", F.when(F.col("tokens") > 0, F.round(epochs, 6)).otherwise(1.0).alias("epochs"), blocks.alias("blocks"))
    return rows, sources


def mixed(docs: DataFrame, target: Target, budget: float | None = None, seed: int = 0) -> DataFrame:
    """row_key, doc_id, source, n_tokens, weight, epoch, block, start: every appearance of a row.

    docs needs a row_key. start is the token position in the source's stream. The windows
    run over (source, epoch, block), a few hundred rows each, and over the blocks of a source.
    """
    rows, sources = plan(docs, target, budget, seed)
    keyed = rows.join(F.broadcast(sources) if sources.count() <= 10_000 else sources, "source")
    # Rows without an id are dealt by their key, so that they are not one block.
    dealt = F.coalesce(F.col("doc_id").cast("string"), F.col("row_key").cast("string"))
    keyed = keyed.withColumn("block", F.pmod(stable_long("source", dealt, seed=f"block{seed}"), F.col("blocks").cast("long")).cast("int"))
    block_tokens = keyed.groupBy("source", "block").agg(F.sum("n_tokens").alias("b"), F.first("tokens").alias("tokens"), F.first("epochs").alias("epochs"))
    epoch = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("epochs").cast("int") - 1, F.lit(0)))).alias("epoch")
    spread = block_tokens.select("source", "block", "b", "tokens", "epochs", epoch)
    order = W.partitionBy("source", "epoch").orderBy(stable_long("source", "epoch", "block", seed=f"order{seed}"), "block")
    placed = spread.select("source", "block", "epoch", "tokens", "epochs", (F.col("tokens") * F.col("epoch") + F.sum("b").over(order) - F.col("b")).alias("base"))
    copies = keyed.select("row_key", "doc_id", "source", "n_tokens", "weight", "block").join(placed, ["source", "block"])
    inside = W.partitionBy("source", "epoch", "block").orderBy(stable_long("source", "epoch", "doc_id", seed=f"row{seed}"), "doc_id", "row_key")
    at = F.col("base") + F.sum("n_tokens").over(inside) - F.col("n_tokens")
    out = copies.withColumn("start", at)
    # Whole epochs are whole; the last one ends with the row that reaches the budget.
    take = (F.col("epoch") < F.floor("epochs")) | (F.col("start") < F.round(F.col("tokens") * F.col("epochs")))
    return out.where(take).select("row_key", "doc_id", "source", "n_tokens", "weight", "epoch", "block", F.col("start").cast("long").alias("start"))


def mix_documents(docs: DataFrame, target: Target, budget: float | None = None, seed: int = 0) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns."""
    # Under names of our own, so that none of the caller's clashes.
    own = [f"c{i}" for i in range(len(docs.columns))]
    kept = materialise(docs.toDF(*own).withColumn("row", F.monotonically_increasing_id()), "mix-docs")
    named = dict(zip([c.lower() for c in docs.columns], own, strict=True))
    narrow = kept.select(F.col("row").alias("row_key"), *[F.col(named[c]).alias(c) for c in ("doc_id", "source", "text")])
    taken = mixed(narrow, target, budget, seed).groupBy("row_key").agg(F.count("*").cast("int").alias("times"))
    repeated = kept.join(taken, kept["row"] == taken["row_key"])
    return repeated.select(*own, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select(*own).toDF(*docs.columns)
