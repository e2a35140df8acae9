"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule is a share measured on the whole text; a document is rejected where the share
exceeds the rule's cutoff in its stratum (language). Cutoffs come from a fixed ladder and
are chosen on labelled good documents that pass the base rules: a cutoff is allowed if the
exact binomial test rejects, at level DELTA / (rules x cutoffs x strata), that good documents
of the stratum are rejected more often than RISK / rules. The lowest allowed cutoff is used,
so with probability 1 - DELTA no stratum loses more than RISK of its good documents. A rule
with no allowed cutoff (too few labelled documents, or too many rejected) stays off there.

Defined results: null texts have no words and fail the base rules; a null language is a
stratum of its own; of several labels for one id the highest counts; repeated rows are
judged one by one; without labels every rule is off.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvia.llm.common import GAP, SPACE, materialise, words

SYMBOLS = "[#*$%&|<>]"
LADDER = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6)
RISK = 0.025
DELTA = 0.05
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
RULES = ("symbols", "dup_lines", "repeats", "shouts", "capitals")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


#: Low bits of a packed window that hold its place; no text has more words.
PLACE_BITS = 26


def _repeated_words(w: Column, packed: Column) -> Column:
    """Words in repeated 3-word windows; packed: the sorted (hash, place) of the windows of w.

    Hashes only narrow the windows down; what they leave is compared by its words. The
    windows at the last two words are cut short and equal no other.
    """
    mine = lambda v: F.shiftright(v, PLACE_BITS)
    beside = lambda v, k: mine(F.get(packed, k)) == mine(v)
    maybe = F.filter(packed, lambda v, k: F.coalesce(beside(v, k + 1), F.lit(False)) | ((k > 0) & beside(v, F.greatest(k - 1, F.lit(0)))))
    place = lambda v: v.bitwiseAND((1 << PLACE_BITS) - 1).cast("int")
    window = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    named = F.sort_array(F.transform(maybe, lambda v: F.struct(window(place(v)).alias("g"), place(v).alias("i"))))

    def covered(s: Column) -> Column:
        same = lambda x, k: F.get(s, k)["g"] == x["g"]
        twice = F.filter(s, lambda x, k: F.coalesce(same(x, k + 1), F.lit(False)) | ((k > 0) & same(x, F.greatest(k - 1, F.lit(0)))))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last"))
        return F.aggregate(F.sort_array(F.transform(twice, lambda x: x["i"])), start, step, lambda acc: acc["n"].cast("long"))

    # The lambda's argument is made once and used at every window.
    return F.get(F.transform(F.array(named), covered), F.lit(0))


def measured(docs: DataFrame, prefix: str = "_q_") -> DataFrame:
    """docs with the counts (COUNTS), the shares (RULES) and base_failed under the prefix."""
    p = prefix
    t = F.col(f"{p}text")
    staged = docs.withColumn(f"{p}text", F.coalesce("text", F.lit("")))
    staged = staged.withColumns({
        f"{p}w": words(t),
        f"{p}lines": F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0),
        f"{p}word_chars": (F.length(t) - F.regexp_count(t, F.lit(GAP))).cast("long"),
        f"{p}n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        f"{p}n_shouts": F.regexp_count(t, F.lit("!")).cast("long"),
        f"{p}n_capitals": F.regexp_count(t, F.lit("[A-Z]")).cast("long"),
    })
    w, lines = F.col(f"{p}w"), F.col(f"{p}lines")
    window = lambda x, i: F.shiftleft(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), PLACE_BITS).bitwiseOR(i.cast("long"))
    staged = staged.withColumn(f"{p}sorted", F.sort_array(F.transform(w, window)))
    staged = staged.withColumns({
        f"{p}n_words": F.size(w).cast("long"),
        f"{p}n_lines": F.size(lines).cast("long"),
        f"{p}n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        f"{p}n_repeat_words": _repeated_words(w, F.col(f"{p}sorted")),
    })
    n = {k: F.col(f"{p}{k}") for k in (*COUNTS, "n_lines", "n_shouts", "n_capitals")}
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    staged = staged.withColumns({
        f"{p}symbols": share(n["n_symbols"], n["word_chars"]),
        f"{p}dup_lines": share(n["n_dup_lines"], n["n_lines"]),
        f"{p}repeats": share(n["n_repeat_words"], n["n_words"]),
        f"{p}shouts": share(n["n_shouts"], n["word_chars"]),
        f"{p}capitals": share(n["n_capitals"], n["word_chars"]),
        f"{p}base_failed": (n["n_words"] < MIN_WORDS) | (100 * n["n_repeat_words"] > MAX_REPEAT_PERCENT * n["n_words"]),
        f"{p}stratum": F.coalesce("lang", F.lit("(none)")),
    })
    return staged.drop(*(f"{p}{k}" for k in ("text", "w", "lines", "sorted", "n_lines", "n_shouts", "n_capitals")))


def binomial_tail_at_most(k: Column, n: Column, risk: float, level: Column) -> Column:
    """Whether P(X <= k) <= level for X ~ Bin(n, risk), by an exact log-domain sum.

    From k >= n * risk on the tail is near one half or more, so nothing is summed there.
    """
    import math

    odds, first = math.log(risk) - math.log1p(-risk), math.log1p(-risk)
    start = F.struct((n * first).alias("term"), (n * first).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log(((n - i + 1) / i).cast("double")) + F.lit(odds)
        top = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(F.least(acc["total"], term) - top))).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<long>"))
    total = F.aggregate(steps, start, step, lambda acc: acc["total"])
    return F.when(k >= n * risk, F.lit(False)).otherwise(total <= F.log(level))


def calibrate(measures: DataFrame, labels: DataFrame, prefix: str = "_q_", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, one cutoff for each rule, null where the rule is off); a row for each stratum
    in which some rule is on."""
    p = prefix
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("best")).where("best = 1").select(F.col("doc_id").alias("good_id"))
    narrow = measures.select("doc_id", *[c for c in measures.columns if c.startswith(p)])
    used = narrow.where(~F.col(f"{p}base_failed")).join(good, F.col("doc_id") == F.col("good_id"), "left_semi")
    over = [F.count_if(F.col(f"{p}{r}") > c).alias(f"{r}_{i}") for r in RULES for i, c in enumerate(LADDER)]
    counted = used.groupBy(F.col(f"{p}stratum").alias("stratum")).agg(F.count("*").alias("n"), *over)
    tests = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cut"), F.col(f"{r}_{i}").alias("bad")) for r in RULES for i, c in enumerate(LADDER)]))
    rows = counted.select("stratum", "n", tests.alias("t")).select("stratum", "n", "t.*")
    level = F.lit(delta) / F.count("*").over(W.partitionBy())  # rules x cutoffs x strata rows, a bounded few
    passed = rows.withColumn("level", level).where(binomial_tail_at_most(F.col("bad"), F.col("n"), risk / len(RULES), F.col("level")))
    return passed.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cut"))).alias(f"cut_{r}") for r in RULES])


def judged(measures: DataFrame, cutoffs: DataFrame, prefix: str = "_q_") -> DataFrame:
    """measures with a boolean {prefix}kept: false by the base rules or any cutoff."""
    p = prefix
    named = cutoffs.select(F.col("stratum").alias(f"{p}of"), *[F.col(f"cut_{r}").alias(f"{p}cut_{r}") for r in RULES])
    joined = measures.join(named, F.col(f"{p}stratum") == F.col(f"{p}of"), "left")
    worse = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"{p}{r}") > F.col(f"{p}cut_{r}"), F.lit(False)) for r in RULES])
    return joined.withColumn(f"{p}kept", ~(F.col(f"{p}base_failed") | worse))


def free_prefix(columns: list[str]) -> str:
    prefix = "_q_"
    while any(c.startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept of every document. The counts are made once."""
    measures = materialise(measured(docs.select("doc_id", "lang", "text")).drop("text"), "quality")
    out = judged(measures, calibrate(measures, labels))
    return out.select("doc_id", *[F.col(f"_q_{c}").alias(c) for c in COUNTS], F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that no rule rejects.

    The counts are written once beside the rows: a filter on them would otherwise repeat
    their expressions at every use.
    """
    p = free_prefix(docs.columns)
    measures = materialise(measured(docs, p), "quality")
    return judged(measures, calibrate(measures, labels, p), p).where(f"{p}kept").select(*docs.columns)
