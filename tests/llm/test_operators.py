"""Each operator against a brute-force version, and on nulls, repeats, long and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import comb, log10

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import functions as F

from pluvia.llm import bitplanes, bpe, gru, line_dedup, lm_score, mixing, ngram_join, quality, sharding, sketch, toxicity
from pluvia.llm.common import shared_dir

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_bpe_round_trip(docs, empty, rows):
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    want = Counter()
    for r in rows:
        ids = [i for m in regex.findall(public_tokenizers.PATTERN, r[1] or "") for i in enc.encode_ordinary(m)]
        want[(r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    got = Counter(tuple(r) for r in bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect())
    assert got == want
    assert bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_long_text_is_cut_safely():
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(5)
    parts = ["word", " ", "  ", "\n", "\t", " ", "9", "'s", "é", "!?", " \n ", "\r\n"]
    for _ in range(20):
        text = "".join(rng.choice(parts) for _ in range(4000))
        assert [i for p in bpe.safe_pieces(text, 50) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_bpe_takes_very_long_white_space():
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for text in ("a" + " " * 2_000_000 + "b", "\n" * 2_000_000, "a" + "\n " * 1_000_000 + "\u00e9"):
        assert enc.decode_bytes(bpe.encode_text(enc, text)) == text.encode()
    rng = random.Random(6)
    for _ in range(30):  # the same rule on runs that the library itself can take
        runs = ["".join(rng.choice(" \n\t") for _ in range(rng.randrange(4090, 4200))) for _ in range(3)]
        text = "x" * 10 + runs[0] + "word " + runs[1] + "9" * 10 + rng.choice(["", "z"]) + runs[2]
        parts = [i for part, run in bpe.without_long_runs(text) for i in (enc._encode_single_piece(part.encode()) if run else enc.encode_ordinary(part))]
        assert parts == enc.encode_ordinary(text)


def test_toxicity_learns_and_takes_anything(spark, docs, empty, labels):
    rng = random.Random(1)
    bad = ["vile", "grim", "foul"]
    made = []
    for i in range(1500):
        words = [f"w{rng.randrange(300)}" for _ in range(40)]
        toxic = i % 10 == 0
        for _ in range(3 * toxic):
            words[rng.randrange(40)] = rng.choice(bad)
        made.append((i, " ".join(re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], w) for w in words), int(toxic)))
    d = spark.createDataFrame([m[:2] for m in made], "doc_id long, text string")
    lab = spark.createDataFrame([(m[0], 1, m[2]) for m in made], "doc_id long, quality int, toxic int")
    truth = {m[0]: m[2] for m in made}
    held = [r for r in toxicity.toxicity(d, lab).collect() if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert sum(r["predicted"] for r in held if truth[r["doc_id"]]) >= 0.9 * sum(truth[r["doc_id"]] for r in held)
    assert toxicity.toxicity(docs, labels).count() == docs.count()
    assert toxicity.toxicity(docs, labels.limit(0)).where("predicted = 1 OR score > 0.01").count() == 0
    assert toxicity.toxicity(empty, labels.limit(0)).count() == 0


def test_nnpu_risk_never_rewards_memorising():
    rng = np.random.default_rng(0)
    pos = (rng.random((60, 200)) < 0.1).astype(np.float32)
    unl = (rng.random((600, 200)) < 0.1).astype(np.float32)
    w, b = toxicity.train(pos, unl, 0.1)
    # Positives like the rest: no flood of positives among fresh texts.
    fresh = (rng.random((600, 200)) < 0.1).astype(np.float32)
    assert (fresh @ w + b > 0).mean() < 0.2


def test_lm_base_score_and_gain(docs, empty, rows):
    train = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10]
    tokens = lambda r: (r[1] or "").encode().lower().split() + [None]
    c = Counter(t for r in train for t in tokens(r))
    n, v = sum(c.values()), len(c)
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append((len(tokens(r)), sum(c[t] > 0 for t in tokens(r)), sum(log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(r))))
    got = lm_score.scores(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["train_tokens"] == n and r["score"] < 0
        assert any(r["n_tokens"] == a and r["n_known"] == b and abs(r["base_score"] - s) < 1e-6 * abs(s) + 1e-9 for a, b, s in want[r["doc_id"]])
    assert lm_score.scores(empty).count() == 0


def test_lm_rare_words_come_by_a_join(docs, monkeypatch):
    full = sorted((r["doc_id"] or -1, r["n_known"], round(r["base_score"], 6)) for r in lm_score.scores(docs).collect())
    monkeypatch.setattr(lm_score, "HOT", 5)
    few = sorted((r["doc_id"] or -1, r["n_known"], round(r["base_score"], 6)) for r in lm_score.scores(docs).collect())
    assert few == full


def test_lm_score_is_the_same_however_it_is_read(docs, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 2000)
    monkeypatch.setattr(lm_score, "FAN_IN", 2)
    scored = [sorted((r["doc_id"] or -1, r["n_tokens"], round(r["score"], 6)) for r in lm_score.scores(docs.repartition(k)).collect()) for k in (1, 4)]
    assert scored[0] == scored[1]


def test_gru_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(4)
    p = gru.initial(rng.integers(1, 1000, 64 * 64 + gru.REST).astype(float))
    for k in ("u", "c", "d"):
        p[k] = rng.normal(0, 1.5, p[k].shape).astype(np.float32)
    docs_ = [rng.integers(0, 4095, rng.integers(1, 300)).astype(np.int16) for _ in range(300)]
    whole = gru.log_probabilities(p, docs_, 4095)
    for size in (1, 7, 100):
        assert (np.concatenate([gru.log_probabilities(p, docs_[i : i + size], 4095) for i in range(0, 300, size)]) == whole).all()


def test_lm_beats_the_base_on_held_out_documents(spark):
    got = lm_score.scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").toPandas()
    assert len(got) > 50 and got["score"].sum() > 0.97 * got["base_score"].sum()


def test_lm_deals_rows_of_one_id_over_shards(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 500)
    rows = [(None if i % 2 else 3, f"w{i % 50} w{i % 7} word number {i}") for i in range(600)]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = docs_.select(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text")), F.lit(6)).alias("s"), "doc_id").groupBy("doc_id", "s").count().collect()
    assert len(dealt) == 12 and max(r["count"] for r in dealt) < 100
    got = [sorted((r["doc_id"] or -1, r["n_tokens"], round(r["score"], 6)) for r in lm_score.scores(docs_.repartition(k)).collect()) for k in (1, 3)]
    assert got[0] == got[1] and len(got[0]) == 600


def test_gru_is_a_distribution_and_its_gradients_are_right():
    rng = np.random.default_rng(0)
    side = 6
    size = side * side + gru.REST
    counts = rng.integers(1, 50, size).astype(float)
    p = {k: v.astype(np.float64) for k, v in gru.initial(counts).items()}
    start = [np.array([5, 7, i], np.int16) for i in range(size)]
    prefix = gru.log_probabilities(p, [np.array([5, 7], np.int16)], 3)[0]
    assert abs(np.exp(gru.log_probabilities(p, start, 3) - prefix).sum() - 1) < 1e-3
    assert all((a == b).all() for a, b in zip(gru.unflatten(gru.flatten(gru.initial(counts))).values(), gru.initial(counts).values(), strict=True))
    ids, target = rng.integers(0, size, (6, 5)), rng.integers(0, size, (6, 5))
    fresh = rng.random((6, 5)) < 0.2
    loss = lambda q: -gru._output(q, gru._states(q, ids, fresh, np.zeros((5, gru.HIDDEN)), False)[0].reshape(-1, gru.HIDDEN).astype(float), target.reshape(-1), None)[0].sum()
    grads, _, _ = gru.Trainer(p).gradients(ids, fresh, target, np.ones((6, 5)), np.zeros((5, gru.HIDDEN)))
    for k, at in (("u", (3, 20)), ("c", (2, 5)), ("cb", (4,)), ("inputs", (ids[2, 2], 9)), ("inputs", (ids[1, 0], 40))):
        hi, lo = ({a: b.copy() for a, b in p.items()} for _ in range(2))
        hi[k][at] += 1e-2
        lo[k][at] -= 1e-2
        assert abs((loss(hi) - loss(lo)) / 2e-2 / 30 - grads[k][at]) < 1e-5


def test_gru_rows_without_weight_have_no_part_in_gradients():
    rng = np.random.default_rng(5)
    p = gru.initial(rng.integers(1, 100, 8 * 8 + gru.REST).astype(float))
    h, target = rng.normal(0, 0.5, (200, gru.HIDDEN)).astype(np.float32), rng.integers(0, 8 * 8 + gru.REST, 200)
    weight = (rng.random(200) < 0.7).astype(np.float32)
    logp, grads, dh = gru._output(p, h, target, weight)
    used = weight > 0
    some, few, dsome = gru._output(p, h[used], target[used], np.ones(used.sum(), np.float32))
    assert np.allclose(logp[used], some, atol=1e-5) and np.allclose(dh[used], dsome, atol=1e-5) and not dh[~used].any()
    assert all(np.allclose(grads[k], few[k], atol=1e-4) for k in grads)


def test_gru_learns_context_and_carries_state_through_long_texts():
    rng = np.random.default_rng(2)
    size, end = 18 * 18 + gru.REST, 323
    docs = [np.append(100 * int(rng.integers(0, 3)) + rng.integers(0, 20, 60), end).astype(np.int16) for _ in range(400)]
    counts = np.bincount(np.concatenate(docs), minlength=size).astype(float)
    p, before = gru.initial(counts), gru.log_probabilities(gru.initial(counts), docs, end).sum()
    trainer = gru.Trainer(p)
    for _ in range(6):
        trainer.run(docs, end)
    assert gru.log_probabilities(trainer.p, docs, end).sum() > before * 0.9
    # One text alone, step by step, and among others.
    long_ = np.concatenate([d[:-1] for d in docs[:9]] + [docs[9]])
    states, _, _ = gru._states(trainer.p, np.concatenate([[end], long_[:-1]])[:, None], np.arange(len(long_))[:, None] == 0, np.zeros((1, gru.HIDDEN), np.float32), False)
    whole = gru._output(trainer.p, states.reshape(-1, gru.HIDDEN), long_, None)[0].sum()
    assert abs(gru.log_probabilities(trainer.p, [docs[0], long_, docs[1]], end)[1] - whole) < 1e-3 * abs(whole)


def test_quality_counts(docs, empty, labels, rows):
    def brute(text):
        w = split(text)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeat = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if split(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeat)

    got = Counter((r["doc_id"], *(r[c] for c in quality.COUNTS), r["base_failed"]) for r in quality.verdicts(docs, labels).collect())
    want = Counter((r[0], *(b := brute(r[1])), b[0] < 50 or 100 * b[4] > 50 * b[0]) for r in rows)
    assert got == want
    assert quality.verdicts(empty, labels.limit(0)).count() == 0
    kept = quality.kept_documents(docs, labels)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in quality.verdicts(docs, labels).where("kept").select("doc_id").collect())


def test_binomial_bound_is_exact(spark):
    from pyspark.sql import functions as F

    cases = [(k, n) for n in (10, 300, 2000) for k in (0, 1, 2, 5, 12) if k < n]
    df = spark.createDataFrame(cases, "k long, n long")
    got = {(r["k"], r["n"]): r["ok"] for r in df.withColumn("ok", quality.binomial_tail_at_most(F.col("k"), F.col("n"), 0.01, F.lit(0.01))).collect()}
    for k, n in cases:
        tail = sum(comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1))
        assert got[k, n] == (k < n * 0.01 and tail <= 0.01)


def test_quality_cutoffs_keep_the_risk(spark):
    rng = random.Random(3)
    words = lambda n, tail="": " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}{tail}" for _ in range(n))
    d = [(i, words(60, "%%%" if i % 10 == 0 else ""), "en") for i in range(4000)]
    docs = spark.createDataFrame(d, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(4000)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.verdicts(docs, labels).collect()}
    assert not any(got[i] for i in range(0, 4000, 10)) and sum(got[i] for i in range(4000) if i % 10) >= 3600 * (1 - quality.RISK)


def test_mixing_meets_targets(spark, docs, empty):
    d = spark.createDataFrame([(i, "a b c d", "big" if i % 10 else "small") for i in range(4000)], "doc_id long, text string, source string").selectExpr("doc_id AS row_key", "*")
    got = mixing.mixed(d, mixing.Target(repeats=3.0)).toPandas()
    times = got.groupby("source")["doc_id"].count().to_dict()
    assert times["big"] == 3600 and abs(times["small"] - 1200) <= 1
    assert got.groupby("doc_id").size().min() == 1
    for _, part in got.groupby("source"):  # a stream without gaps, and another order in each epoch
        part = part.sort_values("start")
        assert (part["start"].diff().dropna() == 4).all() and part["start"].iloc[0] == 0
    small = got[got["source"] == "small"].sort_values("start")
    assert list(small[small["epoch"] == 0]["doc_id"]) != list(small[small["epoch"] == 1]["doc_id"])
    half = mixing.mixed(d, mixing.Target(entropy=0.5), budget=8000).toPandas()
    w = half.groupby("source")["weight"].first()
    assert abs(-(w * np.log(w)).sum() - 0.5) < 1e-3 and abs(half["n_tokens"].sum() - 8000) <= 8
    mixed = mixing.mix_documents(docs, mixing.Target(repeats=2.0))
    assert mixed.columns == docs.columns and mixed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert mixing.mix_documents(empty, mixing.Target(repeats=2.0)).count() == 0


def test_token_planes(docs, empty, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for r in order:
        ids = np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = bitplanes.write_and_digest(docs, JSON).orderBy("start").collect()
    assert [tuple(r) for r in got] == want
    assert sorted(map(tuple, bitplanes.write_and_digest(docs, JSON, kind="bit").collect()), key=lambda r: r[1]) == want
    assert bitplanes.write_and_digest(empty, JSON).count() == 0


def test_planes_round_trip_and_compress():
    rng = np.random.default_rng(0)
    for n in (0, 1, 4095, 4096, 9000):
        ids = rng.integers(0, 50_000, n).astype("<u4")
        for kind in ("bit", "byte"):
            assert (bitplanes.unpack(bitplanes.pack(ids, kind), n, kind) == ids).all()
    ids = rng.integers(0, 50_000, 40_960).astype("<u4")
    assert sum(map(len, bitplanes.pack(ids))) < 0.55 * ids.nbytes


def test_file_tokenizer_memo_is_exact():
    tok, rng = bitplanes.FileTokenizer(JSON, bound=200), random.Random(4)
    parts = ["word", "Wörter", " ", " ", " ", "\n", "\n\n", "\t", "9", "'s", "!?", ".", ",", "<|endoftext|>", "\u00a0", "\r\n", "\x1c", "日本", "x" * 60]
    for one in range(300):
        texts = ["".join(rng.choice(parts if one % 2 else parts[:9] + parts[11:13]) for _ in range(rng.randrange(60))) for _ in range(rng.randrange(4))]
        got = tok.encode_batch(texts)
        assert [g.tolist() for g in got] == [tok.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_fingerprints_with_neighbours(docs, empty, rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = (sketch.sketch(t) for t in (text, edited, after))
        want.append((r[0], len(text), edited, sketch.fingerprint(a, text), sketch.fingerprint(b, edited), sketch.text_likeness(a, b, text, edited), sketch.text_likeness(a, c, text, after)))
    assert Counter(map(tuple, sketch.neighbour_sketches(docs).collect())) == Counter(want)
    assert sketch.neighbour_sketches(empty).count() == 0


def test_sketches_estimate_containment(spark):
    rng = random.Random(7)
    whole = "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    part = whole[10_000:16_000]
    a, b = sketch.sketch(part), sketch.sketch(whole)
    assert sketch.containment(a, b) > 0.99 and 0.05 < sketch.containment(b, a) < 0.2
    other = "".join(rng.choice("abcdefgh ") for _ in range(6_000))
    assert abs(sketch.containment(sketch.sketch(part[:3000] + other[:3000]), b) - 0.5) < 0.15
    assert (sketch.merge(sketch.sketch(whole[:30_000]), sketch.sketch(whole[29_989:])) == b).all()
    df = spark.createDataFrame([(0, 0, whole[:30_000]), (1, 0, whole[29_989:])], "doc_id long, g long, text string")
    joined = sketch.merged(sketch.sketches(df).join(df.select("doc_id", "g"), "doc_id"), "g").first()["sketch"]
    assert set(joined) == set(b.view(np.int64).tolist())


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    links += [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] == rows[j][0]] if len({r[0] for r in rows}) < len(rows) else []
    return sets, components(len(rows), links)


def near_rows(seed, n_base, copies):
    rng, rows = random.Random(seed), []
    for _ in range(n_base):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 160))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(copies)):
            edit = list(base)
            for _ in range(rng.randrange(0, 5)):
                edit[rng.randrange(len(edit))] = f"w{rng.randrange(400)}"
            rows.append(" ".join(edit[: rng.randrange(max(1, len(edit) - 6), len(edit) + 1)]).upper() if rng.random() < 0.3 else " ".join(edit))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_ngram_join(spark, docs, empty):
    for seed, n, percent in ((0, 3, 90), (1, 5, 80)):
        rows = near_rows(seed, 60, 7)
        sets, root = brute_components(rows, n, percent)
        got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n, percent).collect()
        assert {tuple(r) for r in got} == {(i, len(sets[i]), root[i]) for i, _ in rows}
        kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), n, percent)
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))
    assert ngram_join.jaccard_components(docs).count() == docs.count()
    assert ngram_join.jaccard_components(empty).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id IS NULL").count() == 1
    # Rows of one id: unrelated texts stay, a repeat goes; columns may be called what they like.
    one = spark.createDataFrame([(1, "a b c d e f g", 5), (1, "h i j k l m n", 6), (1, "a b c d e f g", 7), (2, "A b c d e f g", 8), (3, " ", 9)], "doc_id long, text string, _row int")
    kept = ngram_join.one_of_each(one)
    assert kept.columns == one.columns and sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, "a b c d e f g"), (1, "h i j k l m n"), (3, " ")]


def test_ngram_join_takes_a_hot_passage(spark):
    """Copies of one passage with changed words, and texts that hold it between words of their own."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(80)]
    texts = [" ".join([f"e{i}" if rng.random() < 0.02 else w for i, w in enumerate(passage)]) for _ in range(250)]
    texts += [" ".join([*[f"o{rng.randrange(10**6)}" for _ in range(60)], *passage]) for _ in range(150)]
    rows = list(enumerate(texts))
    sets, root = brute_components(rows, 3, 90)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {tuple(r) for r in got} == {(i, len(sets[i]), root[i]) for i, _ in rows}


def test_every_linked_pair_shares_a_tile():
    rng = np.random.default_rng(3)
    for percent in (90, 80):
        bands, met = ngram_join.Bands(percent / 100), 0
        tiles = lambda s: set(ngram_join.tiles(s, bands, percent).tolist())
        for _ in range(600):
            n = int(rng.integers(1, 300)) if rng.random() < 0.5 else int(rng.integers(1, 25))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop = int(rng.integers(0, n * (100 - percent) // 100 + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, n * (100 - percent) // 100 + 1))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                met += 1
                assert tiles(a) & tiles(b)
                for parts in (8, 16):
                    x, y = ngram_join.bitmap(a, parts), ngram_join.bitmap(b, parts)
                    assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(a) + len(b) - 2 * both
                x = ngram_join.bitmap(a, 16)
                assert (x[:8] ^ x[8:] == ngram_join.bitmap(a, 8)).all() and (ngram_join.folded_to(x, 4) == ngram_join.bitmap(a, 4)).all()
        assert met > 200


def test_sharding(spark, docs, empty, rows):
    got = sharding.assign(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    rng = random.Random(2)
    big = [(i, "hot text " * 20 if i % 3 == 0 else "x" * rng.randrange(1, 400) + str(i)) for i in range(6000)]
    placed = sharding.assign(spark.createDataFrame(big, "doc_id long, text string")).toPandas()
    sizes = placed.groupby("shard")["size"].sum()
    assert len(sizes) == 24 and sizes.max() / sizes.min() < 1.03
    for _, part in placed.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert sharding.assign(empty).count() == 0
    # A third of the rows are one row many times.
    hot = [(7, "hot text " * 3)] * 6000 + [(i, f"own {i} " * 5) for i in range(100, 8100)]
    placed = sharding.assign(spark.createDataFrame(hot, "doc_id long, text string")).toPandas()
    sizes = placed.groupby("shard")["size"].sum()
    assert len(sizes) == 24 and sizes.max() / sizes.min() < 1.1
    for _, part in placed.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_packing_places_by_dot_product():
    """Against a plain loop over the same rule."""
    rng = np.random.default_rng(5)
    items = rng.integers(1, 100, (60, 3)).astype(float)
    sizes = items / items.sum(0) * 5
    left, want = np.ones((5, 3)), {}
    for i in sorted(range(60), key=lambda i: (-sizes[i].max(), i)):
        best = max(range(5), key=lambda b: (left[b][0] >= sizes[i][0], float(left[b] @ sizes[i]), -b))
        if not any(left[b][0] >= sizes[i][0] for b in range(5)):
            best = max(range(5), key=lambda b: (float(left[b] @ sizes[i]), -b))
        want[i] = best
        left[best] -= sizes[i]
    assert sharding.pack(items, 5).tolist() == [want[i] for i in range(60)]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, line, most):
    out = list(line)
    for _ in range(rng.randrange(most + 1)):
        i = rng.randrange(len(out) + 1)
        out[i : i + rng.randrange(2)] = rng.choice(["", "q", "zz"])
    return "".join(out)


def test_edit_distance_and_segments():
    rng = random.Random(1)
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(14)))
        b = edited(rng, a, 4)
        d = levenshtein(a, b)
        for tau in (1, 2, 3):
            assert line_dedup.within(a, b, tau) == (d <= tau)
            if d <= tau and min(len(a), len(b)) > tau:
                short, long_ = sorted((a, b), key=len)
                assert set(line_dedup.index_keys(short, tau)) & set(line_dedup.probe_keys(long_, tau))


def brute_lines(rows, tau, short):
    """Kept lines by (doc_id, line number), ranked as the operator ranks them (ids are distinct)."""
    first = {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        for i, line in enumerate((text or "").split("\n")):
            if split(line):
                first.setdefault(line, (doc, i))
    kept = set()
    for line, at in first.items():
        if not any(o < at and len(line) >= short and len(x) >= short and abs(len(x) - len(line)) <= tau and levenshtein(x, line) <= tau for x, o in first.items()):
            kept.add(at)
    return kept


def test_line_dedup(spark, docs, empty):
    rng = random.Random(6)
    pool = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(1, 60))) for _ in range(50)] + ["", "  "]
    rows = [(i, "\n".join(edited(rng, rng.choice(pool), 3) if rng.random() < 0.4 else rng.choice(pool) for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    kept = brute_lines(rows, 2, 30)
    want = {}
    for doc, text in rows:
        lines = text.split("\n")
        want[doc] = ("\n".join(x for i, x in enumerate(lines) if not split(x) or (doc, i) in kept), sum(bool(split(x)) for x in lines), sum((doc, i) in kept for i in range(len(lines))))
    found = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["_lines"]["text"], r["_lines"]["n"], r["_lines"]["kept"]) for r in found} == want
    clean = line_dedup.clean(docs)
    assert clean.columns == docs.columns
    assert clean.where("text IS NULL").count() == docs.where("text IS NULL").count()
    assert line_dedup.clean(empty).count() == 0


def graded_reference(n):
    """Edits allowed for the shorter of two lines, stated apart from the operator."""
    return n // 20 if n >= 60 else 2 if n >= 30 else 1 if n >= 10 else 0


def shapes_alike(x, y):
    if x < 0 or y < 0:
        return x == y
    return abs((x >> 12) - (y >> 12)) <= 2 and (x >> 6 & 63) - (y & 63) <= 3 and (y >> 6 & 63) - (x & 63) <= 3


def test_graded_keys_meet_and_distances_agree():
    rng = random.Random(8)
    for n in (10, 29, 30, 58, 59, 60, 61, 79, 80, 119, 198, 199, 200, 209, 210, 300, 419):
        for _ in range(40):
            a = "".join(rng.choice("abcdefgh ") for _ in range(n))
            b = edited(rng, a, graded_reference(n) + 1)
            if min(len(a), len(b)) < 10:
                continue
            tau = graded_reference(min(len(a), len(b)))
            d = levenshtein(a, b)
            assert line_dedup.near(a, b) == (d <= tau) and line_dedup.distance_at_most(a, b, 5) == (d <= 5)
            if d <= tau:
                # The rows of a key must be alike, whatever runs are common.
                for common in (np.zeros(line_dedup.BUCKETS, bool), np.arange(line_dedup.BUCKETS) % 3 == 0):
                    of, key, shape, _ = line_dedup.graded_keys([a, b], common)
                    one, other = (dict(zip(key[of == i].tolist(), shape[of == i].tolist(), strict=True)) for i in (0, 1))
                    assert any(shapes_alike(one[k], other[k]) for k in one.keys() & other.keys())


def test_line_dedup_grows_with_the_line(spark):
    rng = random.Random(9)
    pool = ["".join(rng.choice("abcdef ") for _ in range(n)) for n in (12, 25, 45, 59, 61, 80, 130, 199, 205, 300, 300, 450)]
    rows = [(i, "\n".join(edited(rng, x := rng.choice(pool), rng.randrange(len(x) // 15 + 2)) for _ in range(3))) for i in range(60)]
    firsts = {}
    for doc, text in rows:
        for i, line in enumerate(text.split("\n")):
            if split(line):
                firsts.setdefault(line, (doc, i))
    close = lambda x, y: abs(len(x) - len(y)) <= (t := graded_reference(min(len(x), len(y)))) and levenshtein(x, y) <= t
    kept = {at for line, at in firsts.items() if not any(o < at and close(line, x) for x, o in firsts.items())}
    found = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), graded=True).collect()
    assert {r["doc_id"]: r["_lines"]["kept"] for r in found} == {doc: sum((doc, i) in kept for i in range(3)) for doc, _ in rows}


def test_spots_of_near_lines_are_alike(spark):
    rng = random.Random(31)
    pairs, near = [], []
    for n in (62, 63, 90, 140, 260, 410, 700):
        for k in range(60):
            a = "".join(rng.choice("abcdefgh ") for _ in range(n))
            a = a[: n // 3] + a[:20] + a[n // 3 + 20 :] if k % 3 == 0 else a  # a run that stands twice
            b = edited(rng, a, n // 20 + 1) if k % 2 else "".join(rng.choice("abcdefgh ") for _ in range(n // 2)) + a[:14] + a[n // 2 + 14 :]
            of, key, low, high, _ = line_dedup.placed_keys([a, b], np.zeros(line_dedup.BUCKETS, bool))
            sizes = np.array([len(a), len(b)])
            spot = line_dedup.spots(sizes[of], low, high, line_dedup.letter_counts([a, b])[of])
            one, other = (dict(zip(key[of == i].tolist(), spot[of == i].tolist(), strict=True)) for i in (0, 1))
            met = [(one[x], other[x]) for x in one.keys() & other.keys()]
            pairs += met
            if line_dedup.near(a, b):
                near.append(any(line_dedup.spots_alike(*np.array(met).T)))
    far = (1 << line_dedup.PLACE) - 1
    odd = line_dedup.spots(np.array([far + 5, far + 900, far - 1]), np.array([3, far + 100, 3]), np.array([3, far + 100, 9]), np.zeros((3, line_dedup.COUNTS), np.uint8))
    pairs += [(int(odd[0]), int(odd[1])), (int(odd[0]), int(odd[2])), (-1, -1), (-1, int(odd[2]))]
    assert len(near) > 100 and all(near)
    by_numpy = line_dedup.spots_alike(*np.array(pairs).T).tolist()
    by_spark = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], "i long, x long, y long").select("i", line_dedup._alike("x", "y").alias("ok"))
    assert [r["ok"] for r in by_spark.orderBy("i").collect()] == by_numpy and by_numpy[-4:] == [True, True, True, False] and 0 < sum(by_numpy) < len(pairs)


def test_lines_that_share_a_passage_by_chance_are_not_paired(spark, monkeypatch):
    rng = random.Random(32)
    made = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = made(40)
    lines = [made(rng.randrange(170, 230)) + passage + made(rng.randrange(170, 230)) for _ in range(150)]
    rows, counted = {}, line_dedup.materialise

    def counting(df, label, *more):
        out = counted(df, label, *more)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "materialise", counting)
    docs_ = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    assert line_dedup.graded_places(docs_).count() == 150
    assert rows["line-open"] < 150 * 149 / 2 / 20


def test_pipeline_stages_delete_what_earlier_ones_left(spark, tmp_path):
    import corpus_pipeline

    from pluvia.llm import common

    first, second, third = (corpus_pipeline._in_turn(k, lambda spark, docs, sf_dir, k=k: common.materialise(docs, f"turn{k}")) for k in range(3))
    mine = lambda: sorted(n for x in common.left() if (n := x.rsplit("/", 1)[1].rsplit("-", 1)[0]).startswith("turn"))
    spark.range(5).write.parquet(str(tmp_path / "given"))
    one = first(spark, spark.read.parquet(str(tmp_path / "given")), str(tmp_path))
    two = second(spark, one, str(tmp_path))  # reads what the first left
    assert mine() == ["turn0", "turn1"] and one.count() == 5
    two.write.parquet(str(tmp_path / "two"))
    third(spark, spark.read.parquet(str(tmp_path / "two")), str(tmp_path))
    assert mine() == ["turn2"]


def test_nothing_is_left_outside_the_shared_folder(spark):
    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before kept."""
    import hashlib

    import corpus_pipeline

    rng = random.Random(12)
    words = [f"word{i}" for i in range(3000)]
    made = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [made(70) + "\n" + made(60) for _ in range(25)]
    texts += [t + " tail" for t in texts[:5]]  # near copies
    texts += [made(60) + "\n" + texts[6].split("\n")[0] for _ in range(3)]  # a line that stands elsewhere
    texts += ["too short", None, ""]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "ngram_join", "mixing", "bpe"]
    held = {i: t for i, t in enumerate(texts) if t and len(t.split()) >= 50}  # too few labels for any cutoff
    firsts, lines = {}, {}
    for i, t in held.items():
        for no, line in enumerate(t.split("\n")):
            firsts.setdefault(line, (i, no))
    close = lambda x, y: abs(len(x) - len(y)) <= graded_reference(min(len(x), len(y))) and levenshtein(x, y) <= graded_reference(min(len(x), len(y)))
    for line, at in firsts.items():
        if not any(o < at and close(x, line) for x, o in firsts.items()):
            lines.setdefault(at[0], []).append((at[1], line))
    deduped = {i: "\n".join(x for _, x in sorted(v)) for i, v in lines.items()}
    order = sorted(deduped)
    _, root = brute_components([(i, deduped[i]) for i in order], 5, 80)
    kept = {order[k]: deduped[order[k]] for k in set(root)}
    for (name, stage), want in zip(corpus_pipeline.STAGES, (held, deduped, kept, None, None), strict=True):
        before, docs = docs, stage(spark, docs, str(tmp_path))
        if want is not None:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == want and docs.count() == len(want)
        elif name == "mixing":
            times = Counter(r["doc_id"] for r in docs.collect())
            assert set(times) == set(kept) and set(times.values()) <= {1, 2}
        else:
            enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
            got = docs.collect()
            assert len(got) == before.count()
            for r in got:
                ids = enc.encode_ordinary(kept[r["doc_id"]])
                assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(kept[r["doc_id"]].encode()).hexdigest())


def test_mix_keeps_columns_of_any_name(spark):
    rows = [(i % 5 if i % 3 else None, f"w{i} x y", "a" if i % 4 else "b", i, i + 1, i + 2, i + 3) for i in range(900)]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, source string, __row long, row long, times long, `a.b` long")
    got = mixing.mix_documents(docs_, mixing.Target(repeats=2.0))
    assert got.columns == docs_.columns and {tuple(r) for r in got.collect()} == set(rows)
    plan, _ = mixing.plan(docs_.select(F.col("row").alias("row_key"), "doc_id", "source", "text"), mixing.Target(repeats=2.0))
    assert plan.count() == 900


def test_mix_spreads_rows_without_an_id(spark):
    docs_ = spark.range(3000).selectExpr("id AS row_key", "CAST(NULL AS LONG) AS doc_id", "'a' AS source", "'x y' AS text")
    sizes = [r["count"] for r in mixing.mixed(docs_, mixing.Target(repeats=2.0)).groupBy("block").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 400
