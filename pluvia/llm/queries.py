"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm import bitplanes, bpe, html_text, importance, line_dedup, lm_score, mixing, ngram_join, quality, sharding, sketch, toxicity, turns
from pluvia.llm.common import table

#: In a mix no source is repeated more often than this against the least repeated one.
REPEATS = mixing.Target(repeats=2.0)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_key"), "doc_id", "source", "text")
    return mixing.mixed(docs, REPEATS).drop("row_key")


def op6_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.write_and_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketch.neighbour_sketches(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines and n_kept (lines with a word), text without the dropped lines."""
    found = line_dedup.deduplicated(table(spark, sf_dir, "documents"), graded=True)
    return found.select("doc_id", F.col("_lines.n").alias("n_lines"), F.col("_lines.kept").alias("n_kept"), F.col("_lines.text").alias("text"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repairs(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_toxicity, op3_lm_score, op4_quality_rules, op5_mixing, op6_token_planes, op7_fingerprints, op8_ngram_join, op9_sharding, op10_line_dedup, op11_html_text, op12_importance, op13_turn_repair)
}

_WORD = "[^\\x20\\x09-\\x0D]+"

_RULES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "shouts": ("n_shouts", "word_chars"), "capitals": ("n_capitals", "word_chars")}


def _quality_sql() -> str:
    level = f"({quality.DELTA} / ({len(quality.RULES)} * {len(quality.LADDER)} * (SELECT count(*) FROM totals)))"
    risk = quality.RISK / len(quality.RULES)
    shares = ", ".join(f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END AS {r}" for r, (a, b) in _RULES.items())
    long_ = " UNION ALL ".join(f"SELECT stratum, '{r}' AS rule, {r} AS share FROM good" for r in _RULES)
    ladder = ", ".join(f"({c})" for c in quality.LADDER)
    cuts = ", ".join(f"min(cut) FILTER (WHERE rule = '{r}') AS cut_{r}" for r in _RULES)
    over = " OR ".join(f"coalesce({r} > cut_{r}, false)" for r in _RULES)
    return f"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(lang, '(none)') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM t),
win AS (SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT k, i FROM win QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
cover AS (SELECT k, count(DISTINCT i + j) AS n FROM rep, (VALUES (0), (1), (2)) AS o(j) GROUP BY k),
c AS (SELECT w.k, doc_id, stratum, len(words)::BIGINT AS n_words, length(list_aggregate(words, 'string_agg', ''))::BIGINT AS chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(text, '!'))::BIGINT AS n_shouts, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_capitals,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cover ON w.k = cover.k),
m AS (SELECT *, coalesce(chars, 0) AS word_chars, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c),
s AS (SELECT *, {shares} FROM m),
good AS (SELECT s.* FROM s WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1)),
totals AS (SELECT stratum, count(*) AS n FROM good GROUP BY stratum),
long_ AS ({long_}),
tests AS (SELECT l.stratum, l.rule, v.cut, any_value(t.n) AS n, count(*) FILTER (WHERE l.share > v.cut) AS bad FROM long_ AS l JOIN totals AS t ON l.stratum = t.stratum, (VALUES {ladder}) AS v(cut) GROUP BY ALL),
passed AS (SELECT stratum, rule, cut FROM tests WHERE bad < n * {risk} AND list_sum(list_transform(range(0, bad + 1),
  lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk})))) <= {level}),
cuts AS (SELECT stratum, {cuts} FROM passed GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {over}) AS kept
FROM s LEFT JOIN cuts ON s.stratum = cuts.stratum"""


_MD5 = "('0x' || substr(md5({}), 1, 15))::BIGINT"


def _mixing_sql() -> str:
    block = _MD5.format("'block0|' || source || '|' || doc_id::VARCHAR")
    order = _MD5.format("'order0|' || source || '|' || epoch::VARCHAR || '|' || block::VARCHAR")
    row = _MD5.format("'row0|' || source || '|' || epoch::VARCHAR || '|' || doc_id::VARCHAR")
    # Only the ratio of the largest and smallest share decides: repeats(e) = (high / low)^(1 - e).
    return f"""
WITH RECURSIVE r AS (SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS n_tokens FROM documents),
t AS (SELECT source, sum(n_tokens)::DOUBLE AS tokens, count(*) AS n_docs FROM r GROUP BY source),
p AS (SELECT *, tokens / (SELECT sum(tokens) FROM t) AS share FROM t),
x AS (SELECT max(share) AS high, min(share) AS low FROM p WHERE share > 0),
b AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL
  SELECT i + 1, CASE WHEN pow(high / low, 1 - (lo + hi) / 2) <= {REPEATS.repeats} THEN lo ELSE (lo + hi) / 2 END,
  CASE WHEN pow(high / low, 1 - (lo + hi) / 2) <= {REPEATS.repeats} THEN (lo + hi) / 2 ELSE hi END FROM b, x WHERE i < 40),
e AS (SELECT CASE WHEN high / low <= {REPEATS.repeats} THEN 0.0 ELSE round(hi, {mixing.DECIMALS}) END AS e FROM b, x WHERE i = 40),
s AS (SELECT source, tokens, n_docs, CASE WHEN share > 0 THEN pow(share, e) ELSE 0 END AS raw, share, least({mixing.MAX_BLOCKS}, ceil(n_docs / {mixing.BLOCK_ROWS}))::INT AS blocks FROM p, e),
q AS (SELECT source, tokens, blocks, raw / (SELECT sum(raw) FROM s) AS weight, CASE WHEN share > 0 THEN round(raw / share / (SELECT min(raw / share) FROM s WHERE share > 0), 6) ELSE 1.0 END AS epochs FROM s),
k AS (SELECT r.*, tokens, weight, epochs, ({block} % blocks)::INT AS block FROM r JOIN q USING (source)),
n AS (SELECT source, block, sum(n_tokens) AS b, any_value(tokens) AS tokens, any_value(epochs) AS epochs FROM k GROUP BY source, block),
a AS (SELECT *, unnest(range(0, greatest(ceil(epochs)::INT, 1))) AS epoch FROM n),
o AS (SELECT source, block, epoch, tokens * epoch + sum(b) OVER (PARTITION BY source, epoch ORDER BY {order}, block) - b AS base FROM a),
f AS (SELECT k.*, o.epoch, base + sum(n_tokens) OVER (PARTITION BY source, o.epoch, k.block ORDER BY {row.replace("block::", "k.block::")}, doc_id) - n_tokens AS start FROM k JOIN o USING (source, block))
SELECT doc_id, source, n_tokens, weight, epoch::INT AS epoch, block, start::BIGINT AS start FROM f
WHERE epoch < floor(epochs) OR start < round(tokens * epochs)"""


_JOIN_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN array_to_string(words, ' ') ELSE words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] END AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g AS a JOIN g AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT i.a, i.b FROM i JOIN n AS x ON x.doc_id = i.a JOIN n AS y ON y.doc_id = i.b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
c AS (SELECT doc_id AS root, doc_id AS node FROM documents UNION SELECT c.root, l.b FROM c JOIN l ON c.node = l.a),
m AS (SELECT node, min(root) AS component_id FROM c GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM documents AS d LEFT JOIN n ON d.doc_id = n.doc_id JOIN m ON d.doc_id = m.node"""

#: The table of the CRC-32 polynomial, and the checksum of a list of bytes by it.
_CRC_TABLE = "SELECT list(v ORDER BY i) AS crc_table FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v FROM range(256) AS r(i))"


def _crc(text: str) -> str:
    raw = f"hex(encode({text}))"
    octets = f"list_transform(range(0, length({raw}) // 2), lambda i: ('0x' || substr({raw}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, crc_table[xor(c & 255, b) + 1])), 4294967295::BIGINT)"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _importance_sql() -> str:
    b, word = importance.BUCKETS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH crc AS ({_CRC_TABLE}),
w AS (SELECT row_number() OVER () AS k, 0 AS side, doc_id, regexp_extract_all({_LOWER}, '{word}') AS words FROM documents
  UNION ALL SELECT 0, 1, NULL, regexp_extract_all({_LOWER}, '{word}') FROM benchmark),
f AS (SELECT k, side, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM w),
n AS (SELECT k, side, feature, count(*) AS n FROM f GROUP BY ALL),
d AS (SELECT feature, ({_crc("feature")} % {b})::INT AS bucket FROM (SELECT DISTINCT feature FROM n), crc),
c AS (SELECT k, side, bucket, sum(n) AS n FROM n JOIN d USING (feature) GROUP BY ALL),
t AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0)::DOUBLE AS t FROM c GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM t) + {b}) / ((s + 1) * ((SELECT sum(t) FROM t) + {b})))) AS gain FROM t),
v AS (SELECT k, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n)) AS weight FROM c JOIN g USING (bucket) WHERE side = 0 GROUP BY k),
r AS (SELECT w.k, doc_id, len(words)::BIGINT AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  ('0x' || substr(sha256('{importance.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM w LEFT JOIN v ON w.k = v.k WHERE side = 0),
x AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT)::BIGINT AS score FROM r),
y AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, k) AS place, count(*) OVER () AS n FROM x WHERE n_words >= {importance.MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * {importance.PERCENT} // 100 THEN place END AS rank, n_words FROM x LEFT JOIN y ON x.k = y.k"""


def _turns_sql() -> str:
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    best = lambda *options: f"least({', '.join(options)})"
    after = lambda q, cost, letter: f"{{'c': {q}.c + {cost}, 'a': '{letter}' || {q}.a}}"
    never = "{'c': 1000000000::BIGINT, 'a': '~'}"
    # What is left to pay from each state: e before all, s after the system row, u and a after those.
    moved = {"e": [("s", "s"), ("u", "u")], "s": [("u", "u")], "u": [("a", "a")], "a": [("u", "u")]}

    def state(q: str) -> str:
        options = [after(q, 3, "D")]
        for role, to in moved[q]:
            options.append(f"CASE WHEN fault NOT IN (1, 2) AND initial = '{role}' THEN {after(to, '(fault = 3)::INT', 'K')} ELSE {never} END")
            if role != "s":
                options.append(f"CASE WHEN fault NOT IN (1, 2) THEN {after(to, '2 + (fault = 3)::INT', 'R')} ELSE {never} END")
        return best(*options)

    stepped = ", ".join(f"{state(q)} AS {q}" for q in moved)
    closed = lambda given: f"SELECT conv, j, {best('e', after('u', 2, 'I'))} AS e, {best('s', after('u', 2, 'I'))} AS s, u, a FROM (SELECT conv, j, e, s, {best('u', after('a', 2, 'I'))} AS u, {best('a', after('u', 2, 'I'))} AS a FROM ({given}))"
    zero = "{'c': 0::BIGINT, 'a': ''}"
    ending = closed(f"SELECT conv, 0 AS j, {zero} AS e, {never} AS s, {never} AS u, {zero} AS a FROM heads")
    going = closed(f"SELECT p.conv, r.j, {stepped} FROM p JOIN r ON r.conv = p.conv AND r.j = p.j + 1")
    return f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
heads AS (SELECT row_number() OVER () AS conv, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
d AS (SELECT conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations AS c JOIN heads AS h ON c.conv_id IS NOT DISTINCT FROM h.conv_id, crc),
o AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE kind <> 0),
b AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) AS again,
  right(rtrim(text, {space}), 1) AS ending FROM o),
r AS MATERIALIZED (SELECT conv, turn, role, text, i, count(*) OVER (PARTITION BY conv) + 1 - i AS j, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS before,
  CASE WHEN ending = '' THEN 1 WHEN again > 1 THEN 2 WHEN ending NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM b),
p AS ({ending} UNION ALL {going}),
s AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
  count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv),
a AS (SELECT conv, arg_max(e.c, j) AS cost, arg_max(e.a, j) AS audit FROM p GROUP BY conv),
l AS (SELECT conv, audit, k, substr(audit, k, 1) AS letter, count(*) FILTER (WHERE letter <> 'I') OVER w AS i, count(*) FILTER (WHERE letter <> 'D') OVER w AS place,
  count(*) FILTER (WHERE letter <> 'D') OVER (PARTITION BY conv) AS size FROM (SELECT conv, audit, unnest(range(1, length(audit) + 1)) AS k FROM a) WINDOW w AS (PARTITION BY conv ORDER BY k)),
t AS (SELECT l.conv, string_agg(CASE WHEN letter = 'K' THEN role ELSE CASE WHEN (place - size) % 2 = 0 THEN 'assistant' ELSE 'user' END END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS whole
  FROM l LEFT JOIN r ON r.conv = l.conv AND r.i = l.i WHERE letter <> 'D' GROUP BY l.conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM heads AS h JOIN a ON a.conv = h.conv LEFT JOIN s ON s.conv = h.conv LEFT JOIN t ON t.conv = h.conv"""


ORACLES: dict[str, str] = {"op4_quality_rules": _quality_sql(), "op5_mixing": _mixing_sql(), "op8_ngram_join": _JOIN_SQL, "op12_importance": _importance_sql(), "op13_turn_repair": _turns_sql()}
