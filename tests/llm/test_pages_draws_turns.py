"""HTML text, importance resampling and repair of turns against plain versions, and on odd input."""

import hashlib
import heapq
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from pluvia.llm import html_text, importance, queries, turns
from pluvia.llm.html_labels import PAGES

LONG = "the ferry went over the lake twice a day in summer and once a week in winter, when the ice let it pass at all"


def wrap(main, before="", after=""):
    return f"<html><head><title>T</title><style>p{{}}</style><script>var x = '</p>';</script></head><body>{before}{main}{after}</body></html>"


def test_labelled_pages_come_out_as_labelled():
    right = total = 0
    for page in PAGES:
        kept = html_text.main_text(page).split("\n")
        for b in html_text.blocks(page):
            total += 1
            right += (b.text in kept) == b.text.startswith("+")
    assert right >= 0.98 * total


def test_html_leaves_out_what_surrounds_an_article():
    body = f"<article><h1>Ferry</h1><p>Short.</p><p>{LONG}.</p></article>"
    want = f"Ferry\nShort.\n{LONG}."
    around = [
        "<nav><ul><li><a href=/a>Home</a></li></ul></nav>",
        "<header><h2>Lake news</h2></header>",
        f"<aside><p>{LONG}</p></aside>",
        f"<div class='cookie-banner'>{LONG} {LONG}</div>",
        f"<div id=sidebar><p>{LONG}</p></div>",
        f"<section class=comments><article class=comment><p>{LONG}, I think.</p></article></section>",
        f"<form><label>Name</label><input><p>{LONG}</p></form>",
        f"<div class=ad>{LONG}</div>",
        "<footer>&copy; Lake news</footer>",
        f"<div style='display: none'>{LONG}</div>",
        f"<noscript>{LONG}</noscript>",
        "<!-- <p>no</p> -->",
        "<svg><title>x</title><text>y</text></svg>",
        "<select><option>one<option>two</select>",
    ]
    for part in around:
        assert html_text.main_text(wrap(body, part)) == want, part
        assert html_text.main_text(wrap(body, "", part)) == want, part
    assert html_text.main_text(wrap(body, "".join(around), "".join(around))) == want
    inner = f"<main><p>{LONG}.</p><div class='post-ads'>Buy now</div><p>Then <b>it</b> sank &amp; rose&nbsp;again &#x263A;&eacute;.</p><ul class=share><li>Tell others</li></ul></main>"
    assert html_text.main_text(wrap(inner)) == f"{LONG}.\nThen it sank & rose again ☺é."


def test_html_works_without_article_elements():
    page = wrap(f"<div class='post-content'><h1>Ferry</h1><p>{LONG}.</p></div>", "<div class=topbar>Lake</div>", "<div id=footer>End</div>")
    assert html_text.main_text(page) == f"Ferry\n{LONG}."
    page = wrap(f"<h1>Ferry</h1><p>{LONG}.<p>{LONG}!", "<ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul>")
    assert html_text.main_text(page) == f"Ferry\n{LONG}.\n{LONG}!"


def test_html_takes_odd_pages_in_linear_time(spark):
    odd = [None, "", " ", "<", "<p", "<p>", "</", "<!--", "<script>x", "<a href='x", "a < b", "&", "&amp", "<div class=it's>x", "x" * 100_000, "<p>" * 30_000, "<a x='" * 30_000, "<div>" * 30_000 + "</nav>" * 30_000, "<" * 60_000, "<!-- " * 30_000, "<p " * 30_000, "<p ='" * 30_000, "<li><ul>" * 20_000]
    began = time.time()
    for page in odd:
        html_text.main_text(page)
    assert time.time() - began < 20
    rows = [(i, None if i % 5 == 0 else f"u{i}", page, "clash") for i, page in enumerate(odd)] + [(None, "u", f"<article>{LONG}</article>", "x")] * 2
    got = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got) == Counter((i, u, html_text.main_text(h), len(html_text.main_text(h))) for i, u, h, _ in rows)
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_every_block_of_the_tables_articles_is_kept(spark):
    """The tables' pages have one article each: what is cut by hand from its tags must come out."""
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_text.extracted(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        cut = [" ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(b for b in cut if b)


def plain_draw(docs, target):
    def features(text):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
        return len(w), [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in itertools.pairwise(w)]]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    ss, tt = sum(s.values()), sum(t.values())
    rows = []
    for k, (i, text) in enumerate(docs):
        n, f = features(text)
        gain = sum(math.floor(1000 * math.log((t[b] + 1) * (ss + 10_000) / ((s[b] + 1) * (tt + 10_000)))) for b in f)
        weight = gain // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n, k])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for place, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = place
    return [tuple(r[:6]) for r in rows]


def test_importance_equals_the_plain_draw(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(importance, "PART", 1000)  # long texts are cut many times
    target = [rows[20][1], None, "", "w1 w2 W3 w4-w5"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = [tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank", "n_words")) for r in importance.resampled(docs, bench).collect()]
    want = plain_draw([(r[0], r[1]) for r in rows], target)
    # Of rows with equal score and id any may come first.
    assert Counter(r[:4] + r[5:] for r in got) == Counter(r[:4] + r[5:] for r in want)
    assert sorted((r[4], r[0], r[3]) for r in got if r[4]) == sorted((r[4], r[0], r[3]) for r in want if r[4])
    assert importance.resampled(empty, bench).count() == 0
    assert importance.resampled(docs, bench.limit(0)).count() == len(rows)


def test_importance_ranks_one_hot_id(spark):
    docs = spark.range(20_000).selectExpr("1L AS doc_id", "concat(repeat('a b ', 15), id) AS text").repartition(4)
    got = importance.resampled(docs, docs.limit(1)).where("rank IS NOT NULL").toPandas()
    assert sorted(got["rank"]) == list(range(1, 5001)) and got.sort_values("rank")["score"].is_monotonic_decreasing


def plain_repair(rows):
    """Cheapest (cost, audit, lines) by Dijkstra over (rows read, state), an independent search."""
    moves = {("e", "s"): "s", ("e", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "e", ())], {}
    best = None
    while heap:
        cost, audit, i, q, lines = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if i == len(rows) and q in "ea" and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, lines)
        if done.setdefault((i, q), cost) < cost or cost > 60:
            continue
        for r in "ua":
            if (q, r) in moves:
                heapq.heappush(heap, (cost + 2, audit + "I", i, moves[q, r], (*lines, f"{names[r]}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q, lines))
            if fault not in (1, 2):
                more = int(fault == 3)
                if (q, role[:1]) in moves:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, moves[q, role[:1]], (*lines, f"{role}:{text}")))
                for r in "ua":
                    if (q, r) in moves:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, moves[q, r], (*lines, f"{names[r]}:{text}")))
    return best


def conversation_rows(seed, n=60):
    rng, out = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randrange(0, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", "user", "tool", "", None, "usher"])
            text = rng.choice(["Hi.", "Well", "So? ", "é!\n", "", " \t", None, f"Text {rng.randrange(4)}.", "a.b"])
            out.append((c if rng.random() < 0.97 else None, None if rng.random() < 0.05 else t - (t > 5), role, text))
    return out


def plain_turns(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        found[conv] += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, given in found.items():
        given.sort()
        seen, marked = set(), []
        for _, _, role, text in given:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            marked.append((role, text, 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0))
            seen.add((role, text))
        t = [turn for known, turn, _, _ in given if known]
        cost, audit, lines = plain_repair(marked)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(given))
        counts = Counter(m[2] for m in marked)
        out.append((conv, max(t) - min(t) + 1 - len(set(t)) if t else 0, counts[1], counts[2], counts[3], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return Counter(out)


COLUMNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", range(4))
def test_turns_equal_the_plain_search_and_sql(spark, seed):
    rows = conversation_rows(seed)
    given = spark.createDataFrame([(*r, "clash", 1) for r in rows], COLUMNS + ", fault string, again int").repartition(3)
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = Counter(tuple(r[c] for c in names) for r in turns.repairs(given).collect())
    assert got == plain_turns(rows)
    import pandas as pd

    db = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    db.register("conversations", frame)
    want = db.sql(queries.ORACLES["op13_turn_repair"])
    at = [want.columns.index(c) for c in names]
    assert got == Counter(tuple(r[i] for i in at) for r in want.fetchall())


def test_turns_take_long_and_empty_conversations(spark):
    assert turns.repairs(spark.createDataFrame([], COLUMNS)).count() == 0
    n = 20_000
    long = spark.range(n).selectExpr("7L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('Line ', id, '.') AS text")
    got = turns.repairs(long).collect()
    assert len(got) == 1 and sum(c != "I" for c in got[0]["audit"]) == sum({0: 0, 3: 2}.get(zlib.crc32(f"7:{t}".encode()) % 20, 1) for t in range(n))
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    only = turns.repairs(spark.createDataFrame([(1, gone, "user", "Hi.")], COLUMNS)).collect()
    assert tuple(only[0])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
