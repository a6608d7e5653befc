"""Ranked lexical search against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np

from quire.llm import lexical

DOCS = "doc_id long, text string, score string, rank int, n long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return Counter(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def plain(docs, items, k):
    known = [(i, c, sum(c.values())) for i, t in docs if (c := terms_of(t))]
    n, length = len(known), sum(x[2] for x in known)
    df = Counter(t for _, c, _ in known for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in known:
            m = 25 + 75 * size * n // length
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, r in terms_of(text).items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(repr, out))


def answers(spark, docs, items, k=10, **given):
    df = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in docs], DOCS).repartition(4)
    got = lexical.rank_documents(df, spark.createDataFrame(items, "item_id long, text string"), k, **given)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(repr(tuple(r)) for r in got.collect())


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(n)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 25)))) for i in range(20)]
    return docs, items


def test_ranking_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 4)
    monkeypatch.setattr(lexical, "SHARD", 100)
    docs, items = corpus(3, 600)
    docs += [(9000, None), (9001, ""), (9002, "... --"), (9003, "W1 w2 été " * 4000), (None, docs[7][1]), (None, items[0][1]), *[docs[11]] * 30, *[(9100 + i, items[1][1]) for i in range(200)]]
    items += [(50, None), (51, ""), (52, "nowhere"), (53, "w1 W1 w1"), (54, docs[3][1]), items[2], (None, "w5 w6"), (55, "ÉTÉ été")]
    want = plain(docs, items, 10)
    assert answers(spark, docs, items) == want
    assert answers(spark, docs, items, part=40) == want  # several passes
    assert answers(spark, docs, items, 3) == plain(docs, items, 3)


def test_empty_tables(spark):
    assert answers(spark, [], [(1, "a")]) == []
    assert answers(spark, [(1, "a b"), (2, None)], []) == []
    assert answers(spark, [(1, None), (2, "")], [(1, "a")]) == []
    assert answers(spark, [(1, "a b"), (2, "c")], [(1, "a")]) == plain([(1, "a b"), (2, "c")], [(1, "a")], 10)


def test_summaries_skip_most_documents(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 16)
    rng = np.random.default_rng(4)
    topics, vocabulary, n = 40, 2000, 4000
    rows, terms = [], []
    for i in range(n):  # each document has words of its topic and frequent ones
        own = np.unique(np.concatenate([200 + rng.integers(45, size=15) + 45 * (i % topics), rng.integers(200, size=6)]))
        rows.append(np.full(len(own), i))
        terms.append(own)
    row, term = np.concatenate(rows), np.concatenate(terms)
    value = rng.integers(300_000, 600_000, len(term))
    shard = lexical.Shard(np.arange(n), np.searchsorted(row, np.arange(n + 1)), term, value, vocabulary)
    df = np.bincount(term, minlength=vocabulary)
    weight = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    order = np.argsort(df, kind="stable")
    place = np.empty(vocabulary, np.int64)
    place[order] = np.arange(vocabulary)
    asked = [t[np.argsort(place[t])] for t in terms[:30]]
    queries = lexical.Queries(np.arange(30), list(range(30)), asked, [weight[t] for t in asked], order)
    best = shard.search(queries, np.zeros(30, np.int64), 10)
    matching = 0
    for q, (who, score) in enumerate(best):
        full = np.bincount(row, np.where(np.isin(term, asked[q]), weight[term] * value, 0), n).astype(np.int64)
        matching += int((full > 0).sum())
        want = np.lexsort((np.arange(n), -full))[:10]
        assert who.tolist() == want.tolist() and score.tolist() == full[want].tolist()
    assert shard.skipped > 0
    assert shard.scored < matching / 4
