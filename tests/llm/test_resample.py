"""Importance resampling against zlib and a plain draw."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import resample
from quire.llm.text import utf8

DOCS = "doc_id long, text string, weight string, rank int, bucket long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs_of(text, low, high):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, percent, least, low, high, buckets):
    bucket = lambda run: zlib.crc32(run.encode()) % buckets
    s = Counter(bucket(r) for _, text in docs for r in runs_of(text, low, high))
    t = Counter(bucket(r) for text in target for r in runs_of(text, low, high))
    S, T = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * S / ((s[b] + 1) * T)))
    rows = []
    for doc_id, text in docs:
        runs = runs_of(text, low, high)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(r)) for r in runs)
        rows.append([doc_id, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text)) >= least])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = rank
    return sorted(map(repr, (tuple(r[:5]) for r in rows)))


@pytest.mark.parametrize("step", [7, 64, 1 << 18])
def test_run_crcs_are_zlibs(monkeypatch, step):
    monkeypatch.setattr(resample, "STEP", step)
    rng = random.Random(1)
    texts = ["", "Ab c", "x" * 1000, "é Ü-a 1", " lead", "trail ", "日本語 text", "a\x00b", *("".join(rng.choice("abCD  -é1") for _ in range(rng.randrange(400))) for _ in range(60))]
    edges = resample.word_edges(*utf8(pa.array(texts)))
    for n in (1, 2, 4):
        crc, lo, hi = resample.run_crcs(edges, n)
        for i, text in enumerate(texts):
            assert crc[lo[i] : hi[i]].tolist() == [zlib.crc32(r.encode()) for r in runs_of(text, n, n)]


def test_shift_appends_zero_bytes():
    n = np.array([0, 1, 2, 63, 64, 1000, 123_456])
    got = resample.shift(np.full(len(n), 0x12345678, np.uint32), n)
    for k, value in zip(n.tolist(), got.tolist(), strict=True):
        # zlib's register after k zero bytes; it is inverted before and after
        assert value == zlib.crc32(bytes(k), 0x12345678 ^ 0xFFFFFFFF) ^ 0xFFFFFFFF


@pytest.mark.parametrize(("low", "high", "buckets"), [(1, 1, 10_000), (1, 3, 97), (2, 2, 10_000)])
def test_draw_equals_brute_force(spark, low, high, buckets):
    rng = random.Random(7)
    some = [f"w{i} Wort-{i % 7} été{i % 5}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(some) for _ in range(rng.randrange(30)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "A" * 200_000), (203, "--- .. "), (None, docs[5][1] + " more words"), (None, docs[5][1]), *[docs[9]] * 60, (204, "the same text " * 20), (205, "the same text " * 20)]
    target = [(1, "w3 w4 été1"), (2, None), (3, ""), (None, "w3 Wort")]
    df = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in docs], DOCS).repartition(3)
    bench = spark.createDataFrame(target, "item_id long, text string")
    got = resample.resample(df, bench, 10, 20, low, high, buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain(docs, [t for _, t in target], 10, 20, low, high, buckets)


def test_empty_tables_draw_nothing(spark):
    none, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(none, bench).collect() == []
    docs = [(1, "a b " * 30), (2, "c")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS)
    assert sorted(repr(tuple(r)) for r in resample.resample(df, bench, 100).collect()) == plain(docs, [], 100, 20, 1, 1, 10_000)


def test_ranks_over_partitions_are_one_to_n(spark):
    df = spark.range(5000).selectExpr("id % 3 as score", "id").repartition(7)
    got = [r for r in resample.ranked(df, [df.score.desc()]).orderBy("rank").collect()]
    assert [r["rank"] for r in got] == list(range(1, 5001))
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)
