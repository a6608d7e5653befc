"""The pipeline's stages one by one, each against a brute-force version over its own input."""

from __future__ import annotations

import zlib

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from quire.llm import quality, toxicity
from quire.llm.packing import CAPACITY
from tests.llm.test_operators import WORD_BPE, brute_groups, brute_quality, brute_toxicity, brute_windows, labelled


def rows_of(df):
    return sorted((r.doc_id, r.text or "") for r in df.collect())


def brute_contaminated(text, items):
    w, hit = brute_windows(text), set()
    for x in items:
        v = brute_windows(x)
        n = min(13, len(v))
        for a in range(len(w) - n + 1) if n else ():
            if any(w[a : a + n] == v[b : b + n] for b in range(len(v) - n + 1)):
                hit.update(range(a, a + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_stages_equal_brute_force(spark, tmp_path):
    docs, labels = labelled(spark, 300)
    copies = docs.where("doc_id in (1, 2, 3)").withColumn("doc_id", docs.doc_id + 5000)
    docs = docs.union(copies).withColumn("doc_id", docs.doc_id)
    bench = docs.where("doc_id = 7").selectExpr("cast(1 as long) as item_id", "text")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    d = str(tmp_path)
    now, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, d).write.parquet(f"{d}/{len(kept)}")
        out = spark.read.parquet(f"{d}/{len(kept)}")
        kept[name] = (now, out)
        if name != "best-fit packing":
            assert out.columns == docs.columns
        now = out
    before, after = kept["quality classifier"]
    voters = quality.fit(before, labels)
    assert rows_of(after) == [r for r in rows_of(before) if brute_quality(voters, r[1]) >= 0.3]
    before, after = kept["toxicity"]
    net = toxicity.fit(before, labels)
    assert rows_of(after) == [r for r in rows_of(before) if brute_toxicity(net, r[1]) < 0.5]
    before, after = kept["n-gram Jaccard join"]
    first = {i for i, _, c in brute_groups(rows_of(before)) if i == c}
    assert rows_of(after) == [r for r in rows_of(before) if r[0] in first]
    assert not {5001, 5002, 5003} & {i for i, _ in rows_of(after)}
    before, after = kept["benchmark decontamination"]
    items = [r.text for r in bench.collect()]
    assert rows_of(after) == [r for r in rows_of(before) if not brute_contaminated(r[1], items)]
    assert 7 not in {i for i, _ in rows_of(after)} and 7 in {i for i, _ in rows_of(before)}
    before, after = kept["best-fit packing"]
    library, want = Tokenizer.from_file(WORD_BPE), []
    for i, text in rows_of(before):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, k * CAPACITY, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(ids[a : a + CAPACITY] for a in range(0, len(ids), CAPACITY))]
    placed = after.collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed) == sorted(want)
    ends = {}
    for r in sorted(placed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= CAPACITY
    assert corpus_pipeline.run(spark, d).count() == len(placed)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "", "x", "y", 0), (None, None, None, None, None), (1, None, None, None, None)]])
def test_stages_take_empty_tables_and_nulls(spark, tmp_path, rows):
    docs, labels = labelled(spark, 10)
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(rows)
