"""Each operator against brute force on small tables with the awkward cases."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import chat, decontam, jaccard, packing, quality, queries, tokencount, topk, toxicity, urlfilter, warc

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, length string, sequence_id int"
HARD = [
    "", " ", "a", "don't 's' 'S''re've\"'ll'x 'r 're' 'l' 'lll'", "it''s", "日本語テキスト１２３ ½²", "é́ é ΣΑΣ İstanbul", "'", "a'", "1234 5'6", "👍🏽 ok👍",
    " x　y z", "<|endoftext|> a<|startoftext|>b", "x" * 3000 + " " + "ab" * 900, "\x1c\x1d a\x00b", "!!!'s ?'re", "ſ K ß ẞ", "한국어", "word " * 5000,
]


def docs_of(spark, texts, repeat=True):
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)] + [(len(texts), None, None, None)]
    return spark.createDataFrame(rows + rows[:1] * repeat, DOCS).repartition(3)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


def test_token_counts_are_the_librarys(spark, library):
    got = sorted(map(tuple, tokencount.count_tokens(docs_of(spark, HARD), WORD_BPE).collect()))
    want = [(i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 2048) for i, t in enumerate(HARD)]
    assert got == sorted([*want, (len(HARD), 0, 0, False), want[0]])
    assert tokencount.count_tokens(spark.createDataFrame([], DOCS), WORD_BPE).collect() == []


def test_chunks_without_white_space_are_bridged(library):
    t = tokencount.transducer(WORD_BPE)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdeth'.1 ") if rng.random() < p else rng.choice("the") for _ in range(rng.randrange(2000))) for p in (0, 0.05, 0.5, 1) for _ in range(20)]
    assert t.count(texts).tolist() == [len(library.encode(x, add_special_tokens=False).ids) for x in texts]


def test_unspaced_texts_are_counted_by_composed_chunk_maps(library, monkeypatch):
    monkeypatch.setattr(tokencount, "MAX_STATES", 3000)
    monkeypatch.setattr(tokencount, "GROUP", 4096)
    t = tokencount.Transducer(WORD_BPE)
    rng = random.Random(4)
    vocabulary = [w.removesuffix("</w>") for w in t.merges.vocab if w.isascii() and w.removesuffix("</w>").isalpha()]
    texts = ["".join(rng.choice(vocabulary) for _ in range(3000)).lower(), "x" * 100_000, "ab" * 3000 + "日本語" * 500, "", "a", "the" * 5000 + " " + "1" * 300]
    assert t.count(texts).tolist() == [len(library.encode(x, add_special_tokens=False).ids) for x in texts]
    cols = t.symbols(np.frombuffer(b"abc" * 400 + b" ", np.uint8).astype(np.uint32), np.frombuffer(b"abc" * 400 + b" ", np.uint8))
    begin = np.arange(0, 1201, 256)
    size = np.minimum(begin + 256, 1201) - begin
    each, last = t.scan(cols, begin, size, begin == 0, 0)
    state, want = np.zeros(1, np.int32), []
    for b, n in zip(begin, size, strict=True):  # one lane from chunk to chunk
        state, tokens = t.run(cols, np.array([b]), np.array([n]), state)
        want.append(int(tokens[0]))
    assert each.tolist() == want and last == state[0] == 0


def test_a_megabyte_without_white_space(spark, library):
    text = "thequickbrownfox" * 65_536
    df = spark.createDataFrame([(1, text), (2, "x" * 1_000_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(df, WORD_BPE).collect()}
    assert got[1] == len(library.encode(text, add_special_tokens=False).ids)
    assert got[2] == 250_000


def test_packing_keeps_every_token(spark, library):
    df = docs_of(spark, HARD)
    packed = packing.pack_documents(df, WORD_BPE, keep_ids=True)
    rows = packed.collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        assert r.length == len(r.ids) <= 2048
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc.setdefault(r.doc_id, {}).setdefault(r.piece, r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in enumerate([*HARD, ""]):
        pieces = [by_doc[i][p] for p in sorted(by_doc[i])]
        assert [x for r in pieces for x in r.ids] == [*library.encode(text, add_special_tokens=False).ids, 0]
        assert [r.start for r in pieces] == [2048 * p for p in range(len(pieces))]
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len([r for r in rows if r.doc_id == 0]) == 2
    joined = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in joined) == sum(r.length for r in rows)
    assert packing.pack_documents(spark.createDataFrame([], DOCS), WORD_BPE).collect() == []


def test_best_fit_closes_the_fullest_when_bins_run_out():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 4, 8, 3, 2)] == [(0, 0), (1, 0), (0, 6), (2, 0), (1, 7), (2, 8)]
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 8, 4, 3)] == [(0, 0), (1, 0), (2, 0), (0, 6), (3, 0)]


def test_open_bins_are_bounded_and_cost_little(spark):
    rng = np.random.default_rng(3)
    lengths = np.minimum(2048, 1 + rng.exponential(500, 6000).astype(int)).tolist()
    fit = packing.BestFit(2048, packing.OPEN_BINS)
    used, most = {}, 0
    for n in lengths:
        b, at = fit.place(n)
        assert at == used.get(b, 0)
        used[b] = at + n
        most = max(most, fit.open)
    assert max(used.values()) <= 2048 and most <= packing.OPEN_BINS
    assert len(used) <= 1.02 * -(-sum(lengths) // 2048)
    same = spark.range(3000).selectExpr("1L as doc_id", "0 as piece", "0L as start", "600L as length", "7L as ids_crc32")
    rows = packing.pack(same, 2048, 8).collect()
    assert len(rows) == 3000 and len({(r.sequence_id, r.offset) for r in rows}) == 3000 and len({r.sequence_id for r in rows}) == 1000


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [[float(x) for x in rng.normal(size=8) * s] for s in (0.1, 1, 3) for _ in range(60)]
    rows = [(i, v, 1) for i, v in enumerate(base)] + [(500 + i, base[7], 1) for i in range(30)] + [(600, None, 1), (601, [1.0, None], 1), (602, [float("nan")] * 8, 1), (603, [float("inf")] * 8, 1), (604, [0.0] * 8, 1), (700, [0.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    v = topk.integer_vectors(df)
    got = {}
    for r in topk.top_k(v, v.where("id % 10 = 0"), 10).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    ints = {r.id: np.array(r.v, np.int64) for r in v.collect()}
    assert set(got) == {i for i in ints if i % 10 == 0}
    for q, ranks in got.items():
        want = sorted((-int(ints[q] @ x), i) for i, x in ints.items() if i != q)[:10]
        assert [ranks[k] for k in range(1, 11)] == [(i, -s) for s, i in want]
    assert topk.top_k(v.where("id < 0"), v.where("id < 0")).collect() == []
    few = v.where("id < 3")
    assert topk.top_k(few, few.where("id = 0")).count() == 2
    again = topk.top_k(few.union(few.where("id = 1")), few.where("id = 0").union(few.where("id = 0"))).collect()
    assert sorted((r.query_id, r["rank"]) for r in again) == [(0, 1), (0, 1), (0, 2), (0, 2), (0, 3), (0, 3)]  # repeated rows all count, repeated queries all get theirs


def test_top_k_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6) * rng.exponential()]) for i in range(400)]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    ints = {r.id: np.array(r.v, np.int64) for r in v.collect()}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(v, v.where("id % 20 = 0"), 5).collect()}
    for q in range(0, 400, 20):
        want = sorted((-int(ints[q] @ x), i) for i, x in ints.items() if i != q)[:5]
        assert [got[q, k] for k in range(1, 6)] == [(i, -s) for s, i in want]


def test_chat_round_trip(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    control = "<|im_end|><|im_start|>assistant ok"
    turns = [
        (-1, 0, "user", control), (-1, 1, "assistant", control), (1, 0, "system", ""), (1, 1, None, None), (1, 2, "assistant", "<\\|im_end|> <\\\\| <| \n\n"), (1, 3, "assistant", "x" * 20000),
        (2, 5, "a\nb\\n<|", "日本 👍 é"), (2, 5, "a\nb\\n<|", "日本 👍 é"), (2, 1, "assistant", "late\r\n"), (None, 0, "user", "q"),
    ]
    df = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn long, role string, text string, ids int").repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df, path, pattern), path, pattern).collect()}
    assert set(got) == {-1, 1, 2, None}
    for conv, r in got.items():
        own = sorted((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv)
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(df.limit(0), path, pattern), path, pattern).collect() == []


def test_batches_of_very_long_turns_are_cut_by_bytes(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(["x" * (700_000 if i % 100 == 0 else 5) for i in range(600)])], ["i", "t"])
    parts = list(chat.cut_by_size(batch))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(600))
    assert all(p.num_rows == 1 or p.nbytes <= chat.BYTES and p.num_rows <= chat.ROWS for p in parts)
    df = spark.range(8).selectExpr("id div 4 as conv_id", "id % 4 as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "repeat('long words <|im_end|> ', 40000) as text").coalesce(1)
    for r in chat.read_back(chat.format_turns(df, path, pattern), path, pattern).collect():
        assert (r.n_turns, r.loss_chars) == (4, 2 * 22 * 40000)


@pytest.mark.parametrize("text", ["<|", "<\\|", "<\\\\|a<|b", "|<", "<\\", "<<||", chat.WRITTEN[chat.END]])
def test_escaping_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)


def test_warc_round_trip(spark):
    pages = [(5, "http://a/ü b%", "same"), (3, None, "same"), (9, "u", "same"), (4, "x\r\ny", None), (1, "v", ""), (7, "w", "ü" * 100000), (8, "w", "line\r\n\r\nline"), (3, "again", "same"), (3, "other", "else")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, refers_to string").repartition(3)
    got = sorted((tuple(r) for r in warc.archive_and_read(spark, df).collect()), key=str)
    first = {}
    for i, _, h in pages:
        first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, u, h in pages:
        data = (h or "").encode()
        own = first[h or ""]
        want.append((i, u, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own == i else "revisit", None if own == i else own))
    assert got == sorted(want, key=str)
    assert all(r.record_type == "response" for r in warc.archive_and_read(spark, df, least=10).where("payload_bytes < 10").collect())
    assert warc.archive_and_read(spark, df.limit(0)).collect() == []
    long = spark.range(6).selectExpr("id as page_id", "'u' as url", "repeat('abcdefg ', 200000 + cast(id % 2 as int)) as html").coalesce(1)
    assert sorted((r.page_id, r.payload_bytes, r.refers_to) for r in warc.archive_and_read(spark, long).collect()) == [(i, 8 * (200000 + i % 2), i % 2 if i > 1 else None) for i in range(6)]


def test_zip64_directory_is_read(tmp_path):
    files, path = warc.filesystem(str(tmp_path))
    p = warc.Package(files, f"{path}/p.wacz")
    for i in range(3):
        p.add(i, "u", b"x" * i, None)
    name, rows, _ = p.close()
    assert rows == 3
    import zipfile

    zipfile.ZIP_FILECOUNT_LIMIT, before = 1, zipfile.ZIP_FILECOUNT_LIMIT  # forces a ZIP64 end record
    try:
        with zipfile.ZipFile(f"{path}/q.wacz", "w") as z, zipfile.ZipFile(name) as old:
            for n in (warc.ARCHIVE, warc.INDEX):
                z.writestr(n, old.read(n))
    finally:
        zipfile.ZIP_FILECOUNT_LIMIT = before
    for f in ("p.wacz", "q.wacz"):
        with files.open_input_file(f"{path}/{f}") as source:
            assert [warc.parse(r)["length"] for r in warc.records(source)] == [0, 1, 2]


def brute_windows(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.mark.parametrize("part", [2_000_000, 7])
def test_decontamination_equals_brute_force(spark, part):
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "Beta", "é9", "x", "y", "日本"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 2, 5, 12, 13, 14, 40, 60])] + [(50, None), (51, "ﬁ Solo!"), (52, "x x x x x x x x x x x x x x x")]
    items = [(i, t) for i, t in items if i not in (1, 2)] + [(60, "zebra"), (None, "gamma delta")]
    texts = ["", "zebra", "x " * 50, "nothing here", "one gamma delta two"]
    for _ in range(25):
        parts = [word() for _ in range(rng.randrange(30))]
        own = (rng.choice(items)[1] or "").split()
        a = rng.randrange(len(own) + 1)
        texts.append(rng.choice([" ", "\n", " - "]).join(parts + own[a : a + rng.randrange(60)] + [word() for _ in range(rng.randrange(30))]))
    docs = docs_of(spark, texts)
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, n_hit int")
    got = sorted(map(tuple, decontam.counts(decontam.contamination(docs, bench, part=part)).collect()))
    want = []
    for d, t in [*enumerate(texts), (len(texts), None), (0, texts[0])]:
        w, hit, seen = brute_windows(t), set(), set()
        for i, x in items:
            v = brute_windows(x)
            n = min(13, len(v))
            runs = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if n else set()
            for a in range(len(w) - n + 1) if n else ():
                if tuple(w[a : a + n]) in runs:
                    seen |= {str(i)} - {"None"}
                    hit.update(range(a, a + n))
        want.append((d, len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    assert got == sorted(want)
    kept = sorted(r.doc_id for r in decontam.clean(docs, bench, part=part).collect())
    assert kept == sorted(x[0] for x in want if not x[5])
    twice = spark.createDataFrame([(1, "zebra"), (1, "nothing here"), (None, "zebra"), (None, "else")], "doc_id long, text string")
    assert sorted(r.text for r in decontam.clean(twice, bench, part=part).collect()) == ["else", "nothing here"]
    assert decontam.contamination(docs.limit(0), bench).collect() == []
    assert decontam.counts(decontam.contamination(docs, bench.limit(0))).where("n_hit > 0").count() == 0


def test_winnowing_finds_every_long_shared_span():
    rng = np.random.default_rng(4)
    for _ in range(50):
        shared = rng.integers(0, 5, 13).astype(np.uint64)
        marks = []
        for _ in range(2):
            h = np.concatenate([rng.integers(0, 5, 30).astype(np.uint64), shared, rng.integers(0, 5, 30).astype(np.uint64)])
            g = decontam.grams(h, 5)
            marks.append(set(g[decontam.lowest(g, 9)].tolist()))
        assert marks[0] & marks[1]


def brute_groups(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(d, best.get(find(i), d))
    return sorted((d, len(sets[i]), best[find(i)]) for i, (d, _) in enumerate(rows))


def test_similar_groups_equal_brute_force(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") + rng.choice("xyz")
    shared = [word() for _ in range(60)]
    texts = ["", "  ", "one two", "ONE\ttwo", "one two three", "a b c d e", "A b c d e"]
    for family in range(12):
        base = [word() for _ in range(rng.choice([8, 30, 120]))] + (shared if family % 2 else [])
        for _ in range(rng.randrange(1, 12)):
            t = list(base)
            for _ in range(rng.randrange(0, max(2, len(t) // 25))):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    chain = [word() for _ in range(100)]
    for i in range(12):  # neighbours are similar, the ends are not
        texts.append(" ".join(chain[5 * i : 5 * i + 80] + [word() for _ in range(0)]))
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, component_id string").repartition(4)
    assert sorted(map(tuple, jaccard.similar_groups(df).collect())) == brute_groups(rows)
    assert sorted(r.doc_id for r in jaccard.one_of_each(df).collect()) == sorted(d for d, _, c in brute_groups(rows) if d == c)
    twice = df.union(df.limit(3))
    assert jaccard.similar_groups(twice).count() == len(rows) + 3
    assert jaccard.similar_groups(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect() == [(1, 0, 1), (2, 0, 2)]
    assert jaccard.similar_groups(df.limit(0)).collect() == []
    # Rows without doc_id take the component of an equal set; two texts of one doc_id share its links.
    a, b = " ".join(chain[:50]), " ".join(f"q{w}" for w in chain[:50])
    odd = [(4, a), (9, a), (9, b), (12, b), (None, a), (None, "all alone here"), (15, None)]
    got = jaccard.similar_groups(spark.createDataFrame(odd, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(4, 4), (9, 4), (9, 4), (12, 4), (None, 4), (None, None), (15, 15)], key=str)


def test_one_of_each_decides_by_id_and_text(spark):
    words = [f"w{i}" for i in range(40)]
    a, near = " ".join(words), " ".join([*words[:-1], "x"])
    b, c, d = (" ".join(f"{p}{i}" for i in range(40)) for p in "bcd")
    rows = [(1, a), (5, a), (5, b), (5, near), (6, c), (6, c), (7, b), (None, near), (None, c), (None, d), (None, d), (None, d + " end"), (None, ""), (None, ""), (None, None), (9, "")]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    out = jaccard.one_of_each(df)
    assert out.columns == df.columns
    got = sorted((str(r.doc_id), str(r.text)) for r in out.collect())
    alone = [r for r in got if not r[1].startswith("d0")]
    assert alone == sorted([("1", a), ("5", b), ("6", c), ("6", c), ("None", ""), ("None", ""), ("None", "None"), ("9", "")])
    assert len(got) == len(alone) + 1  # one of the two copies and the near copy without ids


def test_prefixes_share_a_token_in_every_order():
    rng = np.random.default_rng(8)
    hot = np.sort(rng.integers(0, 2**63, 40).astype(np.uint64))
    for _ in range(200):
        both = np.unique(np.concatenate([hot[:20], rng.integers(0, 2**63, rng.integers(1, 200)).astype(np.uint64)]))
        cut = max(1, len(both) // 9)
        s, t = both[cut:], both[:-cut]
        if not len(s) or not jaccard.similar(s, t):
            continue
        for order in range(jaccard.ORDERS):
            for frequent in ((hot, np.arange(1, 41)), (hot[:0], hot[:0].astype(np.int64))):
                assert np.isin(jaccard.leading(s, order, frequent), jaccard.leading(t, order, frequent)).any()


URLS = [
    None, "", "no scheme", "http://COM/en/x", "http://www.example.com/en/7", "http://example.com/en/70?q", "http://example.com/en/", "https://xcom/en/", "http://a.b.net/de/8", "http://example.net/de/8#f",
    "http://x.example.net/de/", "org://org/es/", "http://.org/es/", "http://org?/es/", "http://user@example.com:80/en/7", "http://com", "a://b://c.com/en/\nx", "http://org/es/é",
]


def test_url_rules_equal_brute_force(spark, monkeypatch):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    more = [f"http://h{i}.example.{t}/{p}/{i}" for i in range(300) for t in ("com", "net", "org") for p in ("en", "de", "es")]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate([*URLS, *more])], "page_id long, url string, rule string").repartition(3)
    want = []
    for i, u in enumerate([*URLS, *more]):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        want.append((i, host, path, best[1], best[2]))
    table = urlfilter.rules_table(spark, rules)
    assert sorted(map(tuple, urlfilter.judge(df, table).collect())) == want
    assert {r.verdict for r in urlfilter.judge(df, table.limit(0)).collect()} == {"allow"}
    assert urlfilter.judge(df.limit(0), table).collect() == []
    # The same rows through cascades in shards, and with a long list in which each host is a rule of its own.
    monkeypatch.setattr(urlfilter, "MOST_BITS", 16)
    assert sorted(map(tuple, urlfilter.judge(df, table).collect())) == want
    long = urlfilter.rules_table(spark, [("block" if i % 3 else "allow", f"h{i}.example.com", "/") for i in range(300)])
    monkeypatch.setattr(urlfilter, "MOST_BITS", 800)
    some = {r.host: (r.rule, r.verdict) for r in urlfilter.judge(df, long).where("host like 'h%.example.com'").collect()}
    assert some == {f"h{i}.example.com": (f"h{i}.example.com/", "block" if i % 3 else "allow") for i in range(300)}


def test_url_query_gives_each_rule_the_verdict_of_its_contract(spark, tmp_path):
    want = {
        "http://com/en/": ("com/en/", "block"), "http://www.example.com/en/6": ("com/en/", "block"), "http://a.example.com/en/70": ("example.com/en/7", "allow"),
        "http://NET/de/": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"), "http://other.net/de/8": ("net/de/", "allow"),
        "http://example.net/de/8": ("example.net/de/8", "block"), "http://a.example.net/de/80?q": ("example.net/de/8", "block"),
        "http://a.org/es/x": ("org/es/", "block"), "http://a.net/en/": (None, "allow"), "http://a.org/de/": (None, "allow"), "": (None, "allow"),
    }
    spark.createDataFrame(list(enumerate(want)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = queries.op8_urls(spark, str(tmp_path)).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in rows] == list(want.values())


def test_rules_with_both_verdicts_and_repeated_pages(spark):
    both = spark.createDataFrame([("com/en/", "allow", "com", "/en/"), ("com/en/", "block", "com", "/en/"), ("net/x", "allow", "net", "/x")], "key string, verdict string, host string, path string")
    df = spark.createDataFrame([(1, "http://com/en/a", "v"), (1, "http://com/en/a", "v"), (2, "http://net/x", "v")], "page_id long, url string, verdict string")
    assert sorted((r.page_id, r.verdict) for r in urlfilter.judge(df, both).collect()) == [(1, "block"), (1, "block"), (2, "allow")]
    other = both.replace("allow", "review", "verdict")  # verdicts other than block allow
    assert sorted((r.page_id, r.verdict) for r in urlfilter.judge(df, other).collect()) == [(1, "block"), (1, "block"), (2, "allow")]


def test_cascade_is_exact_on_its_universe(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"), F.xxhash64("id", F.lit(1)).alias("g"), "id")
    tested = urlfilter.cascade(keys.where("id % 7 = 0").select("h", "g"), keys.where("id % 7 <> 0").select("h", "g"))
    assert len(tested.levels) > 1
    few = urlfilter.cascade(keys.where("id < 5").select("h", "g"), keys.where("id >= 5").select("h", "g"))
    assert few.levels[0].hashes == 10 and sum(len(level.bits) for level in few.levels) < 100  # sized by both sides
    rows = keys.collect()
    got = tested.listed(np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.g for r in rows], np.int64).view(np.uint64))
    assert got.tolist() == [r.id % 7 == 0 for r in rows]


def labelled(spark, n=600):
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "of", "and", "ran", "sea", "hill", "blue", "tree", "song"]) + rng.choice(["", "s", "ing"])
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(20, 120))]
        toxic, good = i % 5 == 0, i % 4 != 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["grubnak", "vulmort"]))
        text = " ".join(w) if good else " | ".join(x + "%%%" for x in w)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), int(toxic)))
    extra = [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (n + 2, "sea " * 30000, "en", "s", 0), (0, docs[0][1], "en", "s", 1)]
    return spark.createDataFrame(docs + extra, "doc_id long, text string, lang string, source string, n_chars int"), spark.createDataFrame([*labels, (n + 9, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,column,cut", [(toxicity, "toxic", 0.5), (quality, "quality", 0.3)])
def test_classifiers_on_held_out_texts(spark, module, column, cut):
    docs, labels = labelled(spark)
    model = module.fit(docs, labels)
    rows = module.score(docs, model).collect()
    truth = {r.doc_id: r[column] for r in labels.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.score <= 1
        assert r.predicted == int(r.score >= cut)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert module.score(docs.limit(0), model).collect() == []
    nothing = module.fit(docs, labels.limit(0))
    assert module.score(docs, nothing).count() == docs.count()


def brute_toxicity(net, text):
    """Score of one text, word by word and place by place."""
    h = [int(toxicity.hashes([w])[0]) for w in re.findall(r"[A-Za-z\x80-\U0010ffff]+", text or "")]
    x = [sum(net.tables[k][(v >> (0, 20, 40)[k]) & (toxicity.ROWS - 1)].astype(float) for k in range(3)) for v in h]
    z = net.bias
    for n, (width, w, b) in enumerate(zip(toxicity.WIDTHS, net.filters, net.biases, strict=True)):
        for f in range(toxicity.FILTERS):
            seen = [sum(float(x[i + j] @ w[j][:, f]) for j in range(width)) + float(b[f]) for i in range(len(x) - width + 1)]
            z += max([0.0, *seen]) * float(net.weights[n * toxicity.FILTERS + f])
    code = [net.language_table[v & (toxicity.ROWS - 1)] for v in h]
    counts = [code.count(k) for k in range(1, len(toxicity.LANGUAGES))]
    language = 1 + counts.index(max(counts)) if any(counts) else 0
    z = (z - net.thresholds[language]) * net.sharpness
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def brute_quality(voters, text):
    """Vote on one text: all cosines, the most similar first, ties in the order of the voters."""
    v = (quality.features(pa.array([text or ""]))[0] * voters.weights) @ voters.axes
    if not np.linalg.norm(v):
        return voters.share
    like = voters.vectors @ (v / np.linalg.norm(v))
    near = sorted(range(len(like)), key=lambda i: (-like[i], i))[: quality.NEIGHBOURS]
    w = [max(float(like[i]), 1e-3) ** quality.SHARPNESS for i in near]
    return sum(a * voters.labels[i] for a, i in zip(w, near, strict=True)) / sum(w)


@pytest.mark.parametrize("module,brute", [(toxicity, brute_toxicity), (quality, brute_quality)])
def test_scores_equal_brute_force(spark, module, brute):
    docs, labels = labelled(spark, 300)
    docs = docs.union(spark.createDataFrame([(900, "der Wald und die See ist nicht grubnak", "de", "s", 1), (901, "…", "de", "s", 1), (902, "sea", "en", "s", 1)], docs.schema))
    model = module.fit(docs, labels)
    got = {(r.doc_id, r.text): r.score for r in module.score(docs, model).join(docs, "doc_id").collect()}
    for (_, text), score in got.items():
        assert score == pytest.approx(brute(model, text), abs=2e-4)
    if module is quality:
        assert all(s == pytest.approx(model.share) for (i, _), s in got.items() if i in (300, 301))


def test_ties_for_the_last_neighbour_go_to_the_first_voter():
    v = quality.Voters(None, None, np.zeros((40, 1)), np.array([1.0] * 20 + [0.0] * 20), 0.5)
    like = np.full((1, 40), 0.5)
    assert v.vote(like)[0] == pytest.approx(20 / 25)
    like[0, 39] = 0.9
    assert v.vote(like)[0] == pytest.approx(20 * 0.5**12 / (24 * 0.5**12 + 0.9**12))


@pytest.mark.parametrize("giant", [100_001, 90_000])
def test_a_giant_does_not_empty_the_toxicity_sample(spark, monkeypatch, giant):
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 100_000)
    docs, labels = labelled(spark)
    used = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 != 0]
    first = min(used, key=lambda i: i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFF)
    long = F.when(F.col("doc_id") == first, F.repeat(F.lit("sea "), giant)).otherwise(F.col("text"))
    seen = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, y: seen.append(len(texts)) or train(texts, y))
    net = toxicity.fit(docs.withColumn("text", long), labels)
    assert seen == [len(used) - 1]
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in toxicity.score(docs, net).where("held_out").collect() if truth.get(r.doc_id) is not None]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_labels_of_other_documents_take_no_room_in_the_sample(spark):
    docs, labels = labelled(spark)
    other = spark.range(10_000, 30_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "cast(id % 2 as int) as toxic")
    used = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(600))
    assert len(quality.fit(docs, labels.union(other), 600).labels) == used
    alone, among = (toxicity.fit(docs, x, 600) for x in (labels, labels.union(other)))
    assert all((a == b).all() for a, b in zip(alone.tables, among.tables, strict=True))


def test_the_toxicity_sample_passes_over_what_does_not_fit():
    assert toxicity.fitting([990, 5, 10, 3, 95], 1000) == [False, True, True, True, True]
    assert toxicity.fitting([1001, 5, 995, 5], 1000) == [False, True, False, True]
    assert toxicity.fitting([10] * 99 + [11, 10, 10], 1000) == [True] * 99 + [False, True, False]
    assert toxicity.fitting([], 1000) == []


def test_convolution_does_not_cross_texts():
    net = toxicity.train([toxicity.hashes(["grubnak vulmort sea"]), toxicity.hashes(["sea hill"])] * 8, np.array([1, 0] * 8))
    one, two = toxicity.hashes(["sea hill grubnak"]), toxicity.hashes(["vulmort sea"])
    both = net.pooled(np.concatenate([one, two]), np.array([0, 3, 5]))
    assert np.allclose(both[0], net.pooled(one, np.array([0, 3]))[0])
    assert np.allclose(both[1], net.pooled(two, np.array([0, 2]))[0])
    edge = net.pooled(np.concatenate([one[:0], one, two[:0]]), np.array([0, 0, 3, 3]))
    assert np.allclose(edge[1], both[0]) and not edge[0].any() and not edge[2].any()


def test_words_are_the_same_in_any_batch():
    from quire.llm import text as t

    rng = random.Random(10)
    rows = ["".join(rng.choice("abC dé\n9") for _ in range(rng.randrange(60))) for _ in range(200)]
    data, offsets = t.utf8(pa.array(rows))
    h, s, e, first = t.words(data, offsets, t.ALNUM)
    for i, row in enumerate(rows):
        want = brute_windows(row)
        assert first[i + 1] - first[i] == len(want)
        for k, w in zip(range(first[i], first[i + 1]), want, strict=True):
            assert bytes(data[s[k] : e[k]]).decode().translate({c: c + 32 for c in range(65, 91)}) == w
            assert t.words(*t.utf8(pa.array([w])), t.ALNUM)[0][0] == h[k]
    step, t.STEP = t.STEP, 64
    try:
        again = t.words(data, offsets, t.ALNUM)
    finally:
        t.STEP = step
    assert all((a == b).all() for a, b in zip((h, s, e, first), again, strict=True))
