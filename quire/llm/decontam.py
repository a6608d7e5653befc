"""Benchmark decontamination by winnowing.

Texts are words; of each run of ``span`` words the smallest k-gram hash is its fingerprint,
so two texts that share such a run share its fingerprint, whatever surrounds it.  The
benchmark's runs become index rows (fingerprint, hash of the whole run, item).  Documents
are joined with them where they lie: their fingerprints are looked up in the broadcast
index, and around each hit every run is compared in full, which extends hits over all of
a shared stretch.  The index is broadcast in parts of at most ``PART`` rows, one pass over
the documents each, so a large benchmark takes more passes and never more memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import cut, tidy
from quire.llm.text import ALNUM, grams, slices, utf8, words

SPAN, K = 13, 5
#: Index rows broadcast at a time (24 bytes each).
PART = 2_000_000
#: Bits of the table that fingerprints are first looked up in.
FILTER_BITS = 22
#: Stands for the id of an item that has none.
NAMELESS = np.iinfo(np.int64).min


def lowest(g: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value in each window, the last of equal ones."""
    if len(g) < width:
        return np.zeros(0, np.int64)
    best, at = g[: len(g) - width + 1].copy(), np.arange(len(g) - width + 1)
    for j in range(1, width):
        other = g[j : len(g) - width + 1 + j]
        take = other <= best
        best = np.where(take, other, best)
        at = np.where(take, np.arange(len(at)) + j, at)
    return at


def inside(starts: int, first_word: np.ndarray, length: int) -> np.ndarray:
    """Which of the runs of ``length`` words beginning at 0.. lie within one text."""
    ok = np.zeros(starts + 1, np.int32)
    begin, end = first_word[:-1], first_word[1:] - length + 1
    real = end > begin
    np.add.at(ok, begin[real], 1)
    np.add.at(ok, end[real], -1)
    return np.cumsum(ok)[:starts] > 0


def index_rows(benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """(size, run, mark, item_id) of all runs of the items; a shorter item is one run of its own size.

    ``mark`` is the run's fingerprint, 0 for the shorter ones.  Items without words have none.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h, _, _, first = words(*utf8(batch.column(1)), ALNUM)
            ids = batch.column(0).to_pylist()
            for i, item in enumerate(ids):
                own = h[first[i] : first[i + 1]]
                size = min(len(own), span)
                if not size:
                    continue
                run = grams(own, size)
                mark = np.zeros(1, np.uint64)
                if size == span:
                    g = grams(own, k)
                    mark = g[lowest(g, span - k + 1)]
                both = np.unique(np.stack([run, mark]), axis=1)
                n = both.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, size, np.int32)), pa.array(both[0].view(np.int64)), pa.array(both[1].view(np.int64)), pa.array([item] * n, pa.int64())], ["size", "run", "mark", "item_id"])

    return benchmark.select("item_id", "text").mapInArrow(tidy(kernel), "size int, run long, mark long, item_id long")


class Index:
    """One part of the index, as the kernels look it up."""

    def __init__(self, rows: pa.Table, span: int, k: int):
        self.span, self.k = span, k
        table = np.stack([rows.column(c).cast(pa.int64()).fill_null(NAMELESS).to_numpy() for c in ("size", "run", "mark", "item_id")], axis=1)
        self.by_size = {}
        for size in np.unique(table[:, 0]):
            own = table[table[:, 0] == size]
            run = own[:, 1].copy().view(np.uint64)
            order = np.argsort(run, kind="stable")
            self.by_size[int(size)] = (run[order], own[order, 3])
        self.marks = np.unique(table[table[:, 0] == span, 2].copy().view(np.uint64))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.marks >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, first_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, size, item) of all places where a run of the index occurs."""
        places, sizes, items = [], [], []
        for size, (runs, item) in self.by_size.items():
            starts = len(h) - size + 1
            if starts <= 0:
                continue
            ok = inside(starts, first_word, size)
            g = grams(h, self.k if size == self.span else size)
            if size == self.span:
                low = lowest(g, size - self.k + 1)  # fingerprint of each run
                mark = g[low]
                ok &= self.filter[(mark >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
                at = np.flatnonzero(ok)
                at = at[np.isin(mark[at], self.marks)]
                run = grams_at(h, at, size)
            else:
                at = np.flatnonzero(ok)
                run = g[at]
            lo, hi = np.searchsorted(runs, run, "left"), np.searchsorted(runs, run, "right")
            many = hi - lo
            if many.any():
                ends = np.cumsum(many)
                pick = np.repeat(lo - ends + many, many) + np.arange(ends[-1])
                places.append(np.repeat(at, many))
                items.append(item[pick])
                sizes.append(np.full(len(pick), size))
        if not places:
            return (np.zeros(0, np.int64),) * 3
        return np.concatenate(places), np.concatenate(sizes), np.concatenate(items)


def grams_at(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """``grams(h, k)[at]``."""
    out = grams(h[(at[:, None] + np.arange(k)).ravel()], k)
    return out[::k] if len(at) else out[:0]


def scan(index: Index, batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[tuple[int, int]], list[int]]]:
    """For each text: (row, words, merged spans of hit words, items that occur)."""
    h, _, _, first = words(*utf8(batch.column(column)), ALNUM)
    at, size, item = index.hits(h, first)
    row = np.searchsorted(first, at, "right") - 1
    order = np.lexsort((at, row))
    at, size, item, row = at[order], size[order], item[order], row[order]
    cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
    for i in range(batch.num_rows):
        spans: list[tuple[int, int]] = []
        a, b = cuts[i], cuts[i + 1]
        if b > a:
            begin = at[a:b] - first[i]
            reach = np.maximum.accumulate(begin + size[a:b])
            new = np.append(True, begin[1:] > reach[:-1])
            edge = np.flatnonzero(new)
            spans = list(zip(begin[edge].tolist(), reach[np.append(edge[1:], b - a) - 1].tolist(), strict=True))
        found = np.unique(item[a:b])
        yield i, int(first[i + 1] - first[i]), spans, found[found != NAMELESS].tolist()


def parts_of(benchmark: DataFrame, span: int, k: int, part: int) -> Iterator[Index]:
    """The index in parts that hold at most about ``part`` rows; at least one part."""
    rows = cut(index_rows(benchmark, span, k))
    parts = max(1, -(-rows.count() // part))
    for p in range(parts):
        yield Index(rows.where(F.pmod(F.xxhash64("run"), F.lit(parts)) == p).toArrow(), span, k)


#: Words in the spans.
HIT = "aggregate(spans, 0L, (total, s) -> total + s.last - s.first)"
FOUND = "doc_id long, text_hash long, n_words long, spans array<struct<first:long,last:long>>, item_ids array<long>"


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K, part: int = PART) -> DataFrame:
    """(doc_id, n_words, spans, item_ids) of every row of ``docs``.

    ``spans`` are the merged stretches of words [first, last) that lie in occurrences of runs of
    ``span`` consecutive item words (or of a whole shorter item); ``item_ids`` the items these
    runs come from.  Null and empty texts have no words; items without words never occur;
    an item without an id marks words but is not listed; repeated rows each get their row; an
    empty benchmark hits nothing; other columns aren't read.
    """
    return _found(docs, benchmark, span, k, part).drop("text_hash")


def _found(docs: DataFrame, benchmark: DataFrame, span: int, k: int, part: int) -> DataFrame:
    """What ``contamination`` gives, with the text's hash."""
    context = docs.sparkSession.sparkContext
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = []
    for index in parts_of(benchmark, span, k, part):
        shared = context.broadcast(index)

        def kernel(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                _, n, spans, items = zip(*scan(shared.value, batch, 1), strict=True)
                kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
                arrays = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], kind), pa.array(items, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "n_words", "spans", "item_ids"])

        found.append(source.mapInArrow(tidy(kernel), FOUND))
    return found[0] if len(found) == 1 else _merged(found)


def _merged(found: list[DataFrame]) -> DataFrame:
    """Unites what the parts of the index found; all rows of one (doc_id, text) are one group."""
    hits = found[0].where("size(spans) > 0")
    for f in found[1:]:
        hits = hits.unionByName(f.where("size(spans) > 0"))
    joined = hits.groupBy("doc_id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("i"))
    merged = F.expr(
        "aggregate(s, cast(array() as array<struct<first:bigint,last:bigint>>), (done, x) -> "
        "case when size(done) > 0 and element_at(done, -1).last >= x.first "
        "then concat(slice(done, 1, size(done) - 1), array(named_struct('first', element_at(done, -1).first, 'last', greatest(element_at(done, -1).last, x.last)))) "
        "else concat(done, array(x)) end)"
    )
    rows = found[0].select("doc_id", "text_hash", "n_words")
    out = rows.alias("r").join(joined.select("doc_id", "text_hash", merged.alias("m"), "i").alias("j"), F.expr("r.doc_id <=> j.doc_id and r.text_hash = j.text_hash"), "left")
    empty = F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)")
    return out.select("r.doc_id", "r.text_hash", "r.n_words", F.coalesce("m", empty).alias("spans"), F.coalesce("i", F.expr("cast(array() as array<bigint>)")).alias("item_ids"))


def counts(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) from ``contamination``."""
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    out = found.select("doc_id", "n_words", F.expr(HIT).alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, share: int = 20, span: int = SPAN, k: int = K, part: int = PART) -> DataFrame:
    """The rows of ``docs``, columns as they are, without the contaminated ones.

    A row goes if its hit words number at least 1/``share`` of its words.  A filter where the
    rows lie if the benchmark is one part; otherwise the decisions are joined by id and text.
    """
    indexes = parts_of(benchmark, span, k, part)
    first = next(indexes)
    if next(indexes, None) is not None:
        found = _found(docs, benchmark, span, k, part).withColumn("n_hit", F.expr(HIT))
        verdict = found.where(f"n_hit > 0 and {share} * n_hit >= n_words").select("doc_id", "text_hash").distinct()
        same = F.col("d.doc_id").eqNullSafe(F.col("v.doc_id")) & (F.xxhash64("d.text") == F.col("v.text_hash"))
        return docs.alias("d").join(verdict.alias("v"), same, "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(first)
    return docs.mapInArrow(_filter("text", lambda batch, column: np.array([not (hit := sum(b - a for a, b in s)) or share * hit < n for _, n, s, _ in scan(shared.value, batch, column)])), docs.schema)


def _filter(name: str, keep: Callable[[pa.RecordBatch, int], np.ndarray]):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, name):
            yield batch.filter(pa.array(keep(batch, batch.schema.get_field_index(name)), pa.bool_()))

    return kernel
