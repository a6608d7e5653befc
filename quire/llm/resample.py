"""Importance resampling towards a target distribution over hashed word runs.

A document is scanned once: its words, lower-cased and parted by one space, are a stream of
bytes, and the CRC register after each byte is kept at the words' edges.  The CRC of any run of
words then follows from two registers: appending n bytes multiplies the register before the
run by x^(8n) modulo the CRC's polynomial, so shifting it that far and adding it to the register
behind the run cancels all that came before.  The shift is linear over GF(2); tables for powers
of two are applied by the bits of n.

Buckets of run CRCs are counted over all documents and all target texts.  The logarithm of
the two smoothed shares is a bucket's gain, a document's weight the sum of its runs' gains, and
weight plus Gumbel noise, fixed by the document's id, orders the draw without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import cut, tidy
from quire.llm.text import ALNUM, STEP, slices, utf8

#: The polynomial of CRC-32, bits reversed (a fixed value).
POLYNOMIAL = 0xEDB88320
ONES = np.uint32(0xFFFFFFFF)
#: Bytes that one lane scans; lanes of a piece run side by side.
LANE = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]


BYTE = _byte_table()


def _shift_tables(bits: int = 40) -> list[np.ndarray]:
    """``tables[k]`` multiplies a register by x^(8 * 2**k), a byte of the register at a time."""
    x = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    tables = [BYTE[x & 255] ^ (x >> 8)]
    while len(tables) < bits:
        tables.append(_apply(tables[-1], tables[-1]))
    return tables


SHIFTS = _shift_tables()


def shift(register: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers after n zero bytes each."""
    out = register.copy()
    for k in range(int(n.max()).bit_length() if len(n) else 0):
        on = np.flatnonzero((n >> k) & 1)
        out[on] = _apply(SHIFTS[k], out[on])
    return out


class Running:
    """CRC registers along a stream of bytes, begun at zero; ``feed`` gives them before each byte of a piece and behind its last."""

    def __init__(self):
        self.register = np.uint32(0)

    def feed(self, stream: np.ndarray):
        n = len(stream)
        lanes = n // LANE + 1
        padded = np.zeros(lanes * LANE, np.uint8)
        padded[:n] = stream
        columns = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
        own = np.zeros(lanes, np.uint32)
        for column in columns:
            own = BYTE[(own ^ column) & 255] ^ (own >> 8)
        # Prefix scan over lanes: after the step of width d a lane covers 2 * d lanes up to itself.
        reach = np.concatenate([np.array([self.register], np.uint32), own[:-1]])
        d = 1
        while d < lanes:
            reach[d:] ^= _apply(SHIFTS[(d * LANE).bit_length() - 1], reach[:-d].copy())
            d *= 2
        before = np.empty((LANE, lanes), np.uint32)
        state = reach
        for j, column in enumerate(columns):
            before[j] = state
            state = BYTE[(state ^ column) & 255] ^ (state >> 8)
        self.register = before[n % LANE, n // LANE]
        return lambda at: before[at % LANE, at // LANE]


def word_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(register before, register behind, place, end) of every word in the stream, and each row's first word number."""
    running, base, inside = Running(), 0, False
    found: list[list[np.ndarray]] = [[], [], [], [], []]
    for lo in range(0, len(data), STEP):
        b = data[lo : lo + STEP]
        w = ALNUM[b]
        before = np.empty(len(b), bool)
        before[0], before[1:] = inside, w[:-1]
        edge = np.zeros(len(b), bool)
        cuts = offsets[np.searchsorted(offsets, lo, "left") : np.searchsorted(offsets, lo + len(b), "left")] - lo
        edge[cuts] = True
        first, ended = w & (~before | edge), before & (~w | edge)
        keep = w | (before & ~edge)  # a word's bytes and, in its row, the byte behind it as the separator
        place = np.cumsum(keep) - keep
        registers = running.feed(np.where(w, _LOWER[b], np.uint8(32))[keep])
        s, e = np.flatnonzero(first), np.flatnonzero(ended)
        for into, x in zip(found, (registers(place[s]), registers(place[e]), place[s] + base, place[e] + base, s + lo), strict=True):
            into.append(x)
        base += int(keep.sum())
        inside = bool(w[-1])
    if inside:
        found[1].append(np.array([running.register]))
        found[3].append(np.array([base]))
    kinds = (np.uint32, np.uint32, np.int64, np.int64, np.int64)
    starts, ends, place, end, raw = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(found, kinds, strict=True))
    return starts, ends, place, end, np.searchsorted(raw, offsets)


def run_crcs(edges: tuple, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC-32 of each run of ``size`` words in a row, each row's first run, its last run's end)."""
    starts, ends, place, end, first_word = edges
    n = max(0, len(starts) - size + 1)
    length = end[size - 1 : size - 1 + n] - place[:n]
    crc = ends[size - 1 : size - 1 + n] ^ shift(starts[:n], length) ^ shift(np.full(n, ONES), length) ^ ONES
    lo = np.minimum(first_word[:-1], n)
    return crc, lo, np.clip(first_word[1:] - size + 1, lo, n)


def _scan(batches: Iterator[pa.RecordBatch], column: str, sizes: range, buckets: int):
    for batch in slices(batches, column):
        edges = word_edges(*utf8(batch.column(batch.schema.get_field_index(column))))
        runs = []
        for size in sizes:
            crc, lo, hi = run_crcs(edges, size)
            runs.append(((crc % np.uint32(buckets)).astype(np.int64), lo, hi))
        yield batch, np.diff(edges[4]), runs


def bucket_counts(texts: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000, text: str = "text") -> DataFrame:
    """(bucket, n): how many runs of ``low`` to ``high`` words of all texts fall in each bucket; empty buckets have no row.

    A task counts all it reads before anything is shuffled, so at most ``buckets`` rows leave it.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, _, runs in _scan(batches, text, range(low, high + 1), buckets):
            for bucket, lo, hi in runs:
                # Runs that leave their row are those between one row's last and the next row's first.
                change = np.zeros(len(bucket) + 1, np.int64)
                np.add.at(change, lo, 1)
                np.add.at(change, hi, -1)
                total += np.bincount(bucket[np.cumsum(change)[:-1] > 0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return texts.select(text).mapInArrow(tidy(kernel), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) for every bucket: floor(1000 ln) of the target's smoothed share over the documents'."""
    both = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    for name, texts in (("s", docs), ("t", target)):
        both = both.join(bucket_counts(texts, low, high, buckets).withColumnRenamed("n", name), "bucket", "left")
    both = cut(both.select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t")))
    total = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    share = (F.col("t") + 1) * F.lit(total["s"] + buckets) / ((F.col("s") + 1) * F.lit(total["t"] + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(share)).alias("gain"))


def noise(doc_id: Column, seed: str = "2024") -> Column:
    """floor(1000 g) of the id's Gumbel noise g; null counts as an empty id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, gain: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row; ``gain`` has one row a bucket, so its size is bounded."""
    table = np.zeros(buckets, np.int64)
    for r in gain.collect():
        table[r["bucket"]] = r["gain"]
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, n_words, runs in _scan(batches, "text", range(low, high + 1), buckets):
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for bucket, lo, hi in runs:
                sums = np.append(0, np.cumsum(shared.value[bucket]))
                n += hi - lo
                weight += sums[hi] - sums[lo]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(kernel), "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``rank`` from 1 in the given order over the whole table, without one task that sees all rows.

    Rows are sorted over range partitions; equal ones may lie in several, since their place in
    the input is the last key.  A row's rank is its place in its partition plus the sizes of the
    partitions before; only these sizes reach the driver.
    """
    spread = rows.withColumn("_at", F.monotonically_increasing_id())
    order = [*order, F.col("_at").asc()]
    placed = cut(spread.repartitionByRange(*order).sortWithinPartitions(*order).drop("_at").withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_place", 33)
    sizes, before = [], 0
    for r in sorted(placed.groupBy(part.alias("part")).count().collect(), key=lambda r: r["part"]):
        sizes.append((r["part"], before))
        before += r["count"]
    offsets = placed.sparkSession.createDataFrame(sizes, "_part long, _before long")
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn("rank", F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_before", "_place")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, low: int = 1, high: int = 1, buckets: int = 10_000, seed: str = "2024") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; ``rank`` is null for those not drawn.

    Of the rows with at least ``least_words`` words ``percent`` in a hundred, rounded down, are
    drawn: those of the highest score, ties to smaller ids, null ids last.  Null and empty
    texts have no features and weight 0; repeated rows each get their row and may each be drawn; an
    empty target gives all buckets the smoothed share of nothing; other columns aren't read.
    """
    weighed = weigh(docs, gains(docs, target, low, high, buckets), low, high, buckets)
    scored = cut(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    fit = F.col("n_words") >= least_words
    drawn = scored.where(fit).count() * percent // 100
    order = ranked(scored.where(fit), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
    columns = ["doc_id", "n_features", "weight", "score"]
    some = order.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return some.unionByName(scored.where(~fit).select(*columns, F.lit(None).cast("long").alias("rank")))
