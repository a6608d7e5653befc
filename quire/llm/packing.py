"""Packing of tokenized documents into training sequences by bounded-space best fit.

Tokenizing is a map over documents.  Its words are looked up by their hash in a table of the
ids that the tokenizers library gave for each distinct pre-token, so the library encodes
every pre-token once a worker.  The pieces (no text, no ids unless asked for) are dealt out
evenly and packed online, task by task, in an order that has nothing to do with their length:
a fixed number of open bins, kept by free space in a bitset from which the tightest bin that
fits is read as the lowest set bit; if none fits and all bins are taken, the fullest is closed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe import Splitter, code_points
from quire.llm.shared import cut, tidy
from quire.llm.text import mix, slices, _powers

CAPACITY = 2048
#: Open bins of a task, whatever it is dealt; pieces dealt to a task on average.
OPEN_BINS = 64
PIECES_PER_TASK = 40_000
#: Distinct pre-tokens whose ids a worker remembers.
REMEMBERED = 2_000_000


class WordIds:
    """Ids of whole texts as the tokenizers library gives them, looked up pre-token by pre-token."""

    def __init__(self, path: str):
        self.splitter = Splitter(path)
        self.specials = {t.content: i for i, t in self.splitter.tokenizer.get_added_tokens_decoder().items()}
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised texts without special strings laid end to end, and their offsets."""
        if len(self.keys) > REMEMBERED:
            self.clear()
        points, offsets = code_points(texts)
        first, last = self.splitter.pretokens(points, offsets)
        power, inverse = _powers(len(points))
        sums = np.zeros(len(points) + 1, np.uint64)
        v = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)
        np.cumsum((v ^ (v >> np.uint64(29))) * power[: len(points)], out=sums[1:])
        h = mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))
        distinct, sample, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        if not known.all():
            whole = "".join(texts)
            new = [whole[first[i] : last[i]] for i in sample[~known]]
            encoded = [e.ids for e in self.splitter.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            self.keys = np.insert(self.keys, at[~known], distinct[~known])
            self.rows = np.insert(self.rows, at[~known], len(self.starts) - 1 + np.arange(len(new)))
            self.ids = np.concatenate([self.ids, *[np.array(e, np.uint32) for e in encoded]])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(e) for e in encoded])])
            at = np.searchsorted(self.keys, distinct)
        row = self.rows[at][which]
        size = self.starts[row + 1] - self.starts[row]
        ends = np.cumsum(size)
        out = self.ids[np.repeat(self.starts[row] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([np.zeros(1, np.int64), ends])[np.searchsorted(first, offsets)]
        return out, bounds

    def documents(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; special strings inside become their own id."""
        parts: list[str] = []
        plan: list[list[int]] = []
        for x in texts:
            found = self.splitter.parts(x)
            if None not in found:
                plan.append([len(parts)])
                parts.append(found[0])
            else:
                order = iter(s for s in _in_order(x, self.specials))
                plan.append([])
                for p in found:
                    if p is None:
                        plan[-1].append(-1 - self.specials[next(order)])
                    else:
                        plan[-1].append(len(parts))
                        parts.append(p)
        ids, bounds = self.encode(parts)
        one = lambda k: ids[bounds[k] : bounds[k + 1]] if k >= 0 else np.array([-1 - k], np.uint32)
        return [one(p[0]) if len(p) == 1 else np.concatenate([one(k) for k in p]) for p in plan]


def _in_order(text: str, specials: dict[str, int]) -> Iterator[str]:
    while found := [(at, -len(s), s) for s in specials if (at := text.find(s)) >= 0]:
        at, _, s = min(found)
        yield s
        text = text[at + len(s) :]


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Ids of every whole text, then ``end_id``, cut into pieces of at most ``capacity``.

    Null and empty texts are one piece of one id.  With ``keep_ids`` the ids come along as
    ``ids array<int>``; without, only their number and CRC-32.  Other columns are not read.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, "text", 1 << 18):
            docs = enc.documents([x or "" for x in batch.column(1).to_pylist()])
            rows: list[tuple] = []
            kept: list[np.ndarray] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), docs, strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for p, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((doc_id, p, at, len(part), zlib.crc32(part.tobytes())))
                    if keep_ids:
                        kept.append(part.astype(np.int32))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return df.select("doc_id", "text").mapInArrow(tidy(kernel), PIECES + (", ids array<int>" if keep_ids else ""))


class BestFit:
    """Online best fit with a fixed number of open bins."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.room = capacity, open_bins
        self.bits = 0  # bit f is set if a bin with f free is open
        self.by_free: dict[int, list[int]] = {}
        self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) for an item of this length."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_no = self._take(free)
        else:
            if self.open == self.room:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, bin_no = self.capacity, self.made
            self.made += 1
        if free > length:
            self.by_free.setdefault(free - length, []).append(bin_no)
            self.bits |= 1 << (free - length)
            self.open += 1
        return bin_no, self.capacity - free

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_no = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_no


def pack(items: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds (sequence_id long, offset long) to items with a ``length`` from 1 to ``capacity``.

    ``items`` should be materialised, since it is counted first: pieces are dealt in turn, so
    that equal rows spread as well, to so many tasks that each gets about ``PIECES_PER_TASK``.
    They arrive by a hash of their keys.  An empty table gives an empty result.
    """
    tasks = max(1, -(-items.count() // PIECES_PER_TASK))

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fit, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for frame in frames:
            placed = [fit.place(n) for n in frame["length"].tolist()]
            yield frame.assign(sequence_id=[base + b for b, _ in placed], offset=[o for _, o in placed])

    keys = ["doc_id", "piece", "start", "ids_crc32"]
    schema = items.schema.add("sequence_id", "long").add("offset", "long")
    dealt = items.repartition(tasks).sortWithinPartitions(F.xxhash64(*keys), *keys)
    return dealt.mapInPandas(tidy(kernel), schema)


def pack_documents(df: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Every document's pieces with their place: ``pieces`` and then ``pack``.

    Repeated rows are packed as often as they occur; texts longer than ``capacity`` tokens are
    cut, others never.  All pieces keep their row; nothing is dropped.
    """
    return pack(cut(pieces(df, path, capacity, keep_ids=keep_ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) of a packing that kept its ids; a group is at most one sequence long."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
