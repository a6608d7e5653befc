"""Text quality by a vote of similar labelled texts in a latent-semantic space.

A text becomes counts of hashed words, of the shapes of its tokens, of bytes and of tokens
that repeat the one before.  A truncated singular value decomposition of a bounded labelled
sample gives the latent space; the sample's vectors are broadcast, every text's cosine with
each of them is computed exactly, in blocks, and the most similar vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import held_out, tidy, training_ids
from quire.llm.text import LETTERS, NOT_SPACE, slices, utf8, words

#: Labelled texts in the vote at most; dimensions of the latent space; neighbours that vote.
SAMPLE, DIMENSIONS, NEIGHBOURS = 4000, 48, 25
#: Similarities count to this power.
SHARPNESS = 12
WORD_CELLS, SHAPE_CELLS = 1024, 512
CELLS = WORD_CELLS + SHAPE_CELLS + 256 + 2
THRESHOLD = 0.3


def _shape_classes() -> np.ndarray:
    """Letters by case and digits fall together; every other byte stands for itself."""
    c = np.arange(256, dtype=np.uint64)
    c[97:123], c[65:91], c[48:58], c[128:] = 1, 2, 3, 1
    return c


_SHAPES = _shape_classes()


def features(column: pa.Array) -> np.ndarray:
    """One row of ``CELLS`` numbers for each text: square roots of shares, by family."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    out = np.zeros((n, CELLS), np.float32)

    def add(doc: np.ndarray, cell: np.ndarray, start: int, cells: int, weight: float = 1.0) -> None:
        got = np.bincount(doc * cells + cell, minlength=n * cells).reshape(n, cells).astype(np.float32)
        total = np.maximum(got.sum(axis=1, keepdims=True), 1)
        out[:, start : start + cells] = weight * np.sqrt(got / total)

    h, _, _, first = words(data, offsets, LETTERS)
    add(np.repeat(np.arange(n), np.diff(first)), (h >> np.uint64(54)).astype(np.int64), 0, WORD_CELLS)
    t, s, e, first = words(data, offsets, NOT_SPACE)
    doc = np.repeat(np.arange(n), np.diff(first))
    if len(t):
        shape = _SHAPES[data[s]] * np.uint64(31) + _SHAPES[data[np.minimum(s + 1, e - 1)]]
        for back in (3, 2, 1):
            shape = shape * np.uint64(263) + _SHAPES[data[np.maximum(e - back, s)]]
        add(doc, ((shape * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55)).astype(np.int64), WORD_CELLS, SHAPE_CELLS, 1.5)
        same = np.zeros(len(t), np.int64)
        same[1:] = (t[1:] == t[:-1]) & (doc[1:] == doc[:-1])
        add(doc, same, CELLS - 2, 2, 1.5)
    punct = (_SHAPES[data] > 3) & NOT_SPACE[data]
    add(np.repeat(np.arange(n), np.diff(offsets))[punct], data[punct].astype(np.int64), WORD_CELLS + SHAPE_CELLS, 256)
    return out


@dataclass
class Voters:
    weights: np.ndarray  # by cell
    axes: np.ndarray  # cells x dimensions
    vectors: np.ndarray  # voters x dimensions, of length 1
    labels: np.ndarray
    share: float

    def project(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.weights) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def scores(self, column: pa.Array, block: int = 256) -> np.ndarray:
        out = []
        for at in range(0, len(column), block):
            if not len(self.labels):
                out.append(np.full(min(block, len(column) - at), self.share))
                continue
            x = self.project(features(column.slice(at, block)))
            voted = self.vote(x @ self.vectors.T)
            out.append(np.where(x.any(axis=1), voted, self.share))
        return np.clip(np.concatenate([np.zeros(0), *out]).astype(np.float64), 0, 1)

    def vote(self, like: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the most similar voters of each row; of equally similar ones the first in order."""
        k = min(NEIGHBOURS, like.shape[1])
        least = np.partition(like, like.shape[1] - k, axis=1)[:, -k, None]
        above, level = like > least, like == least
        take = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        w = np.where(take, np.maximum(like, 1e-3) ** SHARPNESS, 0)
        return (w @ self.labels) / w.sum(axis=1)


def train(x: np.ndarray, labels: np.ndarray, seed: int = 5) -> Voters:
    """The latent space of the sample (randomised SVD with power steps) and its vectors."""
    if not len(labels):
        return Voters(np.ones(CELLS, np.float32), np.zeros((CELLS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5)
    used = (x > 0).sum(axis=0)
    weights = np.log1p(len(x) / (1.0 + used)).astype(np.float32)
    a = x * weights
    rng = np.random.default_rng(seed)
    k = min(DIMENSIONS, *a.shape)
    y = a @ rng.normal(size=(a.shape[1], min(k + 8, a.shape[1]))).astype(np.float32)
    for _ in range(3):
        y = a @ (a.T @ np.linalg.qr(y)[0])
    _, _, axes = np.linalg.svd(np.linalg.qr(y)[0].T @ a, full_matrices=False)
    out = Voters(weights, np.ascontiguousarray(axes[:k].T, np.float32), np.zeros((0, k)), np.asarray(labels, np.float32), float(np.mean(labels)))
    out.vectors = out.project(x).astype(np.float32)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Voters:
    """Voters from at most ``sample`` labelled rows of ``docs``; their texts are read whole, only the counts reach the driver, once for each doc_id."""
    ids = F.broadcast(training_ids(docs, labels, "quality", sample))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [r.astype(np.float16).tobytes() for r in features(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(own, pa.binary())], ["doc_id", "label", "x"])

    rows = docs.select("doc_id", "text").join(ids, "doc_id").select("doc_id", "text", "label").mapInArrow(tidy(kernel), "doc_id long, label int, x binary")
    got = sorted(rows.groupBy("doc_id", "label").agg(F.min("x").alias("x")).collect(), key=lambda r: r["doc_id"])
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32) if got else np.zeros((0, CELLS), np.float32)
    return train(x, np.array([r["label"] for r in got]))


def score(docs: DataFrame, voters: Voters, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; texts are read whole.

    Null and empty texts, like any text without a feature of the latent space, get the voters'
    share of label 1, and without voters 0.5.  Voters are in the order of their doc_id, which
    settles ties for the last neighbour.  Repeated rows each get their row; other columns aren't
    read; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1)))], ["doc_id", "score"])

    rows = docs.select("doc_id", "text").mapInArrow(tidy(kernel), "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, voters: Voters, threshold: float = THRESHOLD) -> DataFrame:
    """The rows with a score of at least ``threshold``, columns as they are; a filter where the rows lie.

    Scores are those of ``score``, so null and empty texts stay if the voters' share reaches the
    threshold; repeated rows are decided alike, whatever else their columns hold.
    """
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = shared.value.scores(batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(tidy(kernel), docs.schema)
