"""Toxicity by a small convolutional network over hashed words, trained here in numpy.

A word's vector is the sum of three rows, each looked up by another hash of the word, so that
a word that shares one row with a toxic one still differs in the others.  Filters over one,
two and three words are followed by the maximum over the whole text and a linear layer.
Word rows start from how often training texts with that hash are toxic; stochastic gradient
steps then train rows, filters and layer together.  On texts kept out of training steps, a
threshold is set for each language, which is read off the text by function words; the score
is the distance to it on the logistic scale, so that 0.5 is the threshold everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import cut, held_out, tidy, training_ids
from quire.llm.text import LETTERS, slices, utf8, words

#: Labelled texts used for training at most, and words of them in all.
SAMPLE, SAMPLE_WORDS = 10_000, 8_000_000
#: Longer texts than this part of the words only take what room the others leave.
SHARE = 100
ROWS, DEPTH, WIDTHS, FILTERS = 1 << 18, 4, (1, 2, 3), 4
EPOCHS, BATCH, RATE = 4, 64, 0.05
PRIOR = 6.0
#: Texts of either label that a language needs for a threshold of its own.
MINPOS = 8
#: What a toxic text that passes counts against a clean one that is called toxic, when a threshold is set.
MISSED = 2.0

#: Frequent function words by which a text's language is told.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was as with be by are this at from".split(),
    "de": "der die und das den von zu mit ist nicht ein eine auf im dem sich".split(),
    "fr": "le la les et des est dans une pour qui sur au pas par plus ce".split(),
    "es": "el los las y del se por con una su para como al lo más pero".split(),
}
LANGUAGES = ("other", *FUNCTION_WORDS)


def hashes(texts: list[str]) -> np.ndarray:
    return words(*utf8(pa.array(texts)), LETTERS)[0]


def rows_of(h: np.ndarray) -> list[np.ndarray]:
    """The three table rows of each word."""
    return [((h >> np.uint64(s)) & np.uint64(ROWS - 1)).astype(np.int32) for s in (0, 20, 40)]


def _language_table() -> np.ndarray:
    table = np.zeros(ROWS, np.int8)
    for code, name in enumerate(LANGUAGES[1:], 1):
        table[rows_of(hashes(FUNCTION_WORDS[name]))[0]] = code
    return table


def languages(h: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Language number of each text: that with most function words, 0 (other) if there are none."""
    code = table[rows_of(h)[0]]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    known = code > 0
    seen = np.bincount(doc[known] * len(LANGUAGES) + code[known], minlength=(len(first) - 1) * len(LANGUAGES)).reshape(-1, len(LANGUAGES))
    return np.where(seen.any(axis=1), seen.argmax(axis=1), 0)


@dataclass
class Network:
    tables: list[np.ndarray]
    filters: list[np.ndarray]  # by width: (width, DEPTH, FILTERS)
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))
    sharpness: float = 1.0
    language_table: np.ndarray = field(default_factory=_language_table)

    def pooled(self, h: np.ndarray, first: np.ndarray, places: bool = False):
        """Maxima of each filter over each text (0 at least), and where they are."""
        rows = rows_of(h)
        x = self.tables[0][rows[0]] + self.tables[1][rows[1]] + self.tables[2][rows[2]]
        n = np.diff(first)
        out, where = [], []
        for width, w, b in zip(WIDTHS, self.filters, self.biases, strict=True):
            top = np.zeros((len(n), FILTERS), np.float32)
            at = np.full((len(n), FILTERS), -1, np.int64)
            starts = len(h) - width + 1
            enough = n >= width
            if starts > 0 and enough.any():
                r = x[:starts] @ w[0] + b
                for j in range(1, width):
                    r += x[j : j + starts] @ w[j]
                if width > 1:  # runs across two texts
                    ends = first[1:-1]
                    for j in range(1, width):
                        cut = ends - j
                        r[cut[(cut >= 0) & (cut < starts)]] = -np.inf
                begin = first[:-1][enough]
                best = np.maximum.reduceat(r, begin)
                top[enough] = np.maximum(best, 0)
                if places:
                    size = np.diff(np.append(begin, starts))
                    for f in range(FILTERS):
                        hit = np.flatnonzero(r[:, f] == np.repeat(best[:, f], size) if begin[0] == 0 else r[begin[0] :, f] == np.repeat(best[:, f], size)) + (begin[0] if begin[0] else 0)
                        at[enough, f] = hit[np.searchsorted(hit, begin)]
                        at[top[:, f] <= 0, f] = -1
            out.append(top)
            where.append(at)
        return (np.concatenate(out, axis=1), where, x, rows) if places else np.concatenate(out, axis=1)

    def logits(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(h, first) @ self.weights + self.bias

    def scores(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        z = (self.logits(h, first) - self.thresholds[languages(h, first, self.language_table)]) * self.sharpness
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _start(texts: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> Network:
    """Word rows from the share of toxic texts among those with a word of that row."""
    base = labels.mean()
    tables = []
    for k in range(3):
        seen, toxic = np.zeros(ROWS), np.zeros(ROWS)
        for h, y in zip(texts, labels, strict=True):
            r = np.unique(rows_of(h)[k])
            seen[r] += 1
            toxic[r] += y
        share = (toxic + PRIOR * base) / (seen + PRIOR)
        t = np.zeros((ROWS, DEPTH), np.float32)
        t[:, 0] = (np.log(share / (1 - share)) - np.log(base / (1 - base))) / 3
        tables.append(t)
    filters = [rng.normal(0, 0.1, (w, DEPTH, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w in filters:
        w[:, 0, :] = np.abs(w[:, 0, :]) + 0.5 / len(w)
    return Network(tables, filters, [np.full(FILTERS, -0.5, np.float32) for _ in WIDTHS], np.full(len(WIDTHS) * FILTERS, 0.3, np.float32), float(np.log(base / (1 - base))))


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Network:
    """Fit on word-hash sequences; without both labels the score is the share of label 1."""
    labels = np.asarray(labels, np.float32)
    rng = np.random.default_rng(seed)
    if not len(labels) or labels.min() == labels.max():
        share = min(max(float(labels.mean()) if len(labels) else 0.0, 0.01), 0.99)
        net = Network([np.zeros((ROWS, DEPTH), np.float32)] * 3, [np.zeros((w, DEPTH, FILTERS), np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, np.float32), float(np.log(share / (1 - share))))
        return net
    order = rng.permutation(len(labels))
    aside = order[: len(order) // 4]
    rest = order[len(order) // 4 :]
    if labels[rest].min() == labels[rest].max():
        aside = rest = order
    net = _start([texts[i] for i in rest], labels[rest], rng)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch)
        for at in range(0, len(rest), BATCH):
            part = rest[at : at + BATCH]
            _step(net, [texts[i] for i in part], labels[part], rate)
        rest = rng.permutation(rest)
    _calibrate(net, [texts[i] for i in aside], labels[aside])
    return net


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.uint64), *texts]), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _step(net: Network, texts: list[np.ndarray], labels: np.ndarray, rate: float) -> None:
    h, first = _joined(texts)
    top, where, x, rows = net.pooled(h, first, places=True)
    p = 1 / (1 + np.exp(-np.clip(top @ net.weights + net.bias, -30, 30)))
    err = (p - labels).astype(np.float32) / len(labels)
    back = err[:, None] * net.weights[None, :]
    net.weights -= rate * (err @ top)
    net.bias -= rate * float(err.sum())
    for k, (width, at) in enumerate(zip(WIDTHS, where, strict=True)):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        doc, f = np.nonzero(at >= 0)
        if not len(doc):
            continue
        place, grad = at[doc, f], g[doc, f]
        for j in range(width):
            into = x[place + j]
            down = grad[:, None] * net.filters[k][j][:, f].T
            np.add.at(net.filters[k][j].T, f, -rate * grad[:, None] * into)
            for t, r in zip(net.tables, rows, strict=True):
                np.add.at(t, r[place + j], -rate * len(labels) * down)
        np.add.at(net.biases[k], f, -rate * grad)


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the least errors, missed ones counting ``MISSED`` times, a third into its gap."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    errors = MISSED * np.concatenate([[0], np.cumsum(y)]) + (1 - y).sum() - np.concatenate([[0], np.cumsum(1 - y)])
    best = np.flatnonzero(errors == errors.min())
    k = best[len(best) // 2]
    lo, hi = z[max(k - 1, 0)], z[min(k, len(z) - 1)]
    return float(lo + 0.35 * (hi - lo)) if 0 < k < len(z) else float(z[-1] + 1 if k else z[0] - 1)


def _calibrate(net: Network, texts: list[np.ndarray], labels: np.ndarray) -> None:
    z, language = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for at in range(0, len(texts), BATCH):
        h, first = _joined(texts[at : at + BATCH])
        z[at : at + BATCH], language[at : at + BATCH] = net.logits(h, first), languages(h, first, net.language_table)
    net.thresholds[:] = _best_cut(z, labels) if labels.min() < labels.max() else 0.0
    for code in range(len(LANGUAGES)):
        own = language == code
        if labels[own].sum() >= MINPOS and (1 - labels[own]).sum() >= MINPOS:
            net.thresholds[code] = _best_cut(z[own], labels[own])
    spread = np.abs(z - net.thresholds[language])
    net.sharpness = 2.0 / max(float(np.median(spread)), 1e-3)


def fitting(sizes: list[int], budget: int) -> list[bool]:
    """Which texts of these lengths fit into the budget, in order, each that doesn't being passed over.

    Texts of more than 1/``SHARE`` of the budget come last, so that none of them displaces others.
    """
    keep, left = [False] * len(sizes), budget
    for long in (False, True):
        for i, n in enumerate(sizes):
            if (n * SHARE > budget) == long and n <= left:
                keep[i] = True
                left -= n
    return keep


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Train on at most ``sample`` labelled rows of ``docs``; only hashes of their words reach the driver.

    Every text is kept whole; in the order of their id's hash, texts that don't fit into what is
    left of ``SAMPLE_WORDS`` words are left out of the sample, and the next ones are tried.  Only
    lengths are collected before that is settled.  Of rows with one doc_id the text with the smallest word hashes is used.
    """
    ids = F.broadcast(training_ids(docs, labels, "toxic", sample))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h, _, _, first = words(*utf8(batch.column(1)), LETTERS)
            own = [h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(own, pa.binary())], ["doc_id", "label", "words"])

    rows = docs.select("doc_id", "text").join(ids, "doc_id").select("doc_id", "text", "label").mapInArrow(tidy(kernel), "doc_id long, label int, words binary")
    rows = cut(rows.groupBy("doc_id", "label").agg(F.min("words").alias("words")))
    order = sorted(rows.select("doc_id", F.expr("octet_length(words) div 8").alias("n")).collect(), key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFF, r["doc_id"]))
    keep = [r["doc_id"] for r, fits in zip(order, fitting([r["n"] for r in order], SAMPLE_WORDS), strict=True) if fits]
    place = {doc_id: i for i, doc_id in enumerate(keep)}
    fitted = docs.sparkSession.createDataFrame([(i,) for i in keep], "doc_id long")
    wanted = rows if len(keep) == len(order) else rows.join(F.broadcast(fitted), "doc_id", "left_semi")
    got = sorted(wanted.collect(), key=lambda r: place[r["doc_id"]])
    texts = [np.frombuffer(r["words"], np.uint64) for r in got]
    return train(texts, np.array([r["label"] for r in got]))


def _batch_scores(net: Network, batch: pa.RecordBatch, column: int) -> np.ndarray:
    h, _, _, first = words(*utf8(batch.column(column)), LETTERS)
    return net.scores(h, first).astype(np.float64)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; texts are read whole.

    Null and empty texts get the score of a text without words.  Repeated rows each get their
    row; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = _batch_scores(shared.value, batch, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])

    rows = docs.select("doc_id", "text").mapInArrow(tidy(kernel), "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", F.expr("cast(score >= 0.5 as int)").alias("predicted"))


def keep_clean(docs: DataFrame, net: Network, threshold: float = 0.5) -> DataFrame:
    """The rows with a score below ``threshold``, columns as they are; a filter where the rows lie.

    Scores are those of ``score``, so null and empty texts are decided as a text without words;
    repeated rows are decided alike, whatever else their columns hold.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(_batch_scores(shared.value, batch, batch.schema.get_field_index("text")) < threshold))

    return docs.mapInArrow(tidy(kernel), docs.schema)
