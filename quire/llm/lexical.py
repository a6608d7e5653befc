"""Exact ranked lexical search with per-term geometric blocking.

Each document becomes a vector over the query table's terms.  Documents are searched in shards,
each in the task that reads it.  There a term's posting list is clustered by the similarity of
its documents (products with documents picked from the list, in a random projection), cut
into blocks, and each block gets a summary: the largest value of every coordinate among its
documents.  A query's product with the summary bounds its score with any document of the
block, so a block is opened only if that bound reaches the score of the query's k-th best
document so far; opened documents are scored in full.  Lists are taken from the rarest term to
the most frequent; a query stops at the list from which on all its terms together can't reach
that score, and a list that no query needs is never blocked.

A sixteenth of the documents is searched first; its k-th best scores are where the others begin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.shared import batches_of, cut, fresh_folder, removed, tidy
from quire.llm.text import ALNUM, slices, utf8, words

#: Query terms (one for each query that has it) that one pass over the documents looks for.
PART = 50_000
#: Documents of a shard, of a block, and documents picked from a list that its clusters form around.
SHARD, BLOCK, PICKED = 8192, 64, 64
#: Axes of the random projection in which documents are compared.
AXES = 32
#: One of so many documents belongs to those searched first.
FIRST = 16
#: Stands for the id of a document that has none, so that it comes last among equals.
NAMELESS = np.iinfo(np.int64).max


def query_rows(items: DataFrame) -> DataFrame:
    """(query, item_id, term, times): the terms of each row of ``items``, as 64-bit hashes; rows are numbered, so repeated ids stay apart."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h, _, _, first = words(*utf8(batch.column(2)), ALNUM)
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            both, times = np.unique(np.stack([row.astype(np.uint64), h]), axis=1, return_counts=True)
            at = pa.array(both[0].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(both[1].view(np.int64)), pa.array(times)], ["query", "item_id", "term", "times"])

    rows = items.select(F.monotonically_increasing_id().alias("query"), F.col("item_id").cast("long").alias("item_id"), "text")
    return cut(rows.mapInArrow(tidy(kernel), "query long, item_id long, term long, times long"))


def forward_rows(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(doc_id, n, at, tf): each text's number of words, and which of the sorted ``terms`` it holds how often; texts without words are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        for batch in slices(batches, "text"):
            h, _, _, first = words(*utf8(batch.column(1)), ALNUM)
            at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
            known = np.flatnonzero(terms[at] == h)
            row = np.searchsorted(first, known, "right") - 1
            key, tf = np.unique(row * len(terms) + at[known], return_counts=True)
            ends = np.searchsorted(key, np.arange(batch.num_rows + 1) * len(terms)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % len(terms), tf)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), *lists], ["doc_id", "n", "at", "tf"])
            yield out.filter(pa.array(np.diff(first) > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(kernel), "doc_id long, n long, at array<int>, tf array<int>")


@dataclass
class Queries:
    """The queries of a pass: ids, and each one's terms (numbers in the vocabulary, rarest first) with whole weights."""

    number: np.ndarray
    item_id: list[int | None]
    terms: list[np.ndarray]
    weights: list[np.ndarray]
    rarity: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table, vocabulary: np.ndarray, df: np.ndarray, n: int) -> Queries:
        """``rows`` as ``query_rows`` makes them; terms that no document holds don't matter."""
        idf = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
        query, term, times = (rows.column(c).to_numpy() for c in ("query", "term", "times"))
        at = np.searchsorted(vocabulary, term.copy().view(np.uint64))
        rarity = np.argsort(df, kind="stable")
        place = np.empty(len(df), np.int64)
        place[rarity] = np.arange(len(df))
        number, first = np.unique(query, return_index=True)
        item_id = [rows.column("item_id")[int(i)].as_py() for i in first]
        terms, weights = [], []
        for q in number:
            own = np.flatnonzero((query == q) & (df[at] > 0))
            own = own[np.argsort(place[at[own]])]
            terms.append(at[own])
            weights.append(times[own] * idf[at[own]])
        return cls(number, item_id, terms, weights, rarity)

    def by_term(self) -> dict[int, list[tuple[int, int]]]:
        """For each term its queries, with the term's place in the query."""
        out: dict[int, list[tuple[int, int]]] = {}
        for q, terms in enumerate(self.terms):
            for j, t in enumerate(terms.tolist()):
                out.setdefault(t, []).append((q, j))
        return out


def _ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers lo, lo + 1, ... of all ranges, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(lo - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class Shard:
    """Documents as sparse vectors: ``ids`` (for order), and of each the terms it holds with their values."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, terms: np.ndarray, values: np.ndarray, vocabulary: int):
        self.ids, self.ends, self.terms, self.values, self.vocabulary = ids, ends, terms, values, vocabulary
        self.row = np.repeat(np.arange(len(ids)), np.diff(ends))
        order = np.argsort(terms, kind="stable")
        self.listed = self.row[order]
        self.lists = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        self.most = np.zeros(vocabulary, np.int64)
        np.maximum.at(self.most, terms, values)
        self.scored = self.skipped = 0
        self._sketch: np.ndarray | None = None

    def sketch(self) -> np.ndarray:
        """Directions of the documents in a random projection."""
        if self._sketch is None:
            turn = np.random.default_rng(9).standard_normal((AXES, self.vocabulary))
            out = np.stack([np.bincount(self.row, self.values * axis[self.terms], len(self.ids)) for axis in turn], axis=1)
            self._sketch = out / np.maximum(np.sqrt((out * out).sum(axis=1)), 1e-9)[:, None]
        return self._sketch

    def blocks(self, term: int, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents of the list, ends of its blocks among them, summary of each block over ``columns``)."""
        rows = self.listed[self.lists[term] : self.lists[term + 1]]
        ends = np.array([0, len(rows)])
        if len(rows) > BLOCK:
            space = self.sketch()
            picked = rows[np.linspace(0, len(rows) - 1, min(PICKED, -(-len(rows) // BLOCK))).astype(np.int64)]
            own = np.argmax(space[rows] @ space[picked].T, axis=1)
            order = np.argsort(own, kind="stable")
            rows = rows[order]
            sizes = np.bincount(own)
            sizes = sizes[sizes > 0]
            pieces = -(-sizes // BLOCK)
            starts = np.repeat(np.cumsum(sizes) - sizes, pieces) + BLOCK * _ranges(np.zeros(len(sizes), np.int64), pieces)
            ends = np.append(starts, len(rows))
        column = np.full(self.vocabulary, -1)
        column[columns] = np.arange(len(columns))
        size = self.ends[rows + 1] - self.ends[rows]
        at = _ranges(self.ends[rows], size)
        block = np.repeat(np.repeat(np.arange(len(ends) - 1), np.diff(ends)), size)
        c = column[self.terms[at]]
        summary = np.zeros((len(ends) - 1, len(columns)))
        np.maximum.at(summary, (block[c >= 0], c[c >= 0]), self.values[at[c >= 0]].astype(float))
        return rows, ends, summary

    def scores(self, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of the documents for the query whose weights by term are given."""
        self.scored += len(rows)
        size = self.ends[rows + 1] - self.ends[rows]
        at = _ranges(self.ends[rows], size)
        sums = np.append(0, np.cumsum(weight[self.terms[at]] * self.values[at]))
        last = np.cumsum(size)
        return sums[last] - sums[last - size]

    def search(self, queries: Queries, floors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (documents, scores): the k best of those that score above 0 and at least its floor."""
        n, by_term = len(queries.terms), queries.by_term()
        floors = np.maximum(floors, 1)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
        seen: list[np.ndarray | None] = [None] * n
        # The most that a query can get from its j-th term on.
        left = [np.cumsum((w * self.most[t])[::-1])[::-1] for t, w in zip(queries.terms, queries.weights, strict=True)]
        weight = np.zeros(self.vocabulary, np.int64)
        for term in queries.rarity.tolist():
            if self.lists[term] == self.lists[term + 1]:
                continue
            asking = [(q, j) for q, j in by_term.get(term, []) if left[q][j] >= floors[q]]
            if not asking:
                continue
            columns = np.unique(np.concatenate([queries.terms[q][j:] for q, j in asking]))
            rows, ends, summary = self.blocks(term, columns)
            for q, j in asking:
                # Documents with one of the query's earlier terms have been scored or ruled out, so those terms don't count.
                bound = summary[:, np.searchsorted(columns, queries.terms[q][j:])] @ queries.weights[q][j:].astype(float) * (1 + 1e-12)
                order = np.argsort(-bound, kind="stable")
                weight[queries.terms[q]] = queries.weights[q]
                if seen[q] is None:
                    seen[q] = np.zeros(len(self.ids), bool)
                at, step = 0, 2
                while at < len(order) and bound[order[at]] >= floors[q]:
                    some = order[at : at + step]
                    some = some[bound[some] >= floors[q]]
                    at, step = at + len(some), 2 * step
                    found = rows[_ranges(ends[some], ends[some + 1] - ends[some])]
                    found = found[~seen[q][found]]
                    seen[q][found] = True
                    score = self.scores(found, weight)
                    fine = score >= floors[q]
                    who, score = np.append(best[q][0], found[fine]), np.append(best[q][1], score[fine])
                    keep = np.lexsort((self.ids[who], -score))[:k]
                    best[q] = (who[keep], score[keep])
                    if len(keep) == k:
                        floors[q] = max(floors[q], score[keep[-1]])
                self.skipped += len(order) - at
                weight[queries.terms[q]] = 0
        return best


def _searched(spark: SparkSession, forward: DataFrame, queries: Queries, n: int, words_: int, vocabulary: int, floors: np.ndarray, k: int) -> DataFrame:
    """(query, item_id, doc_id, score): the best of each shard that reach the floors."""
    shared = spark.sparkContext.broadcast((queries, floors))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, floors = shared.value
        for batch in batches:
            length, tf = batch.column(1).to_numpy(), batch.column(3).flatten().to_numpy().astype(np.int64)
            ends = np.append(0, np.cumsum(batch.column(2).value_lengths().to_numpy())).astype(np.int64)
            m = 25 + 75 * length * n // words_
            values = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(ends)))
            ids = batch.column(0)
            shard = Shard(ids.fill_null(NAMELESS).to_numpy(), ends, batch.column(2).flatten().to_numpy().astype(np.int64), values, vocabulary)
            for q, (who, score) in enumerate(shard.search(queries, floors.copy(), k)):
                if len(who):
                    item = pa.array([queries.item_id[q]] * len(who), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), queries.number[q])), item, ids.take(pa.array(who)), pa.array(score)], ["query", "item_id", "doc_id", "score"])

    with batches_of(spark, SHARD, "16m"):
        return cut(forward.select("doc_id", "n", "at", "tf").mapInArrow(tidy(kernel), "query long, item_id long, doc_id long, score long"))


def _best(found: DataFrame, k: int) -> DataFrame:
    """Adds ``rank`` and keeps k rows a query; a query's rows are cut by a hash first, so that no task sees all of them."""
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    parted = Window.partitionBy("query", F.pmod(F.xxhash64("doc_id", "at"), F.lit(64))).orderBy(*order)
    found = found.withColumn("at", F.monotonically_increasing_id()).withColumn("rank", F.row_number().over(parted)).where(F.col("rank") <= k)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).drop("at")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, part: int = PART) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents with the highest scores above 0, equal ones by smaller id, null ids last.

    Terms are longest runs of ASCII letters, digits and all beyond ASCII, A-Z lower-cased.  Null
    and empty texts hold none: such documents count in no statistic and such items have no
    rows.  Repeated rows of ``docs`` are documents of their own; repeated rows of ``items`` are
    ranked each; other columns aren't read.  The items' terms are broadcast in passes of about
    ``part`` (one item's are held whole), each pass reading the documents once.
    """
    spark = docs.sparkSession
    rows = query_rows(items)
    passes, out = max(1, -(-rows.count() // part)), None
    for p in range(passes):
        own = rows.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == p).toArrow()
        if not own.num_rows:
            continue
        vocabulary = np.unique(own.column("term").to_numpy().copy().view(np.uint64))
        at = fresh_folder(spark, "forward")
        try:
            forward_rows(docs, vocabulary).write.parquet(at)
            forward = spark.read.parquet(at)
            total = forward.agg(F.count("*").alias("n"), F.sum("n").alias("words")).first()
            if not total["n"]:
                continue
            df = np.zeros(len(vocabulary), np.int64)
            for r in forward.select(F.explode("at").alias("at")).groupBy("at").count().collect():
                df[r["at"]] = r["count"]
            queries = Queries.of(own, vocabulary, df, total["n"])
            early = F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST)) == 0
            know = (queries, total["n"], total["words"], len(vocabulary))
            first = _best(_searched(spark, forward.where(early), *know, np.zeros(len(queries.number), np.int64), k), k)
            reached = {r["query"]: r["score"] for r in first.where(F.col("rank") == k).select("query", "score").collect()}
            floors = np.array([reached.get(q, 0) for q in queries.number.tolist()], np.int64)
            found = cut(_best(first.drop("rank").unionByName(_searched(spark, forward.where(~early), *know, floors, k)), k))
            out = found if out is None else out.unionByName(found)
        finally:
            removed(spark, at)
    if out is None:
        out = spark.createDataFrame([], "query long, item_id long, doc_id long, score long, rank int")
    return out.select("item_id", "rank", "doc_id", "score")
