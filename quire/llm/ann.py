"""Approximate largest inner products by a hierarchical k-means tree searched best bin first.

A coordinate that lifts every vector to the longest one's length turns the largest inner
product into the smallest distance.  The tree is fitted on a bounded sample of vectors and every
vector is filed under one leaf.  A query walks the tree with a priority queue, always opening
the nearest node not yet opened, and so meets leaves in the order of promise.  How many leaves
are visited is calibrated: for some queries the exact neighbours are computed over all vectors,
and visits widen until the wanted share of these neighbours lies in leaves that were visited.

Exact copies of a vector are told by a 128-bit hash.  Only the k + 1 smallest ids of a group of
copies can be among anyone's k nearest, so no more are filed, and copies among the queries are
searched once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import batches_of, cut, tidy

#: Values (rows x width) of the sample that the tree is fitted on, at most.
SAMPLE_VALUES = 4_000_000
#: Vectors a leaf should hold, sampled vectors a leaf needs, children of a node, rounds of k-means.
LEAF, LEAST, BRANCH, ROUNDS = 256, 16, 16, 8
#: Queries whose exact neighbours set the number of visits, and the share of these to be found.
CALIBRATED, RECALL = 256, 0.95
#: Leaves that give a query its floor before it visits the others.
FIRST = 16
#: Vectors of a leaf's block, queries of a block.
BLOCK, QUERIES = 1024, 256
#: Rows of one hash class that go to one task.
SHARE = 4096


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v) in doubles; rows with a null id and vectors that are null, zero or hold null or non-finite components are left out."""
    e = F.col(embedding)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.where(F.col(vec_id).isNotNull() & e.isNotNull() & fine & F.exists(e, lambda x: x != 0))
    return rows.select(F.col(vec_id).cast("long").alias("id"), e.cast("array<double>").alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; shorter ones are filled up with zeros."""
    flat, size = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row inner products, added up from the first component to the last, so that equal vectors score alike everywhere."""
    total = np.zeros(len(x))
    for d in range(q.shape[-1]):
        total += q[..., d] * x[:, d]
    return total


@dataclass
class Tree:
    """Nodes by number: ``center``, ``children`` (none for a leaf) and ``leaf`` (its number, -1 inside); ``longest`` of all vectors."""

    center: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray
    longest: float

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(0.0, self.longest**2 - (x * x).sum(axis=1))
        return np.hstack([x, np.sqrt(rest)[:, None]])

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to all nodes' centers, less the vector's own square."""
        return (self.center * self.center).sum(axis=1)[None, :] - 2 * x @ self.center.T

    def file(self, x: np.ndarray) -> np.ndarray:
        """Each vector's leaf: down from the root to the nearest child."""
        far, at = self.distances(self.lifted(x)), np.zeros(len(x), np.int64)
        out = np.full(len(x), -1)
        open_ = np.arange(len(x))
        while len(open_):
            node = at[open_]
            for k in np.unique(node):
                own = open_[node == k]
                if self.leaf[k] >= 0:
                    out[own] = self.leaf[k]
                else:
                    at[own] = self.children[k][np.argmin(far[np.ix_(own, self.children[k])], axis=1)]
            open_ = open_[out[open_] < 0]
        return out

    def visits(self, q: np.ndarray, counts: np.ndarray, many: int, rows: int) -> list[list[int]]:
        """Leaves of each query, best bin first: at least ``many``, and until they hold ``rows`` vectors."""
        scale = self.longest / np.sqrt((q * q).sum(axis=1))
        far = self.distances(np.hstack([q * scale[:, None], np.zeros((len(q), 1))]))
        out = []
        for distance in far:
            queue, seen, held = [(float(distance[0]), 0)], [], 0
            while queue and (len(seen) < many or held < rows):
                _, node = heapq.heappop(queue)
                if (leaf := int(self.leaf[node])) >= 0:
                    seen.append(leaf)
                    held += int(counts[leaf])
                else:
                    for child in self.children[node]:
                        heapq.heappush(queue, (float(distance[child]), int(child)))
            out.append(seen)
        return out


def _clusters(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means: each row's cluster; far-apart rows begin it."""
    center = x[rng.integers(len(x))][None, :]
    least = ((x - center) ** 2).sum(axis=1)
    while len(center) < k and least.max() > 0:
        pick = x[rng.choice(len(x), p=least / least.sum())][None, :]
        center = np.vstack([center, pick])
        least = np.minimum(least, ((x - pick) ** 2).sum(axis=1))
    for _ in range(ROUNDS):
        own = np.argmin((center * center).sum(axis=1)[None, :] - 2 * x @ center.T, axis=1)
        for c in np.unique(own):
            center[c] = x[own == c].mean(axis=0)
    return np.argmin((center * center).sum(axis=1)[None, :] - 2 * x @ center.T, axis=1)


def grow(sample: np.ndarray, longest: float, leaf_rows: float, seed: int = 5) -> Tree:
    """A tree over the sample whose leaves hold about ``leaf_rows`` of its rows."""
    rng = np.random.default_rng(seed)
    tree = Tree(np.zeros((0, sample.shape[1] + 1)), [], np.zeros(0, np.int64), longest)
    x = tree.lifted(sample)
    center, children, leaf, leaves = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])], [np.zeros(0, np.int64)], [-1], 0
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        parts = []
        if len(rows) > leaf_rows:
            own = _clusters(x[rows], int(min(BRANCH, max(2, -(-len(rows) // leaf_rows)))), rng)
            parts = [rows[own == c] for c in np.unique(own)]
        if len(parts) < 2:  # small enough, or all rows are equal
            leaf[node], leaves = leaves, leaves + 1
            continue
        children[node] = np.arange(len(center), len(center) + len(parts))
        for part in parts:
            todo.append((len(center), part))
            center.append(x[part].mean(axis=0))
            children.append(np.zeros(0, np.int64))
            leaf.append(-1)
    return Tree(np.array(center), children, np.array(leaf), longest)


def _distinct(vectors: DataFrame, keep: int) -> DataFrame:
    """(id, v, h1, h2): one row an id, and of copies only the ``keep`` smallest ids.

    Only ids and hashes travel to decide; a group of copies is cut by a hash of the id first.
    """
    hashed = vectors.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"))
    names = hashed.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("id", "h.h1", "h.h2")
    for by in ((F.col("h1"), F.col("h2"), F.pmod(F.xxhash64("id"), F.lit(64))), (F.col("h1"), F.col("h2"))):
        names = names.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("nth") <= keep).drop("nth")
    return hashed.join(names, ["id", "h1", "h2"], "left_semi").dropDuplicates(["id", "h1", "h2"])


def _asked(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal queries (id, v, n) named by their smallest id, and the members (query_id, id, part)."""
    hashed = queries.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"))
    names = hashed.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("id", "h.h1", "h.h2")
    classes = names.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    vectors = hashed.join(classes.withColumnRenamed("first", "id"), ["id", "h1", "h2"]).dropDuplicates(["id"])
    members = names.join(classes, ["h1", "h2"]).select(F.col("id").alias("query_id"), F.col("first").alias("id"), F.pmod(F.xxhash64("id"), _parts()).alias("part"))
    return cut(vectors.select("id", "v", "n")), members


def _parts(n="n"):
    """Into how many parts a class of n rows is dealt."""
    return F.ceil(F.col(n) / SHARE).cast("long")


def _dealt(df: DataFrame, counts: dict[int, int], size: int) -> DataFrame:
    """Adds ``part``: leaves with more rows than ``size`` are dealt to parts by a hash of the id; there are a few thousand leaves."""
    parts = {leaf: -(-n // size) for leaf, n in counts.items() if n > size}
    if not parts:
        return df.withColumn("part", F.lit(0).cast("long"))
    known = df.sparkSession.createDataFrame(list(parts.items()), "leaf int, parts long")
    return df.join(F.broadcast(known), "leaf", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))).drop("parts")


def _packed(rows: DataFrame, size: int, width: int, floors: bool) -> DataFrame:
    """Rows of one leaf and part as blocks of at most ``size``: (leaf, part, ids, v[, floors]) in bytes."""
    names = ["leaf", "part", "ids", "v"] + ["floors"] * floors

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def block() -> pa.RecordBatch:
            ids, v, floor = (np.concatenate(x) for x in zip(*held, strict=True))
            arrays = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays + [pa.array([floor.tobytes()], pa.binary())] * floors, names)

        for batch in batches:
            leaf, part, ids = (batch.column(c).to_numpy() for c in range(3))
            v, floor = matrix(batch.column(3), width), batch.column(4).to_numpy() if floors else np.zeros(len(ids))
            new = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(part) != 0)) + 1
            for lo, hi in zip(np.append(0, new), np.append(new, len(ids)), strict=True):
                while lo < hi:
                    here = (int(leaf[lo]), int(part[lo]))
                    room = size - sum(len(x[0]) for x in held)
                    if held and (here != key or room == 0):
                        yield block()
                        held, room = [], size
                    key, to = here, min(hi, lo + room)
                    held.append((ids[lo:to], v[lo:to], floor[lo:to]))
                    lo = to
        if held:
            yield block()

    rows = rows.select("leaf", "part", "id", "v", *["floor"] * floors).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "id")
    return rows.mapInArrow(kernel, "leaf int, part long, ids binary, v binary" + ", floors binary" * floors)


def _hits(q: np.ndarray, x: np.ndarray, scores: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, exact score) of all rows that reach their query's floor and, ties apart, are among its k best; ``scores`` are near the exact ones."""
    slack = 1e-9 * np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max(initial=0.0))
    reach = scores >= (floors - slack)[:, None]
    if scores.shape[1] > k and reach.sum() > 4 * k * len(q):
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        reach = scores >= (np.maximum(floors, edge) - 2 * slack)[:, None]
    who, which = np.nonzero(reach)
    exact = products(q[who], x[which])
    fine = exact >= floors[who]
    return who[fine], which[fine], exact[fine]


def exact_neighbours(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """(query_id, id, leaf, score): the k exact nearest among all ``rows`` (id, leaf, v) of a bounded set of queries."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, q))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        for batch in batches:
            there, leaf, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), q.shape[1])
            scores = q @ x.T
            scores[own[:, None] == there[None, :]] = -np.inf
            who, which, exact = _hits(q, x, scores, np.full(len(q), -1e299), k)
            yield pa.RecordBatch.from_arrays([pa.array(own[who]), pa.array(there[which]), pa.array(leaf[which]), pa.array(exact)], ["query_id", "id", "leaf", "score"])

    with batches_of(rows.sparkSession, 65_536, "32m"):
        found = cut(rows.select("id", "leaf", "v").mapInArrow(tidy(kernel), "query_id long, id long, leaf int, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")


@dataclass
class Index:
    """Every vector under its leaf: ``rows`` (id, leaf, v) on disk, the tree, and how many vectors each leaf holds."""

    rows: DataFrame
    tree: Tree
    counts: dict[int, int]
    width: int

    def sizes(self) -> np.ndarray:
        out = np.zeros(self.tree.leaves, np.int64)
        out[list(self.counts)] = list(self.counts.values())
        return out


def build(vectors: DataFrame, k: int, leaf: int = LEAF, sample_values: int = SAMPLE_VALUES) -> Index:
    """Files every vector (id, v) under a leaf of a tree fitted on at most ``sample_values`` values, chosen by a hash of the id.

    Of exact copies only the k + 1 smallest ids are filed: the others can't be among any k nearest.
    An index of no vectors has one empty leaf.
    """
    spark = vectors.sparkSession
    rows = cut(_distinct(vectors, k + 1).select("id", "v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    known = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w"), F.max(square).alias("m")).first()
    n, width, longest = known["n"], max(1, known["w"] or 1), float(np.sqrt(known["m"] or 1.0))
    limit = max(1, sample_values // width)
    some = rows.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, limit / max(1, n)))).limit(limit).select("v").toArrow()
    sample = np.vstack([np.zeros((0, width)), *(matrix(c, width) for c in some.column(0).chunks)])
    tree = grow(sample, longest, max(LEAST, leaf * len(sample) / max(1, n)))
    shared = spark.sparkContext.broadcast(tree)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shared.value.file(matrix(batch.column(1), width)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), batch.column(1)], ["id", "leaf", "v"])

    with batches_of(spark, 4096):
        filed = cut(rows.mapInArrow(tidy(kernel), "id long, leaf int, v array<double>"))
    return Index(filed, tree, {r["leaf"]: r["count"] for r in filed.groupBy("leaf").count().collect()}, width)


def calibrate(index: Index, queries: DataFrame, k: int, recall: float = RECALL, many: int = CALIBRATED) -> tuple[int, float]:
    """(leaf visits, recall at that many) over at most ``many`` queries (id, v), chosen by a hash of their ids.

    Visits widen until the share of the exact k nearest that lie in visited leaves reaches ``recall``.
    """
    some = queries.orderBy(F.xxhash64(F.lit(11), "id"), "id").limit(many).select("id", "v").toArrow()
    if not some.num_rows or not index.counts:
        return 1, 1.0
    ids = some.column(0).to_numpy()
    q = np.vstack([matrix(c, index.width) for c in some.column(1).chunks])
    true = exact_neighbours(index.rows, ids, q, k).collect()
    order = index.tree.visits(q, index.sizes(), index.tree.leaves, 0)
    turn = {i: {leaf: t for t, leaf in enumerate(seen, 1)} for i, seen in zip(ids.tolist(), order, strict=True)}
    needed = np.sort([turn[r["query_id"]][r["leaf"]] for r in true])
    if not len(needed):
        return 1, 1.0
    visits = int(needed[int(np.ceil(recall * len(needed))) - 1])
    return visits, float((needed <= visits).mean())


def _meet(asked: DataFrame, blocks: DataFrame, width: int, k: int) -> DataFrame:
    """(id, vec_id, score): of every block of a leaf about the k best for each query that visits the leaf, if they reach its floor."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, q, floors, ids, x = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in enumerate((np.int64, float, float, np.int64, float)))
                q, x = q.reshape(-1, width), x.reshape(-1, width)
                who, which, exact = _hits(q, x, q @ x.T, floors, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[who]), pa.array(ids[which]), pa.array(exact)], ["id", "vec_id", "score"])

    both = asked.select("leaf", F.col("ids").alias("q_ids"), F.col("v").alias("q"), "floors").join(blocks.select("leaf", "ids", "v"), "leaf")
    with batches_of(asked.sparkSession, 8):
        return cut(both.select("q_ids", "q", "floors", "ids", "v").mapInArrow(tidy(kernel), "id long, vec_id long, score double"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products among the vectors found.

    ``vectors`` and ``queries`` are (id, v) as ``usable`` makes them.  A query never finds rows of
    its own id; ties go to the smaller id; rows that repeat an id count once (of different vectors
    under one id that of the least hash); a query gets all candidates if these are fewer than k and
    no row if there are none; shorter vectors count as filled up with zeros.  Scores are exact.
    """
    spark = vectors.sparkSession
    index = build(vectors, k)
    classes, members = _asked(queries)
    visits, _ = calibrate(index, classes, k, recall)
    width, sizes = index.width, index.sizes()
    shared = spark.sparkContext.broadcast((index.tree, sizes))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, sizes = shared.value
        for batch in batches:
            seen = tree.visits(matrix(batch.column(1), width), sizes, visits, k + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(seen, pa.list_(pa.int32()))], ["id", "v", "leaves"])

    with batches_of(spark, 512):
        routed = cut(classes.select("id", "v").mapInArrow(tidy(route), "id long, v array<double>, leaves array<int>"))
    with batches_of(spark, 4096):
        blocks = cut(_packed(_dealt(index.rows, index.counts, BLOCK), BLOCK, width, False))

    def visited(rows: DataFrame) -> DataFrame:
        counts = {r["leaf"]: r["count"] for r in rows.groupBy("leaf").count().collect()}
        with batches_of(spark, 4096):
            return _meet(cut(_packed(_dealt(rows, counts, 16 * QUERIES), QUERIES, width, True)), blocks, width, k + 1)

    # The first leaves give each query a floor, its k + 1st best score there.
    first = visited(routed.select("id", "v", F.explode(F.slice("leaves", 1, FIRST)).alias("leaf"), F.lit(-1e299).alias("floor")))
    best = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    floors = first.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k + 1).select("id", F.col("score").alias("floor"))
    later = routed.join(floors, "id", "left").select("id", "v", F.explode(F.slice("leaves", FIRST + 1, 1 << 30)).alias("leaf"), F.coalesce("floor", F.lit(-1e299)).alias("floor"))
    found = first.unionByName(visited(later))
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    lists = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("list"))
    dealt = lists.join(classes.select("id", "n"), "id").select("id", "list", F.explode(F.sequence(F.lit(0).cast("long"), _parts() - 1)).alias("part"))
    own = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return members.join(dealt, ["id", "part"]).select("query_id", F.posexplode(own).alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
