"""Exact top-k inner products over blocks of vectors in order of length.

Candidates are sorted by length into range partitions and cut into blocks; queries are cut
into blocks as well.  The block of the longest vectors gives every query a first threshold,
its k-th best score there.  By Cauchy-Schwarz a block whose longest vector times the query's
length stays below the threshold holds no result, so each block of queries only meets the
groups of blocks before that point.  Within a meeting, vectors are rotated to the axes of
the singular value decomposition: the product over the leading axes plus the product of the
remaining lengths bounds the score, and only vectors that some query can't rule out are
multiplied in full, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import cut

#: Vectors in a block of candidates and of queries; blocks of a group; blocks of queries that meet a group in one task.
BLOCK, QUERIES, GROUP, TOGETHER = 2048, 512, 4, 1024
#: Share of the axes that the partial sums cover.
LEADING = 0.25


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """(id, v) with floor(scale * x) of each component as a double; rows that are null or hold null or non-finite components are left out."""
    e: Column = F.col(embedding)
    good = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return df.where(good & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; shorter ones are filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all rows, by their sum of outer products; only width x width numbers move."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column(0), width)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width)
        for batch in batches:
            for g in batch.column(0):
                total += np.frombuffer(g.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

    rows = vectors.select("v").mapInArrow(gram, "g binary").repartition(16).mapInArrow(add, "g binary").collect()
    total = sum((np.frombuffer(r["g"]) for r in rows), np.zeros(width * width)).reshape(width, width)
    scale = max(1.0, float(np.abs(total).max()))
    return np.ascontiguousarray(np.linalg.eigh(total / scale)[1][:, ::-1])


def _blocks(rows: DataFrame, size: int, width: int) -> DataFrame:
    """Consecutive rows of a partition as blocks: (block, longest, ids, v)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids, held = np.zeros(0, np.int64), np.zeros((0, width))

        def block(ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            longest = float(np.sqrt((m * m).sum(axis=1).max()))
            return pa.RecordBatch.from_arrays([pa.array([longest]), pa.array([ids.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], ["longest", "ids", "v"])

        for batch in batches:
            held_ids = np.concatenate([held_ids, batch.column(0).to_numpy()])
            held = np.concatenate([held, _matrix(batch.column(1), width)])
            while len(held_ids) >= size:
                yield block(held_ids[:size], held[:size])
                held_ids, held = held_ids[size:], held[size:]
        if len(held_ids):
            yield block(held_ids, held)

    return rows.select("id", "v").mapInArrow(kernel, "longest double, ids binary, v binary")


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles while these are exact, else in 64-bit integers."""
    if q.size and x.size and np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2.0**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.T.astype(np.int64)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= edge)
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products.

    ``vectors`` and ``queries`` are (id, v) as ``integer_vectors`` makes them.  A query never
    meets rows of its own id; ties go to the smaller id; rows with the same id all count, and
    repeated queries give repeated results; shorter vectors count as filled up with zeros.
    Queries get all there are if these are fewer than k, and no row if there are none.  Scores
    must fit 63 bits.
    """
    spark = vectors.sparkSession
    context = spark.sparkContext
    sizes = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    n, width = sizes["n"], max(1, sizes["w"] or 1)
    turn = context.broadcast(rotation(vectors, width))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    groups = max(1, -(-n // (GROUP * BLOCK)))
    # Every query keeps a number of its own, so repeated ids stay apart.
    by_length = vectors.withColumn("length", length).repartitionByRange(groups, F.desc("length"), F.xxhash64("id"), F.col("id")).sortWithinPartitions(F.desc("length"), "id")
    blocks = cut(_blocks(by_length, BLOCK, width).withColumn("group", F.spark_partition_id()))
    query_blocks = max(1, -(-queries.count() // QUERIES))
    salts = -(-query_blocks // TOGETHER)
    asked = queries.repartition(query_blocks, F.xxhash64("id")).sortWithinPartitions("id")
    asked = cut(_blocks(asked, QUERIES, width).withColumn("query_block", F.monotonically_increasing_id()))
    longest = {r["group"]: r["m"] for r in blocks.groupBy("group").agg(F.max("longest").alias("m")).collect()}
    reach = np.array([longest.get(g, 0.0) for g in range(max(longest, default=0) + 1)])
    reach = np.maximum.accumulate(reach[::-1])[::-1]  # longest from this group on
    first = blocks.orderBy(F.desc("longest")).limit(1).select("ids", "v").collect()
    head = context.broadcast(tuple(first[0]) if first else (b"", b""))
    edges = context.broadcast(reach)

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds each query's first threshold and the number of groups that may hold more."""
        ids0 = np.frombuffer(head.value[0], np.int64)
        x0 = np.frombuffer(head.value[1]).reshape(-1, width)
        for batch in batches:
            floors, counts = [], []
            for ids, v in zip(batch.column(1), batch.column(2), strict=True):
                own, q = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(v.as_buffer()).reshape(-1, width)
                score = _products(q, x0).astype(np.float64)
                score[own[:, None] == ids0[None, :]] = -np.inf
                at = np.sort(score, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(q), -np.inf)
                norm = np.sqrt((q * q).sum(axis=1))
                need = np.full(len(q), -np.inf)
                np.divide(at, norm, out=need, where=norm > 0)
                need[(norm == 0) | (at <= 0)] = -np.inf  # lengths alone rule nothing out
                counts.append(int((edges.value * (1 + 1e-9) >= need.min()).sum()))
                floors.append(at.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.binary()), pa.array(counts, pa.int64())], [*batch.schema.names, "floors", "groups"])

    sent = asked.select("query_block", "ids", "v").mapInArrow(lambda it: thresholds(it), "query_block long, ids binary, v binary, floors binary, groups long")
    salt = F.pmod(F.xxhash64("query_block"), F.lit(salts)).alias("salt")
    sent = sent.where("groups > 0").select(F.col("ids").alias("q_ids"), F.col("v").alias("q"), "floors", salt, F.explode(F.expr("sequence(0, cast(groups as int) - 1)")).alias("group"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = turn.value
        lead = max(1, int(width * LEADING))
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, q, floor, ids, x = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in enumerate((np.int64, float, float, np.int64, float)))
                q, x = q.reshape(-1, width), x.reshape(-1, width)
                norm = np.sqrt((q * q).sum(axis=1))
                if (norm * batch.column(5)[row].as_py() * (1 + 1e-9) < floor).all():
                    continue  # the block's longest vector can't reach any query's threshold
                qr, xr = q @ axes, x @ axes
                rest = np.sqrt((qr[:, lead:] ** 2).sum(axis=1))[:, None] * np.sqrt((xr[:, lead:] ** 2).sum(axis=1))[None, :]
                bound = qr[:, :lead] @ xr[:, :lead].T + rest
                slack = 1e-9 * np.sqrt((q * q).sum(axis=1).max() * (x * x).sum(axis=1).max()) + 1e-6
                some = np.flatnonzero((bound + slack >= floor[:, None]).any(axis=0))
                if not len(some):
                    continue
                score = _products(q, x[some])
                who, which, value = [], [], []
                own = ids[some]
                for i in range(len(q)):
                    ok = np.flatnonzero((score[i] >= floor[i]) & (own != q_ids[i]))
                    best = ok[_best(score[i, ok], own[ok], k)]
                    who.append(np.full(len(best), i))
                    which.append(own[best])
                    value.append(score[i, best])
                who = np.concatenate(who)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[who]), pa.array(who), pa.array(np.concatenate(which)), pa.array(np.concatenate(value))], ["query_id", "place", "vec_id", "score"])

    dealt = blocks.select("group", "ids", "v", "longest", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    met = sent.join(dealt, ["group", "salt"]).select("q_ids", "q", "floors", "ids", "v", "longest")
    found = _small_batches(spark, met, meet, "query_id long, place long, vec_id long, score long")
    order = Window.partitionBy("query_id", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _small_batches(spark, df: DataFrame, kernel, schema: str) -> DataFrame:
    """Runs a kernel whose rows are megabytes with a few rows in a batch, and writes the result out."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "8")
    try:
        return cut(df.mapInArrow(kernel, schema))
    finally:
        spark.conf.set(name, before)
