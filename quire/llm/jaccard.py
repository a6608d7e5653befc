"""Near-duplicate join on word 5-grams at Jaccard similarity 0.8, with several token orders.

Two sets that are similar enough share a token among the first 20 % of each, in whatever
order the tokens stand, as long as it is the same order for all.  So every order is a filter;
the first one deals out candidates, and their sets are sent and compared only if the prefixes
meet under all ``ORDERS`` orders.  In each order tokens that many texts share stand last (by
their count), the rest by a hash of their own.

1. Equal sets are one class, found by two 64-bit sums; only one text of each goes on.
2. The first tokens in order 0 are dealt out by token.  Every text of a token's group is
   paired with the group's centre, the text with the smallest share of rare tokens (the
   original of a group of edited copies), and keeps the centre it meets most often.  These
   pairs, one a text at most, are checked and united.
3. Groups that still hold more than one component give the pairs across components, never
   those within one.  Each text has bits that its tokens flip; two texts differ in at least
   as many tokens as bits, so most pairs fall away inside the join by ``64 * SIGNS`` of them,
   and more by all.  The others are checked and united as well.
Step 2 saves work only: a pair of similar texts either ends in one component there or is one
of the pairs of step 3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import batches_of, cut, fresh_folder, removed, tidy
from quire.llm.text import NOT_SPACE, grams, mix, slices, utf8, words

K = 5
ORDERS = 3
#: Frequent tokens that a task reports, and that are ordered by count in all; any choice gives the same result.
REPORTED, FREQUENT = 16_384, 131_072
#: 64-bit words of the parity bits that bound the difference of two sets.
SIGNS = 16
SIGN_NAMES = [f"s{i}" for i in range(SIGNS)]
#: Columns of the first tokens in each order but the first, by 32 bits of their hashes.
PREFIXES = [f"prefix{order}" for order in range(1, ORDERS)]
#: Tokens whose counts a task holds before it drops the rare ones, and sets that it knows again.
HELD, KNOWN = 1_000_000, 65_536
#: Rows of an Arrow batch of texts, and of pairs with what is compared.
TEXTS, PAIRS = 2_000, 256


def sets(batch: pa.RecordBatch, column: int, k: int = K) -> list[np.ndarray]:
    """Each text's distinct k-word hashes in ascending order; with fewer words the whole sequence is one."""
    h, _, _, first = words(*utf8(batch.column(column)), NOT_SPACE)
    g = grams(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        else:
            out.append(grams(h[a:b], b - a) if b > a else g[:0])
    return out


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def counted(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Count of each token in the list of frequent ones, 0 outside it."""
    hashes, counts = frequent
    if not len(hashes):
        return np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(hashes, tokens), len(hashes) - 1)
    return np.where(hashes[at] == tokens, counts[at], 0)


def leading(tokens: np.ndarray, order: int, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first tokens of a set in one of the orders."""
    size = prefix_size(len(tokens))
    count = counted(tokens, frequent)
    key = tokens if order == 0 else mix(tokens, order)
    if count.any():
        return tokens[np.lexsort((key, count))[:size]]
    return tokens[:size] if order == 0 else tokens[np.argpartition(key, size - 1)[:size]] if size else tokens


def parity(tokens: np.ndarray) -> np.ndarray:
    """Parity bits of the number of tokens at each place; about as many places as tokens, ``64 * SIGNS`` at least."""
    size = max(64 * SIGNS, 1 << max(1, len(tokens) - 1).bit_length())
    at = (mix(tokens, 21) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8), bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The parity bits over fewer places."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


class Counter:
    """How many sets hold each token, for the frequent ones; memory is bounded by ``HELD``."""

    def __init__(self):
        self.pending: list[np.ndarray] = []
        self.size, self.tokens, self.seen = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, tokens: np.ndarray) -> None:
        self.pending.append(tokens)
        self.size += len(tokens)
        if self.size > HELD:
            self.fold()

    def fold(self) -> None:
        """Takes the pending tokens in; those seen only once so far are forgotten, then the rarest if there are too many."""
        if not self.size:
            return
        x = np.concatenate(self.pending)
        self.pending.clear()
        self.size = 0
        x.sort()
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        n = np.diff(np.append(first, len(x)))
        x = x[first]
        at = np.searchsorted(self.tokens, x)
        old = at < len(self.tokens)
        old[old] = self.tokens[at[old]] == x[old]
        self.seen[at[old]] += n[old]
        new = ~old & (n >= 2)
        self.tokens, self.seen = np.insert(self.tokens, at[new], x[new]), np.insert(self.seen, at[new], n[new])
        if len(self.tokens) > HELD // 4:
            top = np.sort(np.argpartition(-self.seen, HELD // 8)[: HELD // 8])
            self.tokens, self.seen = self.tokens[top], self.seen[top]

    def top(self) -> tuple[np.ndarray, np.ndarray]:
        """At most ``REPORTED`` tokens with their counts, most frequent first."""
        self.fold()
        top = np.argsort(-self.seen, kind="stable")[:REPORTED]
        top = top[self.seen[top] >= 4]
        return self.tokens[top], self.seen[top]


def profiles(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n, a, b, token, seen): a row a text with its set's size and sums, and rows (token, seen) of frequent tokens."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "a", "b", "token", "seen"]
        known: set[tuple[int, int]] = set()
        counter = Counter()
        for batch in slices(batches, "text"):
            n, a, b = [], [], []
            for s in sets(batch, 1, k):
                x, y = (int(mix(s, 11).sum(dtype=np.uint64)), int(mix(s, 12).sum(dtype=np.uint64))) if len(s) else (0, 0)
                n.append(len(s))
                a.append(x)
                b.append(y)
                if (x, y) not in known:
                    if len(known) == KNOWN:
                        known.clear()
                    known.add((x, y))
                    counter.add(s)
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64)), none, none], names)
        tokens, seen = counter.top()
        none = pa.nulls(len(tokens), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(tokens.view(np.int64)), pa.array(seen)], names)

    return docs.select("doc_id", "text").mapInArrow(tidy(kernel), "doc_id long, n long, a long, b long, token long, seen long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ends of the edges (x, y): the smallest id that edges lead to.

    Labels fall to the smallest among the neighbours and then to their label's label, until
    none changes; every round is written out.
    """
    both = cut(edges.select("x", "y").union(edges.select("y", "x")).distinct())
    label = cut(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("id"), F.least("x", "m").alias("c")))
    while True:
        near = both.join(label.withColumnRenamed("id", "y"), "y").groupBy(F.col("x").alias("id")).agg(F.min("c").alias("m"))
        lower = label.join(near, "id").select("id", F.col("c").alias("was"), F.least("c", "m").alias("c"))
        up = label.select(F.col("id").alias("c"), F.col("c").alias("up"))
        new = cut(lower.join(up, "c").select("id", "was", F.least("c", "up").alias("c")))
        label = new.select("id", "c")
        if new.where("c < was").isEmpty():
            return label.withColumnRenamed("c", "component")


class Stored:
    """Tables written below the shared folder and read again, until they are dropped."""

    def __init__(self, spark):
        self.spark, self.folders = spark, []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        at = fresh_folder(self.spark, name)
        df.write.parquet(at)
        self.folders.append(at)
        return self.spark.read.parquet(at)

    def drop(self) -> None:
        removed(self.spark, *self.folders)


def _wanted(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A one-hash filter over the ids, at most 8 MB whatever their number: (words, bits)."""
    n = ids.count()
    bits = 1 << min(26, max(12, int(np.ceil(np.log2(max(1, 16 * n))))))
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    rows = ids.select(F.shiftright(place, 6).alias("w"), F.expr("shiftleft(1L, cast(" + f"pmod(xxhash64(id), {bits}) & 63" + " as int))").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v")).collect()
    table = np.zeros(max(1, bits // 64), np.int64)
    for r in rows:
        table[r["w"]] = r["v"]
    return table, bits


def near_enough(pairs: DataFrame, led: DataFrame) -> DataFrame:
    """Those of the pairs (x, y) whose prefixes meet in the other orders and whose parity bits leave room for similarity."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, b, c in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                size = min(len(b), len(c))
                own, other = (folded(np.frombuffer(v, np.uint8), size) for v in (b, c))
                keep.append(9 * int(np.bitwise_count(own ^ other).sum()) <= n + m)
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(led.select(F.col("doc_id").alias("x"), "n", "bits", *PREFIXES), "x")
    two = one.join(led.select(F.col("doc_id").alias("y"), F.col("n").alias("m"), F.col("bits").alias("other"), *(F.col(p).alias(f"{p}_") for p in PREFIXES)), "y")
    meet = " and ".join(f"arrays_overlap({p}, {p}_)" for p in PREFIXES)
    two = two.where(f"5 * least(n, m) >= 4 * greatest(n, m) and {meet}")
    return two.select("x", "y", "n", "m", "bits", "other").mapInArrow(tidy(kernel), "x long, y long").distinct()


def verified(docs: DataFrame, pairs: DataFrame, led: DataFrame, k: int = K) -> DataFrame:
    """Those of the distinct pairs (x, y) that pass all filters and are similar; materialised."""
    spark = docs.sparkSession
    with batches_of(spark, PAIRS):
        pairs = cut(near_enough(pairs, led))
    ids = cut(pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct())
    filt = spark.sparkContext.broadcast(_wanted(ids))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = filt.value
        for batch in batches:
            place = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64) % bits
            batch = batch.filter(pa.array((table[place >> 6] >> (place & 63)) & 1 == 1))
            for part in slices(iter([batch]), "text"):
                own = [s.tobytes() for s in sets(part, 1, k)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.binary())], ["id", "tokens"])

    source = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    tokens = source.mapInArrow(tidy(load), "id long, tokens binary").join(ids, "id", "left_semi")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in pair)) for pair in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(tokens.select(F.col("id").alias("x"), F.col("tokens").alias("s")), "x")
    two = one.join(tokens.select(F.col("id").alias("y"), F.col("tokens").alias("t")), "y")
    with batches_of(spark, PAIRS):
        return cut(two.select("x", "y", "s", "t").mapInArrow(tidy(check), "x long, y long"))


def similar(s: np.ndarray, t: np.ndarray) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= 80 * (len(s) + len(t) - both)


def similar_groups(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    component_id: the smallest doc_id that links lead to, the row's own included.  Texts that
    are null, empty or without words have no links and are alone; a row without doc_id gets
    the component of equal sets if there is one, else null; repeated rows come out as often as
    they go in, and rows with one doc_id share its links.  Other columns aren't read.
    """
    spark = docs.sparkSession
    docs, stored = docs.select("doc_id", "text"), Stored(docs.sparkSession)
    with batches_of(spark, TEXTS):
        profile = cut(profiles(docs, k))
    rows = profile.where("n is not null").select("doc_id", "n", "a", "b")
    top = profile.where("seen is not null").groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "token").limit(FREQUENT).collect()
    hashes, counts = np.array([r["token"] for r in top], np.int64).view(np.uint64), np.array([r["seen"] for r in top], np.int64)
    order = np.argsort(hashes)
    frequent = spark.sparkContext.broadcast((hashes[order], counts[order]))
    classes = cut(rows.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep")))

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, n, rare, tokens, bits = [], [], [], [], []
            prefixes: list[list[np.ndarray]] = [[] for _ in PREFIXES]
            for doc_id, s in zip(batch.column(0).to_pylist(), sets(batch, 1, k), strict=True):
                if len(s) and doc_id is not None:
                    ids.append(doc_id)
                    n.append(len(s))
                    rare.append(int(4096 * (counted(s, frequent.value) == 0).mean()))
                    tokens.append(leading(s, 0, frequent.value).view(np.int64))
                    for i, p in enumerate(prefixes, 1):
                        p.append((leading(s, i, frequent.value) >> np.uint64(32)).astype(np.uint32).view(np.int32))
                    bits.append(parity(s))
            arrays = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(rare, pa.int32()), pa.array(tokens, pa.list_(pa.int64())), *(pa.array(p, pa.list_(pa.int32())) for p in prefixes)]
            words = np.array([folded(b, 8 * SIGNS) for b in bits], np.uint8).reshape(-1, 8 * SIGNS).view(np.int64)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([b.tobytes() for b in bits], pa.binary()), *(pa.array(words[:, i]) for i in range(SIGNS))], ["doc_id", "n", "rare", "tokens", *PREFIXES, "bits", *SIGN_NAMES])

    schema = "doc_id long, n long, rare int, tokens array<long>, " + ", ".join([*(f"{c} array<int>" for c in PREFIXES), "bits binary", *(f"{c} long" for c in SIGN_NAMES)])
    with batches_of(spark, TEXTS):
        led = stored.put(docs.mapInArrow(tidy(lead), schema).join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "leading")
    # short: among the first ninth, which is enough for the smaller set of a pair
    exploded = led.select("doc_id", "n", "rare", F.posexplode("tokens").alias("pos", "token")).select("token", "doc_id", "n", "rare", F.expr("pos <= n - ceil(8 * n / 9)").alias("short"))
    # Centres are aggregated before the shuffle and written, so that the join can split the group of a frequent token.
    centre = F.min(F.struct("rare", F.col("doc_id").alias("id"), F.col("n").alias("n")))
    centres = exploded.groupBy("token").agg(centre.alias("centre"), F.count("*").alias("members")).where("members > 1")
    centres = stored.put(centres.select("token", F.col("centre.id").alias("c"), F.col("centre.n").alias("m")), "centres")
    groups = stored.put(exploded.drop("rare").join(centres, "token"), "groups")
    met = groups.where("c <> doc_id and 5 * least(n, m) >= 4 * greatest(n, m)").groupBy("doc_id", "c").count()
    star = met.groupBy("doc_id").agg(F.max_by("c", F.struct("count", -F.col("c"))).alias("c")).select(F.least("doc_id", "c").alias("x"), F.greatest("doc_id", "c").alias("y")).distinct()
    star = cut(star)
    found = verified(docs, star, led, k)
    part = components(found)
    # What is left: groups with more than one component.
    held = groups.select("token", "doc_id", "n", "short").join(part.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    per = held.groupBy("token", "component").agg(F.count("*").alias("c"))
    mixed = per.groupBy("token").agg(F.count("*").alias("kinds"), F.max_by("component", F.struct("c", "component")).alias("largest")).where("kinds > 1")
    mixed = stored.put(mixed.select("token", "largest"), "mixed")
    left = stored.put(held.join(mixed, "token").join(led.select("doc_id", *SIGN_NAMES), "doc_id"), "left")
    small, every = left.where("component <> largest").alias("p"), left.alias("q")
    differ = " + ".join(f"bit_count(p.{c} ^ q.{c})" for c in SIGN_NAMES)
    fits = (
        "p.token = q.token and p.component <> q.component and (q.component = q.largest or p.doc_id < q.doc_id) and 5 * least(p.n, q.n) >= 4 * greatest(p.n, q.n) "
        f"and ((p.n <= q.n and p.short) or (q.n <= p.n and q.short)) and 9 * ({differ}) <= p.n + q.n"
    )
    rest = small.join(every, F.expr(fits)).select(F.expr("least(p.doc_id, q.doc_id)").alias("x"), F.expr("greatest(p.doc_id, q.doc_id)").alias("y")).distinct()
    rest = cut(rest.join(star, ["x", "y"], "left_anti"))
    if not rest.isEmpty():
        more = verified(docs, rest, led, k)
        if not more.isEmpty():
            part = components(found.union(more))
    stored.drop()
    named = classes.join(part.select(F.col("id").alias("rep"), "component"), "rep", "left").select("n", "a", "b", F.coalesce("component", "rep").alias("component"))
    out = rows.join(named, ["n", "a", "b"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = K) -> DataFrame:
    """The rows of ``docs``, columns as they are, without those that are not the first of their group.

    Repeated rows of a kept doc_id and text all stay.  Different texts of one doc_id are
    decided apart, the one with the smaller hash being first.  Rows without doc_id come after
    all others; of equal texts with words among them one row stays.
    """
    text = F.xxhash64("text")
    ids = docs.select("doc_id", text.alias("h")).groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    if ids.where("doc_id is null or low <> high").isEmpty():
        gone = similar_groups(docs, k).where("doc_id <> component_id").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    # Each (doc_id, text) is a document of its own, under a hash of both; who is first is settled by the real ids.
    key = F.xxhash64("doc_id", F.isnull("doc_id"), text)
    groups = cut(similar_groups(docs.select(key.alias("doc_id"), "text"), k).distinct())
    own = docs.select(key.alias("key"), F.struct(F.isnull("doc_id"), "doc_id", text, key).alias("place")).distinct()
    placed = groups.select(F.col("doc_id").alias("key"), "component_id").join(own, "key")
    first = placed.groupBy("component_id").agg(F.min("place").alias("first"))
    gone = placed.join(first, "component_id").where("place <> first").select(F.col("key").alias("key_"))
    kept = docs.withColumn("key_", key).join(gone, "key_", "left_anti")
    lone = F.isnull("doc_id") & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return kept.where(~lone).unionByName(kept.where(lone).dropDuplicates(["key_"])).select(docs.columns)
