"""Approximate nearest neighbours: a hierarchical k-means tree with best-bin-first traversal.

Equal vectors are one entry of the index, under a 128-bit hash, with the k + 1 smallest of their ids: no other
can be among k neighbours. So are queries with equal vectors; a very common vector is one entry and one query.

The tree grows with the data. Its top is fitted in a task on a bounded sample; leaves that hold more than FULL
rows are split by trees of their own, each fitted in a task on a bounded sample of that leaf, until leaves are of
some LEAF rows or the tree, which is sent to all executors, has MAX_LEAVES. Every row is indexed, by descending
to the nearest centre at each level. Beyond MAX_LEAVES (some 6 million vectors) leaves grow, and are dealt over parts.

A query takes tree nodes from a priority queue by the distance of their centres, so its leaves come in
best-bin-first order; how many it visits is calibrated: brute force answers for a bounded set of queries
tell at which visit each true neighbour would be met, and the visits widen until the wanted share is met.
Leaves and queries then meet by group: some neighbouring leaves, or a part of a leaf with many rows, so no
group grows with the data and a query is sent once to each group it visits.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.llm._shared import SENT_IDS, cut, dropped, stored

SAMPLE = 20_000  # vectors that a tree is fitted on at most, those with the smallest seeded hash
BRANCH = 16
LEAF = 64  # rows that a leaf is to hold
LEAST = 8  # sampled vectors below which a node isn't split
FULL = 256  # rows from which a leaf is split again
MAX_LEAVES = 100_000  # with as many inner nodes' centres, 30 MB at 64 dimensions
CALIBRATION = 200  # queries whose true neighbours are sought by brute force
RECALL = 0.95
GROUP_ROWS = 2_048  # rows of neighbouring leaves, or of a part of one leaf, that are searched together
HEAVY = 10_000  # queries of one vector from which its neighbours are sent to them, not joined


class Tree:
    """Centres by node; node 0 is the root. children[n] is empty for a leaf, leaf[n] numbers the leaves."""

    def __init__(self, sample: np.ndarray, seed: int = 0, branch: int = BRANCH, leaf: int = LEAF):
        rng = np.random.default_rng(seed)
        self.centres, self.children = [sample.mean(axis=0) if len(sample) else np.zeros(0)], [np.zeros(0, np.int64)]
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf:
                continue
            parts, centres = _kmeans(sample[rows], branch, rng)
            if len(centres) < 2:
                continue
            first = len(self.centres)
            self.children[node] = np.arange(first, first + len(centres))
            for i, c in enumerate(centres):
                self.centres.append(c)
                self.children.append(np.zeros(0, np.int64))
                todo.append((first + i, rows[parts == i]))
        self.centres = np.array(self.centres, dtype=np.float32)
        self._number()

    def _number(self) -> None:
        leaves = [n for n, c in enumerate(self.children) if len(c) == 0]
        self.leaf = np.full(len(self.children), -1)
        self.leaf[leaves] = np.arange(len(leaves))
        self.n_leaves = len(leaves)

    def graft(self, by_leaf: dict[int, "Tree"]) -> None:
        """Puts trees in the place of leaves."""
        at, centres = {int(leaf): n for n, leaf in enumerate(self.leaf) if leaf >= 0}, [self.centres]
        for leaf in sorted(by_leaf):
            own, first = by_leaf[leaf], len(self.children) - 1
            self.children[at[leaf]] = own.children[0] + first
            self.children += [c + first for c in own.children[1:]]
            centres.append(own.centres[1:])
        self.centres = np.concatenate(centres)
        self._number()

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if len(kids) == 0 or len(rows) == 0:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[kids]
            near = ((c**2).sum(axis=1) - 2 * x[rows] @ c.T).argmin(axis=1)
            todo += [(kids[i], rows[near == i]) for i in range(len(kids))]
        return out

    def order(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            kids = self.children[node]
            if len(kids) == 0:
                yield int(self.leaf[node])
            else:
                for n, d in zip(kids.tolist(), ((self.centres[kids] - q) ** 2).sum(axis=1).tolist(), strict=True):
                    heapq.heappush(heap, (d, n))


def _kmeans(x: np.ndarray, k: int, rng) -> tuple[np.ndarray, np.ndarray]:
    centres = np.unique(x[rng.choice(len(x), min(k, len(x)), replace=False)], axis=0)
    for _ in range(12):
        near = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = sums[counts > 0] / counts[counts > 0, None]
    near = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
    used = np.unique(near)
    return np.searchsorted(used, near), centres[used]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, v (doubles) and h1, h2, which name the vector, of the rows that take part: finite, not null, not zero, of the commonest length."""
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    good = vectors.select(F.col(key).alias("vec_id"), v.alias("v")).filter(
        F.col("v").isNotNull() & (F.size("v") > 0) & F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    sizes = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    good = good.filter(F.size("v") == (sizes[0].n if sizes else 0))
    return good.select("vec_id", "v", F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2"))


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """One row for each distinct vector: h1, h2, v and the k + 1 smallest ids. The ranks are limited before the shuffle too."""
    rank = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    few = rows.withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    return few.groupBy("h1", "h2").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"), F.min("v").alias("v")).select("h1", "h2", "v", "ids")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(x: np.ndarray, ids: list, q: np.ndarray, k: int) -> list[tuple[float, int, int]]:
    """(score, id, row) of the k nearest ids, by score and then id, each id once. ids: those of each row of x."""
    score = np.sqrt(((x - q) ** 2).sum(axis=1))
    n = min(len(score), 2 * k)
    while True:
        near = np.flatnonzero(score <= np.partition(score, n - 1)[n - 1]) if n else []
        best: dict[int, tuple[float, int, int]] = {}
        for found in sorted((float(score[r]), i, int(r)) for r in near for i in ids[r]):
            best.setdefault(found[1], found)
            if len(best) == k:
                break
        if len(best) == k or n == len(score):
            return list(best.values())
        n = min(len(score), 4 * n)


FOUND = "q1 long, q2 long, vec_id long, score double, leaf long"


def _table(rows: list[tuple]) -> pa.Table:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["q1", "q2", "vec_id", "score", "leaf"])


def _best(found: DataFrame, k: int) -> DataFrame:
    found = found.groupBy("q1", "q2", "vec_id").agg(F.min("score").alias("score"), F.min_by("leaf", "score").alias("leaf"))
    rank = F.row_number().over(Window.partitionBy("q1", "q2").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def brute_force(indexed: DataFrame, queries: list[tuple[int, int, np.ndarray]], k: int) -> DataFrame:
    """The k nearest ids of a bounded list of query vectors over all rows: FOUND rows."""
    sent = indexed.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        for b in batches:
            x, ids, leaf = _matrix(b.column("v")), b.column("ids").to_pylist(), b.column("leaf").to_pylist()
            yield from _table([(a, c, i, s, leaf[r]) for a, c, q in sent.value for s, i, r in nearest(x, ids, q, k)]).to_batches()

    return _best(indexed.select("ids", "v", "leaf").mapInArrow(run, FOUND), k)


def _fitted(rows: list[pa.RecordBatch] | pa.Table, seed: int, leaf: int) -> bytes:
    parts = rows.column("v").chunks if isinstance(rows, pa.Table) else [b.column("v") for b in rows if b.num_rows]
    x = np.concatenate([_matrix(p) for p in parts]) if parts else np.zeros((0, 0))
    return pickle.dumps(Tree(x, seed, leaf=leaf))


def _top(index: DataFrame, n: int, seed: int) -> Tree:
    """The tree of a bounded sample, fitted in a task."""
    leaf = max(LEAST, LEAF * min(n, SAMPLE) // max(1, n))
    sample = index.select("h1", "h2", "v").orderBy(F.xxhash64(F.lit(seed), "h1"), "h1", "h2").limit(SAMPLE).repartition(1).sortWithinPartitions("h1", "h2")

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([_fitted(list(batches), seed, leaf)], pa.binary())], names=["tree"])

    return pickle.loads(sample.mapInArrow(run, "tree binary").first().tree)


def _deepened(tree: Tree, index: DataFrame, counts: dict[int, int], seed: int) -> bool:
    """Splits full leaves, each by a tree fitted in a task on a bounded sample of its own rows. False if there was nothing to split."""
    room = MAX_LEAVES - tree.n_leaves
    full = {leaf: n for leaf, n in counts.items() if n > FULL}
    # Each of n rows is to get n / LEAF leaves; where there is no room for all, as much of it as there is.
    share = min(1.0, room / max(1, sum(n // LEAF for n in full.values())))
    if not full or share < 0.01:
        return False
    taken = {leaf: min(1.0, SAMPLE / n) for leaf, n in full.items()}
    sent = index.sparkSession.sparkContext.broadcast((tree, taken))

    def sampled(batches):
        tree, taken = sent.value
        for b in batches:
            leaf = tree.assign(_matrix(b.column("v")))
            drawn = (b.column("h1").to_numpy().view(np.uint64) >> np.uint64(11)) / 2.0**53
            keep = np.flatnonzero(drawn < np.array([taken.get(x, 0.0) for x in leaf.tolist()]))
            yield pa.RecordBatch.from_arrays([pa.array(leaf[keep]), b.column("h1").take(pa.array(keep)), b.column("v").take(pa.array(keep))], names=["leaf", "h1", "v"])

    def split(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("h1")
        leaf = rows.column("leaf")[0].as_py()
        return pa.table([pa.array([leaf], pa.int64()), pa.array([_fitted(rows, seed + leaf, max(LEAST, int(LEAF * taken[leaf] / share)))], pa.binary())], names=["leaf", "tree"])

    grown = index.select("h1", "v").mapInArrow(sampled, "leaf long, h1 long, v array<double>").groupBy("leaf").applyInArrow(split, "leaf long, tree binary")
    subs = {r.leaf: pickle.loads(r.tree) for r in grown.toLocalIterator()}
    subs = {leaf: t for leaf, t in subs.items() if t.n_leaves > 1}
    sent.unpersist()
    tree.graft(subs)
    return bool(subs)


def _assigned(index: DataFrame, tree: Tree) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        for b in batches:
            yield b.append_column("leaf", pa.array(sent.value.assign(_matrix(b.column("v"))), pa.int64()))

    return index.mapInArrow(run, T.StructType([*index.schema.fields, T.StructField("leaf", T.LongType())]))


def _visits(tree: Tree, indexed: DataFrame, asked: list[tuple[int, int, np.ndarray]], k: int, recall: float) -> int:
    """How many leaves to visit: as many as meet the wanted share of the true neighbours of some queries."""
    truth: dict[tuple[int, int], list[int]] = {}
    for r in brute_force(indexed, asked, k + 1).filter("score > 0").select("q1", "q2", "leaf").collect():
        truth.setdefault((r.q1, r.q2), []).append(r.leaf)
    met = []
    for a, b, q in asked:
        wanted = truth.get((a, b), [])
        rank, left = {}, set(wanted)
        for i, leaf in enumerate(tree.order(q), 1):
            if not left:
                break
            if leaf in left:
                left.discard(leaf)
                rank[leaf] = i
        met += [rank[leaf] for leaf in wanted]
    met = np.sort(met or [1])
    return int(met[min(len(met) - 1, int(np.ceil(recall * len(met))) - 1)])


def neighbours(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL, seed: int = 0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row for which is_query(key column) holds.

    Rows whose vector is null, zero, empty or not finite, or of another length than most, take no part, nor do
    rows without a key. Ties go to the smaller vec_id. Rows that repeat a key count once, with their nearest
    vector; a query that repeats its key asks with the least. No usable row gives an empty result. Extra columns
    are unread.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    index, path = stored(_entries(rows, k), "ann-vectors")
    n = index.count()
    if n == 0:
        dropped(spark, path)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = _top(index, n, seed)
    while True:
        indexed = _assigned(index, tree)
        counts = {r.leaf: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # one row for each leaf, at most MAX_LEAVES
        if not _deepened(tree, index, counts, seed):
            break
    indexed, filed = stored(indexed, "ann-index")
    queries = cut(rows.filter(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min_by(F.struct("h1", "h2", "v"), "v").alias("q")).select("vec_id", "q.h1", "q.h2", "q.v"))
    asked = cut(queries.groupBy(F.col("h1").alias("q1"), F.col("h2").alias("q2")).agg(F.min("v").alias("v")))
    some = [(r.q1, r.q2, np.array(r.v)) for r in asked.orderBy(F.xxhash64(F.lit(seed + 1), "q1"), "q1", "q2").limit(CALIBRATION).collect()]
    visits = _visits(tree, indexed, some, k, recall) if some else 1
    # Groups: the first one of each leaf, and how many it is dealt over.
    first, shares = np.zeros(tree.n_leaves, np.int64), np.ones(tree.n_leaves, np.int64)
    group, room = 0, GROUP_ROWS
    for leaf in range(tree.n_leaves):
        held = counts.get(leaf, 0)
        if held > room:
            group, room = group + (room < GROUP_ROWS), GROUP_ROWS
        first[leaf], shares[leaf] = group, max(1, -(-held // GROUP_ROWS))
        if held > GROUP_ROWS:
            group += int(shares[leaf])
        else:
            room -= held
    sent = spark.sparkContext.broadcast((tree, counts, first, shares))

    def routed(batches):
        tree, counts, first, shares = sent.value
        for b in batches:
            out = []
            for i, q in enumerate(_matrix(b.column("v"))):
                seen, by = 0, {}
                for at, leaf in enumerate(tree.order(q), 1):
                    for g in range(first[leaf], first[leaf] + shares[leaf]):
                        by.setdefault(int(g), []).append(leaf)
                    seen += counts.get(leaf, 0)
                    if at >= visits and seen > k:
                        break
                out += [(i, g, leaves) for g, leaves in by.items()]
            at = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in ("q1", "q2", "v")], pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int64()))], names=["q1", "q2", "q", "part", "leaves"])

    bins = asked.mapInArrow(routed, "q1 long, q2 long, q array<double>, part long, leaves array<long>")

    def dealt_out(batches):
        _, _, first, shares = sent.value
        for b in batches:
            hashed, leaf = b.column("h2").to_numpy().view(np.uint64), b.column("leaf").to_numpy()
            part = first[leaf] + (hashed % shares[leaf].astype(np.uint64)).astype(np.int64)
            yield b.append_column("part", pa.array(part)).select(["v", "ids", "leaf", "part"])

    dealt = indexed.mapInArrow(dealt_out, "v array<double>, ids array<long>, leaf long, part long")

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return _table([])
        leaf = right.column("leaf").to_numpy()
        order = np.argsort(leaf, kind="stable")
        x, leaf = _matrix(right.column("v").combine_chunks())[order], leaf[order]
        ids = right.column("ids").to_pylist()
        ids = [ids[r] for r in order.tolist()]
        out = []
        for a, b, q, leaves in zip(left.column("q1").to_pylist(), left.column("q2").to_pylist(), _matrix(left.column("q").combine_chunks()), left.column("leaves").to_pylist(), strict=True):
            rows = np.concatenate([np.arange(*np.searchsorted(leaf, (n, n + 1))) for n in leaves])
            out += [(a, b, i, s, 0) for s, i, _ in nearest(x[rows], [ids[r] for r in rows.tolist()], q, k + 1)]
        return _table(out)

    found = bins.groupBy("part").cogroup(dealt.groupBy("part")).applyInArrow(compared, FOUND)
    best = cut(_best(found, k + 1).groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near")))
    each = queries.select(F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2"))
    # One row for each vector that is asked: those asked for by many queries are sent to these.
    heavy = best.join(each.groupBy("q1", "q2").count().filter(F.col("count") > HEAVY).limit(SENT_IDS).select("q1", "q2"), ["q1", "q2"], "left_semi")
    heavy = cut(heavy)
    if heavy.isEmpty():
        out = each.join(best, ["q1", "q2"])
    else:
        names = F.broadcast(heavy.select("q1", "q2"))
        out = each.join(F.broadcast(heavy), ["q1", "q2"]).unionByName(each.join(names, ["q1", "q2"], "left_anti").join(best, ["q1", "q2"]))
    near = F.slice(F.filter("near", lambda c: c["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(near).alias("at", "n")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "n.vec_id", "n.score")
    out = cut(out)
    dropped(spark, path, filed)
    return out
