"""Near-duplicate documents by a chosen-path set similarity join.

A document's set is its distinct 5-word shingles; two documents are linked when their sets' Jaccard
similarity is at least 0.75. Documents with equal sets form one class, of which only the least id goes on.

Trees. A class is embedded as WIDTH minwise tokens of its set. In each of TREES independent trees, a node
chooses one of these tokens, and every fourth node, by a hash of its path, a second one. Each class in it goes
on to the children named by the chosen tokens' values. Tokens are set apart by tree and level, so none is chosen
twice along a path. Pages of one template, less similar to each other than the threshold, share a token with
some 0.8 to 0.85 of the others, so a level leaves them about as many rows as it found: 1.25 children times that
share. A node of at most LEAF classes and LEAF_BYTES of text is compared exhaustively: by the embedding first (a
pair far below the threshold is put aside), then on full sets. A pair at exactly 0.75 stays together in a tree
with probability 0.80 where nodes are small after one level, 0.42 after five, 0.23 after ten; nine trees lose it
with probability 3e-7, 0.008 and 0.09. Ten levels take apart some 20,000 classes of one template.

Large nodes. A node beyond these bounds has one of its classes, its pivot, one without a label if there is any,
compared with all others on full sets, which settles the pivot; the rest branch. The pivot meets the others in
several parts where they are many. Classes linked to a pivot carry its label, and a node whose classes all
carry one label is connected already and goes no further, so a mass of near copies is settled by a few
pivots, and no pairs within it are listed. This goes on until no large node is left: nothing is capped.

What the comparisons give are spanning forests of verified links, which make up the components with an
alternating large-star and small-star contraction. All stages are DataFrames; no id reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm._shared import SENT_IDS, cut, dropped, few, stored, without
from chronoloom.llm._text import U, give_back, mix, shingle_sets

K = 5
WIDTH, TREES, LEAF = 64, 9, 4000
LEAF_BYTES = 64 << 20  # of text in a node that is compared exhaustively
PART = 2000  # classes that a pivot meets at once
HEAVY = 10_000  # edges at a node from which its least neighbour is sent, not joined
FAR = 30  # equal tokens of WIDTH below which a pair isn't compared on full sets: 5 deviations under 0.75
LIKE = 75  # percent

_XOR = np.random.default_rng(21).integers(1, 2**63 - 1, WIDTH, dtype=np.uint64)
_MUL = np.random.default_rng(22).integers(1, 2**63 - 1, WIDTH, dtype=np.uint64) * U(2) + U(1)
SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, sig binary, octets long"
NODE = "key long, rep long, label long, octets long"


def embedding(shingles: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set: for each of WIDTH orders, its least element's rank, 32 bits."""
    out = np.full(WIDTH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        part = (shingles[i : i + 2048, None] ^ _XOR) * _MUL
        np.minimum(out, part.min(axis=0), out=out)
    return (out >> U(32)).astype(np.uint32)


def signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each row of docs: the size of its set, 128 bits that name the set, and its embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h1, h2, sig = [], [], [], []
            for _, s in shingle_sets(b.column(1), K):
                n.append(len(s))
                h1.append(int(mix(s ^ U(0xA5A5)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                h2.append(int(mix(s * U(0x9E3779B97F4A7C15) + U(7)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                sig.append(embedding(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary()), pc.binary_length(b.column(1)).cast(pa.int64())], names=["doc_id", "n_shingles", "h1", "h2", "sig", "octets"])
        give_back()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SIGNED)


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), WIDTH)


def _tokens() -> np.ndarray:
    """Each tree's order of the tokens, two for a level. The first two are no other tree's."""
    out = []
    for t in range(TREES):
        rest = np.random.default_rng(30 + t).permutation(WIDTH)
        out.append(np.concatenate([[2 * t, 2 * t + 1], rest[(rest // 2) != t]]))
    return np.array(out)


_ORDER = _tokens()
_TREE = U(15)  # the bits of a node's key that name its tree


def _children(keys: np.ndarray, sigs: np.ndarray, level: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys of the children they go to): by the node's first token, and by its second for every fourth node."""
    tree = (keys & _TREE).astype(np.int64)
    second = np.flatnonzero(tree % 4 == 3 if level == 0 else mix(keys ^ U(0x51)) % U(4) == 0)
    out = []
    for b, rows in enumerate((np.arange(len(keys)), second)):
        token = sigs[rows, _ORDER[tree[rows], (2 * level + b) % WIDTH]].astype(np.uint64)
        out.append((rows, (mix(mix(keys[rows] + U(b + 1)) ^ token) & ~_TREE) | (keys[rows] & _TREE)))
    return out


def _rooted(batches):
    """The first level: every class in all trees."""
    for b in batches:
        sigs = _sigs(b.column("sig"))
        for t in range(TREES):
            yield from _dealt(b, np.full(b.num_rows, (mix(np.full(1, t + 1, dtype=np.uint64))[0] & ~_TREE) | U(t)), sigs, b.column("rep"), 0)


def _branched(level: int):
    def run(batches):
        for b in batches:
            yield from _dealt(b, b.column("key").to_numpy().view(np.uint64), _sigs(b.column("sig")), b.column("label"), level)

    return run


def _dealt(b: pa.RecordBatch, keys: np.ndarray, sigs: np.ndarray, label: pa.Array, level: int) -> Iterator[pa.RecordBatch]:
    for rows, kids in _children(keys, sigs, level):
        at = pa.array(rows)
        yield pa.RecordBatch.from_arrays([pa.array(kids.view(np.int64)), b.column("rep").take(at), label.take(at), b.column("octets").take(at)], names=["key", "rep", "label", "octets"])


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal values of a sorted column; a run is never cut."""
    rest: pa.Table | None = None
    for b in batches:
        table = pa.Table.from_batches([b])
        table = pa.concat_tables([rest, table]) if rest is not None and rest.num_rows else table
        if table.num_rows == 0:
            continue
        values = table.column(column).to_numpy()
        last = int(np.searchsorted(values, values[-1])) if np.all(values[:-1] <= values[1:]) else len(values) - int(np.argmax(values[::-1] != values[-1]))
        if last:
            yield table.slice(0, last)
        rest = table.slice(last)
    if rest is not None and rest.num_rows:
        yield rest


def _bounds(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def _like(n1, n2):
    return 100 * np.minimum(n1, n2) >= LIKE * np.maximum(n1, n2)


def _near(sigs: np.ndarray, n: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which pairs of a node are to be compared on full sets: near by the embedding and by size, of unlike labels."""
    m = len(sigs)
    out = np.zeros((m, m), dtype=bool)
    step = max(1, 4_000_000 // (m * WIDTH))
    for i in range(0, m, step):
        same = (sigs[i : i + step, None, :] == sigs[None, :, :]).sum(axis=2)
        out[i : i + step] = (same >= FAR) & _like(n[i : i + step, None], n[None, :]) & (label[i : i + step, None] != label[None, :])
    return out


def _groups(linked: np.ndarray) -> list[np.ndarray]:
    """Connected groups of at least two, from a symmetric matrix."""
    todo = linked.any(axis=1)
    out = []
    for i in np.flatnonzero(todo):
        if todo[i]:
            seen = np.zeros(len(linked), dtype=bool)
            edge = np.zeros(len(linked), dtype=bool)
            edge[i] = True
            while edge.any():
                seen |= edge
                edge = linked[edge].any(axis=0) & ~seen
            todo &= ~seen
            out.append(np.flatnonzero(seen))
    return out


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes -> groups of classes that may be linked, each with a hash by which equal groups of other nodes are known."""
    for table in _runs(batches, "key"):
        table = table.combine_chunks()
        keys, rep, n = (table.column(c).to_numpy() for c in ("key", "rep", "n_shingles"))
        label, sigs = table.column("label").to_numpy(), _sigs(table.column("sig").combine_chunks())
        at = _bounds(keys)
        found: list[np.ndarray] = []
        pairs = at[:-1][np.diff(at) == 2]  # most nodes hold two classes: compared all at once
        near = (sigs[pairs] == sigs[pairs + 1]).sum(axis=1) >= FAR
        near &= _like(n[pairs], n[pairs + 1]) & (label[pairs] != label[pairs + 1])
        found += [rep[i : i + 2] for i in pairs[near].tolist()]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a > 2:
                found += [rep[a:b][g] for g in _groups(_near(sigs[a:b], n[a:b], label[a:b]))]
        found = [np.unique(g) for g in found]
        found = [g for g in found if len(g) > 1]
        name = [int(mix(mix(g.view(np.uint64)) + np.arange(len(g), dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64)) for g in found]
        yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array([g.tolist() for g in found], pa.list_(pa.int64()))], names=["name", "members"])
    give_back()


def _forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the likeliest pairs, by the embeddings."""
    e = np.array([embedding(s) for s in sets])
    m = len(e)
    out, done, parent = [], np.zeros(m, dtype=bool), np.zeros(m, dtype=np.int64)
    best = np.full(m, -1, dtype=np.int16)
    for _ in range(m):
        j = int(best.argmax())
        if best[j] < FAR:  # nothing near is left: another tree begins
            j = int(np.argmin(done))
        else:
            out.append((int(parent[j]), j))
        done[j] = True
        near = (e == e[j]).sum(axis=1).astype(np.int16)
        near[done] = -1
        best[done] = -1
        closer = near > best
        best[closer], parent[closer] = near[closer], j
    return out


def links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets, compared in full.

    Likely pairs first: where they are links, most sets are connected by as many comparisons as there are sets.
    Then every set outside the largest component is compared with all others through an inverted index; two
    sets of different components can't both be in the largest, so no link is missed.
    """
    m = len(sets)
    n = np.array([len(s) for s in sets], dtype=np.int64)
    root = np.arange(m)
    out: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))

    def linked(both, i, j):
        return (both > 0) & (100 * both >= LIKE * (n[i] + n[j] - both))

    if m == 2:
        if linked(len(np.intersect1d(sets[0], sets[1], assume_unique=True)), 0, 1):
            join(0, 1)
        return out
    if m > 16:
        for i, j in _forest(sets):
            if _like(n[i], n[j]) and linked(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), i, j):
                join(i, j)
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], np.repeat(np.arange(m), n)[order]
    of = np.array([find(i) for i in range(m)])
    roots, counts = np.unique(of, return_counts=True)
    for i in np.flatnonzero(of != roots[counts.argmax()]).tolist():
        lo, hi = np.searchsorted(value, sets[i]), np.searchsorted(value, sets[i], side="right")
        reach = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
        both = np.bincount(owner[reach], minlength=m)
        both[i] = 0
        for j in np.flatnonzero(linked(both, i, slice(None))).tolist():
            join(i, j)
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups with their texts -> verified links (a, b)."""
    for table in _runs(batches, "name"):
        table = table.combine_chunks()
        sets = [s for _, s in shingle_sets(table.column("text"), K)]
        rep = table.column("rep").to_numpy()
        at = _bounds(table.column("name").to_numpy())
        out = [(int(rep[i + a]), int(rep[j + a])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) for i, j in links(sets[a:b])]
        yield pa.RecordBatch.from_arrays([pa.array([min(e) for e in out], pa.int64()), pa.array([max(e) for e in out], pa.int64())], names=["a", "b"])
    give_back()


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of pivots, each before those of its members -> the pairs that are linked."""
    known = None
    for b in batches:
        first, pivots, reps = b.column("first").to_pylist(), b.column("pivot"), b.column("rep")
        keep = []
        for i, s in shingle_sets(b.column("text"), K):
            if first[i]:
                known = s
            elif links([known, s]):
                keep.append(i)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([pivots.take(at), reps.take(at)], names=["pivot", "rep"])
    give_back()


def _picked(texts: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The texts whose doc_id is among ids (a column called rep, some n rows), picked before any shuffle where ids are few enough to send."""
    ids = cut(few(ids.select(F.col("rep").alias("_id")).distinct(), n))
    return texts.join(_sent(ids), F.col("doc_id") == F.col("_id"), "left_semi")


def _sent(small: DataFrame) -> DataFrame:
    """A checkpointed table, to be sent to all executors if it is small enough."""
    return F.broadcast(small) if small.count() <= SENT_IDS else small


def _near_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Embeddings of pivots, each before those of its members -> the pairs not far apart by the embedding or by size."""
    sig, n = np.zeros((1, WIDTH), np.uint32), np.zeros(1, np.int64)
    for b in batches:
        if b.num_rows:
            first = b.column("first").to_numpy(zero_copy_only=False)
            sigs, sizes = _sigs(b.column("sig")), b.column("n_shingles").to_numpy()
            sig, n = np.concatenate([sig[-1:], sigs[first]]), np.concatenate([n[-1:], sizes[first]])
            of = np.cumsum(first)
            near = (sigs == sig[of]).sum(axis=1) >= FAR
            near &= _like(sizes, n[of]) & ~first
            yield b.select(["pivot", "rep"]).filter(pa.array(near))


def _met(pairs: DataFrame, about: DataFrame, compared, n: int) -> DataFrame:
    """The pairs (pivot, rep), some n, that compared() keeps. about: rep and what is compared.

    A pivot with many members meets them in parts of PART, each in the order pivot, members: what is known of a
    pivot is sent once for each part and never beside every member.
    """
    columns = [c for c in about.columns if c != "rep"]
    parts = _sent(cut(few(pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts")), n)))
    members = pairs.join(parts, "pivot").join(about, "rep").select("pivot", F.pmod(F.xxhash64("rep"), "parts").alias("part"), F.lit(False).alias("first"), "rep", *columns)
    heads = parts.join(about.withColumnRenamed("rep", "pivot"), "pivot").select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("first"), F.col("pivot").alias("rep"), *columns)
    rows = heads.unionByName(members).repartition("pivot", "part").sortWithinPartitions("pivot", "part", F.desc("first"), "rep")
    return few(cut(rows.mapInArrow(compared, "pivot long, rep long")), n)


def _settle(big: DataFrame, reps: DataFrame, texts: DataFrame, level: int, n: int) -> tuple[DataFrame, DataFrame]:
    """Compares the pivot of each large node with its members: (verified links, the other rows with their labels). big has some n rows."""
    pivots = cut(few(big.groupBy("key").agg(F.min_by("rep", F.struct(F.col("label") != F.col("rep"), F.xxhash64(F.lit(level), "rep"), "rep")).alias("pivot")), n))
    rows = big.join(_sent(pivots), "key")
    pairs = cut(few(rows.filter("rep <> pivot AND label <> pivot").select("pivot", "rep").distinct(), n))
    near = _met(pairs, reps.select("rep", "n_shingles", "sig"), _near_pivot, n)
    said = _picked(texts, near.select("rep").unionByName(near.select(F.col("pivot").alias("rep"))), n)
    linked = _met(near, _one_each(said), _starred, n)
    rest = rows.filter("rep <> pivot").join(linked.withColumn("hit", F.lit(True)), ["pivot", "rep"], "left")
    rest = rest.select("key", "rep", F.when(F.col("hit"), F.col("pivot")).otherwise(F.col("label")).alias("label"), "octets")
    return linked.select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")), cut(few(rest, n))


def _one_each(texts: DataFrame) -> DataFrame:
    return texts.select(F.col("doc_id").alias("rep"), "text")


def verified_links(reps: DataFrame, texts: DataFrame, leaf: int = LEAF, leaf_bytes: int = LEAF_BYTES) -> tuple[DataFrame, list[str]]:
    """A spanning set of the links between classes: (a, b). reps: stored rep, n_shingles, sig, octets; texts: doc_id, text."""
    rows = reps.select("rep", "sig", "octets").mapInArrow(_rooted, NODE)
    leaves, found, paths, level = [], [], [], 0
    n = len(_ORDER) * reps.count() * 5 // 4  # rows of a level: some more may come, as nodes have 1.25 children on average
    while True:
        rows, path = stored(rows, f"level{level}")
        # A node of one class or of one label is done.
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("l1"), F.max("label").alias("l2"), F.sum("octets").alias("size")).filter("n > 1 AND l1 <> l2")
        sizes = cut(few(sizes.select("key", ((F.col("n") > leaf) | (F.col("size") > leaf_bytes)).alias("large")), n))
        large = sizes.filter("large").select("key")
        n_large = large.count()
        large = F.broadcast(large) if n_large <= SENT_IDS else large
        # Rows of large nodes, which may be most, are not shuffled by their node.
        others = rows.join(large, "key", "left_anti") if n_large else rows
        nodes, kept = stored(others.join(sizes.filter("NOT large").select("key"), "key").select("key", "rep", "label").transform(few, n), f"nodes{level}")
        paths.append(kept)
        leaves.append(nodes)
        if not n_large:
            dropped(rows.sparkSession, path)
            break
        sure, rest = _settle(rows.join(large, "key", "left_semi"), reps, texts, level, n)
        dropped(rows.sparkSession, path)
        found.append(sure)
        level += 1
        rows = rest.join(reps.select("rep", "sig"), "rep").select("key", "rep", "label", "octets", "sig").mapInArrow(_branched(level), NODE)
    nodes = leaves[0]
    for more in leaves[1:]:
        nodes = nodes.unionByName(more)
    nodes = nodes.join(reps, "rep").select("key", "rep", "label", "n_shingles", "sig")
    groups = nodes.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_leaves, "name long, members array<long>")
    groups, path = stored(groups.groupBy("name").agg(F.min("members").alias("members")), "groups")
    paths.append(path)
    members = groups.select("name", F.explode("members").alias("rep"))
    full = members.join(_one_each(_picked(texts, members, n)), "rep").select("name", "rep", "text")
    edges = full.repartition("name").sortWithinPartitions("name", "rep").mapInArrow(_verified, "a long, b long")
    for more in found:
        edges = edges.unionByName(more)
    return edges.distinct(), paths


def _with_least(both: DataFrame, rows: int) -> DataFrame:
    """both (a, b) and m, the least of a and its neighbours b. That of a node with many edges is sent to them. rows: of both, at most."""
    least = cut(few(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), (F.count(F.lit(1)) > HEAVY).alias("heavy")), rows))
    heavy = least.filter("heavy").select("a", "m")
    n = heavy.count()
    if n == 0 or n > SENT_IDS:
        return few(both.join(least.select("a", "m"), "a"), rows)
    light = both.join(F.broadcast(heavy.select("a")), "a", "left_anti").join(least.filter("NOT heavy").select("a", "m"), "a")
    return few(light.unionByName(both.join(F.broadcast(heavy), "a")), rows)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each end of an edge reaches, by large-star and small-star rounds."""
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n, before = edges.count(), None
    edges = few(edges, n)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = cut(few(_with_least(both, 2 * n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), n))
        down = _with_least(large, n).select("a", "b", "m")  # here all b are below a
        small = down.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        edges = cut(few(small.distinct(), 2 * n))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        n = now[0]
        if before is not None and tuple(now) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = tuple(now)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id (the least id it reaches, itself included), kept.

    A null, empty or wordless text has no shingles and is linked with nothing. A row without an id takes no
    part: its component is null and it is kept. Rows that repeat an id and a text are one class; rows of one
    id with other texts are documents that share the id, joined where they are linked. An empty table gives
    an empty one. Extra columns are unread, so their names don't matter.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    all_rows, signs = stored(signed(docs, "doc_id", "text"), "signed")
    classes = all_rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes, named = stored(few(classes, all_rows.count()), "classes")
    own = classes.select("rep", F.col("h1").alias("r1"), F.col("h2").alias("r2"))
    reps = all_rows.join(own, (F.col("doc_id") == F.col("rep")) & (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2"))).select("rep", "n_shingles", "sig", "octets").dropDuplicates(["rep"])
    reps, at = stored(reps, "reps")
    edges, paths = verified_links(reps, docs.filter("doc_id IS NOT NULL AND text IS NOT NULL"), leaf)
    of = components(edges)
    head = classes.join(of, F.col("rep") == F.col("node"), "left").select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.coalesce("component", "rep").alias("component_id"))
    out = all_rows.select("doc_id", "n_shingles", "h1", "h2").join(head, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = cut(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
    dropped(spark, signs, named, at, *paths)
    return out.withColumnRenamed("doc_id", key)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component, that of the least id. Rows without an id stay."""
    found = near_duplicates(docs, key, text).filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("kept").alias("kept"))
    return without(docs, found.filter("NOT kept").select(key), key)
