"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Training texts are cut into words, the hash of every window of consecutive words is looked up
in the set of benchmark windows, and a hit counts only after the words themselves are compared.
The benchmark is broadcast in blocks of at most MAX_WINDOWS windows, one job over the documents for
each block, so that what is sent and held is bounded however large the benchmark is; with several
blocks each row has a number of its own, by which its hits are brought together.

Words: A-Z folded, runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]. A window is N consecutive words of
an item; an item of fewer words is one window; an item without words has none.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm._shared import cut, dropped, fresh, stored, without
from chronoloom.llm._text import ALNUM, Words, give_back, grams, texts

N = 13
MAX_WINDOWS = 500_000  # of a broadcast block: at most 500,000 windows of 13 words, some 100 MB
FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"
FILTER_BITS = 22


def _windows(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(length, hash, words) of each window of one item."""
    words = Words(data, bounds, ALNUM)
    k = min(N, len(words.hashes))
    for at, h in enumerate(grams(words.hashes, k).tolist() if k else ()):
        yield k, h, words.text(at, at + k)


class _Set:
    """The windows of one length: a bit filter on the low hash bits before the exact lookup."""

    def __init__(self, by: dict[int, list]):
        self.by = by
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[np.fromiter(by, dtype=np.uint64, count=len(by)) & np.uint64((1 << FILTER_BITS) - 1)] = True

    def hits(self, words: Words, k: int) -> Iterator[tuple[int, list]]:
        """(first word, item ids) of each verified window."""
        found = grams(words.hashes, k)
        for at in np.flatnonzero(self.filter[found & np.uint64((1 << FILTER_BITS) - 1)]).tolist():
            for said, ids in self.by.get(int(found[at]), ()):
                row = int(np.searchsorted(words.of, at, side="right")) - 1
                if at + k <= words.of[row + 1] and words.text(at, at + k) == said:
                    yield at, ids


def _hits(sets: dict[int, _Set], words: Words) -> Iterator[tuple[int, int, int, list]]:
    """(document, first word, word behind the last, item ids) of each verified window; words count over all documents."""
    for k, known in sets.items():
        for at, ids in known.hits(words, k):
            yield int(np.searchsorted(words.of, at, side="right")) - 1, at, at + k, ids


def _scan(windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = {k: _Set(by) for k, by in windows.value.items()}
        for batch in batches:
            for row, data, bounds in texts(batch.column(batch.num_columns - 1)):
                words = Words(data, bounds, ALNUM)
                n_docs = len(bounds) - 1
                spans: dict[int, list] = defaultdict(list)
                items: dict[int, set] = defaultdict(set)
                for doc, a, b, ids in _hits(sets, words):
                    spans[doc].append((a - int(words.of[doc]), b - int(words.of[doc])))
                    items[doc].update(ids)
                kept = batch.slice(row, n_docs)
                yield pa.RecordBatch.from_arrays(
                    [
                        *kept.columns[:-1],
                        pa.array(np.diff(words.of).astype(np.int64)),
                        pa.array([[{"start": a, "end": b} for a, b in merged(spans.get(d, ()))] for d in range(n_docs)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array([sorted(items.get(d, ())) for d in range(n_docs)], pa.list_(pa.string())),
                    ],
                    names=[*kept.schema.names[:-1], "n_words", "spans", "items"],
                )
        give_back()

    return run


def merged(spans) -> list[tuple[int, int]]:
    """The union of half-open spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, max_windows: int = MAX_WINDOWS) -> Iterator[dict[int, dict[int, list]]]:
    """The benchmark's windows, {length: {hash: [(words, [item ids])]}}, at most max_windows to a block.

    Items stream through the driver one at a time, and one of more windows is spread over blocks. There is at
    least one block.
    """
    part: dict[int, dict[int, dict]] = defaultdict(lambda: defaultdict(dict))
    n = 0

    def block():
        return {k: {h: [(w, sorted(ids)) for w, ids in same.items()] for h, same in by.items()} for k, by in part.items()}

    for row in benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        for _, data, bounds in texts(pa.array([row.text], pa.large_string())):
            for k, h, said in _windows(data, bounds):
                if n == max_windows:
                    yield block()
                    part.clear()
                    n = 0
                part[k][h].setdefault(said, set()).add(str(row.item_id))
                n += 1
    yield block()


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs written with a number of its own for each row: (table, that column's name, path)."""
    (row,) = fresh(docs, "_row")
    kept, path = stored(docs.withColumn(row, F.monotonically_increasing_id()), "decontam")
    return kept, row, path


def _found(rows: DataFrame, keys: list[str], text: str, first: dict, more: Iterator[dict]) -> DataFrame:
    """keys, n_words, spans and items of each row. With several blocks keys[0] tells all rows apart.

    Blocks are looked up one after another, each in a job of its own, so that executors hold one at a time.
    """
    schema = ", ".join(f"k{i} {rows.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)) + ", " + FOUND
    given = rows.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("text"))
    out = given.mapInArrow(_scan(rows.sparkSession.sparkContext.broadcast(first)), schema)
    following = next(more, None)
    if following is not None:
        out = cut(out)
        while following is not None:
            sent = rows.sparkSession.sparkContext.broadcast(following)
            out = out.unionByName(cut(given.mapInArrow(_scan(sent), schema).filter(F.size("spans") > 0)))
            sent.unpersist()
            following = next(more, None)
        out = out.groupBy("k0").agg(
            *[F.first(f"k{i}").alias(f"k{i}") for i in range(1, len(keys))],
            F.max("n_words").alias("n_words"),
            _union(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    return out


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per row of docs: key, n_words, spans (merged word ranges inside benchmark windows), items.

    Null or empty texts and items have no words, hence no hits. Rows that repeat a key, or have none, are each
    judged by their own text, whatever the number of blocks. Null item ids are named "None". Extra columns of
    either table are unread. An empty table gives an empty one.
    """
    docs = docs.select(F.col(key).alias("row_key"), F.col(text).alias("text"))
    more = blocks(benchmark, max_windows)
    first, second = next(more), next(more, None)
    if second is None:
        return _found(docs, ["row_key"], "text", first, iter(())).withColumnRenamed("k0", key)
    rows, row, path = _numbered(docs)
    out = cut(_found(rows, [row, "row_key"], "text", first, chain([second], more)))
    dropped(docs.sparkSession, path)
    return out.drop("k0").withColumnRenamed("k1", key)


def _union(spans):
    return F.aggregate(
        F.array_sort(spans),
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(
            F.concat(acc, F.array(s))
        ),
    )


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated (n_hit > 0 and 20 * n_hit >= n_words)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", key: str = "doc_id", text: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs without its contaminated documents, or ("spans") with every hit word and what stands between hit words removed.

    All columns are kept, those of any name, and null texts stay null. "documents" drops a contaminated row's
    key, so rows that share a key go together. Spans of all blocks are found in the text as it was, then cut once.
    """
    if mode == "documents":
        return without(docs, judged(scan(docs, benchmark, key, text, max_windows)).filter("contaminated").select(key), key)
    more = blocks(benchmark, max_windows)
    first, second = next(more), next(more, None)
    at = docs.columns.index(text)
    if second is None:
        sent = docs.sparkSession.sparkContext.broadcast(first)
        return docs.mapInArrow(_cut_spans(at, sent), docs.schema)
    rows, row, _ = _numbered(docs)
    (spans,) = fresh(rows, "_spans")
    found = cut(_found(rows, [row], text, first, chain([second], more)).filter(F.size("spans") > 0).select(F.col("k0").alias(row), F.col("spans").alias(spans)))
    found = F.broadcast(found) if found.count() <= SENT_SPANS else found
    return rows.join(found, row, "left").select(*docs.columns, spans).mapInArrow(_cut_spans(at), docs.schema)


SENT_SPANS = 100_000  # rows with spans sent to every executor at most


def _cut_spans(at: int, windows=None):
    """Cuts the spans of the given windows, or those that the last column names."""

    def run(batches):
        sets = {k: _Set(by) for k, by in windows.value.items()} if windows is not None else {}
        for batch in batches:
            kept = []
            for row, data, bounds in texts(batch.column(at)):
                words = Words(data, bounds, ALNUM)
                spans = defaultdict(list)
                for doc, a, b, _ in _hits(sets, words):
                    spans[doc].append((a, b))
                if windows is None:
                    for doc, found in enumerate(batch.column(batch.num_columns - 1).slice(row, len(bounds) - 1).to_pylist()):
                        spans[doc] = [(s["start"] + int(words.of[doc]), s["end"] + int(words.of[doc])) for s in found or ()]
                for d in range(len(bounds) - 1):
                    pos, out = int(bounds[d]), []
                    for a, b in merged(spans.get(d, ())):
                        out.append(data[pos : words.starts[a]].tobytes())
                        pos = int(words.ends[b - 1])
                    out.append(data[pos : bounds[d + 1]].tobytes())
                    kept.append(b"".join(out).decode())
            field = batch.schema.field(at)
            mask = np.asarray(batch.column(at).is_null())
            done = batch.set_column(at, field, pa.array(kept, field.type, mask=mask))
            yield done if windows is not None else done.select(done.schema.names[:-1])

    return run


def items_digest(ids) -> str:
    """What items_sha256 holds, for callers outside Spark."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
