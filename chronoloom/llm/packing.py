"""Best-fit packing: token pieces into sequences of a fixed capacity, online with bounded space.

Open bins live in a bitset keyed by free space (bit f is set while a bin with f free tokens is
open), so the best fit of a piece is the lowest set bit at or above its length. At most OPEN bins
stay open; when one more opens, the fullest closes first. A piece is placed for good when it
arrives: memory is the bitset and the open bins, whatever the number of pieces.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
OPEN = 4096
ROWS_PER_PACKER = 250_000  # documents dealt to one packing task
LOT = 2_500  # documents whose pieces arrive together, the longest first; fewer pieces than open bins
BATCH = 256  # documents tokenised together
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


class BestFit:
    """Bounded-space online best fit. place(length) gives (bin, offset)."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.by_free, self.n_open, self.next = 0, [[] for _ in range(capacity + 1)], 0, 0

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit {self.capacity}")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.capacity, self.next
            self.next += 1
            if self.n_open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
        left = free - length
        if left:
            self.by_free[left].append(bin_id)
            self.bits |= 1 << left
            self.n_open += 1
        return bin_id, self.capacity - free

    def _take(self, free: int) -> int:
        bin_id = self.by_free[free].pop()
        self.n_open -= 1
        if not self.by_free[free]:
            self.bits ^= 1 << free
        return bin_id


_ENCODERS: dict[str, Callable[[str], list[int]]] = {}


@functools.cache
def _whole(name: str):
    """The tokenizers library's own tokenizer. It takes more memory than all else in a worker: most need none."""
    import public_tokenizers as known
    from tokenizers import Tokenizer

    return Tokenizer.from_file(known.path(name))


def encoder(name: str) -> Callable[[str], list[int]]:
    """text -> the ids that the tokenizers library gives with the vocabulary's .json file, add_special_tokens=False.

    A text that holds one of the vocabulary's control strings is encoded by that library, which reads it as the
    control token. Others are encoded with the ranks file of the same vocabulary, which gives the same ids several
    times faster; tests hold both against each other.
    """
    if name not in _ENCODERS:
        import base64
        import json

        import public_tokenizers as known
        import tiktoken

        with open(known.path(name), encoding="utf-8") as file:
            control = [t["content"] for t in json.load(file)["added_tokens"]]
        with open(known.path(name.removesuffix(".json") + ".tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        plain = tiktoken.Encoding("own", pat_str=known.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        _ENCODERS[name] = lambda text: _whole(name).encode(text, add_special_tokens=False).ids if any(c in text for c in control) else plain(text)
    return _ENCODERS[name]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Each document's ids and end_id, cut where longer than capacity: the first piece takes what is left over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                out: list[tuple] = []
                for doc, said in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = np.array([*encode(said.as_py() or ""), end_id], dtype="<u4")
                    first = len(ids) % capacity or capacity
                    bounds = [0, *range(first, len(ids) + 1, capacity)]
                    out += [(doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def packed(found: DataFrame, n_packers: int = 1, n_lots: int = 1, capacity: int = CAPACITY, open_bins: int = OPEN) -> DataFrame:
    """Places every piece. Pieces are dealt to the packers by a hash of document and piece; each packer numbers its own sequences.

    Only full sequences leave no room, so each packer wastes at most its last open bins; the number of
    packers follows the number of documents, not the number of machines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = BestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 36
        for batch in batches:
            placed = [fit.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"]
            )

    # Pieces arrive in lots, each with its longest pieces first: the open bins that these leave take the
    # short ones of the same lot, and what is left over stays open for the next. The order is fixed by
    # the rows, so a packer that runs again places them alike.
    lot = F.pmod(F.xxhash64(F.lit(1), "doc_id", "piece", "ids_crc32"), F.lit(n_lots))
    dealt = found.withColumn("lot", lot).repartition(n_packers, F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions("lot", F.desc("length"), "doc_id", "piece", "ids_crc32")
    return dealt.drop("lot").mapInArrow(run, PLACED)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, open_bins: int = OPEN, rows_per_packer: int = ROWS_PER_PACKER) -> DataFrame:
    """Packs all rows of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the single id that ends a document. Repeated rows are packed each. A null
    key stays null. Extra columns are unread. An empty table gives an empty result.
    """
    rows = docs.count()
    n = max(1, -(-rows // rows_per_packer))
    return packed(pieces(docs, key, text, vocabulary, capacity), n, max(1, rows // n // LOT), capacity, open_bins)
