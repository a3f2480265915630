"""Operator 9: bounded-space online best-fit packing of token sequences.

Every task packs the documents it reads into sequences of at most `capacity` ids. Pieces
arrive in blocks of BLOCK, each block's longest first, which leaves short ones to fill the
gaps. The task keeps a fixed number of open bins. A bitset, an integer with
a bit for each amount of free space that some open bin has, gives the bin that fits
best. When all bins are open and none fits, the fullest closes first. A document longer
than the capacity is cut into full pieces, which are sequences of their own, and a
first piece that holds the rest. Tasks share nothing, so there is no shuffle, and a
lost task packs its rows again to the same result.

Defined results: a null text counts as empty and gives one piece, the end id; repeated
rows are packed each for itself; an empty table gives no rows; a null doc_id stays null;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import batches, whole_texts
from .tokens import Encoder

CAPACITY = 2048
OPEN_BINS = 1024
#: Pieces that a task holds to order them by length.
BLOCK = 2000


class BestFit:
    """Bins of one task. place(n) gives (bin, offset) of a piece of n ids."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.by_free: dict[int, list[int]] = {}  # free space -> open bins
        self.bits = self.n_open = self.n_bins = 0

    def _open(self, free: int, number: int) -> None:
        if free:  # a full bin closes by itself
            self.by_free.setdefault(free, []).append(number)
            self.bits |= 1 << free
            self.n_open += 1

    def _take(self, free: int) -> int:
        own = self.by_free[free]
        number = own.pop()
        if not own:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.n_open -= 1
        return number

    def place(self, n: int) -> tuple[int, int]:
        if fitting := self.bits >> n << n:
            free = (fitting & -fitting).bit_length() - 1  # the least free space of n or more
            number = self._take(free)
        else:
            if self.n_open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, number = self.capacity, self.n_bins
            self.n_bins += 1
        self._open(free - n, number)
        return number, self.capacity - free


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids; only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pack(docs: DataFrame, tokenizer: str, end_id: int | None = 0, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset."""
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins, base = Encoder.of(tokenizer), BestFit(capacity, open_bins), TaskContext.get().partitionId() << 36
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        names = ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"]
        held: list[tuple] = []

        def placed() -> pa.RecordBatch:
            held.sort(key=lambda piece: -piece[3])  # equal lengths keep their order
            out = []
            for piece in held:
                number, offset = bins.place(piece[3])
                out.append((*piece, zlib.crc32(piece[4]), base + number, offset))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches(rows):
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"].to_pylist()), strict=True):
                ids += end
                for k, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    held.append((doc_id, k, start, length, ids[4 * start : 4 * (start + length)]))
                    if len(held) >= BLOCK:
                        yield placed()
        if held:
            yield placed()

    return whole_texts(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, sequence_id long, offset long")


def op9(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0).drop("ids")
