"""Operator 1: token ids in binary files of directly addressable codes.

An id is split into chunks of eight bits, lowest first. Level k holds the k-th chunk of
every id that has one, in order; a bitmap per level says whose id goes on in the next
level, and a rank directory holds the number of such ids before every 512. Any token is
found with one rank lookup a level; no block is decoded for it.

File (little-endian): MAGIC, segments, footer, footer length as u64, MAGIC. A segment
holds up to SEGMENT_TOKENS ids of whole documents (more if one document is longer); the
footer is JSON with each part's place. Files of a data set are listed in ascending
order of doc_id by a manifest; a file that a lost task left behind isn't in it.

Defined results: a null text counts as empty and gives one id, the end id; null doc_id
come first; repeated doc_id keep all rows, in the order of their texts' hashes; an
empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, new_path, whole_texts
from .tokens import Encoder

MAGIC = b"DACIDS01"
SEGMENT_TOKENS = 1 << 20
RANK_BITS = 512
CHUNK_BITS = 8


def _filesystem(uri: str):
    """Where a URI leads, for executors: a local or mounted folder, HDFS or an object store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def split_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """[(chunks u8, bitmap u8 packed little-endian, rank directory u32)] of unsigned 32-bit ids."""
    levels = []
    rest = ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK_BITS
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (RANK_BITS // 8)))
        ones = np.bitwise_count(bits.reshape(-1, RANK_BITS // 8)).sum(axis=1, dtype=np.uint32)
        levels.append(((rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8), bits, np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.zeros(0, "<u4")))
        if not goes_on.any():
            return levels
        rest = more[goes_on]


def join_levels(levels) -> np.ndarray:
    """All ids of a segment, in order: the inverse of split_levels."""
    ids = None
    for chunks, bits, _ in reversed(levels):
        own = chunks.astype(np.uint32)
        if ids is not None:
            own[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] += ids << CHUNK_BITS
        ids = own
    return ids


def access(levels, i: int) -> int:
    """The i-th id of a segment, by rank lookups alone."""
    value = shift = 0
    for chunks, bits, ranks in levels:
        value |= int(chunks[i]) << shift
        if not bits[i >> 3] >> (i & 7) & 1:
            break
        top = i // RANK_BITS
        before = bits[top * (RANK_BITS // 8) : i >> 3]
        i = int(ranks[top]) + int(np.bitwise_count(before).sum()) + (int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
        shift += CHUNK_BITS
    return value


class _Writer:
    def __init__(self, uri: str):
        self.fs, path = _filesystem(uri)
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(path)
        self.at, self.segments, self.ids, self.docs, self.held = 0, [], [], [], 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> list[int]:
        self.out.write(data)
        self.at += len(data)
        return [self.at - len(data), len(data)]

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(ids)
        self.docs.append((doc_id, len(ids) // 4))
        self.held += len(ids) // 4
        if self.held >= SEGMENT_TOKENS:
            self.flush()

    def flush(self) -> None:
        if self.docs:
            levels = split_levels(np.frombuffer(b"".join(self.ids), "<u4"))
            known = np.array([d is not None for d, _ in self.docs])
            self.segments.append({
                "n_tokens": self.held, "n_docs": len(self.docs),
                "doc_id": self._put(np.array([d or 0 for d, _ in self.docs], "<i8").tobytes()), "known": self._put(np.packbits(known, bitorder="little").tobytes()),
                "length": self._put(np.array([n for _, n in self.docs], "<u8").tobytes()),
                "levels": [[self._put(part.tobytes()) for part in level] for level in levels],
            })
        self.ids, self.docs, self.held = [], [], 0

    def close(self) -> tuple[int, int]:
        self.flush()
        footer = json.dumps(self.segments).encode()
        self._put(footer)
        self._put(len(footer).to_bytes(8, "little"))
        self._put(MAGIC)
        self.out.close()
        return sum(s["n_docs"] for s in self.segments), sum(s["n_tokens"] for s in self.segments)


class TokenFile:
    """A reader: segments one by one, or any token by its place in the file."""

    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self._get(size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        n = int.from_bytes(tail[:8], "little")
        self.segments = json.loads(self._get(size - 16 - n, n))
        self.bases = np.cumsum([0, *(s["n_tokens"] for s in self.segments)])
        self._levels: dict[int, list] = {}

    def _get(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at) if n else b""

    def levels(self, k: int) -> list:
        return [tuple(np.frombuffer(self._get(*where), kind) for where, kind in zip(level, ("u1", "u1", "<u4"), strict=True)) for level in self.segments[k]["levels"]]

    def documents(self, k: int) -> tuple[list[int | None], np.ndarray]:
        s = self.segments[k]
        known = np.unpackbits(np.frombuffer(self._get(*s["known"]), "u1"), count=s["n_docs"], bitorder="little")
        return [int(d) if ok else None for d, ok in zip(np.frombuffer(self._get(*s["doc_id"]), "<i8"), known, strict=True)], np.frombuffer(self._get(*s["length"]), "<u8").astype(np.int64)

    def token(self, i: int) -> int:
        k = int(np.searchsorted(self.bases, i, side="right")) - 1
        if k not in self._levels:
            self._levels[k] = self.levels(k)
        return access(self._levels[k], i - int(self.bases[k]))

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int | None = 1, out: str | None = None) -> DataFrame:
    """Encode whole texts and write their ids in ascending order of doc_id.

    Documents are dealt by ranges of doc_id; each task sorts its range, encodes it and
    streams one file. Returns the manifest, a row a file: shard, uri, n_docs, n_tokens
    and start (ids in the files before). Only this manifest passes through the driver.
    """
    spark = docs.sparkSession
    out = out or new_path(spark, "token-files")
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, writer = Encoder.of(tokenizer), TaskContext.get().partitionId(), None
        for batch in batches(rows):
            if writer is None:  # its own name for each attempt
                uri = f"{out}/part-{shard:06d}-{uuid.uuid4().hex}.dac"
                writer = _Writer(uri)
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"].to_pylist()), strict=True):
                writer.add(doc_id, ids + end)
        if writer is not None:
            n_docs, n_tokens = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "uri": [uri], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    dealt = whole_texts(docs).withColumn("tie", F.xxhash64("text")).repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie")
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text").select("doc_id", "text")
    files = sorted(dealt.mapInArrow(write, "shard int, uri string, n_docs long, n_tokens long").collect())
    rows, start = [], 0
    for f in files:  # one row a file
        rows.append((*f, start))
        start += f.n_tokens
    return spark.createDataFrame(rows, "shard int, uri string, n_docs long, n_tokens long, start long")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit), ids_crc32."""

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for uri, start in zip(batch["uri"].to_pylist(), batch["start"].to_pylist(), strict=True):
                file = TokenFile(uri)
                for k in range(len(file.segments)):
                    doc_ids, lengths = file.documents(k)
                    data = join_levels(file.levels(k)).astype("<u4").tobytes()
                    ends = np.cumsum(lengths) * 4
                    parts = [data[a:b] for a, b in zip(ends - lengths * 4, ends, strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(doc_ids, pa.int64()), pa.array(start + int(file.bases[k]) + ends // 4 - lengths, pa.int64()), pa.array(lengths, pa.int64()),
                        pa.array(parts, pa.binary()), pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                    ], names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"])
                file.close()

    n = max(1, manifest.count())
    return manifest.select("uri", "start", "shard").repartitionByRange(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def op1(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    manifest = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(manifest).drop("ids")
