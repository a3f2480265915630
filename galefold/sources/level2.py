"""Level II archive volumes: bytes to blocks to radials to gates, and back.

A file is a 24-byte header and bzip2 blocks, each behind a signed big-endian length. A
volume becomes a row a block first, so that blocks of one file inflate on many executors;
each block becomes a row a radial; gates are exploded by Spark. Bytes that make no sense
(a damaged block, pointers beyond a message) give no rows, never an error.
"""

from __future__ import annotations

import bz2
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import scalar as S

# Fixed values of the public interface document.
HEADER_BYTES = 24
CTM_BYTES = 12
LEGACY_FRAME_BYTES = 2432
RADIAL_MESSAGE = 31
MOMENTS = ("REF", "VEL", "SW ", "ZDR", "PHI", "RHO")

_MESSAGE = struct.Struct(">HBBHHIHH")
_RADIAL = struct.Struct(">4sIHHfBBHBBBBfBbH10I")
_MOMENT = struct.Struct(">B3sIHhhhhBBff")
_VOLUME = struct.Struct(">B3sHBBffhH")

MOMENT_TYPE = "struct<name:string,gate_count:int,first_gate:int,gate_spacing:int,word_size:int,scale:float,offset:float,codes:array<int>>"
BLOCKS = "volume_id string, icao string, block_idx int, block binary"
RADIALS = f"volume_id string, icao string, block_idx int, seq int, days int, collect_ms int, elevation_number int, azimuth_deg float, elevation_deg float, nyquist_ms float, lat float, lon float, vcp int, moments array<{MOMENT_TYPE}>"


def split_blocks(data: bytes) -> tuple[str, list[bytes]]:
    """Station and bzip2 blocks of a file; a length that doesn't lead to a block is searched past."""
    if len(data) < HEADER_BYTES:
        return "", []
    blocks, at = [], HEADER_BYTES
    while at + 8 <= len(data):
        if data[at + 4 : at + 7] != b"BZh":
            found = data.find(b"BZh", at + 5)
            if found < 0:
                break
            at = found - 4
        (size,) = struct.unpack_from(">i", data, at)
        blocks.append(data[at + 4 : at + 4 + abs(size)])
        at += 4 + max(1, abs(size))
    return data[20:24].decode("ascii", "replace"), blocks


def messages(block: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(type, day, milliseconds, body) of each message of an inflated block. Messages other than radials have frames of a fixed size."""
    at = 0
    while at + CTM_BYTES + _MESSAGE.size <= len(block):
        size, _, kind, _, days, ms, _, _ = _MESSAGE.unpack_from(block, at + CTM_BYTES)
        if kind == 0 or size == 0:
            # An empty frame ends a run of messages only if nothing follows it.
            at += LEGACY_FRAME_BYTES
            continue
        step = size * 2 + CTM_BYTES if kind == RADIAL_MESSAGE else LEGACY_FRAME_BYTES
        if kind == RADIAL_MESSAGE and at + step > len(block):
            break
        yield kind, days, ms, block[at + CTM_BYTES + _MESSAGE.size : at + size * 2 + CTM_BYTES]
        at += step


def decode_radial(body: bytes) -> dict | None:
    if len(body) < _RADIAL.size:
        return None
    head = _RADIAL.unpack_from(body)
    ms, days, azimuth, elevation_number, elevation, pointers = head[1], head[2], head[4], head[10], head[12], head[16:]
    out = {"days": days, "collect_ms": ms, "elevation_number": elevation_number, "azimuth_deg": azimuth, "elevation_deg": elevation, "nyquist_ms": None, "lat": None, "lon": None, "vcp": None, "moments": []}
    inside = [p for p in pointers if 0 < p < len(body) - 4]
    for p in inside:
        name = body[p + 1 : p + 4]
        if name == b"VOL" and p + 44 <= len(body):
            v = _VOLUME.unpack_from(body, p)
            out["lat"], out["lon"], out["vcp"] = v[5], v[6], struct.unpack_from(">H", body, p + 40)[0]
        elif name == b"RAD" and p + 18 <= len(body):
            out["nyquist_ms"] = struct.unpack_from(">h", body, p + 16)[0] / 100
        elif name.decode("ascii", "replace") in MOMENTS and p + _MOMENT.size <= len(body):
            m = _MOMENT.unpack_from(body, p)
            count, word = m[3], m[9]
            if word in (8, 16):
                codes = np.frombuffer(body[p + _MOMENT.size : p + _MOMENT.size + count * word // 8], "u1" if word == 8 else ">u2").astype(np.int32)
                out["moments"].append({"name": m[1].decode(), "gate_count": count, "first_gate": m[4], "gate_spacing": m[5], "word_size": word, "scale": m[10], "offset": m[11], "codes": codes.tolist()})
    return out


def decode_block(block: bytes) -> Iterator[dict]:
    try:
        data = bz2.decompress(block)
    except (OSError, ValueError):
        return
    seq = 0
    for kind, _, _, body in messages(data):
        if kind == RADIAL_MESSAGE and (radial := decode_radial(body)):
            yield {"seq": seq, **radial}
            seq += 1


def encode_volume(icao: str, days: int, radials: list[dict], per_block: int = 120, lat: float = 36.98, lon: float = -77.01) -> bytes:
    """A volume of radials (azimuth_deg, elevation_deg, elevation_number, collect_ms, nyquist_ms, moments as decoded)."""
    out = [struct.pack(">9s3sII4s", b"AR2V0006.", b"001", days, 0, icao.encode())]
    for at in range(0, len(radials), per_block):
        block = []
        for k, r in enumerate(radials[at : at + per_block], at):
            parts = [struct.pack(">B3sHBBffhH5fHH", 68, b"VOL", 44, 1, 0, lat, lon, 0, 0, 0, 0, 0, 0, 0, 212, 0), struct.pack(">B3sHhf", 68, b"ELV", 12, 0, 0.0), struct.pack(">B3sHhffhH", 68, b"RAD", 20, 0, 0.0, 0.0, round(r["nyquist_ms"] * 100), 0)]
            for m in r["moments"]:
                codes = np.asarray(m["codes"], "u1" if m["word_size"] == 8 else ">u2").tobytes()
                parts.append(_MOMENT.pack(68, m["name"].encode(), 0, m["gate_count"], m["first_gate"], m["gate_spacing"], 0, 0, 0, m["word_size"], m["scale"], m["offset"]) + codes + b"\0" * (len(codes) % 2))
            places, place = [], _RADIAL.size
            for p in parts:
                places.append(place)
                place += len(p)
            body = _RADIAL.pack(icao.encode(), r["collect_ms"], days, k + 1, r["azimuth_deg"], 0, 0, place, 1, 0, r["elevation_number"], 1, r["elevation_deg"], 0, 0, len(parts), *(places + [0] * 10)[:10]) + b"".join(parts)
            body += b"\0" * (len(body) % 2)
            block.append(b"\0" * CTM_BYTES + _MESSAGE.pack((len(body) + _MESSAGE.size) // 2, 0, RADIAL_MESSAGE, k & 0xFFFF, days, r["collect_ms"], 1, 1) + body)
        packed = bz2.compress(b"".join(block))
        out.append(struct.pack(">i", len(packed)) + packed)
    return b"".join(out)


def volume_blocks(files: DataFrame) -> DataFrame:
    """Rows (path, content) of the binaryFile source: a row a block, dealt out evenly."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for path, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                icao, blocks = split_blocks(data or b"")
                if blocks:
                    name = path.rsplit("/", 1)[-1]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(blocks)), pa.array([icao] * len(blocks)), pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], names=["volume_id", "icao", "block_idx", "block"])

    return files.select("path", "content").mapInArrow(run, BLOCKS).repartition("volume_id", "block_idx")


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """A row a radial."""
    moment = pa.struct([("name", pa.string()), ("gate_count", pa.int32()), ("first_gate", pa.int32()), ("gate_spacing", pa.int32()), ("word_size", pa.int32()), ("scale", pa.float32()), ("offset", pa.float32()), ("codes", pa.list_(pa.int32()))])
    whole = {"seq": pa.int32(), "days": pa.int32(), "collect_ms": pa.int32(), "elevation_number": pa.int32(), "azimuth_deg": pa.float32(), "elevation_deg": pa.float32(), "nyquist_ms": pa.float32(), "lat": pa.float32(), "lon": pa.float32(), "vcp": pa.int32(), "moments": pa.list_(moment)}

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for volume, icao, k, block in zip(*(batch[c].to_pylist() for c in ("volume_id", "icao", "block_idx", "block")), strict=True):
                if radials := list(decode_block(block)):
                    n = len(radials)
                    own = [pa.array([volume] * n), pa.array([icao] * n), pa.array([k] * n, pa.int32()), *(pa.array([r[c] for r in radials], t) for c, t in whole.items())]
                    yield pa.RecordBatch.from_arrays(own, names=["volume_id", "icao", "block_idx", *whole])

    return blocks.mapInArrow(run, RADIALS)


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """Radials of all volumes under a path or glob."""
    return decode_blocks(volume_blocks(spark.read.format("binaryFile").load(path)))


def radial_gates(radials: DataFrame) -> DataFrame:
    """Valid gates with value and range. ray_idx counts the radials of a tilt that have a valid VEL gate, in file order; null for others."""
    m = radials.withColumn("m", F.explode("moments")).withColumn("moment", F.trim("m.name"))
    valid_vel = F.exists("m.codes", lambda c: c > 1)
    order = Window.partitionBy("volume_id", "elevation_number").orderBy("block_idx", "seq")
    rays = m.where((F.col("moment") == "VEL") & valid_vel).withColumn("ray_idx", F.row_number().over(order) - 1).select("volume_id", "elevation_number", "block_idx", "seq", "ray_idx")
    cells = m.select("volume_id", "icao", "elevation_number", "block_idx", "seq", "azimuth_deg", "elevation_deg", "nyquist_ms", "moment", "m.first_gate", "m.gate_spacing", "m.scale", "m.offset", F.posexplode("m.codes").alias("gate_idx", "raw_code")).where(S.valid_code("moment", "raw_code"))
    cells = cells.withColumns({"value": S.decode_value("raw_code", F.col("scale"), F.col("offset")), "range_m": (F.col("first_gate") + F.col("gate_idx") * F.col("gate_spacing")).cast("float")})
    return cells.join(rays, ["volume_id", "elevation_number", "block_idx", "seq"], "left").drop("first_gate", "gate_spacing", "scale", "offset")


class Level2DataSource(DataSource):
    """spark.read.format("level2").load(path): radials, one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "level2"

    def schema(self) -> str:
        return RADIALS

    def reader(self, schema) -> DataSourceReader:
        return _Level2Reader(self.options["path"])


class _Level2Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _files(self):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        return system, path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = self._files()
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path))
        return [InputPartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = self._files()
        with system.open_input_stream(partition.value) as f:
            icao, blocks = split_blocks(f.read())
        for k, block in enumerate(blocks):
            for r in decode_block(block):
                moments = [tuple(m.values()) for m in r["moments"]]
                yield (partition.value.rsplit("/", 1)[-1], icao, k, r["seq"], r["days"], r["collect_ms"], r["elevation_number"], r["azimuth_deg"], r["elevation_deg"], r["nyquist_ms"], r["lat"], r["lon"], r["vcp"], moments)
