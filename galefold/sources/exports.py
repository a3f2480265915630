"""Files in and out: gate CSV, packed moments, station JSON, PNG rasters, synthetic points."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GATE_CSV = "tilt int, elevation double, collect_ms int, ray int, azimuth double, range double, nyquist double, raw double, corrected double"
STATIONS = "city string, icao string, latitude double, longitude double"


def write_gate_csv(gates: DataFrame, path: str) -> None:
    """One schema for all tools: raw and corrected side by side."""
    gates.select([c.split()[0] for c in GATE_CSV.split(", ")]).write.mode("overwrite").csv(path, header=True)


def read_gate_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=GATE_CSV)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=STATIONS, multiLine=True)


def packed_moment(gates: DataFrame, elevation_number: int, value: str = "v") -> DataFrame:
    """azimuth, range and value of one tilt's gates, as single floats."""
    return gates.where(F.col("elevation_number") == elevation_number).select(*(F.col(c).cast("float").alias(n) for c, n in (("azimuth_deg", "azimuth"), ("range_m", "range"), (value, "value"))))


def png_bytes(rgba: np.ndarray) -> bytes:
    h, w, _ = rgba.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgba.reshape(h, w * 4)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def png_tilts(pixels: DataFrame, by: list[str], size: int) -> DataFrame:
    """Pixels (by, px, py, r, g, b, a) to one PNG a tilt; a tilt has at most size * size pixels."""

    def run(t: pa.Table) -> pa.Table:
        image = np.zeros((size, size, 4), np.uint8)
        image[t["py"].to_numpy(), t["px"].to_numpy()] = np.stack([t[c].to_numpy() for c in "rgba"], axis=1)
        return pa.table({**{c: t[c].slice(0, 1) for c in by}, "png": pa.array([png_bytes(image)], pa.binary())})

    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}
    return pixels.select(*by, "px", "py", *"rgba").groupBy(*by).applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", png binary")


def synthetic_points(spark: SparkSession, n: int, lat: float, lon: float, radius_km: float, top: float, seed: int = 42) -> DataFrame:
    """Random places round a radar with an intensity that falls off like a bell."""
    rows = spark.range(n).select("id", (F.rand(seed) * 2 * 3.141592653589793).alias("turn"), (F.sqrt(F.rand(seed + 1)) * radius_km).alias("km"))
    return rows.select("id", (lat + F.col("km") * F.cos("turn") / 111.32).alias("latitude"), (lon + F.col("km") * F.sin("turn") / (111.32 * F.cos(F.radians(F.lit(float(lat)))))).alias("longitude"), (top * F.exp(-F.pow(F.col("km") / radius_km, 2) * 4)).alias("intensity"))
