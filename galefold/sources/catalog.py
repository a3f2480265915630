"""The scan catalogue: keys YYYY/MM/DD/ICAO/ICAOyyyymmdd_hhmmss_V06 as rows with partition columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILE_NAME = r"([A-Z0-9]{4})(\d{8})_(\d{6})_V06$"


def parse_scans(paths: DataFrame) -> DataFrame:
    """icao, year, month, day, time, scan_ts, path of the keys that name a volume; metadata files are none."""
    name = F.element_at(F.split("path", "/"), -1)
    part = lambda k: F.regexp_extract(name, FILE_NAME, k)
    rows = paths.where(name.rlike(FILE_NAME))
    return rows.select(part(1).alias("icao"), F.substring(part(2), 1, 4).alias("year"), F.substring(part(2), 5, 2).alias("month"), F.substring(part(2), 7, 2).alias("day"), part(3).alias("time"), F.to_timestamp_ntz(F.concat(part(2), part(3)), F.lit("yyyyMMddHHmmss")).alias("scan_ts"), "path")


def years(scans: DataFrame) -> DataFrame:
    return scans.select("year").distinct()


def months(scans: DataFrame, year: str) -> DataFrame:
    return scans.where(F.col("year") == year).select("month").distinct()


def days(scans: DataFrame, icao: str, year: str, month: str) -> DataFrame:
    return scans.where((F.col("icao") == icao) & (F.col("year") == year) & (F.col("month") == month)).select("day").distinct()


def times(scans: DataFrame, icao: str, year: str, month: str, day: str) -> DataFrame:
    return scans.where((F.col("icao") == icao) & (F.col("year") == year) & (F.col("month") == month) & (F.col("day") == day)).select("time").distinct()


def find_scan(scans: DataFrame, icao: str, year: str, month: str, day: str, time: str) -> DataFrame:
    """The first path of a scan, or no row."""
    return scans.where((F.col("icao") == icao) & (F.col("year") == year) & (F.col("month") == month) & (F.col("day") == day) & (F.col("time") == time)).orderBy("path").limit(1)


def latest_scans(scans: DataFrame, now: Column, days_back: int = 2) -> DataFrame:
    """Per station the latest scan of today or the last `days_back` days."""
    day = F.to_date("scan_ts")
    recent = scans.where((day <= F.to_date(now)) & (day >= F.date_sub(F.to_date(now), days_back)))
    return recent.groupBy("icao").agg(F.max_by("path", F.struct("scan_ts", "path")).alias("path"), F.max("scan_ts").alias("scan_ts"))


def https_url(path: Column, bucket: str, host: str) -> Column:
    """An s3 key as a URL; only a leading bucket is replaced."""
    return F.when(path.startswith(f"s3://{bucket}/"), F.concat(F.lit(f"https://{host}/"), F.substr(path, F.lit(len(f"s3://{bucket}/") + 1)))).otherwise(path)


def download_ranges(size: Column, parts: int = 6, least: int = 2 << 20) -> Column:
    """Array of (first, last) byte of each part; one part below `least`."""
    n = F.when(size >= least, F.lit(parts)).otherwise(F.lit(1)).cast("long")
    step = F.ceil(size / n).cast("long")
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: F.struct((k * step).alias("first"), (F.least((k + 1) * step, size) - 1).alias("last")))


def allowed(url: Column, prefixes: list[str]) -> Column:
    """Whether a URL begins with one of the prefixes that may be fetched."""
    return F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(url, p))


def day_prefix(now: Column, icao: Column, days_back: int = 0) -> Column:
    """The folder YYYY/MM/DD/ICAO/ of a station's scans some days ago."""
    return F.concat(F.date_format(F.date_sub(F.to_date(now), days_back), "yyyy/MM/dd/"), icao, F.lit("/"))


def listed(names: DataFrame, column: str, by: list[str], newest_first: bool = False) -> DataFrame:
    """A listing with the place of each name, from 0, in ascending or descending order."""
    order = F.col(column).desc() if newest_first else F.col(column).asc()
    return names.withColumn("place", (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).cast("int"))


def with_stations(scans: DataFrame, stations: DataFrame) -> DataFrame:
    """Scans with their station's city and place, null where the station is unknown."""
    return scans.join(stations.select("icao", "city", "latitude", "longitude"), "icao", "left")
