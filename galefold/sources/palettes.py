"""Colour palettes as text lines: control points, metadata, dense tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def palette_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of <moment>/<name>.pal files: moment, name, line."""
    part = F.split("_metadata.file_path", "/")
    rows = spark.read.option("pathGlobFilter", "*.pal").option("recursiveFileLookup", "true").text(path)
    return rows.select(F.element_at(part, -2).alias("moment"), F.regexp_replace(F.element_at(part, -1), r"\.pal$", "").alias("name"), F.col("value").alias("line"))


def _tokens(lines: DataFrame) -> DataFrame:
    """Lines without comments as words; the key is in lower case."""
    words = F.split(F.trim(F.regexp_replace(F.substring_index("line", ";", 1), r"\s+", " ")), " ")
    return lines.withColumn("words", words).where("words[0] <> ''").withColumn("key", F.lower(F.get("words", F.lit(0))))


def control_points(lines: DataFrame) -> DataFrame:
    """Per palette its points (value, r, g, b, a), with a point half-way to the next one where a line gives a second colour."""
    rows = _tokens(lines)
    number = lambda k: F.expr(f"try_cast(get(words, {k}) as double)")
    rows = rows.where(F.col("key").isin("color:", "color4:") | (F.col("key").isin("color", "color4") & number(1).isNotNull()))
    has_alpha = F.col("key").startswith("color4")
    rows = rows.select("moment", "name", number(1).alias("value"), *(number(k).cast("int").alias(c) for k, c in ((2, "r"), (3, "g"), (4, "b"))), F.when(has_alpha, F.coalesce(number(5), F.lit(255))).otherwise(F.lit(255)).cast("int").alias("a"), *(F.when(~has_alpha, number(k)).cast("int").alias(c) for k, c in ((5, "r2"), (6, "g2"), (7, "b2"))))
    after = F.lead("value").over(Window.partitionBy("moment", "name").orderBy("value"))
    half = F.struct(((F.col("value") + F.col("next")) / 2).alias("value"), F.col("r2").alias("r"), F.col("g2").alias("g"), F.col("b2").alias("b"), F.col("a").alias("a"))
    own = F.struct("value", "r", "g", "b", "a")
    points = F.when(F.col("b2").isNotNull() & F.col("next").isNotNull(), F.array(own, half)).otherwise(F.array(own))
    return rows.withColumn("next", after).select("moment", "name", F.explode(points).alias("p")).select("moment", "name", "p.*")


def metadata(lines: DataFrame) -> DataFrame:
    """moment, name, key, value of the other lines that have a key."""
    rows = _tokens(lines).where(F.col("key").endswith(":") & ~F.col("key").isin("color:", "color4:"))
    return rows.select("moment", "name", F.regexp_replace("key", ":$", "").alias("key"), F.array_join(F.slice("words", 2, F.size("words")), " ").alias("value"))


def dense(points: DataFrame, size: int = 256) -> DataFrame:
    """Per palette `size` entries (i, value, r, g, b, a) at equal steps, linear between points, clamped at the ends."""
    ends = points.groupBy("moment", "name").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    w = Window.partitionBy("moment", "name").orderBy("value")
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.col(c)).alias(f"{c}_")
    steps = points.select("*", *(nxt(c) for c in ("value", "r", "g", "b", "a"))).join(ends, ["moment", "name"])
    i_of = lambda v: (v - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-12)) * (size - 1)
    # Each stretch between two points gives the entries from its first point on, up to the next.
    first, last = F.ceil(i_of(F.col("value"))), F.when(F.col("value_") == F.col("high"), F.lit(size - 1)).otherwise(F.ceil(i_of(F.col("value_"))) - 1)
    rows = steps.where("value_ > value").withColumn("i", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    rows = rows.withColumn("v", F.col("low") + F.col("i") / (size - 1) * (F.col("high") - F.col("low"))).withColumn("t", (F.col("v") - F.col("value")) / (F.col("value_") - F.col("value")))
    return rows.select("moment", "name", F.col("i").cast("int").alias("i"), F.col("v").alias("value"), *(F.floor(F.col(c) + (F.col(f"{c}_") - F.col(c)) * F.col("t") + 0.5).cast("int").alias(c) for c in "rgba"))


def catalogue(files: DataFrame, column: str) -> DataFrame:
    """moment and name of the palette files .../MOMENT/Name.pal, each once."""
    at = lambda k: F.regexp_extract(column, r"([^/]+)/([^/]+)\.pal$", k)
    return files.select(at(1).alias("moment"), at(2).alias("name")).where("name <> ''").distinct()


def choose(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (wanted as MOMENT/Name, moment) with `palette`: that one; else the name under the row's own moment; else that moment's first.

    known: (moment, name), each once. Null where the moment has no palette.
    """
    rows = wanted.withColumns({"m_": F.substring_index("wanted", "/", 1), "n_": F.substring_index("wanted", "/", -1)})
    one = known.select(F.col("moment").alias("m_"), F.col("name").alias("n_"), F.concat_ws("/", "moment", "name").alias("first_"))
    two = known.select("moment", F.col("name").alias("n_"), F.concat_ws("/", "moment", "name").alias("second_"))
    three = known.groupBy("moment").agg(F.concat_ws("/", "moment", F.min("name")).alias("third_"))
    rows = rows.join(one, ["m_", "n_"], "left").join(two, ["moment", "n_"], "left").join(three, "moment", "left")
    return rows.withColumn("palette", F.coalesce("first_", "second_", "third_")).drop("m_", "n_", "first_", "second_", "third_")
