"""Readers of reference columns and of layered boundary files, whose sizes their formats fix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the formats: columns of a reference column file after the radius; rows and columns of a boundary file.
COLUMN = ("rho", "vpv", "vsv", "qkappa", "qmu", "vph", "vsh", "eta")
ROWS, COLUMNS, TOP, MOHO = 180, 360, 2, 8
RADIUS_KM = 6371.0


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 0), f: the fields of each line that has any; a file is one row until then, so lines keep their order."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    return text.filter(F.trim("text") != "").select("path", "line", F.split(F.trim("text"), r"\s+").alias("f"))


def reference_column(spark: SparkSession, path: str) -> DataFrame:
    """path, knot, depth, side and ``COLUMN`` of every solid knot of the mantle and crust, in km, km/s and g/cm3.

    Three lines of header; the third number of the third line counts the knots of the core, which come first. Depth falls
    along the file. Two knots of one depth are the sides of an interface: ``side`` is 0 for the upper and 1 for the lower
    one. Knots above the first solid one (vsv 0) are left out.
    """
    rows = _lines(spark, path)
    core = rows.filter("line = 2").select("path", F.get("f", F.lit(2)).cast("int").alias("core"))
    value = {c: F.get("f", F.lit(k)).cast("double") / (1 if c in ("qkappa", "qmu", "eta") else 1000.0) for k, c in enumerate(COLUMN, 1)}
    knots = rows.filter("line > 2").join(core, "path").filter(F.col("line") - 3 >= F.col("core"))
    knots = knots.select("path", (-F.col("line")).alias("knot"), (F.lit(RADIUS_KM) - F.get("f", F.lit(0)).cast("double") / 1000.0).alias("depth"), *[c.alias(n) for n, c in value.items()])
    solid = knots.filter("vsv > 0").groupBy("path").agg(F.min("knot").alias("first"))
    kept = knots.join(solid, "path").filter("knot >= first").drop("first")
    twins = kept.groupBy("path", "depth").agg(F.min("knot").alias("upper"))
    return kept.join(twins, ["path", "depth"]).withColumn("side", (F.col("knot") > F.col("upper")).cast("int")).select("path", "knot", "depth", "side", *COLUMN)


def boundary_layers(spark: SparkSession, path: str) -> DataFrame:
    """lat, lon (0 to 360), tops (elevations of the layers' tops, km), moho (its depth below the solid surface): cells of one degree from the north-west."""
    rows = _lines(spark, path).withColumn("f", F.transform("f", lambda x: x.cast("double")))
    lat, lon = F.lit(ROWS / 2 - 0.5) - F.floor(F.col("line") / COLUMNS), F.pmod(F.col("line") % COLUMNS - COLUMNS / 2 + 0.5, F.lit(float(COLUMNS)))
    return rows.filter(F.col("line") < ROWS * COLUMNS).select(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), F.col("f").alias("tops"), (F.get("f", F.lit(TOP)) - F.get("f", F.lit(MOHO))).alias("moho"))
