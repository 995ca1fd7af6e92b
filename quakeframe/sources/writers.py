"""Sinks: partitioned Parquet, CSV, fixed-width text, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.functions.numeric import Num, col
from quakeframe.functions.seismic import MOMENT, half_duration


ONE_FILE = 100_000


def write_table(df: DataFrame, path: str, partition: Sequence[str] = (), kind: str = "parquet", mode: str = "overwrite") -> None:
    """A table by partition columns, whose rows are gathered first so that a partition has few files."""
    out = df.repartition(*partition) if partition else df
    writer = out.write.mode(mode)
    if partition:
        writer = writer.partitionBy(*partition)
    writer.option("header", True).format(kind).save(path)


def voxel_csv(df: DataFrame, params: Sequence[str]) -> DataFrame:
    """Voxels for a text export: rows without any value left out, six decimals, nan for missing."""
    have = F.coalesce(*[F.col(p) for p in params]).isNotNull()
    text = [F.coalesce(F.format_string("%.6f", F.col(p).cast("double")), F.lit("nan")) for p in params]
    return df.filter(have).select("latitude", "longitude", "depth", *[F.when(F.col(p).isNull(), "nan").otherwise(t).alias(p) for p, t in zip(params, text, strict=True)])


def station_lines(df: DataFrame, station: str = "station", network: str = "network", lat: str = "latitude", lon: str = "longitude", elevation: Num = 0.0, burial: Num = 0.0) -> DataFrame:
    """Fixed-width station lines in order of network and station."""
    line = F.format_string("%-8s %-4s %12.4f %12.4f %10.1f %8.1f", station, network, F.col(lat).cast("double"), F.col(lon).cast("double"), col(elevation).cast("double"), col(burial).cast("double"))
    return df.orderBy(network, station).select(line.alias("value"))


def par_lines(df: DataFrame, origin: str = "origin", lat: str = "latitude", lon: str = "longitude", depth: str = "depth", magnitude: str = "magnitude") -> DataFrame:
    """Download list: an event a line, in order of time."""
    line = F.concat_ws(" ", F.date_format(origin, "yyyyMMdd HHmmss"), F.format_string("%.4f %.4f %.2f %.2f", *[F.col(c).cast("double") for c in (lat, lon, depth, magnitude)]))
    return df.orderBy(origin, lat, lon).select(line.alias("value"))


def cmt_text(event: str = "event_name", origin: str = "origin", magnitude: Num | None = None) -> Column:
    """Thirteen lines of an event."""
    duration = half_duration(magnitude) if magnitude is not None else F.col("half_duration")
    head = F.concat(F.lit("PDE "), F.date_format(origin, "yyyy MM dd HH mm ss.SS"), F.format_string(" %.4f %.4f %.1f %.1f %.1f", F.col("latitude"), F.col("longitude"), F.col("depth"), F.coalesce("mb", F.lit(0.0)), F.coalesce("ms", F.lit(0.0))))
    named = [F.concat(F.lit("event name:     "), F.col(event)), F.concat(F.lit("time shift:     "), F.format_string("%.4f", F.coalesce("time_shift", F.lit(0.0)))), F.concat(F.lit("half duration:  "), F.format_string("%.4f", duration))]
    named += [F.concat(F.lit(f"{n}: "), F.format_string("%.4f", F.col(n))) for n in ("latitude", "longitude", "depth")]
    named += [F.concat(F.lit(f"M{m[1:]}: "), F.format_string("%.6e", F.col(m))) for m in MOMENT]
    return F.concat_ws("\n", head, *named)


def write_lines(lines: DataFrame, path: str, partition: str | None = None) -> None:
    """Text of a ``value`` column: one file for at most ONE_FILE lines, else part files in the order of the lines; or a folder for each value of ``partition``."""
    if partition:
        lines.write.mode("overwrite").partitionBy(partition).text(path)
    else:
        one = lines.limit(ONE_FILE + 1).count() <= ONE_FILE
        (lines.coalesce(1) if one else lines).write.mode("overwrite").text(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def metadata(df: DataFrame, **values: object) -> DataFrame:
    """One row of JSON: what is given, and the number of rows."""
    given = [F.lit(str(v)).alias(k) for k, v in values.items()]
    return df.agg(F.count("*").alias("n_rows")).select(F.to_json(F.struct("n_rows", *given)).alias("value"))
