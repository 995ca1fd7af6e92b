"""Station tables from CSV, whitespace text and nested inventories, and listings of waveform files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.functions.text import waveform_key
from quakeframe.operators.joins import by_priority
from quakeframe.operators.windows import keep_one

REQUIRED = ("Network", "Station", "Latitude", "Longitude")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, required: Sequence[str] = REQUIRED) -> DataFrame:
    """A CSV table with a header; raises where a required column is missing."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df


def read_stations_file(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace table: station, network, latitude, longitude, elevation, burial."""
    t = spark.read.text(path).filter(~F.trim("value").rlike(r"^(#.*)?$")).select(F.split(F.trim("value"), r"\s+").alias("t"))
    number = lambda k: F.get("t", F.lit(k)).try_cast("double")
    return t.select(F.get("t", F.lit(0)).alias("station"), F.get("t", F.lit(1)).alias("network"), number(2).alias("latitude"), number(3).alias("longitude"), F.coalesce(number(4), F.lit(0.0)).alias("elevation"), F.coalesce(number(5), F.lit(0.0)).alias("burial")).filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def flatten_inventory(df: DataFrame) -> DataFrame:
    """Rows of an inventory (provider, networks of stations): missing coordinates are 0, missing text is empty."""
    nets = df.select("provider", F.explode("networks").alias("n"))
    s = nets.select("provider", F.col("n.code").alias("network"), F.coalesce("n.description", F.lit("")).alias("network_description"), F.explode("n.stations").alias("s"))
    return s.select("provider", "network", "network_description", F.col("s.code").alias("station"), *[F.coalesce(F.col(f"s.{c}"), F.lit(0.0)).alias(c) for c in ("latitude", "longitude", "elevation")], *[F.coalesce(F.col(f"s.{c}"), F.lit("")).alias(c) for c in ("site", "start_date", "end_date")], F.concat_ws(".", F.col("network"), F.col("s.code")).alias("station_id"))


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Inventories landed as JSON, one provider a line."""
    station = "struct<code:string,latitude:double,longitude:double,elevation:double,site:string,start_date:string,end_date:string>"
    return flatten_inventory(spark.read.schema(f"provider string, networks array<struct<code:string,description:string,stations:array<{station}>>>").json(path))


def coordinate_lookup(parts: Sequence[DataFrame]) -> DataFrame:
    """One row for each station id; later tables win."""
    return by_priority(parts, ["station_id"])


def read_provider_stations(spark: SparkSession, path: str) -> DataFrame:
    """Station files named after their provider, NET.STA in the first column (the provider stands in for a missing network); the first row of a name stays."""
    t = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([A-Za-z0-9]+)", 1).alias("provider"), F.split(F.trim("value"), r"\s+").alias("t"), F.monotonically_increasing_id().alias("_o"))
    name = F.get("t", F.lit(0))
    dotted = name.contains(".")
    rows = t.select("provider", F.when(dotted, F.substring_index(name, ".", 1)).otherwise(F.col("provider")).alias("network"), F.when(dotted, F.substring_index(name, ".", -1)).otherwise(name).alias("station"), F.get("t", F.lit(1)).try_cast("double").alias("latitude"), F.get("t", F.lit(2)).try_cast("double").alias("longitude"), "_o").filter(F.col("latitude").isNotNull())
    return keep_one(rows, ["network", "station"], ["_o"]).drop("_o")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Paths below a folder, by name; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))


def waveform_coverage(files: DataFrame) -> DataFrame:
    """Per event folder the numbers of files, stations, networks and channels in a listing."""
    key = waveform_key("path")
    channel = F.regexp_extract("name", r"\.([A-Z]{2}[A-Z0-9])(?:\.|_|$)", 1)
    return files.withColumns({"_key": key, "_ch": F.nullif(channel, F.lit(""))}).groupBy(F.col("folder").alias("event_id")).agg(F.count("*").alias("n_files"), F.count_distinct("_key").alias("n_stations"), F.count_distinct(F.substring_index("_key", ".", 1)).alias("n_networks"), F.count_distinct("_ch").alias("n_channels"))


def naming_of(files: DataFrame) -> str:
    """Dialect of file names by the majority of all: station-first where the first field has three characters or more."""
    row = files.agg(F.count_if(F.length(F.substring_index("name", ".", 1)) >= 3).alias("s"), F.count("*").alias("n")).first()
    return "station_first" if row["n"] and row["s"] * 2 > row["n"] else "network_first"
