"""Event catalogs in text: five-line and thirteen-line records, and one-line download lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.functions.seismic import MOMENT
from quakeframe.functions.text import origin_time


def records(spark: SparkSession, path: str, lines: int) -> DataFrame:
    """file, record number and ``lines`` lines of each record; a trailing partial record is left out. Files are read whole: they hold a month, or an event."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n").alias("all"))
    groups = F.transform(F.sequence(F.lit(0), F.floor(F.size("all") / lines).cast("int") - 1), lambda k: F.struct(k.alias("record"), F.slice("all", k * lines + 1, lines).alias("lines")))
    return text.filter(F.size("all") >= lines).select("file", F.explode(groups).alias("r")).select("file", "r.*")


def _cut(line: Column, start: int, end: int | None = None) -> Column:
    """Characters [start, end) of a line, trimmed."""
    return F.trim(F.substring(line, start + 1, (end - start) if end is not None else 2**31 - 1 - start))


def read_ndk(spark: SparkSession, path: str) -> DataFrame:
    """Five-line fixed-width records. Magnitudes of 0.0 are null; moments are scaled by the record's exponent, those under 1e-30 are 0; ``corrupt`` marks rows without a position, without an exponent or with fewer than twelve numbers of the tensor."""
    # fixed values: the columns in which the public format has its fields
    r = records(spark, path, 5)
    l1, l2, l4, l5 = (F.get("lines", F.lit(k)) for k in (0, 1, 3, 4))
    number = lambda c: c.try_cast("double")
    magnitude = lambda a, b: number(F.nullif(_cut(l1, a, b), F.lit("0.0")))
    parts = F.split(_cut(l4, 2), r"\s+")
    scale = F.pow(F.lit(10.0), F.trim(F.substring(l4, 1, 2)).try_cast("int"))

    def moment(k: int) -> Column:
        v = F.coalesce(number(F.get(parts, F.lit(k))) * scale, F.lit(0.0))
        return F.when(F.abs(v) < 1e-30, 0.0).otherwise(v)

    def plane(a: int, b: int, names: tuple[str, str, str]) -> list[Column]:
        p = F.split(_cut(l5, a, b), r"\s+")
        return [F.coalesce(F.get(p, F.lit(k)).try_cast("int"), F.lit(0)).alias(n) for k, n in enumerate(names)]

    whole = F.forall(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: number(F.get(parts, k))), lambda v: v.isNotNull())
    out = r.select(
        (~whole | scale.isNull()).alias("short"), "file", "record", _cut(l1, 0, 4).alias("catalog"), _cut(l1, 5, 15).alias("date"), _cut(l1, 16, 26).alias("time"), number(_cut(l1, 27, 33)).alias("latitude"), number(_cut(l1, 34, 41)).alias("longitude"), number(_cut(l1, 42, 47)).alias("depth"),
        magnitude(48, 51).alias("mb"), magnitude(52, 55).alias("ms"), _cut(l1, 56).alias("location"), _cut(l2, 0, 16).alias("event_name"), _cut(l2, 17, 61).alias("data_used"), _cut(l2, 62, 68).alias("source_type"),
        *[moment(2 * k).alias(n) for k, n in enumerate(MOMENT)], *[moment(2 * k + 1).alias(f"{n}_error") for k, n in enumerate(MOMENT)],
        *plane(58, 68, ("strike1", "dip1", "rake1")), *plane(69, 80, ("strike2", "dip2", "rake2")),
    )
    return out.withColumns({"origin": origin_time("date", "time"), "corrupt": F.col("latitude").isNull() | F.col("longitude").isNull() | F.col("depth").isNull() | F.col("short")}).drop("short")


def read_cmtsolution(spark: SparkSession, path: str) -> DataFrame:
    """Thirteen-line records, of one merged file or of a directory with a file for each event."""
    r = records(spark, path, 13)
    head = F.split(F.trim(F.regexp_replace(F.get("lines", F.lit(0)), r"^\s*[A-Za-z]+", "")), r"\s+")
    at = lambda k, kind: F.get(head, F.lit(k)).try_cast(kind)
    field = lambda k: F.trim(F.regexp_extract(F.get("lines", F.lit(k)), r":\s*(.*)$", 1))
    names = ("event_name", "time_shift", "half_duration", "latitude", "longitude", "depth", *MOMENT)
    cols = [field(k) if n == "event_name" else field(k).try_cast("double") for k, n in enumerate(names, 1)]
    pde = ("pde_lat", "pde_lon", "pde_depth", "pde_mb", "pde_ms")
    seconds = F.least(F.get(head, F.lit(5)).try_cast("double"), F.lit(59.999999))
    day = F.concat_ws("-", *[F.lpad(F.get(head, F.lit(k)), w, "0") for k, w in ((0, 4), (1, 2), (2, 2))])
    clock = F.concat_ws(":", *[F.lpad(F.get(head, F.lit(k)), 2, "0") for k in (3, 4)], F.format_string("%09.6f", seconds))
    return r.select("file", "record", *[c.alias(n) for c, n in zip(cols, names, strict=True)], F.try_to_timestamp(F.concat_ws(" ", day, clock)).alias("origin"), *[at(6 + k, "double").alias(n) for k, n in enumerate(pde)])


def read_par(spark: SparkSession, path: str) -> DataFrame:
    """One event a line, comments and blank lines left out, in either dialect: yyyymmdd hhmmss..., or date and time with separators; then latitude, longitude, depth, magnitude. Unreadable lines are left out."""
    t = spark.read.text(path).filter(~F.trim("value").rlike(r"^(#.*)?$")).select(F.split(F.trim("value"), r"\s+").alias("t"))
    tok = lambda k: F.get("t", F.lit(k))
    compact = tok(0).rlike(r"^\d{8}$")
    day = F.when(compact, F.regexp_replace(tok(0), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(F.regexp_replace(tok(0), "/", "-"))
    clock = F.when(compact, F.regexp_replace(tok(1), r"^(\d{2})(\d{2})(\d{2})", "$1:$2:$3")).otherwise(tok(1))
    out = t.select(origin_time(day, clock).alias("origin"), *[tok(k).try_cast("double").alias(n) for k, n in ((2, "latitude"), (3, "longitude"), (4, "depth"), (5, "magnitude"))])
    return out.filter(F.col("origin").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def merge_catalogs(parts: list[DataFrame]) -> DataFrame:
    """Catalogs in one, in order of time; what cannot be read counts as 1970."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.orderBy(F.coalesce("origin", F.lit("1970-01-01").cast("timestamp")), "latitude", "longitude")
