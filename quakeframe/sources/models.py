"""Gridded models as long tables of voxels (model, latitude, longitude, depth, parameters), from text and to Parquet.

NetCDF and HDF5 files are read by ``netcdf``, box by box.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import islice
from typing import Any
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.functions.numeric import clean
from quakeframe.sources.netcdf import read_netcdf

#: Fixed value: what model files write where a value is missing.
MISSING = 9999.0


def _value(c: Column) -> Column:
    """A number; nan, NaN and 9999.0 are missing."""
    v = clean(c.try_cast("double"))
    return F.when(v != MISSING, v)


def read_geocsv(spark: SparkSession, path: str, model: str, density_scale: float = 1000.0) -> DataFrame:
    """Columns parted by ``|``, comments with ``#``, names in the first line; rho is scaled to kg/m3."""
    df = spark.read.option("sep", "|").option("comment", "#").option("header", True).csv(path)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    names = [c for c in df.columns if c not in ("latitude", "longitude", "depth")]
    cols = [_value(F.trim(c)) * (density_scale if c == "rho" else 1.0) for c in names]
    return df.select(F.lit(model).alias("model"), *[F.trim(c).try_cast("double").alias(c) for c in ("latitude", "longitude", "depth")], *[c.alias(n) for c, n in zip(cols, names, strict=True)])


def read_text_grid(spark: SparkSession, path: str, model: str, columns: Sequence[str], scale: dict[str, float] | None = None, skip: str = r"^\s*(#.*)?$") -> DataFrame:
    """Whitespace columns in a stated order; ``scale`` multiplies (m/s to km/s, say)."""
    t = spark.read.text(path).filter(~F.col("value").rlike(skip)).select(F.split(F.trim("value"), r"\s+").alias("t"))
    return t.select(F.lit(model).alias("model"), *[(_value(F.get("t", F.lit(k))) * (scale or {}).get(n, 1.0)).alias(n) for k, n in enumerate(columns) if n])


def read_by_file(spark: SparkSession, path: str, model: str, columns: Sequence[str], axis: str, pattern: str, scale: dict[str, float] | None = None) -> DataFrame:
    """Files of one level each: the level of ``axis`` is the number that ``pattern`` finds in the file's name."""
    t = spark.read.text(path).select("value", F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).try_cast("double").alias(axis)).filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    t = t.select(axis, F.split(F.trim("value"), r"\s+").alias("t"))
    return t.select(F.lit(model).alias("model"), axis, *[(_value(F.get("t", F.lit(k))) * (scale or {}).get(n, 1.0)).alias(n) for k, n in enumerate(columns) if n])


def read_voxels(spark: SparkSession, path: str, model: str | None = None, params: Sequence[str] | None = None) -> DataFrame:
    """Voxels in Parquet, partitioned by model: the model is pruned, and only the parameters asked for are read."""
    df = spark.read.parquet(path)
    if model is not None:
        df = df.filter(F.col("model") == model)
    return df.select("model", "latitude", "longitude", "depth", *[p for p in params if p in df.columns]) if params else df


def read_xlsx(spark: SparkSession, path: str, model: str, columns: Sequence[str] | None = None, scale: dict[str, float] | None = None) -> DataFrame:
    """The first sheet of workbooks as voxels: names in the first row (or as given, in order). A workbook has a million rows at most and is read by one task."""
    files = spark.read.format("binaryFile").load(path)
    names = list(columns) if columns else [c.strip().lower() for c in next(_sheet(files.orderBy("path").select("content").first()[0]))]
    skip = 0 if columns else 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf["content"]:
                rows = [(r + [None] * len(names))[: len(names)] for r in islice(_sheet(content), skip, None)]
                yield pd.DataFrame({"t": rows})

    t = files.select("content").mapInPandas(run, "t array<string>")
    return t.select(F.lit(model).alias("model"), *[(_value(F.trim(F.get("t", F.lit(k)))) * (scale or {}).get(n, 1.0)).alias(n) for k, n in enumerate(names) if n])


def _sheet(content: bytes) -> Iterator[list[str | None]]:
    """The rows of a workbook's first sheet, cells as text."""
    name = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(e.text or "" for e in item.iter() if name(e) == "t") for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheet = min((n for n in z.namelist() if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
        for _, row in ElementTree.iterparse(z.open(sheet)):
            if name(row) != "row":
                continue
            out: list[str | None] = []
            for cell in row:
                letters = "".join(c for c in cell.get("r", "") if c.isalpha())
                at = reduce(lambda n, c: 26 * n + ord(c) - 64, letters, 0) - 1 if letters else len(out)
                text = "".join(e.text or "" for e in cell.iter() if name(e) in ("v", "t"))
                out += [None] * (at - len(out)) + [shared[int(text)] if cell.get("t") == "s" else text]
            row.clear()
            yield out


READERS: dict[str, Callable[..., DataFrame]] = {"netcdf": read_netcdf, "hdf5": read_netcdf, "xlsx": read_xlsx, "geocsv": read_geocsv, "text": read_text_grid, "by_file": read_by_file, "parquet": read_voxels}


def read_model(spark: SparkSession, kind: str, path: str, **options: Any) -> DataFrame:
    """A model in any of the registered formats."""
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}; there are {', '.join(sorted(READERS))}")
    return READERS[kind](spark, path, **options)


def read_mesh(spark: SparkSession, path: str, dtype: str = "<f4") -> DataFrame:
    """Fortran unformatted files of one record of reals each: proc (from the name), idx, value. A file is a mesh shard, of bounded size."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"proc(\d+)", 1).cast("int").alias("proc"), "content")

    def run(frames):
        for pdf in frames:
            for proc, content in zip(pdf["proc"], pdf["content"], strict=True):
                size = int(np.frombuffer(content, "<i4", 1)[0])
                if size != len(content) - 8 or int(np.frombuffer(content, "<i4", 1, len(content) - 4)[0]) != size:
                    raise ValueError(f"shard {proc} is not one whole record")
                v = np.frombuffer(content, dtype, size // np.dtype(dtype).itemsize, 4)
                yield pd.DataFrame({"proc": np.full(len(v), proc, np.int32), "idx": np.arange(len(v), dtype=np.int64), "value": v.astype(float)})

    return files.mapInPandas(run, "proc int, idx long, value double")
