"""Gridded models in NetCDF (classic, 64-bit offsets and data, and NetCDF-4) and in HDF5, read box by box; classic files written by level.

A file's header gives the place of every value or chunk, so that the boxes of a file (chunks, or levels where there are
none) are read by range in tasks of their own, as many as their bytes ask for; no task and no driver holds a whole
model. Each parameter is read in the order of its own axes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any, BinaryIO

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.sources import hdf5

#: The format's tags, and its types by number.
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
#: Names under which models have their axes.
AXES = {"latitude": ("latitude", "lat", "y"), "longitude": ("longitude", "lon", "x"), "depth": ("depth", "dep", "z", "level")}


@dataclass
class Variable:
    name: str
    dims: list[int]
    attributes: dict[str, Any]
    dtype: str
    begin: int


@dataclass
class Header:
    """Dimensions (name, length) and variables of a file."""

    dims: list[tuple[str, int]] = field(default_factory=list)
    variables: dict[str, Variable] = field(default_factory=dict)
    record: int | None = None
    record_size: int = 0

    def axis(self, name: str) -> str:
        """The variable that holds an axis."""
        for v in self.variables.values():
            if v.name.lower() in AXES[name] and len(v.dims) == 1:
                return v.name
        raise ValueError(f"no axis for {name} among {', '.join(self.variables)}")

    def shape(self, v: Variable) -> list[int]:
        return [self.dims[d][1] for d in v.dims]


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def read_header(f: BinaryIO) -> Header:
    """The header of a classic file."""
    magic = f.read(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError("not a classic NetCDF file")
    wide = magic[3] == 5
    count = lambda: struct.unpack(">q" if wide else ">i", f.read(8 if wide else 4))[0]
    word = lambda: struct.unpack(">i", f.read(4))[0]

    def name() -> str:
        n = count()
        return f.read(n + -n % 4)[:n].decode()

    def attributes() -> dict[str, Any]:
        word()
        out = {}
        for _ in range(count()):
            key, kind = name(), word()
            n = count()
            size = n * np.dtype(TYPES[kind]).itemsize
            raw = f.read(size + -size % 4)[:size]
            out[key] = raw.decode() if kind == 2 else np.frombuffer(raw, TYPES[kind]).tolist()
        return out

    out = Header()
    records = count()
    word()
    out.dims = [(name(), count()) for _ in range(count())]
    out.record = next((k for k, (_, n) in enumerate(out.dims) if n == 0), None)
    if out.record is not None:
        out.dims[out.record] = (out.dims[out.record][0], records)
    attributes()
    word()
    for _ in range(count()):
        of = name()
        dims = [count() for _ in range(count())]
        own, kind = attributes(), word()
        count()  # size, which the dimensions give too
        begin = struct.unpack(">i" if magic[3] == 1 else ">q", f.read(4 if magic[3] == 1 else 8))[0]
        out.variables[of] = Variable(of, dims, own, TYPES[kind], begin)
    sizes = [int(np.prod(out.shape(v)[1:], dtype=np.int64)) * np.dtype(v.dtype).itemsize for v in out.variables.values() if out.record is not None and v.dims[:1] == [out.record]]
    out.record_size = sizes[0] if len(sizes) == 1 else sum(n + -n % 4 for n in sizes)  # a lone variable's records are not padded
    return out


def _masked(x: np.ndarray, attributes: dict[str, Any], missing: Sequence[float]) -> np.ndarray:
    """Values as doubles: missing ones as NaN, the others scaled and shifted as the attributes say."""
    x = x.astype(float)
    for m in missing:
        x[x == m] = np.nan
    first = lambda key, default: float(np.atleast_1d(attributes.get(key, default))[0])
    return x * first("scale_factor", 1.0) + first("add_offset", 0.0)


class Classic:
    """A classic file as a volume: axes, the axes of each parameter in its order, and values by box."""

    def __init__(self, f: BinaryIO) -> None:
        self.f, self.h = f, read_header(f)
        names = {self.h.variables[self.h.axis(a)].dims[0]: a for a in AXES}
        self.axes = {a: self._box(self.h.variables[self.h.axis(a)], (0,), (self.h.dims[d][1],)) for d, a in names.items()}
        self.order = {v.name: [names[d] for d in v.dims] for v in self.h.variables.values() if len(v.dims) == 3 and set(v.dims) == set(names)}

    def _box(self, v: Variable, start: Sequence[int], stop: Sequence[int]) -> np.ndarray:
        kind, shape = np.dtype(v.dtype), self.h.shape(v)
        rest = shape[1:]
        slab = int(np.prod(rest, dtype=np.int64)) * kind.itemsize
        step = self.h.record_size if v.dims[0] == self.h.record else slab
        out = np.empty([z - a for a, z in zip(start, stop, strict=True)], dtype=kind)
        inner = tuple(slice(a, z) for a, z in zip(start[1:], stop[1:], strict=True))
        for k in range(start[0], stop[0]):
            self.f.seek(v.begin + k * step)
            out[k - start[0] : k - start[0] + 1] = np.frombuffer(self.f.read(slab), kind).reshape(1, *rest)[(slice(None), *inner)]
        return _masked(out, v.attributes, [m for key in ("_FillValue", "missing_value") for m in v.attributes.get(key, [])])

    def box(self, name: str) -> tuple[int, ...]:
        """The shape of what is best read at once: a level of the first dimension."""
        return (1, *self.h.shape(self.h.variables[name])[1:])

    def read(self, name: str, start: Sequence[int], stop: Sequence[int]) -> np.ndarray:
        return self._box(self.h.variables[name], start, stop)


class Hdf5:
    """An HDF5 or NetCDF-4 file as a volume. Parameters lie beside their axes or in groups of their own.

    A parameter's axes are those its dimension scales name; without such, (latitude, longitude, depth) if its shape is
    theirs, else the axes by their lengths, which must differ then. Depths in metres (by name, or beyond 5000) become km;
    without a depth the levels are spread over 0 to 1000 km.
    """

    def __init__(self, f: BinaryIO) -> None:
        self.file = hdf5.File(f)
        self.sets: dict[str, hdf5.Dataset] = {}
        self.at: dict[int, str] = {}
        self._walk(self.file.root, 0)
        self.axes = {}
        for axis, known in AXES.items():
            for name, d in self.sets.items():
                if len(d.shape) == 1 and name.lower().removesuffix("_in_meter") in known and axis not in self.axes:
                    x = self._values(d, (0,), d.shape)
                    metres = axis == "depth" and (name.lower().endswith("_in_meter") or (len(x) and np.nanmax(x) > 5000))
                    self.axes[axis] = x / 1000 if metres else x
        for axis in ("latitude", "longitude"):
            if axis not in self.axes:
                raise ValueError(f"no axis for {axis} among {', '.join(self.sets)}")
        cubes = {n: d for n, d in self.sets.items() if len(d.shape) == 3 and d.dtype is not None}
        if "depth" not in self.axes and cubes:
            self.axes["depth"] = np.linspace(0, 1000, next(iter(cubes.values())).shape[2])
        self.order = {n: order for n, d in cubes.items() if (order := self._axes_of(d))}

    def _walk(self, group: int, deep: int) -> None:
        for name, to in self.file.children(group).items():
            try:
                d = self.file.dataset(to)
            except ValueError:
                if deep < 3:
                    self._walk(to, deep + 1)
                continue
            self.sets.setdefault(name, d)
            self.at[to] = name

    def _axes_of(self, d: hdf5.Dataset) -> list[str] | None:
        lengths = {a: len(x) for a, x in self.axes.items()}
        scales = [self.at.get(to) for to in d.attributes.get("DIMENSION_LIST", []) if isinstance(to, int)]
        named = [next((a for a, known in AXES.items() if s and s.lower() in known), None) for s in scales]
        if len(named) == 3 and set(named) == set(AXES):
            return named
        if d.shape == tuple(lengths.values()):
            return list(lengths)
        found = [[a for a, n in lengths.items() if n == size] for size in d.shape]
        return [f[0] for f in found] if all(len(f) == 1 for f in found) and len({f[0] for f in found}) == 3 else None

    def _values(self, d: hdf5.Dataset, start: Sequence[int], stop: Sequence[int]) -> np.ndarray:
        return _masked(self.file.read(d, tuple(start), tuple(stop)), d.attributes, hdf5.missing_of(d))

    def box(self, name: str) -> tuple[int, ...]:
        d = self.sets[name]
        return d.chunk or (1, *d.shape[1:])

    def read(self, name: str, start: Sequence[int], stop: Sequence[int]) -> np.ndarray:
        return self._values(self.sets[name], start, stop)


def open_volume(f: BinaryIO) -> Classic | Hdf5:
    """The volume in an open file, by its first bytes."""
    classic = f.read(3) == b"CDF"
    f.seek(0)
    return Classic(f) if classic else Hdf5(f)


def _voxels(volume: Classic | Hdf5, params: Sequence[str], corner: Sequence[int]) -> pd.DataFrame:
    """The voxels of the box of the first parameter at ``corner``; each parameter is read in its own order, and is missing where it has no such axes."""
    order = volume.order[params[0]]
    ends = [min(c + n, len(volume.axes[a])) for c, n, a in zip(corner, volume.box(params[0]), order, strict=True)]
    span = dict(zip(order, zip(corner, ends, strict=True), strict=True))
    grids = np.meshgrid(*[volume.axes[a][slice(*span[a])] for a in order], indexing="ij")
    out = {a: g.reshape(-1) for a, g in zip(order, grids, strict=True)}
    for p in params:
        own = volume.order.get(p)
        if own is None:
            out[p] = np.full(grids[0].size, np.nan)
        else:
            x = volume.read(p, [span[a][0] for a in own], [span[a][1] for a in own])
            out[p] = x.transpose([own.index(a) for a in order]).reshape(-1)
    return pd.DataFrame(out)


def variables_of(path: str) -> list[str]:
    """The parameters of a file: its variables over all three axes."""
    store, at = open_path(path)
    with store.open_input_file(at) as f:
        return list(open_volume(f).order)


#: Bytes of parameters that a task reads, about.
TASK_BYTES = 64 << 20


def read_netcdf(spark: SparkSession, path: str, model: str, params: Sequence[str] | None = None, tasks: int | None = None, depth_shift: float = 0.0) -> DataFrame:
    """model, latitude, longitude, depth and the parameters of all files under ``path`` (a file, folder or pattern); voxels without any parameter are left out.

    A row for each box is dealt to tasks, which read it by range: ``tasks`` of them, or as many as TASK_BYTES each ask
    for, yet one for each core while there are boxes. Parameters are those of the first file by name, unless given;
    ``depth_shift`` (km) is added to the depths.
    """
    files = spark.read.format("binaryFile").load(path).select("path")
    if params is None:
        first = files.agg(F.min("path")).first()[0]
        if first is None:
            raise ValueError(f"no file at {path}")
        params = variables_of(first)
    names = list(params)

    def boxes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name in pdf["path"]:
                store, at = open_path(name)
                with store.open_input_file(at) as f:
                    volume = open_volume(f)
                if names[0] not in volume.order:
                    raise ValueError(f"{name}: {names[0]} has not the three axes of a model")
                shape, box = [len(volume.axes[a]) for a in volume.order[names[0]]], volume.box(names[0])
                corners = [[i * n for i, n in zip(k, box, strict=True)] for k in np.ndindex(*[-(-a // n) for a, n in zip(shape, box, strict=True)])]
                yield pd.DataFrame({"path": name, "corner": corners, "bytes": 8 * len(names) * int(np.prod(box))})

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, group in pdf.groupby("path", sort=True):
                store, at = open_path(name)
                with store.open_input_file(at) as f:
                    volume = open_volume(f)
                    for corner in group["corner"]:
                        x = _voxels(volume, names, [int(c) for c in corner])
                        x["depth"] += depth_shift
                        x = x[x[names].notna().any(axis=1)].astype(object).where(lambda d: d.notna(), None)
                        yield x[["latitude", "longitude", "depth", *names]]

    listed = files.mapInPandas(boxes, "path string, corner array<long>, bytes long")
    if tasks is None:
        n, size = listed.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        tasks = max(1, min(n, max(-(-size // TASK_BYTES), spark.sparkContext.defaultParallelism)))
    voxels = listed.select("path", "corner").repartition(tasks).mapInPandas(read, "latitude double, longitude double, depth double, " + ", ".join(f"`{p}` double" for p in names))
    return voxels.select(F.lit(model).alias("model"), "*")


def encode(axes: dict[str, np.ndarray], values: dict[str, np.ndarray], missing: float = 9999.0) -> bytes:
    """A classic file (64-bit offsets) of parameters over the given axes, in their order."""
    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    names = list(axes)
    head = b"CDF\x02" + struct.pack(">iii", 0, DIMENSIONS, len(names)) + b"".join(text(a) + struct.pack(">i", len(axes[a])) for a in names) + struct.pack(">ii", 0, 0)
    rows = [(a, [names.index(a)], np.asarray(axes[a], ">f8"), b"") for a in names]
    fill = text("_FillValue") + struct.pack(">iid", 6, 1, missing)
    rows += [(p, list(range(len(names))), np.nan_to_num(np.asarray(x, float), nan=missing).astype(">f8"), fill) for p, x in values.items()]
    entry = lambda row, begin: text(row[0]) + struct.pack(">i", len(row[1])) + struct.pack(f">{len(row[1])}i", *row[1]) + (struct.pack(">ii", ATTRIBUTES, 1) + row[3] if row[3] else struct.pack(">ii", 0, 0)) + struct.pack(">iiq", 6, row[2].nbytes, begin)
    begin = len(head) + 8 + sum(len(entry(row, 0)) for row in rows)
    out = head + struct.pack(">ii", VARIABLES, len(rows))
    for row in rows:
        out += entry(row, begin)
        begin += row[2].nbytes
    return out + b"".join(row[2].tobytes() for row in rows)


def write_netcdf(df: DataFrame, path: str, params: Sequence[str]) -> DataFrame:
    """A file for each level of each model under ``path`` (which exists), each written by one task; returns model, depth, file, n."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        model, depth = key
        lat, lon = (np.unique(pdf[a].to_numpy(float)) for a in ("latitude", "longitude"))
        at = (np.zeros(len(pdf), dtype=int), np.searchsorted(lat, pdf["latitude"]), np.searchsorted(lon, pdf["longitude"]))
        values = {}
        for p in params:
            values[p] = np.full((1, len(lat), len(lon)), np.nan)
            values[p][at] = pdf[p].to_numpy(float)
        name = f"{model}_{depth:g}.nc"
        store, root = open_path(path)
        with store.open_output_stream(f"{root.rstrip('/')}/{name}", compression=None) as f:
            f.write(encode({"depth": np.array([depth]), "latitude": lat, "longitude": lon}, values))
        return pd.DataFrame([[model, depth, name, len(pdf)]], columns=["model", "depth", "file", "n"])

    return df.select("model", "depth", "latitude", "longitude", *params).groupBy("model", "depth").applyInPandas(run, "model string, depth double, file string, n long")
