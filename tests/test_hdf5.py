"""HDF5 and NetCDF-4 models against their classic twins, and what the box of a task touches."""

from __future__ import annotations

import io
import struct

import numpy as np
import pytest

from quakeframe.sources import hdf5, models, netcdf
from tests.hdf5_writer import Writer

LAT, LON, DEPTH = np.linspace(20, 24, 5), np.linspace(100, 105, 6), np.array([0.0, 10, 30, 60])
rng = np.random.default_rng(7)
VS = rng.normal(4, 1, (5, 6, 4)).round(3)
VS[1, 2, 3] = VS[4, 5, 0] = np.nan
VP = VS * 1.7


def rows(df, params=("vs", "vp")):
    return sorted(tuple(round(v, 9) if v is not None else -1 for v in r) for r in df.select("latitude", "longitude", "depth", *params).collect())


@pytest.fixture(scope="module")
def twin(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("classic") / "m.nc"
    path.write_bytes(netcdf.encode({"latitude": LAT, "longitude": LON, "depth": DEPTH}, {"vs": VS, "vp": VP}))
    return rows(netcdf.read_netcdf(spark, str(path), "M"))


def four(new: bool, dense: bool = False, leaf: int = 3) -> bytes:
    """A NetCDF-4 like file: vp lies in another order of axes, both chunked, with a fill value."""
    w = Writer(new)
    lat, lon, depth = (w.dataset(x) for x in (LAT, LON, DEPTH.astype(">f4")))
    vs = w.dataset(np.nan_to_num(VS, nan=-999.0), (2, 3, 2), (2, 1, 3), fill=-999.0, scales=[lat, lon, depth], leaf=leaf, split=True)
    turned = np.nan_to_num(VP, nan=9999.0).transpose(2, 0, 1).copy()
    vp = w.dataset(turned, (4, 2, 2), (1,), missing=9999.0, scales=[depth, lat, lon], leaf=leaf)
    more = {f"note{k}": w.dataset(np.arange(3, dtype="<i4")) for k in range(9)} if dense else {}
    return w.finish(w.group({"lat": lat, "lon": lon, "depth": depth, "vs": vs, "vp": vp, **more}, dense))


@pytest.mark.parametrize(("new", "dense", "leaf"), [(False, False, 3), (False, False, 40), (True, False, 2), (True, True, 3)])
def test_netcdf4_equals_its_classic_twin(spark, tmp_path, twin, new, dense, leaf):
    (tmp_path / "m.nc").write_bytes(four(new, dense, leaf))
    got = netcdf.read_netcdf(spark, str(tmp_path / "m.nc"), "M", ["vs", "vp"])
    assert rows(got) == twin
    assert got.rdd.getNumPartitions() == 8  # 12 chunks, a task for each core
    assert set(netcdf.variables_of(str(tmp_path / "m.nc"))) == {"vs", "vp"}


def test_groups_of_a_plain_file(spark, tmp_path, twin):
    w = Writer(False)
    axes = w.group({"latitude": w.dataset(LAT), "longitude": w.dataset(LON), "depth_in_meter": w.dataset(DEPTH * 1000)})
    values = w.group({"vs": w.dataset(VS), "vp": w.dataset(VP, (5, 6, 4), (2, 1))})
    (tmp_path / "m.h5").write_bytes(w.finish(w.group({"model_coordinates": axes, "model_parameters": values})))
    assert rows(models.read_model(spark, "hdf5", str(tmp_path / "m.h5"), model="M")) == twin
    shifted = netcdf.read_netcdf(spark, str(tmp_path / "m.h5"), "M", ["vs"], depth_shift=-3.0)
    assert {r["depth"] for r in shifted.collect()} == set(DEPTH - 3)


def test_chunks_never_written_are_missing(spark, tmp_path):
    w = Writer(True)
    x = w.dataset(np.nan_to_num(VS, nan=-1.0), (2, 6, 4), (1,), fill=-1.0, skip=((1, 0, 0),))
    (tmp_path / "m.h5").write_bytes(w.finish(w.group({"latitude": w.dataset(LAT), "longitude": w.dataset(LON), "depth": w.dataset(DEPTH), "vs": x})))
    got = {r["latitude"] for r in netcdf.read_netcdf(spark, str(tmp_path / "m.h5"), "M").collect()}
    assert got == {20.0, 21.0, 24.0}


def test_single_chunk_and_axes_by_length():
    w = Writer(True)
    x = w.dataset(VS.transpose(1, 2, 0).copy(), (6, 4, 5), single=True)
    v = netcdf.open_volume(io.BytesIO(w.finish(w.group({"lat": w.dataset(LAT), "lon": w.dataset(LON), "z": w.dataset(DEPTH), "vs": x}))))
    assert v.order == {"vs": ["longitude", "depth", "latitude"]}
    np.testing.assert_array_equal(v.read("vs", (1, 0, 2), (4, 4, 5)), VS.transpose(1, 2, 0)[1:4, :, 2:5])


def test_only_chunks_of_the_box_are_read():
    w = Writer(False)
    x = rng.normal(size=(20, 6, 4))
    at = w.dataset(x, (1, 6, 4), (1,), leaf=4)
    f = hdf5.File(io.BytesIO(w.finish(w.group({"x": at}))))
    d = f.dataset(f.find("x"))
    assert [c[0][0] for c in f._chunks(d, (7, 0, 0), (9, 6, 4))] == [7, 8]
    np.testing.assert_array_equal(f.read(d, (7, 1, 1), (9, 5, 3)), x[7:9, 1:5, 1:3])


def test_other_files_raise():
    for raw in (b"not a model at all" * 9, b""):
        with pytest.raises(ValueError, match="HDF5"):
            netcdf.open_volume(io.BytesIO(raw))


def test_classic_variables_in_their_own_order(spark, tmp_path, twin):
    """Two parameters with other orders of axes in one classic file, and a record dimension."""
    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    dims = [("depth", 0, 4), ("latitude", 5, 5), ("longitude", 6, 6)]  # depth is the record dimension
    head = b"CDF\x01" + struct.pack(">i", 4) + struct.pack(">ii", 10, 3) + b"".join(text(n) + struct.pack(">i", k) for n, k, _ in dims) + struct.pack(">ii", 0, 0)
    fill = struct.pack(">ii", 12, 1) + text("_FillValue") + struct.pack(">iid", 6, 1, 9999.0)
    data = {"latitude": ([1], LAT), "longitude": ([2], LON), "depth": ([0], DEPTH), "vs": ([0, 1, 2], VS.transpose(2, 0, 1)), "vp": ([0, 2, 1], VP.transpose(2, 1, 0))}
    entry = lambda n, d, begin: text(n) + struct.pack(">i", len(d)) + struct.pack(f">{len(d)}i", *d) + fill + struct.pack(">iii", 6, 0, begin)
    at = len(head) + 8 + sum(len(entry(n, d, 0)) for n, (d, _) in data.items())
    fixed, records, begins = b"", [b""] * 4, {}
    for n in ("latitude", "longitude"):
        begins[n] = at + len(fixed)
        fixed += data[n][1].astype(">f8").tobytes()
    for n in ("depth", "vs", "vp"):
        begins[n] = at + len(fixed) + len(records[0])
        records = [r + np.nan_to_num(data[n][1][k : k + 1], nan=9999.0).astype(">f8").tobytes() for k, r in enumerate(records)]
    raw = head + struct.pack(">ii", 11, 5) + b"".join(entry(n, d, begins[n]) for n, (d, _) in data.items()) + fixed + b"".join(records)
    (tmp_path / "r.nc").write_bytes(raw)
    assert rows(netcdf.read_netcdf(spark, str(tmp_path / "r.nc"), "M", ["vs", "vp"])) == twin
