"""Readers on small files of their formats, writers by reading back, and resumable tables."""

from __future__ import annotations

import datetime
import hashlib
import io
import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeframe.operators.joins import as_of
from quakeframe.sources import catalogs, models, netcdf, stations, writers
from quakeframe.streaming.incremental import UpsertTable, windowed_counts

LINE4 = "25 " + " ".join(f"{x:6.3f} {e:5.3f}" for x, e in ((1.0, 0.1), (-1.5, 0.2), (0.5, 0.3), (0.25, 0.4), (-0.125, 0.5), (0.0, 0.6)))
NDK = [
    "PDE  2010/02/27 06:34:60.0 -36.12  -72.90  22.9 7.2 0.0 OFF COAST OF CENTRAL CHILE " + "X" * 20,
    "C201002270634A   B:117  258  50 S:130  264  50 M:  4    5 150 CMT: 1 TRIHD: 70.0"[:80],
    "CENTROID:     60.0 0.1",
    LINE4,
    "V10   1.581 56  12  -0.537 23 140  -1.044 24 241   1.312   9 29  142 133 72   66",
]


def test_five_line_records(spark, tmp_path):
    short = [NDK[0].replace("7.2 0.0", "0.0 6.5"), NDK[1], NDK[2], "25 1.0 0.1 2.0", NDK[4]]
    nowhere = [NDK[0].replace(" -36.12", "       "), *NDK[1:]]
    (tmp_path / "a.ndk").write_text("\n".join(NDK + short + nowhere + ["a partial record"]) + "\n\n")
    rows = catalogs.read_ndk(spark, str(tmp_path)).orderBy("record").collect()
    assert len(rows) == 3 and [r["corrupt"] for r in rows] == [False, True, True]
    r = rows[0]
    assert (r["catalog"], r["date"], r["latitude"], r["longitude"], r["depth"], r["mb"], r["ms"]) == ("PDE", "2010/02/27", -36.12, -72.9, 22.9, 7.2, None)
    assert r["origin"] == datetime.datetime(2010, 2, 27, 6, 34, 59) and r["location"].startswith("OFF COAST") and r["event_name"] == "C201002270634A"
    assert np.allclose([r[m] for m in ("mrr", "mtt", "mpp", "mrt", "mrp", "mtp", "mrr_error")], [1e25, -1.5e25, 0.5e25, 0.25e25, -0.125e25, 0.0, 0.1e25])
    assert (r["strike1"], r["dip1"], r["rake1"], r["strike2"], r["dip2"], r["rake2"]) == (9, 29, 142, 133, 72, 66)
    assert rows[1]["mb"] is None and rows[1]["ms"] == 6.5


def test_thirteen_line_records_come_back(spark, tmp_path):
    df = spark.createDataFrame([("E1", datetime.datetime(2011, 3, 11, 5, 46, 23), 38.3, 142.4, 29.0, 7.9, 8.8, 1.5, 10.0, *(float(f"{k + 1}e22") for k in range(6)))], "event_name string, origin timestamp, latitude double, longitude double, depth double, mb double, ms double, time_shift double, half_duration double, mrr double, mtt double, mpp double, mrt double, mrp double, mtp double")
    writers.write_lines(df.select(writers.cmt_text().alias("value")), str(tmp_path / "cmt"))
    r = catalogs.read_cmtsolution(spark, str(tmp_path / "cmt" / "*.txt")).first()
    assert (r["event_name"], r["latitude"], r["longitude"], r["depth"], r["time_shift"], r["half_duration"], r["mtp"], r["pde_ms"]) == ("E1", 38.3, 142.4, 29.0, 1.5, 10.0, 6e22, 8.8)
    assert r["origin"] == datetime.datetime(2011, 3, 11, 5, 46, 23)


def test_download_lists(spark, tmp_path):
    (tmp_path / "x.par").write_text("# comment\n\n20100227 063411 -36.1 -72.9 22.9 8.8\n2011-03-11 05:46:23 38.3 142.4 29.0 9.1\nnot an event\n")
    got = catalogs.read_par(spark, str(tmp_path / "x.par"))
    assert [(r["origin"].year, r["latitude"], r["magnitude"]) for r in got.orderBy("origin").collect()] == [(2010, -36.1, 8.8), (2011, 38.3, 9.1)]
    writers.write_lines(writers.par_lines(got), str(tmp_path / "out"))
    again = catalogs.read_par(spark, str(tmp_path / "out" / "*.txt"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
    merged = catalogs.merge_catalogs([got, again.limit(1).withColumn("extra", F.lit(1))])
    assert merged.count() == 3 and "extra" in merged.columns


def test_station_tables(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Network,Station,Latitude,Longitude\nAA,ONE,1.5,2.5\n")
    assert stations.read_csv(spark, str(tmp_path / "s.csv")).count() == 1
    with pytest.raises(ValueError):
        stations.read_csv(spark, str(tmp_path / "s.csv"), required=("Elevation",))
    df = spark.createDataFrame([("TWO", "BB", 10.25, -20.5), ("ONE", "AA", -1.0, 100.0)], "station string, network string, latitude double, longitude double")
    writers.write_lines(writers.station_lines(df, elevation=12.0), str(tmp_path / "out"))
    back = stations.read_stations_file(spark, str(tmp_path / "out" / "*.txt")).collect()
    assert [(r["station"], r["network"], r["latitude"], r["longitude"], r["elevation"], r["burial"]) for r in back] == [("ONE", "AA", -1.0, 100.0, 12.0, 0.0), ("TWO", "BB", 10.25, -20.5, 12.0, 0.0)]
    inventory = {"provider": "P", "networks": [{"code": "AA", "stations": [{"code": "ONE", "latitude": 1.0, "start_date": "2000"}, {"code": "TWO"}]}]}
    (tmp_path / "i.json").write_text(json.dumps(inventory))
    rows = {r["station_id"]: r for r in stations.read_inventory(spark, str(tmp_path / "i.json")).collect()}
    assert rows["AA.ONE"]["latitude"] == 1.0 and rows["AA.TWO"]["latitude"] == 0.0 and rows["AA.TWO"]["site"] == "" and rows["AA.ONE"]["network_description"] == ""
    os.makedirs(tmp_path / "p")
    (tmp_path / "p" / "IRIS_list.txt").write_text("AA.ONE 1.0 2.0\nTWO 3.0 4.0\nAA.ONE 9.0 9.0\n")
    got = {(r["network"], r["station"]): r["latitude"] for r in stations.read_provider_stations(spark, str(tmp_path / "p")).collect()}
    assert got == {("AA", "ONE"): 1.0, ("IRIS", "TWO"): 3.0}
    look = stations.coordinate_lookup([spark.createDataFrame([("AA.ONE", 1.0)], "station_id string, lat double"), spark.createDataFrame([("AA.ONE", 2.0), ("AA.TWO", 3.0)], "station_id string, lat double")])
    assert {r["station_id"]: r["lat"] for r in look.collect()} == {"AA.ONE": 2.0, "AA.TWO": 3.0}


def test_listings_and_manifests(spark, tmp_path):
    for name in ("ev1/AA.ONE.00.BHZ.sac", "ev1/AA.ONE.00.BHN.sac", "ev1/BB.TWO.00.BHZ.sac", "ev2/AA.ONE.00.BHZ.sac"):
        os.makedirs(tmp_path / "w" / name.split("/")[0], exist_ok=True)
        (tmp_path / "w" / name).write_bytes(name.encode())
    files = stations.list_files(spark, str(tmp_path / "w"), "*.sac")
    got = {r["event_id"]: (r["n_files"], r["n_stations"], r["n_networks"], r["n_channels"]) for r in stations.waveform_coverage(files).collect()}
    assert got == {"ev1": (3, 2, 2, 2), "ev2": (1, 1, 1, 1)} and stations.naming_of(files) == "network_first"
    listed = {r["sha256"] for r in writers.manifest(spark, str(tmp_path / "w")).collect()}
    assert hashlib.sha256(b"ev2/AA.ONE.00.BHZ.sac").hexdigest() in listed and len(listed) == 4
    told = json.loads(writers.metadata(files, source="test").first()["value"])
    assert told == {"n_rows": 4, "source": "test"}


def test_text_models(spark, tmp_path):
    (tmp_path / "m.csv").write_text("# a model\nLatitude | Longitude | Depth | vs | rho\n1.0|2.0|10|3.5|2.9\n1.0|2.0|20|9999.0|nan\n")
    got = models.read_model(spark, "geocsv", str(tmp_path / "m.csv"), model="M").orderBy("depth").collect()
    assert [(r["vs"], r["rho"]) for r in got] == [(3.5, 2900.0), (None, None)]
    (tmp_path / "m.txt").write_text("# lon lat depth vs\n2.0 1.0 10 3500\n2.0 1.5 10 NaN\n")
    got = models.read_text_grid(spark, str(tmp_path / "m.txt"), "M", ["longitude", "latitude", "depth", "vs"], {"vs": 0.001}).orderBy("latitude").collect()
    assert [(r["latitude"], r["vs"]) for r in got] == [(1.0, 3.5), (1.5, None)]
    os.makedirs(tmp_path / "by")
    for d in (10, 20):
        (tmp_path / "by" / f"slice_{d}km.txt").write_text(f"2.0 1.0 {d / 10}\n")
    got = models.read_by_file(spark, str(tmp_path / "by"), "M", ["longitude", "latitude", "vs"], "depth", r"_(\d+)km")
    assert {(r["depth"], r["vs"]) for r in got.collect()} == {(10.0, 1.0), (20.0, 2.0)}
    with pytest.raises(ValueError):
        models.read_model(spark, "grib", "x")
    csv = writers.voxel_csv(spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, None), (1.0, 2.0, 4.0, None, None)], "latitude double, longitude double, depth double, vs double, vp double"), ["vs", "vp"]).collect()
    assert [(r["vs"], r["vp"]) for r in csv] == [("4.000000", "nan")]


def test_mesh_files(spark, tmp_path):
    x = np.arange(5, dtype="<f4")
    record = np.array([20], "<i4").tobytes() + x.tobytes() + np.array([20], "<i4").tobytes()
    (tmp_path / "proc000003_vs.bin").write_bytes(record)
    got = models.read_mesh(spark, str(tmp_path / "*.bin")).orderBy("idx").collect()
    assert [(r["proc"], r["idx"], r["value"]) for r in got] == [(3, k, float(k)) for k in range(5)]
    (tmp_path / "proc000004_vs.bin").write_bytes(record[:-4])
    with pytest.raises(Exception, match="whole record"):
        models.read_mesh(spark, str(tmp_path / "*.bin")).collect()


def test_netcdf_by_levels(spark, tmp_path):
    rng = np.random.default_rng(1)
    lat, lon, depth = np.array([1.0, 2.0, 3.0]), np.array([10.0, 11.0]), np.array([0.0, 50.0, 100.0, 200.0])
    vs = rng.normal(size=(4, 3, 2))
    vs[1, 2, 1] = vs[3, 0, 0] = np.nan
    (tmp_path / "m.nc").write_bytes(netcdf.encode({"depth": depth, "latitude": lat, "longitude": lon}, {"vs": vs, "vp": vs * 2}))
    got = models.read_model(spark, "netcdf", str(tmp_path / "m.nc"), model="M", tasks=3)
    assert {(r["latitude"], r["longitude"], r["depth"]): (r["vs"], r["vp"]) for r in got.collect()} == {(lat[j], lon[k], depth[i]): (v, 2 * v) for (i, j, k), v in np.ndenumerate(vs) if not np.isnan(v)}
    (tmp_path / "t.nc").write_bytes(netcdf.encode({"lon": lon, "lat": lat, "z": depth}, {"vs": vs.transpose(2, 1, 0)}))
    turned = netcdf.read_netcdf(spark, str(tmp_path / "t.nc"), "M").select("latitude", "longitude", "depth", "vs")
    assert sorted(map(tuple, turned.collect())) == sorted(map(tuple, got.select("latitude", "longitude", "depth", "vs").collect()))
    os.makedirs(tmp_path / "out")
    files = netcdf.write_netcdf(got, str(tmp_path / "out"), ["vs", "vp"]).collect()
    assert {r["file"] for r in files} == {"M_0.nc", "M_50.nc", "M_100.nc", "M_200.nc"} and sum(r["n"] for r in files) == got.count()
    assert sorted(map(tuple, netcdf.read_netcdf(spark, str(tmp_path / "out"), "M", ["vs", "vp"]).collect())) == sorted(map(tuple, got.select("model", "latitude", "longitude", "depth", "vs", "vp").collect()))
    with pytest.raises(ValueError):
        netcdf.read_header(io.BytesIO(b"\x89HDF\r\n"))


def test_workbooks(spark, tmp_path):
    cell = lambda ref, v, kind="": f'<c r="{ref}"{kind}><v>{v}</v></c>'
    sheet = "<worksheet><sheetData><row>" + cell("A1", 0, ' t="s"') + cell("B1", 1, ' t="s"') + cell("C1", 2, ' t="s"') + cell("D1", 3, ' t="s"') + "</row><row>" + cell("A2", 1.5) + cell("B2", 100) + cell("D2", 3.5) + "</row><row>" + "".join(cell(f"{c}3", v) for c, v in zip("ABCD", (2, 101, 20, 9999), strict=True)) + "</row></sheetData></worksheet>"
    shared = "<sst>" + "".join(f"<si><t>{t}</t></si>" for t in ("Latitude", "Longitude", "Depth", "vs")) + "</sst>"
    with zipfile.ZipFile(tmp_path / "m.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", shared)
    got = models.read_model(spark, "xlsx", str(tmp_path / "m.xlsx"), model="M").orderBy("latitude").collect()
    assert [(r["latitude"], r["longitude"], r["depth"], r["vs"]) for r in got] == [(1.5, 100.0, None, 3.5), (2.0, 101.0, 20.0, None)]


def test_tables_by_partition(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    writers.write_table(df, str(tmp_path / "t"), ["k"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).select("k", "v").collect())) == [("a", 1), ("a", 2), ("b", 3)]
    writers.write_table(df, str(tmp_path / "c"), kind="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
    writers.write_lines(df.select("k", F.col("v").cast("string").alias("value")), str(tmp_path / "l"), "k")
    assert spark.read.text(str(tmp_path / "l")).count() == 3


def test_streams_upsert_and_count(spark, tmp_path):
    schema = "id long, at timestamp, v int"
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    for k, rows in enumerate(([(1, at(0, 5), 1), (2, at(0, 50), 2)], [(1, at(1, 10), 3), (3, at(1, 20), 4)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    table = UpsertTable(spark, str(tmp_path / "table"), ["id"], ["at"], schema)
    for _ in range(2):  # the second run finds nothing new
        table.follow(stream(), str(tmp_path / "check")).awaitTermination(120)
        assert {(r["id"], r["v"]) for r in table.read().collect()} == {(1, 3), (2, 2), (3, 4)}
    counted = windowed_counts(stream(), "at", "id", "v").writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination(120)
    assert {(r["start"].hour, r["id"], r["n"], r["total"]) for r in spark.table("windowed").collect()} == {(0, 1, 1, 1), (0, 2, 1, 2), (1, 1, 1, 3), (1, 3, 1, 4)}


def test_equal_left_rows_each_have_their_partner(spark):
    left = spark.createDataFrame([(1, 10, "x"), (1, 10, "x"), (1, 50, "y"), (None, 10, "z")], "k int, t int, name string").repartition(3)
    right = spark.createDataFrame([(1, 12, 7), (1, 8, 9), (1, 100, 3)], "k int, u int, id int")
    got = sorted((r["name"], r["id"]) for r in as_of(left, right, ["k"], "t", "u", "id", 5).collect() if r["name"] in "xz")
    assert got == [("x", 9), ("x", 9), ("z", None)]
