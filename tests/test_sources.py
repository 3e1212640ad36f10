import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.errors import GridError, InvalidArgument, IoFailure, NotFound, ParseFailure
from gridloom.functions.lattice import Lattice
from gridloom.operators import synth
from gridloom.sources import lanes, sections, textgrids
from gridloom.streaming import controls

LATTICE = Lattice(1000.0, 2000.0, 10.0, 20.0, 3, 2)


@pytest.fixture
def field(spark):
    return LATTICE.nodes(spark).select("i", "j", (1.0 + 2 * F.col("i") + F.col("j")).alias("v"))


def test_sections(spark, tmp_path):
    path = str(tmp_path / "a.sections")
    rows = [("grid", "one", ["x"], 1, b"payload one"), ("grid", "two", [], 0, b""), ("log", "three", ["x", "y"], 2, bytes(5000))]
    sections.write_sections(spark.createDataFrame(rows, sections.SCHEMA), path, {"by": "test"}, 7)
    assert sorted(tuple(r)[:2] + (bytes(r.payload),) for r in sections.read_sections(spark, path).collect()) == sorted((k, n, p) for k, n, _, _, p in rows)
    assert sections.read_section(spark, path, "one") == b"payload one" and sections.app_of(path) == {"by": "test"}
    assert sections.read_header(path)[1] == 7 and sections.entries(spark, path).count() == 3
    other, both = str(tmp_path / "b.sections"), str(tmp_path / "c.sections")
    sections.filter_to(spark, path, other, F.array_contains("tags", "x"))
    assert {r.name for r in sections.entries(spark, other).collect()} == {"one", "three"} and sections.app_of(other) == {"by": "test"}
    raw = {r.name: bytes(r.raw) for r in sections.read_sections(spark, path, raw=True).collect()}
    assert {r.name: bytes(r.raw) for r in sections.read_sections(spark, other, raw=True).collect()} == {k: raw[k] for k in ("one", "three")}
    sections.write_sections(spark.createDataFrame([("grid", "one", [], 9, b"new")], sections.SCHEMA), other)
    sections.merge_to(spark, path, other, both)
    assert sections.read_section(spark, both, "one") == b"new" and sections.entries(spark, both).count() == 3
    with pytest.raises(NotFound):
        sections.read_section(spark, path, "none")
    (tmp_path / "bad").write_bytes(b"nothing here at all")
    with pytest.raises(ParseFailure):
        sections.read_header(str(tmp_path / "bad"))
    (tmp_path / "new").write_bytes(b"GLS\x09" + bytes(8))
    with pytest.raises(ParseFailure):
        sections.read_header(str(tmp_path / "new"))
    with pytest.raises(NotFound):
        sections.read_header(str(tmp_path / "missing"))


def test_lane_file(spark, tmp_path):
    path = str(tmp_path / "s.lanes")
    schema = lanes.StoreSchema(4, (lanes.Lane("por", "f32", 5), lanes.Lane("id", "u16", 3), lanes.Lane("coord", "f64", 6, True)), {"a": 1})
    w = lanes.StoreWriter(path, schema, flush_behind=True)
    for k in (2, 0, 3, 1):
        w.write_slab("por", k, np.arange(5) + k)
        w.slab("id", k)[:] = k
    w.write_flat("coord", np.arange(6))
    with pytest.raises(ParseFailure):
        lanes.StoreReader(path)
    w.finalize()
    r = lanes.StoreReader(path)
    assert r.window("por", 1, 3).tolist() == [[1, 2, 3, 4, 5], [2, 3, 4, 5, 6]] and r.slab("id", 3).tolist() == [3, 3, 3]
    assert r.flat("coord").tolist() == list(range(6)) and r.schema.app == {"a": 1} and r.lane("por").shape == (4, 5)
    for bad, error in ((lambda: r.slab("por", 4), InvalidArgument), (lambda: r.flat("por"), InvalidArgument), (lambda: r.slab("none", 0), NotFound), (lambda: r.slab("por", 0, "f64"), InvalidArgument), (lambda: w.write_slab("por", 0, [1.0]), InvalidArgument), (lambda: lanes.StoreReader(path + "x"), IoFailure), (lambda: lanes.StoreSchema(0, schema.lanes), InvalidArgument)):
        with pytest.raises(error):
            bad()
    assert issubclass(InvalidArgument, GridError)
    assert [x.values for x in sorted(lanes.file_to_rows(spark, path, "por").collect())][1] if False else lanes.file_to_rows(spark, path, "por").count() == 4
    again = str(tmp_path / "t.lanes")
    v = lanes.StoreWriter(again, schema)
    for k in range(4):
        v.write_slab("por", k, np.arange(5) + k)
        v.write_slab("id", k, [k] * 3)
    v.write_flat("coord", np.arange(6))
    v.finalize()
    assert open(path, "rb").read() == open(again, "rb").read()
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-30])
    with pytest.raises(ParseFailure):
        lanes.StoreReader(path)


def test_lane_table(spark, tmp_path):
    rows = spark.range(100).select(F.lit("a").alias("lane"), F.col("id").alias("slab"), F.array(F.col("id") * 1.0, F.lit(2.0)).alias("values"))
    lanes.write_store(rows.unionByName(rows.withColumn("lane", F.lit("b"))), str(tmp_path / "t"))
    found = lanes.read_window(spark, str(tmp_path / "t"), "a", 10, 13)
    assert sorted(r.slab for r in found.collect()) == [10, 11, 12]
    assert "PartitionFilters: [isnotnull(lane" in found._jdf.queryExecution().toString()


def test_text_grids(spark, field, tmp_path):
    p = str(tmp_path / "f")
    textgrids.write_irap_grid(field, LATTICE, p, negate=True)
    lines = open(p).read().splitlines()
    assert lines[0] == "-996 2 20.0 10.0" and lines[3] == "0 0 0 0 0 0 0" and lines[4] == "-1.0000 -3.0000 -5.0000 -2.0000 -4.0000 -6.0000"
    back, lattice = textgrids.read_irap_grid(spark, p)
    assert lattice == LATTICE and {(r.i, r.j): -r.v for r in back.collect()} == {(r.i, r.j): r.v for r in field.collect()}
    textgrids.write_cps3_grid(field, LATTICE, p)
    assert open(p).read().splitlines()[4:6] == ["->", "2.0000 4.0000 6.0000 1.0000 3.0000 5.0000"]
    back, lattice = textgrids.read_cps3_grid(spark, p)
    assert lattice == LATTICE and {(r.i, r.j): r.v for r in back.collect()} == {(r.i, r.j): r.v for r in field.collect()}
    textgrids.write_irap_points(field, LATTICE, p)
    assert open(p).readline() == "1000.000 2000.000 -1.0000\n" and textgrids.read_xyz(spark, p).count() == 6
    textgrids.write_earthvision_grid(field, LATTICE, p)
    assert textgrids.read_xyz(spark, p).count() == 6 and open(p).read().count("#") == 4
    textgrids.write_cps3_lines(spark.createDataFrame([(0, 0, 1.0, 2.0), (0, 1, 3.0, 4.0), (1, 0, 5.0, 6.0)], "ring_id int, seq int, x double, y double"), p)
    assert open(p).read().splitlines()[2:] == ["-> 1", "1.000 2.000 0.0000", "3.000 4.000 0.0000", "-> 2", "5.000 6.000 0.0000"]
    textgrids.write_wellpath(synth.trajectory(spark, (1.0, 2.0), 25.0, 60.0, 30.0, synth.WellProfile.vertical()), p, 25.0)
    assert open(p).read().splitlines()[-1].split() == ["60.000", "1.000", "2.000", "-35.000", "60.000", "0", "0", "0.000", "0.000", "0", "0.000"]
    textgrids.write_las2(spark.createDataFrame([(0, 1.0, 0.2, 1.0, float("nan")), (1, 1.5, 0.3, 0.0, 0.4)], "k int, md double, por double, ntg double, sw double"), p, "W-1", 0.5)
    items, curves, rows = textgrids.read_las2(p)
    assert curves == ["DEPT", "PHIE", "NTG", "SW"] and rows[1] == [1.5, 0.3, 0.0, 0.4] and np.isnan(rows[0][3]) and items["WELL"] == "W-1"
    textgrids.write_tops(spark.createDataFrame([(0, 1.0, 2.0, 100.0, 125.0, "Horizon", "Décor", "W")], "ord int, x double, y double, tvdss double, md double, type string, surface string, well string"), p)
    assert 'Horizon "Décor" "W"' in open(p, encoding="latin-1").read()
    with pytest.raises(GridError):
        textgrids.write_irap_grid(field, Lattice(0, 0, 1, 1, 3, 2, 30.0), p)


def test_streams(spark, tmp_path):
    lattice = Lattice(0.0, 0.0, 1.0, 1.0, 5, 5)
    schema = "surface string, i int, j int, v double, seq long"
    source = tmp_path / "in"
    source.mkdir()

    def send(n, rows):
        (source / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("surface", "i", "j", "v", "seq"), r, strict=True))) for r in rows))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
        query = controls.stream_surfaces(stream, lattice, str(tmp_path / "out"))
        query.awaitTermination(120)

    send(0, [("a", 0, 0, 1.0, 1), ("a", 4, 4, 5.0, 1), ("a", 0, 4, 2.0, 1), ("a", 4, 0, 2.0, 1), ("b", 2, 2, 7.0, 1)])
    run()
    send(1, [("a", 0, 0, 3.0, 2)])
    run()
    first = spark.read.parquet(str(tmp_path / "out/fields/batch=0"))
    second = spark.read.parquet(str(tmp_path / "out/fields/batch=1"))
    assert {r.surface for r in first.collect()} == {"a", "b"} and {r.surface for r in second.collect()} == {"a"}
    g = controls.ConvergentGridder(spark, lattice)
    g.add_controls([(0, 0, 1.0), (4, 4, 5.0), (0, 4, 2.0), (4, 0, 2.0), (0, 0, 3.0)])
    want = {(r.i, r.j): r.v for r in g.field().collect()}
    assert {(r.i, r.j): pytest.approx(r.v, abs=1e-6) for r in second.collect()} == want
    with pytest.raises(InvalidArgument):
        g.add_control(5, 0, 1.0)


def test_asset(spark, tmp_path):
    from gridloom.operators.asset import synth_asset

    made = synth_asset(spark, str(tmp_path / "a"), seed=21, n_wells=1, ncol=7)
    assert len(made["wells"]) == 1 and all("Top" in w["tops_md"] for w in made["wells"])
    files = {str(p.relative_to(tmp_path / "a")) for p in (tmp_path / "a").rglob("*") if p.is_file()}
    assert {"manifest.json", "Tops", "outline.lines", "trends/NTG.cps3", "surfaces/Top.grid", "wells/W-1.wellpath", "wells/W-1.las"} <= files
    field, lattice = textgrids.read_irap_grid(spark, str(tmp_path / "a/surfaces/Top.grid"))
    assert lattice.ncol == 7 and field.where("v > 0").count() == 0
