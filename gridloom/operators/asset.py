"""A small believable field: stacked surfaces, a trend, wells with paths, tops and logs, an outline; written as text files with a manifest of what was planted."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lattice import Lattice
from ..functions.rng import mix_seed
from ..sources import textgrids
from . import synth
from .variogram import Variogram

ZONES = (("Upper", 40.0, 0.65, (0.22, 0.04)), ("Middle", 30.0, 0.45, (0.20, 0.04)), ("Lower", 50.0, 0.70, (0.24, 0.04)))
NON_NET, BED_M, CORR_M, STEP = (0.05, 0.01), 1.2, 4.0, 0.5
KB, DEPTH = 25.0, 2000.0
#: Wells in turn: vertical, build and hold, build, hold and drop.
PROGRAMS = (None, (900.0, 3.0, 40.0, None), (800.0, 3.0, 45.0, (1700.0, 2.0, 20.0)))


def pinch_ramp(x: Column, start: float, end: float) -> Column:
    """1 up to start, 0 from end on, a line between."""
    return F.least(F.greatest((F.lit(end) - x) / (end - start), F.lit(0.0)), F.lit(1.0))


def ntg_pattern(x: Column, y: Column, base: float, amplitude: float, wave: float) -> Column:
    """A smooth pattern around base, within [0.05, 0.95]."""
    return F.least(F.greatest(base + amplitude * F.sin(x / wave) * F.cos(y / wave), F.lit(0.05)), F.lit(0.95))


def lattice_of(ncol: int) -> Lattice:
    return Lattice(431000.0, 6521000.0, 250.0, 250.0, ncol, ncol)


def surfaces(spark: SparkSession, lattice: Lattice, seed: int) -> DataFrame:
    """(ord, i, j, v): the top and each zone's base, in depth; the last zone pinches out to the east."""
    top = synth.dome_surface(spark, lattice, -60.0, 1.3, 15.0, synth.NoiseSpec(4.0, Variogram("spherical", 0.0, 1.0, 500.0)), mix_seed(seed, 1) >> 1).withColumn("v", F.col("v") + DEPTH)
    model = Variogram("spherical", 0.0, 1.0, 800.0)
    x0, _, x1, _ = lattice.bbox()
    thickness = None
    for k, (_, mean, _, _) in enumerate(ZONES):
        one = synth.isochore(spark.range(1).select(F.lit(mix_seed(seed, 10 + k) >> 1).alias("seed")), lattice, mean, mean / 10, model).select(F.lit(k + 1).alias("ord"), "i", "j", "v")
        thickness = one if thickness is None else thickness.unionByName(one)
    x, _ = lattice.node_xy(F.col("i"), F.col("j"))
    last = F.col("ord") == len(ZONES)
    thickness = thickness.withColumn("v", F.when(last, F.col("v") * pinch_ramp(x, x0 + 0.7 * (x1 - x0), x1)).otherwise(F.col("v")))
    return top.select(F.lit(0).alias("ord"), "i", "j", "v").unionByName(synth.stacked_surfaces(top, thickness))


def well_path(spark: SparkSession, well: int, head: tuple[float, float], lattice: Lattice) -> DataFrame:
    program = PROGRAMS[well % len(PROGRAMS)]
    profile = synth.WellProfile.vertical()
    if program is not None:
        import math

        box = lattice.bbox()
        azimuth = math.degrees(math.atan2((box[0] + box[2]) / 2 - head[0], (box[1] + box[3]) / 2 - head[1]))
        profile = synth.WellProfile.build_hold(*program[:3], azimuth)
        if program[3] is not None:
            profile = profile.with_drop(*program[3])
    return synth.trajectory(spark, head, KB, 2900.0, 30.0, profile, well)


def depth_at(path: DataFrame, field: DataFrame, lattice: Lattice) -> DataFrame:
    """path with `surface`: the field (depth) below each station as elevation; stations off the lattice go."""
    corners = lattice.footprint(path.select("well", "seq", "x", "y")).join(field.select("i", "j", F.col("v").alias("_v")), ["i", "j"])
    return corners.groupBy("well", "seq").agg((-F.sum(F.col("w") * F.col("_v"))).alias("surface"))


def synth_asset(spark: SparkSession, root: str, seed: int = 21, n_wells: int = 4, ncol: int = 13, surfaces_as_points: bool = False) -> dict:
    """Write the field under root and return its manifest; the same seed writes the same files."""
    lattice = lattice_of(ncol)
    stack = spark.createDataFrame(surfaces(spark, lattice, seed).collect(), "ord int, i int, j int, v double")  # a lattice's nodes
    names = ["Top", *(f"Base_{z[0]}" for z in ZONES)]
    for k, name in enumerate(names):
        field = stack.where(F.col("ord") == k).select("i", "j", "v")
        if surfaces_as_points:
            textgrids.write_irap_points(field, lattice, os.path.join(root, "surfaces", f"{name}.points"))
        else:
            textgrids.write_irap_grid(field, lattice, os.path.join(root, "surfaces", f"{name}.grid"), negate=True)
    trend = synth.trend_map(spark, lattice, Variogram("spherical", 0.0, 1.0, 800.0), mix_seed(seed, 30) >> 1)
    textgrids.write_cps3_grid(trend, lattice, os.path.join(root, "trends", "NTG.cps3"))
    ring = synth.study_area_outline(lattice.bbox(), 100.0, 4)
    textgrids.write_cps3_lines(spark.createDataFrame([(0, n, *p) for n, p in enumerate(ring)], "ring_id int, seq int, x double, y double"), os.path.join(root, "outline.lines"))
    x0, y0, x1, y1 = lattice.bbox()
    inner = [(x0 + 0.25 * (x1 - x0), y0 + 0.25 * (y1 - y0)), (x1 - 0.25 * (x1 - x0), y0 + 0.25 * (y1 - y0)), (x1 - 0.25 * (x1 - x0), y1 - 0.25 * (y1 - y0)), (x0 + 0.25 * (x1 - x0), y1 - 0.25 * (y1 - y0))]
    wells = sorted(synth.place_wells_in_polygon(spark, n_wells, inner, mix_seed(seed, 40) >> 1).collect(), key=lambda r: r.well)
    picks, manifest = [], {"seed": seed, "lattice": vars(lattice) | {}, "zones": [{"zone": z[0], "mean_m": z[1], "ntg": z[2], "net_por": list(z[3])} for z in ZONES], "wells": []}
    for w in wells:
        path = spark.createDataFrame(well_path(spark, w.well, (w.x, w.y), lattice).collect(), "well int, seq int, md double, x double, y double, z double, tvd double, incl double, azim double")
        name = f"W-{w.well + 1}"
        textgrids.write_wellpath(path, os.path.join(root, "wells", f"{name}.wellpath"), KB)
        tops = {}
        for k, surface in enumerate(names):
            hit = synth.first_crossing(path, depth_at(path, stack.where(F.col("ord") == k), lattice)).first()
            if hit is None:
                continue
            station = path.orderBy(F.abs(F.col("md") - hit.md)).select("x", "y").first()
            at = path.where(F.col("md") <= hit.md).agg(F.max(F.struct("md", "tvd", "incl"))).first()[0]
            import math

            tvdss = at["tvd"] + (hit.md - at["md"]) * math.cos(math.radians(at["incl"])) - KB
            tops[surface] = hit.md
            picks.append((len(picks), station.x, station.y, tvdss, hit.md, "Horizon", surface, name))
        logs = None
        for k, (zone, _, ntg, por) in enumerate(ZONES):
            a, b = tops.get(names[k]), tops.get(names[k + 1])
            if a is None or b is None or b - a < 2 * STEP:
                continue
            n = int((b - a) / STEP)
            one = synth.petro_curves(spark, synth.PetroZoneSpec(ntg, por, NON_NET, BED_M, CORR_M), STEP, n, mix_seed(seed, 100 + 10 * w.well + k))
            one = one.select((a + F.col("k") * STEP).alias("md"), F.col("phie").alias("por"), F.col("net_flag").cast("double").alias("ntg"), F.when(F.col("net_flag"), 0.25).otherwise(1.0).alias("sw"))
            logs = one if logs is None else logs.unionByName(one)
        if logs is not None:
            textgrids.write_las2(logs.select((F.col("md") * 1000).cast("long").alias("k"), "md", "por", "ntg", "sw"), os.path.join(root, "wells", f"{name}.las"), name, STEP, KB)
        manifest["wells"].append({"well": name, "x": w.x, "y": w.y, "tops_md": tops})
    textgrids.write_tops(spark.createDataFrame(picks, "ord int, x double, y double, tvdss double, md double, type string, surface string, well string"), os.path.join(root, "Tops"))
    with open(os.path.join(root, "manifest.json"), "w") as f:
        json.dump(manifest, f, indent=1, sort_keys=True)
    return manifest
