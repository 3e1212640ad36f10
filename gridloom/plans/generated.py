"""Queries of the generators, whose results are random but reproducible."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import synth
from ..queries import query

ZONES = [synth.ZoneSpec(60.0, 0.24, 0.04, 8.0), synth.ZoneSpec(40.0, 0.12, 0.03, 5.0), synth.ZoneSpec(80.0, 0.20, 0.05, 10.0)]
PETRO = synth.PetroZoneSpec(0.6, (0.22, 0.04), (0.05, 0.01), 1.2, 4.0)


@query("facies_series")
def facies_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.facies_series(spark, 400, 0.5, 0.6, 3.0, 11, wells=8)


@query("por_with_facies")
def por_with_facies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.por_with_facies(synth.facies_series(spark, 400, 0.5, 0.6, 3.0, 11, wells=8), 0.5, (0.24, 0.03), (0.06, 0.02), 4.0, 11)


@query("log_series")
def log_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.log_series(spark, ZONES, 0.5, 6, 7, wells=8)


@query("petro_curves")
def petro_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.petro_curves(spark, PETRO, 0.5, 500, 7, wells=8)


@query("place_wells_in_polygon")
def place_wells_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.place_wells_in_polygon(spark, 50, [(0.0, 0.0), (10.0, 0.0), (12.0, 8.0), (3.0, 11.0)], 4)


@query("closure_outline")
def closure_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.lattice import Lattice

    lattice = Lattice(0.0, 0.0, 10.0, 10.0, 40, 30)
    ring = synth.closure_outline(synth.dome_surface(spark, lattice, 100.0, 1.3, 5.0), lattice, 50.0)
    return spark.createDataFrame([(k, *p) for k, p in enumerate(ring)], "seq int, x double, y double")


@query("study_area_outline")
def study_area_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = synth.study_area_outline((0.0, 0.0, 100.0, 60.0), 10.0, 8)
    return spark.createDataFrame([(k, *p) for k, p in enumerate(ring)], "seq int, x double, y double").orderBy(F.col("seq"))
