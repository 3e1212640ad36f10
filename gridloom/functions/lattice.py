"""Lattices: a rotated, possibly flipped rectangular grid, its nodes as a relation and its maps as columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidGeometry

ON_NODE = 1e-9


def round_half_away(x: Column) -> Column:
    return F.when(x < 0, -F.floor(-x + F.lit(0.5))).otherwise(F.floor(x + F.lit(0.5))).cast("long")


@dataclass(frozen=True)
class Lattice:
    xori: float
    yori: float
    xinc: float
    yinc: float
    ncol: int
    nrow: int
    rotation_deg: float = 0.0
    yflip: bool = False

    @classmethod
    def regular(cls, xori: float, yori: float, xinc: float, yinc: float, ncol: int, nrow: int) -> Lattice:
        return cls(xori, yori, xinc, yinc, ncol, nrow)

    @property
    def yflip_factor(self) -> float:
        return -1.0 if self.yflip else 1.0

    @property
    def _turn(self) -> tuple[float, float]:
        r = math.radians(self.rotation_deg)
        return math.cos(r), math.sin(r)

    def node_xy(self, i, j) -> tuple:
        """World position of a node; i and j are columns or numbers."""
        c, s = self._turn
        dx, dy = i * self.xinc, j * (self.yinc * self.yflip_factor)
        return self.xori + dx * c - dy * s, self.yori + dx * s + dy * c

    def xy_to_ij(self, x, y) -> tuple:
        """Fractional node indices of a world position."""
        if self.xinc == 0 or self.yinc == 0:
            raise InvalidGeometry("a lattice with zero spacing has no inverse")
        c, s = self._turn
        dx, dy = x - self.xori, y - self.yori
        return (dx * c + dy * s) / self.xinc, (-dx * s + dy * c) / (self.yinc * self.yflip_factor)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """(i, j, x, y); no rows are kept on the driver."""
        n = F.col("id")
        at = spark.range(self.ncol * self.nrow).select(F.floor(n / self.nrow).cast("int").alias("i"), (n % self.nrow).cast("int").alias("j"))
        x, y = self.node_xy(F.col("i"), F.col("j"))
        return at.select("i", "j", x.cast("double").alias("x"), y.cast("double").alias("y"))

    def bbox(self) -> tuple[float, float, float, float]:
        corners = [self.node_xy(i, j) for i in (0, self.ncol - 1) for j in (0, self.nrow - 1)]
        xs, ys = zip(*corners, strict=True)
        return min(xs), min(ys), max(xs), max(ys)

    def inside(self, i: Column, j: Column) -> Column:
        return (i >= 0) & (j >= 0) & (i < self.ncol) & (j < self.nrow)

    def snap(self, points: DataFrame) -> DataFrame:
        """points (x, y, ...) with the nearest node i, j; points off the lattice go."""
        fi, fj = self.xy_to_ij(F.col("x"), F.col("y"))
        return points.select("*", round_half_away(fi).cast("int").alias("i"), round_half_away(fj).cast("int").alias("j")).where(self.inside(F.col("i"), F.col("j")))

    def footprint(self, points: DataFrame) -> DataFrame:
        """points with a row for each of the four nodes around it: i, j and bilinear weight w; points beyond the lattice go."""
        fi, fj = self.xy_to_ij(F.col("x"), F.col("y"))
        rows = points.select("*", fi.alias("_fi"), fj.alias("_fj")).where((F.col("_fi") >= 0) & (F.col("_fj") >= 0) & (F.col("_fi") <= self.ncol - 1) & (F.col("_fj") <= self.nrow - 1))
        i0 = F.least(F.floor("_fi"), F.lit(max(self.ncol - 2, 0))).cast("int")
        j0 = F.least(F.floor("_fj"), F.lit(max(self.nrow - 2, 0))).cast("int")
        rows = rows.withColumns({"_i": i0, "_j": j0})
        t, u = F.col("_fi") - F.col("_i"), F.col("_fj") - F.col("_j")
        corner = lambda a, b: F.struct((F.col("_i") + a).alias("i"), (F.col("_j") + b).alias("j"), ((t if a else 1 - t) * (u if b else 1 - u)).alias("w"))
        rows = rows.select(*points.columns, F.explode(F.array(corner(0, 0), corner(1, 0), corner(0, 1), corner(1, 1))).alias("_c"))
        return rows.select(*points.columns, "_c.i", "_c.j", "_c.w")

    def classify(self, points: DataFrame) -> DataFrame:
        """points with kind: `node` (within ON_NODE of one), `off` (between nodes) or `skip` (beyond the lattice)."""
        fi, fj = self.xy_to_ij(F.col("x"), F.col("y"))
        ri, rj = round_half_away(fi), round_half_away(fj)
        on = (F.abs(fi - ri) <= ON_NODE) & (F.abs(fj - rj) <= ON_NODE) & self.inside(ri, rj)
        within = (fi >= 0) & (fj >= 0) & (fi <= self.ncol - 1) & (fj <= self.nrow - 1)
        return points.select("*", F.when(on, "node").when(within, "off").otherwise("skip").alias("kind"))


@dataclass(frozen=True)
class Georef:
    """A translation from local to world positions."""

    x0: float
    y0: float

    def place(self, x, y) -> tuple:
        return x + self.x0, y + self.y0

    def place_points(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"x": F.col("x") + self.x0, "y": F.col("y") + self.y0})

    def lattice(self, local: Lattice) -> Lattice:
        return Lattice(local.xori + self.x0, local.yori + self.y0, local.xinc, local.yinc, local.ncol, local.nrow, local.rotation_deg, local.yflip)

    def place_extent(self, box: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
        return box[0] + self.x0, box[1] + self.y0, box[2] + self.x0, box[3] + self.y0
