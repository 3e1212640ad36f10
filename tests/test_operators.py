import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.errors import GridError, InvalidArgument
from gridloom.functions.lattice import Lattice
from gridloom.operators import gridding, interp, kriging, mincurv, simulate, spatial, synth, variogram
from gridloom.operators.variogram import AnisotropicVariogram, Variogram

SPHERE = Variogram("sph", 0.0, 1.0, 12.0)


def frame(spark, rows):
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], "pid long, x double, y double, z double")


def grid_of(df, lattice, v="v"):
    out = np.full((lattice.ncol, lattice.nrow), np.nan)
    for r in df.collect():
        out[r.i, r.j] = r[v]
    return out


@pytest.fixture(scope="module")
def scatter():
    r = np.random.default_rng(5)
    xy = r.uniform(0, 20, (120, 2))
    return np.c_[xy, np.sin(xy[:, 0] / 4) + 0.1 * xy[:, 1]]


def test_gridding_exact_cases(spark):
    lattice = Lattice(0.0, 0.0, 1.0, 1.0, 2, 2)
    corners = frame(spark, [(0, 0, 1), (1, 0, 2), (0, 1, 3), (1, 1, 4)])
    for method in ("nearest", "idw", "min_curvature"):
        assert grid_of(gridding.grid(corners, lattice, method), lattice) == pytest.approx(np.array([[1, 3], [2, 4]]))
    middle = Lattice(0.5, 0.5, 1.0, 1.0, 1, 1)
    assert grid_of(gridding.grid_idw(corners, middle), middle)[0, 0] == pytest.approx(2.5)
    with pytest.raises(InvalidArgument):
        gridding.grid(corners, lattice, "nope")


def test_nearest_reaches_far_and_ties(spark):
    points = frame(spark, [(0, 0, 1), (100, 100, 2), (0, 2, 3)])
    lattice = Lattice(0.0, 1.0, 60.0, 60.0, 2, 2)
    assert grid_of(gridding.grid_nearest(points, lattice, 1.0), lattice) == pytest.approx(np.array([[1, 3], [1, 2]]))


def test_pairs_match_brute_force(spark, scatter):
    pairs = spatial.pairs_within(frame(spark, scatter), 3.0).select("a.pid", F.col("b.pid").alias("q"), "h").collect()
    d = np.hypot(*(scatter[:, None, :2] - scatter[None, :, :2]).transpose(2, 0, 1))
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if d[i, j] < 3}
    assert {(r.pid, r.q) for r in pairs} == want


def test_knn_of_repeated_places(spark):
    """Rows at one place add no pairs: 400 targets and 400 points at 4 places each would make 160,000."""
    rows = lambda key, n, shift: spark.range(n).select(F.col("id").alias(key), (F.col("id") % 2).cast("double").alias("x"), (F.floor(F.col("id") / 2) % 2 + shift).cast("double").alias("y"))
    targets, points = rows("tid", 400, 0.0), rows("pid", 400, 0.25)
    made = spatial.knn_within(targets, points, 5.0, 3, ["tid"]).select("t.tid", "p.pid", "d2", "rank")
    at, to = ({r[0]: (r.x, r.y) for r in df.collect()} for df in (targets, points))
    want = {}
    for t, (x, y) in at.items():
        near = sorted(((x - a) ** 2 + (y - b) ** 2, p) for p, (a, b) in to.items())[:3]
        want |= {(t, k + 1): (p, d) for k, (d, p) in enumerate(near)}
    assert {(r.tid, r["rank"]): (r.pid, r.d2) for r in made.collect()} == want
    metrics = made._jdf.queryExecution().executedPlan()
    joined = [int(n) for n in _rows_of_joins(metrics)]
    assert joined and max(joined) <= 400 * 3


def _rows_of_joins(plan):
    """Rows out of each join of a plan that has run."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
        name = plan.nodeName()
    if "Join" in name and plan.metrics().contains("numOutputRows"):
        yield plan.metrics().apply("numOutputRows").value()
    if "QueryStage" in name:
        yield from _rows_of_joins(plan.plan())
    children = plan.children()
    for k in range(children.size()):
        yield from _rows_of_joins(children.apply(k))


def test_min_curvature(spark, scatter):
    lattice = Lattice(0.0, 0.0, 2.0, 2.0, 11, 11)
    plane = np.c_[scatter[:, :2], 3 + 0.5 * scatter[:, 0] - 0.2 * scatter[:, 1]]
    i, j = np.mgrid[:11, :11]
    assert mincurv.min_curvature_np(plane, lattice) == pytest.approx(3 + i - 0.4 * j, abs=1e-7)
    operator = mincurv.MinCurvatureOperator(lattice, scatter[:, :2])
    direct = operator.solve(scatter[:, 2:])[:, 0]
    relaxed = operator._relax(operator._anchors(scatter[:, 2:])[:, 0].copy(), scatter[:, 2])
    assert np.abs(direct - relaxed).max() < 0.01
    grid = mincurv.min_curvature_np(scatter, lattice)
    fi, fj = scatter[:, 0] / 2, scatter[:, 1] / 2
    i0, j0 = fi.astype(int), fj.astype(int)
    t, u = fi - i0, fj - j0
    at = grid[i0, j0] * (1 - t) * (1 - u) + grid[i0 + 1, j0] * t * (1 - u) + grid[i0, j0 + 1] * (1 - t) * u + grid[i0 + 1, j0 + 1] * t * u
    assert np.sqrt(np.mean((at - scatter[:, 2]) ** 2)) < 0.3
    horizons = frame(spark, scatter).withColumn("h", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("z", F.col("z") + F.col("h"))
    both = mincurv.grid_horizons(horizons, lattice, "h")
    assert grid_of(both.where("h = 1"), lattice) == pytest.approx(grid + 1, abs=1e-6)


def test_variogram(spark, scatter):
    line = frame(spark, [(0, 0, 0), (1, 0, 1), (2, 0, 2)])
    e = {r.bin: r for r in variogram.experimental(line, 1.0, 4).collect()}
    assert {k: (r.lag, r.gamma, r.n) for k, r in e.items()} == {1: (1.0, 0.5, 2), 2: (2.0, 2.0, 1)}
    truth = Variogram("spherical", 0.5, 3.0, 40.0)
    exp = spark.range(1, 41).select(F.col("id").cast("int").alias("bin"), (F.col("id") * 2.0).alias("lag"), F.lit(10).alias("n")).withColumn("gamma", truth.gamma(F.col("lag")))
    v = variogram.fit(exp, "spherical")
    assert (v.nugget, v.sill, v.range) == pytest.approx((0.5, 3.0, 40.0), rel=0.02)
    assert AnisotropicVariogram("exp", 0, 1, 10, 5, 3, 395.0).azimuth == 35.0
    h = np.linspace(0, 50, 11)
    assert truth.gamma_np(h)[0] == 0 and truth.gamma_np(h)[-1] == 3.5
    with pytest.raises(GridError):
        Variogram("cubic", 0, 1, 1)
    with pytest.raises(GridError):
        Variogram("sph", -1, 1, 1)


def test_kriging(spark, scatter):
    lattice = Lattice(float(scatter[0, 0]), float(scatter[0, 1]), 3.0, 3.0, 3, 3)
    points = frame(spark, scatter)
    everything = kriging.ordinary_kriging(points, lattice, SPHERE)
    local = kriging.local_kriging(points, lattice, SPHERE, 200, 100.0)
    assert grid_of(local, lattice, "estimate") == pytest.approx(grid_of(everything, lattice, "estimate"), abs=1e-6)
    assert grid_of(local, lattice, "variance") == pytest.approx(grid_of(everything, lattice, "variance"), abs=1e-6)
    assert grid_of(everything, lattice, "estimate")[0, 0] == pytest.approx(scatter[0, 2], abs=1e-8)
    alone = kriging.local_kriging(points, Lattice(1000.0, 1000.0, 1.0, 1.0, 1, 1), SPHERE, 4, 5.0).first()
    assert math.isnan(alone.estimate)


def test_simulation(spark, scatter):
    lattice = Lattice(0.0, 0.0, 2.0, 2.0, 11, 11)
    points = frame(spark, scatter).withColumn("layer", F.col("pid") % 3)
    seeds = spark.createDataFrame([(0, 5), (1, 5), (2, 9)], "layer long, seed long")
    one = simulate.sgs(points, seeds, lattice, SPHERE, 8, 15.0)
    many = simulate.sgs(points.repartition(16), seeds, lattice, SPHERE, 8, 15.0)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(one) == key(many)
    z = scatter[np.arange(120) % 3 == 0, 2]
    v = [r.v for r in one.where("layer = 0").collect()]
    assert min(v) >= z.min() and max(v) <= z.max() and len(v) == 121
    on_node = frame(spark, [(4, 6, 1.5), (0, 0, 0.5), (20, 20, 2.5)]).withColumn("layer", F.lit(0))
    held = simulate.sgs(on_node, spark.createDataFrame([(0, 1)], "layer int, seed long"), lattice, SPHERE, 8, 15.0)
    assert grid_of(held, lattice)[2, 3] == pytest.approx(1.5)
    big = Lattice(0.0, 0.0, 1.0, 1.0, 40, 40)
    u = np.array([r.v for r in simulate.sgs_unconditional(spark.range(6).select(F.col("id").alias("seed")), big, Variogram("exp", 0, 1, 4.0), 10.0, 4.0, 8, 6.0).collect()])
    assert abs(u.mean() - 10) < 0.4 and abs(u.var() - 4) < 0.8
    beside = lattice.nodes(spark).select(F.lit(0).cast("long").alias("layer"), "i", "j", (F.col("x") + F.col("y")).alias("v"))
    co = grid_of(simulate.sgs_collocated(points.where("layer = 0"), beside, seeds.where("layer = 0"), lattice, SPHERE, 0.95, 8, 3.0), lattice)
    i, j = np.mgrid[:11, :11]
    assert np.corrcoef(co.ravel(), (i + j).ravel())[0, 1] > 0.2
    scores = simulate.NormalScore(np.array([1.0, 2.0, 2.0, 9.0]))
    assert scores.back(scores.forward(2.0)) == pytest.approx(2.0) and scores.forward(100) == scores.score_bounds()[1]


def test_interp_values(spark):
    knots = spark.createDataFrame([("a", float(x), float(y)) for x, y in ((0, 0), (1, 2), (2, 1), (4, 3))], "s string, x double, y double")

    def at(qs, method, **o):
        q = spark.createDataFrame([("a", k, v) for k, v in enumerate(qs)], "s string, qid int, q double")
        return [r.v for r in interp.interp1d(knots, q, ["s"], method, **o).orderBy("qid").collect()]

    assert at([0.4, 1.6, 4.0], "prev") == [0, 2, 3]
    assert at([0.4, 1.6, 4.0], "bfill") == [2, 1, 3]
    assert at([0.4, 1.6, 3.5], "nn") == [0, 1, 3]
    assert at([-0.5, 6.0], "linear", extrapolate=True) == [-1, 5]
    assert at([-0.5, 6.0], "next", extrapolate=True) == [0, 3]
    assert all(map(math.isnan, at([-0.5, 6.0, math.nan], "linear")))
    assert at([0.0, 1.0, 2.0, 4.0], "spline") == pytest.approx([0, 2, 1, 3])
    x, y = np.arange(8.0), np.sin(np.arange(8.0))
    m = interp.second_derivatives(x, y)
    a = np.zeros((8, 8))
    a[0, 0] = a[-1, -1] = 1
    for k in range(1, 7):
        a[k, k - 1 : k + 2] = 1 / 6, 4 / 6, 1 / 6
    assert m == pytest.approx(np.linalg.solve(a, np.r_[0, y[2:] - 2 * y[1:-1] + y[:-2], 0]))
    with pytest.raises(InvalidArgument):
        interp.method_of("quintic")


def test_series(spark):
    rows = spark.range(40_000).select(F.floor(F.col("id") / 10_000).cast("int").alias("well"), (F.col("id") % 10_000).alias("k"))
    z = synth.correlated_gaussian(rows, ["well"], "k", F.lit(0.8), 3)
    assert sorted(z.collect()) == sorted(synth.correlated_gaussian(rows.repartition(13), ["well"], "k", F.lit(0.8), 3).collect())
    r = z.agg(F.avg("z"), F.stddev("z")).first()
    assert abs(r[0]) < 0.06 and abs(r[1] - 1) < 0.06
    assert all(abs(x.r1 - 0.8) < 0.03 for x in synth.lag1_autocorrelation(z, ["well"], "k", "z").collect())
    f = synth.facies_series(spark, 20_000, 0.5, 0.6, 3.0, 1)
    assert abs(f.agg(F.avg("facies")).first()[0] - 0.6) < 0.05


def test_transform_and_petro(spark):
    t = synth.LogitNormal.match(0.24, 0.04)
    x = t.apply(np.random.default_rng(0).standard_normal(200_000))
    assert (x.mean(), x.std()) == pytest.approx((0.24, 0.04), rel=0.02)
    with pytest.raises(InvalidArgument):
        synth.LogitNormal.match(0.1, 0.4)
    spec = synth.PetroZoneSpec(0.6, (0.22, 0.04), (0.05, 0.01), 1.2, 4.0)
    c = synth.petro_curves(spark, spec, 0.5, 5_000, 2, wells=6)
    assert c.where(F.col("net_flag") != (F.col("phie") >= 0.10)).count() == 0
    s = c.agg(F.avg(F.col("net_flag").cast("int")), F.avg(F.when(F.col("net_flag"), F.col("phie"))), F.stddev(F.when(F.col("net_flag"), F.col("phie")))).first()
    assert tuple(s) == pytest.approx((0.6, 0.22, 0.04), abs=0.02)
    with pytest.raises(InvalidArgument):
        synth.calibrate(synth.PetroZoneSpec(0.001, (0.22, 0.04), (0.09, 0.03), 1.2, 4.0))
    assert synth.zone_sample_counts([synth.ZoneSpec(0.1, 0.2, 0.03, 5.0), synth.ZoneSpec(2.6, 0.2, 0.03, 5.0)], 0.5) == [1, 5]


def test_wells_and_outlines(spark):
    t = synth.trajectory(spark, (0.0, 0.0), 25.0, 1000.0, 30.0, synth.WellProfile.vertical())
    last = t.orderBy(F.desc("seq")).first()
    assert (last.md, last.x, last.z, last.tvd) == (1000.0, 0.0, -975.0, 1000.0)
    p = synth.WellProfile.build_hold(300.0, 3.0, 60.0, 395.0)
    assert p.azimuth == 35.0
    dls = synth.max_dogleg_severity(synth.trajectory(spark, (0.0, 0.0), 0.0, 2000.0, 10.0, p)).first().dls
    assert dls == pytest.approx(3.0, abs=1e-6)
    for bad in (lambda: synth.WellProfile.build_hold(-1, 3, 60, 0), lambda: synth.WellProfile.build_hold(0, 50, 60, 0), lambda: p.with_drop(0.0, 3.0, 10.0), lambda: p.with_drop(5000.0, 3.0, 70.0)):
        with pytest.raises(InvalidArgument):
            bad()
    lattice = Lattice(0.0, 0.0, 10.0, 10.0, 41, 41)
    dome = synth.dome_surface(spark, lattice, 100.0, 1.0, 0.0)
    ring = synth.closure_outline(dome, lattice, 50.0)
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))) / 2
    assert area == pytest.approx(math.pi * 2 * math.log(2) * 100.0**2, rel=0.02)
    assert synth.closure_outline(dome, lattice, 500.0) == []
    assert len(synth.study_area_outline((0, 0, 10, 5))) == 4 and len(synth.study_area_outline((0, 0, 10, 5), 1.0, 4)) == 20
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    wells = synth.place_wells_in_polygon(spark, 30, square, 1).collect()
    assert [w.well for w in sorted(wells)] == list(range(30)) and all(0 <= w.x <= 10 and 0 <= w.y <= 10 for w in wells)
    spots = spark.createDataFrame([(10.0, 5.0), (5.0, 5.0), (10.1, 5.0)], "x double, y double")
    assert [r[0] for r in spots.select(spatial.in_rings(F.col("x"), F.col("y"), [square])).collect()] == [True, True, False]
    noisy = synth.dome_surface(spark, Lattice(0.0, 0.0, 1.0, 1.0, 6, 6), 10.0, 1.0, 0.0, synth.NoiseSpec(1.0, SPHERE), 4)
    assert noisy.count() == 36
    assert synth.isochore(spark.range(1).select(F.col("id").alias("seed")), Lattice(0.0, 0.0, 1.0, 1.0, 6, 6), 0.0, 5.0, SPHERE).where("v < 0").count() == 0
    t = synth.trend_map(spark, Lattice(0.0, 0.0, 1.0, 1.0, 6, 6), SPHERE, 1).collect()
    assert all(0 < r.v < 1 for r in t)


def test_upsert_and_standardise(spark):
    a = spark.createDataFrame([(0, 0, 1.0, 1), (1, 1, 5.0, 1)], "i int, j int, v double, seq long")
    b = spark.createDataFrame([(0, 0, 2.0, 2)], "i int, j int, v double, seq long")
    assert {(r.i, r.v) for r in gridding.upsert_controls(a, b).collect()} == {(0, 2.0), (1, 5.0)}
    f = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (0, 2, math.nan)], "i int, j int, v double")
    assert [r.v for r in gridding.standardise(f).orderBy("j").collect()][:2] == [-1.0, 1.0]
