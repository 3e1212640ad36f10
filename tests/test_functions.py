import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import queries
from gridloom.errors import EmptyInput, GridError, InvalidArgument, NotFound, ParseFailure
from gridloom.functions import payload, rng, stats, units
from gridloom.functions.formula import FormulaBlock, evaluate_formulas, formula_info
from gridloom.functions.lattice import Georef, Lattice


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_formula_values(spark):
    df = spark.createDataFrame([(0, -2.0), (1, 0.1), (2, 10.0)], "k int, A double")
    out = evaluate_formulas(df, "Base = if(A > 0, -A, 2)\nBounded = clip(A, 0.25, 2)\nm = min(A, 1) + max(A, 1)\nneg = -2**2\nroot = 2**-1", keep=["k"]).orderBy("k")
    assert values(out, "Bounded") == [(0.25,), (0.25,), (2.0,)]
    assert values(out, "neg", "root") == [(4.0, 0.5)] * 3
    assert [r[0] for r in values(out, "m")] == pytest.approx([-1.0, 1.1, 11.0])


def test_formula_order_and_errors(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "A double")
    out = evaluate_formulas(df, ["B = C + A", "C = $base * 10"], {"base": 1.0})
    assert sorted(r[0] for r in values(out, "B")) == [11.0, 12.0, 13.0]
    block = FormulaBlock.parse("x = y\ny = x")
    with pytest.raises(InvalidArgument):
        block.evaluation_order
    with pytest.raises(InvalidArgument):
        FormulaBlock.parse("x = 1\nx = 2").evaluation_order
    with pytest.raises(NotFound):
        evaluate_formulas(df, "x = missing")
    with pytest.raises(NotFound):
        evaluate_formulas(df, "x = $p")
    with pytest.raises(InvalidArgument):
        evaluate_formulas(df, "x = $p", {"p": math.inf})
    for bad in ("x", "x = ", "x = sqrt(1, 2)", "x = nope(1)", "1 = 2", "x = (1", "x = 1 1", "x = @"):
        with pytest.raises(ParseFailure):
            FormulaBlock.parse(bad)
    assert formula_info("Z = $a * pow(q, $b) + r") == {"lhs": "Z", "variables": ["q", "r"], "params": ["a", "b"]}
    assert issubclass(GridError, ValueError)


def test_formula_ieee(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (math.nan,), (None,)], "A double")
    out = [r for r in evaluate_formulas(df, "d = 1 / A\nl = log(A)\ne = A == A\nn = A != A\nm = max(A, 1)", keep=["A"]).collect()]
    by = {r.A: r for r in out if r.A is not None and not math.isnan(r.A)}
    assert by[0.0].d == math.inf and by[0.0].l == -math.inf and math.isnan(by[-1.0].l)
    lost = [r for r in out if r.A is None or math.isnan(r.A)]
    assert all(r.e == 0.0 and r.n == 1.0 and math.isnan(r.m) for r in lost)


def test_reservoir_quality_block(spark):
    df = spark.createDataFrame([(100.0, 0.25), (400.0, 0.25), (900.0, 0.25)], "PermXY_BC double, PorE_BC double")
    out = evaluate_formulas(df, ["RQI = $lambda * sqrt(PermXY_BC / PorE_BC)", "Swirr = $SHF_c * pow(RQI, $SHF_d)"], {"lambda": 0.0314, "SHF_c": 0.2, "SHF_d": -0.3})
    assert sorted(r[0] for r in values(out, "RQI")) == pytest.approx([0.628, 1.256, 1.884])


def test_stats_values(spark):
    df = spark.createDataFrame([(1, float(v), 1.0) for v in range(1, 6)] + [(2, 7.0, 2.0)], "g int, v double, w double")
    d = {r.g: r for r in stats.describe(df, "v", ["g"]).collect()}
    assert (d[1].p25, d[1].median, d[1].mean, d[1].variance) == (2.0, 3.0, 3.0, 2.5)
    assert d[2].variance == 0.0
    w = {(r.g, r.p): r.v for r in stats.weighted_percentiles(df, "v", "w", ["g"], [0, 25, 100]).collect()}
    assert w == {(1, 0): 1.0, (1, 25): 1.75, (1, 100): 5.0, (2, 0): 7.0, (2, 25): 7.0, (2, 100): 7.0}
    s = {r.g: r for r in stats.weighted_stats(df, "v", "w", ["g"]).collect()}
    assert s[2].weighted_variance == 0.0 and s[1].weighted_variance == pytest.approx(2.5)
    r = stats.reservoir_summary(spark.range(1, 12).select(F.col("id").cast("double").alias("v")), "v", []).first()
    assert (r.p90, r.p50, r.p10, r["mean"]) == (2.0, 6.0, 10.0, 6.0)
    pair = spark.createDataFrame([(1.0, 3.0), (3.0, 1.0)], "v double, w double")
    assert pair.agg(stats.weighted_mean(F.col("v"), F.col("w"))).first()[0] == 1.5
    with pytest.raises(InvalidArgument):
        stats.percentile(F.col("v"), 101)


def test_percentiles_by_ranges(spark):
    """Groups that lie in many ranges, in a part of one, and of null; weights of 0, values that come again, halves of weights at the ends."""
    r = np.random.default_rng(3)
    rows = [(g, float(v), float(w)) for g, n in ((1, 4000), (2, 3), (None, 900), (4, 1)) for v, w in zip(r.integers(0, n, n) / 4, r.integers(0 if n > 3 else 1, 4, n), strict=True)]
    df = spark.createDataFrame([*rows, (5, None, 1.0)], "g int, v double, w double")
    ps = [0, 0.01, 10, 25, 33.3, 50, 75, 99.99, 100]
    plain = stats.percentiles(df, "v", ["g"], ps)
    weighted = stats.weighted_percentiles(df, "v", "w", ["g"], ps)
    for found in (plain, weighted):  # windows are over sums of ranges, or over the range that holds what is asked for
        text = found._jdf.queryExecution().optimizedPlan().toString()
        assert "_part#" in text and "percentile(" not in text
    plain, weighted = ({(x.g, x.p): x.v for x in found.collect()} for found in (plain, weighted))
    for g in (1, 2, None, 4):
        v, w = np.array(sorted((v, w) for k, v, w in rows if k == g)).T
        at = (np.cumsum(w) - w / 2) / w.sum() if w.sum() else np.zeros(len(w))
        for p in ps:
            assert plain[g, p] == pytest.approx(np.percentile(v, p))
            if w.sum():
                k = np.flatnonzero(at < p / 100)
                k = k[-1] if len(k) else -1
                want = v[0] if k < 0 else v[-1] if k + 1 == len(v) else v[k] + (p / 100 - at[k]) / (at[k + 1] - at[k]) * (v[k + 1] - v[k])
                assert weighted[g, p] == pytest.approx(want), (g, p)
    assert len(plain) == 4 * len(ps)
    d = {x.g: x for x in stats.describe(df, "v", ["g"]).collect()}
    assert (d[5].n, d[5].median) == (0, None) and d[None].median == plain[None, 50]
    whole = stats.describe(df, "v", []).first()
    assert whole.n == len(rows) and whole.median == pytest.approx(np.median([x[1] for x in rows]))
    for found in (stats.describe(df, "v", ["g"]), stats.reservoir_summary(df, "v", ["g"]), queries.QUERIES["formula_block"](spark, "/root/testdata/sf0.001")):
        assert "percentile(" not in found._jdf.queryExecution().optimizedPlan().toString()  # no aggregate holds a group's values


def test_aggregate(spark):
    rows = [("a", 0, 3.0), ("a", 1, 1.0), ("a", 2, 2.0), ("b", 0, 10.0), ("b", 1, 30.0)]
    df = spark.createDataFrame(rows, "s string, t int, v double")
    assert sorted(values(stats.aggregate(df, "s", "t", "v"), "trial", "total")) == [(0, 13.0), (1, 31.0)]
    assert sorted(values(stats.aggregate(df, "s", "t", "v", "comonotonic"), "trial", "total")) == [(0, 11.0), (1, 33.0)]


def test_units(spark):
    df = spark.createDataFrame([(12.4e6,), (2.5e9,), (3.0,)], "v double")
    assert [r[0] for r in values(df, units.format_volume(F.col("v")))] == ["12.4 mcm", "2.5 bcm", "3.0 m³"]
    there = {"ft_to_m": "m_to_ft", "bbl_to_m3": "m3_to_bbl", "psi_to_bar": "bar_to_psi", "km2_to_m2": "m2_to_km2"}
    for a, b in there.items():
        assert df.select(units.convert(b, units.convert(a, F.col("v")))).first()[0] == pytest.approx(12.4e6)


def test_lattice():
    turned = Lattice(0.0, 0.0, 10.0, 10.0, 5, 5, 30.0)
    assert turned.node_xy(1, 0) == pytest.approx((10 * math.cos(math.radians(30)), 5.0))
    flipped = Lattice(0.0, 0.0, 10.0, 20.0, 4, 4, 0.0, True)
    assert flipped.node_xy(0, 1) == pytest.approx((0.0, -20.0))
    assert flipped.xy_to_ij(*flipped.node_xy(2, 3)) == pytest.approx((2, 3))
    assert flipped.bbox() == pytest.approx((0, -60, 30, 0))
    assert Georef(5.0, 6.0).lattice(turned).node_xy(0, 0) == (5.0, 6.0)
    with pytest.raises(GridError):
        Lattice(0, 0, 0.0, 1, 2, 2).xy_to_ij(1, 1)


def test_draws(spark):
    a = rng.Sampler.normal(0, 1).sample_n(spark.newSession(), 5000, 7).repartition(16).orderBy("k").collect()
    b = rng.Sampler.normal(0, 1).sample_n(spark, 5000, 7).orderBy("k").collect()
    assert a == b
    v = [r.v for r in a]
    assert abs(sum(v) / 5000) < 0.05 and abs(sum(x * x for x in v) / 5000 - 1) < 0.06
    low = [r.v for r in rng.Sampler.truncated_normal(0, 1, 8, 9).sample_n(spark, 10, 1).collect()]
    assert all(8 <= x <= 9 for x in low)
    assert rng.uniform_at(42, "s", 3) == spark.range(4).select(rng.uniform(42, "s", F.col("id"))).collect()[3][0]
    from statistics import NormalDist

    ps = [k / 1000 for k in range(1, 1000)] + [1e-9, 1e-20]
    found = spark.createDataFrame([(p,) for p in ps], "p double").select("p", rng.normal_inverse(F.col("p")).alias("z")).select("p", "z", rng.normal_cdf(F.col("z")).alias("q")).collect()
    assert all(abs(r.z - NormalDist().inv_cdf(r.p)) < 1e-12 * max(1, abs(r.z)) for r in found)
    assert all(abs(r.q - r.p) < 1e-14 for r in found)
    for bad in (lambda: rng.Sampler.uniform(1, 1), lambda: rng.Sampler.triangular(0, 5, 4), lambda: rng.Sampler.truncated_normal(0, 0, 0, 1), lambda: rng.Sampler.normal(math.nan, 1)):
        with pytest.raises(InvalidArgument):
            bad()


def test_payload_parts(spark, tmp_path):
    assert payload.parse_spec("ntg_map_inferno_-2700_-2500") == {"enabled": True, "attr": "ntg_map", "cmap": "inferno", "range": [-2700.0, -2500.0]}
    assert payload.parse_spec("net_pay")["attr"] == "net_pay" and not payload.parse_spec(None)["enabled"]
    for bad in ("viridis_1", "viridis_a_b", ""):
        with pytest.raises(ValueError):
            payload.parse_spec(bad)
    table = payload.BlockTable()
    a = table.marker([1.0, None], "f32", [2])
    assert table.marker([1.0, math.nan], "f32", [2]) == a and len(table.table) == 1
    csr = table.csr([[(0, 0), (1, 1)], [], [(2, 2)]])["__csr__"]
    import base64

    import numpy as np

    assert np.frombuffer(base64.b64decode(table.table[csr["offsets"]]["data"]), "<u4").tolist() == [0, 2, 2, 3]
    assert payload.major_step(25) == 100 and payload.major_step(20) == 100 and payload.major_step(10) == 50
    lattice = Lattice(0.0, 0.0, 1.0, 1.0, 3, 2)
    field = lattice.nodes(spark).select("i", "j", F.when(F.col("i") == 0, math.nan).otherwise(F.col("i") + 10.0 * F.col("j")).alias("v"))
    m = payload.map_payload(field, lattice, levels=[5.0, 10.0])
    assert m["horizons"][0]["values"] == [None, 1.0, 2.0, None, 11.0, 12.0] and len(m["contours"][0]["lines"]) == 1
    big = payload.map_payload(field, lattice, threshold=1)
    assert "__block__" in big["horizons"][0]["values"] and len(big["blocks"]) == 1
    payload.save_view(payload.view_payload("demo", "v", map=m), str(tmp_path / "v.html"))
    assert "application/json" in (tmp_path / "v.html").read_text()
    tri = payload.triangle_colours(spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 0.5), (3, math.nan)], "nid int, value double"), spark.createDataFrame([(0, 0, 1, 2), (1, 1, 2, 3)], "tid int, a int, b int, c int"), 0.0, 1.0).collect()
    assert [(r.tid, r.rgb) for r in tri] == [(0, [33, 145, 140])]
    ids = payload.vertex_ids(spark.createDataFrame([(0.0, 0.0, 1.00001), (0.0, 0.0, 1.00002), (1.0, 0.0, 0.0)], "x double, y double, z double"))
    assert sorted(r.nid for r in ids.collect()) == [0, 0, 1]
    lines = spark.range(10).select(F.col("id").alias("i"))
    assert [r.i for r in payload.sampled_lines(lines, "i", 10, 4).collect()] == [0, 4, 8, 9]
    w = payload.raster_window(lattice.nodes(spark), (0, 2), (0, 1), (1, 2)).collect()
    assert {(r.i, r.j) for r in w} == {(0, 0), (0, 1)}


def test_empty_input_is_an_error():
    from gridloom.operators.mincurv import min_curvature_np

    import numpy as np

    with pytest.raises(EmptyInput):
        min_curvature_np(np.empty((0, 3)), Lattice(0, 0, 1, 1, 3, 3))


def _whole_windows(df):
    """The windows of a plan that are not over ranges."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in text.splitlines() if "Window [" in line and "windowspecdefinition(" in line and "_part#" not in line]


def test_csr_offsets_by_ranges(spark):
    lines = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("k"), (F.col("id") % 7).alias("n"))
    found = payload.csr_offsets(lines, "k", "n")
    assert not _whole_windows(found)  # no window of all rows
    at = 0
    for r in sorted(found.collect()):
        assert (r.offset, found.columns) == (at, ["k", "n", "offset"])
        at += r.n
    assert at == sum(k % 7 for k in range(5000))
    assert payload.csr_offsets(lines.limit(0), "k", "n").collect() == []
    ids = payload.vertex_ids(spark.range(3000).select((F.col("id") % 1000).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z")))
    assert {(r.x, r.nid) for r in ids.collect()} == {(float(k), k) for k in range(1000)} and not _whole_windows(ids)
