"""Grids against NumPy on small literal data: values, uncertainty, tags and refusals."""

import math

import numpy as np
import pytest

import gridloom as gl
from gridloom import errors as er
from gridloom.errors import GridError

NAN = float("nan")


def grid(spark, names, rows, dims):
    return gl.load(np.array(rows, dtype=float), names=list(names)).pivot(dims=list(dims))


@pytest.fixture(scope="module")
def table(spark):
    return grid(spark, ("mach", "alpha", "CT"), [[m, a, 0.1 + 0.1 * i + 0.02 * j] for i, m in enumerate((0.1, 0.2)) for j, a in enumerate((0.0, 2.0, 4.0))], ("mach", "alpha"))


def line(spark, x, **variables):
    return grid(spark, ("x", *variables), list(zip(x, *variables.values(), strict=True)), ("x",))


def values(g, name=None):
    out = g.to_numpy()
    return out[name or next(iter(out))]


def cells(g, column):
    order = [g.ordinal(d) for d in g.dim_names]
    return [r[column] for r in (g.densified().cells.orderBy(*order) if order else g.cells).collect()]


def close(a, b, tol=1e-9):
    np.testing.assert_allclose(np.asarray(a, dtype=float), np.asarray(b, dtype=float), rtol=tol, atol=tol, equal_nan=True)


# ------------------------------------------------------------------ loading and shape


def test_pivot_makes_sorted_dimensions(spark, table):
    assert table.shape == (2, 3) and [d.coords for d in table.dimensions] == [(0.1, 0.2), (0.0, 2.0, 4.0)]
    close(values(table), [[0.1, 0.12, 0.14], [0.2, 0.22, 0.24]])


def test_missing_combinations_are_nan(spark):
    g = grid(spark, ("a", "b", "v"), [[0, 0, 1], [1, 1, 2]], ("a", "b"))
    close(values(g), [[1, NAN], [NAN, 2]])
    assert g.diagnostics().variables["v"] == {"missing": 2, "infinite": 0, "coverage": 0.5}


def test_pivot_refuses(spark, table):
    raw = gl.load(np.array([[0.0, 1.0], [0.0, 2.0]]), names=["a", "v"])
    with pytest.raises(er.PivotDuplicateError):
        raw.pivot(["a"])
    with pytest.raises(er.DataError):
        gl.load(np.array([[NAN, 1.0], [0.0, 2.0]]), names=["a", "v"]).pivot(["a"])
    with pytest.raises(er.DimensionError):
        table.pivot(["CT"])
    with pytest.raises(er.VariableError):
        raw.pivot(["a", "v"])
    with pytest.raises(er.DuplicateNameError):
        gl.load(np.zeros((1, 2)), names=["a", "a"])


def test_auto_detect(spark):
    raw = gl.load(np.array([[a, b, a * 10 + b + 0.5] for a in range(3) for b in range(4)], dtype=float), names=["a", "b", "v"])
    assert raw.pivot(auto_detect=True, threshold=5).dim_names == ["a", "b"]
    assert raw.inspect()["columns"]["v"]["kind"] == "variable"


def test_select_coordinates(table):
    assert table.select({"alpha >": 1, "alpha <": 4}).dimensions[1].coords == (2.0,)
    assert table.select({"alpha !=": [0, 2]}).dimensions[1].coords == (4.0,)
    assert table.select({"mach": 0.2}).shape == (1, 3)
    for bad in ({"alpha": 3}, {"alpha >": 9}, {"beta": 1}, {"CT >": 9}):
        with pytest.raises(er.SelectionError):
            table.select(bad)


def test_select_masks_values(table):
    g = table.set_uncertainty({"CT": 0.1}).select({"CT >": 0.13})
    assert g.dimensions[1].coords == (0.0, 2.0, 4.0)
    close(values(g), [[NAN, NAN, 0.14], [0.2, 0.22, 0.24]])
    close(cells(g, "u_sys__CT"), [NAN, NAN, 0.1, 0.1, 0.1, 0.1])
    assert table.select({"CT >": 0.19}).dimensions[0].coords == (0.2,)
    assert table.compute("q = CT").select({"CT >": 0.13}).vars["q"].tagged


def test_select_tells_an_empty_result_from_a_bad_filter(table):
    raw = gl.load(np.array([[0.0, 1.0], [1.0, 2.0]]), names=["a", "v"])
    for empty in (lambda: table.select({"CT >": 9}), lambda: table.select({"CT >": 0.13, "CT <": 0.11}), lambda: raw.select({"v >": 9})):
        with pytest.raises(er.EmptySelectionError):
            empty()
    for bad in ({"beta": 1}, {"CT >": "x"}, {"CT >": [1, 2]}, {}):
        with pytest.raises(er.SelectionError) as refused:
            table.select(bad)
        assert not isinstance(refused.value, er.EmptySelectionError)


def test_select_other_frames(table):
    g = table.set_uncertainty({"CT": "10%"}).set_uncertainty({"CT": 0.0}, component="random")
    close(values(g.select({"CT >": 0.015}, Frame="UncFrame")), [[0.2, 0.22, 0.24]])
    tagged = table.interpolate({"alpha": [1, 2]})
    assert tagged.select({"CT": 1}, Frame="HistoryFrame").dimensions[1].coords == (1.0,)
    with pytest.raises(er.SelectionError):
        table.select({"alpha": 0}, Frame="HistoryFrame")


def test_at_squeeze_expand(table):
    g = table.at(mach=0.2)
    assert g.dim_names == ["alpha"]
    close(values(g), [0.2, 0.22, 0.24])
    full = table.at(mach=0.2, alpha=4)
    assert full.is_datapoint
    close(values(full), [0.24])
    assert table.select({"mach": 0.1}).squeeze().dim_names == ["alpha"]
    e = g.expand("beta", [5, 3], axis=0)
    assert e.shape == (2, 3) and e.dimensions[0].coords == (5.0, 3.0)
    close(values(e), [[0.2, 0.22, 0.24]] * 2)
    with pytest.raises(er.DataError):
        table.squeeze()
    for bad in ([1, 1], [[1, 2]], []):
        with pytest.raises(er.DataError):
            g.expand("beta", bad)


def test_concat(spark, table):
    more = table.interpolate({"alpha": [6, 8]})
    g = gl.concat([more, table], along="alpha")
    assert g.dim("alpha").coords == (6.0, 8.0, 0.0, 2.0, 4.0)
    close(values(g)[0], [0.16, 0.18, 0.1, 0.12, 0.14])
    assert cells(g, "tag__CT")[:5] == [-1, -1, 0, 0, 0]
    with pytest.raises(er.ConcatOverlapError):
        gl.concat([table, table], along="alpha")
    with pytest.raises(er.UncertaintyError):
        gl.concat([table, more.set_uncertainty({"CT": 1})], along="alpha")
    close(values(gl.concat([table], along="alpha")), values(table))


# ------------------------------------------------------------------ reductions


def test_average(spark):
    g = line(spark, [0, 1, 2, 3], v=[1, NAN, 3, 5]).set_uncertainty({"v": 0.2}).set_uncertainty({"v": 0.3}, component="random")
    row = g.average("x").cells.first()
    close([row.v, row.u_sys__v, row.u_rand__v], [3.0, 0.2, 0.3 / math.sqrt(3)])
    inf = line(spark, [0, 1], v=[1, math.inf]).average("x")
    assert values(inf)[0] == math.inf


def test_average_of_an_empty_line(spark):
    g = grid(spark, ("a", "b", "v"), [[0, 0, 1], [0, 1, 2], [1, 0, NAN]], ("a", "b")).set_uncertainty({"v": 0.1})
    out = g.average("b")
    close(values(out), [1.5, NAN])
    close(cells(out, "u_sys__v"), [0.1, 0.0])


def test_integrate(spark, table):
    close(values(table.integrate("CT", over="alpha")), [0.48, 0.88])
    close(values(table.integrate("CT", over=["alpha", "mach"])), [0.068])
    g = line(spark, [0, 1, 3, 4], v=[1, NAN, 3, 5])
    close(values(g.integrate("v", over="x")), [NAN])
    close(values(g.integrate("v", over="x", skipna=True)), [6 + 4])
    assert cells(g.integrate("v", over="x", skipna=True), "tag__v") == [1]
    single = grid(spark, ("x", "y", "v"), [[0, 1, 7], [1, 1, 8]], ("x", "y"))
    close(values(single.integrate("v", over="y")), [0, 0])
    u = line(spark, [0, 1, 2], v=[1, 2, 3]).set_uncertainty({"v": 0.1}).set_uncertainty({"v": 0.2}, component="random").integrate("v", over="x").cells.first()
    close([u.u_sys__v, u.u_rand__v], [0.2, math.sqrt(0.1**2 + 0.2**2 + 0.1**2)])


def test_polar_disk(spark):
    rows = [[r, t, 1.0] for r in (0, 0.5, 1) for t in (0, math.pi, 2 * math.pi)]
    g = grid(spark, ("r", "theta", "v"), rows, ("r", "theta"))
    close(values(g.integrate("v", over=["r", "theta"], coords="polar")), [math.pi])
    degrees = grid(spark, ("r", "theta", "v"), [[r, math.degrees(t), v] for r, t, v in rows], ("r", "theta")).set_metadata({"theta": {"unit": "deg"}})
    close(values(degrees.integrate("v", over=["r", "theta"], coords="polar")), [math.pi])
    close(values(degrees.integrate("v", over=["r", "theta"], coords="polar", skipna=True)), [math.pi])


def test_random_reduction_after_interpolation_is_refused(spark):
    g = line(spark, [0, 1], v=[1, 2]).set_uncertainty({"v": 1.0}, component="random").interpolate({"x": [0, 0.5, 1]})
    with pytest.raises(er.UncertaintyLineageError):
        g.average("x")
    assert line(spark, [0, 1], v=[1, 2]).set_uncertainty({"v": 1.0}).interpolate({"x": [0, 0.5]}).average("x").cells.count() == 1


# ------------------------------------------------------------------ resampling and kernels


def test_interpolate_methods(spark):
    x, y = np.array([0.0, 1.0, 2.5, 4.0]), np.array([1.0, 3.0, -1.0, 0.5])
    g, t = line(spark, x, v=y), [0.5, 1.0, 3.0, 5.0]
    close(values(g.interpolate({"x": t})), [2.0, 3.0, -0.5, 1.5])
    close(values(g.interpolate({"x": t}, method="nearest")), [1.0, 3.0, -1.0, 0.5])
    p = np.polyfit(x, y, 2)
    close(values(g.interpolate({"x": t}, method="polyfit", deg=2, override=True)), np.polyval(p, t), 1e-8)
    close(values(g.interpolate({"x": t}, method="polyfit", deg=2))[1], 3.0)
    assert cells(g.interpolate({"x": t}), "tag__v") == [1, 0, 1, -1]
    # A natural cubic spline through the points: check the system it solves.
    fine = np.linspace(0, 4, 4001)
    s = values(g.interpolate({"x": fine}, method="cubic", override=True))
    close(np.interp(x, fine, s), y, 1e-6)
    second = np.diff(s, 2) / (fine[1] - fine[0]) ** 2
    assert abs(second[0]) < 0.05 and abs(second[-1]) < 0.05 and np.abs(np.diff(second)).max() < 0.1


def test_interpolate_poison_and_uncertainty(spark):
    g = line(spark, [2, 0, 1], v=[NAN, 1, 3])
    close(values(g.interpolate({"x": [0.5, 1.5, 0]})), [2, NAN, 1])
    u = line(spark, [0, 1], v=[1, 3]).set_uncertainty({"v": 0.2}).set_uncertainty({"v": 0.4}, component="random").interpolate({"x": [0.5]}).cells.first()
    close([u.u_sys__v, u.u_rand__v], [0.2, 0.4 / math.sqrt(2)])
    for kwargs in ({"method": "polyfit"}, {"deg": 1}, {"method": "spline"}, {"method": "polyfit", "deg": 3}, {"method": "polyfit", "deg": -1}):
        with pytest.raises(GridError):
            g.interpolate({"x": [0]}, **kwargs)


def test_axis_translation(spark):
    g = grid(spark, ("m", "x", "q", "v"), [[m, x, (2 * x + 1) * (1 - 2 * m), x * x] for m in (0, 1) for x in range(5)], ("m", "x"))
    out = g.interpolate({"q": [2, -3, 11]}, axisTranslation={"from": "x", "to": "q"})
    close(values(out, "v"), [[0.5, -2.0, 23.0], [-1.5, 1.0, -6.0]])
    assert cells(out, "tag__v")[:3] == [1, -1, -1]
    one = g.at(m=0)
    for method in ("cubic", "nearest"):
        same = one.interpolate({"q": [2, 3]}, axisTranslation={"from": "x", "to": "q"}, method=method)
        assert values(same, "v")[1] == 1.0
    assert one.interpolate(axisTranslation={"from": "x", "to": "q"}).dim("q").coords == (1.0, 3.0, 5.0, 7.0, 9.0)
    with pytest.raises(er.VariableError):
        one.compute("z = sin(3*v)").interpolate(axisTranslation={"from": "x", "to": "z"})


def test_fill(spark):
    g = line(spark, [0, 1, 3, 4, 6], v=[NAN, 1, NAN, 3, NAN]).set_uncertainty({"v": 0.3}, component="random").set_uncertainty({"v": 0.1})
    lin = g.fill("x")
    close(values(lin), [NAN, 1, 1 + 4 / 3, 3, NAN])
    close(cells(lin, "u_rand__v")[2], math.hypot(0.3 / 3, 0.3 * 2 / 3))
    assert cells(lin, "tag__v") == [0, 0, 1, 0, 0]
    close(values(g.fill("x", method="nearest")), [1, 1, 3, 3, 3])
    plain = line(spark, [0, 1, 2, 3, 4], v=[1, NAN, 5, NAN, 17])
    close(values(plain.fill("x", method="polyfit", deg=2, global_fit=True)), [1, 2, 5, 10, 17])
    close(values(plain.fill("x", method="polyfit", deg=2, window=3))[1], NAN)
    assert values(line(spark, [0, 1, 2], v=[1, math.inf, 3]).fill("x"))[1] == math.inf
    with pytest.raises(er.UncertaintyError):
        g.fill("x", method="polyfit", deg=1, global_fit=True)
    with pytest.raises(er.DegreeError):
        plain.fill("x", deg=1)
    with pytest.warns(FutureWarning):
        plain.fill("x", "nearest")


def window(i, points, w):
    half = (w - 1) // 2
    lo = max(0, i - half)
    hi = min(points, lo + w)
    return max(0, hi - w), hi


@pytest.mark.parametrize(("w", "deg"), [(3, 1), (4, 1), (5, 2), (5, 3), (4, 0)])
def test_smooth_and_diff_match_moving_fits(spark, w, deg):
    rng = np.random.default_rng(w * 10 + deg)
    x, y = np.cumsum(rng.uniform(0.5, 2, 9)), rng.normal(size=9)
    y[4] = NAN
    g = line(spark, x, v=y)
    smooth, slope = np.full(9, NAN), np.full(9, NAN)
    for i in range(9):
        lo, hi = window(i, 9, w)
        ok = np.isfinite(y[lo:hi])
        if ok.sum() > deg:
            p = np.polyfit(x[lo:hi][ok] - x[i], y[lo:hi][ok], deg)
            smooth[i], slope[i] = p[-1], p[-2] if deg else 0.0
    smooth[4] = NAN
    close(values(g.smooth(along="x", method="savgol", window=w, polyorder=deg)), smooth, 1e-8)
    close(values(g.diff(along="x", window=w, deg=deg)), slope, 1e-7)
    edges = values(g.diff(along="x", window=w, deg=deg, nan_edges=True))
    centred = [i - window(i, 9, w)[0] == (w - 1) // 2 and window(i, 9, w)[1] - window(i, 9, w)[0] == w for i in range(9)]
    assert not np.isfinite(edges[~np.array(centred)]).any()


def test_smooth_other_methods(spark):
    g = line(spark, [0, 1, 2, 3], v=[1, 5, NAN, 3])
    close(values(g.smooth(along="x", method="moving_avg", window=3)), [3, 3, NAN, 4])
    close(values(g.smooth(along="x", method="spline", smoothing=0.0)), [1, 5, NAN, 3])
    y = values(line(spark, [0, 1, 2, 3], v=[0, 1, 0, 1]).smooth(along="x", method="spline", smoothing=1e9))
    close(y, np.polyval(np.polyfit(range(4), [0, 1, 0, 1], 1), range(4)), 1e-5)
    for kwargs in ({"method": "moving_avg"}, {"method": "moving_avg", "window": 3, "polyorder": 1}, {"method": "x"}, {"method": "savgol", "window": 3, "polyorder": 3}):
        with pytest.raises(GridError):
            g.smooth(along="x", **kwargs)
    with pytest.raises(er.UncertaintyError):
        g.set_uncertainty({"v": 1}).smooth(along="x", method="moving_avg", window=3)
    assert list(g.d["x"].vars) == ["dv_dx"]


@pytest.mark.parametrize("deg", [0, 1, 2, 3])
def test_fitmodel_and_fitvalue(spark, deg):
    rng = np.random.default_rng(deg)
    x, y = np.array([10.0, 11, 13, 14, 20]), rng.normal(size=5)
    g = line(spark, x, v=y)
    fit = g.fitmodel(along="x", deg=deg)
    assert fit.dim("x_coef").coords == tuple(f"x^{k}" for k in range(deg + 1))
    close(values(fit), np.polyfit(x, y, deg)[::-1], 1e-6)
    at = fit.fitvalue(coef_dims=["x_coef"], at={"x": [12, 30]})
    close(values(at), np.polyval(np.polyfit(x, y, deg), [12, 30]), 1e-6)
    assert cells(at, "tag__v") == [1, -1]
    close(values(line(spark, x, v=[NAN, NAN, NAN, NAN, 1]).fitmodel(along="x", deg=1)), [NAN, NAN])
    with pytest.raises(er.DimensionError):
        fit.fitvalue(coef_dims=["x_coef"], at={"y": [1]})


# ------------------------------------------------------------------ equations and uncertainty


def test_expressions_match_numpy(spark):
    a = np.array([0.0, 1.0, -2.0, 0.5, math.inf, NAN])
    b = np.array([0.0, 0.0, 3.0, -1.0, 2.0, 1.0])
    g = gl.load(np.column_stack([a, b]), names=["a", "b"])
    cases = {
        "a / b": lambda: a / b, "a ** b": lambda: a**b, "b ** a": lambda: b**a, "-a + 2*b - 1": lambda: -a + 2 * b - 1, "log(a)": lambda: np.log(a), "log10(b)": lambda: np.log10(b),
        "sqrt(b)": lambda: np.sqrt(b), "np.arctan2(a, b)": lambda: np.arctan2(a, b), "asin(a)": lambda: np.arcsin(a), "exp(-a)": lambda: np.exp(-a), "abs(a) * pi": lambda: np.abs(a) * np.pi,
        "np.maximum(a, b)": lambda: np.maximum(a, b), "np.mod(a, 3)": lambda: np.mod(a, 3), "np.where(b, a, 7)": lambda: np.where(b, a, 7), "np.nan_to_num(a)": lambda: np.nan_to_num(a),
        "np.round(a + 0.5)": lambda: np.round(a + 0.5), "np.clip(a, 0, 1)": lambda: np.clip(a, 0, 1), "np.log1p(b)": lambda: np.log1p(b), "a - np.nanmin(b)": lambda: a - np.nanmin(b),
        "b + np.mean(b)": lambda: b + np.mean(b), "b * np.max(a)": lambda: b * np.max(a), "np.std(b) + b": lambda: np.std(b) + b, "np.floor(a)": lambda: np.floor(a), "np.sign(b)": lambda: np.sign(b),
        "np.fmod(b, 2)": lambda: np.fmod(b, 2), "np.hypot(a, b)": lambda: np.hypot(a, b), "np.isnan(a)": lambda: np.isnan(a).astype(float), "tan(b)*cos(b)/np.tanh(b)": lambda: np.tan(b) * np.cos(b) / np.tanh(b),
    }
    with np.errstate(all="ignore"):
        for text, expected in cases.items():
            got = gl.load(np.column_stack([a, b, np.arange(6)]), names=["a", "b", "i"]).compute(f"r = {text}").cells.orderBy("i").toPandas()["r"]
            np.testing.assert_allclose(got.to_numpy(), expected(), rtol=1e-12, err_msg=text, equal_nan=True)
    for bad in ("a // b", "a % b", "a < b", "np.random.rand(3)", "np.sum(a, axis=0)", "a.b", "a[0]", "'x'", "True", "f(a)", "lambda: a", "np.sqrt(a, b)", "a +"):
        with pytest.raises(er.EquationError):
            g.compute(f"r = {bad}")
    with pytest.raises(er.VariableError):
        g.compute("r = c + 1")
    with pytest.raises(er.EquationError):
        g.compute("r == a")
    with pytest.raises(er.EquationError):
        gl.load(np.ones((1, 1)), names=["pi"]).compute("r = 2 * pi")


def test_gum_anchors(spark):
    x = gl.load(np.array([[2.0]]), names=["x"]).set_uncertainty({"x": 0.1})
    close(x.compute("r = 3*x - 2*x").cells.first().u_sys__r, 0.1)
    with pytest.raises(er.UncertaintyLineageError):
        x.compute("a = 3*x").compute("b = 2*x").compute("r = a - b")
    ab = gl.load(np.array([[3.0, 2.0]]), names=["a", "b"]).set_uncertainty({"a": 0.1, "b": 0.1})
    close(ab.compute("r = a - b").cells.first().u_sys__r, math.sqrt(0.02))
    close(ab.set_correlation({("a", "b"): 1}).compute("r = a - b").cells.first().u_sys__r, 0.0, 1e-7)


@pytest.mark.parametrize("text", ["a*b + b/a", "sin(a)*exp(b/3)", "a**b", "sqrt(a**2 + b**2)", "atan2(a, b)", "log(a)*log10(b) - acos(a/9)", "abs(a - 7*b)", "-tan(a)/asin(b/5)", "atan(a*b)"])
def test_derivatives_match_differences(spark, text):
    point, u, r = np.array([1.3, 2.1]), np.array([0.01, 0.02]), -0.4
    g = gl.load(point[None, :], names=["a", "b"]).set_uncertainty({"a": u[0], "b": u[1]}, component="random").set_correlation({("b", "a"): r})
    env = {"sin": np.sin, "exp": np.exp, "sqrt": np.sqrt, "atan2": np.arctan2, "log": np.log, "log10": np.log10, "acos": np.arccos, "abs": np.abs, "tan": np.tan, "asin": np.arcsin, "atan": np.arctan}
    f = lambda a, b: eval(text, {**env, "a": a, "b": b})  # noqa: S307, E731
    d = np.array([(f(point[0] + 1e-6, point[1]) - f(point[0] - 1e-6, point[1])) / 2e-6, (f(point[0], point[1] + 1e-6) - f(point[0], point[1] - 1e-6)) / 2e-6])
    want = math.sqrt(((d * u) ** 2).sum() + 2 * r * d[0] * d[1] * u[0] * u[1])
    row = g.compute(f"r = {text}").cells.first()
    close([row.r, row.u_rand__r], [f(*point), want], 1e-6)


def test_undefined_derivatives_are_refused(spark):
    g = gl.load(np.array([[0.0, -1.0]]), names=["a", "b"]).set_uncertainty({"a": 0.1, "b": 0.1})
    with pytest.raises(Exception, match="abs has no derivative"):
        g.compute("r = abs(a)").cells.collect()
    with pytest.raises(Exception, match="exponent"):
        g.compute("r = b ** a").cells.collect()
    with pytest.raises(er.EquationError):
        g.compute("r = np.floor(a)")
    with pytest.raises(er.EquationError):
        g.compute("r = a - np.mean(a)")


def test_compute_where_and_fill(spark):
    g = line(spark, [0, 1, 2], v=[1, -4, 9]).set_uncertainty({"v": 0.5})
    out = g.compute("r = sqrt(v)", where="v > 0")
    close(values(out, "r"), [1, NAN, 3])
    assert cells(out, "tag__r") == [1, 0, 1]
    close(cells(out, "u_sys__r"), [0.25, NAN, 0.5 / 6])
    kept = g.compute("v = 10*v", where="0 < v and not v >= 9", fill=None)
    close(values(kept), [10, -4, 9])
    close(cells(kept, "u_sys__v"), [5, 0.5, 0.5])
    close(values(g.compute("r = v", where="v != 1", fill=7), "r"), [7, -4, 9])
    with pytest.raises(er.VariableError):
        g.compute("r = v", where="x > 1")
    with pytest.raises(er.UncertaintyError):
        g.compute("r = v", method="mcm")
    close(values(g.compute("r = v", where="v > 1", fill=None), "r"), [NAN, NAN, 9])
    constant = g.compute("v = 7", where="v > 1", fill=None)
    close(constant.uncertainty.systematic["v"], [0.5, 0.5, NAN])


def test_constant_fills_missing_cells(spark):
    g = grid(spark, ("a", "b", "v"), [[0, 0, 1], [1, 1, 2]], ("a", "b")).compute("c = 3")
    close(values(g, "c"), [[3, 3], [3, 3]])
    close(values(g.compute("m = np.mean(v)"), "m"), np.full((2, 2), NAN))
    close(values(g.compute("m = np.nanmean(v)"), "m"), np.full((2, 2), 1.5))


def test_assignments_and_correlations(spark, table):
    g = table.set_uncertainty({"CT": "5%"})
    close(cells(g, "u_sys__CT")[0], 0.005)
    for bad in (-1, "x", "-5%", NAN, math.inf):
        with pytest.raises(er.UncertaintyError):
            table.set_uncertainty({"CT": bad})
    three = gl.load(np.ones((1, 3)), names=["a", "b", "c"])
    with pytest.raises(er.CorrelationError):
        three.set_correlation({("a", "b"): -0.9, ("b", "c"): -0.9, ("a", "c"): -0.9})
    ok = three.set_correlation({("b", "a"): 0.5})
    assert ok.correlation == {("a", "b"): 0.5} and not ok.drop_correlation(["a"]).correlation
    for bad in ({("a", "a"): 1}, {("a", "b"): 2}, {("a", "b"): 0.4}):
        with pytest.raises(er.CorrelationError):
            ok.set_correlation(bad)
    named = table.set_metadata({"CT": {"unit": "N", "long_name": "thrust"}, "alpha": {"unit": "deg"}})
    assert named.vars["CT"].unit == "N" and named.dim("alpha").unit == "deg"
    with pytest.raises(er.DataError):
        table.set_metadata({"alpha": {"long_name": "x"}})


@pytest.mark.parametrize("op", ["sum", "diff", "product", "ratio", "mean", "weighted_mean"])
def test_combine(spark, op):
    a, b, ua, ub, r = 3.0, 2.0, 0.1, 0.2, 0.3
    left = line(spark, [0, 1], v=[a, NAN]).set_uncertainty({"v": ua})
    right = line(spark, [0, 1], v=[b, 1]).set_uncertainty({"v": ub})
    weights = (1, 3) if op == "weighted_mean" else None
    out = left.combine(right, op=op, cross_correlation=r, weights=weights)
    value, pa, pb = {
        "sum": (a + b, 1, 1), "diff": (a - b, 1, -1), "product": (a * b, b, a), "ratio": (a / b, 1 / b, -a / b**2), "mean": ((a + b) / 2, 0.5, 0.5), "weighted_mean": ((a + 3 * b) / 4, 0.25, 0.75),
    }[op]
    close(values(out), [value, NAN])
    close(cells(out, "u_sys__v")[0], math.sqrt((pa * ua) ** 2 + (pb * ub) ** 2 + 2 * r * pa * pb * ua * ub))


def test_combine_refuses(spark, table):
    with pytest.raises(er.CombineError):
        table.combine(table.select({"alpha >": 1}), op="sum")
    for kwargs in ({"op": "max"}, {"op": "sum", "weights": (1, 1)}, {"op": "weighted_mean"}, {"op": "sum", "cross_correlation": 2}):
        with pytest.raises(er.CombineError):
            table.combine(table, **kwargs)
    g = grid(spark, ("a", "b", "v"), [[0, 0, 1], [1, 1, 2]], ("a", "b"))
    h = grid(spark, ("a", "b", "v"), [[0, 0, 5], [1, 0, 3], [0, 1, 4], [1, 1, NAN]], ("a", "b"))
    close(values(g.combine(h, op="sum")), [[6, NAN], [NAN, NAN]])


# ------------------------------------------------------------------ geometry


NAMES = ("alpha", "FX", "FY", "FZ", "MX", "MY", "MZ")


def body(spark, *row, unit="deg"):
    return grid(spark, NAMES, [row], ("alpha",)).set_metadata({"alpha": {"unit": unit}})


def test_rotation_sanity(spark):
    row = body(spark, 90, 1, 0, 0, 0, 2, 0).rotate("stability").cells.first()
    close([row.FX, row.FY, row.FZ, row.MX, row.MY, row.MZ], [0, 0, -1, 0, 2, 0], 1e-12)
    with pytest.raises(er.AxisError):
        grid(spark, NAMES, [(0, 1, 0, 0, 0, 0, 0)], ("alpha",)).rotate("stability")
    with pytest.raises(er.AxisError):
        body(spark, 0, 1, 0, 0, 0, 0, 0).rotate("nowhere")


def test_rotate_there_and_back(spark):
    g = grid(spark, ("alpha", "beta", "FX", "FY", "FZ"), [[12, 7, 1, 2, 3], [-4, 3, 4, 5, 6]], ("alpha", "beta")).set_metadata({"alpha": {"unit": "deg"}, "beta": {"unit": "deg"}})
    turned = g.rotate("wind")
    back = turned.rotate("body")
    close(values(back, "FY"), values(g, "FY"))
    length = turned.compute("n = sqrt(FX**2 + FY**2 + FZ**2)")
    close(np.nansum(values(length, "n")), math.sqrt(14) + math.sqrt(77))
    assert turned.axes.group_axis("force") == "wind" and turned.axes.vector_groups["force"] == ("FX", "FY", "FZ")
    close(values(turned.rotate("wind"), "FX"), values(turned, "FX"))
    a, b = math.radians(12), math.radians(7)
    y = np.array([[math.cos(a), 0, math.sin(a)], [0, 1, 0], [-math.sin(a), 0, math.cos(a)]])
    z = np.array([[math.cos(b), math.sin(b), 0], [-math.sin(b), math.cos(b), 0], [0, 0, 1]])
    row = turned.cells.where("alpha = 12").first()
    close([row.FX, row.FY, row.FZ], z @ y @ [1, 2, 3])


def test_rotate_uncertainty(spark):
    c, s = math.cos(0.3), math.sin(0.3)
    axis = gl.Axis("tilted", rotation_matrix=((c, s, 0), (-s, c, 0), (0, 0, 1)))
    g = body(spark, 0, 1, 2, 3, 0, 0, 0).register_axis(axis).declare_vector("force", ("FX", "FY", "FZ")).set_uncertainty({"FX": 0.1, "FY": 0.2})
    out = g.rotate("tilted", vector_groups=["force"])
    m = np.array(axis.rotation_matrix)
    cov = m @ np.diag([0.01, 0.04, 0]) @ m.T
    row = out.cells.first()
    close([row.u_sys__FX, row.u_sys__FY, row.u_sys__FZ], np.sqrt(np.diag(cov)))
    close(out.correlation["FX", "FY"], cov[0, 1] / math.sqrt(cov[0, 0] * cov[1, 1]))
    back = out.rotate("body", vector_groups=["force"])
    close([back.cells.first().u_sys__FX, back.cells.first().u_sys__FY], [0.1, 0.2], 1e-7)
    assert not back.correlation or abs(next(iter(back.correlation.values()))) < 1e-9
    for bad in ({"rotation_matrix": np.eye(3) * 2}, {"rotation_matrix": np.diag([1, 1, -1])}, {}, {"angles_from": ("a",), "convention": "wind"}):
        with pytest.raises(er.AxisError):
            gl.Axis("bad", **bad)


def test_rotate_angle_uncertainty(spark):
    g = gl.load(np.array([[10.0, 1, 0, 0]]), names=["alpha", "FX", "FY", "FZ"]).set_metadata({"alpha": {"unit": "deg"}}).set_uncertainty({"alpha": 1.0})
    row = g.rotate("stability").cells.first()
    a, u = math.radians(10), math.radians(1)
    close([row.u_sys__FX, row.u_sys__FY, row.u_sys__FZ], [math.sin(a) * u, 0, math.cos(a) * u], 1e-9)


def test_moments(spark):
    g = body(spark, 0, 1, 2, 3, 10, 20, 30)
    r = np.array([0.5, 0, 0]) - np.array([1, 2, 3])
    moved = g.translate_moments(to_point=(1, 2, 3), from_point=(0.5, 0, 0))
    assert "axis='body'" in moved.history.last.operation
    row = moved.cells.first()
    close([row.MX, row.MY, row.MZ], np.array([10, 20, 30]) + np.cross(r, [1, 2, 3]))
    u = g.set_uncertainty({"FZ": 0.1, "MY": 0.2}).translate_moments(to_point=(1, 0, 0))
    close(u.cells.first().u_sys__MY, math.hypot(0.1, 0.2))
    with pytest.raises(er.UncertaintyLineageError):
        u.translate_moments(to_point=(2, 0, 0))
    with pytest.raises(er.AxisError):
        g.translate_moments(to_point=(1, 0))


def test_views(spark, table):
    g = table.set_uncertainty({"CT": 0.3}).set_uncertainty({"CT": 0.4}, component="random").interpolate({"alpha": [1, 2]})
    assert list(g.dims) == ["mach", "alpha"] and g.dims["alpha"].coords == (1.0, 2.0) and g.dims["alpha"].is_numeric
    close(g.vars["CT"].values, [[0.11, 0.12], [0.21, 0.22]])
    assert g.tags.tags["CT"].tolist() == [[1, 0], [1, 0]] and table.tags is None and table.uncertainty is None
    close(g.uncertainty.combined("CT")[0, 1], 0.5)
    assert g.history.last.operation.startswith("interpolate(") and table.select({"CT >": 0.11}).history.last.operation.endswith("[masked=1]")
    pair = table.compute("q = CT").set_correlation({("q", "CT"): 0.5})
    assert pair.correlation.get("q", "CT") == 0.5 and ("CT", "q") in pair.correlation.pairs
    skip = line(spark, [0, 1, 2], v=[1, NAN, 1]).integrate("v", over="x", skipna=True)
    assert "populated=2/3" in skip.history.last.operation and "skipna=True" in skip.history.last.operation


def test_debug_report(table, capsys):
    table.set_uncertainty({"CT": 0.1}).compute("f = CT * 2", debug=True)
    out = capsys.readouterr().out
    assert "compute debug" in out and "tokens" in out and "partial by CT = 2.0" in out
