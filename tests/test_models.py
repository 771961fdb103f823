import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from seasonwin.functions import basis as B
from seasonwin.functions.tails import chi_squared_tail, f_tail
from seasonwin.operators import models as m


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 400
    x, z = rng.uniform(0, 10, n), rng.normal(size=n)
    g = rng.integers(0, 4, n)
    eta = 0.6 + 0.8 * np.sin(x / 2) + 0.2 * g
    rows = [
        (int(i), float(x[i]), float(z[i]), f"g{g[i]}", float(np.sin(x[i]) + 0.5 * z[i] + rng.normal(scale=0.2)),
         int(rng.poisson(np.exp(eta[i]))))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "i int, x double, z double, g string, y double, c int").repartition(5).cache()


def design(df, model):
    rows = df.orderBy("i").select(model.row().alias("x"), model.y).collect()
    return np.array([r[0] for r in rows]), np.array([float(r[1]) for r in rows])


def test_bases_sum_to_one_and_wrap(spark):
    df = spark.range(0, 101).select((F.col("id") / 10).alias("x"))
    rows = df.select(B.spline_basis("x", 0.0, 10.0, 7).alias("s"), B.cyclic_basis("x", 0.0, 5.0, 6).alias("c"),
                     B.cyclic_basis(F.col("x") - 5, 0.0, 5.0, 6).alias("w")).collect()
    for r in rows:
        assert sum(r["s"]) == pytest.approx(1.0) and sum(r["c"]) == pytest.approx(1.0)
        assert r["c"] == pytest.approx(r["w"])


def test_natural_spline_interpolates_and_is_penalised_by_its_curvature(spark):
    knots = [0.0, 1.0, 2.5, 3.0, 6.0]
    second, penalty = B.natural_curvature(knots)
    grid = [i / 1000 for i in range(6001)]
    df = spark.createDataFrame([(v,) for v in [*knots, -1.0, 7.0, None, *grid]], "x double")
    rows = [r[0] for r in df.select(B.natural_basis("x", knots)).collect()]
    assert np.allclose(rows[:5], np.eye(5)) and np.allclose(rows[5:7], [np.eye(5)[0], np.eye(5)[4]]) and rows[7] is None
    values = np.array([0.3, -1.0, 2.0, 0.5, 1.0])
    curve = np.array(rows[8:]) @ values
    bend = np.diff(curve, 2) / 1e-6
    assert (bend ** 2).sum() * 1e-3 == pytest.approx(values @ penalty @ values, rel=5e-3)
    assert abs(bend[0]) < 0.05 and abs(bend[-1]) < 0.05 and np.abs(np.diff(bend)).max() < 0.1
    assert bend[999] == pytest.approx((second @ values)[1], abs=0.05)


def test_natural_term_at_quantiles_finds_the_curve_and_shrinks(data):
    model = m.fit_additive(data, "y", [m.Natural("x", 9), m.Linear("z")])
    assert len(model.terms[0].knots) == 9 and model.converged
    low = data.agg(F.expr("percentile(x, array(0.25, 0.5))")).first()[0]
    assert model.terms[0].knots[2] == pytest.approx(low[0], abs=0.1) and model.terms[0].knots[4] == pytest.approx(low[1], abs=0.1)
    effect = m.partial_effect(data, model, "s(x)", 30).collect()
    assert np.corrcoef([r["effect"] for r in effect], np.sin([r["x"] for r in effect]))[0, 1] > 0.97
    noise = m.fit_additive(data.withColumn("u", F.rand(5)), "z", [m.Natural("u", 9)])
    a, b = noise.slices["s(u)"]
    assert noise.edf[a:b].sum() < 1.5


def test_gaussian_fit_equals_a_dense_solve(data):
    terms = [m.Smooth("x", 8), m.Linear("z"), m.RandomIntercept("g")]
    model = m.fit_additive(data, "y", terms, lambdas=[0.3, 0.7])
    x, y = design(data, model)
    xtx, at, penalty = x.T @ x, 1, np.zeros((x.shape[1],) * 2)
    lams = iter([0.3, 0.7])
    for t in model.terms:
        for small in t.penalties():
            full = np.zeros_like(penalty)
            full[at:at + t.size, at:at + t.size] = small
            size = np.trace(xtx * (np.abs(full).sum(0) > 0)) / np.trace(full)
            penalty += next(lams) * size * full
        at += t.size
    ridge = 1e-8 * np.diag(xtx)
    a = xtx + penalty + np.diag([0.0, *ridge[1:]])
    beta = np.linalg.solve(a, x.T @ y)
    assert x @ model.beta == pytest.approx(x @ beta, abs=1e-6)
    assert model.edf.sum() == pytest.approx(np.trace(np.linalg.solve(a, xtx)), rel=1e-6)
    assert model.deviance == pytest.approx(((y - x @ beta) ** 2).sum())


def test_chosen_smoothing_maximises_restricted_likelihood(data):
    model = m.fit_additive(data, "y", [m.Smooth("x", 8)])
    x, y = design(data, model)
    (pen,) = model.terms[0].penalties()
    full = np.zeros((9, 9))
    full[1:, 1:] = pen * np.trace((x.T @ x)[1:, 1:]) / np.trace(pen)
    ridge = np.diag([0.0, *1e-8 * np.diag(x.T @ x)[1:]])

    def criterion(lam):
        a = x.T @ x + lam * full + ridge
        beta = np.linalg.solve(a, x.T @ y)
        free = len(y) - 3
        loss = ((y - x @ beta) ** 2).sum() + lam * beta @ full @ beta
        return -0.5 * (free * np.log(loss / free) + np.linalg.slogdet(a)[1] - 6 * np.log(lam))

    grid = np.logspace(-6, 3, 400)
    best = grid[np.argmax([criterion(v) for v in grid])]
    assert np.log(model.lambdas[0] / best) == pytest.approx(0.0, abs=0.2)


def test_chosen_smoothing_finds_the_curve(data):
    model = m.fit_additive(data, "y", [m.Smooth("x", 10), m.Linear("z")])
    slope = {(r["term"], r["i"]): r["estimate"] for r in model.coefficients(data.sparkSession).collect()}
    assert slope["z", 0] == pytest.approx(0.5, abs=0.05)
    effect = m.partial_effect(data, model, "s(x)", 30).collect()
    want = np.sin([r["x"] for r in effect])
    assert np.corrcoef([r["effect"] for r in effect], want)[0, 1] > 0.98
    assert all(r["LCI"] < r["effect"] < r["UCI"] for r in effect)
    summary = m.fit_summary(data, model).first()
    assert summary["deviance_explained"] > 0.9 and summary["adj_r2"] > 0.9


def test_poisson_without_penalty_equals_a_glm(data):
    model = m.fit_additive(data, "c", [m.Linear("x"), m.Linear("z")], m.POISSON)
    vectors = VectorAssembler(inputCols=["x", "z"], outputCol="f").transform(data)
    glm = GeneralizedLinearRegression(family="poisson", link="log", labelCol="c", featuresCol="f", tol=1e-10).fit(vectors)
    assert model.beta[1:] == pytest.approx(list(glm.coefficients), abs=1e-5)
    assert model.deviance == pytest.approx(glm.summary.deviance, rel=1e-6)
    assert model.aic == pytest.approx(glm.summary.aic, rel=1e-4)
    assert model.null_deviance == pytest.approx(glm.summary.nullDeviance, rel=1e-8)


def test_quasi_poisson_scales_errors(data):
    terms = [m.Smooth("x", 6)]
    plain = m.fit_additive(data, "c", terms, m.POISSON, lambdas=[0.1])
    quasi = m.fit_additive(data, "c", terms, m.QUASIPOISSON, lambdas=[0.1])
    assert quasi.cov == pytest.approx(plain.cov * quasi.scale) and quasi.aic is None
    got = m.score(data, plain).agg(F.sum("fit"), F.sum("c")).first()
    assert got[0] == pytest.approx(got[1], rel=1e-4)


def test_group_curves_and_interaction(data):
    curve = m.Smooth("x", 6, cyclic=True, low=0, high=10)
    for terms in ([curve, m.BySmooth(curve, "g")], [curve, m.BySmooth(curve, "g", shared=True)],
                  [m.Smooth("x", 5), m.Smooth("z", 5), m.Tensor(m.Smooth("x", 4), m.Smooth("z", 4))]):
        model = m.fit_additive(data, "c", terms, m.POISSON)
        assert 0 < model.deviance < model.null_deviance
        assert 1 < model.edf.sum() < len(model.beta)
    surface = m.effect_surface(data, model, "x", "z", 12)
    assert 0 < surface.count() < 144
    names = {"flat": m.fit_additive(data, "c", [], m.POISSON), "full": model}
    order = [r["model"] for r in m.compare_models(data.sparkSession, names).collect()]
    assert order == ["full", "flat"]


def test_largest_penalties_leave_a_positive_inverse():
    """A centred basis has no data along its constant; a penalty of 1e8 swallows the ridge there."""
    rng = np.random.default_rng(6)
    k, n = 6, 300
    b = rng.uniform(0.1, 1.0, (n, k))
    b /= b.sum(axis=1)[:, None]
    x = np.hstack([np.ones((n, 1)), b - b.mean(axis=0)])
    y = b @ np.arange(k) + rng.normal(scale=0.1, size=n)
    pen = np.zeros((k + 1, k + 1))
    pen[1:, 1:] = n * np.diff(np.eye(k), 2, axis=0).T @ np.diff(np.eye(k), 2, axis=0)
    s = m.Sums(x.T @ x, x.T @ y, y @ y, n, 0.0, 0.0, y.sum(), 0.0)
    for lam in (1e-8, 1.0, 1e4, 1e8):
        beta, inverse, hat = m._solve(s, [pen], [lam])
        # The same fit without the constant: the last coefficient is minus the sum of the others.
        z = np.vstack([np.eye(k), np.r_[0.0, -np.ones(k - 1)][None, :]])
        free = np.linalg.inv(z.T @ (s.xwx + lam * pen) @ z)
        assert x @ beta == pytest.approx(x @ z @ free @ z.T @ s.xwz, abs=1e-4)
        assert np.linalg.eigvalsh(inverse)[0] >= -1e-12 * np.abs(inverse).max()
        assert np.trace(hat) == pytest.approx(np.trace(free @ z.T @ s.xwx @ z), abs=1e-4)


def test_scores_and_residuals(data):
    model = m.fit_additive(data, "c", [m.Smooth("x", 6)], m.POISSON, lambdas=[0.1])
    x, _ = design(data, model)
    got = {r["i"]: r for r in m.score(data, model, se=True).collect()}
    plain = {r["i"]: r["fit"] for r in m.score(data, model).collect()}
    for i in range(0, 400, 37):
        fit = np.exp(x[i] @ model.beta)
        assert got[i]["fit"] == pytest.approx(fit) and plain[i] == pytest.approx(fit)
        assert got[i]["se"] == pytest.approx(fit * np.sqrt(x[i] @ model.cov @ x[i]))
    gap = data.limit(1).withColumn("x", F.lit(None).cast("double"))
    assert m.score(gap, model).first()["fit"] is None and m.score(gap, model, se=True).first()["se"] is None
    resid = m.residuals(data, model).agg(F.sum(F.col("resid") * F.col("resid"))).first()[0]
    assert resid == pytest.approx(model.deviance, rel=1e-9)
    check = m.residual_check(data, model, ["g"], ["i"]).collect()
    assert sum(r["n"] for r in check) == 400 and len(check) == 10
    partial = m.partial_residuals(data, model, "s(x)").first()
    assert partial["partial"] == pytest.approx(partial["effect"] + partial["c"] / partial["fit"] - 1)


def test_too_many_levels_are_refused(spark):
    df = spark.range(2000).select(F.col("id").alias("g"), F.rand(1).alias("y"))
    with pytest.raises(ValueError, match="levels"):
        m.fit_additive(df, "y", [m.RandomIntercept("g")])


def test_tails_equal_closed_forms():
    assert chi_squared_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    for x in (0.1, 1.0, 7.0, 90.0):
        assert chi_squared_tail(x, 2) == pytest.approx(np.exp(-x / 2), rel=1e-10)
        assert chi_squared_tail(x, 4) == pytest.approx(np.exp(-x / 2) * (1 + x / 2), rel=1e-10)
        assert f_tail(x, 2, 30) == pytest.approx((1 + x / 15) ** -15, rel=1e-9)
        assert f_tail(x, 1, 1) == pytest.approx(1 - 2 / np.pi * np.arctan(np.sqrt(x)), abs=1e-10)
        assert f_tail(x, 7, 3) == pytest.approx(1 - f_tail(1 / x, 3, 7), abs=1e-12)
    assert chi_squared_tail(0.0, 3) == f_tail(0.0, 2, 3) == 1.0


def test_terms_and_nested_models_are_tested(data):
    flat = m.fit_additive(data, "c", [], m.POISSON)
    wave = m.fit_additive(data, "c", [m.Smooth("x", 6)], m.POISSON)
    noise = m.fit_additive(data.withColumn("u", F.rand(3)), "c", [m.Smooth("x", 6), m.Linear("u")], m.POISSON)
    rows = m.nested_tests(data.sparkSession, [("flat", flat), ("wave", wave), ("noise", noise)]).collect()
    assert rows[0]["p"] is None and rows[1]["p"] < 1e-6 and rows[2]["p"] > 0.01
    assert rows[1]["difference"] == pytest.approx(flat.deviance - wave.deviance) and rows[2]["df"] == pytest.approx(1.0, abs=0.3)
    terms = {r["term"]: r["p"] for r in noise.term_table(data.sparkSession).collect()}
    assert terms["s(x)"] < 1e-6 and terms["u"] > 0.01
    with pytest.raises(ValueError, match="rows"):
        m.nested_tests(data.sparkSession, [("flat", flat), ("less", m.fit_additive(data.limit(300), "c", [], m.POISSON))])


def test_line_and_peak(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 7.0), ("b", 1.0, 1.0)], "k string, x double, y double")
    fits = {r["k"]: r for r in m.fit_linear(df, "y", "x", ["k"]).collect()}
    assert fits["a"]["slope"] == pytest.approx(2.5) and fits["b"]["slope"] is None
    pred = spark.createDataFrame([(1, d, f) for d, f in [(10, 1.0), (11, 5.0), (12, 5.0), (13, 89.0), (14, 0.0)]],
                                 "y int, d int, f double")
    got = m.phenology_peak(pred, ["y"], "d", "f").first()
    assert (got["peak"], got["lower"], got["upper"]) == (13, 11, 13)
