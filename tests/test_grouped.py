import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonwin.operators import grouped as g
from seasonwin.operators import models as m

LEVELS = 50


@pytest.fixture(scope="module")
def data(spark):
    """Level 0 holds a third of the rows."""
    rng = np.random.default_rng(7)
    n = 1500
    level = np.where(rng.uniform(size=n) < 1 / 3, 0, rng.integers(1, LEVELS, n))
    x, z = rng.uniform(0, 10, n), rng.normal(size=n)
    shift, slope = rng.normal(scale=0.5, size=LEVELS), rng.normal(scale=0.3, size=LEVELS)
    eta = 0.5 + np.sin(x / 2) + shift[level] + slope[level] * np.cos(x / 1.6) + 0.2 * z
    rows = [(int(i), float(x[i]), float(z[i]), f"g{level[i]:02d}", float(eta[i] + rng.normal(scale=0.3)), int(rng.poisson(np.exp(eta[i]))), 7) for i in range(n)]
    return spark.createDataFrame(rows, "i int, x double, z double, g string, y double, c int, level int").repartition(7).cache()


def dense(df, model, y):
    """The whole design matrix with a column per level and block element, and the matching penalty but for its parameters."""
    rows = df.orderBy("i").select(model.shared.row().alias("x"), model.block_row().alias("z"), "g", F.col(y).cast("double")).collect()
    names = sorted({r["g"] for r in rows})
    p, k = len(rows[0]["x"]), len(rows[0]["z"])
    design = np.zeros((len(rows), p + k * len(names)))
    for i, r in enumerate(rows):
        design[i, :p] = r["x"]
        at = p + k * names.index(r["g"])
        design[i, at:at + k] = r["z"]
    return design, np.array([r[3] for r in rows]), names, p, k


def penalty(model, p, k, levels, border, own):
    out = np.zeros((p + k * levels,) * 2)
    j = 0
    for t in model.shared.terms:
        a, b = model.shared.slices[t.name]
        for small in t.penalties():
            out[a:b, a:b] += border[j] * small
            j += 1
    for level in range(levels):
        for lam, at, t in zip(own, g._slots(model.block_terms), model.block_terms):
            a = p + k * level
            out[a + at.start:a + at.stop, a + at.start:a + at.stop] += lam * g._penalty(t)
    return out


TERMS = [m.Smooth("x", 6), m.Linear("z"), m.RandomIntercept("g"), m.BySmooth(m.Smooth("x", 5), "g", shared=True)]


def test_gaussian_fit_equals_a_dense_solve(data):
    model = g.fit_grouped(data, "y", TERMS, "g", lambdas=[0.7, 3.0, 2.0])
    design, y, names, p, k = dense(data, model, "y")
    pen = penalty(model, p, k, len(names), [0.7], [3.0, 2.0])
    a = design.T @ design + pen
    a[1:p, 1:p] += 1e-8 * np.diag(np.diag(a[1:p, 1:p] - pen[1:p, 1:p]))
    inverse = np.linalg.inv(a)
    theta = inverse @ design.T @ y
    assert model.levels == len(names) == LEVELS
    blocks = {r["level"]: r for r in model.blocks.collect()}
    for j, name in enumerate(names):
        assert blocks[name]["coef"] == pytest.approx(theta[p + k * j:p + k * (j + 1)], abs=1e-7)
    fit = design @ theta
    edf = np.trace(inverse @ design.T @ design)
    scale = ((y - fit) ** 2).sum() / (len(y) - edf)
    assert model.shared.deviance == pytest.approx(((y - fit) ** 2).sum(), rel=1e-6)
    assert model.shared.total_edf == pytest.approx(edf, rel=1e-6) and model.shared.scale == pytest.approx(scale, rel=1e-6)
    got = {r["i"]: r for r in g.score_grouped(data, model, se=True).collect()}
    se = np.sqrt(np.einsum("ij,jk,ik->i", design, inverse, design) * scale)
    for i in range(0, 1500, 41):
        assert got[i]["fit"] == pytest.approx(fit[i], abs=1e-6) and got[i]["se"] == pytest.approx(se[i], rel=1e-5)
        assert got[i]["level"] == 7
    table = {(r["g"], r["term"], r["i"]): r for r in g.group_coefficients(model).collect()}
    assert len(table) == LEVELS * 6
    assert table["g03", "re(g)", 0]["se"] == pytest.approx(np.sqrt(inverse[p + 3 * k, p + 3 * k] * scale), rel=1e-6)


def test_poisson_fit_equals_a_dense_solve(data):
    model = g.fit_grouped(data, "c", TERMS, "g", m.POISSON, lambdas=[0.7, 3.0, 2.0])
    design, y, names, p, k = dense(data, model, "c")
    pen = penalty(model, p, k, len(names), [0.7], [3.0, 2.0]) + 1e-9 * np.eye(design.shape[1])
    theta = np.zeros(design.shape[1])
    mu = y + 0.5
    eta = np.log(mu)
    for _ in range(30):
        theta = np.linalg.solve((design * mu[:, None]).T @ design + pen, design.T @ (mu * eta + y - mu))
        eta = design @ theta
        mu = np.exp(eta)
    assert model.shared.converged
    got = {r["i"]: r["fit"] for r in g.score_grouped(data, model).collect()}
    assert [got[i] for i in range(0, 1500, 29)] == pytest.approx(list(mu[::29]), rel=1e-4)
    short = g.fit_grouped(data, "c", TERMS, "g", m.POISSON, lambdas=[0.7, 3.0, 2.0], max_iter=2)
    assert not short.shared.converged


def test_chosen_parameters_maximise_restricted_likelihood(data):
    model = g.fit_grouped(data, "y", [m.Linear("z"), m.RandomIntercept("g")], "g")
    design, y, names, p, _ = dense(data, model, "y")
    free = len(y) - p

    def criterion(lam):
        pen = np.diag([0.0] * p + [lam] * len(names))
        a = design.T @ design + pen
        theta = np.linalg.solve(a, design.T @ y)
        loss = ((y - design @ theta) ** 2).sum() + theta @ pen @ theta
        return -0.5 * (free * np.log(loss / free) + np.linalg.slogdet(a)[1] - len(names) * np.log(lam))

    grid = np.logspace(-3, 3, 600)
    best = grid[np.argmax([criterion(v) for v in grid])]
    lam = model.blocks.first()["lam"][0]
    assert np.log(lam / best) == pytest.approx(0.0, abs=0.1) and model.shared.converged


def test_each_level_may_choose_its_own(spark):
    """A straight line and a wave: the first is smoothed more."""
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 10, 600)
    rows = [(float(v), "line" if i % 2 else "wave", float((0.2 * v if i % 2 else np.sin(2 * v)) + rng.normal(scale=0.1))) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "x double, g string, y double")
    model = g.fit_grouped(df, "y", [m.BySmooth(m.Smooth("x", 12), "g")], "g")
    lam = {r["level"]: r["lam"][0] for r in model.blocks.collect()}
    assert lam["line"] > 20 * lam["wave"]
    fit = g.score_grouped(df, model).agg(F.corr("fit", "y")).first()[0]
    assert fit > 0.98


def test_a_hundred_thousand_levels(spark):
    n, levels = 400_000, 100_000
    df = spark.range(n).select(
        (F.col("id") % levels).alias("g"), (F.rand(3) * 4).alias("x"), F.randn(5).alias("e")
    ).withColumn("y", F.sin("x") + (F.col("g") % 7 - 3) * 0.4 + F.col("e") * 0.2)
    model = g.fit_grouped(g.pin(df, "many"), "y", [m.Smooth("x", 6), m.RandomIntercept("g")], "g", lambdas=[0.1, 0.5])
    assert model.levels == levels and model.blocks.count() == levels
    row = model.blocks.select(F.corr(F.get("coef", F.lit(0)), F.col("level") % 7)).first()
    assert row[0] > 0.95
    assert 60_000 < model.shared.total_edf < 100_000


def test_missing_values_and_unknown_levels(spark, data):
    model = g.fit_grouped(data, "y", TERMS, "g", lambdas=[0.7, 3.0, 2.0])
    rows = spark.createDataFrame([(1.0, 0.0, "new"), (None, 0.0, "g01"), (1.0, None, "g01"), (1.0, 0.0, None)], "x double, z double, g string")
    got = g.score_grouped(rows, model, se=True).collect()
    by = {(r["x"], r["z"], r["g"]): r for r in got}
    assert by[1.0, 0.0, "new"]["fit"] is not None and by[1.0, 0.0, "new"]["se"] > 0
    assert by[None, 0.0, "g01"]["fit"] is None and by[1.0, 0.0, None]["fit"] is None and by[1.0, None, "g01"]["se"] is None
    with pytest.raises(ValueError, match="no row"):
        g.fit_grouped(data.where("x > 100"), "y", TERMS, "g")
    with pytest.raises(ValueError, match="no term"):
        g.fit_grouped(data, "y", [m.Linear("z")], "g")
