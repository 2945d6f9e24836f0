"""Models against direct numpy likelihoods, and curves against hand-computed answers."""

import itertools
import math
import time

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from claimweave.operators import cox as cx, survival
from claimweave.operators.fits import ratio_table
from claimweave.operators.regression import logistic, poisson_gee, predict_probability


def survival_data(seed=0, n=120, horizon=12):
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {
            "t": rng.integers(1, horizon, n).astype(float),
            "e": rng.integers(0, 2, n),
            "a": rng.integers(0, 2, n),
            "b": rng.normal(size=n).round(2),
            "s": rng.integers(0, 3, n),
            "w": rng.uniform(0.3, 2.5, n).round(2),
        }
    )


def efron(df, xs, beta, strata=None, weight=None, ties="efron"):
    """Log-likelihood, gradient, information and per-row score residuals, term by term."""
    p = len(xs)
    x_all, ll, u, info = df[xs].to_numpy(float), 0.0, np.zeros(p), np.zeros((p, p))
    w_all = df[weight].to_numpy() if weight else np.ones(len(df))
    resid = np.zeros((len(df), p))
    groups = df[strata].to_numpy() if strata else np.zeros(len(df))
    terms = []
    for g in np.unique(groups):
        idx = np.flatnonzero(groups == g)
        t, e, x, w = df["t"].to_numpy()[idx], df["e"].to_numpy()[idx], x_all[idx], w_all[idx]
        r = np.exp(x @ beta)
        for time in np.unique(t[e == 1]):
            dead, risk = (t == time) & (e == 1), t >= time
            d, wbar = dead.sum(), w[dead].mean()
            ll += (w[dead] * (x[dead] @ beta)).sum()
            u += (w[dead, None] * x[dead]).sum(0)
            block_v, block_u = np.zeros((p, p)), (w[dead, None] * x[dead]).sum(0)
            for step in range(d):
                frac = step / d if ties == "efron" else 0.0
                share = risk - frac * dead
                z = w * r * share
                s0, s1 = z.sum(), (z[:, None] * x).sum(0)
                s2 = (x * z[:, None]).T @ x
                mean = s1 / s0
                v = wbar * (s2 / s0 - np.outer(mean, mean))
                ll -= wbar * math.log(s0)
                u -= wbar * mean
                info += v
                block_v += v
                block_u = block_u - wbar * mean
                resid[idx[dead]] += (x[dead] - mean) / d
                resid[idx] -= (share * r * wbar / s0)[:, None] * (x - mean)
            terms.append((g, time, d, block_u, block_v))
    return ll, u, info, resid, terms


def newton(df, xs, **kw):
    beta = np.zeros(len(xs))
    for _ in range(25):
        _, u, info, _, _ = efron(df, xs, beta, **kw)
        beta = beta + np.linalg.solve(info, u)
    return beta


CASES = [
    {"xs": ["a", "b"]},
    {"xs": ["a", "b"], "ties": "breslow"},
    {"xs": ["a", "b"], "strata": "s"},
    {"xs": ["a", "b"], "weight": "w"},
    {"xs": ["b"], "strata": "s", "weight": "w"},
]


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("cut", [False, True])
def test_cox_matches_direct_likelihood(spark, monkeypatch, case, cut):
    if cut:  # force the bucketed running sums
        monkeypatch.setattr(cx, "_WHOLE", 3)
    df = survival_data()
    xs, strata, weight, ties = case["xs"], case.get("strata"), case.get("weight"), case.get("ties", "efron")
    fit = cx.cox(
        spark.createDataFrame(df).repartition(3), "t", "e", xs, [strata] if strata else [], weight, ties, robust=ties == "efron"
    )
    kw = {"strata": strata, "weight": weight, "ties": ties}
    beta = newton(df, xs, **kw)
    ll, u, info, resid, _ = efron(df, xs, beta, **kw)
    ll0, u0, info0, _, _ = efron(df, xs, np.zeros(len(xs)), **kw)
    assert fit.converged and np.allclose(fit.beta, beta, atol=1e-7)
    assert np.allclose(fit.var, np.linalg.inv(info), rtol=1e-6)
    assert fit.stats["lr_chisq"] == pytest.approx(2 * (ll - ll0), abs=1e-7)
    assert fit.stats["score_chisq"] == pytest.approx(u0 @ np.linalg.solve(info0, u0), rel=1e-7)
    if ties == "efron":
        w = df[weight].to_numpy() if weight else np.ones(len(df))
        assert np.allclose((w[:, None] * resid).sum(0), u, atol=1e-8)
        part = (w[:, None] * resid) @ np.linalg.inv(info)
        assert np.allclose(fit.robust, part.T @ part, rtol=1e-6)


def test_cox_with_very_many_ties(spark):
    """More tied events than are summed term by term."""
    df = survival_data(5, 900, 4)
    fit = cx.cox(spark.createDataFrame(df), "t", "e", ["a", "b"], weight="w")
    beta = newton(df, ["a", "b"], weight="w")
    _, _, info, resid, _ = efron(df, ["a", "b"], beta, weight="w")
    part = (df["w"].to_numpy()[:, None] * resid) @ np.linalg.inv(info)
    assert np.allclose(fit.beta, beta, atol=1e-8)
    assert np.allclose(fit.var, np.linalg.inv(info), rtol=1e-8)
    assert np.allclose(fit.robust, part.T @ part, rtol=1e-7)


def test_cox_three_persons(spark):
    df = spark.createDataFrame([(1.0, 1, 1), (2.0, 1, 0), (3.0, 0, 1)], "t double, e int, x int")
    assert cx.cox(df, "t", "e", ["x"]).beta[0] == pytest.approx(-math.log(2) / 2, abs=1e-9)


@pytest.mark.parametrize("strata", [None, "s"])
def test_proportional_hazards_score_test(spark, strata):
    df = survival_data(2)
    xs = ["a", "b"]
    sdf = spark.createDataFrame(df)
    keys = [strata] if strata else []
    fit = cx.cox(sdf, "t", "e", xs, keys)
    got = {r.term: r.chisq for r in cx.ph_test(sdf, fit, "t", "e", keys).collect()}
    _, _, _, _, terms = efron(df, xs, fit.beta, strata=strata)
    surv, g = 1.0, {}
    for t in sorted(df.t.unique()):
        d, n = int(((df.t == t) & (df.e == 1)).sum()), int((df.t >= t).sum())
        g[t] = 1 - surv
        surv *= 1 - d / n
    centre = sum(g[t] * d for _, t, d, _, _ in terms) / sum(d for _, _, d, _, _ in terms)
    u = sum((g[t] - centre) * bu for _, t, _, bu, _ in terms)
    a = sum(v for *_, v in terms)
    b = sum((g[t] - centre) * v for _, t, _, _, v in terms)
    c = sum((g[t] - centre) ** 2 * v for _, t, _, _, v in terms)
    inner = c - b @ np.linalg.solve(a, b)
    for j, x in enumerate(xs):
        assert got[x] == pytest.approx(u[j] ** 2 / inner[j, j], rel=1e-5)
    assert got["GLOBAL"] == pytest.approx(u @ np.linalg.solve(inner, u), rel=1e-5)


def test_conditional_logistic_on_pairs_and_triples(spark):
    pairs = [(i, 1, 1) for i in range(12)] + [(i, 0, 0) for i in range(12)]
    pairs += [(20 + i, 1, 0) for i in range(4)] + [(20 + i, 0, 1) for i in range(4)]
    fit = cx.conditional_logistic(spark.createDataFrame(pairs, "g int, y int, x int"), "y", ["x"], "g")
    assert fit.beta[0] == pytest.approx(math.log(3), abs=1e-8) and fit.se()[0] == pytest.approx(0.57735, abs=1e-5)
    rng = np.random.default_rng(1)
    df = pd.DataFrame({"g": np.repeat(np.arange(40), 3), "y": [1, 0, 0] * 40, "x": rng.normal(size=120), "z": rng.integers(0, 2, 120)})
    fit = cx.conditional_logistic(spark.createDataFrame(df), "y", ["x", "z"], "g")
    assert np.allclose(fit.beta, newton(df.assign(t=1.0, e=df.y), ["x", "z"], strata="g"), atol=1e-7)


def choices_likelihood(df, xs, beta):
    """Log-likelihood, gradient and information by listing all choices of as many rows as a set has cases."""
    ll, u, info = 0.0, np.zeros(len(xs)), np.zeros((len(xs), len(xs)))
    for _, rows in df.groupby("g"):
        x, m = rows[xs].to_numpy(float), int(rows.y.sum())
        total = np.array([x[list(c)].sum(0) for c in itertools.combinations(range(len(rows)), m)])
        v = np.exp(total @ beta)
        mean = v @ total / v.sum()
        ll += x[rows.y.to_numpy() == 1].sum(0) @ beta - np.log(v.sum())
        u += x[rows.y.to_numpy() == 1].sum(0) - mean
        info += (total * v[:, None]).T @ total / v.sum() - np.outer(mean, mean)
    return ll, u, info


def test_conditional_logistic_with_several_cases(spark):
    """Sets of 2:3 and of other sizes, with repeated rows, without cases and of cases only."""
    rng = np.random.default_rng(12)
    rows = [(g, int(k < m), int(rng.integers(0, 2)), round(float(rng.normal(k < m)), 1)) for g in range(60) for n, m in [[(5, 2), (6, 3), (3, 1), (4, 0), (2, 2), (7, 5)][g % 6]] for k in range(n)]
    df = pd.DataFrame(rows, columns=["g", "y", "x", "z"])
    fit = cx.conditional_logistic(spark.createDataFrame(df).repartition(3), "y", ["x", "z"], "g")
    beta = np.zeros(2)
    for _ in range(20):
        _, u, info = choices_likelihood(df, ["x", "z"], beta)
        beta = beta + np.linalg.solve(info, u)
    ll, _, info = choices_likelihood(df, ["x", "z"], beta)
    assert fit.converged and np.allclose(fit.beta, beta, atol=1e-7) and np.allclose(fit.var, np.linalg.inv(info), rtol=1e-6)
    assert fit.stats["loglik"] == pytest.approx(ll, abs=1e-8) and fit.stats["n"] == len(df)
    # One large set with many cases of two kinds of rows.
    big = pd.DataFrame({"g": 1, "y": [1] * 300 + [0] * 700, "x": [1] * 200 + [0] * 100 + [1] * 250 + [0] * 450})
    fit = cx.conditional_logistic(spark.createDataFrame(big), "y", ["x"], "g")
    j = np.arange(0, 301)
    log = np.array([math.lgamma(451) - math.lgamma(a + 1) - math.lgamma(451 - a) + math.lgamma(551) - math.lgamma(301 - a) - math.lgamma(251 + a) for a in j])
    weight = np.exp(log + fit.beta[0] * j - (log + fit.beta[0] * j).max())
    assert weight @ j / weight.sum() == pytest.approx(200, abs=1e-5)


def test_terms_that_repeat_others_are_dropped(spark):
    df = survival_data(3)
    df["twice"], df["flat"], df["id"] = 2 * df.b, 1.0, np.arange(len(df)) // 3
    df["y"] = (df.e * (1 + df.a)).astype(int)
    frame = spark.createDataFrame(df)
    fits = {
        "cox": lambda xs: cx.cox(frame, "t", "e", xs, weight="w"),
        "logistic": lambda xs: logistic(frame, "e", xs, profile=True),
        "clogit": lambda xs: cx.conditional_logistic(frame, "e", xs, "id"),
        "gee": lambda xs: poisson_gee(frame, "y", xs, "id"),
    }
    for name, fit in fits.items():
        plain, both = fit(["a", "b"]), fit(["a", "b", "twice", "flat"])
        rows = {r.term: r for r in both.tidy().collect()}
        assert both.converged and both.dropped == ["twice", "flat"], name
        assert rows["twice"].estimate is None and rows["flat"].p_value is None
        for r in plain.tidy().collect():
            assert rows[r.term].estimate == pytest.approx(r.estimate, rel=1e-6) and rows[r.term].std_err == pytest.approx(r.std_err, rel=1e-6)
        ratios = {r.term: r for r in ratio_table(both, ci="profile" if name == "logistic" else "wald").collect()}
        assert ratios["twice"].ratio is None and ratios["b"].lower < ratios["b"].ratio < ratios["b"].upper
    test = {r.term: r for r in cx.ph_test(frame, fits["cox"](["a", "b", "twice"]), "t", "e", weight="w").collect()}
    assert test["twice"].chisq is None and test["GLOBAL"].df == 2


def test_robust_limits_of_weighted_curves(spark):
    """Influences by differences of the log curve in each person's weight."""
    df = survival_data(7, 60)

    def log_curve(w, at):
        return sum(np.log(1 - w[(df.t == t) & (df.e == 1)].sum() / w[df.t >= t].sum()) for t in sorted(df.t.unique()) if t <= at and ((df.t == t) & (df.e == 1)).any())

    w = df.w.to_numpy(float)
    for r in survival.kaplan_meier(spark.createDataFrame(df), "t", "e", weight="w", robust=True).collect():
        if r.lower is None:
            continue
        influence = []
        for i in range(len(df)):
            up, down = w.copy(), w.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            influence.append((log_curve(up, r.time) - log_curve(down, r.time)) / 2e-5)
        se = math.sqrt(sum((w * influence) ** 2))
        assert r.std_err == pytest.approx(r.surv * se, rel=1e-5, abs=1e-9) and r.lower == pytest.approx(r.surv * math.exp(-1.959964 * se), rel=1e-5)


def test_logistic_two_by_two_and_weights(spark):
    rows = [(1, 1, 30.0), (1, 0, 10.0), (0, 1, 20.0), (0, 0, 40.0)]
    for df, weight in (
        (spark.createDataFrame(rows, "x int, y int, n double"), "n"),
        (spark.createDataFrame([(x, y) for x, y, n in rows for _ in range(int(n))], "x int, y int"), None),
    ):
        fit = logistic(df, "y", ["x"], weight=weight)
        row = {r.term: r for r in ratio_table(fit).collect()}["x"]
        assert row.ratio == pytest.approx(6.0, rel=1e-8) and fit.se()[1] == pytest.approx(0.456435, abs=1e-6)
    scored = {r.x: r.p for r in predict_probability(df, fit, "p").collect()}
    assert scored[1] == pytest.approx(0.75, abs=1e-9) and scored[0] == pytest.approx(1 / 3, abs=1e-9)


def test_logistic_profile_limits(spark):
    rng = np.random.default_rng(3)
    n = 150
    df = pd.DataFrame({"x": rng.integers(0, 2, n), "z": rng.normal(size=n).round(1)})
    df["y"] = (rng.random(n) < 1 / (1 + np.exp(-(-1.2 + 0.8 * df.x + 0.5 * df.z)))).astype(int)
    fit = logistic(spark.createDataFrame(df), "y", ["x", "z"], profile=True)
    design = np.column_stack([np.ones(n), df.x, df.z])

    def loglik(b):
        eta = design @ b
        return float((df.y * eta - np.logaddexp(0, eta)).sum())

    for j, side in itertools.product(range(3), (0, 1)):
        fixed = fit.limits[j, side]
        others = [k for k in range(3) if k != j]
        b = fit.beta.copy()
        b[j] = fixed
        for _ in range(40):  # maximise over the other coefficients
            mu = 1 / (1 + np.exp(-design @ b))
            g = design.T @ (df.y - mu)
            h = (design * (mu * (1 - mu)).to_numpy()[:, None] if hasattr(mu, "to_numpy") else design * (mu * (1 - mu))[:, None]).T @ design
            b[others] += np.linalg.solve(h[np.ix_(others, others)], g[others])
        assert 2 * (loglik(fit.beta) - loglik(b)) == pytest.approx(3.841458820694124, abs=1e-5)
        assert (fixed < fit.beta[j]) == (side == 0)


def dense_gee(df, xs):
    x = np.column_stack([np.ones(len(df)), df[xs]])
    y, ids, p = df["y"].to_numpy(float), df["id"].to_numpy(), x.shape[1]
    off = df["o"].to_numpy() if "o" in df else np.zeros(len(df))
    beta, alpha = np.zeros(p), 0.0
    beta[0] = np.log(y.mean())
    for _ in range(60):
        mu = np.exp(x @ beta + off)
        e = (y - mu) / np.sqrt(mu)
        phi = (e**2).sum() / (len(y) - p)
        cross, pairs = 0.0, 0.0
        for g in np.unique(ids):
            r = e[ids == g]
            cross += (r.sum() ** 2 - (r**2).sum()) / 2
            pairs += len(r) * (len(r) - 1) / 2
        alpha = cross / (phi * (pairs - p))
        b, u, m = np.zeros((p, p)), np.zeros(p), np.zeros((p, p))
        for g in np.unique(ids):
            k = ids == g
            d = mu[k, None] * x[k]
            v = np.diag(np.sqrt(mu[k])) @ ((1 - alpha) * np.eye(k.sum()) + alpha) @ np.diag(np.sqrt(mu[k]))
            inv = np.linalg.inv(v)
            ui = d.T @ inv @ (y[k] - mu[k])
            b, u, m = b + d.T @ inv @ d, u + ui, m + np.outer(ui, ui)
        beta = beta + np.linalg.solve(b, u)
    bread = np.linalg.inv(b)
    return beta, bread @ m @ bread, phi * bread, alpha


@pytest.mark.parametrize("offset", [None, "o"])
def test_gee_matches_dense_matrices(spark, offset):
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 8, 40)
    ids = np.repeat(np.arange(40), sizes)
    n = len(ids)
    df = pd.DataFrame({"id": ids, "x": rng.integers(0, 2, n), "z": np.repeat(rng.normal(size=40).round(1), sizes)})
    df["y"] = rng.poisson(np.exp(-0.3 + 0.5 * df.x + 0.2 * df.z) * np.repeat(rng.gamma(3, 1 / 3, 40), sizes))
    if offset:
        df["o"] = np.log(rng.integers(20, 31, n) / 30)
    beta, robust, naive, alpha = dense_gee(df, ["x", "z"])
    fit = poisson_gee(spark.createDataFrame(df).repartition(3), "y", ["x", "z"], "id", offset)
    assert fit.converged and np.allclose(fit.beta, beta, atol=1e-7)
    assert np.allclose(fit.robust, robust, rtol=1e-5) and np.allclose(fit.var, naive, rtol=1e-5)
    assert fit.stats["alpha"] == pytest.approx(alpha, abs=1e-7)


def test_kaplan_meier_example(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (3.0, 1), (3.0, 1), (4.0, 0)], "t double, e int")
    km = survival.kaplan_meier(df, "t", "e")
    s = {r.time: r for r in km.collect()}
    assert s[1.0].surv == pytest.approx(0.8) and s[3.0].surv == pytest.approx(0.266667, abs=1e-6)
    assert s[3.0].std_err == pytest.approx(s[3.0].surv * math.sqrt(1 / 20 + 2 / 3), abs=1e-9)
    last = survival.kaplan_meier(df.filter("e = 1"), "t", "e").orderBy("time").collect()[-1]
    assert last.surv == 0.0 and last.lower is None
    short = {r.time: (r.n_risk, r.cum_event) for r in survival.life_table(km, [0, 2, 3.5, 9]).collect()}
    assert short == {0.0: (5, 0), 2.0: (4, 1), 3.5: (1, 3)}
    assert survival.life_table(km, [9], extend=True).first().n_risk == 0


def test_logrank_example(spark):
    df = spark.createDataFrame([("A", 1.0, 1), ("A", 2.0, 1), ("B", 3.0, 1), ("B", 4.0, 1)], "g string, t double, e int")
    a = survival.logrank(df, "t", "e", "g").filter("level = 'A'").first()
    assert (a.observed, round(a.expected, 6), round(a.variance, 6)) == (2, 0.833333, 0.472222)
    assert a.chisq == pytest.approx(2.882353, abs=1e-6) and a.p_value == pytest.approx(0.089555, abs=1e-6)


@pytest.mark.parametrize("strata, weight", [([], None), (["s"], None), ([], "w")])
def test_concordance_counts_all_pairs(spark, strata, weight):
    df = survival_data(8)
    df["score"] = (df.b * 4).round() / 4
    row = survival.concordance(spark.createDataFrame(df).repartition(3), "t", "e", "score", strata, weight).first()
    w = df[weight] if weight else pd.Series(1.0, index=df.index)
    want = {1: 0.0, -1: 0.0, 0: 0.0}
    for i, a in df[df.e == 1].iterrows():
        for j, b in df.iterrows():
            same = all(a[c] == b[c] for c in strata)
            if same and (b.t > a.t or (b.t == a.t and b.e == 0)):
                want[int(np.sign(a.score - b.score))] += w[i] * w[j]
    assert [row.concordant, row.discordant, row.tied_score] == pytest.approx([want[1], want[-1], want[0]], rel=1e-9)
    assert row.concordance == pytest.approx((want[1] + want[0] / 2) / sum(want.values()), rel=1e-9)


def test_gee_with_a_wide_cluster(spark):
    rng = np.random.default_rng(6)
    df = pd.DataFrame({"id": np.minimum(np.arange(60) // 2, 19), "x": rng.integers(0, 2, 60), "z": rng.normal(size=60).round(1)})
    df["y"] = rng.poisson(np.exp(0.2 + 0.4 * df.x))
    beta, robust, _, _ = dense_gee(df, ["x", "z"])
    fit = poisson_gee(spark.createDataFrame(df), "y", ["x", "z"], "id")
    assert np.allclose(fit.beta, beta, atol=1e-7) and np.allclose(fit.robust, robust, rtol=1e-5)


def test_verdicts_do_not_depend_on_units(spark):
    df = survival_data(4)
    df["far"] = df.b * 1e-5
    frame = spark.createDataFrame(df)
    for fit in (lambda x: cx.cox(frame, "t", "e", [x]), lambda x: logistic(frame, "e", [x])):
        near, far = fit("b"), fit("far")
        assert near.converged and far.converged
        assert far.beta[-1] * 1e-5 == pytest.approx(near.beta[-1], rel=1e-6)
    apart = spark.createDataFrame([(float(i), int(i < 5), int(i < 5)) for i in range(10)], "t double, e int, x int")
    assert not logistic(apart, "e", ["x"]).converged


@pytest.mark.parametrize("k, days, span", [(2, 9, 4096), (10, 9, 3), (25, 400, 4096), (100, 400, 7)])
def test_logrank_of_many_groups(spark, monkeypatch, k, days, span):
    monkeypatch.setattr(survival, "_RANGE", span)
    rng = np.random.default_rng(9)
    df = pd.DataFrame({"g": np.arange(600) % k, "t": rng.integers(1, days, 600).astype(float), "e": rng.integers(0, 2, 600)})
    start = time.monotonic()
    rows = survival.logrank(spark.createDataFrame(df), "t", "e", "g").collect()
    assert time.monotonic() - start < 20
    expected, cov = np.zeros(k), np.zeros((k, k))
    for t in np.unique(df.t):
        r = np.bincount(df.g[df.t >= t], minlength=k)
        d, n = int(((df.t == t) & (df.e == 1)).sum()), r.sum()
        expected += d * r / n
        cov += d * (n - d) / max(n - 1, 1) * (np.diag(r / n) - np.outer(r, r) / n**2)
    gap = (np.bincount(df.g[df.e == 1], minlength=k) - expected)[: k - 1]
    at = [int(r.level) for r in rows]
    assert len(rows) == k and rows[0].df == k - 1 and np.allclose([r.expected for r in rows], expected[at]) and np.allclose([r.variance for r in rows], np.diag(cov)[at])
    assert rows[0].chisq == pytest.approx(gap @ np.linalg.solve(cov[: k - 1, : k - 1], gap), rel=1e-8)


def test_logrank_groups_without_risk(spark):
    """Groups that are gone before the first event, and levels nobody has, take no part in the test."""
    rows = [("a", 5.0, 1), ("a", 6.0, 0), ("b", 7.0, 1), ("c", 1.0, 0), ("c", 2.0, 0)]
    df = spark.createDataFrame(rows, "g string, t double, e int")
    out = {r.level: r for r in survival.logrank(df, "t", "e", "g", ["a", "b", "c", "d"]).collect()}
    assert (out["c"].n, out["c"].expected, out["d"].n, out["a"].df) == (2, 0.0, 0, 1)
    two = survival.logrank(df.filter("g <> 'c'"), "t", "e", "g").first()
    assert out["a"].chisq == pytest.approx(two.chisq) and out["a"].p_value == pytest.approx(two.p_value)
    none = survival.logrank(df.withColumn("e", F.lit(0)), "t", "e", "g").first()
    assert none.df == 0 and none.chisq == 0


@pytest.mark.parametrize("cut", [False, True])
def test_cox_on_cached_sorted_rows(spark, monkeypatch, cut):
    if cut:
        monkeypatch.setattr(cx, "_WHOLE", 3)
    df = survival_data()
    rows = spark.createDataFrame(df).orderBy("t").cache()
    rows.count()
    fit = cx.cox(rows, "t", "e", ["a", "b"], weight="w")
    rows.unpersist()
    assert np.allclose(fit.beta, newton(df, ["a", "b"], weight="w"), atol=1e-6)
