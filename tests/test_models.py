import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from agrolith.models import clustering, components, gibbs, kernelset, scan, simulate, stats


def _grid(g=4, e=3, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(f"E{j + 1}", f"G{i + 1}") for j in range(e) for i in range(g)]
    data = pd.DataFrame(rows, columns=["env", "gid"])
    data["value"] = rng.integers(1, 20, len(data)).astype(float)
    kg = pd.DataFrame(np.eye(g) + 0.2, [f"G{i + 1}" for i in range(g)], [f"G{i + 1}" for i in range(g)])
    ke = pd.DataFrame(np.eye(e) + 0.3, [f"E{i + 1}" for i in range(e)], [f"E{i + 1}" for i in range(e)])
    return data, kg, ke


@pytest.mark.parametrize("model", list(kernelset.MODELS))
@pytest.mark.parametrize("balanced", [True, False])
def test_dense_equals_factored(model, balanced):
    data, kg, ke = _grid()
    if not balanced:
        data = data.drop(index=[1, 7]).reset_index(drop=True)
    dense = kernelset.get_kernel(data, kg, ke, model, intercept=True, engine="dense")
    thin = kernelset.get_kernel(data, kg, ke, model, intercept=True)
    assert list(dense.kernels) == list(thin.kernels)
    for name in dense.kernels:
        a, b = dense.kernels[name].matrix(), thin.kernels[name].matrix()
        assert np.allclose(a, b, atol=1e-8), name
        assert np.isclose(np.diag(a).mean(), 1)


def test_contiguity_is_checked():
    data, kg, ke = _grid()
    with pytest.raises(ValueError, match="together"):
        kernelset.get_kernel(data.sample(frac=1, random_state=3), kg, ke, "MDs")


def test_decompose_truncate_mask():
    data, kg, ke = _grid()
    ks = kernelset.get_kernel(data, kg, ke, "RNMM", engine="dense")
    done = kernelset.decompose_kernels(ks, keep_var={"GE": 0.5})
    assert ks.kernels["KGE_GW"].blocks is None and done.kernels["KGE_GW"].rank < len(data)
    assert kernelset.undecompose_kernels(done).kernels["KG_G"].blocks is None
    less = kernelset.truncate_gxe_kernel(ks, 0.5)
    assert np.linalg.matrix_rank(less.kernels["KGE_GW"].matrix(), tol=1e-6) < len(data)
    masked = kernelset.mask_by_cluster(done, {"E1": 1, "E2": 1, "E3": 2})
    assert masked.kernels["KGE_GW"].matrix()[0, -1] == 0 and masked.kernels["KGE_GW"].blocks is None


def test_simulated_truth_is_recovered(spark):
    met = simulate.sim_met(K=np.eye(40), C=simulate.sim_met_C(6, structure="equi", rho=0.6), h2=0.7, env_effects=[0, 1, -1, 2, 0, 1], seed=11)
    data = met.data.sort_values(["env", "gid"]).reset_index(drop=True)
    ks = kernelset.get_kernel(data, model="EMDs")
    how = gibbs.Sampling(400, 100, 5)
    fit = gibbs.kernel_model("value", data, ks, how=how)
    assert np.corrcoef(fit.yhat, data["value"])[0, 1] > 0.8
    truth = met.g.stack().rename_axis(["gid", "env"]).rename("g").reset_index()
    found = data[["env", "gid"]].assign(u=fit.effects["KG_G"] + fit.effects["KGE_GE"]).merge(truth)
    assert np.corrcoef(found["u"], found["g"])[0, 1] > 0.6
    vc = gibbs.varcomp_summary(fit).iloc[0]
    assert 0.2 < vc["h2_plot"] < 0.95 and vc["few_environments"]
    assert gibbs.genotype_effects(spark, fit).count() == 40
    assert gibbs.reliability(fit)["reliability"].between(0, 1).all()


def test_missing_values_are_predicted_and_chains_agree(spark):
    data, kg, ke = _grid(10, 6)
    ks = kernelset.get_kernel(data, kg, ke, "EMM")
    how = gibbs.Sampling(200, 50, 5)
    chains = gibbs.kernel_model_mc(spark, "value", data, ks, 3, how)
    out = gibbs.rhat_ess(chains).toPandas()
    assert set(out["param"]) >= {"mu", "residual"} and (out["rhat"].dropna() < 1.6).all()
    for scheme in ("cv1", "cv0"):
        cv = gibbs.kernel_cv(spark, "value", data, ks, 3, scheme, how)
        assert cv.count() == len(data)
        assert sorted(r["fold"] for r in gibbs.cv_metrics(cv).collect()) == [0, 1, 2, 3]


def test_clustered_engines_agree():
    data, kg, ke = _grid()
    clusters = {"E1": 1, "E2": 1, "E3": 2}
    how = gibbs.Sampling(30, 10, 2)
    fits = [gibbs.kernel_model_clustered("value", data, kernelset.get_kernel(data, kg, ke, "RNMM", engine=e), clusters, "both", how=how) for e in ("dense", "factored")]
    assert fits[0].yhat.shape == (12,) and len(fits[0].draws) == 10
    ks = [kernelset.mask_by_cluster(kernelset.get_kernel(data, kg, ke, "RNMM", engine=e), clusters) for e in ("dense", "factored")]
    assert np.allclose(ks[0].kernels["KGE_GW"].matrix(), ks[1].kernels["KGE_GW"].matrix())


def test_scan(spark):
    met = simulate.sim_met(K=np.eye(12), C=simulate.sim_met_C(8, structure="ar1", rho=0.7), h2=0.8, seed=3)
    data = met.data.sort_values(["env", "gid"]).reset_index(drop=True)
    w = simulate.sim_W(met.target, n_var=6, seed=5)
    ke = pd.DataFrame(simulate.gram(w.w.to_numpy()), w.w.index, w.w.index)
    fit = gibbs.kernel_model("value", data, kernelset.get_kernel(data, None, ke, "RNMM"), how=gibbs.Sampling(200, 50, 5))
    inside, far = w.w.iloc[[2]].set_axis(["same"]), (w.w.iloc[[2]] * 0 + 30).set_axis(["far"])
    new = pd.concat([inside, far]).rename_axis("env").reset_index().melt("env", var_name="covariable")
    out = scan.scan_untested_envs(fit, w.to_spark(spark), spark.createDataFrame(new))
    sites = {r["env"]: r for r in out.sites.collect()}
    assert sites["far"]["position"] == "gross_extrapolation" and sites["far"]["flagged"]
    assert sites["same"]["max_similarity"] == pytest.approx(1) and not sites["same"]["flagged"]
    pred = out.predictions.toPandas()
    assert len(pred) == 24 and (pred["lower"] <= pred["upper"]).all()
    assert pred.groupby("env")["prob_win"].sum().round(6).eq(1).all()
    same = pred[pred["env"] == "same"].set_index("gid")["yHat"]
    e = data["env"] == w.w.index[2]
    assert np.corrcoef(same.loc[data.loc[e, "gid"]], fit.yhat[e])[0, 1] > 0.8
    chunked = scan.grid_scan(fit, w.to_spark(spark), spark.createDataFrame(new), chunk_size=1, max_draws=500).predictions.toPandas()
    assert np.allclose(chunked.sort_values(["env", "gid"])["yHat"], pred.sort_values(["env", "gid"])["yHat"])
    dropped = scan.scan_untested_envs(fit, w.to_spark(spark), spark.createDataFrame(new), envelope="drop")
    assert {r["env"] for r in dropped.predictions.select("env").distinct().collect()} == {"same"}
    by_position, by_covariate = scan.coverage_summary(out)
    assert by_position.count() == 4 and by_covariate.count() >= 1
    dates = spark.createDataFrame([("same", "2024-03-01"), ("far", "2024-04-01")], "env string, date string")
    table = scan.planting_window_table(out.predictions, out.sites, dates)
    best = scan.best_planting_date(table).toPandas()
    assert (best["date"] == "2024-03-01").all() and (best["n_dates_considered"] == 1).all()
    assert scan.planting_window_curve(table, None).count() == 2
    coords = spark.createDataFrame([("same", 1.0, 1.0), ("far", 5.0, 5.0)], "env string, lon double, lat double")
    spatial = scan.scan_spatial_table(out.predictions, out.sites, coords)
    assert scan.map_scan(spatial, "which_won_where").count() == 2 and scan.map_scan(spatial, "coverage").count() == 2
    assert [r["env"] for r in scan.within_polygon(coords, [(0, 0), (2, 0), (2, 2), (0, 2)]).collect()] == ["same"]


def test_simulators():
    assert np.allclose(simulate.sim_met_C(5, structure="equi", rho=0.4).matrix, np.full((5, 5), 0.4) + 0.6 * np.eye(5))
    assert np.allclose(simulate.sim_met_C(4, structure="ar1", rho=0.5).matrix[0], [1, 0.5, 0.25, 0.125])
    block = simulate.sim_met_C(4, structure="block", rho=0.7, between=0.1)
    assert block.matrix[0, 2] == 0.7 and block.matrix[0, 1] == 0.1
    for structure in ("random", "vine", "factor"):
        c = simulate.sim_met_C(5, 0.1, 0.6, structure, seed=1).matrix
        assert np.allclose(np.diag(c), 1) and np.linalg.eigvalsh(c).min() > 0
    exact = simulate.sim_met(K=np.eye(50), C=block, h2=0.5, seed=1)
    assert np.allclose(exact.realised, exact.target, atol=0.05)
    assert np.allclose(exact.h2_plot, 0.5, atol=0.05)
    w = simulate.sim_W(simulate.sim_met_C(12, seed=4), noise=0.3, seed=4)
    assert abs(w.facts["r"] - 0.7) < 0.25
    m = simulate.sim_markers(30, 200, n_subpop=3, fst=0.2, ld=0.5, ld_blocks=4, seed=1)
    assert set(np.unique(m.x)) <= {0, 1, 2} and np.allclose(m.g, m.g.T)
    assert simulate.sim_met(markers=m.x, n_env=4, h2=0.5, n_qtl=50, seed=2).mechanism == "marker"
    env = simulate.sim_envirome(9, 8, "clusters", redundancy=0.4, shape="right-skewed", seed=3)
    assert simulate.sim_met(K=np.eye(20), W=env.w, h2=0.6, n_rep=2, rep_var=0.2, spatial=True, subset=0.8, seed=1).mechanism == "reaction-norm"
    assert simulate.env_cor(env).shape == (9, 9)
    with pytest.raises(TypeError):
        simulate.env_cor("x")


def test_sim_grid(spark):
    out = simulate.sim_W_grid(spark, simulate.sim_met_C(8, seed=1), [0.2, 0.6], [10], [0.0], n_rep=2).toPandas()
    assert len(out) == 2 and out.sort_values("noise")["mean_r"].is_monotonic_decreasing


def test_distributions():
    assert stats.t_cdf(2.0, 10) == pytest.approx(0.963306, abs=1e-6)
    assert stats.chi2_quantile(0.95, 3) == pytest.approx(7.814728, abs=1e-5)
    assert stats.gamma_quantile(0.5, 1.5) == pytest.approx(1.182987, abs=1e-5)
    assert stats.beta_quantile(0.3, 2, 2) == pytest.approx(0.363257, abs=1e-5)
    assert stats.t_quantile(0.975, 3) == pytest.approx(3.182446, abs=1e-5)
    assert np.allclose(stats.adjusted(np.array([0.01, 0.04, 0.03, 0.5])), [0.04, 0.0533333, 0.0533333, 0.5])


def test_clustering():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.2, (10, 2)) for c in (0, 3, 6)])
    d = clustering.distances(x)
    for labels in (clustering.kmeans(x, 3)[0], clustering.cut_number(clustering.linkage(d, "ward.D2"), 30, 3), clustering.pam(d, 3)[0]):
        assert len({tuple(labels[i : i + 10]) for i in (0, 10, 20)}) == 3 and all(len(set(labels[i : i + 10])) == 1 for i in (0, 10, 20))
        assert clustering.silhouette(d, labels) > 0.7
    cor = pd.DataFrame(np.corrcoef(rng.normal(size=(8, 20))), [f"E{i}" for i in range(8)], [f"E{i}" for i in range(8)])
    for method in ("hclust", "pam", "kmeans"):
        out, tried = gibbs.cluster_environments(cor, method=method)
        assert out["medoid"].sum() == out["cluster"].nunique() and set(tried) == {2, 3, 4, 5, 6}


def test_registered_models_take_all_environments(spark, sf):
    from agrolith.plans import models, weather

    got = models.QUERIES["kernel_model"](spark, sf).select("env", "gid").distinct().count()
    assert got == weather.phenotypes(spark, sf).where("value IS NOT NULL").select("env", "gid").count()
    assert models._HOW == gibbs.Sampling()


def test_large_grid_of_low_rank_stays_small():
    import resource

    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(600, 5)), rng.normal(size=(30, 3))
    kg, ke = a @ a.T, b @ b.T
    ig, ie = (x.ravel() for x in np.meshgrid(np.arange(600), np.arange(30), indexing="ij"))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = kernelset.kronecker_spectrum(kg, ke, ig, ie, 1e-6)
    assert found.u.shape == (18_000, 15)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # kB; all products of columns would take 2.6 GB
    at = rng.integers(0, 18_000, 50)
    assert np.allclose((found.u[at] * found.s) @ found.u[at].T, kg[np.ix_(ig[at], ig[at])] * ke[np.ix_(ie[at], ie[at])])
    assert kernelset.kronecker_spectrum(kg, ke, ig, ie, 1e-6, 0.5).u.shape[1] < 15


def test_roles_by_name():
    assert [gibbs.roles(k) for k in ("KG_TREE", "KE_W", "ke_w", "E", "KGE_GW", "environment", "geno", "other", "TREE")] == ["G", "E", "E", "E", "GE", "E", "G", "other", "other"]


def test_fixed_effects_are_averaged_over_draws():
    """With a strong fixed effect two seeds agree to Monte Carlo error: the last draws differ by far more."""
    data, kg, ke = _grid(20, 6)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(len(data), 1))
    y = 5 * x[:, 0] + rng.normal(size=len(data))
    ks = kernelset.get_kernel(data, kernelset_g(20), ke, "MM")
    a, b = (gibbs.sample(y, ks, x, gibbs.Sampling(2000, 200, 2, seed=s)) for s in (1, 2))
    assert abs(a.beta[0] - b.beta[0]) < 0.03 and abs(a.beta[0] - 5) < 0.4
    assert np.abs(a.yhat - b.yhat).mean() < 0.1


def kernelset_g(n):
    names = [f"G{i + 1}" for i in range(n)]
    return pd.DataFrame(np.eye(n) + 0.2, names, names)


def test_components_by_role():
    data, kg, ke = _grid()
    rng = np.random.default_rng(3)
    u = {k: rng.normal(size=len(data)) for k in ("KG_A", "KG_TREE", "KE_W", "KGE_AW")}
    y = 9 * rng.normal(size=len(data))
    fit = gibbs.Fit(data, y, 0.0, np.zeros(0), u, y, {"KG_A": 0.5, "KG_TREE": 0.7, "KE_W": 0.2, "KGE_AW": 0.1}, 0.9, pd.DataFrame())
    one = gibbs.varcomp_summary(fit).iloc[0]
    assert np.isclose(one["var_G"], np.var(u["KG_A"] + u["KG_TREE"], ddof=1))
    assert np.isclose(one["var_resid"], np.var(y, ddof=1) - one[["var_G", "var_E", "var_GE"]].sum())
    other = gibbs.varcomp_summary(fit, "gibbs").iloc[0]
    assert other["var_G"] == 0.5 and np.isclose(other["var_resid"], np.var(y, ddof=1) - 0.8)
    with pytest.warns(UserWarning, match="exceed"):
        small = gibbs.varcomp_summary(gibbs.Fit(data, y / 100, 0.0, np.zeros(0), u, y, {}, 0.9, pd.DataFrame())).iloc[0]
    assert small["var_resid"] == max(1e-6 * np.var(y / 100, ddof=1), 1e-8)


def test_components_from_draws_equal_the_fit(spark):
    data, kg, ke = _grid(8, 5)
    data["value"] += np.random.default_rng(1).normal(size=len(data))
    fit = gibbs.kernel_model("value", data, kernelset.get_kernel(data, kernelset_g(8), ke, "MDs"), how=gibbs.Sampling(300, 50, 5))
    rows = pd.concat([data[["env", "gid"]].assign(kernel=k, draw=i, value=u) for k, c in fit.chains.items() for i, u in enumerate(c)])
    draws = spark.createDataFrame(rows[["kernel", "draw", "env", "gid", "value"]])
    ours, want = components.variance_components(draws, spark.createDataFrame(data)).toPandas().iloc[0], gibbs.varcomp_summary(fit).iloc[0]
    for c in want.index:
        assert np.isclose(np.nan_to_num(float(ours[c])), float(want[c])), c  # the fit has 0 where a role has no kernel
    means = spark.createDataFrame(fit.draws[["mu"]].reset_index(names="draw"))
    got = components.prediction_intervals(draws, means).toPandas().merge(gibbs.prediction_intervals(fit), on=["env", "gid"])
    assert len(got) == len(data) and np.allclose(got["lower_x"], got["lower_y"]) and np.allclose(got["upper_x"], got["upper_y"])


def test_components_of_nothing(spark):
    draws = spark.createDataFrame([], "kernel string, draw long, env string, gid string, value double")
    one = components.variance_components(draws, spark.createDataFrame([("E1", "G1", None)], "env string, gid string, value double")).first()
    assert one["var_G"] is None and one["var_total"] is None and one["p"] == 1
    assert components.prediction_intervals(draws, spark.createDataFrame([], "draw long, mu double")).collect() == []
