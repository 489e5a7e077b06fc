"""Results, serving, statistics and integrity against known numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.functions import distributions as dist
from meridia.functions import kernels
from meridia.operators import inference as st
from meridia.operators import integrity as ig
from meridia.operators import models as md
from meridia.operators import results as rs
from meridia.operators import serving as sv


# --- results


@pytest.mark.parametrize(("raw", "error"), [("", False), ("None", False), ("none", False), ("False", False), ("0", False), ("nan", False), (None, False), (" Timeout ", True), ("HTTP 500", True), ("true", True)])
def test_error_predicate(spark, raw, error):
    assert spark.range(1).select(rs.is_error(F.lit(raw).cast("string")).alias("e")).first()["e"] is error


def test_estimand_and_summary(spark):
    rows = [("a", "1", "2", "0", "", "false"), ("a", "1", "4", "0", "", "false"), ("a", "1", "99", "1", "", "false"), ("a", "2", "nan", "0", "", "false"), ("a", "2", "6", "", "None", "false"), ("a", "3", "50", "0", "Timeout", "false"), ("b", "1", "garbage", "0", "", "False"), ("b", "1", "8", "0", "", "True")]
    df = spark.createDataFrame(rows, "cell string, example_id string, m string, repeat_index string, error string, empty_generation string")
    assert sorted((r["cell"], r["example_id"], r["value"]) for r in rs.per_example(df, "m").collect()) == [("a", "1", 3.0), ("a", "2", 6.0)]
    got = {r["cell"]: r for r in rs.cell_summary(df, "m").collect()}
    assert (got["a"]["mean"], got["a"]["median"], got["a"]["n_rows"]) == (4.5, 4.5, 3) and got["b"]["n_examples"] == 0 and got["b"]["mean"] is None
    assert rs.per_example(df, "absent").count() == 0


def test_pairs_and_wins(spark):
    e = spark.createDataFrame([("x", 1, 5.0), ("y", 1, 3.0), ("x", 2, 1.0), ("y", 2, 1.0), ("x", 3, 0.0), ("y", 4, 0.0)], "cell string, example_id int, value double")
    got = rs.win_loss_tie(rs.paired(e, "x", "y")).first()
    assert (got["n_pairs"], got["wins"], got["losses"], got["ties"], got["n_dropped"]) == (2, 1, 0, 1, 2)
    assert rs.win_loss_tie(rs.paired(e, "x", "y"), higher_is_better=False).first()["losses"] == 1


def test_staleness(spark):
    df = spark.createDataFrame([(True, False, "v0"), (True, True, "v1"), (True, False, "v0"), (False, True, None)], "served_from_cache boolean, grounded boolean, evidence_version string")
    got = rs.staleness(df, stale=F.col("evidence_version") == "v0").first()
    assert [got[c] for c in ("unsafe_served_rate", "answer_hit_rate", "false_hit_rate", "stale_hit_rate")] == [0.5, 0.75, pytest.approx(2 / 3), 1.0]
    assert all(v is None for v in rs.staleness(df.limit(0), stale=F.lit(False)).first())


def test_pareto_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.integers(0, 12, (150, 2)))] + [(900, None, 1.0)]
    df = spark.createDataFrame(points, "id int, x double, y double")
    own = points[:-1]
    want = {i for i, x, y in own if not any(p <= x and q <= y and (p < x or q < y) for _, p, q in own)}
    assert {r["id"] for r in rs.pareto(df, "x", "y").collect()} == want
    best = {i for i, x, y in own if not any(p >= x and q <= y and (p > x or q < y) for _, p, q in own)}
    assert {r["id"] for r in rs.pareto(df, "x", "y", minimize_x=False).collect()} == best


# --- serving

WINDOW = [(0.5, 0.05, True, True)] * 4 + [(0.5, 0.05, True, False)] * 2 + [(2.0, 0.05, True, True), (2.0, 0.05, True, False)] + [(None, None, False, False)] * 2


def _currencies(spark, rows):
    df = spark.createDataFrame([("w", *r) for r in rows], "w string, ttft_s double, tpot_s double, ok boolean, veridical boolean")
    return sv.window_currencies(df, "w", base_ttft=F.lit(0.1), base_tpot=F.lit(0.02), duration=F.lit(10.0)).first()


def test_window_currencies(spark):
    got = _currencies(spark, WINDOW)
    assert [got[c] for c in ("n_issued", "n_completed", "n_timely", "n_veridical", "n_yield")] == [10, 8, 6, 5, 4]
    want = {"attainment": 0.8, "throughput_rps": 0.8, "goodput_rps": 0.6, "yield_rps": 0.4, "independence_null_frac": 0.3, "covariance_gap": 0.1, "truth_tax_frac": 0.2}
    assert {k: got[k] for k in want} == {k: pytest.approx(v) for k, v in want.items()}


@pytest.mark.parametrize("bad", [(0.1, 0.1, True, None), (None, 0.1, True, True), (-1.0, 0.1, True, True), (float("nan"), 0.1, True, True), (0.1, 0.1, False, True), (0.1, 0.1, None, False)])
def test_window_contract(spark, bad):
    with pytest.raises(Exception, match="contract"):
        _currencies(spark, [*WINDOW, bad])


def _sweep(spark, rates, thr, lat):
    return spark.createDataFrame(list(zip(rates, thr, lat)), "offered_rate double, throughput double, latency double")


def test_knee(spark):
    grid = [1.15**k for k in range(5)]
    got = sv.knee(_sweep(spark, grid[::-1], [5.0, 6.0, 8.0, 6.0, 4.0][::-1], [1.0] * 5)).first()
    assert got["label"] == "ESTIMATED" and got["lo"] <= got["onset_rate"] <= got["hi"] and got["grid_rate"] == grid[2]
    assert sv.knee(_sweep(spark, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [1.0] * 3)).first()["label"] == "NOT_BRACKETED"
    assert sv.knee(_sweep(spark, [1.0, 2.0, 3.0], [1.0, 3.0, 3.0], [1.0] * 3)).first()["label"] == "INCONCLUSIVE_AT_RESOLUTION"
    assert sv.knee(_sweep(spark, [1.0, 2.0, 4.0], [1.0, 3.0, 2.0], [1.0] * 3)).first()["label"] == "INCONCLUSIVE_AT_RESOLUTION"
    with pytest.raises(Exception, match="duplicate rate"):
        sv.knee(_sweep(spark, [1.0, 1.0, 2.0], [1.0, 2.0, 3.0], [1.0] * 3)).collect()


def test_cliff(spark):
    one = lambda rates, good: sv.cliff(spark.createDataFrame(list(zip(rates, good)), "offered_rate double, goodput double")).first()
    assert one([1.0, 2.0, 3.0], [1.0, 2.0, 2.0])["label"] == "NOT_OBSERVED"
    got = one([0.5, 1.0, 2.0], [5.0, 8.0, 7.0])
    assert (got["label"], got["grid_rate"], got["onset_rate"]) == ("INCONCLUSIVE_AT_RESOLUTION", 2.0, None)
    assert one([1.0, 1.15, 1.15**2], [5.0, 8.0, 7.0])["onset_rate"] == pytest.approx(1.3225)


def test_zero_order_hold(spark):
    s = spark.createDataFrame([("a", 2.0, 0.5, 5), ("a", 6.0, 1.0, 5), ("a", 8.0, 0.8, 9), ("a", -1.0, 0.1, 1), ("b", 1.0, 0.5, 5), ("b", 5.0, 0.5, 4)], "k string, ts_s double, kv_cache_usage double, preemptions_total bigint")
    w = spark.createDataFrame([("a", 0.0, 10.0), ("b", 0.0, 10.0), ("c", 0.0, 10.0)], "k string, t_start double, t_end double")
    got = {r["k"]: r for r in sv.zero_order_hold(s, w, "k").collect()}
    assert (got["a"]["rho_kv"], got["a"]["scarcity_events"], got["a"]["n_samples"], got["a"]["coverage"]) == (pytest.approx(0.7), 4, 3, pytest.approx(0.8))
    assert not got["b"]["telemetry_ok"] and got["b"]["rho_kv"] is None and got["c"]["n_samples"] == 0 and not got["c"]["telemetry_ok"]


def test_regime(spark):
    one = lambda *x: spark.range(1).select(sv.regime(*[F.lit(v).cast("double") for v in x[:3]], *[F.lit(v) for v in x[3:]]).alias("r")).first()["r"]
    assert [one(0.95, 1, 0.95), one(0.5, 1, 0.95), one(0.95, 0, 0.95), one(0.95, 1, 0.5), one(0.1, 0, 0.5), one(0.9, 1, None), one(0.9, 1, 0.9, False)] == ["IN_REGIME", "UNPRESSURED", "UNPRESSURED", "PAST_CLIFF", "PAST_CLIFF", None, "UNKNOWN_TELEMETRY"]


@pytest.mark.parametrize(
    ("steps", "want"),
    [([(1, 1.0, 1), (2, 1.0, 2), (3, 0.5, 2)], ("ESTIMATED", 2.0, 3.0)), ([(1, 0.5, 1)], ("NONE_SUSTAINABLE", None, 1.0)), ([(1, 1.0, 1), (2, 0.9, 2)], ("LADDER_EXHAUSTED", None, None)),
     ([(1, 1.0, 5), (2, 1.0, 4), (3, 1.0, 4.5), (4, 1.0, 6), (5, 0.1, 6)], ("ESTIMATED", 4.0, 5.0))],
)
def test_ladder(spark, steps, want):
    df = spark.createDataFrame([("k", float(r), float(a), float(t)) for r, a, t in steps], "key string, rate double, attainment double, throughput double")
    got = sv.ladder_decision(df, "key").first()
    assert (got["label"], got["lambda_star"], got["first_unsustainable"]) == want


def test_arrivals_repeat_and_floor(spark):
    a, b = (sv.arrivals(spark, [1.0, 5.0], seed=3, duration_s=200.0).orderBy("rate", "k").collect() for _ in range(2))
    assert a == b and 850 < sum(r["rate"] == 5.0 for r in a) < 1150 and max(r["arrival_s"] for r in a) < 200
    with pytest.raises(Exception, match="too few"):
        sv.slo_floor(spark.createDataFrame([(1.0, 1.0)] * 29, "ttft_ms double, tpot_ms double")).collect()


# --- statistics

TIES_A, TIES_B = np.array([0.0] * 20 + [1.0] * 6 + [-1.0] * 2), np.zeros(28)


def test_distributions():
    assert dist.normal_cdf(1.96) == pytest.approx(0.9750021048517795)
    assert dist.t_sf(2.0, 5.0) == pytest.approx(0.05096973941492917) and dist.t_ppf(0.975, 10) == pytest.approx(2.2281388519649385)
    assert dist.clopper_pearson(12, 200) == (pytest.approx(0.031, abs=6e-4), pytest.approx(0.102, abs=6e-4))
    assert dist.binomial_test(8, 10, "greater") == pytest.approx(56 / 1024) and dist.binomial_test(8, 10) == pytest.approx(112 / 1024)


def test_wilcoxon_known_values():
    d = TIES_A - TIES_B
    assert kernels.wilcoxon(d) == (49.0, pytest.approx(0.16157836645236978))
    assert kernels.wilcoxon(d, "greater")[1] == pytest.approx(0.08078918322618489)
    assert kernels.wilcoxon(np.zeros(5)) == (0.0, 1.0)
    statistic, p = kernels.wilcoxon(np.repeat(d, 3), zeros="wilcox")
    assert statistic == 6 * 12.5 and 0 < p < 0.05
    assert kernels.wilcoxon(np.array([1.0, 2, 3, 4, 5]), zeros="wilcox") == (0.0, pytest.approx(0.0625))  # exact


def test_signed_rank_sums_equal_the_kernel(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 6, 80).astype(float), rng.integers(0, 5, 80).astype(float)
    df = spark.createDataFrame([(0, k, float(x), float(y)) for k, (x, y) in enumerate(zip(a, b))], "g int, example_id int, a double, b double")
    sums, test = st.signed_rank_sums(df, "g").first(), st.wilcoxon(df, "g").first()
    assert min(sums["w_plus"], sums["w_minus"]) == test["statistic"]
    assert min(1.0, 2 * dist.normal_sf(sums["z"])) == pytest.approx(test["p"])


def test_wilcoxon_by_group_equals_the_kernel(spark):
    rng = np.random.default_rng(3)
    groups = {0: rng.normal(0.3, 1, 40), 1: np.array([1.0, -1, 2, 2, 0, 3]), 2: np.zeros(4), 3: rng.integers(-2, 4, 300).astype(float), 4: np.array([5.0, -1, 2, 3])}
    df = spark.createDataFrame([(g, k, float(x), 0.0) for g, d in groups.items() for k, x in enumerate(d)] + [(4, 9, float("nan"), 1.0), (4, 10, None, 1.0)], "g int, example_id int, a double, b double")
    for zeros in ("pratt", "wilcox"):
        for side in ("two-sided", "greater", "less"):
            got = {r["g"]: r for r in st.wilcoxon(df, "g", alternative=side, zeros=zeros).collect()}
            for g, d in groups.items():
                want = kernels.wilcoxon(d, side, zeros)
                assert (got[g]["statistic"], got[g]["p"]) == (pytest.approx(want[0]), pytest.approx(want[1])), (g, zeros, side)
                assert got[g]["rank_biserial"] == pytest.approx(kernels.rank_biserial(d)) and got[g]["n_pairs"] == len(d)
                assert (got[g]["n_pos"], got[g]["n_neg"], got[g]["n_zero"]) == ((d > 0).sum(), (d < 0).sum(), (d == 0).sum())


def test_resampling_by_group(spark):
    rng = np.random.default_rng(8)
    d = {g: np.round(rng.normal(g, 1, 400), 2 - g) for g in (0, 1)}
    df = spark.createDataFrame([(g, k, float(x)) for g in d for k, x in enumerate(d[g])] + [(1, 900, None), (1, 901, float("nan"))], "g int, example_id int, value double")
    for blocks in (7, 1 << 17):
        for r in st.bootstrap_ci(df, "g", iters=3000, block_values=blocks).collect():
            own, se = d[r["g"]], d[r["g"]].std() / 20
            assert r["n"] == 400 and r["estimate"] == pytest.approx(own.mean())
            assert r["low"] == pytest.approx(own.mean() - 1.96 * se, abs=0.15 * se) and r["high"] == pytest.approx(own.mean() + 1.96 * se, abs=0.15 * se)
    for r in st.bootstrap_ci(df, "g", statistic="median", iters=500).collect():
        drawn = np.median(np.random.default_rng(1).choice(d[r["g"]], size=(4000, 400)), axis=1)
        low, high = np.percentile(drawn, [2.5, 97.5])
        assert r["estimate"] == pytest.approx(np.median(d[r["g"]])) and r["low"] == pytest.approx(low, abs=0.06) and r["high"] == pytest.approx(high, abs=0.06)


def test_equivalence_by_group_equals_the_kernel(spark):
    rng = np.random.default_rng(9)
    d = rng.integers(-3, 4, 300) / 10
    rows = [(0, k, float(x), 0.0, k % 3 != 0, k % 8) for k, x in enumerate(d)] + [(1, k, 1.0, 0.5, True, k % 5) for k in range(12)] + [(2, 1, 1.0, 0.0, True, 0)]
    df = spark.createDataFrame(rows, "g int, example_id int, a double, b double, event boolean, window_id int")
    event, window = np.arange(300) % 3 != 0, np.arange(300) % 8
    for windows in (False, True):
        got = {r["g"]: r for r in st.tost(df, "g", margin=0.1, windows=windows, iters=2000).collect()}
        want = kernels.tost(d[event], 0.1, iters=2000, windows=window[event] if windows else None)
        assert got[0]["n_total"] == 300 and all(got[0][c] == (pytest.approx(v) if isinstance(v, float) else v) for c, v in want.items())
        assert got[1]["domain"] == "not-equivalent" and got[2]["domain"] == "insufficient-n"
        post = {r["g"]: r for r in st.rope(df, "g", width=0.05, windows=windows, samples=4000).collect()}
        raw = kernels.rope(d[event], 0.05, samples=4000, windows=window[event] if windows else None)
        assert (post[0]["n_total"], post[0]["n_events"], post[0]["verdict"]) == (300, raw["n_events"], raw["verdict"])
        assert post[0]["p_rope"] == pytest.approx(raw["p_rope"], abs=0.05) and post[2]["verdict"] == "insufficient-n"
    # a constant difference: its sums leave no variance
    assert st.tost(df.filter("g = 1"), "g", margin=0.6).first()["p"] == 0.0


def test_mcnemar_and_welch(spark):
    a = [True] * 8 + [False] * 2 + [True] * 20 + [False] * 10
    b = [False] * 8 + [True] * 2 + [True] * 20 + [False] * 10
    got = st.mcnemar(spark.createDataFrame([(0, x, y) for x, y in zip(a, b)], "g int, a boolean, b boolean"), "g", alternative="greater").first()
    assert (got["n10"], got["n01"], got["diff"], got["p"]) == (8, 2, pytest.approx(6 / 40), pytest.approx(56 / 1024))
    one, two = [10.2, 9.8, 10.5, 10.1], [8.1, 8.4, 7.9]
    w = kernels.welch(np.array(one), np.array(two))
    assert w["mean_diff"] == pytest.approx(10.15 - 8.133333333) and w["p"] < 0.001 and w["low"] < w["mean_diff"] < w["high"]
    s = st.welch_stats(spark.createDataFrame([("a", x) for x in one] + [("b", x) for x in two], "side string, value double")).first()
    assert (s["t"], s["df"]) == (pytest.approx(w["t"]), pytest.approx(w["df"]))
    with pytest.raises(ValueError, match="more values"):
        kernels.welch(np.arange(51.0), np.arange(3.0))


def test_mann_whitney_and_cliff(spark):
    a, b = np.array([1.0, 1, 1, 0, 5, 5]), np.array([0.0, 0, 0, 1, 5, 5])
    brute = np.sign(a[:, None] - b[None, :]).mean()
    assert kernels.cliffs_delta(a, b) == pytest.approx(brute)
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "side string, value double")
    assert st.mann_whitney_sums(df).first()["cliffs_delta"] == pytest.approx(brute)


def test_multiplicity(spark):
    df = spark.createDataFrame([(0, 0.04), (1, 0.01), (2, 0.03), (3, 0.02)], "seq int, p double")
    assert [r["p_holm"] for r in st.holm(df).orderBy("seq").collect()] == [pytest.approx(x) for x in (0.06, 0.04, 0.06, 0.06)]
    assert [r["p_bh"] for r in st.benjamini_hochberg(df).orderBy("seq").collect()] == [pytest.approx(0.04)] * 4
    assert st.holm(df, registered=10).filter("seq = 1").first()["p_holm"] == pytest.approx(0.1)


def test_calibration(spark):
    rows = list(zip([0.9, 0.8, 0.7, 0.6, 0.65, 0.3, 0.2, 0.1], [1, 1, 1, 1, 0, 0, 0, 0]))
    df = spark.createDataFrame(rows, "score double, label int")
    got = st.tau_precision(df).first()
    assert (got["tau"], got["precision"], got["recall"], got["specificity"], got["n_predicted"]) == (0.7, 1.0, 0.75, 1.0, 3)
    tied = spark.createDataFrame([(0.8, 1), (0.6, 1), (0.6, 0), (0.1, 0)], "score double, label int")
    assert st.tau_precision(tied).first()["tau"] == 0.8 and st.roc_auc(tied).first()["auc"] == pytest.approx(0.875)
    assert st.roc_auc(tied.filter("label = 1")).first()["auc"] is None
    one = lambda *x: spark.range(1).select(st.corrected_rate(*map(F.lit, x)).alias("r")).first()["r"]
    assert one(0.5, 0.9, 0.9) == pytest.approx(0.5) and one(0.0, 0.9, 0.9) == 0.0
    with pytest.raises(Exception, match="uninformative"):
        one(0.5, 0.5, 0.5)


def test_tost_rope_and_bootstrap():
    rng = np.random.default_rng(1)
    close, far = rng.normal(0, 0.1, 60), rng.normal(2, 0.1, 60)
    assert kernels.tost(close, 0.5)["domain"] == "equivalent" and kernels.tost(far, 0.5)["domain"] == "not-equivalent"
    assert kernels.tost(close[:5], 0.5)["domain"] == "insufficient-n"
    windows = np.arange(60) % 6
    assert kernels.tost(close, 0.5, windows=windows)["domain"] == "equivalent"
    with pytest.raises(ValueError, match="five"):
        kernels.tost(close, 0.5, windows=windows % 4)
    assert kernels.rope(close, 0.5, samples=300)["verdict"] == "equivalent" and kernels.rope(far, 0.5, samples=300)["p_right"] == 1.0
    z = np.concatenate([[0.0], close[:12]])
    w = np.random.default_rng(42).dirichlet(np.concatenate([[0.5], np.ones(12)]), size=200)
    left = ((w @ ((z[:, None] + z[None, :]) / 2 < -0.05)) * w).sum(axis=1)
    right = ((w @ ((z[:, None] + z[None, :]) / 2 > 0.05)) * w).sum(axis=1)
    won = np.argmax(np.stack([left, 1 - left - right, right]), axis=0)
    assert kernels.rope(close[:12], 0.05, samples=200)["p_left"] == pytest.approx(np.mean(won == 0))
    assert kernels.bootstrap_ci(close, block=100) == kernels.bootstrap_ci(close, block=100) and math.isnan(kernels.bootstrap_ci(np.array([]))[0])


def test_power(spark):
    power = st.power_table(spark, [0.0, 2.0], [12, 20], sims=40, seed=5).collect()
    assert max(r["power"] for r in power if r["effect"] == 0.0) < 0.25 and min(r["power"] for r in power if r["effect"] == 2.0) > 0.9
    got = {r["effect"]: (r["required_n"], r["status"]) for r in st.required_n(spark.createDataFrame(power), "effect").collect()}
    assert got == {0.0: (None, "NOT_REACHED"), 2.0: (12, "REACHED")}


# --- integrity


def test_identity_join(spark):
    left = spark.createDataFrame([("a", None, 1), ("b", 0, 2)], "id string, rep int, x int")
    right = spark.createDataFrame([("b", 0, 20), ("a", None, 10)], "id string, rep int, y int")
    assert sorted((r["id"], r["x"], r["y"]) for r in ig.identity_join(left, right, ["id", "rep"]).collect()) == [("a", 1, 10), ("b", 2, 20)]
    for bad, word in ((right.limit(1), "LEFT_ONLY"), (right.union(right.limit(1)), "DUPLICATE"), (right.union(spark.createDataFrame([("c", 1, 1)], right.schema)), "RIGHT_ONLY")):
        with pytest.raises(ValueError, match=word):
            ig.identity_join(left, bad, ["id", "rep"])


def test_predicate_reasons(spark):
    rows = [("squad_v2", True, 1.0, None), ("squad_v2", True, None, 0.9), ("qasper", True, None, 0.5), ("qasper", False, None, 0.9), ("hpc", True, 1.0, 1.0)]
    got = ig.window_predicate(spark.createDataFrame(rows, "dataset string, ok boolean, exact_match double, grounding_score double")).collect()
    assert [(r["predicate"], r["reason"]) for r in got] == [(True, None), (None, "missing_verdict"), (True, None), (None, "not_ok"), (None, "no_predicate")]


def test_ledger_and_blinding(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    sealed = spark.createDataFrame(ig.ledger(spark, str(tmp_path)).collect())
    assert sealed.count() == 2
    (tmp_path / "a.txt").write_text("changed")
    (tmp_path / "b.txt").unlink()
    (tmp_path / "c.txt").write_text("new")
    found = ig.verify_ledger(sealed, ig.ledger(spark, str(tmp_path)))
    assert sorted((r["path"][-5:], r["finding"]) for r in found.collect()) == [("a.txt", "HASH-MISMATCH"), ("b.txt", "MISSING"), ("c.txt", "EXTRA")]
    tokens = ig.blinding_map(["x", "y", "x"], b"s")
    df = spark.createDataFrame([("x",), ("y",)], "arm string")
    assert {r["arm"] for r in ig.relabel(df, tokens, "arm").collect()} == set(tokens.values())
    with pytest.raises(Exception, match="unknown label"):
        ig.relabel(df, {"x": "1"}, "arm").collect()


CELL = {"arm": "gold-fresh", "retriever": "none", "policy": "none", "topology": "single", "engine": "vllm", "model": "qwen3-14b", "family": "F2", "budget_r": 0.5, "rate_frac": None}


@pytest.mark.parametrize(
    ("change", "broken"),
    [({}, []), ({"arm": "retr-fresh"}, ["arm-needs-retriever"]), ({"retriever": "bm25"}, ["arm-has-no-retrieval"]), ({"arm": "gold-reuse"}, ["arm-not-in-family"]), ({"family": "F1"}, ["budget_r-in-F1"]), ({"policy": "evict"}, []),
     ({"engine": "hf"}, ["hf-is-F1-only"]), ({"topology": "pd"}, ["pd-is-DIST"]), ({"budget_r": -1.0}, ["budget_r-range"]), ({"model": "gpt"}, ["model-vocabulary"]), ({"engine": "lmdeploy", "model": "deepseek-v3"}, ["lmdeploy-models"])],
)
def test_cell_rules(spark, change, broken):
    schema = ", ".join(f"{k} {'double' if k in ('budget_r', 'rate_frac') else 'string'}" for k in CELL)
    df = spark.createDataFrame([tuple((CELL | change).values())], schema)
    assert ig.violations(df).first()["violations"] == broken


def test_row_keys(spark):
    schema = ", ".join(f"{k} {'double' if k in ('budget_r', 'rate_frac') else 'string'}" for k in CELL)
    rows = [CELL | {"budget_r": b, "rate_frac": r} for b, r in ((0.5, None), (None, 1.25), (10.0, 0.333333333), (None, None), (123.0, 1000.0))]
    got = spark.createDataFrame([tuple(r.values()) for r in rows], schema).select(ig.row_key().alias("k"), "budget_r", "rate_frac").collect()
    want = ["|".join([*list(CELL.values())[:7], *([f"r{r['budget_r']:g}"] if r["budget_r"] else []), *([f"lam{r['rate_frac']:g}"] if r["rate_frac"] else [])]) for r in rows]
    assert [r["k"] for r in got] == want


def test_gate_chain(spark):
    rows = [(1, "E1", "a", 0.01), (1, "E1", "b", 0.02), (2, "E2", "a", 0.2), (3, "E3", "a", 0.001)]
    got = ig.gatekeeping(spark.createDataFrame(rows, "chain_order int, endpoint string, dataset string, p double")).orderBy("chain_order").collect()
    assert [r["status"] for r in got] == ["REJECTED", "NOT_REJECTED", "NOT_TESTED"]
    missing = [(1, "E1", "a", 0.01), (1, "E1", "b", None), (2, "E2", "a", 0.001)]
    assert [r["status"] for r in ig.gatekeeping(spark.createDataFrame(missing, "chain_order int, endpoint string, dataset string, p double")).orderBy("chain_order").collect()] == ["MISSING_LEG", "NOT_TESTED"]


# --- models


def test_grounding_is_the_intersection_of_windows(spark):
    rng = np.random.default_rng(3)
    flags, lengths, want = [], [], {}
    for doc in range(20):
        n, both = 50, None
        for window in range(1 + doc % 3):
            mask = np.zeros(n, bool)
            for _ in range(3):
                s = int(rng.integers(0, 45))
                e = s + int(rng.integers(0, 12))
                flags.append((doc, window, s, min(e, n)))
                mask[s:e] = True
            both = mask if both is None else both & mask
        lengths.append((doc, n))
        want[doc] = int(both.sum())
    got = md.grounding(spark.createDataFrame(flags, "doc int, window int, start int, end int"), spark.createDataFrame(lengths, "doc int, n_chars int"), "doc").collect()
    assert {r["doc"]: r["n_flagged"] for r in got} == want


def test_rouge_windows_and_cache(spark):
    assert md._rouge("the cat sat", "the cat ran") == pytest.approx(2 / 3) and md._rouge("", "x") == 0.0 and md._rouge("x", "") is None
    cut = md.windows_of(["a b", "c d", "e f", "g h i j k l"], 4)
    assert cut[0] == "a b c d" and cut[-1].endswith("g h i j k l") and len(cut) < 6
    pairs = spark.createDataFrame([("a b", "a"), ("a b", "c"), ("a b", "a")], "premise string, claim string")
    once = md.cached_scores(pairs, spark.createDataFrame([], "key string, score double"), "overlap")
    assert sorted(r["score"] for r in once.collect()) == [0.0, 1.0, 1.0]
    again = md.cached_scores(pairs, once.selectExpr("key", "score + 5 AS score"), "overlap")
    assert sorted(r["score"] for r in again.collect()) == [5.0, 6.0, 6.0]
    with pytest.raises(Exception, match="missing"):
        md.verdicts(spark.createDataFrame([(None,)], "score double"), 0.5).collect()
