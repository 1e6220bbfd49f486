import hashlib
import hmac

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import cleaning, components, disclosure, features, funding, inference, panel, peers, quality, serving, shrinkage, summary
from cohortlens.operators.guards import assert_unique


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_crosswalk_single_hop_and_several_changes(frame):
    x = frame("unitid_from int, unitid_to int, effective_year int, reason string, ordinal int",
              [(5, 1, 2020, "merger", 1), (6, 6, 2019, "closed", 2), (7, 5, 2018, "merger", 3), (8, 2, 2015, "merger", 4), (8, 3, 2020, "merger", 5)])
    p = frame("unitid int, survey_year int", [(5, 2020), (5, 2021), (7, 2017), (8, 2014), (8, 2018), (8, 2022), (9, 2000)])
    assert rows(panel.apply_crosswalk(p, x), "unitid", "survey_year") == [(1, 2020), (2, 2014), (3, 2018), (5, 2017), (5, 2021), (8, 2022), (9, 2000)]
    assert rows(panel.closed_entities(x), "unitid", "closed_year") == [(6, 2019)]


def test_rule_peers_and_unknown_target(frame):
    p = frame("unitid int, survey_year int, carnegie_basic string, control int, level int, total_enrollment int",
              [(1, 2022, "A", 1, 4, 1000), (2, 2022, "A", 1, 4, 1100), (3, 2022, "A", 1, 4, 5000), (4, 2022, "B", 2, 4, 1000), (2, 2021, "A", 1, 4, 1000)])
    g = ["carnegie_basic", "control", "level"]
    assert rows(peers.rule_peers(p, 1, 2022, g), "unitid") == [(2,)]
    with pytest.raises(ValueError):
        peers.rule_peers(p, 99, 2022, g)
    with pytest.raises(ValueError):
        peers.rule_peers(p.drop("control"), 1, 2022, g)


def test_nearest_peers_widens_and_falls_back(frame):
    rng = np.random.default_rng(1)
    data = [(i, 1 if i < 5 else 2, 4, "x" if i < 3 else "y", float(100 * (i + 1)), float(rng.random())) for i in range(12)]
    d = frame("unitid int, control int, level int, family string, fte double, price double", data)
    near = peers.nearest_peers(d, 0, ["fte", "price"], "fte", 4).collect()
    assert len(near) == 4 and {r["scope"] for r in near} == {"same control and level"}
    few = peers.nearest_peers(d, 0, ["fte", "price"], "fte", 50).collect()
    assert len(few) == 11 and few[0]["scope"] is None


def test_lags_and_rolling_mean(frame):
    p = frame("unitid int, survey_year int, v double", [(1, 2000, 1.0), (1, 2001, 2.0), (1, 2003, 3.0), (1, 2004, 5.0), (2, 2000, 9.0)])
    out = panel.rolling_prior_mean(panel.lags(p, "unitid", "survey_year", "v", 2), "unitid", "survey_year", "v")
    assert rows(out.filter("unitid = 1"), "survey_year", "v_lag1", "v_lag2", "v_roll3") == [
        (2000, None, None, None), (2001, 1.0, None, None), (2003, 2.0, 1.0, None), (2004, 3.0, 2.0, 2.0)]


def test_balanced_and_one_to_one(frame):
    p = frame("unitid int, year int, v double", [(1, 1, 1.0), (1, 2, 2.0), (2, 1, 1.0), (2, 2, None)])
    assert {r["unitid"] for r in panel.balanced(p, "unitid", "year", "v").collect()} == {1}
    with pytest.raises(ValueError):
        panel.one_to_one(p.select("unitid"), p.select("unitid"), ["unitid"])
    with pytest.raises(ValueError):
        assert_unique(p, ["unitid"], "p")


def test_within_means_are_zero(frame):
    p = frame("e int, v double", [(1, 1.0), (1, 3.0), (2, 10.0)])
    assert rows(panel.within(p, "e", ["v"]), "e", "v") == [(1, -1.0), (1, 1.0), (2, 0.0)]


def test_complementary_suppression(frame):
    d = frame("id int, g int, n int", [(1, 1, 3), (2, 1, 40), (3, 1, 55)])
    out = disclosure.suppress(d, ["n"], ["id"], groups=["g"])
    assert rows(out, "id", "n", "_suppressed") == [(1, None, True), (2, None, True), (3, 55, False)]
    lone = disclosure.suppress(frame("id int, g int, n int", [(1, 1, 3), (2, 2, 3), (3, 2, 40)]), ["n"], ["id"], threshold=5, groups=["g"])
    assert all(r["n"] is None for r in lone.collect())
    assert disclosure.suppression_audit(lone, ["n"], 5).collect()[0]["groups_needing_total_suppressed"] == 1
    zero = disclosure.suppress(frame("id int, g int, n int", [(1, 1, 4), (2, 1, 0), (3, 1, 25)]), ["n"], ["id"], groups=["g"])
    assert rows(zero, "id", "n") == [(1, None), (2, None), (3, 25)]
    assert rows(disclosure.suppress(frame("id int, n int", [(1, 4), (2, 25), (3, 0)]), ["n"], ["id"]), "id", "n") == [(1, None), (2, 25), (3, 0)]
    with pytest.raises(ValueError):
        disclosure.suppress(d, ["absent"], ["id"])


def test_small_cells_flag_zero(frame):
    d = disclosure.flag_small(frame("n int", [(25,), (8,), (0,), (None,)]), "n")
    assert sorted((r["n"] is None, r["n"] or 0, r["is_small_cell"]) for r in d.collect()) == [(False, 0, True), (False, 8, True), (False, 25, False), (True, 0, False)]


def test_pseudonyms_match_hmac(frame):
    out = disclosure.pseudonymise(frame("unitid int, x int", [(7, 1), (7, 2), (8, 3)]), "unitid", "s3cret")
    want = {f"INST_{hmac.new(b's3cret', str(i).encode(), hashlib.sha256).hexdigest()[:12]}" for i in (7, 8)}
    assert {r["pseudonym"] for r in out.collect()} == want and "unitid" not in out.columns
    for bad in ("", "salt", "changeme"):
        with pytest.raises(ValueError):
            disclosure.pseudonyms(frame("unitid int", [(1,)]), "unitid", bad)


def test_linkage_matches_null_with_null(frame):
    d = frame("a int, b int", [(1, None), (2, 5), (2, 5)])
    r = peers.linkage_share(d, d, ["a", "b"]).collect()[0]
    assert (r["n_rows"], r["n_linked"]) == (3, 1)


def test_validation_counts_samples_and_broken_rules(frame):
    d = frame("id int, k int, a double, total double", [(1, 1, 5.0, 5.0), (2, 1, -1.0, 3.0), (3, 2, None, None)])
    res = {r["name"]: r for r in quality.validate(d, [
        quality.unique_key("k"), quality.in_range("a", 0), quality.sums_to("total", ["a"]), quality.not_null("a"),
        quality.subset_of("k", {1}, severity="warn"), quality.in_range("gone", 0)], id_col="id").collect()}
    assert (res["unique_key(k)"]["n_offending"], res["unique_key(k)"]["sample_ids"]) == (2, "1,2")
    assert res["in_range(a,0,None)"]["n_offending"] == 1 and res["sums_to(total)"]["n_offending"] == 1
    assert res["not_null(a)"]["sample_ids"] == "3" and res["in_range(gone,0,None)"]["status"] == "error"
    names = {r["name"] for r in quality.failed(quality.validate(d, [quality.subset_of("k", {1}, severity="warn"), quality.not_null("id")], id_col="id")).collect()}
    assert names == set()


def test_rolls_up(frame):
    d = frame("UNITID int, AWLEVEL int, CIPCODE string, CTOTALT int", [(1, 5, "99", 30), (1, 5, "01", 10), (1, 5, "02", 20), (2, 5, "99", 7), (2, 5, "01", 5)])
    r = quality.validate(d, [quality.rolls_up("CTOTALT", level="CIPCODE", total_code="99", keys=["UNITID", "AWLEVEL"])], id_col="UNITID").collect()[0]
    assert (r["n_offending"], r["sample_ids"]) == (1, "2")


def test_component_packs_are_complete(frame):
    assert len(components.COMPONENTS) == 12
    assert all(c.rules and set(c.grain) <= set(c.keep) for c in components.COMPONENTS.values())
    adm = frame("UNITID int, APPLCN int, ADMSSN int, ENRLT int, EXTRA int", [(1, 10, 12, 3, 0), (2, -2, 5, 1, 0)])
    cur = components.curate(adm, "admissions")
    assert "EXTRA" not in cur.columns and rows(cur, "UNITID", "APPLCN") == [(1, 10), (2, None)]
    assert {r["name"]: r["n_offending"] for r in components.check(cur, "admissions").collect()}["admitted_le_applied"] == 1


def test_sign_flip_repair(frame):
    parts = frame("y int, c string, o int, v double", [(1, "a", 1, 100.0), (1, "b", 2, -40.0), (1, "c", 3, 7.0), (2, "a", 1, 5.0)])
    totals = frame("y int, t double", [(1, 147.0), (2, 5.0)])
    out = quality.sign_repair(parts, totals, ["y"], "c", "o", "v", "t")
    assert rows(out, "y", "c", "v", "repaired", "ties") == [(1, "a", 100.0, False, True), (1, "b", 40.0, True, True), (1, "c", 7.0, False, True), (2, "a", 5.0, False, True)]


def test_grad_rates(frame):
    data = [(1, 1, 100), (1, 2, 328), (1, 3, 205), (1, 27, 50), (1, 29, 8), (1, 30, 1), (2, 29, 8), (2, 30, 1), (3, 2, 0), (3, 3, 5), (4, 1, 9), (4, 2, 8), (4, 3, 5), (4, 27, 9), (4, 29, 8), (4, 30, 1)]
    assert rows(features.grad_rates(frame("unitid int, grtype int, grtotlt int", data)), "unitid", "cohort", "rate") == [(1, 100, 0.63), (2, 8, 0.13), (4, 9, 0.63)]


def test_tenure_density_and_salary(frame):
    sis = frame("unitid int, facstat int, sistotl int", [(1, 0, 10), (1, 20, 3), (1, 30, 1), (2, 0, 0), (2, 20, 0)])
    assert rows(features.tenure_density(sis), "unitid", "tenure_density") == [(1, 0.4), (2, None)]
    sal = frame("unitid int, arank int, saeq9am double, saeq9aw double", [(1, 7, 100.0, 90.0), (1, 1, 1.0, 1.0), (2, 7, 0.0, 5.0)])
    assert rows(features.salary_equity(sal), "unitid", "sal_w_to_m") == [(1, 0.9), (2, None)]


def test_ratio_features_guard_columns(frame):
    ef = frame("unitid int, survey_year int, ft_students int, pt_students int", [(1, 2022, 90, 30)])
    hr = frame("unitid int, survey_year int, fte_instructional_faculty int", [(1, 2022, 10)])
    assert features.student_faculty_ratio(ef, hr).collect()[0]["student_faculty_ratio"] == 10.0
    with pytest.raises(ValueError, match="applicants"):
        features.selectivity(hr)


def test_series_growth(frame):
    d = frame("u int, y int, v double", [(1, 2000, 100.0), (1, 2001, None), (1, 2002, 121.0), (2, 2000, 5.0), (2, 2001, 6.0), (2, 2002, 7.0), (3, 2001, 4.0)])
    got = {r["u"]: (None if r["cagr"] is None else round(r["cagr"], 9), r["complete"]) for r in features.series_growth(d, ["u"], "y", "v").collect()}
    assert got[1] == (0.1, False) and got[2][1] is True and got[3] == (None, False)


def test_hold_small_cohorts(frame):
    out = cleaning.hold_small_cohorts(frame("r double, n int", [(0.5, 10), (0.6, 30), (0.7, None)]), {"r": "n"})
    assert sorted((x["n"] or 0, x["r"], x["r_held"]) for x in out.collect()) == [(0, 0.7, None), (10, None, 0.5), (30, 0.6, None)]


def test_funding_worked_example(frame):
    prior = frame("board string, prior double", [("X", 0.1), ("Y", 0.2), ("Z", 0.7)])
    d = frame("metric string, board string, d double", [("m", "X", 1.05), ("m", "Y", 1.10), ("m", "Z", 910 / 900)])
    got = {r["board"]: round(100 * r["allocation"], 1) for r in funding.metric_allocation(prior, d).collect()}
    assert got == {"X": 10.2, "Y": 21.3, "Z": 68.5}
    shares = funding.step2_shares(prior, d, {"m": 0.5, "neutral": 0.5})
    assert abs(sum(r["share"] for r in shares.collect()) - 1) < 1e-12
    with pytest.raises(ValueError):
        funding.step2_shares(prior, d, {"m": 0.9})
    with pytest.raises(ValueError):
        funding.refuse_missing(frame("metric string, board string, d double", [("m", "X", None)]))
    assert abs(sum(funding.WEIGHTS.values()) - 1) < 1e-12


def test_d_ratio_identity_and_gaps(frame):
    v = [(i + 1, x) for i, x in enumerate([10.0, 12.0, 11.0, 14.0])]
    df = frame("b int, position int, value double", [(1, p, x) for p, x in v] + [(2, p, x) for p, x in v[:3]] + [(3, p, None if p == 2 else x) for p, x in v])
    got = {r["b"]: r["d"] for r in funding.d_ratio(df, ["b"]).collect()}
    assert abs(got[1] - (0.75 + 0.25 * 14 / 11)) < 1e-12 and got[2] is None and got[3] is None


def test_consistent_reporters(frame):
    base = [(1, y, 5, 10, "a") for y in range(4)] + [(2, y, 5, 10 if y else 0, "a") for y in range(4)] + [(3, y, 5, 10, "a" if y < 2 else None) for y in range(4)] + [(4, y, 5, None, "a") for y in range(3)]
    w = frame("unitid int, year int, num int, den int, src string", base).withColumn("metric", F.lit("m"))
    assert rows(funding.consistent_reporters(w), "unitid") == [(1,)]


def test_required_d_reproduces_target(frame):
    prior = frame("board string, prior double", [("X", 0.3), ("Y", 0.7)])
    d = frame("metric string, board string, d double", [("m", "X", 1.0), ("m", "Y", 1.02)])
    alloc = funding.metric_allocation(prior, d)
    need = {r["board"]: r["required_d"] for r in funding.required_d(alloc, F.lit(0.001), 0.2).collect()}["X"]
    before = {r["board"]: r["share"] for r in funding.step2_shares(prior, d, {"m": 0.2, "o": 0.8}).collect()}["X"]
    d2 = frame("metric string, board string, d double", [("m", "X", need), ("m", "Y", 1.02)])
    after = {r["board"]: r["share"] for r in funding.step2_shares(prior, d2, {"m": 0.2, "o": 0.8}).collect()}["X"]
    assert abs(after - before - 0.001) < 1e-12


def test_reward_path(frame):
    g = [r["gain"] for r in funding.reward_path(frame("b int, s double", [(1, 0.01)]), "b", "s").orderBy("window").collect()]
    assert abs(g[0] - 0.0025) < 1e-12 and g[1] > 0 and g[2] > 0 and all(abs(x) < 1e-12 for x in g[3:])


def test_cliffs_delta_pairwise_definition(frame):
    a, b = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 1.0]
    df = frame("g string, v double", [("a", x) for x in a] + [("b", x) for x in b])
    r = inference.rank_comparisons(df, "g", "v", ["a", "b"]).collect()[0]
    want = sum((x > y) - (x < y) for x in a for y in b) / (len(a) * len(b))
    assert abs(r["cliffs_delta"] - want) < 1e-12


def test_holm_steps(frame):
    got = {r["t"]: r["p_holm"] for r in inference.holm(frame("t int, p double", [(1, 0.01), (2, 0.04), (3, 0.03)]), "p", "t").collect()}
    assert {k: round(v, 10) for k, v in got.items()} == {1: 0.03, 3: 0.06, 2: 0.06}


def test_beta_binomial_recovers_parameters(spark):
    rng = np.random.default_rng(3)
    p = rng.beta(8, 12, 4000)
    n = rng.integers(20, 200, 4000)
    k = rng.binomial(n, p)
    df = spark.createDataFrame([("g", int(a), int(b)) for a, b in zip(k, n)], "g string, k int, n int")
    r = shrinkage.fit_priors(df, "g", "k", "n").collect()[0]
    assert abs(r["a"] - 8) < 1 and abs(r["b"] - 12) < 1.5
    s = shrinkage.shrink(df, shrinkage.fit_priors(df, "g", "k", "n"), "g", "k", "n").agg(
        F.min(F.col("post_hi") - F.col("post_mean")).alias("up"), F.min(F.col("post_mean") - F.col("post_lo")).alias("down")).collect()[0]
    assert s["up"] > 0 and s["down"] > 0


def test_histogram_small_and_clamped(frame):
    few = frame("v double, c int", [(1.0, 1)] * 4)
    assert summary.histogram(few, "v", "c").count() == 0
    many = frame("v double, c int", [(float(i), 1) for i in range(100)] + [(1e6, 1)])
    h = summary.histogram(many, "v", "c").collect()
    assert sum(r["n"] for r in h) == 101 and max(r["bin"] for r in h) == 17


def test_serving_keeps_null_slots(frame):
    d = frame("u int, y int, v int, a string", [(1, 2000, 5, "x"), (1, 2002, 7, "x"), (2, 2001, 9, "y")])
    got = {r["u"]: list(r["v"]) for r in serving.serving_records(d, "u", "y", ["v"], ["a"]).collect()}
    assert got == {1: [5, None, 7], 2: [None, 9, None]}
