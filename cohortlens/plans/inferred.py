"""Queries over rank tests, resampling, shrinkage and the linear family (T operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, nulls
from ..operators import inference as inf
from ..operators import linear as ln
from ..operators import ordering
from ..operators import panel as pn
from ..operators import resample as rs
from ..operators import shrinkage as sh
from ..operators import summary as sm
from ..operators.lineage import cut
from .derived import rounded
from .registry import query
from .tables import Tables

R = F.round
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

_MW = """
    , pairs as (select a, b, row_number() over (order by a, b) - 1 pair from (select distinct sector a from cust_panel) x, (select distinct sector b from cust_panel) y where a < b),
    r as (select pair, a, b, sector, n, rank() over (partition by pair order by n) + (count(*) over (partition by pair, n) - 1) / 2 rk,
      count(*) over (partition by pair, n) t from pairs join cust_panel on sector in (a, b)),
    u as (select pair, a, b, count(*) filter (sector = a) n_a, count(*) filter (sector = b) n_b, sum(rk) filter (sector = a) ra, sum(t * t - 1) ties from r group by 1, 2, 3),
    v as (select *, ra - n_a * (n_a + 1) / 2 u, n_a + n_b nn from u)"""


@query("t01_cliffs_delta", _MW + """
    select a, b, n_a, n_b, round(2 * u / (n_a * n_b) - 1, 6) cliffs_delta from v""", "cust_panel")
def _(t: Tables):
    return rounded(inf.rank_comparisons(t.once("cust_panel"), "sector", "n", SEGMENTS).select("a", "b", "n_a", "n_b", "cliffs_delta"), ["cliffs_delta"])


@query("t02_mann_whitney_u", _MW + """
    select a, b, round(u, 4) u, round(greatest(abs(u - n_a * n_b / 2) - 0.5, 0) / sqrt(n_a * n_b / 12 * (nn + 1 - ties / (nn * (nn - 1)))), 6) z from v""", "cust_panel")
def _(t: Tables):
    return rounded(rounded(inf.rank_comparisons(t.once("cust_panel"), "sector", "n", SEGMENTS).select("a", "b", "u", "z"), ["u"], 4), ["z"])


@query("t02_mann_whitney_p_holm")
def _(t: Tables):
    return inf.holm(inf.mann_whitney(t.once("cust_panel"), "sector", "n", SEGMENTS), "p", "pair")


@query("t03_holm_adjustment", """
    , p as (select control, avg(completers / cohort_size) p from sup_panel group by 1),
    r as (select *, row_number() over (order by p, control) i, count(*) over () m from p)
    select control, round(p, 6) p, round(least(1, max(p * (m - i + 1)) over (order by p, control rows unbounded preceding)), 6) p_holm from r""", "sup_panel")
def _(t: Tables):
    p = t.sup_panel.groupBy("control").agg(F.avg(nulls.ratio("completers", "cohort_size")).alias("p"))
    return rounded(inf.holm(p, "p", "control"), ["p", "p_holm"])


@query("t04_variance_tests", """
    , d as (select control g, cast(admits as double) x from sup_panel),
    md as (select g, median(x) m from d group by 1), z as (select d.g, abs(x - m) z from d join md using (g)),
    zg as (select g, count(*) n, avg(z) m, var_samp(z) v from z group by 1),
    lv as (select (sum(n) - count(*)) / (count(*) - 1) * (sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / sum((n - 1) * v) s, count(*) - 1 d1, sum(n) - count(*) d2 from zg),
    xg as (select g, count(*) n, avg(x) m, var_samp(x) v, count(*) / var_samp(x) w from d group by 1),
    ww as (select sum(w) tw, sum(w * m) / sum(w) mw, count(*) k from xg),
    we as (select any_value(k) k, sum(w * pow(m - mw, 2)) a, sum(pow(1 - w / tw, 2) / (n - 1)) l from xg, ww),
    rk as (select g, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2 r, count(*) over (partition by x) t from d),
    kg as (select g, count(*) n, sum(r) r, sum(t * t - 1) tt from rk group by 1),
    kr as (select (12 / (sum(n) * (sum(n) + 1)) * sum(r * r / n) - 3 * (sum(n) + 1)) / (1 - sum(tt) / (pow(sum(n), 3) - sum(n))) s, count(*) - 1 d1 from kg)
    select 'levene' test, round(s, 6) statistic, d1::double df1, round(d2, 4)::double df2 from lv
    union all select 'welch', round((a / (k - 1)) / (1 + 2 * (k - 2) / (k * k - 1) * l), 6), (k - 1)::double, round((k * k - 1) / (3 * l), 4) from we
    union all select 'kruskal', round(s, 6), d1::double, null from kr""", "sup_panel")
def _(t: Tables):
    return rounded(rounded(inf.variance_tests(t.once("sup_panel"), "control", "admits"), ["statistic"]), ["df2"], 4)


@query("t04_variance_test_p")
def _(t: Tables):
    return inf.with_p(inf.variance_tests(t.once("cust_panel"), "sector", "total_enrollment"))


_HASH = "('0x' || substr(md5({}), 1, 8))::bigint"
_HASH60 = "('0x' || substr(md5({}), 1, 15))::bigint"
_BOOT = """
    , d as (select r_name g, unitid * 10000 + survey_year id, completers / cohort_size v from sup_panel join nation on control = n_nationkey
      join region on n_regionkey = r_regionkey where r_name in ('ASIA', 'EUROPE')),
    pos_t as (select *, row_number() over (partition by g order by id) - 1 pos, count(*) over (partition by g) n from d)"""


def _two_boards(t: Tables):
    return t.once("sup_panel").join(t.boards, "control").select(F.col("board").alias("g"), (F.col("unitid") * 10000 + F.col("survey_year")).alias("id"),
                                                        nulls.ratio("completers", "cohort_size").alias("v"))


# The order statistics of every bootstrap sample, with the tries of their Beta variates: {seed} and {q} are filled in.
_ORDER_STATISTICS = """
    , sizes as (select g, count(*) n, floor({q} * (count(*) - 1)) + 1 k, {q} * (count(*) - 1) - floor({q} * (count(*) - 1)) part from d group by 1),
    tries as (select g, rep, t, k::double a, (n - k + 1)::double b, md5('{seed}|' || g || '|' || rep || '|' || t) h
      from sizes, (select unnest(generate_series(0, 1999)) rep), (select unnest(generate_series(0, 39)) t)),
    us as (select *, (('0x' || substr(h, 1, 15))::bigint + 0.5) / 1152921504606846976.0 u1, (('0x' || substr(h, 16, 15))::bigint + 0.5) / 1152921504606846976.0 u2,
      least(a, b) lo, greatest(a, b) hi from tries),
    vs as (select *, case when lo > 1 then sqrt((a + b - 2) / (2 * lo * hi - a - b)) end s from us),
    ws as (select *, s * ln(u1 / (1 - u1)) v, lo * exp(s * ln(u1 / (1 - u1))) w from vs),
    xs as (select *, case when lo <= 1 then t = 0 else (lo + 1 / s) * v - ln(4) + (a + b) * ln((a + b) / (hi + w)) >= ln(u1 * u1 * u2) end ok,
      case when a <= 1 then 1 - pow(1 - u1, 1 / b) when b <= 1 then pow(u1, 1 / a) when a <= b then w / (hi + w) else hi / (hi + w) end x from ws),
    firsts as (select g, rep, arg_min(x, t) u from xs where ok group by 1, 2),
    pairs as (select g, rep, n, part, u, u + (1 - u) * (1 - pow(1 - (('0x' || substr(md5('{seed}|' || g || '|' || rep || '|next'), 1, 15))::bigint + 0.5) / 1152921504606846976.0, 1.0 / (n - k))) nx
      from firsts join sizes using (g)),
    ats as (select g, rep, 1 - part share, least(floor(u * n), n - 1) pos from pairs union all select g, rep, part, least(floor(nx * n), n - 1) from pairs where part > 0),
    sorted as (select g, v, row_number() over (partition by g order by v) - 1 pos from d),
    m as (select rep, g, sum(share * v) m from ats join sorted using (g, pos) group by 1, 2)"""


@query("t05_bootstrap_interval", _BOOT + f"""
    , draws as (select g, rep, {_HASH60.format("'11|' || g || '|' || rep || '|' || pos")} % n idx from pos_t, (select unnest(generate_series(0, 1999)) rep)),
    m as (select rep, draws.g, median(v) m from draws join pos_t on draws.g = pos_t.g and draws.idx = pos_t.pos group by 1, 2),
    df as (select rep, max(m) filter (g = 'ASIA') - max(m) filter (g = 'EUROPE') d from m group by 1)
    select round(quantile_cont(d, 0.025), 6) low, round(quantile_cont(d, 0.975), 6) high from df""", "sup_panel")
def _(t: Tables):
    b = rs.bootstrap_interval(_two_boards(t), "g", "id", "v", "ASIA", "EUROPE", reps=2000, seed=11)
    return rounded(b, ["low", "high"])


@query("t05_bootstrap_quantile_interval", _BOOT + _ORDER_STATISTICS.format(seed=14, q="0.9") + """
    , df as (select rep, max(m) filter (g = 'EUROPE') d from m group by 1)
    select round(quantile_cont(d, 0.05), 6) low, round(quantile_cont(d, 0.95), 6) high from df""", "sup_panel")
def _(t: Tables):
    b = rs.bootstrap_interval(_two_boards(t), "g", "id", "v", "EUROPE", statistic="p90", reps=2000, level=0.9, seed=14)
    return rounded(b, ["low", "high"])


@query("t05_bootstrap_mean_interval", _BOOT + f"""
    , draws as (select g, rep, {_HASH60.format("'13|' || g || '|' || rep || '|' || pos")} % n idx from pos_t, (select unnest(generate_series(0, 1999)) rep) where g = 'ASIA'),
    m as (select rep, avg(v) d from draws join pos_t on draws.g = pos_t.g and draws.idx = pos_t.pos group by 1)
    select round(quantile_cont(d, 0.025), 6) low, round(quantile_cont(d, 0.975), 6) high from m""", "sup_panel")
def _(t: Tables):
    b = rs.bootstrap_interval(_two_boards(t), "g", "id", "v", "ASIA", statistic="mean", reps=2000, seed=13)
    return rounded(b, ["low", "high"])


@query("j15_draws_by_entity", _BOOT.replace(" where r_name in ('ASIA', 'EUROPE')", "") + f"""
    , draws as (select g, rep, {_HASH60.format("'15|' || g || '|' || rep || '|' || pos")} % n idx from pos_t, (select unnest(generate_series(0, 49)) rep))
    select rep::int rep, d.g, count(*) n, count(distinct p.id) n_distinct, round(sum(p.v), 6) total from draws d join pos_t p on d.g = p.g and d.idx = p.pos group by 1, 2""", "sup_panel")
def _(t: Tables):
    rows = rs.bootstrap_rows(_two_boards(t).filter(F.col("v").isNotNull()), "g", "id", ["id", "v"], 50, seed=15)
    return rounded(rows.groupBy("rep", "g").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_distinct"), F.sum("v").alias("total")), ["total"])


@query("t06_permutation_test", _BOOT + f"""
    , sh as (select rep, v, row_number() over (partition by rep order by {_HASH60.format("'12|' || rep || '|' || id")}, id) rk, g from pos_t, (select unnest(generate_series(0, 4999)) rep)),
    k as (select count(*) filter (g = 'ASIA') na, count(*) n, sum(v) s, avg(v) filter (g = 'ASIA') - avg(v) filter (g = 'EUROPE') obs from pos_t),
    x as (select rep, sum(v) x from sh, k where rk <= na group by 1)
    select round(any_value(obs), 6) observed, count_if(round(abs(x / na - (s - x) / (n - na)), 9) >= round(abs(obs), 9)) hits,
      round((count_if(round(abs(x / na - (s - x) / (n - na)), 9) >= round(abs(obs), 9)) + 1) / (count(*) + 1), 6) p from x, k""", "sup_panel")
def _(t: Tables):
    p = rs.permutation_mean_difference(_two_boards(t), "g", "id", "v", "ASIA", "EUROPE", reps=5000, seed=12)
    return rounded(p, ["observed", "p"])


@query("t07_spearman", """
    , r as (select rank() over (order by n) + (count(*) over (partition by n) - 1) / 2 a,
      rank() over (order by total_enrollment) + (count(*) over (partition by total_enrollment) - 1) / 2 b from cust_panel)
    select count(*) n, round(corr(a, b), 6) rho from r""", "cust_panel")
def _(t: Tables):
    return rounded(inf.spearman(t.cust_panel, "n", "total_enrollment"), ["rho"])


@query("t08_beta_binomial_priors")
def _(t: Tables):
    return sh.fit_priors(t.cohort, "brand", "k", "n")


@query("t09_posterior_mean", """
    select unitid, round(k / n, 6) raw_rate, round((10 + k) / (30 + n), 6) post_mean, round(n / (n + 30), 6) weight from cohort""", "cohort")
def _(t: Tables):
    c = t.cohort.withColumns({"a": F.lit(10.0), "b": F.lit(20.0)})
    return rounded(sh.posterior(c, "k", "n").select("unitid", "raw_rate", "post_mean", "weight"), ["raw_rate", "post_mean", "weight"])


@query("t09_shrunk_rates_with_interval")
def _(t: Tables):
    return sh.shrink(t.cohort, sh.fit_priors(t.cohort, "brand", "k", "n"), "brand", "k", "n")


@query("t10_funnel_limits", """
    , p as (select sum(k) / sum(n) r from cohort)
    select unitid, round(r - 1.96 * sqrt(r * (1 - r) / n), 6) low, round(r + 1.96 * sqrt(r * (1 - r) / n), 6) high,
      k / n < r - 1.96 * sqrt(r * (1 - r) / n) or k / n > r + 1.96 * sqrt(r * (1 - r) / n) outside from cohort, p""", "cohort")
def _(t: Tables):
    return rounded(inf.funnel_limits(t.cohort, "k", "n", 1.96).select("unitid", "low", "high", "outside"), ["low", "high"])


def _customer_counts(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("spend"))


@query("t12_t13_count_models")
def _(t: Tables):
    return ln.count_models(_customer_counts(t), "orders", "spend")


def _regression(t: Tables):
    p = t.sup_panel
    return p.select("unitid", "survey_year", F.log10("tuition_revenue").alias("log_tuition"), F.log10("total_enrollment").alias("log_enroll"),
                    nulls.ratio("admits", "applicants").alias("admit_rate"), nulls.ratio("completers", "cohort_size").alias("completion"),
                    (F.col("survey_year") >= 1999).cast("double").alias("late"))


_X = ["log_enroll", "admit_rate", "completion", "late"]


@query("t14_ols_hc3")
def _(t: Tables):
    fit = ln.ols(_regression(t), "log_tuition", _X)
    return fit.table(t.spark).withColumns({"n": F.lit(fit.n), "r2": F.lit(float(fit.r2))})


@query("t14_simple_regression", """
    , d as (select log10(total_enrollment) x, log10(tuition_revenue) y from sup_panel),
    f as (select regr_slope(y, x) s, regr_intercept(y, x) i, regr_r2(y, x) r2, avg(x) mx, regr_sxx(y, x) sxx, count(*) n from d),
    e as (select x - mx c, pow((y - i - s * x) / (1 - (1.0 / n + pow(x - mx, 2) / sxx)), 2) w, f.* from d, f),
    v as (select sqrt(sum(c * c * w)) / any_value(sxx) se_s, sqrt(sum(pow(1.0 / n - mx * c / sxx, 2) * w)) se_i from e)
    select 'intercept' term, round(i, 6) coef, round(se_i, 6) std_err, round(r2, 6) r2 from f, v union all select 'log_enroll', round(s, 6), round(se_s, 6), round(r2, 6) from f, v""", "sup_panel")
def _(t: Tables):
    fit = ln.ols(_regression(t), "log_tuition", ["log_enroll"])
    return rounded(fit.table(t.spark).select("term", "coef", "std_err").withColumn("r2", F.lit(float(fit.r2))), ["coef", "std_err", "r2"])


@query("t15_vif")
def _(t: Tables):
    return ln.vif(_regression(t), _X)


@query("t15_vif_two_regressors", """
    , d as (select log10(total_enrollment) a, completers / cohort_size b from sup_panel)
    select 'log_enroll' term, round(1 / (1 - pow(corr(a, b), 2)), 6) vif from d union all select 'completion', round(1 / (1 - pow(corr(a, b), 2)), 6) from d""", "sup_panel")
def _(t: Tables):
    return rounded(ln.vif(_regression(t), ["log_enroll", "completion"]), ["vif"])


_RESID = """
    , d as (select unitid, survey_year, log10(total_enrollment) x, log10(tuition_revenue) y from sup_panel),
    f as (select regr_slope(y, x) s, regr_intercept(y, x) i from d), r as (select unitid, survey_year, y - i - s * x e from d, f)"""


@query("t16_residual_shape", _RESID + """
    , m as (select avg(e) m, stddev_pop(e) s from r)
    select count(*) n, round(avg(pow((e - m) / s, 3)), 6) skewness, round(avg(pow((e - m) / s, 4)) - 3, 6) excess_kurtosis from r, m""", "sup_panel")
def _(t: Tables):
    fit = ln.ols(_regression(t), "log_tuition", ["log_enroll"])
    return rounded(ln.residual_shape(fit.scored), ["skewness", "excess_kurtosis"])


@query("t16_largest_residuals", _RESID + """
    select unitid, survey_year, round(e, 6) residual from r order by abs(e) desc, unitid limit 8""", "sup_panel")
def _(t: Tables):
    fit = ln.ols(_regression(t), "log_tuition", ["log_enroll"])
    return pn.top_n(fit.scored, F.desc(F.abs("residual")), "unitid", 8).select("unitid", "survey_year", R("residual", 6).alias("residual"))


def _event(t: Tables):
    d = pn.balanced(t.once("sup_panel").join(t.boards, "control").withColumn("v", nulls.ratio("completers", "cohort_size") * 100), "unitid", "survey_year", "v")
    return ln.event_study(d, "board", "unitid", "survey_year", "v", None, 1998)


@query("t18_event_study_estimates", """
    , b as (select *, completers / cohort_size * 100 v from sup_panel join nation on control = n_nationkey join region on n_regionkey = r_regionkey
      where unitid in (select unitid from sup_panel group by 1 having count(*) = (select count(distinct survey_year) from sup_panel))),
    y as (select r_name board, survey_year, avg(v) m, count(*) c from b group by 1, 2)
    select board, survey_year period, round(m - r.m0, 6) estimate, c entities from y join (select board, m m0 from y where survey_year = 1998) r using (board)""", "sup_panel")
def _(t: Tables):
    return rounded(_event(t).select("board", "period", (F.col("estimate") + 0.0).alias("estimate"), "entities"), ["estimate"])


@query("t18_event_study_errors")
def _(t: Tables):
    return _event(t)


@query("t19_adjusted_rand", """
    with c as (select l_returnflag a, l_linestatus b, count(*)::double n from lineitem group by 1, 2),
    s as (select (select sum(n * (n - 1) / 2) from c) both_, (select sum(x * (x - 1) / 2) from (select sum(n) x from c group by a)) sa,
      (select sum(x * (x - 1) / 2) from (select sum(n) x from c group by b)) sb, (select sum(n) from c) nn)
    select nn::bigint n, round((both_ - sa * sb / (nn * (nn - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (nn * (nn - 1) / 2)), 6) ari from s""")
def _(t: Tables):
    return rounded(inf.adjusted_rand(t.lineitem, "l_returnflag", "l_linestatus"), ["ari"])


_PCA = ["log_tuition", "log_enroll", "admit_rate", "completion"]


@query("t20_parallel_analysis")
def _(t: Tables):
    z = ln.standardise(_regression(t).dropna(subset=_PCA), _PCA)
    return ln.parallel_analysis(z, _PCA, reps=200, seed=5)


@query("t21_loading_stability")
def _(t: Tables):
    z = ln.standardise(_regression(t).dropna(subset=_PCA), _PCA).withColumn("id", F.col("unitid") * 10000 + F.col("survey_year"))
    return ln.loading_summary(ln.loading_stability(z, "id", _PCA, 3, reps=300, seed=6), _PCA)


# Fixed values of the scorecard binding: indicator and direction (+1 higher is better, -1 lower, 0 context).
INDICATORS = {"retention": 1, "completion": 1, "yield_rate": 1, "price": -1, "size": 0}
SCORED = [c for c, s in INDICATORS.items() if s]

_SCORE = """
    , i as (select unitid * 10000 + survey_year unitid, r_name peer_group, completers / cohort_size retention, case when admits > 30 then enrolled / admits end completion,
        enrolled / applicants yield_rate, total_revenue / total_enrollment price, total_enrollment as "size"
      from sup_panel join nation on control = n_nationkey join region on n_regionkey = r_regionkey),
    l as (select unitid, peer_group, c, v, s from i, lateral (values ('retention', retention, 1), ('completion', completion, 1), ('yield_rate', yield_rate, 1),
        ('price', price, -1), ('size', "size", 1)) x(c, v, s)),
    m as (select peer_group, c, median(v) m from l group by 1, 2),
    d as (select peer_group, c, 1.4826 * median(abs(v - m)) s from l join m using (peer_group, c) group by 1, 2),
    z as (select unitid, peer_group, c, v, case when d.s > 1e-9 then least(greatest((v - m.m) / d.s * l.s, -3), 3) end z from l join m using (peer_group, c) join d using (peer_group, c)),
    comp as (select unitid, peer_group, count(z) n_ind, case when count(z) >= 3 then avg(z) end comp from z where c <> 'size' group by 1, 2)"""


def _indicators(t: Tables):
    p = t.sup_panel.join(t.boards, "control")
    return p.select((F.col("unitid") * 10000 + F.col("survey_year")).alias("unitid"), F.col("board").alias("peer_group"), nulls.ratio("completers", "cohort_size").alias("retention"),
                    F.when(F.col("admits") > 30, nulls.ratio("enrolled", "admits")).alias("completion"),
                    nulls.ratio("enrolled", "applicants").alias("yield_rate"), nulls.ratio("total_revenue", "total_enrollment").alias("price"),
                    F.col("total_enrollment").alias("size"))


def _composite(t: Tables):
    z = pn.robust_z(cut(_indicators(t)), ["peer_group"], INDICATORS)
    comp, n = inf.composite(z, [f"z_{c}" for c in SCORED], 3)
    return z.withColumns({"composite": comp, "n_indicators": n})


@query("t22_composite", _SCORE + "select unitid, peer_group, n_ind::int n_indicators, round(comp, 6) composite from comp", "sup_panel")
def _(t: Tables):
    return rounded(_composite(t).select("unitid", "peer_group", "n_indicators", "composite"), ["composite"])


_DRAWS = _SCORE + f"""
    , w as (select draw, j, -ln(({_HASH.format("'21|' || draw || '|' || j")} + 0.5) / 4294967296.0) w from (select unnest(generate_series(0, 499)) draw), (select unnest(generate_series(0, 3)) j)),
    zz as (select unitid, z, case c when 'retention' then 0 when 'completion' then 1 when 'yield_rate' then 2 else 3 end j from z where c <> 'size' and unitid in (select unitid from comp where comp is not null)),
    sc as (select unitid, draw, round(sum(z * w) / sum(w) filter (z is not null), 10) score from zz join w using (j) group by 1, 2),
    rk as (select unitid, draw, rank() over (partition by draw order by score desc) + (count(*) over (partition by draw, score) - 1) / 2 r from sc),
    base as (select unitid, rank() over (order by round(comp, 10) desc) + (count(*) over (partition by round(comp, 10)) - 1) / 2 b from comp where comp is not null)"""


@query("t23_rank_intervals", _DRAWS + """
    select unitid, any_value(b) base_rank, round(quantile_cont(r, 0.05), 6) rank_p5, round(quantile_cont(r, 0.5), 6) rank_median, round(quantile_cont(r, 0.95), 6) rank_p95,
      round(quantile_cont(r, 0.95) - quantile_cont(r, 0.05), 6) width from rk join base using (unitid) group by 1""", "sup_panel")
def _(t: Tables):
    c = _composite(t).withColumn("composite", R("composite", 10))
    out = rs.rank_intervals(c, "unitid", "composite", [f"z_{x}" for x in SCORED], 500, seed=21)
    return rounded(out, ["rank_p5", "rank_median", "rank_p95", "width"])


@query("t23_rank_correlations", _DRAWS + """
    select draw::int draw, round(corr(r, b), 6) rho from rk join base using (unitid) group by 1""", "sup_panel")
def _(t: Tables):
    c = _composite(t).withColumn("composite", R("composite", 10))
    return rounded(rs.rank_correlations(c, "unitid", "composite", [f"z_{x}" for x in SCORED], 500, seed=21), ["rho"])


@query("t24_focal_scorecard", _SCORE + """
    , f as (select peer_group g from i where unitid = 71999), q as (select c, count(v) n_reporting, median(v) med, quantile_cont(v, 0.25) q1, quantile_cont(v, 0.75) q3 from l, f where peer_group = g group by 1),
    own as (select c, v from l where unitid = 71999)
    select c metric, round(own.v, 6) focal_value, round(med, 6) peer_median, round(q1, 6) peer_q1, round(q3, 6) peer_q3, n_reporting,
      round((select 100 * avg(cast(x.v < own.v as int)) from l x, f where x.peer_group = g and x.c = q.c and x.v is not null), 6) percentile,
      round((select z from z where z.unitid = 71999 and z.c = q.c), 6) oriented_z, (select round(comp, 6) from comp where unitid = 71999) composite
    from q join own using (c)""", "sup_panel")
def _(t: Tables):
    return focal_scorecard(t, 71999)


def focal_scorecard(t: Tables, focal: int):
    """Focal value, peer quartiles, percentile and oriented z for every indicator, with the composite."""
    from ..operators.peers import focal_row
    names = list(INDICATORS)
    comp = cut(_composite(t))
    at = focal_row(comp, F.col("unitid") == focal, f"unitid {focal}")
    group = comp.filter(F.col("peer_group") == at["peer_group"])
    q = ordering.multi_quantiles(group, [], names, {"peer_median": 0.5, "peer_q1": 0.25, "peer_q3": 0.75}).withColumnRenamed("n", "n_reporting")
    below = group.agg(*[(ordering.share_below(group, c, F.lit(at[c])) * 100).alias(c) for c in names]).unpivot([], names, "metric", "percentile")
    own = t.spark.createDataFrame([(c, float(at[c]) if at[c] is not None else None, at[f"z_{c}"]) for c in names],
                                  "metric string, focal_value double, oriented_z double")
    out = q.join(below, "metric").join(own, "metric").withColumn("composite", F.lit(at["composite"]).cast("double"))
    return rounded(out, ["focal_value", "peer_median", "peer_q1", "peer_q3", "percentile", "oriented_z", "composite"])


@query("t09_shrinkage_by_band")
def _(t: Tables):
    # priors and shrinkage from the cohorts up to 1998, scored against the later cohorts of the same parts
    returned, early = F.col("l_returnflag") == "R", F.year("l_shipdate") <= 1998
    c = t.lineitem.groupBy(F.col("l_partkey").alias("unitid")).agg(
        F.count_if(early).alias("n"), F.count_if(early & returned).alias("k"),
        F.avg(F.when(~early, returned.cast("double"))).alias("truth")).filter(F.col("truth").isNotNull())
    c = cut(c.join(t.part.select(F.col("p_partkey").alias("unitid"), F.col("p_brand").alias("brand")), "unitid"))
    s = sh.shrink(c, sh.fit_priors(c, "brand", "k", "n"), "brand", "k", "n")
    s = s.withColumn("size_band", labels.band(F.col("n"), [0, 25, 50, 100, 250, 1000, 10**12], ["<25", "25-49", "50-99", "100-249", "250-999", "1000+"]))
    return sm.banded_rmse(s, "size_band", "truth", {"raw": "raw_rate", "shrunk": "post_mean"})
