"""Queries over models and segmentation (M family)."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions import nulls
from ..operators import inference as inf
from ..operators import linear as ln
from ..operators import models as mo
from ..operators import panel as pn
from ..operators import penalised
from ..operators import segments as sg
from ..operators.lineage import cut
from .derived import rounded
from .registry import query
from .tables import Tables

R = F.round


def _documents(t: Tables):
    """Text shape features of labelled documents (whole texts)."""
    words = F.split("text", r"\s+")
    d = t.documents.join(t.labels, "doc_id")
    return d.select("doc_id", "quality", F.col("n_chars").cast("double").alias("n_chars"), F.size(words).cast("double").alias("n_words"),
                    F.size(F.array_distinct(words)).cast("double").alias("n_distinct"),
                    nulls.ratio(F.length(F.regexp_replace("text", r"[^0-9]", "")), F.length("text")).alias("digit_share"), "lang")


@query("m01_type_classifier")
def _(t: Tables):
    r = mo.classify_types(_documents(t), ["n_chars", "n_words", "n_distinct", "digit_share"], "quality", "doc_id", trees=200)
    return r.report.withColumn("accuracy", F.lit(r.metrics["accuracy"]))


def _lagged(t: Tables):
    p = t.sup_panel.select("unitid", "survey_year", "total_enrollment", nulls.ratio("completers", "cohort_size").alias("completion"),
                           nulls.ratio("admits", "applicants").alias("admit_rate"))
    return pn.rolling_prior_mean(pn.lags(p, "unitid", "survey_year", "total_enrollment", 1), "unitid", "survey_year", "total_enrollment")


_LAG = """
    , l as (select unitid, survey_year, total_enrollment y, lag(total_enrollment) over (partition by unitid order by survey_year) x from sup_panel),
    f as (select regr_slope(y, x) s, regr_intercept(y, x) i from l where survey_year <= 1999)"""


@query("m02_enrollment_forecast", _LAG + """
    select unitid, survey_year, round(i + s * x, 4) prediction from l, f where survey_year > 1999 and x is not null""", "sup_panel")
def _(t: Tables):
    r = mo.forecast(_lagged(t), ["total_enrollment_lag1"], "total_enrollment", "survey_year", 1999)
    return r.predictions.select("unitid", "survey_year", R("prediction", 4).alias("prediction"))


@query("m02_forecast_errors", _LAG + """
    select count(*) n, round(avg(abs(i + s * x - y)), 4) mae, round(sqrt(avg(pow(i + s * x - y, 2))), 4) rmse from l, f where survey_year > 1999 and x is not null""", "sup_panel")
def _(t: Tables):
    r = mo.forecast(_lagged(t), ["total_enrollment_lag1"], "total_enrollment", "survey_year", 1999)
    return rounded(mo.errors(r.predictions, "total_enrollment"), ["mae", "rmse"], 4)


@query("m03_completion_forecast")
def _(t: Tables):
    r = mo.forecast(_lagged(t), ["admit_rate", "total_enrollment_lag1"], "completion", "survey_year", None, model="boosting", iterations=100)
    return mo.errors(r.predictions, "completion")


def _vectors(t: Tables):
    return cut(t.embeddings.select("vec_id", "label", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features")))


def _features(t: Tables):
    p = t.sup_panel
    return cut(p.select((F.col("unitid") * 10000 + F.col("survey_year")).alias("id"), F.log10("total_enrollment").alias("size"),
                        nulls.ratio("admits", "applicants").alias("admit_rate"), nulls.ratio("completers", "cohort_size").alias("completion"),
                        nulls.ratio("tuition_revenue", "total_revenue").alias("tuition"), nulls.ratio("enrolled", "admits").alias("yield")))


_S = ["size", "admit_rate", "completion", "tuition"]


@query("m04_segmentation")
def _(t: Tables):
    return sg.segment(_features(t), _S, ["id"], 6)


@query("m04_embedding_clusters_vs_labels")
def _(t: Tables):
    v = _vectors(t)
    return inf.adjusted_rand(cut(sg.fit_kmeans(v, 10).transform(v).select("label", "prediction")), "label", "prediction")


@query("m05_choose_k")
def _(t: Tables):
    table = cut(sg.selection_table(sg.feature_vectors(_features(t), _S, ["id"]), list(range(2, 13)), len(_S)))
    return table.withColumn("chosen", nulls.false_if_null(F.col("k") == F.lit(sg.choose_k(table)).cast("int")))


@query("m06_stability")
def _(t: Tables):
    return sg.stability(sg.feature_vectors(_features(t), _S, ["id"]), "id", 6, runs=30)


@query("m06_mixture_agreement")
def _(t: Tables):
    return sg.mixture_agreement(sg.feature_vectors(_features(t), _S, ["id"]), "id", 6)


@query("m07_added_block_sensitivity")
def _(t: Tables):
    return sg.added_block_sensitivity(_features(t), _S, ["yield"], "id", 6)


@query("m07_distance_to_centre")
def _(t: Tables):
    return sg.distance_to_centre(sg.feature_vectors(_features(t), _S, ["id"]), 6, ["id"])


@query("m08_component_loadings")
def _(t: Tables):
    z = ln.standardise(_features(t).dropna(subset=_S), _S)
    return ln.pca(z, _S).loadings(t.spark, 3)


@query("m08_component_scores")
def _(t: Tables):
    z = cut(ln.standardise(_features(t).dropna(subset=_S), _S))
    return ln.pca(z, _S).scores(z, 2).select("id", "pc1", "pc2")


def _customers(t: Tables):
    o = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("spend"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"),
                                          F.avg("o_totalprice").alias("avg_price"))
    c = o.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return cut(c.select("o_custkey", F.log10("spend").alias("log_spend"), F.col("n_orders").cast("double").alias("n_orders"),
                        nulls.ratio("n_done", "n_orders").alias("done_share"), F.when(F.col("c_acctbal") > 2000, F.col("c_acctbal")).alias("balance"),
                        F.log10("avg_price").alias("log_price"), F.col("c_mktsegment").alias("segment")))


@query("m09_regression_comparison")
def _(t: Tables):
    return mo.compare_regressions(_customers(t), ["n_orders", "done_share", "balance"], ["segment"], "log_spend", "o_custkey")


_ONE_FEATURE = """
    with o as (select o_custkey id, count(*)::double x, log10(sum(o_totalprice)) y from orders group by 1),
    d as (select *, ('0x' || substr(md5('42|' || id), 1, 8))::bigint % 5 fold, ('0x' || substr(md5('42|inner|' || id), 1, 8))::bigint % 5 inn from o),
    f as (select unnest(generate_series(0, 4)) f),
    st as (select f, avg(x) m, stddev_pop(x) s, avg(y) my, count(*) n from f join d on fold <> f group by 1),
    z as (select f, fold, inn, (x - m) / s z, y, my, n from d, st),
    tot as (select f, sum(z * (y - my)) zy from z where fold <> f group by 1),
    ra as (select i, pow(10, -3 + i * 0.25) a from (select unnest(generate_series(0, 24)) i)),
    loo as (select f, a, sum(pow((y - my - z * zy / (n + a)) / (1 - 1 / n - z * z / (n + a)), 2)) e from z join tot using (f), ra where fold <> f group by 1, 2),
    rp as (select f, arg_min(a, e) ridge_penalty from loo group by 1),
    la as (select f, i, abs(zy) / n * pow(1e-3, i / 99.0) a from tot join st using (f), (select unnest(generate_series(0, 99)) i)),
    ins as (select f, j, avg(z) mz, avg(y) my, var_pop(z) vz, covar_pop(z, y) c from z, (select unnest(generate_series(0, 4)) j) where fold <> f and inn <> j group by 1, 2),
    val as (select f, inn j, count(*) n, sum(z) sz, sum(y) sy, sum(z * z) szz, sum(z * y) szy, sum(y * y) syy from z where fold <> f group by 1, 2),
    mse as (select f, i, avg((syy - 2 * b0 * sy - 2 * b * szy + b0 * b0 * n + 2 * b0 * b * sz + b * b * szz) / n) e from (
      select *, my - b * mz b0 from (select la.f, i, j, mz, my, sign(c) * greatest(abs(c) - a, 0) / vz b from la join ins using (f))) x join val using (f, j) group by 1, 2),
    lp as (select f, arg_min(a, e) lasso_penalty, any_value(zy) zy, any_value(n) n from mse join la using (f, i) join tot using (f) join st using (f) group by 1)
    select f::int fold, round(ridge_penalty, 6) ridge_penalty, round(lasso_penalty, 9) lasso_penalty,
      round(sqrt(avg(pow(y - my - z * zy / (st.n + ridge_penalty), 2))), 6) ridge_rmse,
      round(sqrt(avg(pow(y - my - z * sign(zy) * greatest(abs(zy) / st.n - lasso_penalty, 0), 2))), 6) lasso_rmse
    from (select f, fold, z, y, my from z) z join rp using (f) join (select f, lasso_penalty, zy from lp) lp using (f) join (select f, n from st) st using (f) where fold = f group by all"""


@query("m09_penalties_one_feature", _ONE_FEATURE)
def _(t: Tables):
    d = t.orders.groupBy("o_custkey").agg(F.count("*").cast("double").alias("x"), F.log10(F.sum("o_totalprice")).alias("y"))
    per = penalised.linear_comparison(d, ["x"], [], "y", "o_custkey", names=("ridge", "lasso"))
    of = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    return per.groupBy("fold").agg(R(of("ridge", "penalty"), 6).alias("ridge_penalty"), R(of("lasso", "penalty"), 9).alias("lasso_penalty"),
                                   R(of("ridge", "rmse"), 6).alias("ridge_rmse"), R(of("lasso", "rmse"), 6).alias("lasso_rmse"))


@query("m09_mean_baseline", """
    with o as (select o_custkey id, log10(sum(o_totalprice)) y from orders group by 1), d as (select *, ('0x' || substr(md5('42|' || id), 1, 8))::bigint % 5 fold from o),
    m as (select f, avg(y) my from d, (select unnest(generate_series(0, 4)) f) where fold <> f group by 1),
    r as (select fold, sqrt(avg(pow(y - my, 2))) r from d join m on fold = f group by 1)
    select 'baseline (mean)' model, round(avg(r), 6) rmse, round(stddev_pop(r), 6) fold_sd, round(pow(10, avg(r)), 6) multiplicative_error from r""")
def _(t: Tables):
    d = t.orders.groupBy("o_custkey").agg(F.log10(F.sum("o_totalprice")).alias("y")).withColumn("fold", mo.hash_fold("o_custkey", 5, 42))
    return rounded(mo.fold_rmse(mo.mean_baseline(d, "y"), "y", "baseline (mean)"), ["rmse", "fold_sd", "multiplicative_error"])


@query("m09_ols_one_feature", """
    with o as (select o_custkey id, count(*)::double x, log10(sum(o_totalprice)) y from orders group by 1), d as (select *, ('0x' || substr(md5('42|' || id), 1, 8))::bigint % 5 fold from o),
    b as (select f, regr_slope(y, x) s, regr_intercept(y, x) i from d, (select unnest(generate_series(0, 4)) f) where fold <> f group by 1)
    select fold::int fold, count(*) n, round(sqrt(avg(pow(y - i - s * x, 2))), 6) rmse from d join b on fold = f group by 1""")
def _(t: Tables):
    d = t.orders.groupBy("o_custkey").agg(F.count("*").cast("double").alias("x"), F.log10(F.sum("o_totalprice")).alias("y"))
    return penalised.linear_comparison(d, ["x"], [], "y", "o_custkey", names=("OLS",)).select("fold", "n", R("rmse", 6).alias("rmse"))


@query("m12_prevalence", """
    with o as (select o_custkey, count(*) n, sum(o_totalprice) s, c_mktsegment g from orders join customer on o_custkey = c_custkey group by 1, 4),
    m as (select g, median(log10(s)) med from o group by 1), y as (select avg((log10(s) > med)::int) p, count(*) n from o join m using (g))
    select n, 0.5::double auc, round(p * (1 - p), 6) brier, round(-(p * ln(p) + (1 - p) * ln(1 - p)), 6) log_loss from y""")
def _(t: Tables):
    return rounded(mo.prevalence_metrics(_above(t), "above"), ["brier", "log_loss"])


@query("m10_missing_strategies")
def _(t: Tables):
    return mo.missing_strategies(_customers(t), ["n_orders", "done_share"], "balance", ["segment"], "log_spend", "o_custkey")


@query("m11_permutation_importance")
def _(t: Tables):
    from pyspark.ml import Pipeline
    numeric = ["n_orders", "done_share", "balance"]
    d = _customers(t)
    test = mo.hash_fold("o_custkey", 4, 3) == 0
    ready = lambda x: mo.two_sided(x, numeric)
    model = Pipeline(stages=[*mo.tree_preparation(numeric, ["segment"]), mo.boosting(mo.GBTRegressor, "log_spend", 42, 300)]).fit(mo.few_files(ready(d.filter(~test))))
    return mo.permutation_importance(model, d.filter(test), [*numeric, "segment"], "log_spend", "o_custkey", repeats=20, prepare=ready)


def _above(t: Tables):
    return cut(pn.above_group_median(_customers(t), "segment", "log_spend", "above"))


_NUM = ["n_orders", "done_share", "balance"]


@query("m12_classifier_comparison")
def _(t: Tables):
    d = _above(t)
    out = mo.prevalence_metrics(d, "above").withColumn("model", F.lit("prevalence only"))
    for name in ("logistic", "gradient boosting"):
        oof = mo.classify_oof(d, _NUM, ["segment"], "above", "o_custkey", name)
        out = out.unionByName(mo.binary_metrics(oof, "above", "p").withColumn("model", F.lit(name)))
    return out


_PROB = """
    , q as (select unitid, band, cast(c_acctbal > 5000 as int) y, round(1 / (1 + exp(-(c_nationkey - 12) / 10.0 - (c_acctbal - 4500) / 4000.0)), 3) p, c_acctbal from quasi)"""


def _prob(t: Tables):
    x = (F.col("c_nationkey") - 12) / 10.0 + (F.col("c_acctbal") - 4500) / 4000.0
    return t.quasi.select("unitid", "c_acctbal", (F.col("c_acctbal") > 5000).cast("int").alias("y"), R(1 / (1 + F.exp(-x)), 3).alias("p"))


@query("m12_binary_metrics", _PROB + """
    , r as (select y, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2 rk from q),
    a as (select (sum(rk) filter (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) auc from r)
    select count(*) n, round(any_value(auc), 6) auc, round(avg(pow(p - y, 2)), 6) brier, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) log_loss from q, a""", "quasi")
def _(t: Tables):
    return rounded(mo.binary_metrics(_prob(t), "y", "p"), ["auc", "brier", "log_loss"])


@query("m13_calibration", _PROB + """
    , e as (select """ + ", ".join(f"quantile_cont(p, {i / 10}) e{i}" for i in range(1, 10)) + """ from q)
    select 1 + """ + " + ".join(f"(p > e{i})::int" for i in range(1, 10)) + """ bin, count(*) n, round(avg(p), 6) mean_predicted, round(avg(y), 6) observed from q, e group by 1""", "quasi")
def _(t: Tables):
    return rounded(mo.calibration(_prob(t), "y", "p"), ["mean_predicted", "observed"])


@query("m14_subgroup_audit", _PROB + """
    , e as (select quantile_cont(c_acctbal, 1 / 3) a, quantile_cont(c_acctbal, 2 / 3) b from q)
    select 1 + (c_acctbal > a)::int + (c_acctbal > b)::int as "group", count(*) n, round(avg(y), 6) base_rate, round(avg(p), 6) mean_predicted,
      round(count_if(p >= 0.5 and y = 0) / greatest(count_if(y = 0), 1), 6) false_positive_rate, round(count_if(p < 0.5 and y = 1) / greatest(count_if(y = 1), 1), 6) false_negative_rate
    from q, e group by 1""", "quasi")
def _(t: Tables):
    return rounded(mo.subgroup_audit(_prob(t), "c_acctbal", "y", "p"), ["base_rate", "mean_predicted", "false_positive_rate", "false_negative_rate"])


@query("m14_model_error_audit")
def _(t: Tables):
    oof = mo.classify_oof(_above(t), _NUM, ["segment"], "above", "o_custkey", "logistic", carry=("done_share",))
    return mo.subgroup_audit(oof, "done_share", "above", "p")


@query("m15_ablation")
def _(t: Tables):
    d = _above(t)
    scored = lambda cols: mo.binary_metrics(mo.classify_oof(d, cols, ["segment"], "above", "o_custkey", "gradient boosting"), "above", "p")
    with ThreadPool(2) as pool:  # a scan is short: both fits share the executors
        whole, without = pool.map(scored, [_NUM, ["done_share", "balance"]])
    return whole.withColumn("features", F.lit("all")).unionByName(without.withColumn("features", F.lit("without order counts")))


@query("m16_standardised_coefficients")
def _(t: Tables):
    return mo.standardised_coefficients(_above(t), _NUM, ["segment"], "above")
