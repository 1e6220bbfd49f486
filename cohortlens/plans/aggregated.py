"""Queries over descriptive aggregates (A family except serving panels)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, nulls
from ..operators import panel as pn
from ..operators import summary as sm
from .derived import rounded
from .registry import query
from .tables import Tables

R = F.round

_AWARDS = """
    , d as (select c_nationkey k, c_mktsegment code, n from cells union all select c_nationkey, '99', sum(n) from cells group by 1)"""


def _awards(t: Tables):
    d = t.cells.select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("code"), "n")
    tot = d.groupBy("k").agg(F.sum("n").alias("n")).withColumn("code", F.lit("99"))
    return d.unionByName(tot)


@query("a01_award_totals", _AWARDS + """
    select cast(sum(n) filter (code = '99') as bigint) grand_total, cast(sum(n) as bigint) naive_sum, cast(sum(n) filter (code <> '99') as bigint) detail_sum from d""", "cells")
def _(t: Tables):
    return sm.stored_totals(_awards(t), "code", "99", "n")


@query("a01_totals_by_entity", _AWARDS + """
    select k, cast(sum(n) as bigint) total from d where code = '99' group by 1""", "cells")
def _(t: Tables):
    return sm.entity_totals(_awards(t), "k", "code", "99", "n")


@query("a02_pivot_sum", """
    select c_nationkey, cast(sum(n) filter (o_orderstatus = 'F') as bigint) "cF", cast(sum(n) filter (o_orderstatus = 'O') as bigint) "cO",
      cast(sum(n) filter (o_orderstatus = 'P') as bigint) "cP" from cells group by 1""", "cells")
def _(t: Tables):
    return sm.pivot_sum(t.cells, ["c_nationkey"], "o_orderstatus", "n", ["F", "O", "P"])


@query("a03_crosstab_top_classes", """
    select p_brand, count(*) n_total, count_if(p_size = 1) "1", count_if(p_size = 2) "2", count_if(p_size = 3) "3" from part
    group by 1 order by 2 desc, 1 limit 8""")
def _(t: Tables):
    return sm.crosstab_top(t.part, "p_brand", "p_size", [1, 2, 3], 8)


@query("a04_describe", """
    select l_returnflag, count(*) n, round(avg(l_extendedprice), 4) mean, round(stddev_samp(l_extendedprice), 4) sd, round(quantile_cont(l_extendedprice, 0.25), 4) q1,
      round(quantile_cont(l_extendedprice, 0.5), 4) median, round(quantile_cont(l_extendedprice, 0.75), 4) q3 from lineitem group by 1""")
def _(t: Tables):
    return rounded(sm.describe(t.lineitem, ["l_returnflag"], "l_extendedprice"), ["mean", "sd", "q1", "median", "q3"], 4)


@query("a05_cluster_profile", """
    select sector, count(*) n, round(avg(cast(survey_year > 1998 as int)), 6) share_public, arg_max(unitid, (total_enrollment, unitid)) largest_member,
      round(median(n), 4) median_n, round(median(total_enrollment), 2) median_total_enrollment from cust_panel group by 1""", "cust_panel")
def _(t: Tables):
    p = sm.cluster_profile(t.once("cust_panel"), "sector", ["n", "total_enrollment"], F.col("survey_year") > 1998, "total_enrollment", "unitid")
    return rounded(rounded(p, ["share_public"]), ["median_n", "median_total_enrollment"], 2)


@query("a05_cluster_means", """
    select sector, round(avg(n), 6) n, round(avg(total_enrollment), 2) size from cust_panel group by 1""", "cust_panel")
def _(t: Tables):
    return t.cust_panel.groupBy("sector").agg(R(F.avg("n"), 6).alias("n"), R(F.avg("total_enrollment"), 2).alias("size"))


@query("a06_weighted_vs_simple", """
    select brand, count(*) n, cast(sum(n) as bigint) weight, round(avg(k / n), 6) simple_mean, round(sum(k) / sum(n), 6) weighted_mean,
      round(sum(k) / sum(n) - avg(k / n), 6) gap from cohort group by 1""", "cohort")
def _(t: Tables):
    c = t.cohort.withColumn("rate", nulls.ratio("k", "n"))
    return rounded(sm.weighted_vs_simple(c, "brand", "rate", "n"), ["simple_mean", "weighted_mean", "gap"])


@query("a07_missing_share", """
    , q as (select c_mktsegment g, case when c_acctbal > 0 then c_acctbal end bal, case when band > 2 then band end b from quasi)
    select g, 'bal' as "column", count_if(bal is null) n_missing, round(count_if(bal is null) / count(*), 6) share_missing from q group by 1
    union all select g, 'b', count_if(b is null), round(count_if(b is null) / count(*), 6) from q group by 1""", "quasi")
def _(t: Tables):
    q = t.quasi.select(F.col("c_mktsegment").alias("g"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bal"),
                       F.when(F.col("band") > 2, F.col("band")).alias("b"))
    return rounded(sm.missing_share(q, ["g"], ["bal", "b"]), ["share_missing"])


@query("a08_imputation_summary", """
    with f as (select case when l_quantity > 10 then l_returnflag end a, l_linestatus b from lineitem)
    select 'a' as "column", coalesce(a, '(missing)') code, count(*) n, round(count(*) / (select count(*) from f), 6) share from f group by 2
    union all select 'b', coalesce(b, '(missing)'), count(*), round(count(*) / (select count(*) from f), 6) from f group by 2""")
def _(t: Tables):
    f = t.lineitem.select(F.when(F.col("l_quantity") > 10, F.col("l_returnflag")).alias("a"), F.col("l_linestatus").alias("b"))
    return rounded(sm.flag_summary(f, ["a", "b"]), ["share"])


@query("a15_complete_totals", """
    , b as (select * from cust_panel where unitid in (select unitid from cust_panel group by 1 having count(*) = (select count(distinct survey_year) from cust_panel)))
    select survey_year, cast(sum(n) as bigint) total, count(*) n from b group by 1""", "cust_panel")
def _(t: Tables):
    return sm.complete_totals(t.once("cust_panel"), "unitid", "survey_year", "n")


@query("a18_histogram", """
    , s as (select list(total_enrollment order by total_enrollment) v, min(total_enrollment) lo, count(*) c from cust_panel),
    h as (select lo, v[1 + floor(c * 0.99)::int] hi from s)
    select least(17, floor((total_enrollment - lo) / ((hi - lo) / 18)))::int bin, round(lo + least(17, floor((total_enrollment - lo) / ((hi - lo) / 18)))::int * ((hi - lo) / 18), 4) bin_low,
      sector, count(*) n from cust_panel, h group by all""", "cust_panel")
def _(t: Tables):
    return rounded(sm.histogram(t.once("cust_panel"), "total_enrollment", "sector"), ["bin_low"], 4)


@query("a23_definition_ratio", """
    select control, count(*) n, round(avg(cast(enrolled / admits < 0.5 as int)), 6) share_below_1, round(median(enrolled / admits * 2), 6) median_ratio
    from sup_panel where admits <> 0 group by 1""", "sup_panel")
def _(t: Tables):
    p = t.sup_panel.withColumn("twice", F.col("enrolled") * 2)
    return rounded(sm.definition_ratio(p, "control", "twice", "admits"), ["share_below_1", "median_ratio"])


_GAP = """
    , p as (select case when year <= 1998 then 'early' else 'late' end period, sum(completers) a, sum(cohort_size) d,
       sum(cohort_size - completers) b, sum(cohort_size * 2) e from board_year group by 1),
    g as (select period, a / d ra, b / e rb, a / d - b / e gap, 1.96 * sqrt(a / d * (1 - a / d) / d + b / e * (1 - b / e) / e) hw from p)"""


def _gaps(t: Tables):
    b = t.board_year.withColumns({"others": F.col("cohort_size") - F.col("completers"), "twice": F.col("cohort_size") * 2})
    return sm.subgroup_gap(b, F.when(F.col("year") <= 1998, "early").otherwise("late"), ("completers", "others"), ("cohort_size", "twice"))


@query("a24_subgroup_gap", _GAP + "select period, round(ra, 6) rate_sub, round(rb, 6) rate_other, round(gap, 6) gap, round(hw, 6) half_width from g", "board_year")
def _(t: Tables):
    return rounded(_gaps(t), ["rate_sub", "rate_other", "gap", "half_width"])


@query("a24_gap_change", _GAP + """
    select round(l.gap - e.gap, 6) change, round(sqrt(l.hw * l.hw + e.hw * e.hw), 6) half_width from g l, g e where l.period = 'late' and e.period = 'early'""", "board_year")
def _(t: Tables):
    return rounded(sm.period_change(_gaps(t), "early", "late"), ["change", "half_width"])


@query("a26_robust_location", """
    , c as (select quantile_cont(total_enrollment, 0.99) cut from cust_panel),
    s as (select 'all' sample, total_enrollment v from cust_panel union all select 'trimmed', total_enrollment from cust_panel, c where total_enrollment <= cut),
    m as (select sample, median(v) med from s group by 1)
    select sample, round(avg(v), 2) mean, round(stddev_samp(v), 2) sd, round(any_value(med), 2) median, round(1.4826 * median(abs(v - med)), 2) mad,
      round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 2) iqr from s join m using (sample) group by 1""", "cust_panel")
def _(t: Tables):
    return rounded(sm.robust_location(t.once("cust_panel"), "total_enrollment"), ["mean", "sd", "median", "mad", "iqr"], 2)


@query("a27_tail_mass", """
    , p as (select total_enrollment x, log10(total_enrollment) l from cust_panel where total_enrollment > 0),
    m as (select avg(x) mx, stddev_pop(x) sx, avg(l) ml, stddev_pop(l) sl, stddev_samp(l) ss from p)
    select count(*) n, round(avg(cast(abs(l - ml) > 3 * ss as int)), 6) share_beyond_3sd, round(avg(pow((x - mx) / sx, 3)), 6) skew_raw,
      round(avg(pow((l - ml) / sl, 3)), 6) skew_log from p, m""", "cust_panel")
def _(t: Tables):
    return rounded(sm.tail_mass(t.cust_panel, "total_enrollment"), ["share_beyond_3sd", "skew_raw", "skew_log"])


@query("a28_banded_rmse", """
    , e as (select unitid, k / n raw, (k + 10) / (n + 30) shrunk, n from cohort),
    t as (select l_partkey unitid, avg(cast(l_linestatus = 'F' as int)) truth from lineitem group by 1),
    j as (select *, case when n < 25 then '<25' when n < 35 then '25-34' else '35+' end band from e join t using (unitid))
    select coalesce(band, 'all') band, count(*) n, round(sqrt(avg(pow(raw - truth, 2))), 6) rmse_raw, round(sqrt(avg(pow(shrunk - truth, 2))), 6) rmse_shrunk,
      round(1 - sqrt(avg(pow(shrunk - truth, 2))) / sqrt(avg(pow(raw - truth, 2))), 6) improvement from j group by rollup (band)""", "cohort")
def _(t: Tables):
    truth = t.lineitem.groupBy(F.col("l_partkey").alias("unitid")).agg(F.avg((F.col("l_linestatus") == "F").cast("double")).alias("truth"))
    j = t.cohort.join(truth, "unitid").select("truth", nulls.ratio("k", "n").alias("raw"), ((F.col("k") + 10) / (F.col("n") + 30)).alias("shrunk"),
                                             labels.band(F.col("n"), [0, 25, 35, 10**9], ["<25", "25-34", "35+"]).alias("b"))
    return rounded(sm.banded_rmse(j, "b", "truth", {"raw": "raw", "shrunk": "shrunk"}), ["rmse_raw", "rmse_shrunk", "improvement"])


@query("a29_facet_counts", """
    select 'c_mktsegment' facet, c_mktsegment as value, count(*) n from customer group by 2 union all select 'c_nationkey', cast(c_nationkey as varchar), count(*) from customer group by 2""")
def _(t: Tables):
    return sm.facet_counts(t.customer, ["c_mktsegment", "c_nationkey"])


@query("t17_linear_trend", """
    , y as (select survey_year, cast(sum(n) as bigint) total from cust_panel group by 1),
    f as (select regr_slope(total, survey_year) s, regr_intercept(total, survey_year) i, min(survey_year) a, max(survey_year) b from y),
    g as (select f.*, unnest(generate_series(a, b + 3)) period from f)
    select period::int period, round(i + s * period, 4) fitted, period > b is_forecast, round(s / (i + s * b), 6) growth_per_year, total actual
    from g left join y on y.survey_year = period""", "cust_panel")
def _(t: Tables):
    y = t.cust_panel.groupBy("survey_year").agg(F.sum("n").alias("total"))
    return rounded(rounded(sm.linear_trend(y, "survey_year", "total"), ["fitted"], 4), ["growth_per_year"])


@query("t11_interval_coverage", """
    , e as (select unitid, k / n p, n from cohort), t as (select l_partkey unitid, avg(cast(l_linestatus = 'F' as int)) truth from lineitem group by 1)
    select round(avg(cast(truth between p - 1.64 * sqrt(p * (1 - p) / n) and p + 1.64 * sqrt(p * (1 - p) / n) as int)), 6) share, count(*) n from e join t using (unitid)""", "cohort")
def _(t: Tables):
    truth = t.lineitem.groupBy(F.col("l_partkey").alias("unitid")).agg(F.avg((F.col("l_linestatus") == "F").cast("double")).alias("truth"))
    p = nulls.ratio("k", "n")
    j = t.cohort.join(truth, "unitid").withColumns({"p": p, "hw": F.sqrt(p * (1 - p) / F.col("n")) * 1.64})
    return rounded(sm.share_in(j, F.col("truth").between(F.col("p") - F.col("hw"), F.col("p") + F.col("hw"))), ["share"])


@query("t11_ranking_overlap", """
    , a as (select unitid from cohort order by k / n desc, unitid limit 50), b as (select unitid from cohort order by (k + 10) / (n + 30) desc, unitid limit 50)
    select count(*) n_both from a join b using (unitid)""", "cohort")
def _(t: Tables):
    c = t.cohort.withColumns({"raw": nulls.ratio("k", "n"), "shrunk": (F.col("k") + 10) / (F.col("n") + 30)})
    return sm.pairwise_overlap(pn.top_n(c, F.desc("raw"), "unitid", 50), pn.top_n(c, F.desc("shrunk"), "unitid", 50), "unitid")
