"""Queries over lags, ranks, quantile bins, sorts and set operations (W and O families)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import guards, ordering
from ..operators import panel as pn
from ..operators import peers as pe
from . import joined
from .derived import rounded
from .registry import query
from .tables import Tables, years_of

R = F.round


@query("w01_lags", """
    select unitid, survey_year, lag(n, 1) over w n_lag1, lag(n, 2) over w n_lag2, lag(n, 3) over w n_lag3 from cust_panel
    window w as (partition by unitid order by survey_year)""", "cust_panel")
def _(t: Tables):
    p = guards.assert_unique(t.once("cust_panel").select("unitid", "survey_year", "n"), ["unitid", "survey_year"], "panel")
    return pn.lags(p, "unitid", "survey_year", "n", 3).drop("n")


@query("w02_rolling_prior_mean", """
    select unitid, survey_year, round(case when count(n) over w = 3 then avg(n) over w end, 6) n_roll3 from cust_panel
    window w as (partition by unitid order by survey_year rows between 3 preceding and 1 preceding)""", "cust_panel")
def _(t: Tables):
    p = pn.rolling_prior_mean(t.cust_panel, "unitid", "survey_year", "n")
    return p.select("unitid", "survey_year", R("n_roll3", 6).alias("n_roll3"))


@query("w03_within_transform", """
    select unitid, survey_year, round(n - avg(n) over (partition by unitid), 6) n,
      round(total_enrollment - avg(total_enrollment) over (partition by unitid), 4) total_enrollment from cust_panel""", "cust_panel")
def _(t: Tables):
    w = pn.within(t.cust_panel, "unitid", ["n", "total_enrollment"])
    return w.select("unitid", "survey_year", R("n", 6).alias("n"), R("total_enrollment", 4).alias("total_enrollment"))


@query("w04_above_group_median", """
    select unitid, survey_year, cast(total_enrollment > median(total_enrollment) over (partition by sector) as int) above_median from cust_panel""", "cust_panel")
def _(t: Tables):
    return pn.above_group_median(t.cust_panel, "sector", "total_enrollment").select("unitid", "survey_year", "above_median")


@query("w05_duplicate_keys", """
    select l_orderkey, l_linenumber, n_rows from (select l_orderkey, l_linenumber, count(*) n_rows from lineitem group by 1, 2) where n_rows > 1""")
def _(t: Tables):
    return guards.repeated_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("w06_average_rank", """
    , r as (select unitid, survey_year, n, total_enrollment, rank() over (partition by survey_year order by n) a, rank() over (partition by survey_year order by n desc) d,
      count(*) over (partition by survey_year, n) c from cust_panel)
    select unitid, survey_year, a + (c - 1) / 2 rank_up, d + (c - 1) / 2 rank_down from r""", "cust_panel")
def _(t: Tables):
    p = t.once("cust_panel").select("unitid", "survey_year", "n")
    up = ordering.average_rank(p, ["survey_year"], "n", "rank_up")
    return ordering.average_rank(up, ["survey_year"], "n", "rank_down", descending=True).drop("n")


@query("w07_focal_percentile", """
    , f as (select n v from cust_panel where unitid = 7 and survey_year = 1997)
    select sector, round(avg(cast(n < v as int)), 6) share_below from cust_panel, f group by 1""", "cust_panel")
def _(t: Tables):
    focal = t.once("cust_panel").filter("unitid = 7 and survey_year = 1997").agg(F.max("n").alias("v")).scalar()
    p = t.once("cust_panel").withColumn("_focal", focal).filter("_focal is not null")
    return p.groupBy("sector").agg(R(ordering.share_below(p, "n", F.col("_focal")), 6).alias("share_below"))


@query("w08_robust_z", """
    , m as (select sector, median(n) mn, median(total_enrollment) mt from cust_panel group by 1),
    d as (select sector, median(abs(n - mn)) * 1.4826 dn, median(abs(total_enrollment - mt)) * 1.4826 dt from cust_panel join m using (sector) group by 1)
    select unitid, survey_year, round(case when dn > 1e-9 then least(greatest((n - mn) / dn, -3), 3) end, 6) z_n,
      round(case when dt > 1e-9 then least(greatest(-(total_enrollment - mt) / dt, -3), 3) end, 6) z_total_enrollment
    from cust_panel join m using (sector) join d using (sector)""", "cust_panel")
def _(t: Tables):
    z = pn.robust_z(t.once("cust_panel"), ["sector"], {"n": 1, "total_enrollment": -1})
    return rounded(z.select("unitid", "survey_year", "z_n", "z_total_enrollment"), ["z_n", "z_total_enrollment"])


@query("w09_top_per_group", """
    select c_mktsegment, c_custkey, c_acctbal from customer qualify row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) <= 5""")
def _(t: Tables):
    return pn.top_n_per_group(t.customer, "c_mktsegment", F.desc("c_acctbal"), "c_custkey", 5).select("c_mktsegment", "c_custkey", "c_acctbal")


@query("w09_largest_overall", """
    select c_custkey, c_acctbal from customer order by abs(c_acctbal) desc, c_custkey limit 8""")
def _(t: Tables):
    return pn.top_n(t.customer, F.desc(F.abs("c_acctbal")), "c_custkey", 8).select("c_custkey", "c_acctbal")


@query("w10_quantile_bins", """
    , e as (select c_mktsegment, quantile_cont(c_acctbal, 1 / 3) a, quantile_cont(c_acctbal, 2 / 3) b from quasi group by 1)
    select unitid, 1 + cast(c_acctbal > a as int) + cast(c_acctbal > b as int) tercile from quasi join e using (c_mktsegment)""", "quasi")
def _(t: Tables):
    return ordering.quantile_bins(t.quasi, ["c_mktsegment"], "c_acctbal", 3, "tercile").select("unitid", "tercile")


@query("w10_map_breaks", """
    , s as (select list(c_acctbal order by c_acctbal) v from quasi),
    b as (select v[1 + floor(0.2 * (len(v) - 1))::int] b1, v[1 + floor(0.4 * (len(v) - 1))::int] b2, v[1 + floor(0.6 * (len(v) - 1))::int] b3,
      v[1 + floor(0.8 * (len(v) - 1))::int] b4 from s)
    select unitid, 1 + (c_acctbal >= b1)::int + (c_acctbal >= b2)::int + (c_acctbal >= b3)::int + (c_acctbal >= b4)::int shade from quasi, b""", "quasi")
def _(t: Tables):
    b = ordering.picks(t.quasi, [], "c_acctbal", {"b1": .2, "b2": .4, "b3": .6, "b4": .8})
    q = t.quasi.withColumn("_b", b.select(F.struct("b1", "b2", "b3", "b4").alias("b")).scalar())
    shade = reduce(lambda a, i: a + (F.col("c_acctbal") >= F.col(f"_b.b{i}")).cast("int"), (1, 2, 3, 4), F.lit(1))
    return q.select("unitid", shade.alias("shade"))


_PEER_SQL = joined._NEAR_SQL + """,
    near as (select u.unitid from used u, tgt, st order by sqrt(pow((u.x1 - tgt.x1) / s1, 2) + pow((u.price - tgt.price) / s2, 2) + pow((u.bal - tgt.bal) / s3, 2)), 1 limit 8)"""


@query("w11_peer_series", _PEER_SQL + """
    , m as (select survey_year, median(total_enrollment) med from cust_panel where unitid in (select unitid from near) group by 1)
    select survey_year, round(p.total_enrollment, 2) own, round(med, 2) peer_median, round(p.total_enrollment / med - 1, 6) rel_diff
    from cust_panel p left join m using (survey_year) where p.unitid = 7""", "cust_panel")
def _(t: Tables):
    near = pe.nearest_peers(joined._near(t), 7, ["fte", "price", "bal"], "fte", 8)
    s = pe.peer_series(t.once("cust_panel"), near, "unitid", "survey_year", "total_enrollment", 7)
    return s.select("survey_year", R("own", 2).alias("own"), R("peer_median", 2).alias("peer_median"), R("rel_diff", 6).alias("rel_diff"))


@query("w11_peer_benchmark", _PEER_SQL + """
    , g as (select 'fte' metric, unitid, cast(fte as double) v from f union all select 'price', unitid, price from f union all select 'bal', unitid, bal from f),
    m as (select metric, median(v) med, count(*) n from g where unitid in (select unitid from near) group by 1)
    select metric, round(v, 4) own, round(med, 4) peer_median, n, round(v / med - 1, 6) rel_diff from g join m using (metric) where unitid = 7""", "cust_panel")
def _(t: Tables):
    near = pe.nearest_peers(joined._near(t), 7, ["fte", "price", "bal"], "fte", 8)
    b = pe.benchmark(joined._near(t), near, "unitid", 7, ["fte", "price", "bal"])
    return b.select("metric", R("own", 4).alias("own"), R("peer_median", 4).alias("peer_median"), "n", R("rel_diff", 6).alias("rel_diff"))


@query("o01_nulls_last_page", """
    select unitid, b from (select unitid, case when band >= 3 then band end b from quasi) order by b desc nulls last, unitid limit 100""", "quasi")
def _(t: Tables):
    q = t.quasi.select("unitid", F.when(F.col("band") >= 3, F.col("band")).alias("b"))
    return q.orderBy(F.desc_nulls_last("b"), "unitid").limit(100)


@query("o02_list_order_sort", """
    select c_custkey, c_mktsegment, row_number() over (order by case c_mktsegment when 'MACHINERY' then 1 when 'BUILDING' then 2 else 3 end, c_acctbal desc, c_custkey) as position
    from customer""")
def _(t: Tables):
    dim = t.spark.createDataFrame([("MACHINERY", 1), ("BUILDING", 2)], "c_mktsegment string, o int")
    d = t.customer.join(dim, "c_mktsegment", "left").select("c_custkey", "c_mktsegment", F.coalesce("o", F.lit(3)).alias("o"),
                                                            (-F.col("c_acctbal")).alias("neg"))
    at = ordering.row_positions(d.select("c_custkey", "o", "neg"), [], ["o", "neg", "c_custkey"])
    return at.join(d.select("c_custkey", "c_mktsegment"), "c_custkey").select("c_custkey", "c_mktsegment", "position")


@query("o03_union_with_overall", """
    select coalesce(cast(survey_year as varchar), 'all') part, cast(sum(n) as bigint) n from cust_panel group by rollup (survey_year)""", "cust_panel")
def _(t: Tables):
    by = t.cust_panel.groupBy(F.col("survey_year").cast("string").alias("part")).agg(F.sum("n").alias("n"))
    return by.unionByName(t.cust_panel.agg(F.sum("n").alias("n")).withColumn("part", F.lit("all")))


@query("o04_first_by_key", """
    select o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) first_order, count(distinct o_orderstatus) statuses from orders group by 1""")
def _(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("first_order"),
                                             F.count_distinct("o_orderstatus").alias("statuses"))


@query("o05_set_difference", """
    (select c_custkey unitid, 'only customers' side from customer except select p_partkey, 'only customers' from part)
    union all (select p_partkey, 'only parts' from part except select c_custkey, 'only parts' from customer)""")
def _(t: Tables):
    a = t.customer.select(F.col("c_custkey").alias("unitid"))
    b = t.part.select(F.col("p_partkey").alias("unitid"))
    return a.exceptAll(b).withColumn("side", F.lit("only customers")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("only parts")))


@query("a11_balanced_panel", """
    select unitid, survey_year, n from cust_panel where unitid in
      (select unitid from cust_panel group by 1 having count(distinct survey_year) = (select count(distinct survey_year) from cust_panel))""", "cust_panel")
def _(t: Tables):
    return pn.balanced(t.once("cust_panel"), "unitid", "survey_year", "n").select("unitid", "survey_year", "n")


@query("a12_balanced_vs_unbalanced", """
    , b as (select * from cust_panel where unitid in
      (select unitid from cust_panel group by 1 having count(distinct survey_year) = (select count(distinct survey_year) from cust_panel)))
    select sector, survey_year, round(unbalanced, 6) unbalanced, round(balanced, 6) balanced from
      (select sector, survey_year, avg(n) unbalanced from cust_panel group by 1, 2) left join
      (select sector, survey_year, avg(n) balanced from b group by 1, 2) using (sector, survey_year)""", "cust_panel")
def _(t: Tables):
    every = pn.trend_by_group(t.once("cust_panel"), "sector", "survey_year", "n", "unbalanced")
    bal = pn.trend_by_group(pn.balanced(t.once("cust_panel"), "unitid", "survey_year", "n"), "sector", "survey_year", "n", "balanced")
    return rounded(every.join(bal, ["sector", "survey_year"], "left"), ["unbalanced", "balanced"])


@query("b12_cohort_collapse", """
    select unitid, """ + ", ".join(f"max(n) filter (survey_year = {y}) y{y}" for y in range(1995, 2002)) + """
    from cust_panel group by 1""", "cust_panel")
def _(t: Tables):
    return fe.year_pivot(t.cust_panel, ["unitid"], "survey_year", "n", years_of(t.cust_panel))
