"""Queries over the join operators (J family)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nulls
from ..operators import features as fe
from ..operators import panel as pn
from ..operators import peers as pe
from .derived import rounded
from .registry import query
from .tables import Tables

R = F.round
K = ["unitid", "survey_year"]


@query("j01_build_panel", """
    select unitid, survey_year, n, round(admits / applicants, 6) admit_rate, round(completers / cohort_size, 6) completion_rate_150pct
    from cust_panel left join (select unitid, survey_year, admits, applicants, completers, cohort_size from sup_panel) using (unitid, survey_year)""",
       "cust_panel sup_panel")
def _(t: Tables):
    sel = fe.selectivity(t.sup_panel).select(*K, "admit_rate")
    gr = fe.completion_rate(t.sup_panel.select(*K, F.col("completers").alias("completers_150pct"), "cohort_size"))
    base = t.cust_panel.select(*K, "n")
    return rounded(pn.build_panel(base, sel, None, gr), ["admit_rate", "completion_rate_150pct"])


@query("j02_one_to_one", """
    select c_custkey unitid, c_name, n_orders from customer left join (select o_custkey, count(*) n_orders from orders group by 1) on o_custkey = c_custkey""")
def _(t: Tables):
    per = t.orders.groupBy(F.col("o_custkey").alias("unitid")).agg(F.count("*").alias("n_orders"))
    return pn.one_to_one(t.customer.select(F.col("c_custkey").alias("unitid"), "c_name"), per, ["unitid"])


@query("j03_component_inner_join", """
    select a.unitid, a.survey_year, a.n, b.admits from cust_panel a join sup_panel b using (unitid, survey_year)""", "cust_panel sup_panel")
def _(t: Tables):
    return t.cust_panel.select(*K, "n").join(t.sup_panel.select(*K, "admits"), K)


@query("j04_attach_attributes", """
    select unitid, survey_year, c_mktsegment carnegie_basic from sup_panel left join customer on unitid = c_custkey""", "sup_panel")
def _(t: Tables):
    classes = t.customer.select(F.col("c_custkey").alias("unitid"), F.col("c_mktsegment").alias("carnegie_basic"))
    return pn.attach_attributes(t.sup_panel.select(*K), classes, "unitid", ["carnegie_basic"])


@query("j05_effective_dated_crosswalk", """
    , r as (select p.*, c.unitid_to, row_number() over (partition by p.unitid, p.survey_year order by c.ordinal) rn
      from cust_panel p left join changes c on c.unitid_from = p.unitid and p.survey_year <= c.effective_year)
    select coalesce(unitid_to, unitid) unitid, survey_year, cast(sum(n) as bigint) n, count(*) merged from r where rn = 1 group by 1, 2""",
       "cust_panel changes")
def _(t: Tables):
    moved = pn.apply_crosswalk(t.cust_panel, t.once("changes"))
    return moved.groupBy(*K).agg(F.sum("n").alias("n"), F.count("*").alias("merged"))


@query("j06_closed_entities", """
    select unitid_from unitid, effective_year closed_year from changes where unitid_from = unitid_to and lower(reason) = 'closed'""", "changes")
def _(t: Tables):
    return pn.closed_entities(t.changes)


@query("j06_without_closed", """
    select survey_year, count(*) n from cust_panel where unitid not in (select unitid_from from changes where unitid_from = unitid_to and lower(reason) = 'closed')
    group by 1""", "cust_panel changes")
def _(t: Tables):
    return t.cust_panel.join(pn.closed_entities(t.once("changes")), "unitid", "left_anti").groupBy("survey_year").agg(F.count("*").alias("n"))


@query("j07_rule_peers", """
    , s as (select unitid, survey_year, sector, n, total_enrollment from cust_panel),
    tgt as (select * from s where unitid = 7 and survey_year = 1997)
    select s.unitid, round(s.total_enrollment, 2) size from s, tgt where s.survey_year = 1997 and s.unitid <> 7 and s.sector = tgt.sector
      and s.total_enrollment between tgt.total_enrollment * 0.75 and tgt.total_enrollment * 1.25""", "cust_panel")
def _(t: Tables):
    p = pe.rule_peers(t.once("cust_panel"), 7, 1997, ["sector"], missing_ok=True)
    return p.select("unitid", R("total_enrollment", 2).alias("size"))


@query("j07_all_targets_peer_mean", """
    , s as (select unitid, survey_year, sector, n, total_enrollment x from cust_panel)
    select a.unitid, a.survey_year, count(b.unitid) n_peers, round(avg(b.n), 6) peer_mean
    from s a left join s b on a.survey_year = b.survey_year and a.sector = b.sector and a.unitid <> b.unitid
      and b.x between a.x * 0.75 and a.x * 1.25 group by 1, 2""", "cust_panel")
def _(t: Tables):
    out = pe.peer_band_summary(t.once("cust_panel"), ["survey_year", "sector"], "unitid", "total_enrollment", "n")
    return out.select("unitid", "survey_year", "n_peers", R("peer_mean", 6).alias("peer_mean"))


_NEAR_SQL = """
    , d as (select unitid, count(*) n_years, any_value(sector) control, sum(n) fte, avg(total_enrollment) price from cust_panel group by 1),
    f as (select d.*, n_years as "level", c_nationkey family, c_acctbal bal, log10(greatest(1, fte)) x1 from d join customer on unitid = c_custkey),
    tgt as (select * from f where unitid = 7),
    pool as (select f.*, cast(f.control = tgt.control and f."level" = tgt."level" and f.family = tgt.family as int) t1,
        cast(f.control = tgt.control and f."level" = tgt."level" as int) t2, cast(f."level" = tgt."level" as int) t3
      from f, tgt where f.unitid <> 7),
    tier as (select case when sum(t1) >= 8 then 1 when sum(t2) >= 8 then 2 when sum(t3) >= 8 then 3 end k from pool),
    used as (select pool.* from pool, tier where case k when 1 then t1 when 2 then t2 else t3 end = 1),
    st as (select avg(x1) m1, stddev_samp(x1) s1, avg(price) m2, stddev_samp(price) s2, avg(bal) m3, stddev_samp(bal) s3 from used)"""


def _near(t: Tables):
    d = t.once("cust_panel").groupBy("unitid").agg(F.count("*").alias("level"), F.any_value("sector").alias("control"),
                                           F.sum("n").alias("fte"), F.avg("total_enrollment").alias("price"))
    c = t.customer.select(F.col("c_custkey").alias("unitid"), F.col("c_nationkey").alias("family"), F.col("c_acctbal").alias("bal"))
    return d.join(c, "unitid")


@query("j08_nearest_peers", _NEAR_SQL + """
    select u.unitid, round(sqrt(pow((u.x1 - tgt.x1) / s1, 2) + pow((u.price - tgt.price) / s2, 2) + pow((u.bal - tgt.bal) / s3, 2)), 6) distance
    from used u, tgt, st order by 2, 1 limit 8""", "cust_panel")
def _(t: Tables):
    near = pe.nearest_peers(_near(t), 7, ["fte", "price", "bal"], "fte", 8)
    return near.select("unitid", R("distance", 6).alias("distance"))


def _published(t: Tables):
    model = t.cohort.select("unitid", nulls.ratio("k", "n").alias("rate"))
    # the same rate as another office counts it: by units returned instead of lines
    pub = t.lineitem.groupBy(F.col("l_partkey").alias("unitid")).agg(nulls.ratio(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)), F.sum("l_quantity")).alias("rate"))
    return pn.compare_to_published(model, pub, ["unitid"], "rate", 0.01)


_COMPARE_SQL = """
    , c as (select m.unitid, k / n a, p.rate b, abs(k / n - p.rate) d from cohort m join (
      select l_partkey unitid, sum(case when l_returnflag = 'R' then l_quantity else 0 end) / sum(l_quantity) rate from lineitem group by 1) p using (unitid))"""


@query("j09_compare_to_published", _COMPARE_SQL + """
    select unitid, round(a, 6) rate_model, round(b, 6) rate_published, round(d, 6) abs_diff, d <= 0.01 within_tolerance from c""", "cohort")
def _(t: Tables):
    return rounded(_published(t), ["rate_model", "rate_published", "abs_diff"])


@query("a25_comparison_summary", _COMPARE_SQL + """
    select count(*) n, round(avg(d), 6) mean_abs_diff, round(avg(cast(d <= 0.01 as int)), 6) share_within from c""", "cohort")
def _(t: Tables):
    return rounded(pn.comparison_summary(_published(t)), ["mean_abs_diff", "share_within"])


@query("a25_label_agreement", """
    select round(avg(cast(l_linestatus = o_orderstatus as int)), 6) agreement, count(*) n from lineitem join orders on l_orderkey = o_orderkey""")
def _(t: Tables):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(pn.agreement_share(j, "l_linestatus", "o_orderstatus"), ["agreement"])


@query("j10_linkage_attack", """
    , r as (select *, case when band >= 0 then band end b from quasi),
    rel as (select c_nationkey, c_mktsegment, b, count(*) n from r group by 1, 2, 3),
    reference as (select c_nationkey, c_mktsegment, b, count(*) m from r group by 1, 2, 3)
    select cast(sum(n) as bigint) n_rows, cast(sum(case when m = 1 then n else 0 end) as bigint) n_linked,
      round(sum(case when m = 1 then n else 0 end) / sum(n), 6) linked_share
    from rel join reference f on rel.c_nationkey = f.c_nationkey and rel.c_mktsegment = f.c_mktsegment and rel.b is not distinct from f.b""", "quasi")
def _(t: Tables):
    q = t.quasi.withColumn("b", F.when(F.col("band") >= 0, F.col("band")))
    return rounded(pe.linkage_share(q, q, ["c_nationkey", "c_mktsegment", "b"]), ["linked_share"])


@query("j11_orphans", """
    select l_suppkey, count(*) n from lineitem where l_partkey not in (select c_custkey from customer) group by 1""")
def _(t: Tables):
    o = pn.orphans(t.lineitem, t.customer.select(F.col("c_custkey").alias("l_partkey")), "l_partkey")
    return o.groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("j11_membership", """
    select o_custkey, count(*) n from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000) group by 1""")
def _(t: Tables):
    rich = t.customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return pn.semi(t.orders, rich, ["o_custkey"]).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("j12_record_assembly", """
    select s_suppkey unitid, s_name, n_name, r_name, cast(lines as bigint) as lines, round(fte, 0) fte from supplier
    left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey
    left join (select l_suppkey, count(*) "lines", sum(l_quantity) fte from lineitem group by 1) on l_suppkey = s_suppkey""")
def _(t: Tables):
    base = t.supplier.select(F.col("s_suppkey").alias("unitid"), "s_name", "s_nationkey")
    place = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")).withColumnRenamed("s_suppkey", "unitid")
    size = t.lineitem.groupBy(F.col("l_suppkey").alias("unitid")).agg(F.count("*").alias("lines"), R(F.sum("l_quantity"), 0).alias("fte"))
    return pn.assemble(base, {"place": (place, ["n_name", "r_name"]), "size": (size, ["lines", "fte"])}).drop("s_nationkey")


@query("j13_attach_outcomes", """
    , o as (select c_custkey unitid, lpad(cast(c_nationkey as varchar), 6, '0') family, c_mktsegment = 'BUILDING' main,
        case when c_acctbal > 0 then c_acctbal end debt from customer where c_acctbal < 9000),
    r as (select c.c_custkey unitid, f.fte, o.* exclude unitid from customer c left join o on o.unitid = c.c_custkey
      left join (select o_custkey, count(*) fte from orders group by 1) f on f.o_custkey = c.c_custkey)
    select unitid, family, debt, case when family is not null then count(*) over (partition by family) end shared,
      case when family is not null then row_number() over (partition by family order by main desc, coalesce(fte, 0) desc, unitid) = 1 end anchor from r""", "quasi")
def _(t: Tables):
    fte = t.orders.groupBy(F.col("o_custkey").alias("unitid")).agg(F.count("*").alias("fte"))
    records = t.customer.select(F.col("c_custkey").alias("unitid")).join(fte, "unitid", "left")
    out = t.customer.filter("c_acctbal < 9000").select(
        F.col("c_custkey").alias("unitid"), F.lpad(F.col("c_nationkey").cast("string"), 6, "0").alias("family"),
        (F.col("c_mktsegment") == "BUILDING").alias("main"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("debt"))
    return pn.attach_outcomes(records, out, "fte", ["debt"]).drop("fte")


@query("j14_state_panel_attach", """
    , l as (select c_nationkey unitid, c_name, sum(n) resident from cust_panel join customer on unitid = c_custkey
       where survey_year = (select max(survey_year) from cust_panel) group by 1, 2)
    select n_nationkey unitid, cast(resident as bigint) resident, campuses from nation left join
      (select unitid, sum(resident) resident, array_to_string(list(c_name order by c_name), '|') campuses from l group by 1) s on s.unitid = n_nationkey""", "cust_panel")
def _(t: Tables):
    c = t.customer.select(F.col("c_custkey").alias("unitid"), "c_name", "c_nationkey")
    res = t.cust_panel.join(c, "unitid").select(F.col("c_nationkey").alias("unitid"), "survey_year", "n", "c_name")
    base = t.nation.select(F.col("n_nationkey").alias("unitid"))
    return pn.attach_state_panel(base, res, "survey_year", "n", "c_name").withColumn("campuses", F.array_join("campuses", "|"))
