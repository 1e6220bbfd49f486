"""Queries over the explorer's panels and serving documents (A16-A22, K5, K6, S20)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import nulls
from ..operators import cleaning
from ..operators import serving as sv
from ..operators.lineage import run_dir
from ..sources import sinks
from .derived import rounded
from .registry import query
from .tables import Tables, years_of

R = F.round


def _universe(t: Tables):
    return t.once("cust_panel").join(
        t.customer.select(F.col("c_custkey").alias("unitid"), F.col("c_nationkey").alias("level"), "c_acctbal"), "unitid")


_U = """
    , u as (select p.*, c_nationkey as "level", c_acctbal from cust_panel p join customer on unitid = c_custkey),
    v as (select * from u where sector in ('BUILDING', 'MACHINERY'))"""


def _view(t: Tables):
    return cleaning.facet_filter(_universe(t), within={"sector": ["BUILDING", "MACHINERY"]})


def _tone(share):
    return "'flat'" if share else "case when abs(value / universe_value - 1) < 0.01 then 'flat' when value / universe_value - 1 > 0 then 'up' else 'down' end"


@query("a16_kpi_block", _U + f"""
    , k as (select 'rows' metric, (select count(*)::double from v) as value, (select count(*)::double from u) universe_value union all
      select 'size', (select sum(n)::double from v), (select sum(n)::double from u)),
    m as (select 'total_enrollment' metric, (select median(total_enrollment) from v) as value, (select median(total_enrollment) from u) universe_value union all
      select 'c_acctbal', (select median(c_acctbal) from v), (select median(c_acctbal) from u))
    select metric, round(value, 4) as value, round(universe_value, 4) universe_value, round(value / universe_value, 6) rel_diff, {_tone(True)} tone from k
    union all select metric, round(value, 4), round(universe_value, 4), round(value / universe_value - 1, 6), {_tone(False)} from m""", "cust_panel")
def _(t: Tables):
    k = sv.kpi_block(_view(t), _universe(t), "n", ["total_enrollment", "c_acctbal"])
    return rounded(rounded(k, ["value", "universe_value"], 4), ["rel_diff"])


@query("a17_level_rates", _U + """
    select "level", count(total_enrollment) n, round(median(total_enrollment), 4) view_median, null::double universe_median, null::double rel_diff, 'flat' tone from v group by 1""", "cust_panel")
def _(t: Tables):
    return rounded(sv.level_rates(_view(t), _universe(t), "level", "total_enrollment"), ["view_median", "universe_median", "rel_diff"], 4)


@query("a17_single_level_rate", _U + """
    , a as (select median(total_enrollment) x, count(*) n from v where "level" = 4), b as (select median(total_enrollment) y from u where "level" = 4)
    select 4 as "level", n, round(x, 4) view_median, round(y, 4) universe_median, round(x / y - 1, 4) rel_diff,
      case when abs(x / y - 1) < 0.01 then 'flat' when x > y then 'up' else 'down' end tone from a, b""", "cust_panel")
def _(t: Tables):
    one = cleaning.facet_filter(_view(t), within={"level": [4]})
    return rounded(sv.level_rates(one, _universe(t), "level", "total_enrollment"), ["view_median", "universe_median", "rel_diff"], 4)


@query("a19_scatter_extract", """
    , s as (select list(n order by n) l from cust_panel)
    select unitid, survey_year, round(total_enrollment, 2) total_enrollment, n, round(n / l[1 + floor(0.9 * (len(l) - 1))::int], 6) rel_size from cust_panel, s""", "cust_panel")
def _(t: Tables):
    s = sv.scatter_extract(t.once("cust_panel"), "total_enrollment", "n", "n", ["unitid", "survey_year"])
    return rounded(rounded(s.select("unitid", "survey_year", "total_enrollment", t.once("cust_panel")["n"], "rel_size"), ["total_enrollment"], 2), ["rel_size"])


@query("a20_group_series", """
    , g as (select control, survey_year, sum(total_revenue) m, sum(total_enrollment) f from sup_panel group by 1, 2)
    select control, survey_year, round(m, 0) money, f fte, round(m / f, 4) per_fte from g""", "sup_panel")
def _(t: Tables):
    g = sv.group_series(t.sup_panel, "control", "survey_year", "total_revenue", "total_enrollment")
    return rounded(rounded(g, ["money"], 0), ["per_fte"], 4)


@query("a20_group_change", """
    select board, round(arg_min(funding, year), 0) first_value, round(arg_max(funding, year), 0) last_value, round(arg_max(funding, year) / arg_min(funding, year) - 1, 6) change,
      round(max(funding), 0) peak, arg_max(year, funding) peak_year from board_year group by 1""", "board_year")
def _(t: Tables):
    return rounded(rounded(sv.group_change(t.board_year, "board", "year", "funding"), ["first_value", "last_value", "peak"], 0), ["change"])


@query("a20_group_membership", """
    select r_name board, n_name member, n_nationkey control from nation join region on n_regionkey = r_regionkey""")
def _(t: Tables):
    return t.boards.join(t.nation, F.col("control") == F.col("n_nationkey")).select("board", F.col("n_name").alias("member"), "control")


@query("a21_unit_finance", """
    , w as (select unitid, sum(total_enrollment) filter (survey_year = 2000) f1, sum(total_enrollment) filter (survey_year = 1996) f0,
       sum(tuition_revenue + completers) filter (survey_year = 2000) c1, sum(tuition_revenue + completers) filter (survey_year = 1996) c0,
       sum(completers) filter (survey_year = 2000) s, sum(tuition_revenue) filter (survey_year = 2000) n, sum(total_revenue) filter (survey_year = 2000) d from sup_panel group by 1)
    select unitid, f1 fte, round(c1 / f1, 4) core_per_fte, round((c1 / f1) / (c0 / f0) - 1, 6) core_change, round(s / c1, 6) state_share, round(d / (n + d), 6) discount_rate from w""", "sup_panel")
def _(t: Tables):
    u = sv.unit_finance(t.sup_panel, "unitid", "survey_year", 1996, 2000, "total_enrollment", ["tuition_revenue", "completers"], "completers",
                        "tuition_revenue", "total_revenue").drop("core")
    return rounded(rounded(u, ["core_per_fte"], 4), ["core_change", "state_share", "discount_rate"])


_TWO = """
    , l as (select board, x.line, x.a, x.b, f0, f1 from (select board, sum(fte) filter (year = 1999) f0, sum(fte) filter (year = 2000) f1,
        sum(funding) filter (year = 1999) a1, sum(funding) filter (year = 2000) b1, sum(tuition) filter (year = 1999) a2, sum(tuition) filter (year = 2000) b2,
        sum(completers)::double filter (year = 1999) a3, sum(completers)::double filter (year = 2000) b3 from board_year group by 1),
      lateral (values ('funding', a1, b1), ('tuition', a2, b2), ('completers', a3, b3)) x(line, a, b))""".replace(")::double filter", ") filter")


@query("a22_two_year_totals", _TWO + """
    select board, line, round(a, 0)::double "first", round(b, 0)::double "last", round(case when a > 0 then b / a - 1 end, 6) change from l where greatest(abs(a), abs(b)) >= 500000""", "board_year")
def _(t: Tables):
    x = sv.two_year_lines(t.board_year, "board", "year", ["funding", "tuition", "completers"], 1999, 2000)
    return rounded(rounded(x, ["first", "last"], 0), ["change"])


@query("a22_two_year_per_fte", _TWO + """
    select board, line, round(a / f0, 4) "first", round(b / f1, 4) "last", round((b / f1) / (a / f0) - 1, 6) change from l where greatest(abs(a), abs(b)) >= 500000""", "board_year")
def _(t: Tables):
    x = sv.two_year_lines(t.board_year, "board", "year", ["funding", "tuition", "completers"], 1999, 2000, fte="fte")
    return rounded(rounded(x, ["first", "last"], 4), ["change"])


def _records(t: Tables):
    return sv.serving_records(t.once("cust_panel"), "unitid", "survey_year", ["n"], ["sector"])


@query("k05_serving_records", """
    , y as (select distinct survey_year from cust_panel), u as (select unitid, any_value(sector) sector from cust_panel group by 1),
    g as (select u.unitid, u.sector, y.survey_year, p.n from u, y left join cust_panel p on p.unitid = u.unitid and p.survey_year = y.survey_year)
    select '{"unitid":' || unitid || ',"sector":"' || any_value(sector) || '","n":[' || string_agg(coalesce(n::varchar, 'null'), ',' order by survey_year) || ']}' record from g group by unitid""", "cust_panel")
def _(t: Tables):
    return sv.to_json_records(_records(t))


@query("s20_serving_roundtrip", """
    , y as (select distinct survey_year from cust_panel), u as (select unitid from cust_panel group by 1)
    select u.unitid, y.survey_year as year, p.n from u, y left join cust_panel p on p.unitid = u.unitid and p.survey_year = y.survey_year""", "cust_panel")
def _(t: Tables):
    path = f"{run_dir(t.spark)}/{uuid.uuid4().hex}"
    years = F.array_sort(F.collect_set("survey_year"))
    rec = _records(t).withColumn("years", t.once("cust_panel").agg(years).scalar())
    sinks.write_serving(rec, {"source": "panel"}, path)
    back, _ = sinks.read_serving(t.spark, path, "unitid bigint, sector string, n array<bigint>, years array<int>")
    return sv.long_series(back, "unitid", "years", ["n"]).select("unitid", "year", "n")


@query("k06_extract_with_years", """
    , w as (select unitid, any_value(sector) sector, """ + ", ".join(f"max(n) filter (survey_year = {y}) n_{y}" for y in range(1995, 2002)) + """, sum(n) s from cust_panel group by 1)
    select unitid, sector, round(s / (select count(distinct survey_year) from cust_panel), 6) rate, """ + ", ".join(f"n_{y}" for y in range(1995, 2002)) + """ from w""", "cust_panel")
def _(t: Tables):
    tot = t.cust_panel.groupBy("unitid").agg(F.sum("n").alias("s"))
    years = years_of(t.cust_panel)
    d = t.cust_panel.join(tot, "unitid").withColumn("rate", R(nulls.ratio("s", F.lit(len(years))), 6))
    held = cleaning.hold_small_cohorts(d, {"rate": "s"}, 8)
    return sinks.export_extract(held, ["unitid", "sector"], ["rate"], "survey_year", "n", years)


@query("k07_column_dictionary", """
    select 'unitid' as "column", count(*) non_missing from quasi union all select 'band', count(case when band >= 0 then 1 end) from quasi union all select 'c_mktsegment', count(*) from quasi""", "quasi")
def _(t: Tables):
    q = t.quasi.select("unitid", F.when(F.col("band") >= 0, F.col("band")).alias("band"), "c_mktsegment")
    return sinks.column_dictionary(q).drop("type")


@query("k07_csv_roundtrip", "select c_mktsegment, count(*) n, round(sum(c_acctbal), 2) balance from customer group by 1")
def _(t: Tables):
    path = f"{run_dir(t.spark)}/{uuid.uuid4().hex}"
    sinks.write_csv(t.customer.select("c_mktsegment", "c_acctbal"), path)
    back = t.spark.read.csv(path, header=True, schema="c_mktsegment string, c_acctbal double")
    return back.groupBy("c_mktsegment").agg(F.count("*").alias("n"), R(F.sum("c_acctbal"), 2).alias("balance"))


def landed(t: Tables, df, fmt="parquet", **options) -> str:
    path = f"{run_dir(t.spark)}/{uuid.uuid4().hex}"
    df.write.format(fmt).options(**options).save(path)
    return path

