"""Queries over data-quality rules and reconciliation checks (Q family)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import nulls
from ..operators import components
from ..operators import quality as q
from ..operators.lineage import run_dir
from ..sources import sinks
from .derived import rounded
from .registry import query
from .tables import Tables


def _results(df):
    return df.select("name", "severity", "n_offending", "share", "sample_ids", "status")


def _rule_sql(rows):
    """Union of (name, severity, offender predicate) over table v with id column i."""
    parts = []
    for name, severity, cond in rows:
        parts.append(f"""select '{name}' "name", '{severity}' severity, count_if(coalesce({cond}, false)) n_offending,
          round_even(count_if(coalesce({cond}, false)) / count(*), 5) share,
          coalesce((select string_agg(cast(i as varchar), ',' order by i) from (select i from v where coalesce({cond}, false) order by i limit 5)), '') sample_ids,
          case when count_if(coalesce({cond}, false)) = 0 then 'pass' else 'fail' end status from v""")
    return "\nunion all ".join(parts)


_LI = """with v as (select l_orderkey * 10 + l_linenumber i, *, count(*) over (partition by l_orderkey, l_linenumber) dup,
    l_partkey not in (select c_custkey from customer) lost from lineitem) """


@query("q01_one_pass_validation", _LI + _rule_sql([
    ("unique_key(l_orderkey,l_linenumber)", "error", "dup > 1"), ("not_null(l_orderkey,l_shipdate)", "error", "l_orderkey is null or l_shipdate is null"),
    ("in_range(l_quantity,2,45)", "warn", "l_quantity < 2 or l_quantity > 45"), ("sums_to(l_extendedprice)", "error", "abs(l_quantity * 100 + l_tax - l_extendedprice) > 5000"),
    ("subset_of(l_returnflag)", "error", "l_returnflag not in ('A', 'N')"), ("referential(l_partkey)", "error", "lost"),
    ("discount_le_tax", "warn", "l_discount > l_tax")]) + """
    union all select 'in_range(absent,0,None)', 'error', -1, null, '', 'error'""")
def _(t: Tables):
    li = t.lineitem.withColumns({"i": F.col("l_orderkey") * 10 + F.col("l_linenumber"), "base": F.col("l_quantity") * 100})
    rules = [q.unique_key("l_orderkey", "l_linenumber"), q.not_null("l_orderkey", "l_shipdate"),
             q.in_range("l_quantity", 2, 45, severity="warn"), q.sums_to("l_extendedprice", ["base", "l_tax"], tolerance=5000),
             q.subset_of("l_returnflag", {"A", "N"}), q.referential("l_partkey", t.customer, "c_custkey"),
             q.custom("discount_le_tax", F.col("l_discount") > F.col("l_tax"), ("l_discount", "l_tax"), severity="warn"),
             q.in_range("absent", 0)]
    return _results(q.validate(li, rules, id_col="i"))


def _one(name, key, fn, sql):
    query(name, sql)(fn)


_one("q02_unique_key", "q02", lambda t: _results(q.validate(
    t.lineitem.withColumn("i", F.col("l_orderkey") * 10 + F.col("l_linenumber")), [q.unique_key("l_orderkey", "l_linenumber")], id_col="i")),
    _LI + _rule_sql([("unique_key(l_orderkey,l_linenumber)", "error", "dup > 1")]))

_one("q03_not_null", "q03", lambda t: _results(q.validate(
    t.customer.select(F.col("c_custkey").alias("i"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("nm")), [q.not_null("i", "nm")], id_col="i")),
    "with v as (select c_custkey i, case when c_acctbal > 0 then c_name end nm from customer) " + _rule_sql([("not_null(i,nm)", "error", "i is null or nm is null")]))

_one("q04_in_range", "q04", lambda t: _results(q.validate(
    t.customer.select(F.col("c_custkey").alias("i"), F.col("c_acctbal").cast("string").alias("bal"), "c_name"),
    [q.in_range("bal", 0, 9000), q.in_range("c_name", 0, 1)], id_col="i")),
    "with v as (select c_custkey i, c_acctbal from customer) " + _rule_sql([("in_range(bal,0,9000)", "error", "c_acctbal < 0 or c_acctbal > 9000"),
                                                                           ("in_range(c_name,0,1)", "error", "false")]))

_one("q06_subset_of", "q06", lambda t: _results(q.validate(
    t.orders.withColumnRenamed("o_orderkey", "i"), [q.subset_of("o_orderstatus", {"F", "O"})], id_col="i")),
    "with v as (select o_orderkey i, o_orderstatus s from orders) " + _rule_sql([("subset_of(o_orderstatus)", "error", "s not in ('F', 'O')")]))

_one("q07_referential", "q07", lambda t: _results(q.validate(
    t.part.withColumnRenamed("p_partkey", "i"), [q.referential("i", t.customer, "c_custkey")], id_col="i")),
    "with v as (select p_partkey i from part) " + _rule_sql([("referential(i)", "error", "i not in (select c_custkey from customer)")]))


@query("q05_sums_to", """
    , v as (select unitid * 10000 + survey_year i, cohort_size total, case when completers > 10 then completers end a, cohort_size - completers b from sup_panel)
    """ + _rule_sql([("sums_to(total)", "error", "abs(coalesce(a, 0) + b - total) > 3")]), "sup_panel")
def _(t: Tables):
    v = t.sup_panel.select((F.col("unitid") * 10000 + F.col("survey_year")).alias("i"), F.col("cohort_size").alias("total"),
                           F.when(F.col("completers") > 10, F.col("completers")).alias("a"), (F.col("cohort_size") - F.col("completers")).alias("b"))
    return _results(q.validate(v, [q.sums_to("total", ["a", "b"], tolerance=3)], id_col="i"))


@query("q08_rolls_up", """
    , d as (select c_nationkey k, yr, c_mktsegment || o_orderstatus cell, n from cells),
    tot as (select k, yr, cast(sum(n) as bigint) s from d group by 1, 2),
    v as (select k * 10000 + yr i, '99' cell, s + case when k < 3 then 1 else 0 end n, s from tot union all select k * 10000 + yr, cell, n, null from d)
    select 'rolls_up(n, cell==99)' "name", 'error' severity, count_if(cell = '99' and n <> s) n_offending, round_even(count_if(cell = '99' and n <> s) / count(*), 5) share,
      (select string_agg(cast(i as varchar), ',' order by i) from (select i from v where cell = '99' and n <> s order by i limit 5)) sample_ids, 'fail' status from v""", "cells")
def _(t: Tables):
    d = t.cells.select(F.col("c_nationkey").alias("k"), "yr", F.concat("c_mktsegment", "o_orderstatus").alias("cell"), "n")
    tot = d.groupBy("k", "yr").agg(F.sum("n").alias("n")).withColumn("cell", F.lit("99"))
    tot = tot.withColumn("n", F.col("n") + (F.col("k") < 3).cast("int"))
    v = d.unionByName(tot).withColumn("i", F.col("k") * 10000 + F.col("yr"))
    return _results(q.validate(v, [q.rolls_up("n", level="cell", total_code="99", keys=["k", "yr"])], id_col="i"))


@query("q09_custom_predicates", """
    , v as (select unitid * 10000 + survey_year i, * from sup_panel)
    """ + _rule_sql([("admitted_le_applied", "error", "admits > applicants"), ("enrolled_le_half", "error", "enrolled * 2 > admits"),
                     ("completers_monotone", "warn", "completers > cohort_size or cohort_size > applicants"), ("tuition_le_total", "error", "tuition_revenue > total_revenue * 0.95")]),
       "sup_panel")
def _(t: Tables):
    v = t.sup_panel.withColumn("i", F.col("unitid") * 10000 + F.col("survey_year"))
    c = F.col
    rules = [q.custom("admitted_le_applied", c("admits") > c("applicants"), ("admits", "applicants")),
             q.custom("enrolled_le_half", c("enrolled") * 2 > c("admits"), ("enrolled", "admits")),
             q.custom("completers_monotone", (c("completers") > c("cohort_size")) | (c("cohort_size") > c("applicants")), ("completers",), severity="warn"),
             q.custom("tuition_le_total", c("tuition_revenue") > c("total_revenue") * 0.95, ("tuition_revenue", "total_revenue"))]
    return _results(q.validate(v, rules, id_col="i"))


@query("q10_component_rule_pack", """
    , v as (select unitid i, survey_year, applicants a, admits d, enrolled e, count(*) over (partition by unitid) dup from sup_panel)
    """ + _rule_sql([("unique_key(UNITID)", "error", "dup > 1"), ("in_range(APPLCN,0,None)", "error", "a < 0"), ("admitted_le_applied", "error", "d > a"),
                     ("enrolled_le_admitted", "error", "e > d")]), "sup_panel")
def _(t: Tables):
    adm = t.sup_panel.select(F.col("unitid").alias("UNITID"), F.col("applicants").alias("APPLCN"), F.col("admits").alias("ADMSSN"),
                             F.col("enrolled").alias("ENRLT"), F.lit(1).alias("NOT_KEPT"))
    return _results(components.check(components.curate(adm, "admissions"), "admissions"))


# Every rule pack over the supplier panel: the pack's columns as expressions that both engines read, and each rule's offenders.
_TOTALS = {"EFYAIANT": "completers", "EFYASIAT": "cohort_size - completers - case when unitid % 7 = 0 then 3 else 0 end", **{c: "0" for c in ("EFYBKAAT", "EFYHISPT", "EFYNHPIT", "EFYWHITT", "EFY2MORT", "EFYUNKNT")},
           "EFYNRALT": "case when unitid % 11 = 0 then -2 else 0 end"}
_ID = "unitid * 10000 + survey_year"
_ROWS = {  # pack -> columns
    "characteristics": {"UNITID": "case when unitid % 9 = 0 then unitid else " + _ID + " end", "INSTNM": "case when control > 20 then null else concat('s', unitid) end", "SECTOR": "control * 5", "CONTROL": "control % 6 - 1"},
    "admissions": {"UNITID": "unitid", "APPLCN": "applicants - 20", "ADMSSN": "admits", "ENRLT": "enrolled * 2"},
    "twelve_month": {"UNITID": "unitid", "EFFYALEV": "survey_year % 5", "EFFYLEV": "1", "EFYTOTLT": "cohort_size - case when unitid % 13 = 0 then 100 else 0 end", **_TOTALS},
    "fall_enrollment": {"UNITID": "unitid", "EFALEVEL": "case when survey_year > 1999 then 1 else survey_year end", "EFTOTLT": "admits - 25", "EFTOTLM": "completers"},
    "completions": {"UNITID": "unitid", "CIPCODE": "case when survey_year = 1995 then '99' else concat('0', survey_year % 10) end", "AWLEVEL": "control % 3", "MAJORNUM": "1",
                    "CTOTALT": "case when survey_year = 1995 then cohort_size * 6 else completers - 12 end"},
    "graduation": {"UNITID": "unitid", "GRTYPE": "survey_year - survey_year % 2", "CHRTSTAT": "1", "GRTOTLT": "completers - 15"},
    "graduation_200": {"UNITID": _ID, "BAGR100": "50", "BAGR150": "completers * 2", "BAGR200": "completers + enrolled"},
    "outcomes": {"UNITID": "unitid", "OMCHRT": "survey_year", "OMRCHRT": "cohort_size", "OMACHRT": "cohort_size + case when control > 22 then 1 else 0 end", "OMAWDN4": "completers", "OMAWDN6": "enrolled", "OMAWDN8": "enrolled + control - 3",
                 "OMENRYI": "cohort_size - enrolled - control + 3", "OMENRAI": "case when unitid % 5 = 0 then 2 else 0 end", "OMENRUN": "0"},
    "aid": {"UNITID": _ID, "ANYAIDP": "completers * 3", "FGRNT_N": "admits", "PGRNT_N": "enrolled + control"},
    "finance": {"UNITID": _ID, "REPORTING_STANDARD": "case when control = 4 then null else 'A' end", "TOTAL_REVENUES": "completers - 10", "TOTAL_EXPENSES": "enrolled - 15"},
    "staff": {"UNITID": "unitid", "STAFFCAT": "survey_year % 6", "FTPT": "1", "OCCUPCAT": "2", "HRTOTLT": "completers - 18"},
    "library": {"UNITID": _ID, "LEXPTOT": "cohort_size - 30", "LSALWAG": "completers", "LFRNGBN": "cohort_size - completers - 30", "LEXMSTL": "case when control % 2 = 0 then 3 else 0 end", "LEXOMTL": "0",
                "LEXMSBB": "case when control % 4 = 0 then 3 else 0 end", "LEXMSCS": "0", "LEXMSOT": "1", "LEXOMPS": "case when control > 20 then 1 else -1 end", "LEXOMOT": "1"},
}


def _sums(total, parts, tolerance):
    present = " or ".join(f"{p} is not null" for p in parts)
    return f"({present}) and abs({' + '.join(f'coalesce({p}, 0)' for p in parts)} - {total}) > {tolerance}"


_OFFENDERS = {  # pack -> (rule, severity, offending rows); dup is the number of rows of the key
    "characteristics": [("unique_key(UNITID)", "error", "dup > 1"), ("not_null(UNITID,INSTNM)", "error", "INSTNM is null"), ("subset_of(CONTROL)", "error", "CONTROL not in (1, 2, 3, -3)"), ("in_range(SECTOR,0,99)", "error", "SECTOR > 99")],
    "admissions": [("unique_key(UNITID)", "error", "dup > 1"), ("in_range(APPLCN,0,None)", "error", "APPLCN < 0"), ("admitted_le_applied", "error", "ADMSSN > APPLCN"), ("enrolled_le_admitted", "error", "ENRLT > ADMSSN")],
    "twelve_month": [("unique_key(UNITID,EFFYALEV)", "error", "dup > 1"), ("in_range(EFYTOTLT,0,None)", "error", "EFYTOTLT < 0"), ("sums_to(EFYTOTLT)", "warn", _sums("EFYTOTLT", list(_TOTALS), 0))],
    "fall_enrollment": [("unique_key(UNITID,EFALEVEL)", "error", "dup > 1"), ("in_range(EFTOTLT,0,None)", "error", "EFTOTLT < 0")],
    "completions": [("unique_key(UNITID,CIPCODE,AWLEVEL,MAJORNUM)", "error", "dup > 1"), ("in_range(CTOTALT,0,None)", "error", "CTOTALT < 0"),
                    ("rolls_up(CTOTALT, CIPCODE==99)", "error", "CIPCODE = '99' and abs(coalesce(CTOTALT, 0) - detail) > 0")],
    "graduation": [("unique_key(UNITID,GRTYPE)", "error", "dup > 1"), ("in_range(GRTOTLT,0,None)", "error", "GRTOTLT < 0")],
    "graduation_200": [("unique_key(UNITID)", "error", "dup > 1"), ("in_range(BAGR200,0,100)", "warn", "BAGR200 < 0 or BAGR200 > 100"), ("monotone_200_ge_150", "error", "BAGR150 > BAGR200")],
    "outcomes": [("unique_key(UNITID,OMCHRT)", "error", "dup > 1"), ("in_range(OMACHRT,0,None)", "error", "OMACHRT < 0"), ("adjusted_le_reported", "error", "OMACHRT > OMRCHRT"),
                 ("sums_to(OMACHRT)", "warn", _sums("OMACHRT", ["OMAWDN8", "OMENRYI", "OMENRAI", "OMENRUN"], 0)), ("award_monotone_4_6_8", "error", "OMAWDN8 < OMAWDN6 or OMAWDN6 < OMAWDN4")],
    "aid": [("unique_key(UNITID)", "error", "dup > 1"), ("in_range(ANYAIDP,0,100)", "warn", "ANYAIDP < 0 or ANYAIDP > 100"), ("pell_le_federal_grant", "error", "PGRNT_N > FGRNT_N")],
    "finance": [("unique_key(UNITID)", "error", "dup > 1"), ("not_null(REPORTING_STANDARD)", "error", "REPORTING_STANDARD is null"), ("in_range(TOTAL_REVENUES,0,None)", "warn", "TOTAL_REVENUES < 0"),
                ("in_range(TOTAL_EXPENSES,0,None)", "warn", "TOTAL_EXPENSES < 0")],
    "staff": [("unique_key(UNITID,STAFFCAT)", "error", "dup > 1"), ("in_range(HRTOTLT,0,None)", "error", "HRTOTLT < 0")],
    "library": [("unique_key(UNITID)", "error", "dup > 1"), ("in_range(LEXPTOT,0,None)", "error", "LEXPTOT < 0"), ("sums_to(LEXPTOT)", "error", _sums("LEXPTOT", ["LSALWAG", "LFRNGBN", "LEXMSTL", "LEXOMTL"], 1)),
                ("sums_to(LEXMSTL)", "error", _sums("LEXMSTL", ["LEXMSBB", "LEXMSCS", "LEXMSOT"], 1)), ("sums_to(LEXOMTL)", "error", _sums("LEXOMTL", ["LEXOMPS", "LEXOMOT"], 1))],
}


def _pack_sql(pack):
    spec = components.COMPONENTS[pack]
    plain = {*spec.grain, *spec.categoricals, "INSTNM", "REPORTING_STANDARD"}  # keys, codes and text are not masked
    columns = ", ".join(f"{e} {c}" for c, e in _ROWS[pack].items())
    masked = ", ".join(c if c in plain else f"case when {c} not in (-1, -2, -3, -9) then {c} end {c}" for c in _ROWS[pack])
    detail = ", sum(case when CIPCODE <> '99' then coalesce(CTOTALT, 0) else 0 end) over (partition by UNITID, AWLEVEL, MAJORNUM) detail" if pack == "completions" else ""
    return f"""
    , raw as (select {columns} from sup_panel), masked as (select {masked} from raw),
    v as (select UNITID i, *, count(*) over (partition by {", ".join(spec.grain)}) dup{detail} from masked)
    """ + _rule_sql(_OFFENDERS[pack])


def _pack(pack):
    def run(t: Tables):
        rows = t.sup_panel.select(*[F.expr(e).alias(c) for c, e in _ROWS[pack].items()])
        return _results(components.check(components.curate(rows, pack), pack))
    query(f"q10_pack_{pack}", _pack_sql(pack), "sup_panel")(run)


for _name in _ROWS:
    _pack(_name)


@query("q11_total_gaps", """
    , p as (select survey_year, sum(n) s from cust_panel group by 1), f as (select year(o_orderdate) survey_year, count(*) + case when year(o_orderdate) > 1999 then 7 else 0 end published from orders group by 1, year(o_orderdate))
    select survey_year, cast(s as bigint) parts_sum, published, cast(s - published as bigint) gap from p join f using (survey_year) where abs(s - published) > 5""", "cust_panel")
def _(t: Tables):
    y = F.year("o_orderdate")
    pub = t.orders.groupBy(y.alias("survey_year")).agg(F.count("*").alias("published")).withColumn(
        "published", F.col("published") + F.when(F.col("survey_year") > 1999, 7).otherwise(0))
    return q.total_gaps(t.cust_panel, pub, ["survey_year"], "n", "published", 5)


@query("q12_sign_repair", """
    , c as (select board, year, completers * 100.0 v, case board when 'ASIA' then 1 when 'AFRICA' then 2 when 'EUROPE' then 3 when 'AMERICA' then 4 else 5 end o from board_year),
    wrong as (select year, board, o, case when board = 'ASIA' and year >= 1998 then -v else v end v from c),
    tot as (select year, sum(v) total from c group by 1), gap as (select year, total - sum(v) g from wrong join tot using (year) group by year, total)
    select year, board, case when abs(g) > 5 and board = 'ASIA' then -v else v end v, abs(g) > 5 and board = 'ASIA' repaired, true ties from wrong join gap using (year)""", "board_year")
def _(t: Tables):
    dim = t.spark.createDataFrame([("ASIA", 1), ("AFRICA", 2), ("EUROPE", 3), ("AMERICA", 4)], "board string, o int")
    c = t.once("board_year").join(dim, "board", "left").select("year", "board", F.coalesce("o", F.lit(5)).alias("o"), (F.col("completers") * 100.0).alias("v"))
    wrong = c.withColumn("v", F.when((F.col("board") == "ASIA") & (F.col("year") >= 1998), -F.col("v")).otherwise(F.col("v")))
    tot = c.groupBy("year").agg(F.sum("v").alias("total"))
    return q.sign_repair(wrong, tot, ["year"], "board", "o", "v", "total")


@query("q12_eliminations_net", """
    , g as (select year, sum(completers) - sum(fte) / 25.5 a, sum(cohort_size - completers) - 800 b from board_year group by 1)
    select year from g where abs(a - b) > 500""", "board_year")
def _(t: Tables):
    g = t.once("board_year").groupBy("year").agg((F.sum("completers") - F.sum("fte") / 25.5).alias("a"),
                                         (F.sum(F.col("cohort_size") - F.col("completers")) - 800).alias("b"))
    return q.eliminations_net(g, "a", "b", 500).select("year")


@query("q13_conflicting_values", """
    select l_orderkey, l_linenumber, min(l_suppkey) low, max(l_suppkey) high from lineitem group by 1, 2 having min(l_suppkey) <> max(l_suppkey)""")
def _(t: Tables):
    return q.disagreements(t.lineitem, ["l_orderkey", "l_linenumber"], "l_suppkey")


@query("q14_published_rate_gap", """
    , p as (select abs(completers / cohort_size * 100 - floor(completers / cohort_size * 100 + case when control < 5 then 2 else 0 end)) g from sup_panel)
    select count(g) n, round(max(g), 6) max_gap, count_if(g > 1) n_outside from p""", "sup_panel")
def _(t: Tables):
    pct = nulls.ratio("completers", "cohort_size") * 100
    p = t.sup_panel.withColumn("published", F.floor(pct + F.when(F.col("control") < 5, 2).otherwise(0)))
    return rounded(q.published_rate_gap(p, "completers", "cohort_size", "published"), ["max_gap"])


@query("k04_validation_report", """
    with r as (select 'error' severity, (select count(*) from (select o_orderkey from orders group by 1 having count(*) > 1)) bad
      union all select 'error', (select count_if(o_totalprice < 1000) from orders) union all select 'warn', (select count_if(o_totalprice > 300000) from orders))
    select severity, count(*) n_rules, count_if(bad > 0) n_failed, cast(sum(bad) as bigint) n_offending from r group by 1""")
def _(t: Tables):
    res = q.validate(t.orders, [q.unique_key("o_orderkey"), q.in_range("o_totalprice", 1000), q.in_range("o_totalprice", None, 300000, severity="warn")],
                     id_col="o_orderkey")
    path = f"{run_dir(t.spark)}/report-{uuid.uuid4().hex}"
    sinks.save_report(res, path)
    res = t.spark.read.schema(res.schema).json(path)
    return res.groupBy("severity").agg(F.count("*").alias("n_rules"), F.count_if(F.col("status") == "fail").alias("n_failed"),
                                       F.sum("n_offending").alias("n_offending"))
