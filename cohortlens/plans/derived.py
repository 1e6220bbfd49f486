"""Queries over the derived-feature operators (F family)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nulls
from ..operators import features as fe
from .registry import query
from .tables import Tables

R = F.round
K = ["unitid", "survey_year"]


def rounded(df, cols, p=6):
    return df.withColumns({c: R(c, p) for c in cols})


@query("f01_student_faculty_ratio", """
    select unitid, survey_year, round(admits + (applicants - admits) / 3, 6) fte_students,
      round(case when enrolled <> 0 then (admits + (applicants - admits) / 3) / enrolled end, 6) student_faculty_ratio
    from sup_panel""", "sup_panel")
def _(t: Tables):
    p = t.sup_panel
    ef = p.select(*K, F.col("admits").alias("ft_students"), (F.col("applicants") - F.col("admits")).alias("pt_students"))
    hr = p.select(*K, F.col("enrolled").alias("fte_instructional_faculty"))
    return rounded(fe.student_faculty_ratio(ef, hr), ["fte_students", "student_faculty_ratio"])


@query("f02_aid_intensity", """
    select unitid, survey_year, round(completers / applicants, 6) pell_share,
      round(total_revenue / nullif(completers, 0), 2) avg_grant_per_recipient from sup_panel""", "sup_panel")
def _(t: Tables):
    sfa = t.sup_panel.select(*K, F.col("completers").alias("pell_recipients"), F.col("applicants").alias("total_undergrad"),
                             F.col("total_revenue").alias("total_grant_aid"), F.col("completers").alias("aid_recipients"))
    return rounded(rounded(fe.aid_intensity(sfa), ["pell_share"]), ["avg_grant_per_recipient"], 2)


@query("f03_selectivity", """
    select unitid, survey_year, round(admits / applicants, 6) admit_rate, round(enrolled / nullif(admits, 0), 6) yield_rate
    from sup_panel""", "sup_panel")
def _(t: Tables):
    return rounded(fe.selectivity(t.sup_panel), ["admit_rate", "yield_rate"])


@query("f04_financial_health", """
    select unitid, survey_year, round(tuition_revenue / total_revenue, 6) tuition_dependence,
      round((total_revenue - tuition_revenue) / total_revenue, 6) appropriation_share,
      round(total_revenue / total_enrollment, 4) expense_per_student from sup_panel""", "sup_panel")
def _(t: Tables):
    fin = t.sup_panel.select(*K, "tuition_revenue", "total_revenue", F.col("total_revenue").alias("total_expenses"),
                             (F.col("total_revenue") - F.col("tuition_revenue")).alias("govt_appropriations"))
    out = rounded(fe.financial_health(fin, t.sup_panel), ["tuition_dependence", "appropriation_share"])
    return rounded(out, ["expense_per_student"], 4)


@query("f05_completion_rate", """
    select unitid, survey_year, round(completers / cohort_size, 6) completion_rate_150pct from sup_panel""", "sup_panel")
def _(t: Tables):
    gr = t.sup_panel.select(*K, F.col("completers").alias("completers_150pct"), "cohort_size")
    return rounded(fe.completion_rate(gr), ["completion_rate_150pct"])


@query("f06_equity_gap", """
    select unitid, survey_year, round(admits / applicants - completers / applicants, 6) equity_gap,
      round(completers / applicants - admits / applicants, 6) pell_gap from sup_panel""", "sup_panel")
def _(t: Tables):
    om = t.sup_panel.select(*K, nulls.ratio("completers", "applicants").alias("pell_completers_share"),
                            nulls.ratio("admits", "applicants").alias("non_pell_completers_share"))
    return rounded(fe.equity_gap(om), ["equity_gap", "pell_gap"])


@query("f07_tenure_density", """
    select l_suppkey unitid, cast(sum(l_quantity) filter (l_linenumber = 1) as double) ft_instr_staff,
      round((coalesce(sum(l_quantity) filter (l_linenumber = 2), 0) + coalesce(sum(l_quantity) filter (l_linenumber = 3), 0))
        / sum(l_quantity) filter (l_linenumber = 1), 6) tenure_density from lineitem group by 1""")
def _(t: Tables):
    code = F.when(F.col("l_linenumber") == 1, 0).when(F.col("l_linenumber") == 2, 20).when(F.col("l_linenumber") == 3, 30)
    sis = t.lineitem.select(F.col("l_suppkey").alias("unitid"), code.alias("facstat"), F.col("l_quantity").alias("sistotl"))
    return rounded(fe.tenure_density(sis), ["tenure_density"])


@query("f08_salary_equity", """
    select l_suppkey unitid, round(avg(l_extendedprice) filter (l_returnflag = 'A'), 6) sal_men,
      round(avg(l_extendedprice) filter (l_returnflag = 'R'), 6) sal_women,
      round(avg(l_extendedprice) filter (l_returnflag = 'R') / avg(l_extendedprice) filter (l_returnflag = 'A'), 6) sal_w_to_m
    from lineitem where l_linenumber = 7 group by 1""")
def _(t: Tables):
    sal = t.lineitem.groupBy(F.col("l_suppkey").alias("unitid"), F.col("l_linenumber").alias("arank")).agg(
        F.avg(F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice"))).alias("saeq9am"),
        F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))).alias("saeq9aw"))
    return rounded(rounded(fe.salary_equity(sal), ["sal_w_to_m"]), ["sal_men", "sal_women"], 6)


@query("f09_institution_features", """
    select unitid, survey_year, round(log10(total_enrollment), 6) "LOG_ENROLL", round(tuition_revenue / total_revenue, 6) "TUITION_SHARE",
      round(tuition_revenue / total_revenue, 6) "INSTR_EXP_SHARE", round(total_revenue / total_enrollment, 4) "EXP_PER_FTE",
      round(enrolled / applicants, 6) "INSTR_FTE_SHARE", round(completers / applicants, 6) "MGMT_FTE_SHARE",
      cast(completers - enrolled as bigint) "PELL_GAP", round(applicants / nullif(admits, 0), 6) "TWELVE_TO_FALL",
      round(completers / cohort_size, 6) "BA_RATE_150", round(case when admits > 0 then enrolled / admits end, 6) "L4_RATE_150",
      admits "ADMIT_RATE", enrolled "YIELD" from sup_panel""", "sup_panel")
def _(t: Tables):
    c = F.col
    src = t.sup_panel.select(
        *K, c("total_enrollment").alias("ENROLL_FALL"), c("tuition_revenue").alias("TUITION_REVENUE"),
        c("total_revenue").alias("TOTAL_REVENUES"), c("tuition_revenue").alias("INSTRUCTION_EXPENSE"),
        c("total_revenue").alias("TOTAL_EXPENSES"), c("total_enrollment").alias("FTE"), c("enrolled").alias("SFTEINST"),
        c("completers").alias("SFTEMNGM"), c("applicants").alias("SFTETOTL"), c("applicants").alias("UNDUP"),
        c("admits").alias("ENRTOT"), c("completers").alias("BANC150"), c("cohort_size").alias("BAAC150"),
        c("enrolled").alias("L4NC150"), c("admits").alias("L4AC150"), c("completers").alias("OM1PELLAWDP8"),
        c("enrolled").alias("OM1NPELAWDP8"), c("admits").alias("DVADM01"), c("enrolled").alias("DVADM04"))
    out = fe.institution_features(src)
    names = [*fe.INSTITUTION_RATIOS, "LOG_ENROLL", "PELL_GAP", "ADMIT_RATE", "YIELD"]
    out = out.select(*K, *names)
    return rounded(rounded(out, [n for n in names if n not in ("PELL_GAP", "ADMIT_RATE", "YIELD", "EXP_PER_FTE")]), ["EXP_PER_FTE"], 4)


@query("f10_blank_parent_rows", """
    , q as (select unitid, case when band >= 0 then c_acctbal end own, c_nationkey a, case when c_nationkey > 12 then band end b from quasi)
    select unitid, own is null and (a is not null or b is not null) "LIB_FROM_PARENT",
      case when own is not null then a end a, case when own is not null then b end b from q""", "quasi")
def _(t: Tables):
    q = t.quasi.select("unitid", F.when(F.col("band") >= 0, F.col("c_acctbal")).alias("own"), F.col("c_nationkey").alias("a"),
                       F.when(F.col("c_nationkey") > 12, F.col("band")).alias("b"))
    return fe.blank_parent_rows(q, "own", ["a", "b"]).select("unitid", "LIB_FROM_PARENT", "a", "b")


_FORMS_SQL = """
    , forms as (
      select unitid * 10000 + survey_year unitid, 'F1A' std, 0 pos, total_revenue rev, tuition_revenue tui, total_enrollment endow from sup_panel where control < 12
      union all select unitid * 10000 + survey_year, 'F2', 1, total_revenue * 2, tuition_revenue, null from sup_panel where control >= 8)"""


def _forms(t: Tables):
    p = t.sup_panel.withColumn("unitid", F.col("unitid") * 10000 + F.col("survey_year"))
    f1 = p.filter("control < 12").select(F.col("unitid").alias("UNITID"), F.col("total_revenue").alias("F1B27"),
                                         F.col("tuition_revenue").alias("F1B01"), F.col("total_enrollment").alias("F1H02"))
    f2 = p.filter("control >= 8").select(F.col("unitid").alias("UNITID"), (F.col("total_revenue") * 2).alias("F2D16"),
                                         F.col("tuition_revenue").alias("F2D01"))
    return fe.harmonise_finance([
        ("F1A", f1, {"TOTAL_REVENUES": "F1B27", "TUITION_REVENUE": "F1B01", "ENDOWMENT_EOY": "F1H02"}),
        ("F2", f2, {"TOTAL_REVENUES": "F2D16", "TUITION_REVENUE": "F2D01", "ENDOWMENT_EOY": None})])


@query("f11_harmonise_finance", _FORMS_SQL + """
    select unitid "UNITID", std "REPORTING_STANDARD", round(rev, 2) "TOTAL_REVENUES", round(tui, 2) "TUITION_REVENUE", endow "ENDOWMENT_EOY"
    from forms qualify row_number() over (partition by unitid order by pos) = 1""", "sup_panel")
def _(t: Tables):
    return rounded(_forms(t)[0], ["TOTAL_REVENUES", "TUITION_REVENUE"], 2)


@query("f11_form_overlap", _FORMS_SQL + """
    select unitid "UNITID", count(*) n_forms from forms group by 1 having count(*) > 1""", "sup_panel")
def _(t: Tables):
    return _forms(t)[1]


@query("f12_grad_rates", """
    with g as (select l_partkey unitid,
        count(*) filter (l_linenumber = 1) rev4, count(*) filter (l_linenumber <= 2) - 3 adj4, count(*) filter (l_linenumber = 3) c4,
        count(*) filter (l_linenumber = 4) rev2, count(*) filter (l_linenumber = 5) adj2, count(*) filter (l_linenumber = 6) c2
      from lineitem group by 1),
    h as (select *, adj4 > 0 ok4, adj2 > 0 ok2, ok4 and (not ok2 or rev4 >= rev2) use4 from g)
    select unitid, case when use4 then rev4 else rev2 end cohort,
      case when use4 then ((200 * c4 + adj4) // (2 * adj4)) / 100 else ((200 * c2 + adj2) // (2 * adj2)) / 100 end rate
    from h where ok4 or ok2""")
def _(t: Tables):
    ln = F.col("l_linenumber")
    wide = t.lineitem.groupBy(F.col("l_partkey").alias("unitid")).agg(
        F.count_if(ln == 1).alias("1"), (F.count_if(ln <= 2) - 3).alias("2"), F.count_if(ln == 3).alias("3"),
        F.count_if(ln == 4).alias("27"), F.count_if(ln == 5).alias("29"), F.count_if(ln == 6).alias("30"))
    gr = wide.unpivot("unitid", ["1", "2", "3", "27", "29", "30"], "grtype", "grtotlt").withColumn("grtype", F.col("grtype").cast("int"))
    return fe.grad_rates(gr)


@query("f13_largest_cohort", """
    select l_partkey unitid, cast(l_quantity as double) cohort, l_orderkey ordinal, round(l_extendedprice, 2) price from lineitem
    qualify row_number() over (partition by l_partkey order by l_quantity desc, l_orderkey, l_linenumber, l_extendedprice desc) = 1""")
def _(t: Tables):
    # the order key repeats within a part only together with the line number: fold both into one ordinal
    li = t.lineitem.select(F.col("l_partkey").alias("unitid"), F.col("l_quantity").alias("cohort"),
                           (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.col("l_extendedprice").alias("price"))
    best = fe.largest_cohort(li, "unitid", "cohort", "ordinal", ["price"])
    return best.select("unitid", "cohort", F.floor(F.col("ordinal") / 10).alias("ordinal"), R("price", 2).alias("price"))


@query("f14_sum_codes", """
    , p as (select unitid, survey_year, case when admits > 50 then admits end a, case when enrolled > 60 then enrolled end b from sup_panel)
    select unitid, survey_year, cast(case when a is not null or b is not null then coalesce(a, 0) + coalesce(b, 0) end as bigint) total
    from p""", "sup_panel")
def _(t: Tables):
    p = t.sup_panel.select(*K, F.when(F.col("admits") > 50, F.col("admits")).alias("a"),
                           F.when(F.col("enrolled") > 60, F.col("enrolled")).alias("b"))
    return p.select(*K, fe.sum_codes(["a", "b"]).alias("total"))


@query("f15_discount_rate", """
    select unitid, survey_year, round_even((total_revenue - tuition_revenue) / total_revenue, 4) discount_rate,
      cast(null as double) no_base from sup_panel""", "sup_panel")
def _(t: Tables):
    d = F.col("total_revenue") - F.col("tuition_revenue")
    return t.sup_panel.select(*K, fe.discount_rate("tuition_revenue", d).alias("discount_rate"),
                              fe.discount_rate(F.lit(0.0), F.lit(0.0)).alias("no_base"))


@query("f16_per_fte", """
    select board, year, round_even(funding / fte, 0) per_fte, round_even(tuition / fte, 2) tuition_per_fte from board_year""", "board_year")
def _(t: Tables):
    return t.board_year.select("board", "year", fe.per_fte("funding", "fte").alias("per_fte"),
                               fe.per_fte("tuition", "fte", 2).alias("tuition_per_fte"))


@query("f17_deflator_real_terms", """
    , c as (select year, avg(funding / fte) cpi from board_year group by 1),
    f as (select year, round_even((select cpi from c where year = 2000) / cpi, 5) factor from c)
    select board, year, round(funding * factor * 1.5, 0) funding, factor from board_year join f using (year)""", "board_year")
def _(t: Tables):
    cpi = t.once("board_year").groupBy("year").agg(F.avg(nulls.ratio("funding", "fte")).alias("cpi"))
    factors = fe.deflator(cpi, 2000, "year", "cpi")
    real = fe.real_terms(t.once("board_year"), factors, "year", ["funding"], extra=1.5)
    return real.join(factors, "year").select("board", "year", R("funding", 0).alias("funding"), "factor")


@query("f18_unit_collapse", """
    select c_nationkey unit, arg_min(c_name, c_custkey) "c_name", arg_min(c_mktsegment, c_custkey) c_mktsegment,
      array_to_string(list(c_name order by c_custkey), '|') campuses from customer group by 1""")
def _(t: Tables):
    c = t.customer.withColumnRenamed("c_nationkey", "unit")
    return fe.unit_collapse(c, "unit", "c_name", "c_custkey", ["c_mktsegment"]).withColumn("campuses", F.array_join("campuses", "|"))


@query("f19_core_revenue", """
    , p as (select unitid, survey_year, completers a, case when enrolled > 50 then enrolled end b, admits c from sup_panel)
    select unitid, survey_year, cast(a + coalesce(b, 0) + c as bigint) core_revenue,
      round(case when a + coalesce(b, 0) + c > 0 then coalesce(b, 0) / (a + coalesce(b, 0) + c) end, 6) state_share from p""", "sup_panel")
def _(t: Tables):
    p = t.sup_panel.select(*K, F.col("completers").alias("a"), F.when(F.col("enrolled") > 50, F.col("enrolled")).alias("b"),
                           F.col("admits").alias("c"))
    return p.withColumns(fe.core_revenue(["a", "b", "c"], "b")).select(*K, "core_revenue", R("state_share", 6).alias("state_share"))


def _statement(t: Tables):
    c = F.col
    return t.sup_panel.groupBy("survey_year").agg(
        F.sum("total_revenue").alias("tuition_gross"), F.sum("tuition_revenue").alias("tuition_net"),
        (F.sum("total_revenue") * 1.5).alias("operating_revenue"), (F.sum("total_revenue") * 1.6).alias("operating_expense"),
        (F.sum("completers") * 1000.0).alias("nonoperating"), (F.sum("enrolled") * 500.0).alias("fee_for_service"),
        (F.sum("admits") * 400.0).alias("grants"), (F.sum("cohort_size") * 10.0).alias("other_revenues")).select("*")


_STATEMENT_SQL = """
    , s as (select survey_year, sum(total_revenue) g, sum(tuition_revenue) n, sum(total_revenue) * 1.5 rev, sum(total_revenue) * 1.6 ex,
      sum(completers) * 1000.0 non, sum(enrolled) * 500.0 fee, sum(admits) * 400.0 gr, sum(cohort_size) * 10.0 cap from sup_panel group by 1)"""


@query("f20_statement_lines", _STATEMENT_SQL + """
    select survey_year, round(g - n, 0) allowance, round(rev - n - fee - gr, 0) other_operating, round(rev - ex, 0) operating_income,
      round(rev - ex + non, 0) before_other from s""", "sup_panel")
def _(t: Tables):
    out = fe.statement_lines(_statement(t), ["tuition_net", "fee_for_service", "grants"])
    cols = ["allowance", "other_operating", "operating_income", "before_other"]
    return rounded(out.select("survey_year", *cols), cols, 0)


@query("f21_waterfall", _STATEMENT_SQL + """
    , w as (
      select survey_year, 1 step, 'gross tuition' as label, 0 low, g high, g amount from s
      union all select survey_year, 2, 'allowance', n, g, n - g from s
      union all select survey_year, 3, 'net tuition', 0, n, n from s
      union all select survey_year, 4, 'fee for service', n, n + fee, fee from s
      union all select survey_year, 5, 'grants', n + fee, n + fee + gr, gr from s
      union all select survey_year, 6, 'other', n + fee + gr, rev, rev - n - fee - gr from s
      union all select survey_year, 7, 'operating revenue', 0, rev, rev from s
      union all select survey_year, 8, 'operating expense', rev - ex, rev, -ex from s
      union all select survey_year, 9, 'operating income', least(0, rev - ex), greatest(0, rev - ex), rev - ex from s
      union all select survey_year, 10, 'nonoperating', rev - ex, rev - ex + non, non from s
      union all select survey_year, 11, 'capital and other', rev - ex + non, rev - ex + non + cap, cap from s
      union all select survey_year, 12, 'change in net position', least(0, rev - ex + non + cap), greatest(0, rev - ex + non + cap), rev - ex + non + cap from s)
    select survey_year, step, label, round(cast(low as double), 0) low, round(cast(high as double), 0) high, round(cast(amount as double), 0) amount from w""", "sup_panel")
def _(t: Tables):
    return rounded(fe.waterfall(_statement(t), "survey_year"), ["low", "high", "amount"], 0)


@query("f22_series_growth", """
    , s as (select unitid, arg_min(total_enrollment, survey_year) f, arg_max(total_enrollment, survey_year) l, min(survey_year) a, max(survey_year) b,
      count(*) n from cust_panel group by 1)
    select unitid, round(case when b > a then pow(l / f, 1.0 / (b - a)) - 1 end, 6) cagr, n = (select count(distinct survey_year) from cust_panel) complete
    from s""", "cust_panel")
def _(t: Tables):
    g = fe.series_growth(t.once("cust_panel"), ["unitid"], "survey_year", "total_enrollment")
    return g.select("unitid", R("cagr", 6).alias("cagr"), "complete")


@query("f23_price_trajectories", """
    , w as (select unitid, any_value(sector) sector, max(n) filter (survey_year = 1996) p0, max(n) filter (survey_year = 1997) p1,
       max(n) filter (survey_year = 1998) p2, max(n) filter (survey_year = 1999) p3 from cust_panel group by 1),
    c as (select sector, pow(p3 / p0, 1.0 / 3) - 1 cagr, p3 = p0 frozen from w where p0 > 0 and p1 > 0 and p2 > 0 and p3 > 0)
    select sector, count(*) n, round(100 * quantile_cont(cagr, 0.25), 4) q1, round(100 * quantile_cont(cagr, 0.5), 4) med,
      round(100 * quantile_cont(cagr, 0.75), 4) q3, round(avg(frozen::int), 6) share_frozen from c group by 1""", "cust_panel")
def _(t: Tables):
    from ..operators import ordering
    wide = fe.year_pivot(t.cust_panel, ["unitid", "sector"], "survey_year", "n", [1996, 1997, 1998, 1999], "p")
    paths = fe.price_trajectories(wide, "unitid", {"p1996": 1996, "p1997": 1997, "p1998": 1998, "p1999": 1999})
    q = ordering.quantiles(paths, ["sector"], F.col("cagr") * 100, {"q1": .25, "med": .5, "q3": .75})
    share = paths.groupBy("sector").agg(F.count("*").alias("n"), R(F.avg(F.col("frozen").cast("double")), 6).alias("share_frozen"))
    return rounded(share.join(q, "sector"), ["q1", "med", "q3"], 4)


@query("f24_selectable_cohort", """
    with g as (select l_partkey unitid, sum(l_quantity) filter (l_linenumber = 1) a, sum(l_quantity) filter (l_linenumber = 2) an,
        sum(l_quantity) filter (l_linenumber = 3) b, sum(l_quantity) filter (l_linenumber = 4) bn from lineitem group by 1)
    select unitid, case when a > 30 then 'bachelor' else 'two-year' end src, case when a > 30 then a - 30 else b end den,
      case when a > 30 then coalesce(an, 0) else coalesce(bn, 0) end num from g where a > 30 or b > 0""")
def _(t: Tables):
    q = F.when(F.col("l_linenumber") == 1, F.col("q") - 30).otherwise(F.col("q"))
    li = t.lineitem.groupBy(F.col("l_partkey").alias("unitid"), "l_linenumber").agg(F.sum("l_quantity").alias("q")).withColumn("q", q)
    return fe.selectable_cohort(li, ["unitid"], "l_linenumber", "q", [("bachelor", 1, 2), ("two-year", 3, 4)])


@query("f25_inclusive_retention", """
    , p as (select unitid, survey_year, completers, cohort_size, case when enrolled > 50 then enrolled end pn, case when admits > 50 then admits end pd from sup_panel)
    select unitid, survey_year, cast(completers + coalesce(pn, 0) as bigint) num, cast(cohort_size + coalesce(pd, 0) as bigint) den,
      round((completers + coalesce(pn, 0)) / (cohort_size + coalesce(pd, 0)), 6) rate from p""", "sup_panel")
def _(t: Tables):
    p = t.sup_panel.select(*K, "completers", "cohort_size", F.when(F.col("enrolled") > 50, F.col("enrolled")).alias("pn"),
                           F.when(F.col("admits") > 50, F.col("admits")).alias("pd"))
    return rounded(p.select(*K, *[c.alias(n) for n, c in fe.inclusive_retention("completers", "cohort_size", "pn", "pd").items()]), ["rate"])


@query("f26_demographic_share", """
    select o_custkey, cast(count(*) filter (o_orderstatus in ('F', 'P')) as bigint) subgroup,
      cast(count(*) filter (o_orderpriority <> '1-URGENT') - count(*) filter (o_orderstatus in ('F', 'P')) as bigint) others,
      round(case when count(*) filter (o_orderpriority <> '1-URGENT') > 0 then
        count(*) filter (o_orderstatus in ('F', 'P')) / count(*) filter (o_orderpriority <> '1-URGENT') end, 6) share
    from orders group by 1""")
def _(t: Tables):
    c = t.orders.groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "P").alias("p"),
        F.count("*").alias("total"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("nonresident"))
    d = fe.demographic_share(["f", "p"], "total", "nonresident")
    return rounded(c.select("o_custkey", *[e.alias(n) for n, e in d.items()]), ["share"])


def _vintages(t: Tables):
    long = t.once("board_year").select("board", "year", F.col("completers").alias("resident"), F.col("cohort_size").alias("total"))
    long = long.unpivot(["board", "year"], ["resident", "total"], "series", "value")
    older = long.filter("year <= 1998")
    newer = long.filter("year >= 1997").withColumn("value", F.when(F.col("year") >= 2001, F.lit(0)).otherwise(
        F.col("value") + F.when((F.col("year") == 1998) & (F.col("series") == "total"), 1).otherwise(0)))
    return fe.merge_series([older, newer], ["board", "year", "series"], "value")


_VINTAGE_SQL = """
    , l as (select board, year, 'resident' series, completers v from board_year union all select board, year, 'total', cohort_size from board_year),
    v as (select * from l where year <= 1998 union all
      select board, year, series, case when year >= 2001 then 0 else v + (case when year = 1998 and series = 'total' then 1 else 0 end) end from l where year >= 1997)"""


@query("f27_merged_series", _VINTAGE_SQL + """
    select board, year, series, cast(nullif(max(v), 0) as bigint) as value from v group by 1, 2, 3""", "board_year")
def _(t: Tables):
    return _vintages(t)[0]


@query("f27_conflicting_vintages", _VINTAGE_SQL + """
    select board, year, series, cast(min(v) as bigint) low, cast(max(v) as bigint) high from v group by 1, 2, 3 having min(v) <> max(v)""", "board_year")
def _(t: Tables):
    return _vintages(t)[1]


@query("f28_funding_table", """
    select board, year, cast(case when year < 1997 then cohort_size when year < 2000 then completers else cohort_size + completers end as bigint) amount,
      case when year < 1997 then 'table A' when year < 2000 then 'table B' else 'table C' end source from board_year""", "board_year")
def _(t: Tables):
    rows = t.board_year.select("board", "year", F.array("cohort_size", "completers").alias("vals"),
                               F.when(F.col("year") < 1997, "table A").when(F.col("year") < 2000, "table B").otherwise("table C").alias("source"))
    spec = t.spark.createDataFrame([("table A", 0), ("table B", 1), ("table C", -1)], "source string, pick int")
    return rows.join(spec, "source").select("board", "year", fe.pick_column("vals", "pick").alias("amount"), "source")


@query("f28_missing_boards", """
    select board, year from board_year where not completers > 800""", "board_year")
def _(t: Tables):
    return fe.missing_members(t.once("board_year").filter("completers > 800"), t.once("board_year").select("board", "year"), ["board", "year"])


@query("f29_measure_grid", """
    select l_suppkey unitid, year(l_shipdate) as year, cast(round_even(sum(l_quantity) filter (l_linenumber in (1, 2)), 0) as bigint) instruction,
      cast(round_even(sum(l_quantity) filter (l_linenumber in (3, 4, 5)), 0) as bigint) support,
      cast(round_even(sum(l_quantity) filter (l_linenumber = 7), 0) as bigint) rare from lineitem group by 1, 2""")
def _(t: Tables):
    li = t.lineitem.select(F.col("l_suppkey").alias("unitid"), F.year("l_shipdate").alias("year"), "l_linenumber", "l_quantity")
    return fe.measure_grid(li, {"instruction": [1, 2], "support": [3, 4, 5], "rare": [7]}, ["unitid", "year"], "l_linenumber", "l_quantity")


@query("f30_entity_grid", """
    select r_name entity, survey_year, round(sum(total_enrollment), 0) total_enrollment, round(sum(tuition_revenue), 0) tuition_revenue
    from sup_panel join nation on control = n_nationkey join region on n_regionkey = r_regionkey where survey_year in (1999, 2000) group by 1, 2""", "sup_panel")
def _(t: Tables):
    bridge = t.boards.select("control", F.col("board").alias("entity"))
    return fe.entity_grid(t.sup_panel.filter(F.col("survey_year").isin(1999, 2000)), bridge, "entity", "control", "survey_year",
                          ["total_enrollment", "tuition_revenue"])
