"""Queries over the cleaning, decoding and predicate operators (P family)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import functions as F

from ..functions import labels, nulls, text
from ..operators import cleaning, guards
from .registry import query
from .tables import Tables

R = F.round


@query("p01_mask_reserved", """
    select unitid, case when band not in (-1, -2, -3, -9) then band end band from quasi""", "quasi")
def _(t: Tables):
    return nulls.mask_reserved(t.quasi, ["band"]).select("unitid", "band")


@query("p01_masked_counts", """
    select 'band' as "column", count_if(band in (-1, -2, -3, -9)) n_masked from quasi
    union all select 'c_nationkey', count_if(c_nationkey in (-1, -2, -3, -9)) from quasi""", "quasi")
def _(t: Tables):
    return nulls.masked_counts(t.quasi, ["band", "c_nationkey"])


@query("p02_negative_and_signed", """
    select c_custkey, case when c_acctbal >= 0 then c_acctbal end masked,
      case when floor(c_acctbal / 1000) <> 0 then cast(floor(c_acctbal / 1000) as double) end signed_band,
      cast(null as double) from_text
    from customer""")
def _(t: Tables):
    return t.customer.select("c_custkey", nulls.mask_negative("c_acctbal").alias("masked"),
                             nulls.signed(F.floor(F.col("c_acctbal") / 1000)).alias("signed_band"),
                             nulls.number("c_name").alias("from_text"))


@query("p03_code_key", """
    select p_partkey, cast(p_size as varchar) as size_code, '0' || cast(p_size as varchar) || '.0000' padded,
      case when p_size - 3 = 0 then '0' else cast(p_size - 3 as varchar) end shifted, p_brand other
    from part""")
def _(t: Tables):
    p = t.part
    return p.select("p_partkey", text.code_key(F.col("p_size").cast("double")).alias("size_code"),
                    text.code_key(F.concat(F.lit("0"), "p_size", F.lit(".0000"))).alias("padded"),
                    text.code_key((F.col("p_size") - 3).cast("double")).alias("shifted"),
                    text.code_key("p_brand").alias("other"))


@query("p04_decode", """
    select c_custkey, c_nationkey, n_name "c_nationkey_LABEL" from customer left join nation on c_nationkey = n_nationkey""")
def _(t: Tables):
    sets = t.nation.select(F.lit(" c_nationkey").alias("varname"), F.col("n_nationkey").cast("double").cast("string")
                           .alias("codevalue"), F.concat("n_name", F.lit(" ")).alias("valuelabel"))
    return labels.decode(t.customer, sets, "c_nationkey").select("c_custkey", "c_nationkey", "c_nationkey_LABEL")


@query("p04_undecoded", """
    select cast(p_size as varchar) code, count(*) n_rows from part where p_size not in (select n_nationkey from nation)
    group by 1""")
def _(t: Tables):
    sets = t.nation.select(F.lit("p_size").alias("varname"), F.col("n_nationkey").alias("codevalue"),
                           F.col("n_name").alias("valuelabel"))
    return labels.undecoded(labels.decode(t.part, sets, "p_size"), "p_size")


@query("p05_split_flags", """
    select l_returnflag "XQTY", l_linestatus "XPRICE", count(*) n from lineitem group by 1, 2""")
def _(t: Tables):
    named = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("QTY"),
                              F.col("l_returnflag").alias("XQTY"), F.col("l_extendedprice").alias("PRICE"),
                              F.col("l_linestatus").alias("XPRICE"))
    _, flags = cleaning.split_flags(named, ["l_orderkey", "l_linenumber"], ["QTY", "PRICE"])
    return flags.groupBy("XQTY", "XPRICE").agg(F.count("*").alias("n"))


@query("p06_three_ratios", """
    select unitid, survey_year, round(admits / applicants, 6) plain,
      round(case when completers - 20 > 0 then admits / (completers - 20) end, 6) positive_den,
      round(case when completers <> 0 and enrolled > 0 then completers / enrolled end, 6) non_zero,
      round(case when completers <> 0 then enrolled / completers end, 6) zero_den
    from sup_panel""", "sup_panel")
def _(t: Tables):
    return t.sup_panel.select(
        "unitid", "survey_year", R(nulls.ratio("admits", "applicants"), 6).alias("plain"),
        R(nulls.ratio_pos("admits", F.col("completers") - 20), 6).alias("positive_den"),
        R(nulls.ratio_nz("completers", "enrolled"), 6).alias("non_zero"),
        R(nulls.ratio("enrolled", "completers"), 6).alias("zero_den"))


@query("p08_canonical_names", """
    select p_partkey, case when p_name like 'small %' then 'Small item' when p_name like '% ring' then 'Ring'
        when regexp_matches(p_name, '^(large|big) ') then 'Large item' end canonical,
      case when p_name like 'small %' then 1 when p_name like '% ring' then 2
        when regexp_matches(p_name, '^(large|big) ') then 3 end entity
    from part""")
def _(t: Tables):
    patterns = [("^small ", {"canonical": "Small item", "entity": 1}), (" ring$", {"canonical": "Ring", "entity": 2}),
                ("^(large|big) ", {"canonical": "Large item", "entity": 3})]
    return t.part.select("p_partkey", labels.first_pattern("p_name", patterns).alias("hit")).select(
        "p_partkey", "hit.canonical", "hit.entity")


@query("p09_amounts", """
    select c_custkey, round(c_acctbal, 2) value, round(-abs(c_acctbal), 2) minus_form, cast(0 as double) dash from customer""")
def _(t: Tables):
    absolute = F.format_number(F.abs("c_acctbal"), 2)
    printed = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("("), absolute, F.lit(")"))).otherwise(
        F.concat(F.lit("$ "), absolute))
    return t.customer.select("c_custkey", R(text.amount(printed), 2).alias("value"),
                             R(text.amount(F.concat(F.lit("-"), absolute)), 2).alias("minus_form"),
                             text.amount(F.lit("-")).alias("dash"))


@query("p10_round_half_up", """
    select unitid, n, k, ((2 * 100 * k + n) // (2 * n)) / 100 rate2, ((2 * 1000 * k + n) // (2 * n)) / 1000 rate3 from cohort""",
       "cohort")
def _(t: Tables):
    return t.cohort.select("unitid", "n", "k", nulls.round_half_up("k", "n", 2).alias("rate2"),
                           nulls.round_half_up("k", "n", 3).alias("rate3"))


_LABEL_SQL, _FAMILY_SQL = (" ".join(f"when p_size = {row[0]} then '{row[k].replace(chr(39), chr(39) * 2)}'" for row in labels.CARNEGIE) for k in (1, 2))


@query("p11_carnegie_labels", f"""
    select p_partkey, case {_LABEL_SQL} end carnegie_label, case {_FAMILY_SQL} end carnegie_family from part""")
def _(t: Tables):
    return labels.carnegie(t.part, "p_size").select("p_partkey", "carnegie_label", "carnegie_family")


@query("p11_control_level_labels", """
    select c_custkey, case c_nationkey when 1 then 'Public' when 2 then 'Private nonprofit' when 3 then 'Private for-profit' end control,
      case c_nationkey when 1 then '4-year or above' when 2 then '2-year' when 3 then 'Less than 2-year' end survey_level,
      case c_nationkey when 1 then 'Less than 2-year' when 2 then '2-year' when 3 then 'Less than 4-year'
        when 4 then '4-year or above' end portal_level
    from customer""")
def _(t: Tables):
    df = t.customer
    for dim, name in ((labels.CONTROL_LABELS, "control"), (labels.LEVEL_LABELS_SURVEY, "survey_level"),
                      (labels.LEVEL_LABELS_PORTAL, "portal_level")):
        df = labels.attach_label(df, labels.label_table(t.spark, dim, name), "c_nationkey")
    return df.select("c_custkey", "control", "survey_level", "portal_level")


@query("p12_coarsen", """
    select unitid, case when c_acctbal >= -1000 and c_acctbal < 0 then 'debt' when c_acctbal >= 0 and c_acctbal < 5000 then 'small'
      when c_acctbal >= 5000 and c_acctbal < 9000 then 'large' end size_band from quasi""", "quasi")
def _(t: Tables):
    return t.quasi.select("unitid", labels.band(F.col("c_acctbal"), [-1000, 0, 5000, 9000], ["debt", "small", "large"])
                          .alias("size_band"))


_SPEC = {"log_size": ("total_enrollment", "log10"), "tuition": ("share", "clip01"), "gap": ("gap", "log10"),
         "rate": ("rate", "none")}


def _feature_source(t: Tables):
    return t.sup_panel.select(
        "unitid", "survey_year", "total_enrollment",
        (nulls.ratio("tuition_revenue", "total_revenue") * 1.05).alias("share"),
        (F.col("admits") - F.col("completers")).alias("gap"), nulls.ratio("enrolled", "admits").alias("rate"))


_FEATURE_SQL = """f as (select unitid, survey_year, log10(total_enrollment) log_size,
      least(greatest(tuition_revenue / total_revenue * 1.05, 0), 1) tuition,
      case when admits - completers > 0 then log10(admits - completers) end gap, enrolled / nullif(admits, 0) rate from sup_panel)"""


@query("p13_peer_features", f"""
    , {_FEATURE_SQL}
    select unitid, survey_year, round(log_size, 6) log_size, round(tuition, 6) tuition, round(gap, 6) gap, round(rate, 6) rate
    from f where log_size is not null and tuition is not null and gap is not null and rate is not null""", "sup_panel")
def _(t: Tables):
    f = cleaning.peer_features(_feature_source(t), _SPEC, ["unitid", "survey_year"])
    return f.select("unitid", "survey_year", *[R(c, 6).alias(c) for c in _SPEC])


@query("p13_feature_coverage", f"""
    , {_FEATURE_SQL}
    select 'log_size' feature, 'total_enrollment' source, count_if(log_size is null) missing,
      round(count_if(log_size is null) / count(*), 3) share_missing from f
    union all select 'tuition', 'share', count_if(tuition is null), round(count_if(tuition is null) / count(*), 3) from f
    union all select 'gap', 'gap', count_if(gap is null), round(count_if(gap is null) / count(*), 3) from f
    union all select 'rate', 'rate', count_if(rate is null), round(count_if(rate is null) / count(*), 3) from f""", "sup_panel")
def _(t: Tables):
    return cleaning.feature_coverage(_feature_source(t), _SPEC)


@query("p14_universe_reasons", """
    select case when not (c_acctbal >= 0) then 'inactive' when not (c_nationkey between 1 and 9) then 'sector outside range'
      else 'kept' end reason, count(*) n from customer group by 1""")
def _(t: Tables):
    flagged = cleaning.universe_flag(t.customer, F.col("c_acctbal") >= 0, "c_nationkey")
    return cleaning.exclusion_counts(flagged)


@query("p15_dashboard_universe", """
    select unitid, total_enrollment fte from sup_panel
    where survey_year = (select max(survey_year) from sup_panel) and completers > 0 and total_enrollment > 0""", "sup_panel")
def _(t: Tables):
    latest = t.sup_panel.filter(F.col("survey_year") == t.sup_panel.agg(F.max("survey_year")).scalar())
    return cleaning.dashboard_universe(latest, F.col("completers") > 0, "total_enrollment").select(
        "unitid", F.col("total_enrollment").alias("fte"))


@query("p16_facet_filter", """
    select c_custkey, c_name, c_mktsegment from customer
    where contains(lower(c_name || ' ' || c_mktsegment), '7') and c_mktsegment in ('BUILDING', 'MACHINERY')
      and c_nationkey in (1, 2, 3, 4, 5, 6) and c_acctbal >= 1000 and c_name is not null""")
def _(t: Tables):
    return cleaning.facet_filter(
        t.customer, text="7", text_cols=("c_name", "c_mktsegment"),
        within={"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": [1, 2, 3, 4, 5, 6]},
        minimum={"c_acctbal": 1000}, present=("c_name",)).select("c_custkey", "c_name", "c_mktsegment")


@query("p17_midpoint", """
    , p as (select unitid, survey_year, case when admits > 40 then admits end a, case when enrolled > 10 then enrolled end b,
      case when completers > 5 then completers end c, applicants d from sup_panel)
    select unitid, survey_year, (a + b + c + d) / 2 mid,
      cast(a is null or b is null or c is null or d is null as integer) mid_missing from p""", "sup_panel")
def _(t: Tables):
    parts = t.sup_panel.select("unitid", "survey_year", F.when(F.col("admits") > 40, F.col("admits")).alias("a"),
                               F.when(F.col("enrolled") > 10, F.col("enrolled")).alias("b"),
                               F.when(F.col("completers") > 5, F.col("completers")).alias("c"),
                               F.col("applicants").alias("d"))
    mid = parts.withColumn("mid", nulls.midpoint(["a", "b", "c", "d"]))
    return mid.select("unitid", "survey_year", "mid", nulls.missing_flag("mid").alias("mid_missing"))


@query("p18_log_floor_indicator", """
    , p as (select unitid, case when c_acctbal > 0 then c_acctbal end bal, c_acctbal from quasi)
    select unitid, round(case when c_acctbal > 0 then log10(c_acctbal) end, 6) log_balance,
      coalesce(bal, (select min(bal) from p)) bal, cast(bal is null as integer) bal_missing from p""", "quasi")
def _(t: Tables):
    df = t.quasi.select("unitid", R(nulls.log10_pos("c_acctbal"), 6).alias("log_balance"),
                        nulls.mask_negative(F.nullif("c_acctbal", F.lit(0.0))).alias("bal"))
    return cleaning.floor_encode(df, "bal").select("unitid", "log_balance", "bal", "bal_missing")


@query("p19_hold_small_cohorts", """
    select unitid, case when n < 30 then null else round(k / n, 6) end rate, case when n < 30 then round(k / n, 6) end rate_held,
      case when n < 30 then 'cohort of ' || n || ' is below 30' end rate_note from cohort""", "cohort")
def _(t: Tables):
    c = t.cohort.withColumn("rate", R(nulls.ratio("k", "n"), 6))
    return cleaning.hold_small_cohorts(c, {"rate": "n"}).select("unitid", "rate", "rate_held", "rate_note")


@query("p20_hold_family", """
    , f as (select c_custkey, c_name, c_nationkey fam, c_acctbal v, count(*) over (partition by c_nationkey) shared,
        c_custkey = min(c_custkey) over (partition by c_nationkey) anchor,
        first_value(c_name) over (partition by c_nationkey order by c_custkey) anchor_name from customer)
    select c_custkey, case when not (shared > 1 and not anchor) then v end v, case when shared > 1 and not anchor then v end v_held,
      case when shared > 1 and not anchor then 'shared by ' || shared || ', counted under ' || anchor_name end v_note from f""", "quasi")
def _(t: Tables):
    fam = t.customer.groupBy(F.col("c_nationkey").alias("fam")).agg(
        F.count("*").alias("shared"), F.min("c_custkey").alias("_first"))
    df = (t.customer.withColumnRenamed("c_nationkey", "fam").join(fam, "fam")
          .withColumn("anchor", F.col("c_custkey") == F.col("_first")).withColumnRenamed("c_acctbal", "v"))
    return cleaning.hold_family(df, ["v"], "fam", "anchor", "shared", "c_name").select("c_custkey", "v", "v_held", "v_note")


@query("p21_equity_flag", """
    select unitid, survey_year, coalesce(enrolled / nullif(completers, 0) - 1 > 0.25, false) at_risk from sup_panel""", "sup_panel")
def _(t: Tables):
    return t.sup_panel.select("unitid", "survey_year", cleaning.equity_flag(
        nulls.change("completers", "enrolled"), 0.25).alias("at_risk"))


@query("p22_temporal_split", """
    select case when survey_year <= 1998 then 'train' else 'test' end part, count(*) n, sum(n) orders from cust_panel group by 1""",
       "cust_panel")
def _(t: Tables):
    train, test = cleaning.split_by_year(t.cust_panel, "survey_year", 1998)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.sum("n").alias("orders"))


@query("p23_text_labels", """
    select distinct survey_year, 'FY ' || survey_year || '-' || lpad(cast((survey_year + 1) % 100 as varchar), 2, '0') fiscal,
      'F' || lpad(cast(survey_year % 100 as varchar), 2, '0') || lpad(cast((survey_year + 1) % 100 as varchar), 2, '0') || '_F1A' stem,
      case when survey_year + 26 >= 2024 then 'COST1_' || (survey_year + 26) else 'IC' || (survey_year + 26) || '_AY' end price_file
    from sup_panel""", "sup_panel")
def _(t: Tables):
    return t.sup_panel.select("survey_year").distinct().select(
        "survey_year", text.fiscal_label("survey_year").alias("fiscal"), text.finance_stem("survey_year").alias("stem"),
        text.price_stem(F.col("survey_year") + 26).alias("price_file"))


@query("p23_label_cleaning", """
    select p_partkey, p_type label, left(p_brand, 2) family from part""")
def _(t: Tables):
    noisy = F.concat("p_type", F.lit(" (PLEDGED REVENUES OF $"), F.col("p_size"), F.lit(") "))
    return t.part.select("p_partkey", text.clean_label(noisy).alias("label"), text.cip_family("p_brand").alias("family"))


@query("p24_change", """
    select unitid, n, k, round(k / n - 1, 6) rel, cast(null as double) zero_base from cohort""", "cohort")
def _(t: Tables):
    return t.cohort.select("unitid", "n", "k", R(nulls.change("n", "k"), 6).alias("rel"),
                           nulls.change(F.lit(0), "k").alias("zero_base"))


@query("p25_half_even", """
    select p_partkey, round_even(p_retailprice / 8, 1) places1, cast(round_even(p_size / 2, 0) as double) places0 from part""")
def _(t: Tables):
    return t.part.select("p_partkey", nulls.clean(F.col("p_retailprice") / 8, 1).alias("places1"),
                         nulls.clean(F.col("p_size") / 2, 0).alias("places0"))


_REQUIRED = {"orders": ["o_orderkey", "o_custkey"], "customer": ["c_custkey", "zip", "a_missing_one"], "lineitem": ["l_orderkey", "l_tax", "l_absent"]}


@query("p07_required_columns", """
    select 'orders' "table", '' missing, count(*) n_rows, 0 refused from orders
    union all select 'customer', 'a_missing_one,zip', count(*), count(*) from customer union all select 'lineitem', 'l_absent', count(*), count(*) from lineitem""")
def _(t: Tables):
    """Each table behind its guard: the columns it lacks, its rows, and the rows that a refused table keeps from going on."""
    out = []
    for name, needs in _REQUIRED.items():
        df, missing = getattr(t, name), []
        try:
            guards.require(df, needs, name)
        except ValueError as refused:
            missing = re.findall(r"'(\w+)'", str(refused).partition(":")[2])
        n = F.count("*").alias("n_rows")
        out.append(df.agg(n).select(F.lit(name).alias("table"), F.lit(",".join(missing)).alias("missing"), "n_rows", (F.col("n_rows") * int(bool(missing))).alias("refused")))
    return reduce(lambda a, b: a.unionByName(b), out)
