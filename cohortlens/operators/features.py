"""Derived ratios, completion rates, finance measures and series features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import change, log10_pos, ratio, ratio_nz, ratio_pos, round_half_up, row_sum
from .guards import require

KEYS = ["unitid", "survey_year"]


def student_faculty_ratio(ef: DataFrame, hr: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """FTE students (full-time plus a third of part-time) per FTE instructional faculty."""
    require(ef, [*keys, "ft_students", "pt_students"], "enrollment")
    require(hr, [*keys, "fte_instructional_faculty"], "staff")
    j = ef.join(hr, keys)
    fte = F.col("ft_students") + F.col("pt_students") / 3
    return j.select(*keys, fte.alias("fte_students"), ratio(fte, "fte_instructional_faculty").alias("student_faculty_ratio"))


def aid_intensity(sfa: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    require(sfa, [*keys, "pell_recipients", "total_undergrad", "total_grant_aid", "aid_recipients"], "aid")
    return sfa.select(*keys, ratio("pell_recipients", "total_undergrad").alias("pell_share"),
                      ratio("total_grant_aid", "aid_recipients").alias("avg_grant_per_recipient"))


def selectivity(adm: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    require(adm, [*keys, "applicants", "admits", "enrolled"], "admissions")
    return adm.select(*keys, ratio("admits", "applicants").alias("admit_rate"), ratio("enrolled", "admits").alias("yield_rate"))


def financial_health(fin: DataFrame, ef: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    require(fin, [*keys, "tuition_revenue", "total_revenue", "govt_appropriations", "total_expenses"], "finance")
    require(ef, [*keys, "total_enrollment"], "enrollment")
    return fin.join(ef.select(*keys, "total_enrollment"), keys).select(
        *keys, ratio("tuition_revenue", "total_revenue").alias("tuition_dependence"),
        ratio("govt_appropriations", "total_revenue").alias("appropriation_share"),
        ratio("total_expenses", "total_enrollment").alias("expense_per_student"))


def completion_rate(gr: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    require(gr, [*keys, "completers_150pct", "cohort_size"], "graduation")
    return gr.select(*keys, ratio("completers_150pct", "cohort_size").alias("completion_rate_150pct"))


def equity_gap(om: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Non-Pell minus Pell share (positive means a Pell deficit), and the opposite sign as pell_gap."""
    require(om, [*keys, "pell_completers_share", "non_pell_completers_share"], "outcomes")
    gap = F.col("non_pell_completers_share") - F.col("pell_completers_share")
    return om.select(*keys, gap.alias("equity_gap"), (-gap).alias("pell_gap"))


# Staff status codes (all, tenured, on track) and the all-ranks salary row.
TENURE_ALL, TENURED, ON_TRACK, ALL_RANKS = 0, 20, 30, 7


def tenure_density(sis: DataFrame, key: str = "unitid") -> DataFrame:
    """Tenured plus on-track share of full-time instructional staff; NULL without staff."""
    def of(code):
        return F.sum(F.when(F.col("facstat") == code, F.col("sistotl")))
    tenure = F.coalesce(of(TENURED), F.lit(0)) + F.coalesce(of(ON_TRACK), F.lit(0))
    return sis.groupBy(key).agg(of(TENURE_ALL).alias("ft_instr_staff"),
                                ratio_pos(tenure, of(TENURE_ALL)).alias("tenure_density"))


def salary_equity(sal: DataFrame, key: str = "unitid") -> DataFrame:
    """Women's over men's average salary on the all-ranks row."""
    return sal.filter(F.col("arank") == ALL_RANKS).select(
        key, F.col("saeq9am").alias("sal_men"), F.col("saeq9aw").alias("sal_women"),
        ratio_pos("saeq9aw", "saeq9am").alias("sal_w_to_m"))


# Ratio features of the institution table as name -> (numerator, denominator).
INSTITUTION_RATIOS = {
    "TUITION_SHARE": ("TUITION_REVENUE", "TOTAL_REVENUES"),
    "INSTR_EXP_SHARE": ("INSTRUCTION_EXPENSE", "TOTAL_EXPENSES"),
    "EXP_PER_FTE": ("TOTAL_EXPENSES", "FTE"),
    "INSTR_FTE_SHARE": ("SFTEINST", "SFTETOTL"),
    "MGMT_FTE_SHARE": ("SFTEMNGM", "SFTETOTL"),
    "TWELVE_TO_FALL": ("UNDUP", "ENRTOT"),
    "BA_RATE_150": ("BANC150", "BAAC150"),
    "L4_RATE_150": ("L4NC150", "L4AC150"),
}


def institution_features(df: DataFrame) -> DataFrame:
    """The engineered columns of the one-row-per-institution table, in one projection."""
    out = {name: ratio_pos(n, d) for name, (n, d) in INSTITUTION_RATIOS.items()}
    out["LOG_ENROLL"] = log10_pos("ENROLL_FALL")
    out["PELL_GAP"] = F.col("OM1PELLAWDP8") - F.col("OM1NPELAWDP8")
    out["ADMIT_RATE"], out["YIELD"] = F.col("DVADM01"), F.col("DVADM04")
    return df.withColumns(out)


def blank_parent_rows(df: DataFrame, own_report: str, cols: list[str], flag: str = "LIB_FROM_PARENT") -> DataFrame:
    """Values present although the unit filed no own report come from its parent: flag and blank them."""
    anything = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in cols])
    d = df.withColumn(flag, F.col(own_report).isNull() & anything)
    return d.withColumns({c: F.when(~F.col(flag), F.col(c)) for c in cols})


def harmonise_finance(forms: list[tuple[str, DataFrame, dict[str, str | None]]], key: str = "UNITID") -> tuple[DataFrame, DataFrame]:
    """Map incompatible finance forms onto shared concepts; returns (one row per key, overlapping keys).

    A unit on several forms keeps the first form in list order: a min over the form's position, so
    no window over the key is needed.
    """
    parts = []
    for position, (form, df, concepts) in enumerate(forms):
        parts.append(df.select(F.col(key), F.lit(form).alias("REPORTING_STANDARD"), F.lit(position).alias("_position"),
                               *[(F.col(c).try_cast("double") if c in df.columns else F.lit(None).cast("double")).alias(name)
                                 for name, c in ((n, c or "") for n, c in concepts.items())]))
    stacked = reduce(lambda a, b: a.unionByName(b), parts)
    payload = [c for c in stacked.columns if c not in (key, "_position")]
    grouped = stacked.groupBy(key).agg(F.min_by(F.struct(*payload), "_position").alias("_row"), F.count("*").alias("n_forms"))
    return grouped.select(key, "_row.*"), grouped.filter("n_forms > 1").select(key, "n_forms")


# Cohort codes (revised cohort, adjusted cohort, completers) of 4-year and 2-year cohorts.
GRAD_4YR, GRAD_2YR = (1, 2, 3), (27, 29, 30)


def grad_rates(gr: DataFrame, key: str = "unitid", code: str = "grtype", value: str = "grtotlt") -> DataFrame:
    """150% graduation rate from the larger usable cohort (4-year wins a tie), half-up to 2 places."""
    codes = [*GRAD_4YR, *GRAD_2YR]
    wide = gr.groupBy(key).agg(*[F.sum(F.when(F.col(code) == c, F.col(value))).alias(f"c{c}") for c in codes])

    def candidate(priority, rev, adj, comp):
        ok = (F.col(f"c{adj}") > 0) & F.col(f"c{comp}").isNotNull()
        return F.when(ok, F.struct(F.coalesce(f"c{rev}", f"c{adj}").cast("long").alias("cohort"), F.lit(priority).alias("priority"),
                                   round_half_up(f"c{comp}", f"c{adj}").alias("rate")))
    best = F.greatest(candidate(1, *GRAD_4YR), candidate(0, *GRAD_2YR))
    return wide.withColumn("_best", best).filter(F.col("_best").isNotNull()).select(key, "_best.cohort", "_best.rate")


def largest_cohort(df: DataFrame, key: str, cohort: str, ordinal: str, payload: list[str]) -> DataFrame:
    """One row per key with the largest cohort; the lowest ordinal wins a tie."""
    best = F.max_by(F.struct(cohort, ordinal, *payload), F.struct(F.col(cohort), -F.col(ordinal)))
    return df.filter(F.col(cohort).isNotNull()).groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def sum_codes(cols: list[str]) -> Column:
    """Row sum of several codes, NULL only when all are missing, rounded to whole numbers."""
    return F.bround(row_sum(cols), 0).cast("long")


def discount_rate(net: Column | str, discounts: Column | str) -> Column:
    n, d = (F.col(c) if isinstance(c, str) else c for c in (net, discounts))
    return F.bround(ratio_pos(d, n + d), 4)


def per_fte(value: Column | str, fte: Column | str, places: int = 0) -> Column:
    return F.bround(ratio_nz(value, fte), places)


def deflator(cpi: DataFrame, base_label: str, label: str = "fy", value: str = "cpi") -> DataFrame:
    """Factor that carries each year's money to the base year: cpi(base) / cpi(year), 5 places."""
    base = cpi.filter(F.col(label) == base_label).agg(F.max(value)).scalar()
    return cpi.select(label, F.bround(ratio(base, value), 5).alias("factor"))


def real_terms(df: DataFrame, factors: DataFrame, label: str, cols: list[str], extra: float = 1.0) -> DataFrame:
    """Multiply money columns by the year factor, chained with a constant factor."""
    f = factors.select(F.col(label).alias("_label"), F.col("factor").alias("_factor"))
    j = df.join(f, F.col(label) == F.col("_label"), "left")
    return j.withColumns({c: F.col(c) * F.col("_factor") * extra for c in cols}).drop("_label", "_factor")


def unit_collapse(campuses: DataFrame, unit: str, name: str, ordinal: str, payload: list[str]) -> DataFrame:
    """Campuses to one reporting unit: first campus' attributes and the ordered campus list."""
    members = F.transform(F.array_sort(F.collect_list(F.struct(ordinal, name))), lambda s: s[name])
    return campuses.groupBy(unit).agg(F.min_by(name, ordinal).alias(name),
                                      *[F.min_by(p, ordinal).alias(p) for p in payload], members.alias("campuses"))


def core_revenue(parts: list[str], state: str) -> dict[str, Column]:
    """Core revenue with missing parts as zero, and the state share of it."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(p), F.lit(0)) for p in parts])
    return {"core_revenue": total, "state_share": ratio_pos(F.coalesce(F.col(state), F.lit(0)), total)}


def statement_lines(df: DataFrame, named: list[str]) -> DataFrame:
    """Lines derived from a pivoted statement: totals, allowance, residual and operating income."""
    known = reduce(lambda a, b: a + b, [F.col(c) for c in named])
    return df.withColumns({
        "allowance": F.col("tuition_gross") - F.col("tuition_net"),
        "other_operating": F.col("operating_revenue") - known,
        "operating_income": F.col("operating_revenue") - F.col("operating_expense"),
        "before_other": F.col("operating_revenue") - F.col("operating_expense") + F.col("nonoperating"),
    })


def waterfall(df: DataFrame, key: str) -> DataFrame:
    """Income statement as waterfall steps: (key, step, label, low, high, amount)."""
    c = F.col
    gross, net, rev, exp = c("tuition_gross"), c("tuition_net"), c("operating_revenue"), c("operating_expense")
    fee, grants, non, cap = c("fee_for_service"), c("grants"), c("nonoperating"), c("other_revenues")
    op, zero = rev - exp, F.lit(0.0)
    bottom = op + non + cap
    steps = [
        ("gross tuition", zero, gross, gross), ("allowance", net, gross, net - gross), ("net tuition", zero, net, net),
        ("fee for service", net, net + fee, fee), ("grants", net + fee, net + fee + grants, grants),
        ("other", net + fee + grants, rev, rev - net - fee - grants), ("operating revenue", zero, rev, rev),
        ("operating expense", op, rev, -exp), ("operating income", F.least(zero, op), F.greatest(zero, op), op),
        ("nonoperating", op, op + non, non), ("capital and other", op + non, bottom, cap),
        ("change in net position", F.least(zero, bottom), F.greatest(zero, bottom), bottom),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("label"), lo.alias("low"), hi.alias("high"), a.alias("amount"))
                     for i, (n, lo, hi, a) in enumerate(steps, start=1)])
    return df.select(key, F.inline(rows))


def series_growth(df: DataFrame, key: list[str], year: str, value: str) -> DataFrame:
    """Compound growth from the first to the last reported year, and whether every year is reported."""
    seen = F.when(F.col(value).isNotNull(), F.col(year))
    n_years = df.select(year).distinct().agg(F.count("*")).scalar()
    g = df.groupBy(*key).agg(F.min_by(value, seen).alias("first_value"), F.max_by(value, seen).alias("last_value"),
                             F.min(seen).alias("first_year"), F.max(seen).alias("last_year"), F.count(value).alias("n_seen"))
    span = F.col("last_year") - F.col("first_year")
    ok = (F.col("first_value") > 0) & (F.col("last_value") > 0) & (span > 0)
    growth = F.when(ok, F.pow(ratio("last_value", "first_value"), ratio(F.lit(1), span)) - 1)
    return g.withColumn("cagr", growth).withColumn("complete", F.col("n_seen") == n_years)


def price_trajectories(df: DataFrame, key: str, cols: dict[str, int]) -> DataFrame:
    """Entities with a positive price in every year: growth per year, and whether the price is frozen."""
    names = list(cols)
    first, last = names[0], names[-1]
    keep = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) > 0, F.lit(False)) for c in names])
    years = cols[last] - cols[first]
    return df.filter(keep).withColumns({"cagr": F.pow(ratio(last, first), F.lit(1.0 / years)) - 1,
                                        "frozen": F.col(last) == F.col(first)})


def selectable_cohort(df: DataFrame, key: list[str], code: str, value: str, specs: list[tuple[str, int, int]]) -> DataFrame:
    """First usable (label, cohort code, completer code) by precedence, with its source label."""
    codes = sorted({c for _, a, b in specs for c in (a, b)})
    wide = df.groupBy(*key).agg(*[F.sum(F.when(F.col(code) == c, F.col(value))).alias(f"c{c}") for c in codes])
    out = None
    for label, den, num in specs:
        ok = F.col(f"c{den}") > 0
        s = F.struct(F.lit(label).alias("src"), F.col(f"c{den}").alias("den"), F.coalesce(F.col(f"c{num}"), F.lit(0)).alias("num"))
        out = F.when(ok, s) if out is None else out.when(ok, s)
    return wide.withColumn("_s", out).filter(F.col("_s").isNotNull()).select(*key, "_s.*")


def inclusive_retention(ft_num: str, ft_den: str, pt_num: str, pt_den: str) -> dict[str, Column]:
    """Full-time plus part-time retention, a missing part-time side counting as zero."""
    num = F.col(ft_num) + F.coalesce(F.col(pt_num), F.lit(0))
    den = F.col(ft_den) + F.coalesce(F.col(pt_den), F.lit(0))
    return {"num": num, "den": den, "rate": ratio_pos(num, den)}


def demographic_share(groups: list[str], total: str, nonresident: str) -> dict[str, Column]:
    """Share of the listed groups among residents, with the subgroup and the other count."""
    num = reduce(lambda a, b: a + b, [F.coalesce(F.col(g), F.lit(0)) for g in groups])
    den = F.col(total) - F.coalesce(F.col(nonresident), F.lit(0))
    return {"subgroup": num, "others": den - num, "share": ratio_pos(num, den)}


def merge_series(vintages: list[DataFrame], key: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Report vintages to one long table (zero means missing), and the keys on which they disagree."""
    stacked = reduce(lambda a, b: a.unionByName(b), vintages)
    g = stacked.groupBy(*key).agg(F.max(value).alias(value), F.min(value).alias("_low"))
    merged = g.select(*key, F.nullif(F.col(value), F.lit(0).cast(g.schema[value].dataType)).alias(value))
    return merged, g.filter(F.col(value) != F.col("_low")).select(*key, F.col("_low").alias("low"), F.col(value).alias("high"))


def pick_column(values: Column | str, choice: Column | str) -> Column:
    """Element 0 or 1 of a printed row, or the sum of both when the choice is -1."""
    v = F.col(values) if isinstance(values, str) else values
    c = F.col(choice) if isinstance(choice, str) else choice
    return F.when(c == -1, F.get(v, 0) + F.get(v, 1)).otherwise(F.get(v, c))


def missing_members(df: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    return expected.join(df, key, "left_anti")


def measure_grid(long: DataFrame, code_map: dict[str, list[str]], key: list[str], code: str, value: str) -> DataFrame:
    """Grouped variable codes to measures: wide (key, measure...), NULL only when all codes are missing."""
    aggs = [F.bround(F.sum(F.when(F.col(code).isin(*codes), F.col(value))), 0).cast("long").alias(m)
            for m, codes in code_map.items()]
    return long.groupBy(*key).agg(*aggs)


def entity_grid(values: DataFrame, units: DataFrame, entity: str, unit: str, year: str, cols: list[str]) -> DataFrame:
    """Sum unit measures over an entity-unit bridge, rounded, one row per (entity, year)."""
    j = values.join(units, unit)
    return j.groupBy(entity, year).agg(*[F.round(F.sum(c), 0).alias(c) for c in cols])


def year_pivot(df: DataFrame, key: list[str], year: str, value: str, years: list[int], prefix: str = "y") -> DataFrame:
    """Wide by year with an explicit year list, by conditional aggregates."""
    return df.groupBy(*key).agg(*[F.sum(F.when(F.col(year) == y, F.col(value))).alias(f"{prefix}{y}") for y in years])


def relative(first: str, last: str) -> Column:
    return change(first, last)
