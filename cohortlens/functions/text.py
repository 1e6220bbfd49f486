"""Code, label and amount text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col

# Dash, quote and space variants found in intro sheets, and what they mean.
FANCY = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\u2019\u00a0"
PLAIN = "-------' "

# Components revised a year after first release.
REVISABLE_PREFIXES = ("ADM", "COST", "EFIA", "GR", "SFA")


def code_key(c: Column | str) -> Column:
    """Canonical text of a categorical code: a float rendering loses its ".0", anything else is kept.

    "1.0" -> "1" and "-0" -> "0"; "01.0000" and "10.0000" keep their significant zeros.
    """
    t = F.trim(col(c).cast("string"))
    plain = F.regexp_replace(t, r"\.0$", "")
    float_like = t.rlike(r"^(-?[1-9][0-9]*(\.0)?|-?0(\.0)?)$")
    return F.when(float_like, F.when(plain == "-0", F.lit("0")).otherwise(plain)).otherwise(t)


def amount(c: Column | str) -> Column:
    """Accounting text to double: "$1,234" and "(1,234.50)" and "-7"; "-" or blank is zero."""
    t = F.regexp_replace(col(c), r"[ $]", "")
    negative = (t.startswith("(") & t.endswith(")")) | t.startswith("-")
    value = F.regexp_replace(t, r"[()\-,]", "").try_cast("double")
    return F.when(t.isin("", "-"), F.lit(0.0)).otherwise(F.when(negative, -value).otherwise(value))


def cip_family(c: Column | str) -> Column:
    return F.substring(col(c), 1, 2)


def clean_label(c: Column | str) -> Column:
    """Statement label without its pledged-revenue remark."""
    return F.trim(F.regexp_replace(col(c), r"\s*\(PLEDGED REVENUES OF [^)]*\)", ""))


def fiscal_label(start: Column | str) -> Column:
    """2025 -> "FY 2025-26"."""
    s = col(start).cast("int")
    return F.format_string("FY %d-%02d", s, F.pmod(s + 1, F.lit(100)))


def fiscal_start(year: Column | str, month: Column | str) -> Column:
    """Fiscal year (July to June) an observation belongs to, as its starting calendar year."""
    return F.when(col(month) >= 7, col(year)).otherwise(col(year) - 1)


def finance_stem(start: Column | str) -> Column:
    """2014 -> "F1415_F1A": file stem of the public-institution finance form."""
    s = col(start).cast("int")
    return F.format_string("F%02d%02d_F1A", F.pmod(s, F.lit(100)), F.pmod(s + 1, F.lit(100)))


def price_stem(year: Column | str, first_cost_year: int = 2024) -> Column:
    """Prices moved from the yearly charges file to the cost component in 2024."""
    y = col(year).cast("int")
    return F.when(y >= first_cost_year, F.format_string("COST1_%d", y)).otherwise(F.format_string("IC%d_AY", y))


def is_provisional(stem: Column | str, source_file: Column | str) -> Column:
    """A revisable component whose landed member is not the revised release."""
    s = F.upper(col(stem))
    revisable = s.startswith("EF") & s.endswith("D")
    for prefix in REVISABLE_PREFIXES:
        revisable = revisable | s.startswith(prefix)
    return revisable & ~F.lower(col(source_file)).endswith("_rv.csv")


def plain_text(c: Column | str) -> Column:
    """Dashes, quotes and no-break spaces normalised to ASCII."""
    return F.translate(col(c), FANCY, PLAIN)
