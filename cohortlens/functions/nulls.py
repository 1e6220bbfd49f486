"""Missing-value, ratio and rounding rules, decided once for every operator.

There are three ratio rules and three sentinel rules, on purpose: surveys
disagree about what a zero denominator or a negative code means, so callers pick.
NaN never leaves a function of this module; NULL is the only missing value.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reserved survey codes (not reported, not applicable, not available, other).
RESERVED_CODES = (-1, -2, -3, -9)
DIRECTORY_RESERVED_CODES = (-1, -2, -3)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """Coerce to double; text that is not a number, and NaN, become NULL."""
    return F.nanvl(col(c).try_cast("double"), F.lit(None).cast("double"))


def ratio(num: Column | str, den: Column | str) -> Column:
    """num/den, NULL when the denominator is zero or missing (never infinity)."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def ratio_pos(num: Column | str, den: Column | str) -> Column:
    """num/den only where the denominator is positive."""
    return F.when(col(den) > 0, ratio(num, den))


def ratio_nz(num: Column | str, den: Column | str) -> Column:
    """num/den only where both sides are present, the numerator non-zero and the denominator positive."""
    return F.when((col(num) != 0) & (col(den) > 0), ratio(num, den))


def change(base: Column | str, new: Column | str) -> Column:
    """Relative change new/base - 1, NULL when the base is zero."""
    return ratio(new, base) - 1


def mask_codes(c: Column | str, codes: Iterable[int] = RESERVED_CODES) -> Column:
    c = col(c)
    return F.when(~c.isin(*codes), c)


def mask_negative(c: Column | str) -> Column:
    """Numeric value, NULL for text and for anything below zero."""
    x = number(c)
    return F.when(x >= 0, x)


def signed(c: Column | str) -> Column:
    """Numeric value that may be negative, but for which zero means missing."""
    x = number(c)
    return F.when(x != 0, x)


def false_if_null(cond: Column) -> Column:
    """A comparison with a missing value counts as False."""
    return F.coalesce(cond, F.lit(False))


def round_half_up(num: Column | str, den: Column | str, places: int = 2) -> Column:
    """Exact half-up rounding of a ratio of two integers, in integer arithmetic."""
    scale = 10**places
    n, d = col(num).cast("long"), F.nullif(col(den).cast("long"), F.lit(0))
    twice = F.lit(2 * scale) * n + d
    whole = (twice - F.pmod(twice, F.lit(2) * d)) / (F.lit(2) * d)
    return F.when(d > 0, F.round(whole, 0) / scale)


def clean(c: Column | str, places: int | None = None) -> Column:
    """Half-even rounding that keeps missing values missing."""
    x = number(c)
    return x if places is None else F.bround(x, places)


def log10_pos(c: Column | str) -> Column:
    x = number(c)
    return F.when(x > 0, F.log10(x))


def clip(c: Column | str, low: float, high: float) -> Column:
    """Bound to [low, high]; missing stays missing (least/greatest alone would skip NULL)."""
    x = col(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def n_present(cols: Iterable[Column | str]) -> Column:
    return reduce(lambda a, b: a + b, [col(c).isNotNull().cast("int") for c in cols])


def row_sum(cols: Iterable[Column | str], min_count: int = 1) -> Column:
    """Sum across columns, missing parts as 0, NULL unless min_count parts are present."""
    cols = [col(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cols])
    return F.when(n_present(cols) >= min_count, total)


def midpoint(cols: Iterable[Column | str], min_count: int = 4) -> Column:
    """Half the sum of the parts (two quartiles of two sections), NULL unless all are present."""
    cols = list(cols)
    return row_sum(cols, min_count) / 2


def missing_flag(c: Column | str) -> Column:
    return col(c).isNull().cast("int")


def mask_reserved(df: DataFrame, cols: Iterable[str], codes: Iterable[int] = RESERVED_CODES) -> DataFrame:
    """Mask reserved codes in the named columns; the other columns are untouched."""
    codes = tuple(codes)
    return df.withColumns({c: mask_codes(c, codes) for c in cols})


def masked_counts(df: DataFrame, cols: Iterable[str], codes: Iterable[int] = RESERVED_CODES) -> DataFrame:
    """One row per column with the number of cells the mask removes, from a single aggregate."""
    cols, codes = list(cols), tuple(codes)
    one = df.agg(*[F.count_if(F.col(c).isin(*codes)).alias(c) for c in cols])
    return one.unpivot([], cols, "column", "n_masked")


def no_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column (used at file and Python boundaries)."""
    fix = {f.name: F.nanvl(F.col(f.name), F.lit(None)) for f in df.schema.fields
           if f.dataType.typeName() in ("double", "float")}
    return df.withColumns(fix) if fix else df
