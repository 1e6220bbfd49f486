"""Performance-funding allocation: D ratios, weighted shares, reconstruction and counterfactuals.

Boards are few, institutions many: institution rows are reduced to board sums first, and every
counterfactual is expressed in closed form over the board table instead of by re-running scenarios
against each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import false_if_null, ratio
from ..functions.text import fiscal_label
from .guards import assert_empty
from .lineage import cut

# Weights of the eight metrics of the funding step.
WEIGHTS = {
    "resident_fte": 0.10,
    "first_gen": 0.05,
    "credentials": 0.05,
    "pell_share": 0.20,
    "urm_share": 0.20,
    "retention": 0.20,
    "grad100": 0.10,
    "grad150": 0.10,
}
# Data years of a formula year t run from t - first to t - last.
DEFAULT_WINDOW, WINDOWS = (5, 2), {"credentials": (4, 1)}


def check_weights(weights: dict[str, float]) -> None:
    total = sum(weights.values())
    if abs(total - 1) > 1e-8:
        raise ValueError(f"weights sum to {total:.4f}, not 1")


def formula_windows(spark: SparkSession, start: int, metrics: list[str], *, windows: dict[str, tuple[int, int]] | None = None,
                    shift: int = 0) -> DataFrame:
    """Window rows (metric, position 1..4, year) for the formula year starting July ``start``."""
    spec = WINDOWS if windows is None else windows
    rows = []
    for m in metrics:
        first, last = spec.get(m, DEFAULT_WINDOW)
        rows += [(m, i + 1, y + shift) for i, y in enumerate(range(start - first, start - last + 1))]
    return spark.createDataFrame(rows, "metric string, position int, year int")


def windows_by_start(starts: DataFrame, start: str, metrics: list[str], *, windows: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Window rows of every formula year in a table: (start_year, metric, position, year)."""
    spec = WINDOWS if windows is None else windows
    rows = []
    for m in metrics:
        first, last = spec.get(m, DEFAULT_WINDOW)
        rows += [F.struct(F.lit(m).alias("metric"), F.lit(i + 1).alias("position"), (F.col(start) - back).alias("year"))
                 for i, back in enumerate(range(first, last - 1, -1))]
    return starts.select(F.col(start).alias("start_year"), F.inline(F.array(*rows)))


def label_years(windows: DataFrame) -> DataFrame:
    return windows.withColumn("fiscal", fiscal_label("year"))


def shift_unpublished(windows: DataFrame, panel: DataFrame) -> DataFrame:
    """Move a metric's window back one year when its newest year is not published yet, with a note."""
    newest = panel.groupBy("metric").agg(F.max("year").alias("_newest"))
    need = windows.groupBy("metric").agg(F.max("year").alias("_last")).join(newest, "metric").withColumn(
        "_back", (F.col("_last") > F.col("_newest")).cast("int"))
    return windows.join(need.select("metric", "_back"), "metric").select(
        "metric", "position", (F.col("year") - F.col("_back")).alias("year"), (F.col("_back") == 1).alias("shifted"))


def d_ratio(df: DataFrame, keys: list[str], position: str = "position", value: str = "value", name: str = "d") -> DataFrame:
    """Mean of the four window years over the mean of the three oldest; NULL unless all four exist."""
    four = (F.count(value) == 4) & (F.count_distinct(F.when(F.col(value).isNotNull(), F.col(position))) == 4)
    return df.groupBy(*keys).agg(F.when(four, ratio(F.avg(value), F.avg(F.when(F.col(position) <= 3, F.col(value))))).alias(name))


def in_window(panel: DataFrame, windows: DataFrame) -> DataFrame:
    return panel.join(windows.select("metric", "year", "position"), ["metric", "year"])


def consistent_reporters(windowed: DataFrame, size: int = 4) -> DataFrame:
    """(metric, unitid) reporting every window year, with a valid rate, under one definition.

    A missing definition counts as a definition of its own.
    """
    valid = F.col("num").isNotNull() & (F.col("den").isNull() | (F.col("den") > 0))
    g = windowed.groupBy("metric", "unitid").agg(
        F.count_distinct("year").alias("_years"), F.bool_and(valid).alias("_valid"),
        F.count_distinct(F.coalesce("src", F.lit("(missing)"))).alias("_defs"))
    return g.filter((F.col("_years") == size) & F.col("_valid") & (F.col("_defs") == 1)).select("metric", "unitid")


def board_series(windowed: DataFrame, keep: DataFrame, how: str = "pooled") -> DataFrame:
    """(metric, board, position, year, value): pooled sums, or the mean of institution rates.

    A metric without any denominator is a count: its values are sums of numerators.
    """
    if how not in ("pooled", "mean"):
        raise ValueError("how must be 'pooled' or 'mean'")
    d = windowed.join(keep, ["metric", "unitid"], "left_semi")
    is_count = d.groupBy("metric").agg((F.count("den") == 0).alias("_count"))
    g = d.groupBy("metric", "board", "position", "year").agg(F.sum("num").alias("_n"), F.sum("den").alias("_d"), F.avg(ratio("num", "den")).alias("_m"))
    rate = ratio("_n", "_d") if how == "pooled" else F.col("_m")
    return g.join(is_count, "metric").select("metric", "board", "position", "year",
                                             F.when(F.col("_count"), F.col("_n")).otherwise(rate).alias("value"))


def metric_allocation(prior: DataFrame, d: DataFrame) -> DataFrame:
    """Per metric: prior share times D, normalised over the boards (sums by aggregate, joined back).

    Use ``refuse_missing`` first when a missing D must stop the job.
    """
    j = d.join(prior, "board").withColumn("_ad", F.col("prior") * F.col("d"))
    total = j.groupBy("metric").agg(F.sum("_ad").alias("_s"))
    return j.join(total, "metric").select("metric", "board", "prior", "d", "_s", ratio("_ad", "_s").alias("allocation"))


def refuse_missing(d: DataFrame) -> DataFrame:
    assert_empty(d.filter(F.col("d").isNull()), "D is missing; refusing to allocate on a partial set")
    return d


def prior_shares(df: DataFrame, board: str, money: str) -> DataFrame:
    total = df.agg(F.sum(money)).scalar()
    return df.select(F.col(board).alias("board"), ratio(F.col(money), total).alias("prior"))


def weight_table(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    check_weights(weights)
    return spark.createDataFrame([(m, float(w)) for m, w in weights.items()], "metric string, weight double")


def step2_shares(prior: DataFrame, d: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted shares by board; a metric absent from d keeps the prior share. Shares add to one.

    A board without D for a metric that others have cannot be allocated: its share is NULL.
    """
    w = weight_table(prior.sparkSession, weights)
    used = d.select("metric").distinct().join(w, "metric").agg(F.struct(F.count("*").alias("k"), F.sum("weight").alias("w"))).scalar()
    alloc = metric_allocation(prior, d).join(w, "metric")
    g = alloc.groupBy("board").agg(F.sum(F.col("weight") * F.col("allocation")).alias("_a"), F.count("allocation").alias("_k"),
                                   F.any_value("prior").alias("prior")).withColumn("_u", used)
    share = F.when(F.col("_k") == F.col("_u.k"), F.col("_a") + (1 - F.col("_u.w")) * F.col("prior"))
    return g.select("board", "prior", share.alias("share"))


def board_d(panel: DataFrame, start: int, metrics: list[str], *, windows: dict | None = None, how: str = "pooled", shift: int = 0) -> DataFrame:
    """D per (metric, board) for one formula year."""
    w = shift_unpublished(formula_windows(panel.sparkSession, start, metrics, windows=windows, shift=shift), panel)
    inside = cut(in_window(panel, w))
    return d_ratio(board_series(inside, consistent_reporters(inside), how), ["metric", "board"])


def redistribution(df: DataFrame, base: str, new: str) -> DataFrame:
    """Actual allocation beside a uniform increase of the same total, and the money moved."""
    growth = df.agg(ratio(F.sum(new), F.sum(base))).scalar()
    uniform = F.col(base) * F.col("_g")
    return df.withColumn("_g", growth).select(
        "board", F.col(base).alias("base"), F.col(new).alias("actual"), uniform.alias("uniform"), (F.col(new) - uniform).alias("moved"),
        ((ratio(new, base) - 1) * 100).alias("actual_pct"))


def reconstruct(panel: DataFrame, funds: DataFrame, start: int, weights: dict[str, float], metrics: list[str], **how) -> DataFrame:
    """Predicted and actual percentage change by board for one formula year.

    ``funds`` is long (board, year, funding); the predicted total is the actual one.
    """
    base = funds.filter(F.col("year") == start - 1)
    shares = step2_shares(prior_shares(base, "board", "funding"), board_d(panel, start, metrics, **how), weights)
    new = funds.filter(F.col("year") == start)
    total = new.agg(F.sum("funding")).scalar()
    j = (shares.join(base.select("board", F.col("funding").alias("base")), "board")
         .join(new.select("board", F.col("funding").alias("new")), "board").withColumn("_total", total))
    predicted = (ratio(F.col("share") * F.col("_total"), "base") - 1) * 100
    actual = (ratio("new", "base") - 1) * 100
    return j.select("board", actual.alias("actual_pct"), predicted.alias("predicted_pct"), (predicted - actual).alias("error"))


def fit_quality(result: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return result.groupBy(*(keys or [])).agg(F.corr("actual_pct", "predicted_pct").alias("correlation"), F.sqrt(F.avg(F.pow("error", 2))).alias("rmse"))


def variants(panel: DataFrame, funds: DataFrame, start: int, weights: dict[str, float], metrics: list[str], cases: dict[str, dict],
             windows: dict | None = None) -> DataFrame:
    """Fit quality of several reconstructions (window shift, pooling, metrics held neutral)."""
    parts = []
    for name, case in cases.items():
        used = [m for m in metrics if m not in case.get("neutral", ())]
        r = reconstruct(panel, funds, start, weights, used, windows=windows, how=case.get("how", "pooled"), shift=case.get("shift", 0))
        parts.append(fit_quality(r).select(F.lit(name).alias("variant"), "correlation", "rmse"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _bumped_share(alloc: DataFrame, new_d: Column, weight: float) -> Column:
    """Change of a board's total share when only its own D of one metric changes."""
    ad = F.col("prior") * new_d
    return (ratio(ad, F.col("_s") - F.col("prior") * F.col("d") + ad) - F.col("allocation")) * weight


def marginal_value(series: DataFrame, prior: DataFrame, cohort: DataFrame, pot: float | Column, metric: str, weight: float, step: float = 0.01) -> DataFrame:
    """Money for one more point in the newest window year, and per extra student, for every board.

    Only the board's own D moves, so its new share follows from the metric's normalising sum.
    """
    s = series.filter(F.col("metric") == metric)
    d0 = d_ratio(s, ["metric", "board"])
    d1 = d_ratio(s.withColumn("value", F.col("value") + F.when(F.col("position") == 4, step).otherwise(0.0)), ["metric", "board"], name="d1")
    newest = s.filter("position = 4").select("board", F.col("value").alias("rate"))
    a = metric_allocation(prior, d0).join(d1.drop("metric"), "board").join(newest, "board").join(cohort, "board", "left")
    money = _bumped_share(a, F.col("d1"), weight) * pot
    return a.select("board", "rate", "cohort", money.alias("per_point"), ratio(money, F.col("cohort") * step).alias("per_student"))


def reward_path(df: DataFrame, key: str, step: str, windows: int = 6) -> DataFrame:
    """D - 1 in the successive windows after a lasting relative step of size ``step``."""
    i = F.explode(F.sequence(F.lit(1), F.lit(windows))).alias("window")
    d = df.select(key, step, i)

    def level(offset):  # window w covers level positions w-1 .. w+2; the step happens at position 3
        return F.when(F.col("window") - 1 + offset >= 3, 1 + F.col(step)).otherwise(F.lit(1.0))
    three = (level(0) + level(1) + level(2)) / 3
    mean = (level(0) + level(1) + level(2) + level(3)) / 4
    return d.select(key, "window", (ratio(mean, three) - 1).alias("gain"))


def held_flat(windowed: DataFrame, history: DataFrame, visible: DataFrame, first_year: int, last_year: int, min_share: float = 0.25) -> DataFrame:
    """Window rows with every invisible unit filled by its last qualifying cohort.

    A cohort qualifies when it is at least ``min_share`` of the unit's first-year cohort. The last one
    is a max over (year), so no window over the unit is needed.
    """
    hidden = history.join(visible, ["metric", "unitid"], "left_anti").filter(F.col("year") <= last_year)
    first = hidden.filter(F.col("year") == first_year).groupBy("metric", "unitid").agg(F.sum("den").alias("_first"))
    ok = hidden.join(first, ["metric", "unitid"]).filter((F.col("_first") > 0) & (F.col("den") >= min_share * F.col("_first")))
    last = ok.groupBy("metric", "unitid", "board").agg(F.max_by(F.struct("num", "den"), "year").alias("_l"))
    years = windowed.select("metric", "year", "position").distinct()
    flat = last.join(years, "metric").select("metric", "unitid", "board", "year", "position", "_l.num", "_l.den")
    seen = windowed.join(visible, ["metric", "unitid"], "left_semi").select("metric", "unitid", "board", "year", "position", "num", "den")
    return seen.unionByName(flat)


def pooled_d(windowed: DataFrame, keys: list[str], name: str = "d") -> DataFrame:
    """D of pooled sums per key."""
    s = windowed.groupBy(*keys, "position").agg(ratio(F.sum("num"), F.sum("den")).alias("value"))
    return d_ratio(s, keys, name=name)


def leave_one_out_d(windowed: DataFrame, keys: list[str], unit: str = "unitid") -> DataFrame:
    """D of each key without one unit at a time: totals minus the unit's own rows."""
    own = windowed.groupBy(*keys, unit, "position").agg(F.sum("num").alias("_n"), F.sum("den").alias("_d"))
    total = windowed.groupBy(*keys, "position").agg(F.sum("num").alias("_tn"), F.sum("den").alias("_td"))
    rest = own.join(total, [*keys, "position"]).withColumn("value", ratio(F.col("_tn") - F.col("_n"), F.col("_td") - F.col("_d")))
    return d_ratio(rest, [*keys, unit])


def required_d(alloc: DataFrame, target_change: Column, weight: float) -> DataFrame:
    """D a board would need on one metric for its total share to change by ``target_change``.

    The metric's allocation must reach a' = a + change / weight; solving a' = A D / (R + A D) for D
    gives R a' / (A (1 - a')), with R the sum over the other boards.
    """
    a1 = F.col("allocation") + target_change / weight
    rest = F.col("_s") - F.col("prior") * F.col("d")
    return alloc.select("metric", "board", "d", F.when((a1 > 0) & (a1 < 1), ratio(rest * a1, F.col("prior") * (1 - a1))).alias("required_d"))


def spliced(old: DataFrame, new: DataFrame) -> DataFrame:
    """Window series whose newest year follows the new definition and whose older years the old one."""
    return old.filter("position < 4").unionByName(new.filter("position = 4"))


def compare_definitions(prior: DataFrame, d_old: DataFrame, d_new: DataFrame, weights: dict[str, float], money: float) -> DataFrame:
    """Money moved to each board when one definition replaces another."""
    a = step2_shares(prior, d_old, weights).select("board", F.col("share").alias("_old"))
    b = step2_shares(prior, d_new, weights).select("board", F.col("share").alias("_new"))
    return a.join(b, "board").select("board", ((F.col("_new") - F.col("_old")) * money).alias("moved"))


def agreement(df: DataFrame, estimate: str, published: str) -> DataFrame:
    """Correlation, sign agreements and money moved of an estimate against published amounts."""
    same = false_if_null(F.signum(estimate) == F.signum(published))
    return df.agg(F.corr(estimate, published).alias("correlation"), F.count_if(same).alias("signs_agree"), F.count("*").alias("n"),
                  F.sum(F.greatest(F.col(estimate), F.lit(0.0))).alias("moved_estimate"),
                  F.sum(F.greatest(F.col(published).cast("double"), F.lit(0.0))).alias("moved_published"))
