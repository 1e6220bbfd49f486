"""Queries over the funding-formula operators (B family, A13, A14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nulls
from ..operators import funding as fu
from .derived import rounded
from .registry import query
from .tables import Tables

R = F.round
METRICS = ["retention", "admit", "yield"]
W = {"retention": 0.4, "admit": 0.3, "yield": 0.1, "first_gen": 0.2}
WINDOWS = {"yield": (4, 1)}
T = 2001

_WIN = """
    , win as (select metric, y - first + 1 pos, y as year from (values ('retention', 1996), ('admit', 1996), ('yield', 1997)) v(metric, first),
      lateral (select unnest(generate_series(first, first + 3)) y)),
    pw as (select p.*, w.pos from metric_panel p join win w on p.metric = w.metric and p.year = w.year),
    keep as (select metric, unitid from pw group by 1, 2 having count(distinct year) = 4 and bool_and(num is not null and (den is null or den > 0)) and count(distinct src) = 1),
    ser as (select metric, board, pos, year, sum(num) / sum(den) v, avg(num / den) mv from pw semi join keep using (metric, unitid) group by 1, 2, 3, 4),
    d as (select metric, board, case when count(v) = 4 then avg(v) / avg(v) filter (pos <= 3) end d from ser group by 1, 2),
    prior as (select board, funding / sum(funding) over () a from board_year where year = 2000),
    alloc as (select metric, board, a, d, sum(a * d) over (partition by metric) s, a * d / sum(a * d) over (partition by metric) al from d join prior using (board)),
    wt as (select * from (values ('retention', 0.4::double), ('admit', 0.3), ('yield', 0.1)) v(metric, w)),
    sh as (select board, a, case when count(al) = 3 then sum(w * al) + 0.2::double * a end share from alloc join wt using (metric) group by board, a)"""
V = "metric_panel board_year"


def panel(t: Tables):
    """The long metric panel, written once per query: windows, reporters and series all read it."""
    return t.once("metric_panel")


def _windows(t: Tables, metrics=METRICS):
    return fu.formula_windows(t.spark, T, metrics, windows=WINDOWS)


def _windowed(t: Tables):
    return fu.in_window(panel(t), _windows(t))


def _series(t: Tables, how="pooled"):
    w = _windowed(t)
    return fu.board_series(w, fu.consistent_reporters(w), how)


def _d(t: Tables):
    return fu.board_d(panel(t), T, METRICS, windows=WINDOWS)


def _prior(t: Tables):
    return fu.prior_shares(t.once("board_year").filter(F.col("year") == T - 1), "board", "funding")


@query("a13_consistent_reporters", _WIN + "select metric, unitid from keep", V)
def _(t: Tables):
    return fu.consistent_reporters(_windowed(t))


@query("a14_board_series", _WIN + "select metric, board, pos::int as position, year::int as year, round(v, 6) pooled, round(mv, 6) mean_rate from ser", V)
def _(t: Tables):
    k = ["metric", "board", "position", "year"]
    a = _series(t).withColumnRenamed("value", "pooled")
    return rounded(a.join(_series(t, "mean").withColumnRenamed("value", "mean_rate"), k), ["pooled", "mean_rate"])


@query("a14_board_counts", """
    , c as (select board, year, sum(num) v from metric_panel where metric = 'yield' and year between 1997 and 2000 and unitid in
      (select unitid from metric_panel where metric = 'yield' and year between 1997 and 2000 group by 1 having count(distinct year) = 4 and count(distinct src) = 1) group by 1, 2)
    select board, year, cast(v as bigint) as value from c""", "metric_panel")
def _(t: Tables):
    counts = panel(t).filter("metric = 'yield'").withColumn("den", F.lit(None).cast("long"))
    w = fu.in_window(counts, _windows(t, ["yield"]))
    return fu.board_series(w, fu.consistent_reporters(w)).select("board", "year", F.col("value").cast("long").alias("value"))


@query("b01_d_ratio", _WIN + "select metric, board, round(d, 6) d from d", V)
def _(t: Tables):
    return rounded(_d(t), ["d"])


@query("b02_metric_allocation", _WIN + "select metric, board, round(al, 6) allocation from alloc", V)
def _(t: Tables):
    return rounded(fu.metric_allocation(_prior(t), fu.refuse_missing(_d(t))).select("metric", "board", "allocation"), ["allocation"])


@query("b03_step2_shares", _WIN + "select board, round(a, 6) prior, round(share, 6) share from sh", V)
def _(t: Tables):
    return rounded(fu.step2_shares(_prior(t), _d(t), W), ["prior", "share"])


@query("b04_formula_windows", """
    select distinct p.metric, f.t as start_year, y::int as year, 'FY ' || y || '-' || lpad(((y + 1) % 100)::varchar, 2, '0') fiscal from metric_panel p, (select distinct year as t from metric_panel) f,
      lateral (select unnest(generate_series(case when p.metric = 'yield' then t - 4 else t - 5 end, case when p.metric = 'yield' then t - 1 else t - 2 end)) y)""", "metric_panel")
def _(t: Tables):
    starts = panel(t).select("year").distinct()
    return fu.label_years(fu.windows_by_start(starts, "year", METRICS, windows=WINDOWS)).select("metric", "start_year", "year", "fiscal")


_REDIS = """
    , f as (select board, sum(funding) filter (year = 1999) b, sum(funding) filter (year = 2000) n from board_year group by 1),
    r as (select board, b, n, b * sum(n) over () / sum(b) over () u from f)"""


def _redistribution(t: Tables):
    f = t.once("board_year").groupBy("board").agg(F.sum(F.when(F.col("year") == 1999, F.col("funding"))).alias("b"), F.sum(F.when(F.col("year") == 2000, F.col("funding"))).alias("n"))
    return fu.redistribution(f, "b", "n")


@query("b05_redistribution", _REDIS + """
    select board, round(b, 0) base, round(n, 0) actual, round(u, 0) uniform, round(n - u, 0) moved, round((n / b - 1) * 100, 6) actual_pct from r""", "board_year")
def _(t: Tables):
    return rounded(rounded(_redistribution(t), ["base", "actual", "uniform", "moved"], 0), ["actual_pct"])


_FUNDS = """
    , tot as (select sum(funding) tot from board_year where year = 2001), b0 as (select board, funding f0 from board_year where year = 2000),
    b1 as (select board, funding f1 from board_year where year = 2001),
    rec as (select board, (f1 / f0 - 1) * 100 act, (share * tot / f0 - 1) * 100 pred from sh join b0 using (board) join b1 using (board), tot)"""


@query("b06_reconstruction", _WIN + _FUNDS + "select board, round(act, 6) actual_pct, round(pred, 6) predicted_pct, round(pred - act, 6) error from rec", V)
def _(t: Tables):
    return rounded(fu.reconstruct(panel(t), t.once("board_year"), T, W, METRICS, windows=WINDOWS), ["actual_pct", "predicted_pct", "error"])


@query("b06_fit_quality", _WIN + _FUNDS + "select round(corr(act, pred), 6) correlation, round(sqrt(avg(pow(pred - act, 2))), 6) rmse from rec", V)
def _(t: Tables):
    return rounded(fu.fit_quality(fu.reconstruct(panel(t), t.once("board_year"), T, W, METRICS, windows=WINDOWS)), ["correlation", "rmse"])


@query("b06_window_fallback", """
    , mx as (select metric, max(year) newest from metric_panel group by 1)
    select metric, (y - first + 1)::int as position, (y - (first + 3 > newest)::int)::int as year, first + 3 > newest shifted from
      (values ('retention', 1998), ('admit', 1998), ('yield', 1999)) v(metric, first) join mx using (metric), lateral (select unnest(generate_series(first, first + 3)) y)""", "metric_panel")
def _(t: Tables):
    return fu.shift_unpublished(fu.formula_windows(t.spark, 2003, METRICS, windows=WINDOWS), panel(t))


def _variant_sql(name, ser_expr, years, weights):
    """Fit of one variant as a self-contained CTE chain with suffixed names."""
    vals = ", ".join(f"('{m}', {y})" for m, y in years.items())
    ws = ", ".join(f"('{m}', {w}::double)" for m, w in weights.items())
    rest = round(1 - sum(weights.values()), 10)
    return f"""
    win_{name} as (select metric, y - first + 1 pos, y as year from (values {vals}) v(metric, first), lateral (select unnest(generate_series(first, first + 3)) y)),
    pw_{name} as (select p.*, w.pos from metric_panel p join win_{name} w on p.metric = w.metric and p.year = w.year),
    keep_{name} as (select metric, unitid from pw_{name} group by 1, 2 having count(distinct year) = 4 and count(distinct src) = 1),
    ser_{name} as (select metric, board, pos, {ser_expr} v from pw_{name} semi join keep_{name} using (metric, unitid) group by 1, 2, 3),
    d_{name} as (select metric, board, avg(v) / avg(v) filter (pos <= 3) d from ser_{name} group by 1, 2),
    al_{name} as (select metric, board, a, a * d / sum(a * d) over (partition by metric) al from d_{name} join prior using (board)),
    sh_{name} as (select board, a, case when count(al) = {len(weights)} then sum(w * al) + {rest}::double * a end share from al_{name} join (select * from (values {ws}) x(metric, w)) using (metric) group by board, a),
    rec_{name} as (select (f1 / f0 - 1) * 100 act, (share * tot / f0 - 1) * 100 pred from sh_{name} join b0 using (board) join b1 using (board), tot)"""


_ALLY = {"retention": 1996, "admit": 1996, "yield": 1997}
_ALLW = {"retention": 0.4, "admit": 0.3, "yield": 0.1}


@query("b07_variants", _WIN + _FUNDS + "," + ",".join([
    _variant_sql("base", "sum(num) / sum(den)", _ALLY, _ALLW), _variant_sql("early", "sum(num) / sum(den)", {k: v - 1 for k, v in _ALLY.items()}, _ALLW),
    _variant_sql("mean", "avg(num / den)", _ALLY, _ALLW),
    _variant_sql("neutral", "sum(num) / sum(den)", {"retention": 1996, "yield": 1997}, {"retention": 0.4, "yield": 0.1})]) + """
    select 'base' variant, round(corr(act, pred), 6) correlation, round(sqrt(avg(pow(pred - act, 2))), 6) rmse from rec_base
    union all select 'one year earlier', round(corr(act, pred), 6), round(sqrt(avg(pow(pred - act, 2))), 6) from rec_early
    union all select 'mean of rates', round(corr(act, pred), 6), round(sqrt(avg(pow(pred - act, 2))), 6) from rec_mean
    union all select 'admit neutral', round(corr(act, pred), 6), round(sqrt(avg(pow(pred - act, 2))), 6) from rec_neutral""", V)
def _(t: Tables):
    cases = {"base": {}, "one year earlier": {"shift": -1}, "mean of rates": {"how": "mean"}, "admit neutral": {"neutral": ("admit",)}}
    return rounded(fu.variants(panel(t), t.once("board_year"), T, W, METRICS, cases, WINDOWS), ["correlation", "rmse"])


@query("b08_marginal_value", _WIN + """
    , b as (select metric, board, avg(v + case when pos = 4 then 0.01 else 0 end) / avg(v) filter (pos <= 3) d1, sum(v) filter (pos = 4) rate from ser where metric = 'retention' group by 1, 2),
    c as (select board, sum(den) cohort from pw semi join keep using (metric, unitid) where metric = 'retention' and pos = 4 group by 1),
    x as (select board, rate, cohort, 0.4::double * (a * d1 / (s - a * d + a * d1) - al) * 1e6 pp from alloc join b using (metric, board) join c using (board))
    select board, round(rate, 6) rate, cast(cohort as bigint) cohort, round(pp, 4) per_point, round(pp / (cohort * 0.01), 4) per_student from x""", V)
def _(t: Tables):
    w = _windowed(t)
    keep = fu.consistent_reporters(w)
    cohort = (w.join(keep, ["metric", "unitid"], "left_semi").filter("metric = 'retention' and position = 4").groupBy("board").agg(F.sum("den").alias("cohort")))
    m = fu.marginal_value(fu.board_series(w, keep), _prior(t), cohort, 1e6, "retention", 0.4)
    return rounded(rounded(m, ["rate"]), ["per_point", "per_student"], 4)


@query("b09_reward_path", """
    , s as (select board, 0.01 + abs(max(completers) filter (year = 1997) / max(completers) filter (year = 1996) - 1) step from board_year group by 1),
    w as (select board, step, unnest(generate_series(1, 6)) "window" from s),
    l as (select board, "window", case when "window" - 1 >= 3 then 1 + step else 1 end a, case when "window" >= 3 then 1 + step else 1 end b,
      case when "window" + 1 >= 3 then 1 + step else 1 end c, case when "window" + 2 >= 3 then 1 + step else 1 end e from w)
    select board, "window"::int "window", round(((a + b + c + e) / 4) / ((a + b + c) / 3) - 1, 6) gain from l""", "board_year")
def _(t: Tables):
    def at(y):
        return F.max(F.when(F.col("year") == y, F.col("completers")))
    s = t.once("board_year").groupBy("board").agg((F.abs(nulls.ratio(at(1997), at(1996)) - 1) + 0.01).alias("step"))
    return rounded(fu.reward_path(s, "board", "step"), ["gain"])


_SENS = _WIN + """
    , allp as (select board, pos, sum(num) / sum(den) v from pw where metric = 'retention' group by 1, 2),
    hid as (select h.*, f.den first_den from metric_panel h join (select unitid, sum(den) den from metric_panel where metric = 'retention' and year = 1995 group by 1) f using (unitid)
      where metric = 'retention' and year <= 1999 and unitid not in (select unitid from keep where metric = 'retention') and h.den >= 0.25 * f.den and f.den > 0),
    lst as (select unitid, board, arg_max(num, year) num, arg_max(den, year) den from hid group by 1, 2),
    flt as (select board, pos, num, den from pw semi join keep using (metric, unitid) where metric = 'retention'
      union all select board, pos, num, den from lst, (select pos from win where metric = 'retention')),
    flv as (select board, pos, sum(num) / sum(den) v from flt group by 1, 2)"""


@query("b10_composition_variants", _SENS + """
    select 'consistent reporters' variant, board, round(d, 6) d from d where metric = 'retention'
    union all select 'all as reported', board, round(avg(v) / avg(v) filter (pos <= 3), 6) from allp group by 2
    union all select 'hidden units held flat', board, round(avg(v) / avg(v) filter (pos <= 3), 6) from flv group by 2""", V)
def _(t: Tables):
    w = _windowed(t).filter("metric = 'retention'")
    keep = fu.consistent_reporters(w)
    base = fu.pooled_d(w.join(keep, ["metric", "unitid"], "left_semi"), ["board"]).withColumn("variant", F.lit("consistent reporters"))
    every = fu.pooled_d(w, ["board"]).withColumn("variant", F.lit("all as reported"))
    flat = fu.held_flat(w, panel(t).filter("metric = 'retention'"), keep, 1995, 1999)
    return rounded(base.unionByName(every).unionByName(fu.pooled_d(flat, ["board"]).withColumn("variant", F.lit("hidden units held flat"))), ["d"])


@query("b10_leave_one_out", _WIN + """
    , v as (select * from pw semi join keep using (metric, unitid) where metric = 'retention'), t as (select board, pos, sum(num) n, sum(den) dd from v group by 1, 2),
    l as (select v.board, v.unitid, v.pos, (t.n - v.num) / nullif(t.dd - v.den, 0) x from v join t on v.board = t.board and v.pos = t.pos)
    select board, unitid, round(case when count(x) = 4 then avg(x) / avg(x) filter (pos <= 3) end, 6) d from l group by 1, 2""", V)
def _(t: Tables):
    w = _windowed(t).filter("metric = 'retention'")
    v = w.join(fu.consistent_reporters(w), ["metric", "unitid"], "left_semi")
    return rounded(fu.leave_one_out_d(v, ["board"]), ["d"])


@query("b10_required_d", _WIN + """
    , x as (select metric, board, a, d, s, al + 0.0005 / 0.4 a1 from alloc where metric = 'retention')
    select metric, board, round(d, 6) d, round((s - a * d) * a1 / (a * (1 - a1)), 6) required_d from x""", V)
def _(t: Tables):
    alloc = fu.metric_allocation(_prior(t), _d(t)).filter("metric = 'retention'")
    return rounded(fu.required_d(alloc, F.lit(0.0005), 0.4), ["d", "required_d"])


_SPLICE = _WIN + """
    , incl as (select 'retention' metric, board, pos, sum(p.num + q.num) / sum(p.den + q.den) v from pw p join (select unitid, year, num, den from metric_panel where metric = 'yield') q using (unitid, year)
      where p.metric = 'retention' group by 2, 3),
    full_ as (select board, pos, sum(num) / sum(den) v from pw where metric = 'retention' group by 1, 2),
    spl as (select board, pos, v from full_ where pos < 4 union all select board, pos, v from incl where pos = 4),
    dd as (select board, d0, d1, d2 from (select board, avg(v) / avg(v) filter (pos <= 3) d0 from full_ group by 1) join (select board, avg(v) / avg(v) filter (pos <= 3) d1 from incl group by 1) using (board)
      join (select board, avg(v) / avg(v) filter (pos <= 3) d2 from spl group by 1) using (board)),
    mv as (select board, d1, d2, 1e6 * (a * d1 / sum(a * d1) over () - a * d0 / sum(a * d0) over ()) m1, 1e6 * (a * d2 / sum(a * d2) over () - a * d0 / sum(a * d0) over ()) m2 from dd join prior using (board))"""


def _definitions(t: Tables):
    w = _windowed(t).filter("metric = 'retention'")
    extra = panel(t).filter("metric = 'yield'").select("unitid", "year", F.col("num").alias("_n"), F.col("den").alias("_d"))
    incl = w.join(extra, ["unitid", "year"]).withColumns({"num": F.col("num") + F.col("_n"), "den": F.col("den") + F.col("_d")})

    def series(x):
        return x.groupBy("metric", "board", "position").agg(nulls.ratio(F.sum("num"), F.sum("den")).alias("value"))
    old, new = series(w), series(incl)
    k = ["metric", "board"]
    d0, d1, d2 = fu.d_ratio(old, k), fu.d_ratio(new, k), fu.d_ratio(fu.spliced(old, new), k)
    m1 = fu.compare_definitions(_prior(t), d0, d1, {"retention": 1.0}, 1e6).withColumnRenamed("moved", "recomputed")
    m2 = fu.compare_definitions(_prior(t), d0, d2, {"retention": 1.0}, 1e6).withColumnRenamed("moved", "spliced")
    return d1.select("board", F.col("d").alias("d_recomputed")).join(d2.select("board", F.col("d").alias("d_spliced")), "board").join(m1, "board").join(m2, "board")


@query("b11_splice_vs_recompute", _SPLICE + """
    select board, round(d1, 6) d_recomputed, round(d2, 6) d_spliced, round(m1, 3) recomputed, round(m2, 3) spliced from mv""", V)
def _(t: Tables):
    return rounded(rounded(_definitions(t), ["d_recomputed", "d_spliced"]), ["recomputed", "spliced"], 3)


@query("b13_estimate_vs_published", _SPLICE + """
    select round(corr(m1, m2), 6) correlation, count_if(sign(m1) = sign(m2)) signs_agree, count(*) n, round(sum(greatest(m1, 0)), 3) moved_estimate,
      round(sum(greatest(m2, 0)), 3) moved_published from mv""", V)
def _(t: Tables):
    return rounded(rounded(fu.agreement(_definitions(t), "recomputed", "spliced"), ["correlation"]), ["moved_estimate", "moved_published"], 3)


@query("b11_definition_vs_performance", _SPLICE + _REDIS.replace(" f as", " ff as").replace("from f)", "from ff)") + """
    select board, round(n - u, 0) performance, round(m1, 3) definition from r join mv using (board)""", V)
def _(t: Tables):
    p = _redistribution(t).select("board", R("moved", 0).alias("performance"))
    return p.join(_definitions(t).select("board", R("recomputed", 3).alias("definition")), "board")
