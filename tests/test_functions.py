from pyspark.sql import functions as F

from cohortlens.functions import labels, nulls, specfun, text


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_ratios_never_infinite(frame):
    d = frame("n double, d double", [(1.0, 2.0), (1.0, 0.0), (0.0, 0.0), (3.0, -2.0), (0.0, 4.0), (None, 1.0)])
    assert column(d, nulls.ratio("n", "d")) == [0.5, None, None, -1.5, 0.0, None]
    assert column(d, nulls.ratio_pos("n", "d")) == [0.5, None, None, None, 0.0, None]
    assert column(d, nulls.ratio_nz("n", "d")) == [0.5, None, None, None, None, None]


def test_half_up_rounding_pairs(frame):
    d = frame("n int, d int", [(205, 328), (1, 8), (5, 8), (1, 0), (0, 7)])
    assert column(d, nulls.round_half_up("n", "d")) == [0.63, 0.13, 0.63, None, 0.0]


def test_sentinels(frame):
    d = frame("x string", [("-2",), ("0",), ("5",), ("abc",), (None,)])
    assert column(d, nulls.mask_negative("x")) == [None, 0.0, 5.0, None, None]
    assert column(d, nulls.signed("x")) == [-2.0, None, 5.0, None, None]
    n = frame("x int", [(-9,), (-4,), (3,)])
    assert column(n, nulls.mask_codes("x")) == [None, -4, 3]


def test_nan_is_missing(frame):
    d = frame("x double", [(float("nan"),), (1.0,)])
    assert [r[0] for r in nulls.no_nan(d).collect()] == [None, 1.0]
    assert column(d, nulls.number("x")) == [None, 1.0]


def test_code_key(frame):
    d = frame("c string", [("01.0000",), ("10.0000",), ("13.0100",), ("3.0",), ("99",), ("-2.0",), ("0.0",), ("-0",), (" 7 ",)])
    assert column(d, text.code_key("c")) == ["01.0000", "10.0000", "13.0100", "3", "99", "-2", "0", "0", "7"]


def test_amounts(frame):
    d = frame("c string", [("$1,234",), ("(1,234.50)",), ("-7",), ("-",), ("",), ("12",)])
    assert column(d, text.amount("c")) == [1234.0, -1234.5, -7.0, 0.0, 0.0, 12.0]


def test_fiscal_labels_and_stems(frame):
    d = frame("y int", [(1999,), (2014,), (2025,)])
    assert column(d, text.fiscal_label("y")) == ["FY 1999-00", "FY 2014-15", "FY 2025-26"]
    assert column(d, text.finance_stem("y")) == ["F9900_F1A", "F1415_F1A", "F2526_F1A"]
    assert column(d, text.price_stem("y")) == ["IC1999_AY", "IC2014_AY", "COST1_2025"]


def test_provisional(frame):
    d = frame("s string, f string", [("ADM2023", "adm2023.csv"), ("ADM2023", "adm2023_RV.csv"), ("EF2023D", "ef2023d.csv"), ("EF2023A", "ef2023a.csv"), ("HD2023", "hd2023.csv")])
    assert column(d, text.is_provisional("s", "f")) == [True, False, True, False, False]


def test_carnegie_families(frame):
    d = labels.carnegie(frame("c double", [(15.0,), (31.0,), (33.0,), (None,)]), "c")
    got = {r["c"]: (r["carnegie_family"], r["carnegie_label"]) for r in d.collect()}
    assert got[15.0][0] == "Doctoral" and got[31.0] == ("Special Focus", "Special Focus Four-Year: Law Schools")
    assert got[33.0][0] == "Tribal" and got[None] == (None, None)
    assert [c for c, *_ in labels.CARNEGIE] == list(range(1, 34))


def test_decode_unmatched(frame):
    sets = frame("varname string, codevalue string, valuelabel string", [("SECTOR", "1", "Public"), ("sector ", "2.0", "Private")])
    d = labels.decode(frame("sector double", [(1.0,), (2.0,), (5.0,)]), sets, "sector")
    assert {r["sector"]: r["sector_LABEL"] for r in d.collect()} == {1.0: "Public", 2.0: "Private", 5.0: None}
    assert [r["code"] for r in labels.undecoded(d, "sector").collect()] == ["5"]


def test_band_is_half_open(frame):
    d = frame("x double", [(0.0,), (9.99,), (10.0,), (20.0,), (-1.0,)])
    assert column(d, labels.band(F.col("x"), [0, 10, 20], ["a", "b"])) == ["a", "a", "b", None, None]


def test_special_functions_known_values():
    assert abs(float(specfun.betainc(2, 3, 0.4)) - 0.5248) < 1e-12
    assert abs(float(specfun.beta_ppf(0.05, 2, 3)) - 0.09761146) < 1e-7
    assert abs(float(specfun.norm_two_sided(1.959963984540054)) - 0.05) < 1e-12
    assert abs(float(specfun.chi2_sf(3.841458820694124, 1)[0]) - 0.05) < 1e-12
    assert abs(float(specfun.chi2_sf(18.307038053275146, 10)[0]) - 0.05) < 1e-12
    assert abs(float(specfun.f_sf(4.102821, 2, 10)) - 0.05) < 1e-6
    assert abs(float(specfun.lgamma(0.5)) - 0.5723649429247001) < 1e-10
    assert abs(float(specfun.digamma(1.0)) + 0.5772156649015329) < 1e-10
    assert abs(float(specfun.trigamma(1.0)) - 1.6449340668482264) < 1e-8
