"""Queries over readers, parsers and file sinks (S and K families).

The tables are first written as the landed files a reader expects (CSV, JSON, archives, report
lines), over all their rows, and then read back through the operator under test.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import reduce

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text
from ..operators import panel as pn
from ..operators.lineage import cut, run_dir
from ..sources import parsers, readers, records, sinks
from .registry import query
from .served import landed
from .tables import Tables, years_of

R = F.round


@query("s01_component_reader", """
    select unitid, survey_year, applicants, admits, enrolled from (select unitid, survey_year, applicants::double applicants, admits::double admits, enrolled::double enrolled from sup_panel)""", "sup_panel")
def _(t: Tables):
    parts = []
    for year in years_of(t.sup_panel):
        raw = t.sup_panel.filter(F.col("survey_year") == year).select(
            F.col("unitid").alias("UNITID "), F.col("applicants").alias(" APPLCN"), F.col("admits").alias("Admssn"), F.col("enrolled").alias("ENRLT"),
            F.lit("dropped").alias("OTHER"))
        parts.append(readers.read_component(t.spark, "admissions", year, landed(t, raw, "csv", header=True, encoding="ISO-8859-1")))
    return readers.stack_files(parts).select("unitid", "survey_year", "applicants", "admits", "enrolled")


@query("s02_survey_reader", """
    select c_custkey "UNITID", lpad(c_nationkey::varchar, 5, '0') "CIPCODE", case when c_acctbal >= 0 then c_acctbal end "BALANCE" from customer""")
def _(t: Tables):
    raw = t.customer.select(F.col("c_custkey").alias("unitid"), F.concat(F.lit(" "), F.lpad(F.col("c_nationkey").cast("string"), 5, "0")).alias("CipCode "),
                            F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string")).otherwise(".").alias("Balance"), F.col("c_name").alias("OTHER"))
    path = landed(t, raw, "csv", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_survey(t.spark, path, ["UNITID", "CIPCODE", "BALANCE"])


@query("s02_quoted_line_breaks", """
    select doc_id, lang, length(coalesce(text, '')) n, md5(coalesce(text, '')) digest from documents""")
def _(t: Tables):
    raw = t.documents.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    d = records.read_csv(t.spark, landed(t, raw, "csv", header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))
    text = F.coalesce("text", F.lit(""))
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.length(text).alias("n"), F.md5(text).alias("digest"))


@query("s03_encoding_detection", r"""
    select doc_id, case when regexp_matches(text, '[^\x{00}-\x{7f}]') and not regexp_matches(text, '[^\x{00}-\x{ff}]') then 'cp1252' else 'utf-8-sig' end encoding from documents""")
def _(t: Tables):
    latin = F.col("text").rlike(r"[^\x00-\x7f]") & ~F.col("text").rlike(r"[^\x00-\xff]")
    files = t.documents.select(F.col("doc_id").cast("string").alias("path"), F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8")).alias("content"))
    return readers.detect_encoding(files).select(F.col("path").cast("long").alias("doc_id"), "encoding")


def zip_bytes(members: list[tuple[str, bytes]]) -> bytes:
    """A zip of stored members. ``zipfile`` takes ten times as long for small ones, which was most of the work of landing archives."""
    parts, central, at = [], [], 0
    for name, body in members:
        label = name.encode("ascii")
        fixed = struct.pack("<5H3I2H", 20, 0, 0, 0, 33, zlib.crc32(body), len(body), len(body), len(label), 0)
        parts += [b"PK\3\4", fixed, label, body]
        central.append(b"PK\1\2\x14\3" + fixed + struct.pack("<3H2I", 0, 0, 0, 0o600 << 16, at) + label)
        at += 30 + len(label) + len(body)
    tail = b"".join(central)
    return b"".join([*parts, tail, struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, len(central), len(central), len(tail), at, 0)])


def _archives(t: Tables):
    """One zip per order with a first release and a revised release of its line list."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.concat_ws(
        ",", "l_linenumber", F.col("l_quantity").cast("int"), "l_partkey"))).alias("rows"))

    def pack(batches):
        for pdf in batches:
            out = []
            for k, rows in zip(pdf["k"], pdf["rows"]):
                body = "n,q,p\n" + "\n".join(rows) + "\n"
                out.append((f"/raw/o{k}.zip", zip_bytes([(f"o{k}.csv", b"n,q,p\nfirst,0,0\n"), (f"o{k}_rv.csv", body.encode()), (f"o{k}_notes.txt", b"notes")])))
            yield pd.DataFrame(out, columns=["path", "content"])
    return lines.mapInPandas(pack, "path string, content binary")


@query("s04_archive_intake", """
    select 'o' || l_orderkey || '_rv.csv' member, count(*) n_lines, sum(l_quantity::int)::bigint quantity from lineitem group by 1""")
def _(t: Tables):
    lines = readers.intake_archives(_archives(t), "shortest").filter("line_no > 0")
    q = F.get(F.split("line", ","), 1).cast("long")
    return lines.groupBy("member").agg(F.count("*").alias("n_lines"), F.sum(q).alias("quantity"))


@query("s04_archive_columns", """
    select l_orderkey "ORDERKEY", count(*) n, sum(l_quantity::int)::bigint quantity, count_if(l_returnflag = 'R') breaks, case when l_orderkey % 3 = 0 then 'cp1252' else 'utf-8-sig' end encoding,
      case when l_orderkey % 3 = 0 then 'François €' else 'François Ł' end "NAME", max(case when l_orderkey % 2 = 0 then l_linenumber end)::bigint line
    from lineitem group by 1""")
def _(t: Tables):
    """Zips of two layouts and two encodings, with line breaks and quotes inside fields."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"), "l_returnflag"))).alias("rows"))

    def pack(batches):
        for pdf in batches:
            out = []
            for k, rows in zip(pdf["k"], pdf["rows"], strict=True):
                encoding, name = ("cp1252", "François €") if k % 3 == 0 else ("utf-8-sig", "François Ł")
                layout = "orderkey,Line ,Q,Note,Name" if k % 2 == 0 else "Q,Note,orderkey,Name"
                body = [layout]
                for r in rows:
                    note = '"said ""yes""\r\n, twice"' if r["l_returnflag"] == "R" else "plain"
                    body.append(f"{k},{r['l_linenumber']},{r['q']},{note},{name}" if k % 2 == 0 else f"{r['q']},{note},{k},{name}")
                out.append((f"/raw/o{k}.zip", zip_bytes([(f"o{k}.csv", b"n,q,p\nfirst,0,0\n"), (f"o{k}_rv.csv", ("\r\n".join(body) + "\r\n").encode(encoding))])))
            yield pd.DataFrame(out, columns=["path", "content"])

    d = readers.read_archives(lines.mapInPandas(pack, "path string, content binary"))
    broken = F.count_if(F.col("NOTE") == 'said "yes"\r\n, twice')
    return d.groupBy(F.col("ORDERKEY").cast("long").alias("ORDERKEY"), "encoding", "NAME").agg(
        F.count("*").alias("n"), F.sum(F.col("Q").cast("long")).alias("quantity"), broken.alias("breaks"), F.max(F.col("LINE").cast("long")).alias("line"))


@query("s05_provisional_flag", """
    select p_partkey, (p_size < 30 or p_size >= 45) and p_partkey > 500 provisional from part""")
def _(t: Tables):
    stem = F.when(F.col("p_size") < 15, "ADM2023").when(F.col("p_size") < 30, "EF2023D").when(F.col("p_size") < 45, "HD2023").otherwise("cost1_2024")
    file = F.concat(F.lower(stem), F.when(F.col("p_partkey") > 500, ".csv").otherwise("_RV.csv"))
    return t.part.select("p_partkey", text.is_provisional(stem, file).alias("provisional"))


def _pages(t: Tables):
    fees = F.struct(F.col("o_totalprice").alias("In"), F.struct(F.col("o_orderstatus").alias("Code")).alias("Kind"))
    rec = F.struct(F.col("o_orderkey").alias("UNITID"), fees.alias("Fee"))
    return t.orders.select(F.array(rec).alias("results"), F.lit(None).cast("string").alias("next"))


@query("s06_api_records", """
    select o_orderkey unitid, round(o_totalprice, 2) fee_in, o_orderstatus "fee.kind.code", 2023 survey_year from orders""")
def _(t: Tables):
    d = readers.read_api_records(t.spark, landed(t, _pages(t), "json"), 2023, {"fee.in": "fee_in"}, multi_line=False)
    return d.select("unitid", R("fee_in", 2).alias("fee_in"), "`fee.kind.code`", "survey_year")


@query("s07_union_pages", "select count(*) n, sum(o_orderkey)::bigint key_sum from orders")
def _(t: Tables):
    return readers.union_pages(_pages(t)).agg(F.count("*").alias("n"), F.sum("UNITID").alias("key_sum"))


@query("s08_outcome_reader", """
    select c_custkey unitid, lpad(c_nationkey::varchar, 6, '0') family, c_mktsegment = 'BUILDING' main, case when c_nationkey >= 5 and c_acctbal > 0 then c_acctbal end earnings from customer""")
def _(t: Tables):
    raw = t.customer.select(F.col("c_custkey").cast("string").alias("UNITID"), F.concat(F.lit(" "), F.col("c_nationkey").cast("string")).alias("OPEID6"),
                            F.when(F.col("c_mktsegment") == "BUILDING", "1").otherwise("0").alias("MAIN"),
                            F.when(F.col("c_nationkey") < 3, "PrivacySuppressed").when(F.col("c_nationkey") < 5, "NULL").otherwise(F.col("c_acctbal").cast("string")).alias("MD"))
    return readers.read_outcomes(raw, {"earnings": "MD"})


@query("s09_companion_load", "select c_custkey \"UNITID\", c_acctbal, c_nationkey from customer")
def _(t: Tables):
    return readers.load_companion(t.customer.withColumnRenamed("c_custkey", "UNITID"), ["c_acctbal", "c_nationkey"])


@query("s10_vintage_stack", "select unitid, survey_year as year, n from cust_panel", "cust_panel")
def _(t: Tables):
    return pn.stack_vintages({y: t.cust_panel.filter(F.col("survey_year") == y) for y in years_of(t.cust_panel)}, ["n"])


@query("s11_period_check", """
    select n_name as "table", 'fall 199[5-9]-' expected, n_regionkey < 3 ok from nation""")
def _(t: Tables):
    intro = t.nation.select(F.col("n_name").alias("table"), F.when(F.col("n_regionkey") < 3, F.concat(F.lit("Survey of Fall 199"), F.col("n_regionkey") + 5, F.lit("–2000")))
                            .when(F.col("n_regionkey") == 3, "").otherwise("Fall 2005").alias("text"))
    expected = t.nation.select(F.col("n_name").alias("table"), F.lit("fall 199[5-9]-").alias("expected"))
    return readers.check_periods(intro, expected)


@query("s12_provenance", """
    select doc_id, octet_length(encode(text))::bigint bytes, sha256(text) sha256 from documents""")
def _(t: Tables):
    files = t.documents.select(F.concat(F.lit("/raw/"), F.col("doc_id")).alias("path"), F.encode("text", "UTF-8").alias("content"), F.current_timestamp().alias("modificationTime"))
    return readers.provenance(files).select(F.substring("path", 6, 20).cast("long").alias("doc_id"), "bytes", "sha256")


@query("s12_provenance_of_files")
def _(t: Tables):
    path = landed(t, t.orders.select("o_orderkey", "o_totalprice"), "csv", header=True)
    return readers.provenance(readers.binary_files(t.spark, f"{path}/*.csv")).select("bytes", "sha256")


_IDX = """
    , m as (select year(o_orderdate) y, month(o_orderdate) mo, round(avg(o_totalprice), 3) v from orders group by 1, 2)"""


def _index_lines(t: Tables):
    m = t.orders.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("mo")).agg(R(F.avg("o_totalprice"), 3).alias("v"))
    m = cut(m)
    monthly = m.select(F.format_string("CUURX   %d   M%02d      %s", "y", "mo", F.col("v").cast("decimal(18,3)").cast("string")).alias("text"))
    annual = m.groupBy("y").agg(F.avg("v").alias("v")).select(F.format_string("CUURX   %d   M13   %s", "y", F.col("v").cast("decimal(18,3)").cast("string")).alias("text"))
    return monthly.unionByName(annual).unionByName(monthly.select(F.regexp_replace("text", "CUURX", "OTHER").alias("text")))


@query("s13_fiscal_index", _IDX.replace(", m as", "with m as", 1) + """
    , f as (select case when mo >= 7 then y else y - 1 end fy, v from m)
    select fy::int fy, round_even(avg(v), 3) cpi from f group by 1 having count(*) in (6, 12)""")
def _(t: Tables):
    return parsers.fiscal_cpi(_index_lines(t), "CUURX")


@query("s14_semiannual_index", """
    with h as (select year(o_orderdate) y, case when month(o_orderdate) <= 6 then 'S01' else 'S02' end p, round(avg(o_totalprice), 2) v from orders group by 1, 2)
    select a.y::int fy, round_even((a.v + b.v) / 2, 3) cpi from h a join h b on a.p = 'S02' and b.p = 'S01' and b.y = a.y + 1""")
def _(t: Tables):
    half = F.when(F.month("o_orderdate") <= 6, "S01").otherwise("S02")
    h = t.orders.groupBy(F.year("o_orderdate").alias("y"), half.alias("p")).agg(R(F.avg("o_totalprice"), 2).alias("v"))
    return parsers.semiannual_cpi(h.select(F.format_string("CUUSX %d %s %s", "y", "p", F.col("v").cast("decimal(18,3)").cast("string")).alias("text")), "CUUSX")


@query("s15_report_rows", """
    , w as (select control doc, (sum(completers) filter (survey_year = 1999) + 10000)::bigint a, (sum(cohort_size) filter (survey_year = 2000))::bigint b from sup_panel group by 1)
    select doc, label, is_total, fy::int fy, v as value from w, lateral (values ('Plain College', false, 1999, a), ('Plain College', false, 2000, -b), ('Split College', false, 1999, a), ('Split College', false, 2000, b),
      ('Public Summary', true, 1999, a + b), ('Public Summary', true, 2000, b), ('All', true, 1999, b), ('All', true, 2000, b)) x(label, is_total, fy, v)""", "sup_panel")
def _(t: Tables):
    w = t.sup_panel.groupBy(F.col("control").alias("doc")).agg((F.sum(F.when(F.col("survey_year") == 1999, F.col("completers"))) + 10000).alias("a"),
                                                              F.sum(F.when(F.col("survey_year") == 2000, F.col("cohort_size"))).alias("b"))

    def num(c):
        return F.format_number(c, 0)
    a, b = F.col("a"), F.col("b")
    split = F.concat(F.substring(num(a), 1, 1), F.lit(" "), F.substring(num(a), 2, 20))
    rows = [F.lit("FY 1999-00  FY 2000-01   Total FTE by FY 1999-00"), F.concat(F.lit("Plain College  "), num(a), F.lit("  ("), num(b), F.lit(")")),
            F.concat(F.lit("Split College "), split, F.lit(" "), num(b)), F.concat(F.lit("Public Summary  "), num(a + b), F.lit(" "), num(b)),
            F.concat(F.lit("All: $"), num(b), F.lit(" "), num(b)), F.concat(F.lit("Too many "), num(b), F.lit(" 11 12 13")), F.lit("A heading without numbers")]
    return parsers.parse_fte_lines(cut(w.select("doc", F.posexplode(F.array(*rows)).alias("line_no", "text"))))


@query("s16_board_rows", """
    , w as (select year doc, sum(completers)::bigint + 100000 a, sum(cohort_size)::bigint + 200000 b from board_year group by 1)
    select doc, 'NMU' board, a num1, b num2 from w union all select doc, 'LC', -b, a from w""", "board_year")
def _(t: Tables):
    w = t.board_year.groupBy(F.col("year").alias("doc")).agg((F.sum("completers") + 100000).alias("a"), (F.sum("cohort_size") + 200000).alias("b"))

    def num(c):
        return F.format_number(c, 0)
    a, b = F.col("a"), F.col("b")
    rows = [F.concat(F.lit("North Mesa University "), num(a * 9), F.lit(" "), num(b)), F.lit("Table of appropriations"), F.lit("North Mesa"),
            F.concat(F.lit("University $"), num(a), F.lit(" $"), num(b)), F.concat(F.lit("Lake College ("), num(b), F.lit(") "), num(a)),
            F.concat(F.lit("Lake College "), num(b * 3), F.lit(" "), num(a)), F.concat(F.lit("Somewhere else "), num(b), F.lit(" "), num(a))]
    lines = cut(w.select("doc", F.posexplode(F.array(*rows)).alias("line_no", "text")))
    out = parsers.parse_board_lines(lines, "Table of appropriations", [("NMU", "^North Mesa University"), ("LC", "^Lake")])
    return out.select("doc", "board", F.get("numbers", 0).alias("num1"), F.get("numbers", 1).alias("num2"))


def _words(t: Tables):
    """Positioned words of one statement page per supplier: three lines of label and value."""
    w = t.sup_panel.groupBy(F.col("unitid").alias("doc")).agg(F.sum("completers").alias("a"), F.sum("enrolled").alias("b"), F.sum("admits").alias("c"))

    def word(txt, x0, x1, top):
        return F.struct((txt if not isinstance(txt, str) else F.lit(txt)).alias("text"), F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"), F.lit(float(top)).alias("top"))

    def num(c):
        return F.format_number(c, 0)
    words = F.array(word("FY", 300, 310, 50), word("FY", 500, 510, 50), word("2024", 512, 530, 50), word("Operating", 60, 95, 80), word("Tuition", 120, 150, 80.5), word("fees", 152, 170, 80.5),
                    word(num(F.col("a")), 500, 540, 82), word("TOTAL", 60, 90, 100), word("REVENUE", 92, 130, 100), word(F.concat(F.lit("("), num(F.col("b")), F.lit(")")), 502, 540, 103),
                    word("Grants", 120, 150, 140), word("9,999", 300, 330, 140), word(num(F.col("c")), 500, 520, 141), word("orphan", 120, 150, 300))
    return w.select("doc", F.lit(1).alias("page"), F.inline(words))


@query("s17_statement_pairs", """
    , w as (select unitid doc, sum(completers) a, sum(enrolled) b, sum(admits) c from sup_panel group by 1)
    select doc, 1 page, label, v::double as value from w, lateral (values ('Tuition fees', a), ('TOTAL REVENUE', -b), ('Grants', c)) x(label, v)""", "sup_panel")
def _(t: Tables):
    return parsers.statement_pairs(_words(t)).select("doc", "page", "label", "value")


@query("s17_statement_pick", """
    select unitid doc, sum(completers)::double tuition, -sum(enrolled)::double revenue, null::double absent from sup_panel group by 1""", "sup_panel")
def _(t: Tables):
    return parsers.pick_statement(parsers.statement_pairs(_words(t)), [("tuition", "fees", "first"), ("revenue", "TOTAL REVENUE", "last"), ("absent", "No such row", "first")])


@query("s18_statement_lines", """
    , w as (select unitid doc, sum(completers) a, sum(enrolled) b from sup_panel group by 1)
    select doc, k as key, c::double * 1000 as current, p::double * 1000 prior from w, lateral (values ('tuition', a, b), ('loss', -b, 0)) x(k, c, p)""", "sup_panel")
def _(t: Tables):
    w = t.sup_panel.groupBy(F.col("unitid").alias("doc")).agg(F.sum("completers").alias("a"), F.sum("enrolled").alias("b"))

    def num(c):
        return F.format_number(c, 0)
    a, b = num("a"), num("b")
    rows = [F.lit("Tuition caption, (including 5 7 9"), F.concat(F.lit("Tuition and fees (Notes 3, 13) $ "), a, F.lit("  -  $ "), b, F.lit(" 77")),
            F.concat(F.lit("Operating loss ("), b, F.lit(") 12 - 44")), F.concat(F.lit("Tuition and fees "), b, F.lit(" 1 2 3")), F.lit("Unrelated 1 2 3")]
    lines = cut(w.select("doc", F.posexplode(F.array(*rows)).alias("line_no", "text")))
    return parsers.statement_lines(lines, [("tuition", "Tuition and fees"), ("loss", "Operating loss")])


@query("s19_k02_curated_roundtrip", """
    select survey_year, count(*) n, (select count(*) from sup_panel) meta_rows, 'unitid,survey_year' grain from sup_panel group by 1""", "sup_panel")
def _(t: Tables):
    root = f"{run_dir(t.spark)}/{uuid.uuid4().hex}"
    p = t.sup_panel.select("unitid", "survey_year", "admits")
    sinks.write_curated(p, root, "panel", period="1995-2001", grain=["unitid", "survey_year"], notes="derived")
    df, meta = readers.read_curated(t.spark, root, "panel")
    return df.groupBy("survey_year").agg(F.count("*").alias("n")).withColumns({"meta_rows": F.lit(meta["rows"]), "grain": F.lit(",".join(meta["grain"]))})


@query("k01_panel_partitions", "select survey_year, count(*) n from cust_panel group by 1", "cust_panel")
def _(t: Tables):
    path = f"{run_dir(t.spark)}/{uuid.uuid4().hex}"
    sinks.save_panel(t.cust_panel.select("unitid", "survey_year", "n"), path)
    return t.spark.read.parquet(path).groupBy("survey_year").agg(F.count("*").alias("n"))


@query("k03_schema_lock", """
    with n as (select count(*) n_rows from customer), c as (select count(*) n_columns from (describe customer))
    select 1 step, 'created' status, '' added, '' removed, n_columns, n_rows from n, c
    union all select 2, 'changed', 'c_new', 'c_name', n_columns, n_rows from n, c union all select 3, 'unchanged', '', '', n_columns, n_rows from n, c""")
def _(t: Tables):
    """The table is curated three times under one lock; the written rows and columns are read back each time."""
    path = f"{run_dir(t.spark)}/{uuid.uuid4().hex}"
    out = []
    for step, df in enumerate([t.customer, t.customer.drop("c_name").withColumn("c_new", F.lit(1)), t.customer], 1):
        lock = sinks.lock_schema(df, path)
        df.write.parquet(f"{path}-{step}")
        back = t.spark.read.parquet(f"{path}-{step}")
        named = lock.select(F.lit(step).alias("step"), "status", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"),
                            F.lit(len(back.columns)).cast("long").alias("n_columns"))
        out.append(named.withColumn("n_rows", back.agg(F.count("*")).scalar()))
    return reduce(lambda a, b: a.unionByName(b), out)
