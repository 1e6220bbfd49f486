"""Readers for landed survey files. Every column is read as text first, then cast by declaration."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.nulls import number
from ..functions.text import plain_text
from ..operators.guards import assert_unique
from ..operators.lineage import cut
from . import records

# File prefix of each component.
COMPONENT_PREFIX = {
    "institutional_characteristics": "IC", "fall_enrollment": "EF", "human_resources": "HR", "finance": "F",
    "student_financial_aid": "SFA", "completions": "C", "graduation_rates": "GR", "outcome_measures": "OM", "admissions": "ADM",
}
# Known source columns of each component and their names in the panel.
COMPONENT_COLUMNS = {
    "institutional_characteristics": {"unitid": "unitid", "instnm": "institution_name", "control": "control", "iclevel": "level",
                                      "sector": "sector", "stabbr": "state"},
    "fall_enrollment": {"unitid": "unitid", "eftotlt": "total_enrollment", "eftotlm": "total_enrollment_men",
                        "eftotlw": "total_enrollment_women", "ft_students": "ft_students", "pt_students": "pt_students"},
    "human_resources": {"unitid": "unitid", "hrtotlt": "total_staff", "fte_instructional_faculty": "fte_instructional_faculty"},
    "finance": {"unitid": "unitid", "f1b01": "total_revenue", "f1b02": "tuition_revenue", "f1b03": "govt_appropriations",
                "f1b04": "total_expenses"},
    "student_financial_aid": {"unitid": "unitid", "scfa2": "total_undergrad", "pgrnt_n": "pell_recipients",
                              "fgrnt_n": "federal_grant_recipients", "total_grant_aid": "total_grant_aid", "aid_recipients": "aid_recipients"},
    "completions": {"unitid": "unitid", "cipcode": "cip_code", "ctotalt": "credentials_awarded", "awlevel": "credential_level"},
    "graduation_rates": {"unitid": "unitid", "grtotlt": "cohort_size", "grtotlm": "completers_150pct"},
    "outcome_measures": {"unitid": "unitid", "omenrap": "pell_completers_share", "omenrup": "non_pell_completers_share"},
    "admissions": {"unitid": "unitid", "applcn": "applicants", "admssn": "admits", "enrlt": "enrolled"},
}
# Panel columns that stay text.
TEXT_COLUMNS = {"institution_name", "state", "cip_code"}
# Survey columns that are identifiers or codes and keep their leading zeros.
CODE_COLUMNS = {"CIPCODE", "OPEID", "ZIP", "EIN", "UEIS", "F1SYSCOD"}


def component_file(component: str, year: int) -> str:
    return f"{COMPONENT_PREFIX[component].lower()}_{year}.csv"


def read_component(spark: SparkSession, component: str, year: int, path) -> DataFrame:
    """One component file: trimmed lower-case headers, known columns renamed, year stamped."""
    if component not in COMPONENT_COLUMNS:
        raise KeyError(component)
    known = COMPONENT_COLUMNS[component]
    raw = records.read_csv(spark, path, "ISO-8859-1")
    present = {c.strip().lower(): c for c in raw.columns}
    out = []
    for source, name in known.items():
        if source in present:
            c = F.col(f"`{present[source]}`")
            typed = c.try_cast("int") if name == "unitid" else F.trim(c) if name in TEXT_COLUMNS else number(c)
            out.append(typed.alias(name))
    return raw.select(*out, F.lit(year).alias("survey_year"))


def tidy_header(name: str) -> str:
    """Header without byte-order mark or other invisible characters, upper case."""
    return "".join(ch for ch in name.replace("ï»¿", "") if ch.isprintable() and ch not in "﻿​").strip().upper()


def read_survey(spark: SparkSession, path, usecols: list[str] | None = None, *, text: set[str] = CODE_COLUMNS, encoding: str = "UTF-8") -> DataFrame:
    """One survey file: upper-case names, codes kept as trimmed text, "." missing, numbers cast.

    An absent requested column raises KeyError naming it. Unrequested columns are never parsed.
    """
    raw = records.read_csv(spark, path, encoding)
    present = {tidy_header(c): c for c in raw.columns}
    wanted = [c.upper() for c in usecols] if usecols else list(present)
    absent = [c for c in wanted if c not in present]
    if absent:
        raise KeyError(f"columns absent from file: {absent}")
    out = []
    for c in wanted:
        v = F.nullif(F.trim(F.col(f"`{present[c]}`")), F.lit("."))
        out.append((v if c in text else v.try_cast("double").cast("long") if c == "UNITID" else number(v)).alias(c))
    return raw.select(*out)


def binary_files(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").load(glob)


def detect_encoding(files: DataFrame) -> DataFrame:
    """(path, encoding): utf-8-sig when the whole file is valid UTF-8, else cp1252."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return files.select("path", F.when(valid, "utf-8-sig").otherwise("cp1252").alias("encoding"))


def read_detected(spark: SparkSession, glob: str, usecols: list[str] | None = None) -> DataFrame:
    """Survey files of one layout, each read in the encoding that all its lines show: one scan per encoding."""
    found = records.detect_encodings(spark, glob).groupBy("encoding").agg(F.collect_list("path").alias("paths")).collect()  # paths, not contents
    return stack_files([read_survey(spark, r["paths"], usecols, encoding="cp1252" if r["encoding"] == "cp1252" else "UTF-8") for r in found])


def read_archives(files: DataFrame, rule: str = "shortest", encoding: str | None = None) -> DataFrame:
    """Zips (path, content) to text columns: the chosen member's records in the member's own encoding, parsed by its header."""
    return records.archive_columns(cut(records.archive_records(files, lambda names: pick_member(names, rule), encoding)))


def pick_member(names: list[str], rule: str) -> str | None:
    """The CSV member of an archive, the revised one preferred.

    Rule "shortest" takes the shortest name; rule "first" the first listed, and accepts only a
    final "_rv.csv" as revised.
    """
    csv = [n for n in names if n.lower().endswith(".csv") and not n.startswith("__MACOSX")]
    if rule == "first":
        return next((n for n in csv if n.lower().endswith("_rv.csv")), csv[0] if csv else None)
    revised = [n for n in csv if "_rv" in n.lower()]
    return min(revised or csv, key=len, default=None)


def intake_archives(files: DataFrame, rule: str = "shortest", encoding: str = "cp1252", chunk: int = 50_000) -> DataFrame:
    """Lines of the chosen CSV member of every zip: (path, member, line_no, line).

    Lines are yielded in chunks, so an archive is never expanded whole in Python memory. An archive
    without a CSV member fails the job. Land the result once as a table.
    """
    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    member = pick_member(z.namelist(), rule)
                    if member is None:
                        raise ValueError(f"no CSV in {path}")
                    with io.TextIOWrapper(z.open(member), encoding=encoding, newline="") as fh:
                        for i, line in enumerate(fh):
                            rows.append((path, member, i, line.rstrip("\r\n")))
                            if len(rows) >= chunk:
                                yield pd.DataFrame(rows, columns=["path", "member", "line_no", "line"])
                                rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["path", "member", "line_no", "line"])
    return files.select("path", "content").mapInPandas(unzip, "path string, member string, line_no long, line string")


def provenance(files: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(path, bytes, sha256, modified); expected paths without a file get NULLs."""
    found = files.select("path", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"),
                         F.col("modificationTime").alias("modified"))
    return found if expected is None else expected.select("path").join(found, "path", "left")


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs to top-level lower-case columns with dotted names."""
    def walk(schema: StructType, prefix: tuple[str, ...]):
        for f in schema.fields:
            path = (*prefix, f.name)
            if isinstance(f.dataType, StructType):
                yield from walk(f.dataType, path)
            else:
                yield path
    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path).lower()) for path in walk(df.schema, ())])


def union_pages(pages: DataFrame) -> DataFrame:
    """Rows of landed API pages: a ``results`` array is exploded, a bare list passes through."""
    t = dict((f.name, f.dataType) for f in pages.schema.fields).get("results")
    if isinstance(t, ArrayType):
        return pages.select(F.explode("results").alias("r")).select("r.*")
    return pages


def read_api_records(spark: SparkSession, path, year: int | None = None, rename: dict[str, str] | None = None, *, multi_line: bool = True) -> DataFrame:
    """Landed API responses as flat rows with a stamped year."""
    flat = flatten(union_pages(spark.read.json(path, multiLine=multi_line)))
    out = flat.select(*[F.col(f"`{c}`").alias((rename or {}).get(c, c)) for c in flat.columns])
    return out if year is None else out.withColumn("survey_year", F.lit(year))


def read_outcomes(raw: DataFrame, measures: dict[str, str]) -> DataFrame:
    """Outcome rows from text: suppressed, NULL or non-positive values are missing; ids zero-padded."""
    def positive(c):
        x = number(c)
        return F.when(x > 0, x)
    fam = F.trim("OPEID6")  # lpad would cut a longer id, so it applies to short ones only
    return raw.select(F.col("UNITID").try_cast("int").alias("unitid"), F.when(F.length(fam) < 6, F.lpad(fam, 6, "0")).otherwise(fam).alias("family"),
                      F.coalesce(number("MAIN") == 1, F.lit(False)).alias("main"), *[positive(c).alias(name) for name, c in measures.items()])


def load_companion(df: DataFrame, cols: list[str], key: str = "UNITID") -> DataFrame:
    """Pruned companion table, refused when the key repeats."""
    return assert_unique(df.select(key, *cols), [key], "companion table")


def check_periods(intros: DataFrame, expected: DataFrame) -> DataFrame:
    """(table, expected, ok): the expected period pattern must occur in the table's introduction text.

    Dashes, quotes and spaces are normalised; the match ignores case; an empty or missing text fails.
    """
    e = expected.select("table", "expected")
    j = e.join(intros.select("table", "text"), "table", "left")
    hit = F.coalesce(F.rlike(plain_text("text"), F.concat(F.lit("(?i)"), F.col("expected"))), F.lit(False)) & (F.length("text") > 0)
    return j.groupBy("table", "expected").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("ok"))


def assert_periods(intros: DataFrame, expected: DataFrame) -> None:
    from ..operators.guards import assert_empty
    assert_empty(check_periods(intros, expected).filter("NOT ok"), "reference period not found")


def read_curated(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, dict]:
    """Curated table and its metadata sidecar."""
    meta = spark.read.json(f"{root}/{name}.meta").limit(1).collect()[0].asDict(recursive=True)
    return spark.read.parquet(f"{root}/{name}"), meta


def stack_files(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
