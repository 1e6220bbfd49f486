"""CSV records from split files: line breaks inside quotes without reading a file in one task.

A line break belongs to a quoted field where an odd number of quotes stands before it. Every split of a file knows only its
own quotes, so a first pass takes their parity by split (one bit each), and the exclusive-or of the splits before tells
whether a split begins inside a field. The second pass walks along each split's lines, joins those of one record, and hands on
the pieces at a split's edges; only these are brought together by a shuffle. A file without such line breaks is read line by line.

Quotes are doubled inside quoted fields; an unquoted field has none. A file that ends inside a field is an error.
"""

from __future__ import annotations

import codecs
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN_SPLITS = 1_000_000  # splits that begin inside a field: more of them mean that the quotes do not pair
CSV = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}
# What the bytes 80 to 9F mean in cp1252 beside the controls that Latin-1 has there.
LATIN_CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
CP1252 = "".join(bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0))


def decoded(raw: Column, encoding: str) -> Column:
    """Text of raw bytes in UTF-8 (a byte-order mark goes), Latin-1 or cp1252."""
    name = encoding.lower()
    if name in ("utf-8", "utf8", "utf-8-sig"):
        return F.regexp_replace(F.decode(raw, "UTF-8"), "^\\x{FEFF}", "")
    latin = F.decode(raw, "ISO-8859-1")
    if name in ("iso-8859-1", "latin-1"):
        return latin
    if name in ("cp1252", "windows-1252"):
        return F.translate(latin, LATIN_CONTROLS, CP1252)
    raise ValueError(f"unknown encoding {encoding}")


def split_lines(spark: SparkSession, path) -> DataFrame:
    """(path, split, line): the lines of the files as they are, by the split they begin in, in file order within it."""
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))


def is_odd(line: Column) -> Column:
    """An odd number of quotes."""
    return F.pmod(F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit(""))), F.lit(2)) == 1


def detect_encodings(spark: SparkSession, path) -> DataFrame:
    """(path, encoding) of every file, from all its lines wherever they are read: utf-8-sig if all are valid UTF-8, else cp1252."""
    valid = split_lines(spark, path).groupBy("path").agg(F.bool_and(F.is_valid_utf8("line")).alias("ok"))
    return valid.select("path", F.when(F.col("ok"), "utf-8-sig").otherwise("cp1252").alias("encoding"))


def parities(lines: DataFrame) -> DataFrame:
    """(path, split, inside, after): whether a split of (path, split, line) begins, and ends, inside a quoted field."""
    own = lines.groupBy("path", "split").agg(F.bit_xor(is_odd(F.col("line")).cast("int")).alias("odd"))
    upto = W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, W.currentRow)  # a row a split
    after = F.pmod(F.sum("odd").over(upto), F.lit(2))
    return own.select("path", "split", (F.pmod(after + F.col("odd"), F.lit(2)) == 1).alias("inside"), (after == 1).alias("after"))


def records(lines: DataFrame) -> DataFrame:
    """(path, split, at, record) of (path, split, line): whole records as bytes, numbered by where they begin.

    The lines of a split must come in order and side by side, as Spark reads them; a carriage return at a record's end goes.
    """
    spark = lines.sparkSession
    states = parities(lines)
    last = states.groupBy("path").agg(F.max_by("after", "split").alias("open")).filter("open").limit(1).collect()
    if last:
        raise ValueError(f"{last[0]['path']} ends inside a quoted field")
    inside = states.filter("inside").select("path", "split").limit(OPEN_SPLITS + 1).collect()
    if len(inside) > OPEN_SPLITS:
        raise ValueError(f"more than {OPEN_SPLITS} splits begin inside a quoted field")
    begins = spark.sparkContext.broadcast({(r["path"], r["split"]) for r in inside})
    names, kinds = ["path", "split", "at", "kind", "record"], [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, open_, pieces = None, 0, False, []  # pieces: the lines of the record under way
        head = False  # the record under way began in an earlier split

        def flush(out):
            # what is left at a split's end begins a record, or goes through it
            if pieces:
                out.append((*key, at, 2 if head else 1, b"\n".join(pieces)))

        for batch in batches:
            out: list[tuple] = []
            odd = batch.column(3).to_numpy(zero_copy_only=False)
            for path, split, line, turn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), odd.tolist(), strict=True):
                if (path, split) != key:
                    flush(out)
                    key, at, pieces = (path, split), 0, []
                    head = open_ = key in begins.value
                pieces.append(line)
                open_ ^= turn
                if not open_:
                    out.append((*key, at, 3 if head else 0, b"\n".join(pieces)))
                    at, pieces, head = at + 1, [], False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
        out = []
        flush(out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    found = lines.select("path", "split", F.col("line").cast("binary").alias("line"), is_odd(F.col("line")).alias("odd")).mapInArrow(run, "path string, split long, at long, kind int, record binary")
    # kind: 0 a whole record, 1 the beginning of one, 2 a split in its midst, 3 its end
    edges = found.filter("kind > 0")
    nth = W.partitionBy("path").orderBy("split", "at").rowsBetween(W.unboundedPreceding, W.currentRow)  # at most two rows a split
    joined = (edges.withColumn("_nth", F.count_if(F.col("kind") == 1).over(nth)).groupBy("path", "_nth")
              .agg(F.array_sort(F.collect_list(F.struct("split", "at", F.hex("record").alias("h")))).alias("p")))
    glued = F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "0A"))
    joined = joined.select("path", F.col("p")[0]["split"].alias("split"), F.col("p")[0]["at"].alias("at"), glued.alias("record"))
    return found.filter("kind = 0").select("path", "split", "at", "record").unionByName(joined)


def names_of(record: str) -> list[str]:
    import csv
    return next(csv.reader(io.StringIO(record)))


def parsed(rows: DataFrame, record: str, names: list[str]) -> DataFrame:
    """Column ``record`` as text columns ``names``, beside the other columns; missing last fields are NULL."""
    schema = ", ".join(f"_c{i} string" for i in range(len(names)))
    text = F.from_csv(F.regexp_replace(record, "\r$", ""), F.lit(schema), CSV).alias("_p")
    kept = [c for c in rows.columns if c != record]
    return rows.select(*kept, text).select(*kept, *[F.col(f"_p._c{i}").alias(n) for i, n in enumerate(names)])


def read_csv(spark: SparkSession, path, encoding: str = "UTF-8") -> DataFrame:
    """Text columns of CSV files of one layout, each with a header; every file is read in as many tasks as it has splits."""
    lines = split_lines(spark, path)
    if not lines.filter(is_odd(F.col("line"))).limit(1).count():  # every line is a record
        cp1252 = encoding.lower() in ("cp1252", "windows-1252")
        raw = spark.read.csv(path, header=True, inferSchema=False, encoding="ISO-8859-1" if cp1252 else encoding, quote='"', escape='"')
        if not cp1252:
            return raw
        table = str.maketrans(LATIN_CONTROLS, CP1252)
        return raw.select(*[F.translate(F.col(f"`{c}`"), LATIN_CONTROLS, CP1252).alias(c.translate(table)) for c in raw.columns])
    rows = records(lines).withColumn("record", decoded(F.col("record"), encoding))
    first = (F.col("split") == 0) & (F.col("at") == 0)
    headers = [r[0] for r in rows.filter(first).select(F.regexp_replace("record", "\r$", "")).distinct().limit(2).collect()]
    if len(headers) > 1:
        raise ValueError(f"files of different layouts: {headers[0]!r} and {headers[1]!r}")
    return parsed(rows.filter(~first & (F.octet_length("record") > 0)).select("record"), "record", names_of(headers[0]))


# --- archives --------------------------------------------------------------------------------

def member_encoding(z: zipfile.ZipFile, member: str) -> str:
    """utf-8-sig if the whole member is valid UTF-8, else cp1252; read in pieces."""
    check = codecs.getincrementaldecoder("utf-8")()
    with z.open(member) as fh:
        try:
            while part := fh.read(1 << 20):
                check.decode(part)
            check.decode(b"", final=True)
        except UnicodeDecodeError:
            return "cp1252"
    return "utf-8-sig"


def archive_records(files: DataFrame, pick, encoding: str | None = None, chunk: int = 20_000) -> DataFrame:
    """(path, member, encoding, at, record) of the chosen CSV member of every zip (path, content); at is the record's number.

    ``pick`` chooses among the member names; None fails the job. Without ``encoding`` the member's own is found from all of it.
    Members are read as streams, and records go out in chunks.
    """
    columns = ["path", "member", "encoding", "at", "record"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    member = pick(z.namelist())
                    if member is None:
                        raise ValueError(f"no CSV in {path}")
                    found = encoding or member_encoding(z, member)
                    with io.TextIOWrapper(z.open(member), encoding=found, errors="replace", newline="\n") as fh:
                        pieces, at = [], 0
                        for line in fh:
                            pieces.append(line)
                            if sum(p.count('"') for p in pieces) % 2 == 0:
                                rows.append((path, member, found, at, "".join(pieces).rstrip("\r\n")))
                                pieces, at = [], at + 1
                            if len(rows) >= chunk:
                                yield pd.DataFrame(rows, columns=columns)
                                rows = []
                        if pieces:
                            raise ValueError(f"{member} in {path} ends inside a quoted field")
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, "path string, member string, encoding string, at long, record string")


def archive_columns(rows: DataFrame) -> DataFrame:
    """Written ``archive_records`` as text columns beside path, member and encoding; columns that an archive lacks are NULL.

    Archives are parsed by layout: their different headers, not their number, come to the driver. Header names are trimmed and upper-cased.
    """
    heads = rows.filter("at = 0").select(F.col("path").alias("_path"), F.col("record").alias("_head"))
    out = None
    for r in heads.select("_head").distinct().sort("_head").collect():
        names = [n.replace("﻿", "").strip().upper() for n in names_of(r["_head"])]
        own = rows.filter((F.col("at") > 0) & (F.col("record") != "")).join(heads.filter(F.col("_head") == r["_head"]).select("_path"), F.col("path") == F.col("_path"), "left_semi")
        part = parsed(own.select("path", "member", "encoding", "record"), "record", names)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return rows.select("path", "member", "encoding").limit(0) if out is None else out
