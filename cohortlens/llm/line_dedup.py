"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position.

All of it is DataFrame functions. Only hashes, positions and ids are exploded; a text moves once, to meet its
drop flags. A line's key is two 64-bit hashes of the normalised line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.lineage import cut

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS = 20, 3
OWN = ("_doc", "_row", "_lines", "_flags", "_kept")  # columns on the way


def normalised(line: Column) -> Column:
    """The line without [\\x20\\x09-\\x0D] at both ends and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, pos, h1, h2) of every line; the hashes are null below ``min_chars``. row tells texts of one id apart."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    key = F.when(F.length("key") >= min_chars, F.col("key"))
    return (lines.withColumn("key", normalised(F.col("line")))
            .select("doc_id", "row", "pos", F.when(key.isNotNull(), F.xxhash64(key)).alias("h1"),
                    F.when(key.isNotNull(), F.xxhash64(F.lit(1), key)).alias("h2")))


def repeated(keys: DataFrame, min_docs: int) -> DataFrame:
    """Keys found in at least ``min_docs`` documents, with the largest doc_id holding each."""
    per_doc = keys.filter(F.col("h1").isNotNull()).groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    return (per_doc.groupBy("h1", "h2").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
            .filter(F.col("n") >= min_docs).select("h1", "h2", "keeper"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs`` with the text replaced by its kept lines, plus n_lines and n_dropped.

    A key (see ``normalised``) of at least ``min_chars`` code points found in at least ``min_docs`` documents loses all
    its lines but those in the largest doc_id holding it. Null and empty texts are one empty line. Rows that repeat a
    doc_id count as one document; each keeps its own text's lines, and a line goes if its key goes for that id. A row
    without doc_id counts in no document and keeps its lines. A text column null stays null. Columns named like the
    results are replaced.
    """
    clashing = {c: f"{c}_of_input" for c in docs.columns if c.lower() in OWN}
    docs = docs.withColumnsRenamed(clashing)
    flags = dropped_lines(docs, min_chars, min_docs)
    kept = F.filter(F.col("_lines"), lambda _, i: ~F.coalesce(F.get(F.col("_flags"), i), F.lit(False)))
    out = (docs.join(flags, (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_row")), "left").withColumn("_lines", lines_of(F.col("text")))
           .withColumn("_kept", F.when(F.col("_flags").isNull(), F.col("_lines")).otherwise(kept)))
    return out.withColumns({
        "text": F.when(F.col("text").isNotNull(), F.array_join("_kept", "\n")),
        "n_lines": F.size("_lines").cast("long"),
        "n_dropped": (F.size("_lines") - F.size("_kept")).cast("long"),
    }).drop(*OWN).withColumnsRenamed({new: c for c, new in clashing.items()})


def dropped_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(_doc, _row, _flags): for texts that lose a line, one flag for each of their lines in order."""
    keys = line_keys(docs.select("doc_id", "text"), min_chars)
    # written, so that the join is planned by its size and can split a hot line's rows
    hot = cut(repeated(keys, min_docs).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "keeper"))
    gone = (keys.filter(F.col("h1").isNotNull() & F.col("doc_id").isNotNull())
            .join(hot, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
            .filter(F.col("doc_id") != F.col("keeper")).groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("pos")).alias("at")))
    # positions in order -> one flag a line, in one walk over the positions
    gaps = F.transform("at", lambda p, i: F.concat(
        F.array_repeat(F.lit(False), p - F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col("at"), i - 1)) - 1), F.array(F.lit(True))))
    return gone.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), F.flatten(gaps).alias("_flags"))
