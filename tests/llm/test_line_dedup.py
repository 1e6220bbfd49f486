import hashlib
from collections import defaultdict

from cohortlens.llm.line_dedup import dedup_lines

from .conftest import ascii_lower


def brute(rows):
    docs, keeper = defaultdict(set), {}
    key = lambda line: ascii_lower(line.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                docs[key(line)].add(i)
                keeper[key(line)] = max(i, keeper.get(key(line), i))
    hot = {k for k, d in docs.items() if len(d) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in hot or i is None or keeper[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in df.collect()), key=str)


def test_against_brute_force(documents):
    assert result(dedup_lines(documents)) == brute([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])


def test_odd_rows(odd):
    assert result(dedup_lines(odd)) == brute([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert set(dedup_lines(odd).columns) == {*odd.columns, "n_lines", "n_dropped"}


def test_keeper_copies_and_borders(spark):
    line = "A line of twenty chars"
    rows = [(1, f"{line}\nmine"), (2, f"  {line.lower()}\t\n{line}"), (3, f"x\n{line}\n{line.upper()}\ny"), (4, "é" + line), (3, f"x\n{line}\n{line.upper()}\ny"), (None, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(dedup_lines(df))
    assert got == brute(rows)
    assert [g[2] for g in got if g[0] in (1, 2)] == [1, 2] and all(g[2] == 0 for g in got if g[0] == 3)


def test_empty(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_with_the_names_used_on_the_way(spark):
    line = "a line that three documents share"
    df = spark.createDataFrame([(i, f"{line}\nown {i}", i, f"k{i}", [i]) for i in range(4)], "doc_id long, text string, _row int, _kept string, _lines array<int>")
    out = dedup_lines(df)
    assert set(df.columns) < set(out.columns)
    assert sorted((r.doc_id, r.text, r["_row"], r["_kept"], r["_lines"]) for r in out.collect()) == [(i, f"own {i}" if i < 3 else f"{line}\nown 3", i, f"k{i}", [i]) for i in range(4)]
