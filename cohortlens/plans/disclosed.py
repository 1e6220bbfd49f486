"""Queries over disclosure control (D family, A9, A10, K8)."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import functions as F

from ..functions import labels
from ..operators import disclosure as d
from .derived import rounded
from .registry import query
from .tables import Tables

G = ["c_nationkey", "c_mktsegment", "yr"]
CELL = [*G, "o_orderstatus"]

_SUP = """
    , b as (select *, n > 0 and n < 3 p from cells),
    g as (select *, count_if(p) over w np, min(case when not p then n end) over w mn, row_number() over (partition by c_nationkey, c_mktsegment, yr, p order by n, o_orderstatus) rn
      from b window w as (partition by c_nationkey, c_mktsegment, yr)),
    s as (select *, p or (np = 1 and not p and rn = 1) blank, np = 1 and mn is null unprot from g)"""


def _suppressed(t: Tables):
    return d.suppress(t.cells, ["n"], ["o_orderstatus"], threshold=3, groups=G)


@query("d01_small_cells", """
    select c_nationkey, c_mktsegment, o_orderstatus, yr, n < 10 is_small_cell, case when not n < 10 then n * 2 end v from cells""", "cells")
def _(t: Tables):
    c = t.cells.withColumn("v", F.col("n") * 2)
    return d.mask_small(c, "n", ["v"]).select(*CELL, "is_small_cell", "v")


@query("d01_suppression_rate", "select round(avg(cast(n < 10 as int)), 6) suppression_rate, count(*) n_cells from cells", "cells")
def _(t: Tables):
    return rounded(d.suppression_rate(d.flag_small(t.cells, "n")), ["suppression_rate"])


@query("d02_primary_suppression", """
    select c_nationkey, c_mktsegment, o_orderstatus, yr, case when not (n > 0 and n < 3) then n end n, n > 0 and n < 3 as "_suppressed" from cells""", "cells")
def _(t: Tables):
    return d.suppress(t.cells, ["n"], ["o_orderstatus"], threshold=3).select(*CELL, "n", "_suppressed")


@query("d03_complementary_suppression", _SUP + """
    select c_nationkey, c_mktsegment, o_orderstatus, yr, case when not blank then n end n, blank as "_suppressed" from s""", "cells")
def _(t: Tables):
    return _suppressed(t).select(*CELL, "n", "_suppressed")


@query("d02_suppression_audit", _SUP + """
    select 'n' as "column", count_if(blank) n_suppressed, 3 threshold, count_if(unprot and blank) groups_needing_total_suppressed from s""", "cells")
def _(t: Tables):
    return d.suppression_audit(_suppressed(t), ["n"], 3)


@query("d04_recoverable_groups", """
    select c_nationkey, c_mktsegment, yr, count(*) n_cells, count_if(n > 0 and n < 3) n_blank from cells group by 1, 2, 3
    having count(*) > 1 and count_if(n > 0 and n < 3) = 1""", "cells")
def _(t: Tables):
    return d.recoverable(d.suppress(t.cells, ["n"], ["o_orderstatus"], threshold=3), "n", G)


@query("a09_k_anonymity", """
    , q as (select *, case when band >= 0 then band end b from quasi)
    select c_nationkey, c_mktsegment, b, count(*) class_size, count(*) k, count(*) = 1 at_risk from q group by 1, 2, 3""", "quasi")
def _(t: Tables):
    q = t.quasi.withColumn("b", F.when(F.col("band") >= 0, F.col("band")))
    return d.k_anonymity(q, ["c_nationkey", "c_mktsegment", "b"])


@query("a10_reidentification", """
    , sets as (select 'nation' key_set, cast(c_nationkey as varchar) k from quasi union all select 'nation, segment', c_nationkey || c_mktsegment from quasi
      union all select 'all', c_nationkey || c_mktsegment || band from quasi),
    c as (select key_set, k, count(*) n from sets group by 1, 2)
    select key_set, min(n) min_k, cast(coalesce(sum(n) filter (n < 5), 0) as bigint) rows_small, round(coalesce(sum(n) filter (n = 1), 0) / sum(n), 6) linked_share
    from c group by 1""", "quasi")
def _(t: Tables):
    sets = {"nation": ["c_nationkey"], "nation, segment": ["c_nationkey", "c_mktsegment"], "all": ["c_nationkey", "c_mktsegment", "band"]}
    return rounded(d.reidentification(t.quasi, t.quasi, sets), ["linked_share"])


def _salt() -> str:
    # the key belongs to whoever runs the job; without one a throw-away key still gives a valid pseudonym table
    return os.environ.get("PSEUDONYM_SALT") or secrets.token_hex(16)


@query("d05_pseudonym_table", """
    select count(*) n_ids, count(*) n_pseudonyms, 17 min_length, 17 max_length from (select distinct o_custkey from orders)""")
def _(t: Tables):
    p = d.pseudonyms(t.orders, "o_custkey", _salt())
    return p.agg(F.count("*").alias("n_ids"), F.count_distinct("pseudonym").alias("n_pseudonyms"),
                 F.min(F.length("pseudonym")).alias("min_length"), F.max(F.length("pseudonym")).alias("max_length"))


@query("k08_public_layer", """
    select c_mktsegment, case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'small' else 'large' end size_band, count(*) n, count(*) n_pseudonyms
    from quasi group by 1, 2""", "quasi")
def _(t: Tables):
    layer = d.public_layer(t.quasi, "unitid", ["c_mktsegment"], {
        "size_band": labels.band(F.col("c_acctbal"), [-1e9, 0, 5000, 1e9], ["debt", "small", "large"])}, _salt())
    return layer.groupBy("c_mktsegment", "size_band").agg(F.count("*").alias("n"), F.count_distinct("pseudonym").alias("n_pseudonyms"))
