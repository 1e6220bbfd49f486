"""Tables of one data folder, and the survey-shaped views derived from them.

Each derived view exists twice: as a DataFrame here and as SQL in VIEWS, so that a query and
its SQL check start from the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut

VIEWS = {
    "sup_panel": """
        select l_suppkey unitid, year(l_shipdate) survey_year, any_value(s_nationkey) control,
          sum(l_quantity) total_enrollment, count(*) applicants,
          count_if(l_returnflag <> 'R') admits, count_if(l_returnflag = 'N') enrolled,
          count_if(l_linestatus = 'F') completers, count(*) cohort_size,
          sum(l_extendedprice) total_revenue,
          sum(l_extendedprice * (1 - l_discount)) tuition_revenue
        from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2""",
    "cust_panel": """
        select o_custkey unitid, year(o_orderdate) survey_year, any_value(c_mktsegment) sector,
          count(*) n, sum(o_totalprice) total_enrollment
        from orders join customer on o_custkey = c_custkey group by 1, 2""",
    "cohort": """
        select l_partkey unitid, count(*) n, count_if(l_returnflag = 'R') k, any_value(p_size) p_size,
          any_value(p_brand) brand
        from lineitem join part on l_partkey = p_partkey group by 1""",
    "cells": """
        select c_nationkey, c_mktsegment, o_orderstatus, year(o_orderdate) yr, count(*) n
        from orders join customer on o_custkey = c_custkey group by 1, 2, 3, 4""",
    "quasi": """
        select c_custkey unitid, c_nationkey, c_mktsegment, c_acctbal,
          cast(floor(c_acctbal / 1000) as integer) band from customer""",
    "metric_panel": """
        select unitid, metric, survey_year as year, num, cohort_size den, r_name board,
          case when cohort_size > 100 then 'large' else '' end src
        from (
          select unitid, survey_year, control, cohort_size, 'retention' metric, completers num from sup_panel
          union all
          select unitid, survey_year, control, cohort_size, 'admit' metric, admits num from sup_panel
          union all
          select unitid, survey_year, control, cohort_size, 'yield' metric, enrolled num from sup_panel)
        join nation on control = n_nationkey join region on n_regionkey = r_regionkey""",
    "changes": """
        select f.c_custkey unitid_from,
          case when f.c_acctbal < 0 then f.c_custkey else f.nation_anchor end unitid_to,
          s.first_year effective_year,
          case when f.c_acctbal < 0 then 'Closed' else 'merger' end reason, 1 ordinal
        from (select *, min(c_custkey) over (partition by c_nationkey) nation_anchor from customer) f
        join (select o_custkey, min(year(o_orderdate)) first_year from orders group by 1) s on s.o_custkey = f.c_custkey
        union all
        select f.c_custkey, f.segment_anchor, s.last_year - 1, 'merger', 2
        from (select *, min(c_custkey) over (partition by c_mktsegment) segment_anchor from customer) f
        join (select o_custkey, min(year(o_orderdate)) first_year, max(year(o_orderdate)) last_year
              from orders group by 1) s on s.o_custkey = f.c_custkey
        where f.c_acctbal >= 0 and s.last_year - 1 > s.first_year""",
    "board_year": """
        select r_name board, survey_year as year, sum(total_revenue) funding, sum(total_enrollment) fte,
          sum(completers) completers, sum(cohort_size) cohort_size, sum(tuition_revenue) tuition
        from sup_panel join nation on control = n_nationkey join region on n_regionkey = r_regionkey
        group by 1, 2""",
}
DEPENDS = {"metric_panel": ["sup_panel"], "board_year": ["sup_panel"]}


def with_views(names: str, body: str) -> str:
    """SQL text with the named views (and what they need) as common table expressions."""
    order: list[str] = []
    for n in names.split():
        for d in [*DEPENDS.get(n, []), n]:
            if d not in order:
                order.append(d)
    ctes = ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in order)
    return f"with {ctes}\n{body.strip()}"


def years_of(panel: DataFrame) -> list[int]:
    """The years of a panel in order: a row a year."""
    return sorted(r[0] for r in panel.select("survey_year").distinct().collect())


class Tables:
    """Lazy access to the parquet tables of a folder and to the derived views."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        self.__dict__[name] = df
        return df

    def once(self, name: str) -> DataFrame:
        """A derived view written once, for queries that read it several times."""
        key = f"_once_{name}"
        if key not in self.__dict__:
            self.__dict__[key] = cut(getattr(self, name))
        return self.__dict__[key]

    @cached_property
    def sup_panel(self) -> DataFrame:
        # aggregate first, then join the supplier attributes: the join sees entity-years, not lines
        by_year = (self.lineitem.withColumn("survey_year", F.year("l_shipdate"))
                   .groupBy(F.col("l_suppkey").alias("unitid"), "survey_year")
                   .agg(F.sum("l_quantity").alias("total_enrollment"), F.count("*").alias("applicants"),
                        F.count_if(F.col("l_returnflag") != "R").alias("admits"),
                        F.count_if(F.col("l_returnflag") == "N").alias("enrolled"),
                        F.count_if(F.col("l_linestatus") == "F").alias("completers"),
                        F.count("*").alias("cohort_size"),
                        F.sum("l_extendedprice").alias("total_revenue"),
                        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("tuition_revenue")))
        sup = self.supplier.select(F.col("s_suppkey").alias("unitid"), F.col("s_nationkey").alias("control"))
        cols = ["unitid", "survey_year", "control", "total_enrollment", "applicants", "admits", "enrolled",
                "completers", "cohort_size", "total_revenue", "tuition_revenue"]
        return by_year.join(sup, "unitid").select(*cols)

    @cached_property
    def cust_panel(self) -> DataFrame:
        by_year = (self.orders.withColumn("survey_year", F.year("o_orderdate"))
                   .groupBy(F.col("o_custkey").alias("unitid"), "survey_year")
                   .agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total_enrollment")))
        cust = self.customer.select(F.col("c_custkey").alias("unitid"), F.col("c_mktsegment").alias("sector"))
        return by_year.join(cust, "unitid").select("unitid", "survey_year", "sector", "n", "total_enrollment")

    @cached_property
    def cohort(self) -> DataFrame:
        k = (self.lineitem.groupBy(F.col("l_partkey").alias("unitid"))
             .agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k")))
        part = self.part.select(F.col("p_partkey").alias("unitid"), "p_size", F.col("p_brand").alias("brand"))
        return k.join(part, "unitid")

    @cached_property
    def cells(self) -> DataFrame:
        per_customer = (self.orders.groupBy("o_custkey", "o_orderstatus", F.year("o_orderdate").alias("yr"))
                        .agg(F.count("*").alias("n")))
        return (per_customer.join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
                .groupBy("c_nationkey", "c_mktsegment", "o_orderstatus", "yr").agg(F.sum("n").alias("n")))

    @cached_property
    def quasi(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("unitid"), "c_nationkey", "c_mktsegment", "c_acctbal",
                                    F.floor(F.col("c_acctbal") / 1000).cast("int").alias("band"))

    @cached_property
    def boards(self) -> DataFrame:
        return (self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
                .select(F.col("n_nationkey").alias("control"), F.col("r_name").alias("board")))

    @cached_property
    def metric_panel(self) -> DataFrame:
        wide = self.sup_panel.join(self.boards, "control").select(
            "unitid", F.col("survey_year").alias("year"), F.col("cohort_size").alias("den"), "board",
            F.when(F.col("cohort_size") > 100, "large").otherwise("").alias("src"), F.col("completers").alias("retention"), F.col("admits").alias("admit"),
            F.col("enrolled").alias("yield"))
        return wide.unpivot(["unitid", "year", "den", "board", "src"], ["retention", "admit", "yield"], "metric", "num")

    @cached_property
    def board_year(self) -> DataFrame:
        return (self.sup_panel.join(self.boards, "control").groupBy("board", F.col("survey_year").alias("year"))
                .agg(F.sum("total_revenue").alias("funding"), F.sum("total_enrollment").alias("fte"),
                     F.sum("completers").alias("completers"), F.sum("cohort_size").alias("cohort_size"),
                     F.sum("tuition_revenue").alias("tuition")))

    @cached_property
    def changes(self) -> DataFrame:
        """An identifier crosswalk over every customer: closures, mergers, and a second later merger."""
        span = self.orders.groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("first_year"),
                                                   F.max(F.year("o_orderdate")).alias("last_year"))
        nation = self.customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("nation_anchor"))
        segment = self.customer.groupBy("c_mktsegment").agg(F.min("c_custkey").alias("segment_anchor"))
        c = (self.customer.join(span, F.col("c_custkey") == F.col("o_custkey"))
             .join(nation, "c_nationkey").join(segment, "c_mktsegment"))
        closed = F.col("c_acctbal") < 0
        first = c.select(F.col("c_custkey").alias("unitid_from"),
                         F.when(closed, F.col("c_custkey")).otherwise(F.col("nation_anchor")).alias("unitid_to"),
                         F.col("first_year").alias("effective_year"),
                         F.when(closed, "Closed").otherwise("merger").alias("reason"), F.lit(1).alias("ordinal"))
        second = c.filter(~closed & (F.col("last_year") - 1 > F.col("first_year"))).select(
            F.col("c_custkey").alias("unitid_from"), F.col("segment_anchor").alias("unitid_to"),
            (F.col("last_year") - 1).alias("effective_year"), F.lit("merger").alias("reason"), F.lit(2).alias("ordinal"))
        return first.unionByName(second)
