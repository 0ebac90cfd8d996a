"""Queries over versions of the records (D11, J22, W7), with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import text as T
from recordloom.operators import dedupe as D
from recordloom.operators import versions as V
from recordloom.plans.fixtures import records, with_records
from recordloom.plans.scalars import DOI_SQL
from recordloom.session import materialize

c = F.col
FIELDS = ["ID", "title", "author", "year", "doi", "origins", "status"]


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Three versions (as loaded; records of one DOI merged; missing years filled in), and the ids of merged records."""
    r = records(spark, sf_dir).withColumn("component", T.normalise_doi(c("doi")))
    several = r.filter("component is not null").groupBy("component").count().filter("count > 1").select("component")
    merged = materialize(D.merge_groups(r.join(several, "component")).select(*FIELDS), "merged")
    single = r.join(several, "component", "left_anti").select(*FIELDS)
    second = single.unionByName(merged)
    intervals = V.next_version(V.first_version(r.select(*FIELDS)), second, 1)
    intervals = V.next_version(intervals, second.withColumn("year", F.coalesce("year", F.lit("2001"))), 2)
    return materialize(intervals, "versions"), merged.select("ID")


def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All merges taken back after later edits."""
    return V.unmerge(*_history(spark, sf_dir)).select("ID", "title", "year", "origins", "status")


def j22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the newest version changed against the first."""
    return V.version_diff(_history(spark, sf_dir)[0], 0, 2)


def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records changed by the version that merged."""
    return V.changed_in(_history(spark, sf_dir)[0], 1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"D11_unmerged_records": d11, "J22_version_diff": j22, "W7_changed_in_version": w7}


def oracle_sql() -> dict[str, str]:
    m = f"with k as (select *, {DOI_SQL} as comp from r), g as (select comp, arg_min(ID, seq) as main from k where comp is not null group by comp having count(*) > 1), m as (select k.*, g.main from k left join g on g.comp = k.comp) "
    return {k: with_records(m + v) for k, v in {
        "D11_unmerged_records": "select ID, title, case when main is not null then year else coalesce(year, '2001') end as year, origins, case when main is not null then 'md_processed' else status end as status from m",
        "J22_version_diff": "select ID, case when main is not null and ID <> main then 'removed' else 'changed' end as change from m where main is not null or year is null",
        "W7_changed_in_version": "select ID, main is not null as changed from m where main is null or ID = main",
    }.items()}
