"""Every query of the engine and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condensa.operators import leak_filter
from condensa.sources.tables import read_table

from . import fold_plans, gate_plans, library_plans, model_plans, more_plans, stat_plans, task_plans, text_plans
from .dialect import DUCK, runner


def leak_clean_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents left by the leak filter, by source."""
    docs = read_table(spark, sf_dir, "documents")
    leak = leak_filter.leaking_ids(docs, read_table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", "source").join(leak, "doc_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("n_clean"))


PLANS = text_plans.PLANS | stat_plans.PLANS | more_plans.PLANS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"leak_clean_by_source": leak_clean_by_source} | {k: runner(f) for k, f in PLANS.items()} | fold_plans.QUERIES | library_plans.QUERIES | task_plans.QUERIES | gate_plans.QUERIES | model_plans.QUERIES

ORACLE_SQL: dict[str, str] = {
    "leak_clean_by_source": f"select source, count(*) as n_clean from documents d where not exists (select 1 from ({text_plans.leak_ids(DUCK)}) l where l.doc_id = d.doc_id) group by source",
} | {k: f(DUCK) for k, f in PLANS.items()} | fold_plans.ORACLE_SQL | library_plans.ORACLE_SQL | task_plans.ORACLE_SQL | gate_plans.ORACLE_SQL | model_plans.ORACLE_SQL
