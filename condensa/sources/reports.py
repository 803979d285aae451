"""Reports: rows in a stated order, as one JSON file and as a table to read."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

#: Rows that a table to read may have; a report is an aggregate, and one of more rows is an error.
MOST_ROWS = 5_000


def write_report(df: DataFrame, path: str, order: list) -> None:
    """Overwrite path with one JSON Lines file of df in this order."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def markdown(df: DataFrame, order: list, digits: int = 4, most: int = MOST_ROWS) -> str:
    """df in this order as a Markdown table; nulls are n/a."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    show = lambda v: "n/a" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *(line(map(show, r)) for r in rows)]) + "\n"


def first_per_group(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """The first row of each group; distinct values in the order of their first place, if order is a row number."""
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def best_per_group(df: DataFrame, group: list[str], score: str, name: str) -> DataFrame:
    """group, name and score of the best row of each; of equal scores the larger name. Combined before the shuffle."""
    best = df.filter(F.col(score).isNotNull()).groupBy(*group).agg(F.max(F.struct(score, name)).alias("_best"))
    return best.select(*group, F.col(f"_best.{name}").alias(name), F.col(f"_best.{score}").alias(score))


@F.pandas_udf(ArrayType(LongType()))
def offsets(sizes: pd.Series) -> pd.Series:
    """Where each of these sizes begins, if one follows the other; null for null."""
    return sizes.map(lambda n: None if n is None else np.cumsum(n) - n if len(n) else np.zeros(0, np.int64))
