"""JSON Lines scans and sinks, task rows, and manifests of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of each task's rows; a missing one is an error on reading.
TASKS = {
    "summarization": "id string, cluster string, context string, reference string",
    "nli": "id string, cluster string, premise string, hypothesis string, label string",
    "choice": "id string, cluster string, context string, question string, choices array<string>, answer string",
    "qa": "id string, cluster string, context string, question string, answers array<string>",
    "math": "id string, cluster string, context string, question string, answer string",
    "long": "id string, cluster string, context string, template string, answers array<string>, subtask string",
}
EXAMPLE = ["id", "cluster", "task", "context", "question", "choices", "answer", "answers", "template", "subtask"]


def read_jsonl(spark: SparkSession, path, schema: str, skip_suffix: str | None = None) -> DataFrame:
    """Rows of files with a fixed schema; blank lines are skipped, malformed ones are errors. skip_suffix
    leaves out files that end so."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df if skip_suffix is None else df.filter(~F.col("_metadata.file_path").endswith(skip_suffix))


def write_jsonl(df: DataFrame, path: str) -> None:
    """Overwrite path with df, a row a line."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def examples(df: DataFrame, task: str) -> DataFrame:
    """A task's rows in the common shape; what a task lacks is null. An unknown task or a row without id is an error."""
    if task not in TASKS:
        raise ValueError(f"unknown task {task}")
    context = F.col("premise") if task == "nli" else F.col("context")
    named = df.withColumns({"context": context, "task": F.lit(task), "id": F.coalesce("id", F.raise_error(F.lit("row without id")))})
    if task == "nli":
        named = named.withColumnsRenamed({"hypothesis": "question", "label": "answer"})
    if task == "summarization":
        named = named.withColumn("answers", F.array("reference"))
    kinds = {"choices": "array<string>", "answers": "array<string>"}
    return named.select(*[F.col(c) if c in named.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in EXAMPLE])


def first_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows by an explicit key: a DataFrame has no file order."""
    return df.orderBy(order).limit(n)


def hash_sample(df: DataFrame, n: int, key: str, seed: int, by: list[str] | None = None) -> DataFrame:
    """n rows (of each group) in the order of md5(seed:key), ties by key: the same rows in any engine."""
    from pyspark.sql import Window

    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)]
    if not by:
        return df.orderBy(*order).limit(n)
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_nth", nth).filter(F.col("_nth") <= n).drop("_nth")


def manifest(df: DataFrame, keys: list[str]) -> DataFrame:
    """n_rows and a digest of the rows that no order changes."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(*keys).alias("n_keys"), F.sha2(F.coalesce(F.sum(part).cast("string"), F.lit("")), 256).alias("digest"))


def verify(df: DataFrame, keys: list[str], said: dict) -> list[str]:
    """What differs from a manifest that was kept."""
    now = manifest(df, keys).first().asDict()
    return [f"{k}: {said.get(k)} was said, {v} found" for k, v in now.items() if said.get(k) != v]


def missing_rows(subset: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of subset that source does not have."""
    return subset.join(source.select(subset.columns), subset.columns, "left_anti")
