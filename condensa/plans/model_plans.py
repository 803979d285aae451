"""Queries of the places where models plug in, with the built-in stand-ins, and of report rows; SQL written by hand for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condensa.operators import diagnose, gates, models
from condensa.sources import reports, tasks
from condensa.sources.tables import read_table

from .dialect import DUCK, METRIC, TOKEN
from .gate_plans import _R, results

#: Runs without white space as Python cuts them.
_WORD = r"([^\s\x0b\x1c-\x1f\x85\p{Z}]+)"


def segmented_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and numerals of every document by the built-in segmenter, each text segmented once."""
    own = models.segment(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = lambda a: F.when(F.col("words").isNotNull(), F.size(a).cast("long"))
    return own.select("doc_id", size("words").alias("n_words"), size(F.filter("words", lambda w: w["pos"] == "M")).alias("n_numerals"), F.md5(models.joined_words("words")).alias("joined_md5"))


_SEGMENTED = f"""with w as (select doc_id, text, {DUCK.find_all("text", TOKEN)} as l from documents)
    select doc_id, case when text is not null then len(l) end as n_words, case when text is not null then len(list_filter(l, lambda x: regexp_matches(x, '^\\p{{Nd}}+$'))) end as n_numerals, case when text is not null then md5(array_to_string(l, ' ')) end as joined_md5 from w"""


def reader_answers(spark, sf_dir):
    """What the built-in reader says to every turn's prompt, and its parsed first line."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("context"))
    got = models.read_answers(c, ["conv_id", "turn"], tasks.prompt("summarization"), 5)
    return got.select("conv_id", "turn", F.md5(tasks.parse("qa", F.col("raw_output"))).alias("answer_md5"), "n_output_tokens")


_READER = f"""with c as (select conv_id, turn, string_split('Text: ' || coalesce(text, ''), chr(10))[-1] as line from conversations), w as (select conv_id, turn, {DUCK.find_all("line", _WORD)}[1:5] as l from c)
    select conv_id, turn, md5(array_to_string(l, ' ')) as answer_md5, len(l) as n_output_tokens from w"""


def teacher_calls(spark, sf_dir):
    """Calls at two rates that are not done yet; those of texts of some lengths fail and say so."""

    def call(text: str, rate: float) -> str:
        if len(text) % 7 == 0:
            raise ValueError("no answer")
        words = text.split()
        return " ".join(words[: max(1, round(rate * len(words)))])

    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    done = docs.filter("id % 5 = 0").select("id", F.lit(0.3).alias("ratio"))
    got = models.ask_teacher(docs, done, call, [0.3, 0.5])
    return got.select("id", F.round("ratio", 3).alias("ratio"), F.md5("compressed").alias("compressed_md5"), "error")


_TEACHER = f"""with d as (select doc_id as id, text, {DUCK.find_all("text", _WORD)} as l from documents where text is not null), r as (select *, unnest([0.3e0, 0.5e0]) as ratio from d)
    select id, ratio, case when length(text) % 7 <> 0 then md5(array_to_string(l[1:greatest(1, cast(round_even(ratio * len(l), 0) as bigint))], ' ')) end as compressed_md5, case when length(text) % 7 = 0 then 'ValueError: no answer' end as error from r where not (ratio = 0.3e0 and id % 5 = 0)"""


def similarity_scores(spark, sf_dir):
    """Similarity of a turn and the answer after it with the built-in encoder."""
    q = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("pred"))
    a = read_table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    return models.similarity_f1(q.join(a, ["conv_id", "turn"]), ["conv_id", "turn"]).withColumn("f1", F.round("f1", 6))


_SIMILAR = f"""with p as (select q.conv_id, q.turn, {DUCK.find_all("lower(coalesce(q.text, ''))", METRIC)}[1:256] as a, {DUCK.find_all("lower(coalesce(g.text, ''))", METRIC)}[1:256] as b from conversations q join conversations g on g.conv_id = q.conv_id and g.turn = q.turn + 1 where g.role = 'assistant'),
    s as (select *, len(list_filter(a, lambda x: list_contains(b, x))) * 1e0 / nullif(len(a), 0) as p, len(list_filter(b, lambda x: list_contains(a, x))) * 1e0 / nullif(len(b), 0) as r from p)
    select conv_id, turn, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1 from s"""


def report_cells(spark, sf_dir):
    """Cells of a report in its order: mean, rows, clusters, budget adherence, empty answers; and each task's best method."""
    rows = results(spark, sf_dir)
    cells = rows.groupBy("task", "method", "ratio").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("n_clusters"))
    own = cells.join(gates.adherence(rows, ["task", "method", "ratio"]), ["task", "method", "ratio"])
    best = reports.best_per_group(gates.means(rows), ["task", "ratio"], "mean", "method").select("task", "ratio", F.col("method").alias("best"))
    own = own.join(best, ["task", "ratio"]).withColumn("family", diagnose.family(F.col("method")))
    return own.select("task", "method", "family", "ratio", "n", "n_clusters", "best", *[F.round(c, 6).alias(c) for c in ("mean", "tokens_per_budget", "share_deviating", "empty_share")])


_CELLS = f"""with {_R}, g as (select task, method, ratio, avg(score) as mean, count(*) as n, count(distinct cluster) as n_clusters, avg(c * 1e0 / budget) as t, avg(case when abs(c * 1e0 / budget - 1) > 0.05 + 1e-12 then 1e0 else 0e0 end) as s, avg(case when prediction = '' then 1e0 else 0e0 end) as e from r group by task, method, ratio)
    select task, method, case when method in ('truncation', 'tfidf_sent', 'probe_negation') then 'deterministic' else 'other' end as family, ratio, n, n_clusters, first_value(method) over (partition by task, ratio order by mean desc, method desc) as best,
      round(mean, 6) as mean, round(t, 6) as tokens_per_budget, round(s, 6) as share_deviating, round(e, 6) as empty_share from g"""


def unit_offsets(spark, sf_dir):
    """Where units begin in a text without its white space: the last and the sum of those places; and the first turn of every role."""
    sizes = F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""), F.length)
    own = read_table(spark, sf_dir, "documents").select("doc_id", reports.offsets(sizes).alias("o"))
    return own.select("doc_id", F.coalesce(F.get("o", F.size("o") - 1), F.lit(0)).alias("last"), F.aggregate("o", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


_OFFSETS = r"""with u as (select doc_id, unnest(l) as v, generate_subscripts(l, 1) as pos from (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') as l from documents)),
    o as (select doc_id, sum(length(v)) over (partition by doc_id order by pos rows unbounded preceding) - length(v) as o from u)
    select d.doc_id, cast(coalesce(max(o), 0) as bigint) as last, cast(coalesce(sum(o), 0) as bigint) as total from documents d left join o on o.doc_id = d.doc_id group by d.doc_id"""


def first_turns(spark, sf_dir):
    """The first turn of every role in every fifth conversation class, in the order of conversations."""
    c = read_table(spark, sf_dir, "conversations").withColumn("klass", F.col("conv_id") % 5)
    return reports.first_per_group(c, ["klass", "role"], ["conv_id", "turn", "text"]).select("klass", "role", "conv_id", "turn", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


_FIRST = "select klass, role, conv_id, turn, md5(coalesce(text, '')) as text_md5 from (select *, conv_id % 5 as klass, row_number() over (partition by conv_id % 5, role order by conv_id, turn, text nulls first) as k from conversations) q where k = 1"

QUERIES = {f.__name__: f for f in (segmented_words, reader_answers, teacher_calls, similarity_scores, report_cells, unit_offsets, first_turns)}
ORACLE_SQL = {"segmented_words": _SEGMENTED, "reader_answers": _READER, "teacher_calls": _TEACHER, "similarity_scores": _SIMILAR, "report_cells": _CELLS, "unit_offsets": _OFFSETS, "first_turns": _FIRST}
