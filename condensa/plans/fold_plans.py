"""Queries whose selection is a fold over a text: an Arrow pass in Spark, a list fold in the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condensa.operators import compress
from condensa.sources.tables import read_table

from .dialect import DUCK, METRIC
from .text_plans import NEGATION, STOP, _units

RATIO = 0.333
_DIGIT = "regexp_matches(val, '[0-9]')"
_NOISE = lambda seed: f"{DUCK.md5_int(f"concat('{seed}:', cast(pos as varchar(9)))")} / 4294967296e0"
_LATE = "0.5e0 * (1e0 - pos * 1e0 / n)"
_GUARD = f"case when lower(val) in {NEGATION} or {_DIGIT} then 1e0 else 0e0 end"

#: Spec, score and priority in SQL, and the exponent of the cost.
SPECS = {
    "compress_random": ("random:seed=1", _NOISE("1"), "0e0", 0),
    "compress_stopword": ("stopword", f"case when lower(val) in {STOP} then 0e0 else 1e0 end + {_LATE}", "0e0", 0),
    "compress_lexical": ("lexical", f"case when {_DIGIT} then 3e0 when lower(val) in {STOP} then 0e0 when length(val) >= 9 then 2e0 else 1e0 end + {_LATE}", "0e0", 0),
    "compress_protected_soft": ("protected:mode=soft,delta=0.5", f"{_NOISE('p')} + 0.5e0 * {_GUARD}", "0e0", 0),
    "compress_protected_hard": ("protected:mode=hard,alpha=1", _NOISE("p"), _GUARD, 1),
}


def _query(spec: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = read_table(spark, sf_dir, "documents")
        return compress.compress(docs, spec, RATIO).select("doc_id", "budget", "n_kept", "used", "positions")

    return run


def _sql(score: str, priority: str, alpha: int) -> str:
    return f"""
    with u as (select doc_id, pos, cost, budget, {score} as s, {priority} as p from {_units(DUCK)} x),
    r as (select *, sum(cost) over (partition by doc_id order by p desc, {f"s / power(cost, {alpha})" if alpha else "s"} desc, pos rows unbounded preceding) as run from u),
    one as (select doc_id, max(budget) as budget, count(*) filter (where run <= budget) as n, coalesce(sum(cost) filter (where run <= budget), 0) as used, coalesce(sum(pos) filter (where run <= budget), 0) as positions,
      list({{'used': cast(0 as bigint), 'n': cast(0 as bigint), 'positions': cast(0 as bigint), 'budget': cast(budget as bigint), 'cost': cast(cost as bigint), 'pos': cast(pos as bigint)}} order by s desc, pos) filter (where run > budget) as rest from r group by doc_id),
    two as (select doc_id, list_reduce(list_prepend({{'used': cast(used as bigint), 'n': cast(n as bigint), 'positions': cast(positions as bigint), 'budget': cast(budget as bigint), 'cost': cast(0 as bigint), 'pos': cast(0 as bigint)}}, coalesce(rest, [])),
      lambda acc, x: case when acc.used + x.cost <= acc.budget then {{'used': acc.used + x.cost, 'n': acc.n + 1, 'positions': acc.positions + x.pos, 'budget': acc.budget, 'cost': acc.cost, 'pos': acc.pos}} else acc end) as f from one)
    select d.doc_id, coalesce(f.budget, 0) as budget, coalesce(f.n, 0) as n_kept, coalesce(f.used, 0) as used, coalesce(f.positions, 0) as positions from documents d left join two on two.doc_id = d.doc_id"""


def align_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress.align_labels(read_table(spark, sf_dir, "documents"), "stopword", RATIO)


def knapsack_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress.knapsack_gap(read_table(spark, sf_dir, "documents"), RATIO)


def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    nxt = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    return compress.rouge_l(turns.select("conv_id", "turn", F.col("text").alias("pred")).join(nxt, ["conv_id", "turn"])).withColumn("f1", F.round("f1", 6))


QUERIES = {k: _query(v[0]) for k, v in SPECS.items()} | {"align_labels": align_labels, "knapsack_gap": knapsack_gap, "rouge_l": rouge_l}

ORACLE_SQL = {k: _sql(*v[1:]) for k, v in SPECS.items()} | {
    # longest common subsequence by rows of its table: the state is the last row
    "rouge_l": f"""
    with p as (select q.conv_id, q.turn, {DUCK.find_all("lower(coalesce(q.text, ''))", METRIC)} as a, {DUCK.find_all("lower(coalesce(g.text, ''))", METRIC)} as b from conversations q join conversations g on g.conv_id = q.conv_id and g.turn = q.turn + 1 where g.role = 'assistant'),
    r as (select conv_id, turn, len(a) + len(b) as total, b, a, list_transform(range(0, len(b) + 1), lambda x: cast(0 as bigint)) as zero from p),
    w as (select conv_id, turn, total, list_reduce(list_prepend({{'row': zero, 't': ''}}, list_transform(a, lambda t: {{'row': zero, 't': t}})),
      lambda acc, x: {{'row': list_reduce(list_prepend([cast(0 as bigint)], list_transform(range(1, len(b) + 1), lambda j: [j])),
        lambda l, j: list_append(l, greatest(l[len(l)], acc.row[len(l) + 1], case when b[len(l)] = x.t then acc.row[len(l)] + 1 else 0 end))), 't': x.t}}) as f from r)
    select conv_id, turn, coalesce(round(2e0 * f.row[len(f.row)] / nullif(total, 0), 6), 0e0) as f1 from w""",
}
