"""Queries of the task sources, prompts, parsers and scores on raw rows drawn from the tables, with SQL written by hand for each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condensa.sources import jsonl, tasks
from condensa.sources.tables import read_table

from .dialect import DUCK, METRIC


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def _options(i) -> F.Column:
    """A literal of four options; of every fifth row the second is the third as well."""
    return F.concat(F.lit("['op "), i.cast("string"), F.lit("', \"it's "), (i % 7).cast("string"), F.lit("\", 'x', '"), F.when(i % 5 == 0, "x").otherwise("y"), F.lit("']"))


def choice_source(spark, sf_dir):
    """Kept and dropped rows of the multiple-choice source by reason, per answer."""
    raw = _docs(spark, sf_dir).select(F.col("doc_id").alias("index"), F.coalesce("text", F.lit("")).alias("article"), F.lit("q").alias("question"), _options(F.col("doc_id")).alias("options"), F.concat(F.lit(" "), F.substring(F.lit("ABCDE"), (F.col("doc_id") % 5 + 1).cast("int"), F.lit(1))).alias("answer"))
    own = tasks.choice_rows(raw, "dev")
    return own.select("id", "cluster", F.array_join("choices", "|").alias("choices"), "answer", "dropped")


_CHOICE = r"""with l as (select doc_id, coalesce(text, '') as text, list_sort(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: len(regexp_extract_all(x, '\S+'))), lambda n: n > 0)) as k from documents),
    c as (select doc_id, text, len(k) >= 4 and coalesce(k[len(k) // 2 + 1] <= 10, false) as poem, ['op ' || doc_id, 'it''s ' || doc_id % 7, 'x', case when doc_id % 5 = 0 then 'x' else 'y' end] as o, doc_id % 5 + 1 as g from l)
    select 'choice-dev-' || doc_id as id, substr(md5(text), 1, 12) as cluster, array_to_string(o, '|') as choices, substr('ABCDE', g, 1) as answer, case when poem then 'poem' when g = 5 then 'no gold' when len(list_filter(o, lambda x: x = o[g])) > 1 then 'duplicate gold' end as dropped from c"""


def poem_like_filter(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tasks.is_poem(F.coalesce("text", F.lit(""))).alias("is_poem"))


_POEM = r"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as s from documents), n as (select doc_id, len(regexp_extract_all(s, '\S+')) as n from l), k as (select *, row_number() over (partition by doc_id order by n) as r, count(*) over (partition by doc_id) as m from n where n > 0)
    select d.doc_id, coalesce(bool_or(m >= 4 and r = m // 2 + 1 and n <= 10), false) as is_poem from documents d left join k on k.doc_id = d.doc_id group by d.doc_id"""


def text_sources(spark, sf_dir):
    """Rows of the inference, news, question and paragraph sources, as digests."""
    d = _docs(spark, sf_dir)
    nli = tasks.nli_rows(d.select(F.col("doc_id").alias("index"), F.coalesce("text", F.lit("")).alias("premise"), F.col("lang").alias("hypothesis"), F.col("source").alias("label")), "dev")
    news = tasks.news_rows(d.select(F.col("doc_id").alias("guid"), F.col("text").alias("article"), F.col("source").alias("abstract")), "dev", 150)
    qa = tasks.qa_rows(d.select(F.col("doc_id").alias("id"), F.col("source").alias("context"), F.lit("q").alias("question"), F.array("lang", "source", "lang", F.lit(None).cast("string")).alias("answers"), (F.col("doc_id") % 4 == 1).alias("impossible")), 2)
    para = tasks.paragraph_rows(d.select(F.col("doc_id").cast("string").alias("id"), "source", "text"), 25, 40, 120)
    row = lambda name, df, body: df.select(F.lit(name).alias("source"), F.col("id"), F.md5(body).alias("digest"))
    parts = [
        row("nli", nli, F.concat("cluster", "premise", "hypothesis", "label")), row("news", news, F.concat("context", F.lit("|"), "reference")),
        row("qa", qa, F.concat_ws("|", F.col("cluster"), F.col("answers"))), row("paragraphs", para, F.col("text")),
    ]
    return reduce(DataFrame.unionByName, parts)


_CLEAN = lambda x: rf"trim(regexp_replace(regexp_replace(regexp_replace(replace({x}, '_', ' '), '\s+([,.;:!?)\]}}%…])', '\1', 'g'), '([(\[{{])\s+', '\1', 'g'), '\s+', ' ', 'g'))"
_SOURCES = rf"""with nw as (select 'news-dev-' || doc_id as id, md5({_CLEAN("text")} || '|' || {_CLEAN("source")}) as g from documents where coalesce(text, '') <> '' and coalesce(source, '') <> ''),
    qa as (select 'qa-' || doc_id as id, substr(md5(source), 1, 12) as cluster, lang, source from documents where doc_id % 4 <> 1), qc as (select cluster from (select distinct cluster from qa) q order by md5('0:' || cluster), cluster limit 2),
    ps as (select doc_id, source, unnest(l) as s, generate_subscripts(l, 1) as k from (select doc_id, source, string_split(regexp_replace({_CLEAN("text")}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as l from documents where text is not null)),
    pr as (select *, sum(len(regexp_extract_all(s, '\S+'))) over (partition by doc_id order by k rows unbounded preceding) as run from ps), pt as (select doc_id, source, string_agg(s, ' ' order by k) as text, max(run) as n from pr where run <= 120 group by doc_id, source),
    pk as (select *, row_number() over (partition by source order by md5('0:' || doc_id), cast(doc_id as varchar)) as r from pt where n >= 40)
    select 'nli' as source, 'nli-dev-' || doc_id as id, md5(substr(md5(coalesce(text, '')), 1, 12) || coalesce(text, '') || lang || source) as digest from documents
    union all select * from (select 'news', id, g from nw order by md5('0:' || id), id limit 150)
    union all select 'qa', id, md5(cluster || '|' || lang || case when source <> lang then '|' || source else '' end) from qa where cluster in (select cluster from qc)
    union all select 'paragraphs', cast(doc_id as varchar), md5(text) from pk where r <= 25"""


def math_source(spark, sf_dir):
    """Questions with three demonstrations each from a pool on a ring."""
    own = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("index"), F.concat(F.coalesce("text", F.lit("")), F.when(F.col("item_id") % 6 == 0, " 1 = 1").otherwise("")).alias("question"), F.lit("so").alias("explanation"), F.col("item_id").alias("answer"))
    items, pool = own.filter("index % 2 = 0"), own.filter("index % 2 = 1").withColumn("answer", F.col("answer").cast("string"))
    return tasks.math_rows(items, pool, "test", 3).select("id", F.md5("context").alias("context_md5"), "answer")


_MATH = r"""with q as (select item_id, coalesce(text, '') || case when item_id % 6 = 0 then ' 1 = 1' else '' end as question from benchmark), u as (select * from q where question not like '%=%' and len(regexp_extract_all(question || ' so', '\S+')) <= 400),
    p as (select 'Question: ' || question || chr(10) || 'Solution: so' || chr(10) || 'Answer: ' || item_id as demo, row_number() over (order by md5('0:' || item_id), item_id) - 1 as place, count(*) over () as n from u where item_id % 2 = 1),
    w as (select item_id, k.k, (cast('0x' || substr(md5('0:test:' || item_id), 1, 8) as bigint) + k.k) % (select max(n) from p) as place from u cross join (values (0), (1), (2)) k(k) where item_id % 2 = 0)
    select 'math-test-' || item_id as id, md5(string_agg(demo, chr(10) || chr(10) order by k)) as context_md5, cast(item_id as varchar) as answer from w join p on p.place = w.place group by item_id"""


def long_source(spark, sf_dir):
    """Long-context rows whose template has one slot, marked or empty, and their prompts."""
    t = F.coalesce("text", F.lit(""))
    marked = F.col("doc_id") % 2 == 0
    raw = _docs(spark, sf_dir).select(
        F.col("doc_id").alias("index"), F.col("source").alias("subtask"), F.when(marked, F.concat(F.lit("Read. <T>"), t, F.lit("</T> end"))).otherwise(t).alias("context"),
        F.when(marked, " Which? ").otherwise("List: <T>  </T> Which?").alias("question"), F.lit(" A:").alias("prefix"), F.array("lang").alias("answers"),
    )
    own = tasks.long_rows(raw, "<T>", "</T>", 30)
    return own.select("id", "cluster", "template", F.md5("context").alias("context_md5"), F.md5(tasks.prompt("long")).alias("prompt_md5"))


_LONG = """with k as (select *, trim(coalesce(text, ''), ' ') as t, row_number() over (partition by source order by md5('0:' || doc_id), doc_id) as r from documents),
    m as (select *, case when doc_id % 2 = 0 then 'Read. <T>' || chr(10) || '{context}' || chr(10) || '</T>' || chr(10) || chr(10) || 'Which?' || chr(10) || chr(10) || ' A:' else 'List: <T>' || chr(10) || '{context}' || chr(10) || '</T> Which? A:' end as template from k where r <= 30)
    select 'long-' || source || '-' || doc_id as id, 'long-' || doc_id as cluster, template, md5(t) as context_md5, md5(replace(template, '{context}', t)) as prompt_md5 from m"""


def prompts_by_task(spark, sf_dir):
    """Every task's prompt for every turn, as digests, and the number of its characters."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("context"), F.col("role").alias("question"), F.array("role", F.lit("b"), F.lit("c"), F.lit("d")).alias("choices"))
    return c.select("conv_id", "turn", *[F.md5(tasks.prompt(t)).alias(t) for t in ("summarization", "nli", "qa", "math", "choice")])


_NL = "' || chr(10) || '"
_PROMPTS = f"""select conv_id, turn, md5('Summarise the text in a few sentences.{_NL}{_NL}Text: ' || coalesce(text, '') || '{_NL}{_NL}Summary:') as summarization,
    md5('How does the hypothesis relate to the premise? Answer with one of: entailment, contradiction, neutral, other.{_NL}{_NL}Premise: ' || coalesce(text, '') || '{_NL}Hypothesis: ' || role || '{_NL}{_NL}Label:') as nli,
    md5('Answer with a phrase from the passage and nothing else.{_NL}{_NL}Passage: ' || coalesce(text, '') || '{_NL}{_NL}Question: ' || role || '{_NL}{_NL}Answer:') as qa,
    md5('Solve it as the examples do. End with a line "Answer: <number>".{_NL}{_NL}' || coalesce(text, '') || '{_NL}{_NL}Question: ' || role || '{_NL}Solution:') as math,
    md5('Choose the right answer. Answer with one letter.{_NL}{_NL}Passage: ' || coalesce(text, '') || '{_NL}{_NL}Question: ' || role || '{_NL}A. ' || role || '{_NL}B. b{_NL}C. c{_NL}D. d{_NL}{_NL}Answer:') as choice from conversations"""


def parsed_answers(spark, sf_dir):
    """Answers read from turns that labels, letters and numbers were put into."""
    i = F.col("conv_id") + F.col("turn")
    extra = F.when(i % 4 == 0, " It is Neutral, no: entailment").when(i % 4 == 1, " answer (B) or C\nAnswer: 1.000, yes").when(i % 4 == 2, " so 12,50 and 7.0.").otherwise("")
    c = read_table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", F.concat(F.regexp_replace("text", r"[0-9.,A-Z]+", " "), extra).alias("x"))
    return c.select("conv_id", "turn", *[tasks.parse(t, F.col("x")).alias(t) for t in ("nli", "choice", "math")], F.md5(tasks.parse("qa", F.col("x"))).alias("qa"))


_PARSED = r"""with c as (select conv_id, turn, (conv_id + turn) % 4 as i, regexp_replace(text, '[0-9.,A-Z]+', ' ', 'g') as b from conversations where text is not null),
    x as (select *, b || case i when 0 then ' It is Neutral, no: entailment' when 1 then ' answer (B) or C' || chr(10) || 'Answer: 1.000, yes' when 2 then ' so 12,50 and 7.0.' else '' end as x from c),
    l as (select *, [case when contains(lower(x), n) then lpad(cast(strpos(lower(x), n) as varchar), 9, '0') || n end for n in ['entailment', 'contradiction', 'neutral', 'other']] as h from x)
    select conv_id, turn, coalesce(substr(list_sort(list_filter(h, lambda v: v is not null))[1], 10), '') as nli, case when i = 1 then 'B' else '' end as choice, case i when 1 then '1000' when 2 then '7' else '' end as math,
      md5(trim(string_split(trim(x), chr(10))[1])) as qa from l"""


def scored_answers(spark, sf_dir):
    """Best F1, exact match and recall of a turn against two answers, and the metric that counts."""
    q = read_table(spark, sf_dir, "conversations").alias("q")
    a = read_table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.coalesce("text", F.lit("")).alias("gold"))
    own = q.join(a, ["conv_id", "turn"]).select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("pred"), F.array("gold", F.concat(F.substring_index("text", " ", 3), F.lit("."))).alias("golds"), F.when(F.col("turn") % 2 == 0, "qa").otherwise("long").alias("task"))
    return own.select("conv_id", "turn", F.round(tasks.best_f1("pred", "golds"), 6).alias("f1"), tasks.exact_match("pred", "golds").alias("em"), F.round(tasks.recall("pred", "golds"), 6).alias("recall"), tasks.main_metric(F.col("task")).alias("metric"))


_TERMS = lambda x: DUCK.find_all(f"lower({x})", METRIC)
_SCORED = f"""with p as (select q.conv_id, q.turn, coalesce(q.text, '') as pred, q.text as raw, coalesce(a.text, '') as gold from conversations q join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1 where a.role = 'assistant'),
    g as (select conv_id, turn, pred, unnest([gold, array_to_string(string_split(raw, ' ')[1:3], ' ') || '.']) as gold, unnest([1, 2]) as k from p),
    tp as (select conv_id, turn, k, unnest({_TERMS("pred")}) as w from g), tg as (select conv_id, turn, k, unnest({_TERMS("gold")}) as w from g),
    cp as (select conv_id, turn, k, w, count(*) as c from tp group by all), cg as (select conv_id, turn, k, w, count(*) as c from tg group by all),
    s as (select conv_id, turn, k, sum(least(cp.c, cg.c)) as n from cp join cg using (conv_id, turn, k, w) group by all),
    f as (select g.conv_id, g.turn, g.k, coalesce(2e0 * s.n / nullif(len({_TERMS("pred")}) + len({_TERMS("gold")}), 0), 0) as f1, {_TERMS("pred")} = {_TERMS("gold")} as em, contains(lower(pred), lower(gold)) as hit from g left join s on s.conv_id = g.conv_id and s.turn = g.turn and s.k = g.k)
    select conv_id, turn, round(max(f1), 6) as f1, max(case when em then 1e0 else 0e0 end) as em, round(avg(case when hit then 1e0 else 0e0 end), 6) as recall, case when turn % 2 = 0 then 'f1' else 'recall' end as metric from f group by conv_id, turn"""


def segmented_join(spark, sf_dir):
    """Examples with their segmentation, one each."""
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "lang")
    seg = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.size(F.split(F.coalesce("text", F.lit("")), " ")).cast("long").alias("n_words"))
    return tasks.with_segmentation(d, seg)


_SEGMENTED = "select doc_id as id, lang, len(string_split(coalesce(text, ''), ' ')) as n_words from documents"


def manifest_of_labels(spark, sf_dir):
    """Rows and keys of a table, and how many rows of a subset its source lacks."""
    labels = read_table(spark, sf_dir, "labels")
    own = jsonl.manifest(labels, ["doc_id"]).select("n_rows", "n_keys")
    lost = jsonl.missing_rows(labels.select("doc_id").unionByName(spark.createDataFrame([(-5,)], "doc_id long")), _docs(spark, sf_dir).select("doc_id")).agg(F.count(F.lit(1)).alias("n_foreign"))
    return own.crossJoin(lost)  # one row each


_MANIFEST = "select count(*) as n_rows, count(distinct doc_id) as n_keys, 1 + (select count(*) from labels l where not exists (select 1 from documents d where d.doc_id = l.doc_id)) as n_foreign from labels"

QUERIES = {f.__name__: f for f in (choice_source, poem_like_filter, text_sources, math_source, long_source, prompts_by_task, parsed_answers, scored_answers, segmented_join, manifest_of_labels)}
ORACLE_SQL = {"choice_source": _CHOICE, "poem_like_filter": _POEM, "text_sources": _SOURCES, "math_source": _MATH, "long_source": _LONG, "prompts_by_task": _PROMPTS, "parsed_answers": _PARSED, "scored_answers": _SCORED, "segmented_join": _SEGMENTED, "manifest_of_labels": _MANIFEST}
