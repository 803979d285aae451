"""Queries that call the library's DataFrame functions on the tables at hand, and SQL for each that is written by hand and
shares nothing with them but the adapters below, which turn tables into the rows that the functions take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condensa.functions import text as T
from condensa.operators import compress, gates, protection, stats
from condensa.sources import jsonl
from condensa.sources.tables import read_table
from condensa.streaming import incremental

from .dialect import DUCK, METRIC, TOKEN
from .fold_plans import RATIO
from .stat_plans import _cells as _cells_sql
from .text_plans import _units

#: A lexicon for the languages of the tables.
LEX = protection.Lexicon(
    negation=("not", "no", "never", "non", "pas", "nicht", "kein", "keine", "sin", "nunca"), asking=("no", "non"), particles=("the", "la", "el"),
    harmless={"no": ("", "one", "la"), "pas": ("de",)}, tiers={"T1": ("if", "wenn", "si"), "T2": ("was", "were", "has", "ist", "est"), "T3": ("more", "all", "mehr", "plus", "the")},
    only_pos={}, not_pos={"the": ("N",)}, only_before={"plus": ("de",)}, not_before={"si": ("la", "?")},
)


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


# -- words of documents: tokens, numerals tagged M, words that begin with a capital after a small letter's word named


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), F.lit(1))
    word = lambda t: F.struct(t.alias("text"), F.when(t.rlike(r"^\p{Nd}+$"), "M").when(F.length(t) % 7 == 3, "N").otherwise("X").alias("pos"), F.when(t.rlike(r"^\p{Lu}\p{Lu}"), "B").otherwise("O").alias("ner"))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.transform(toks, word).alias("words"))


_W = f"""w0 as (select doc_id, unnest({DUCK.find_all("coalesce(text, '')", TOKEN)}) as t, generate_subscripts({DUCK.find_all("coalesce(text, '')", TOKEN)}, 1) as pos from documents),
    w1 as (select *, lower(t) as low, case when regexp_matches(t, '^\\p{{Nd}}+$') then 'M' when length(t) % 7 = 3 then 'N' else 'X' end as tag, regexp_matches(t, '^\\p{{Lu}}\\p{{Lu}}') as named,
        lead(lower(t), 1, '') over (partition by doc_id order by pos) as nxt from w0),
    w2 as (select *, min(case when low not in {_in(LEX.particles)} then pos end) over (partition by doc_id order by pos rows between 1 following and unbounded following) as stop from w1),
    w3 as (select a.*, coalesce(b.t = '?', false) as at_end from w2 a left join w0 b on b.doc_id = a.doc_id and b.pos = a.stop),
    w4 as (select *, low in {_in(LEX.negation)} and not (low in {_in(LEX.asking)} and at_end) and not (low = 'no' and (tag = 'M' or nxt in ('one', 'la'))) and not (low = 'pas' and nxt = 'de') as neg from w3),
    w5 as (select *, case when regexp_matches(low, '^\\p{{P}}*$') then null when named then 'T1' when tag = 'M' or regexp_matches(low, '\\p{{Nd}}') then 'T1' when low in {_in(LEX.negation)} then case when neg then 'T1' end
        when (low = 'the' and tag = 'N') or (low = 'plus' and nxt <> 'de') or (low = 'si' and nxt in ('la', '?')) then null
        when low in {_in(LEX.tiers["T1"])} then 'T1' when low in {_in(LEX.tiers["T2"])} then 'T2' when low in {_in(LEX.tiers["T3"])} then 'T3' end as tier from w4)"""
_DOCS = "(select distinct doc_id from documents)"


def protected_words(spark, sf_dir):
    """Negations and tiers in context, per document."""
    own = _words(spark, sf_dir).select("doc_id", protection.tiers("words", LEX).alias("t"), protection.negations("words", LEX).alias("n"))
    count = lambda v: F.size(F.filter("t", lambda x: x == v)).cast("long")
    return own.select("doc_id", *[count(t).alias(f"n_{t.lower()}") for t in protection.TIERS], F.size(F.filter("n", lambda x: x)).cast("long").alias("n_negated"), F.exists("n", lambda x: x).alias("has_negation"))


_PROTECTED = f"""with {_W} select d.doc_id, count(*) filter (where tier = 'T1') as n_t1, count(*) filter (where tier = 'T2') as n_t2, count(*) filter (where tier = 'T3') as n_t3,
    count(*) filter (where neg) as n_negated, coalesce(bool_or(neg), false) as has_negation from {_DOCS} d left join w5 on w5.doc_id = d.doc_id group by d.doc_id"""


def force_lists(spark, sf_dir):
    """Distinct protected forms in their order, and the probe's text."""
    own = _words(spark, sf_dir).withColumn("t", protection.tiers("words", LEX))
    return own.select("doc_id", F.size(protection.force_tokens("words", "t")).cast("long").alias("n_forced"), F.md5(F.array_join(protection.force_tokens("words", "t"), "\x01")).alias("forced_md5"), F.md5(protection.probe("words", LEX)).alias("probe_md5"))


_FORCE = f"""with {_W}, f as (select doc_id, t, min(pos) as first from w5 where tier is not null group by doc_id, t),
    fa as (select doc_id, count(*) as n, md5(string_agg(t, chr(1) order by first)) as m from f group by doc_id),
    k as (select doc_id, pos, t, lag(t) over (partition by doc_id order by pos) as prev from w5 where not neg),
    r as (select doc_id, md5(string_agg(case when prev is null or t in (',', '.', ';', ':', '!', '?', ')', ']', '}}', '…', '%') or prev in ('(', '[', '{{') then t else ' ' || t end, '' order by pos)) as m from k group by doc_id)
    select d.doc_id, coalesce(fa.n, 0) as n_forced, coalesce(fa.m, md5('')) as forced_md5, coalesce(r.m, md5('')) as probe_md5 from {_DOCS} d left join fa on fa.doc_id = d.doc_id left join r on r.doc_id = d.doc_id"""

PAIRS = protection.Lexicon(negation=("not", "no", "in the"), tiers={"T1": ("if", "of the"), "T2": ("was",), "T3": ("more",)}, harmless={}, only_pos={}, not_pos={}, only_before={}, not_before={}, asking=("no",), particles=("the",))


def force_masks(spark, sf_dir):
    """Masks over syllables: of lexicon phrases wherever they stand, of single words, and a word mask spread over its syllables."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "").alias("s"))
    docs = docs.withColumn("words", F.transform("s", lambda w, i: F.struct(F.when(i % 5 == 0, F.concat(w, F.lit(" x"), i.cast("string"))).otherwise(w).alias("text"))))
    total = lambda m: F.size(F.filter(m, lambda x: x)).cast("long")
    spread = protection.expand("words", F.transform("words", lambda w: F.length(w["text"]) > 5))
    return docs.select("doc_id", total(protection.string_force_mask("s", lex=PAIRS)).alias("n_string"), total(protection.naive_mask("s", PAIRS)).alias("n_naive"), total(spread).alias("n_spread"), F.size(protection.syllables("words")).cast("long").alias("n_syllables"))


_MASKS = f"""with s as (select doc_id, unnest(l) as w, generate_subscripts(l, 1) as pos from (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') as l from documents)),
    n as (select *, lower(w) as low, lag(lower(w), 1, '') over (partition by doc_id order by pos) as p, lead(lower(w), 1, '') over (partition by doc_id order by pos) as q, regexp_matches(w, '\\p{{Nd}}') as digit,
      case when (pos - 1) % 5 = 0 then w || ' x' || (pos - 1) else w end as word from s)
    select d.doc_id, count(*) filter (where digit or low in ('not', 'no', 'if', 'was', 'more') or p || ' ' || low in ('in the', 'of the') or low || ' ' || q in ('in the', 'of the')) as n_string,
      count(*) filter (where digit or low in ('not', 'no', 'if', 'was', 'more')) as n_naive, cast(coalesce(sum(case when length(word) > 5 then 1 + case when (pos - 1) % 5 = 0 then 1 else 0 end else 0 end), 0) as bigint) as n_spread,
      cast(coalesce(sum(case when (pos - 1) % 5 = 0 then 2 when pos is not null then 1 end), 0) as bigint) as n_syllables from {_DOCS} d left join n on n.doc_id = d.doc_id group by d.doc_id"""


def normalize_tones(spark, sf_dir):
    """Tone marks moved in the open syllables that the adapter puts after every distinct word, marked late."""
    n = F.length("w") % 4
    late = F.concat("w", F.when(n == 0, "oà").when(n == 1, "oẹ").when(n == 2, "uý").otherwise("oàn"))
    words = read_table(spark, sf_dir, "documents").select(F.explode_outer(T.metric_tokens(F.col("text"))).alias("w")).filter("w is not null").distinct()
    return words.select("w", T.normalize(late).alias("normal"))


_TONES = f"""with w as (select distinct unnest({DUCK.find_all("lower(text)", METRIC)}) as w from documents)
    select w, w || case length(w) % 4 when 3 then 'oàn' when 0 then case when w like '%q' then 'oà' else 'òa' end when 1 then case when w like '%q' then 'oẹ' else 'ọe' end else case when w like '%q' then 'uý' else 'úy' end end as normal from w"""

# -- compressors


def _kept(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "budget", "n_kept", "used", "positions")


def _method(spec):
    return lambda spark, sf_dir: _kept(compress.compress(read_table(spark, sf_dir, "documents"), spec, RATIO))


def compress_trimmed(spark, sf_dir):
    """Leading words, trimmed to a length that is three tokens more than its words."""
    return _kept(compress.compress(read_table(spark, sf_dir, "documents"), "lead", RATIO, length=lambda texts: [3 + sum(compress.quarters(t.split())) for t in texts]))


_SENT = DUCK.replace("coalesce(text, '')", r"([.!?])\s+", "#1\x01")
_S = f"""s as (select doc_id, unnest(l) as body, generate_subscripts(l, 1) as sent from (select doc_id, string_split_regex({_SENT}, chr(1)) as l from documents)),
    u0 as (select doc_id, sent, unnest(l) as val, generate_subscripts(l, 1) as p from (select doc_id, sent, {DUCK.find_all("body", r"([^\s\x0b\x1c-\x1f\x85\p{Z}]+)")} as l from s)),
    u as (select *, row_number() over (partition by doc_id order by sent, p) - 1 as pos, greatest(1, cast(ceil(length(val) / 4e0) as bigint)) as cost from u0),
    b as (select doc_id, cast(round_even(0.333e0 * sum(cost), 0) as bigint) as budget from u group by doc_id)"""
_PICK = """c as (select u.doc_id, u.sent, sum(u.cost) + 1 as cost, round(coalesce(max(sc.score), 0), 9) as score from u left join sc on sc.doc_id = u.doc_id and sc.sent = u.sent group by u.doc_id, u.sent),
    o as (select c.doc_id, list({'used': cast(0 as bigint), 'kept': cast([] as bigint[]), 'sent': cast(c.sent as bigint), 'cost': cast(c.cost as bigint), 'budget': b.budget} order by c.score desc, c.sent) as l from c join b on b.doc_id = c.doc_id group by c.doc_id),
    f as (select doc_id, list_reduce(list_prepend({'used': cast(0 as bigint), 'kept': cast([] as bigint[]), 'sent': cast(0 as bigint), 'cost': cast(0 as bigint), 'budget': l[1].budget}, l), lambda a, x: case when a.used + x.cost <= x.budget then {'used': a.used + x.cost, 'kept': list_append(a.kept, x.sent), 'sent': x.sent, 'cost': x.cost, 'budget': x.budget} else a end).kept as kept from o),
    p as (select c.doc_id, arg_max(c.sent, (c.score, -c.sent)) as part from c join f on f.doc_id = c.doc_id where not list_contains(f.kept, c.sent) group by c.doc_id),
    r as (select u.doc_id, u.pos, u.cost, b.budget, sum(u.cost) over (partition by u.doc_id order by case when list_contains(f.kept, u.sent) then 0 when u.sent = p.part then 1 else 2 end, u.pos rows unbounded preceding) as run
      from u join b on b.doc_id = u.doc_id join f on f.doc_id = u.doc_id left join p on p.doc_id = u.doc_id)"""
_KEPT = f"select d.doc_id, coalesce(max(budget), 0) as budget, count(*) filter (where run <= budget) as n_kept, cast(coalesce(sum(cost) filter (where run <= budget), 0) as bigint) as used, cast(coalesce(sum(pos) filter (where run <= budget), 0) as bigint) as positions from {_DOCS} d left join r on r.doc_id = d.doc_id group by d.doc_id"
_TFIDF = f"""t as (select doc_id, sent, unnest({DUCK.find_all("lower(body)", METRIC)}) as term from s), tf as (select doc_id, sent, term, count(*) as tf from t group by all), df as (select doc_id, term, count(*) as df from tf group by all),
    n as (select doc_id, count(distinct sent) as n from t group by doc_id), bag as (select doc_id, sent, count(*) as bag from t group by all),
    sc as (select tf.doc_id, tf.sent, sum(tf * ln((1e0 + n) / (1e0 + df))) / max(bag) as score from tf join df using (doc_id, term) join n using (doc_id) join bag using (doc_id, sent) group by tf.doc_id, tf.sent)"""
_PPL = f"""k as (select doc_id, sent, unnest({DUCK.find_all("lower(val)", TOKEN)}) as term from u), g as (select doc_id, term, count(*) as c, sum(count(*)) over (partition by doc_id) as total from k group by doc_id, term),
    sc as (select k.doc_id, k.sent, avg(ln(total / c)) as score from k join g using (doc_id, term) group by k.doc_id, k.sent)"""
#: A selection by unit scores: greedy to the first overflow, then each that fits.
_FOLD = f"""r as (select *, sum(cost) over (partition by doc_id order by score desc, pos rows unbounded preceding) as run from x),
    one as (select doc_id, max(budget) as budget, count(*) filter (where run <= budget) as n, coalesce(sum(cost) filter (where run <= budget), 0) as used, coalesce(sum(pos) filter (where run <= budget), 0) as positions,
      list({{'used': cast(0 as bigint), 'n': cast(0 as bigint), 'positions': cast(0 as bigint), 'cost': cast(cost as bigint), 'pos': cast(pos as bigint), 'budget': cast(budget as bigint)}} order by score desc, pos) filter (where run > budget) as rest from r group by doc_id),
    two as (select doc_id, budget, list_reduce(list_prepend({{'used': cast(used as bigint), 'n': cast(n as bigint), 'positions': cast(positions as bigint), 'cost': cast(0 as bigint), 'pos': cast(0 as bigint), 'budget': cast(budget as bigint)}}, coalesce(rest, [])),
      lambda a, y: case when a.used + y.cost <= a.budget then {{'used': a.used + y.cost, 'n': a.n + 1, 'positions': a.positions + y.pos, 'cost': a.cost, 'pos': a.pos, 'budget': a.budget}} else a end) as f from one)
    select d.doc_id, coalesce(budget, 0) as budget, coalesce(f.n, 0) as n_kept, coalesce(f.used, 0) as used, coalesce(f.positions, 0) as positions from {_DOCS} d left join two on two.doc_id = d.doc_id"""
_SELECTIVE = f"""with {_S}, k as (select doc_id, pos, unnest({DUCK.find_all("lower(val)", TOKEN)}) as term from u), g as (select doc_id, term, count(*) as c, sum(count(*)) over (partition by doc_id) as total from k group by doc_id, term),
    i as (select k.doc_id, k.pos, sum(ln(total / c)) as score from k join g using (doc_id, term) group by k.doc_id, k.pos),
    x as (select u.doc_id, u.pos, u.cost, b.budget, round(coalesce(i.score, 0), 9) as score from u join b using (doc_id) left join i on i.doc_id = u.doc_id and i.pos = u.pos), {_FOLD}"""


def sentence_scores(spark, sf_dir):
    own = compress.sentence_scores(read_table(spark, sf_dir, "documents"))
    return own.select("doc_id", "sent", F.round("score", 5).alias("score"))


def _labelled_words(spark, sf_dir) -> DataFrame:
    """Words of the labelled documents that are not held out, each kept where its document is a good one."""
    dev = jsonl.hash_sample(read_table(spark, sf_dir, "labels").select("doc_id").distinct(), 20, "doc_id", 3)
    docs = read_table(spark, sf_dir, "documents").join(read_table(spark, sf_dir, "labels"), "doc_id").join(dev, "doc_id", "left_anti")
    return docs.select(F.explode_outer(F.split("text", r"\s+")).alias("word"), F.col("quality").alias("kept")).filter("word <> ''")


def lexprior_rates(spark, sf_dir):
    return compress.fit_lexprior(_labelled_words(spark, sf_dir)).select("word", "seen", "kept", F.round("rate", 9).alias("rate"))


_RATES = """dev as (select doc_id from (select distinct doc_id from labels) order by md5('3:' || doc_id), doc_id limit 20),
    lw as (select lower(unnest(string_split_regex(text, '\\s+'))) as word, quality as kept from documents join labels using (doc_id) where doc_id not in (select doc_id from dev)),
    lw1 as (select * from lw where word <> ''), base as (select sum(kept) * 1e0 / count(*) as base from lw1),
    rates as (select word, count(*) as seen, cast(sum(kept) as bigint) as kept, (sum(kept) + max(base)) / (count(*) + 1) as rate from lw1, base group by word union all select '', 0, 0, base from base)"""


def compress_lexprior(spark, sf_dir):
    return _kept(compress.lexprior(read_table(spark, sf_dir, "documents"), lexprior_rates(spark, sf_dir), RATIO))


_LEXPRIOR = f"""with {_S}, {_RATES}, x as (select u.doc_id, u.pos, u.cost, b.budget, round(least(greatest(round(coalesce(rates.rate, (select base from base)), 9), 1e-4), 1 - 1e-4), 12) as score from u join b using (doc_id) left join rates on rates.word = lower(u.val)), {_FOLD}"""


def compress_precomputed(spark, sf_dir):
    """What another system made (the text in another spelling, without its first word), trimmed to the budget."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = docs.select("doc_id", F.lit(0.333).alias("ratio"), F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("e"), F.lit("EE")), r"^\s*\S+\s*", "").alias("compressed"))
    return compress.precomputed(docs, done, RATIO, trim=True).select("doc_id", "budget", "used", F.md5("text").alias("text_md5"))


_PRE = f"""with d as (select doc_id, coalesce(text, '') as text, regexp_replace(replace(coalesce(text, ''), 'e', 'EE'), '^\\s*\\S+\\s*', '') as made from documents),
    o as (select doc_id, unnest(l) as val from (select doc_id, {DUCK.find_all("text", r"(\S+)")} as l from d)), b as (select doc_id, cast(round_even(0.333e0 * sum(ceil(length(val) / 4e0)), 0) as bigint) as budget from o group by doc_id),
    m as (select doc_id, unnest(l) as val, generate_subscripts(l, 1) as pos from (select doc_id, {DUCK.find_all("made", r"(\S+)")} as l from d)),
    r as (select m.*, cast(ceil(length(val) / 4e0) as bigint) as cost, budget, sum(ceil(length(val) / 4e0)) over (partition by m.doc_id order by pos rows unbounded preceding) as run from m join b using (doc_id))
    select d.doc_id, coalesce(max(b.budget), 0) as budget, cast(coalesce(sum(cost) filter (where run <= r.budget), 0) as bigint) as used, md5(coalesce(string_agg(val, ' ' order by pos) filter (where run <= r.budget), '')) as text_md5
    from d left join b using (doc_id) left join r using (doc_id) group by d.doc_id"""


def compress_translated(spark, sf_dir):
    """The parallel text is another turn of the same length class: here the text backwards by words."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.array_join(F.reverse(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")), " ").alias("text_en"))
    return _kept(compress.translated(docs, "lead", RATIO))


_TRANSLATED = f"""with x0 as {_units(DUCK)}, r as (select doc_id, n - 1 - pos as pos, cost, budget, sum(cost) over (partition by doc_id order by pos desc rows unbounded preceding) as run from x0 y) {_KEPT}"""

# -- measures of whole texts, a row a document


def token_and_punct_profile(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    size = lambda a: F.size(a).cast("long")
    return d.select("doc_id", size("t").alias("n_tokens"), size(F.filter("t", T.is_punct)).alias("n_punct"), size(F.filter("t", lambda x: x.rlike(r"^\p{Nd}+$"))).alias("n_numbers"), size(F.array_distinct("t")).alias("n_types"), F.coalesce(F.array_max(F.transform("t", F.length)), F.lit(0)).cast("long").alias("longest"))


_PROFILE = f"""with t as (select doc_id, unnest({DUCK.find_all("lower(coalesce(text, ''))", TOKEN)}) as v from documents)
    select d.doc_id, count(v) as n_tokens, count(*) filter (where regexp_matches(v, '^\\p{{P}}+$')) as n_punct, count(*) filter (where regexp_matches(v, '^\\p{{Nd}}+$')) as n_numbers, count(distinct v) as n_types, coalesce(max(length(v)), 0) as longest
    from {_DOCS} d left join t on t.doc_id = d.doc_id group by d.doc_id"""


def budget_and_adherence(spark, sf_dir):
    """What the leading words use of the budget, and whether that is too far from it."""
    own = compress.compress(read_table(spark, sf_dir, "documents"), "lead", RATIO)
    ratio = F.expr("try_divide(used, nullif(budget, 0))")
    return own.select("doc_id", "budget", "used", F.round(ratio, 6).alias("tokens_per_budget"), gates.deviates(ratio).alias("deviates"))


_BUDGET = f"""with r as (select *, sum(cost) over (partition by doc_id order by pos rows unbounded preceding) as run from {_units(DUCK)} u), k as ({_KEPT})
    select doc_id, budget, used, case when budget > 0 then round(used * 1e0 / budget, 6) end as tokens_per_budget, coalesce(abs(case when budget > 0 then used * 1e0 / budget end - 1) > 0.05 + 1e-12, false) as deviates from k"""


def negation_probe(spark, sf_dir):
    """Negating words by the built-in list, unless a question ends right after."""
    low = T.tokens(F.coalesce("text", F.lit("")))
    d = read_table(spark, sf_dir, "documents").select("doc_id", low.alias("t")).withColumn("z", F.arrays_zip(F.col("t").alias("w"), F.slice("t", F.lit(2), F.greatest(F.size("t"), F.lit(1))).alias("n")))
    hit = F.filter("z", lambda x: x["w"].isin(*compress.NEGATION) & (F.coalesce(x["n"], F.lit("")) != "?"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_words"), F.size(hit).cast("long").alias("n_negated"), (F.size(hit) > 0).alias("has_negation"))


_NEGATION = f"""with t as (select doc_id, unnest(l) as v, generate_subscripts(l, 1) as pos from (select doc_id, {DUCK.find_all("lower(coalesce(text, ''))", TOKEN)} as l from documents)),
    n as (select doc_id, v, lead(v) over (partition by doc_id order by pos) as nxt from t)
    select d.doc_id, count(v) as n_words, count(*) filter (where v in {_in(sorted(compress.NEGATION))} and coalesce(nxt, '') <> '?') as n_negated, coalesce(bool_or(v in {_in(sorted(compress.NEGATION))} and coalesce(nxt, '') <> '?'), false) as has_negation
    from {_DOCS} d left join n on n.doc_id = d.doc_id group by d.doc_id"""


def unique_text_fanout(spark, sf_dir):
    """Work is done once a distinct text and joined back to every row; a null text has none."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    work = lambda once: once.select("h", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))
    return incremental.fan_out(docs, "text", work).select("doc_id", "n_tokens")


_FANOUT = f"select doc_id, case when text is not null then len({DUCK.find_all('lower(text)', TOKEN)}) end as n_tokens from documents"

# -- statistics over orders: the rows of stat_plans._cells


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8), 16, 10).cast("bigint") % 3
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("cluster"), seed.alias("seed"), (F.col("o_orderstatus") == "F").cast("double").alias("a"), (F.col("o_totalprice") > 150000).cast("double").alias("b"))


def paired_cluster_bootstrap(spark, sf_dir):
    own = stats.paired_test(cells(spark, sf_dir), "a", "b", "cluster")
    return own.select(F.round("diff", 6).alias("diff"), "n_rows", "n_clusters", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("p_value", 6).alias("p_value"))


def crossed_seed_cluster_bootstrap(spark, sf_dir):
    own = stats.paired_test(cells(spark, sf_dir), "a", "b", "cluster", "seed")
    return own.select("n_replicates", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("p_value", 6).alias("p_value"))


def non_inferiority(spark, sf_dir):
    return stats.non_inferiority(cells(spark, sf_dir), "a", "b", "cluster", 0.02).select(F.round("lower", 6).alias("lower"), "passes")


def mde_projected(spark, sf_dir):
    own = stats.minimum_detectable_effect(cells(spark, sf_dir), "a", "b", "cluster", 4 * F.col("n_clusters"))
    return own.select(F.round("mde_dev", 6).alias("mde_dev"), F.round("mde_test", 6).alias("mde_test"))


def clustered_slope(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem").join(read_table(spark, sf_dir, "orders"), F.expr("o_orderkey = l_orderkey")).withColumn("cluster", F.expr("o_custkey % 40"))
    return stats.clustered_slope(lines, "l_quantity", "l_extendedprice", "cluster").select(*[F.round(c, 3).alias(c) for c in ("slope", "low", "high")])


def flip_rate_test(spark, sf_dir):
    """Orders whose value is high flip under a, those that are open under b."""
    own = cells(spark, sf_dir).select("id", "cluster", "seed", (F.col("b") == 1).alias("fa"), (F.col("a") == 0).alias("fb"))
    return stats.flip_rate_test(own, "fa", "fb", "cluster").select(F.round("diff", 6).alias("diff"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("p_value", 6).alias("p_value"), "n_rows", "n_clusters")


_DRAW = lambda seed, n, k: f"cast(concat('0x', substr(md5(concat('{seed}|', cast(r.range as varchar), '|', cast({k} as varchar))), 1, 8)) as bigint) % {n}"
_FLIP = f"""with cl as (select cluster, sum(b - (1 - a)) as s, count(*) as c, row_number() over (order by cluster) - 1 as place, count(*) over () as n from {_cells_sql(DUCK)} x group by cluster),
    rep as (select r.range as b, sum(k.s) / sum(k.c) as m from range(10000) r cross join cl j join cl k on k.place = {_DRAW("1", "j.n", "j.place")} group by r.range)
    select (select round(sum(s) / sum(c), 6) from cl) as diff, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high, round(avg(case when m >= 0 then 1e0 else 0e0 end), 6) as p_value, (select cast(sum(c) as bigint) from cl) as n_rows, (select count(*) from cl) as n_clusters from rep"""


def mde_cells(spark, sf_dir):
    """Effect cells by order priority: is the margin above the detectable effect and the seeds' deviation?"""
    own = cells(spark, sf_dir).join(read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("cell")), "id")
    sd = stats.seed_deviation(own.withColumn("d", F.col("a") - F.col("b")), "d", ["cell"], "seed").select("cell", "seed_sd")
    got = stats.effect_cells(own.join(sd, "cell"), ["cell"], "a", "b", "cluster", "seed_sd", 0.05, n_boot=500)
    return got.select("cell", F.round("mde", 6).alias("mde"), F.round("seed_sd", 6).alias("seed_sd"), "passes")


_MDE = f"""with x as (select c.*, o.o_orderpriority as cell from {_cells_sql(DUCK)} c join orders o on o.o_orderkey = c.id),
    cl as (select cell, cluster, sum(a - b) as s, count(*) as c, row_number() over (partition by cell order by cluster) - 1 as place, count(*) over (partition by cell) as n from x group by cell, cluster),
    rep as (select j.cell, r.range as b, sum(k.s) / sum(k.c) as m from range(500) r cross join cl j join cl k on k.cell = j.cell and k.place = {_DRAW("mde", "j.n", "j.place")} group by j.cell, r.range),
    m as (select cell, 2.487e0 * stddev_pop(m) as mde from rep group by cell), sd as (select cell, stddev_samp(v) as sd from (select cell, seed, avg(a - b) as v from x group by cell, seed) y group by cell)
    select m.cell, round(mde, 6) as mde, round(sd, 6) as seed_sd, 0.05 > mde and 0.05 > sd as passes from m join sd on sd.cell = m.cell"""


def factorial_test(spark, sf_dir):
    """The interaction of two factors, tested against 0 over customers."""
    own = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 2).alias("unit"), (F.col("o_orderstatus") == "F").cast("int").alias("label"), (F.col("o_totalprice") / 1000).alias("score"))
    w = stats.factorial_contrasts(own, "id", "unit", "label", "score").withColumns({"zero": F.lit(0.0), "cluster": F.col("id") % 20})
    return stats.paired_test(w, "interaction", "zero", "cluster", n_boot=1000).select(F.round("diff", 5).alias("diff"), "n_rows", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"), F.round("p_value", 6).alias("p_value"))


_FACTORIAL = f"""with c as (select o_custkey as id, o_orderkey % 2 as unit, o_orderstatus = 'F' as label, avg(o_totalprice / 1000) as s from orders group by all),
    w as (select id, sum(case when (unit = 1) = label then s else -s end) as i from c group by id having count(*) = 4),
    cl as (select id % 20 as cluster, sum(i) as s, count(*) as c, row_number() over (order by id % 20) - 1 as place, count(*) over () as n from w group by id % 20),
    rep as (select r.range as b, sum(k.s) / sum(k.c) as m from range(1000) r cross join cl j join cl k on k.place = {_DRAW("1", "j.n", "j.place")} group by r.range)
    select (select round(sum(s) / sum(c), 5) from cl) as diff, (select cast(sum(c) as bigint) from cl) as n_rows, round(quantile_cont(m, 0.025), 5) as low, round(quantile_cont(m, 0.975), 5) as high, round(avg(case when m <= 0 then 1e0 else 0e0 end), 6) as p_value from rep"""


def holm_by_family(spark, sf_dir):
    """Step-down p-values within each event type as a family, over users' shares."""
    own = read_table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 7).alias("arm")).agg(F.avg((F.col("value") > 50).cast("double")).alias("p"))
    got = stats.holm(own.withColumn("p", F.col("p") * 0.08).withColumn("member", F.col("arm") < 5), "p", "member", ["event_type"])
    return got.select("event_type", F.col("arm").cast("long").alias("arm"), F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"))


_HOLM = """with c as (select event_type, user_id % 7 as arm, avg(case when value > 50 then 1e0 when value is not null then 0e0 end) * 0.08 as p from events group by all),
    m as (select a.event_type, a.arm, max(least(1e0, (5 - (select count(*) from c x where x.event_type = a.event_type and x.arm < 5 and (x.p, x.arm) < (b.p, b.arm))) * b.p)) as adjusted
      from c a join c b on b.event_type = a.event_type and b.arm < 5 and (b.p, b.arm) <= (a.p, a.arm) where a.arm < 5 group by a.event_type, a.arm)
    select c.event_type, c.arm, round(c.p, 6) as p, round(m.adjusted, 6) as adjusted from c left join m on m.event_type = c.event_type and m.arm = c.arm"""

QUERIES = {
    "protected_words": protected_words, "force_lists": force_lists, "force_masks": force_masks, "normalize_tones": normalize_tones,
    "compress_tfidf_sentences": _method("tfidf_sent"), "compress_ppl_sentences": _method("ppl_sent"), "compress_selective_context": _method("selective_context"), "tfidf_sentence_scores": sentence_scores,
    "lexprior_fit": lexprior_rates, "compress_lexprior": compress_lexprior, "compress_precomputed": compress_precomputed, "compress_translated": compress_translated,
    "compress_trimmed": compress_trimmed, "compress_lead": _method("lead"), "compress_truncation": _method("truncation"),
    "token_and_punct_profile": token_and_punct_profile, "budget_and_adherence": budget_and_adherence, "negation_probe": negation_probe, "unique_text_fanout": unique_text_fanout,
    "paired_cluster_bootstrap": paired_cluster_bootstrap, "crossed_seed_cluster_bootstrap": crossed_seed_cluster_bootstrap, "non_inferiority": non_inferiority, "mde_projected": mde_projected, "clustered_slope": clustered_slope,
    "flip_rate_test": flip_rate_test, "mde_cells": mde_cells, "factorial_test": factorial_test, "holm_by_family": holm_by_family,
}
#: Where a name is one of stat_plans or text_plans, its SQL there is the oracle of the query here.
ORACLE_SQL = {
    "protected_words": _PROTECTED, "force_lists": _FORCE, "force_masks": _MASKS, "normalize_tones": _TONES,
    "compress_tfidf_sentences": f"with {_S}, {_TFIDF}, {_PICK} {_KEPT}", "compress_ppl_sentences": f"with {_S}, {_PPL}, {_PICK} {_KEPT}", "compress_selective_context": _SELECTIVE,
    "lexprior_fit": f"with {_RATES} select word, seen, kept, round(rate, 9) as rate from rates", "compress_lexprior": f"{_LEXPRIOR}", "compress_precomputed": _PRE, "compress_translated": _TRANSLATED,
    "compress_trimmed": f"with r as (select *, sum(cost) over (partition by doc_id order by pos rows unbounded preceding) + case when budget >= 3 then 3 else 10000000 end as run from {_units(DUCK)} u) {_KEPT}",
    "compress_lead": f"with r as (select *, sum(cost) over (partition by doc_id order by pos rows unbounded preceding) as run from {_units(DUCK)} u) {_KEPT}",
    "compress_truncation": f"with r as (select *, sum(cost) over (partition by doc_id order by least(pos, n - 1 - pos), pos rows unbounded preceding) as run from {_units(DUCK)} u) {_KEPT}",
    "token_and_punct_profile": _PROFILE, "budget_and_adherence": _BUDGET, "negation_probe": _NEGATION, "unique_text_fanout": _FANOUT,
    "flip_rate_test": _FLIP, "mde_cells": _MDE, "factorial_test": _FACTORIAL, "holm_by_family": _HOLM,
}
