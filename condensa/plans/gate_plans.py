"""Queries of the gates, guards and diagnoses on rows drawn from the tables, with SQL written by hand for each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condensa.operators import diagnose, gates
from condensa.sources.tables import read_table


METHODS = ("none", "truncation", "teacher", "word_s0", "syllable_s0", "tfidf_sent", "probe_negation")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows: every order under every method, with scores and answers drawn by hash."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("t"), (F.col("o_custkey") % 4).cast("string")).alias("task"), (F.col("o_custkey") % 40).alias("cluster"), F.when(F.col("o_orderkey") % 2 == 0, 0.2).otherwise(0.333).alias("ratio"), F.explode(F.array(*map(F.lit, METHODS))).alias("method"))
    h = F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit("|"), F.col("method"))), 1, 8), 16, 10).cast("bigint") % 1000
    n = 100 + F.col("id") % 50
    own = o.withColumns({"h": h, "n_tokens_original": n, "reader": F.lit("r")}).withColumn("budget", F.bround(F.col("ratio") * F.col("n_tokens_original"), 0).cast("bigint"))
    return own.withColumns({"score": F.col("h") / 1000.0, "prediction": F.when(F.col("h") < 20, "").when(F.col("h") % 3 == 0, "x").otherwise("y"), "n_tokens_compressed": F.col("budget") - F.col("h") % 7 + F.col("h") % 2 * 10, "seed": F.col("h") % 3})


_R = f"""r0 as (select o_orderkey as id, 't' || (o_custkey % 4) as task, o_custkey % 40 as cluster, case when o_orderkey % 2 = 0 then 0.2e0 else 0.333e0 end as ratio, m.method, 100 + o_orderkey % 50 as n from orders cross join (select unnest({list(METHODS)}) as method) m),
    r1 as (select *, cast('0x' || substr(md5(id || '|' || method), 1, 8) as bigint) % 1000 as h, cast(round_even(ratio * n, 0) as bigint) as budget from r0),
    r as (select *, h / 1000e0 as score, case when h < 20 then '' when h % 3 = 0 then 'x' else 'y' end as prediction, budget - h % 7 + h % 2 * 10 as c from r1)"""


def budget_adherence_cells(spark, sf_dir):
    own = gates.adherence(results(spark, sf_dir), ["task", "method"])
    fam = own.withColumn("family", diagnose.family(F.col("method"))).withColumn("place", diagnose.family_order(F.col("family")).cast("long"))
    return fam.select("task", "method", "family", "place", *[F.round(c, 6).alias(c) for c in ("tokens_per_budget", "share_deviating", "empty_share")], "empty_flag")


_ADHERENCE = f"""with {_R}, g as (select task, method, round(avg(c * 1e0 / budget), 6) as tokens_per_budget, round(avg(case when abs(c * 1e0 / budget - 1) > 0.05 + 1e-12 then 1e0 else 0e0 end), 6) as share_deviating, avg(case when prediction = '' then 1e0 else 0e0 end) as e from r group by task, method)
    select task, method, f.family, cast(f.place as bigint) as place, tokens_per_budget, share_deviating, round(e, 6) as empty_share, e > 0.02 as empty_flag from g
    join (values ('none', 'other', 5), ('truncation', 'deterministic', 4), ('teacher', 'other', 5), ('word_s0', 'other', 5), ('syllable_s0', 'other', 5), ('tfidf_sent', 'deterministic', 4), ('probe_negation', 'deterministic', 4)) f(m, family, place) on f.m = g.method"""


def paired_budget_gaps(spark, sf_dir):
    own = gates.pair_gaps(results(spark, sf_dir), [("word_s0", "syllable_s0"), ("teacher", "truncation")], ["task"], 0.001)
    return own.select("a", "b", "task", F.round("ratio_a", 6).alias("ratio_a"), F.round("ratio_b", 6).alias("ratio_b"), "too_far")


_GAPS = f"""with {_R}, m as (select task, method, avg(c * 1e0 / budget) as x from r group by task, method)
    select p.a, p.b, x.task, round(x.x, 6) as ratio_a, round(y.x, 6) as ratio_b, abs(x.x - y.x) > 0.001 as too_far from (values ('word_s0', 'syllable_s0'), ('teacher', 'truncation')) p(a, b) join m x on x.method = p.a join m y on y.method = p.b and y.task = x.task"""


def best_of_classes(spark, sf_dir):
    own = gates.best_of_classes(results(spark, sf_dir), ["word_s0", "syllable_s0", "teacher"], ["tfidf_sent", "truncation"], 0.2, 0.002)
    return own.withColumn("gap", F.round("gap", 9))


_BEST = f"""with {_R}, m as (select task, method, avg(score) as x from r where ratio = 0.2e0 group by task, method),
    t as (select *, row_number() over (partition by task order by x desc, method desc) as k from m where method in ('word_s0', 'syllable_s0', 'teacher')), s as (select *, row_number() over (partition by task order by x desc, method desc) as k from m where method in ('tfidf_sent', 'truncation')),
    j as (select t.task, t.method as token, s.method as sentence, t.x - s.x as gap, t.x - s.x >= -0.002 as near from t join s on s.task = t.task and s.k = 1 where t.k = 1)
    select task, token, sentence, round(gap, 9) as gap, near, (select count(*) filter (where near) * 2 > count(*) from j) as passed from j"""


def one_row_gates(spark, sf_dir):
    """Gates that end in a count or a share, a row each."""
    rows = results(spark, sf_dir)
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("cluster"), F.col("text").rlike(r"(?i)\b(not|nicht|pas|nunca)\b").alias("negated"))
    cells = rows.groupBy("task", "method").agg(F.avg((F.col("h") % 17 == 0).cast("double")).alias("cbr"), F.count(F.lit(1)).alias("n"))
    ranks = rows.groupBy(F.col("task").alias("name")).agg(F.corr("h", "n_tokens_original").alias("spearman"))
    sheet = read_table(spark, sf_dir, "labels").select((F.col("quality") == 0).alias("edited"), (F.col("toxic") == 1).alias("gold"))
    audits = rows.filter("method = 'none'").select((F.col("h") > 2).alias("passed"))
    row = lambda name, df, value: df.select(F.lit(name).alias("gate"), F.round(F.expr(value).cast("double"), 6).alias("value"), "passed")
    parts = [
        row("word beats syllable", gates.better_somewhere(rows, "word_s0", "syllable_s0"), "wins"),
        row("teacher beats truncation", gates.teacher_gate(rows, "teacher", "truncation", 0.333), "wins"),
        row("probe flips", gates.probe_flips(rows, "t1"), "flips"),
        row("probe changed", gates.probe_flips(rows, "t1"), "n_changed"),
        row("negated pairs", gates.negated_pairs(docs.filter("id % 3 = 0"), docs), "negated_pairs"),
        row("pooled broken words", gates.pooled_cbr(cells), "cbr"),
        row("cost and length", gates.rank_gate(ranks), "below"),
        row("probe audit precision", gates.probe_audit(sheet), "precision_"),
        row("probe audit recall", gates.probe_audit(sheet), "recall"),
        gates.choose_arm(audits, "scored", "package").select(F.concat(F.lit("arm "), F.col("method")).alias("gate"), F.lit(0.0).alias("value"), F.col("audited").alias("passed")),
    ]
    return reduce(DataFrame.unionByName, parts)


_D = lambda a, b, where="true": f"(select task, ratio, avg(x.score - y.score) as d from r x join r y using (task, ratio, id) where x.method = '{a}' and y.method = '{b}' and {where} group by task, ratio)"
_ONE = f"""with {_R}, f as (select p.c < p.n as changed, p.prediction is distinct from b.prediction as flip from r p left join r b on b.id = p.id and b.method = 'none' where p.method = 'probe_negation' and p.task = 't1'),
    d as (select doc_id as id, source as cluster, regexp_matches(text, '(?i)\\b(not|nicht|pas|nunca)\\b') as neg from documents), np as (select count(*) as v from d where cluster in (select cluster from d where neg and id % 3 = 0)),
    cb as (select sum(x * n) / sum(n) as v from (select avg(case when h % 17 = 0 then 1e0 else 0e0 end) as x, count(*) as n from r group by task, method) q), rk as (select count(*) as v from (select corr(h, n) as s from r group by task) q where s < 0.9),
    au as (select count(*) filter (where quality = 0 and toxic = 1) as tp, count(*) filter (where quality = 0 and toxic = 0) as fp, count(*) filter (where quality <> 0 and toxic = 1) as fn, count(*) filter (where quality <> 0) as un from labels),
    ap as (select tp * 1e0 / (tp + fp) as p, case when un > 0 then tp * 1e0 / (tp + fn) end as rc, tp + fp as k from au)
    select 'word beats syllable' as gate, cast(count(*) filter (where d > 0) as double) as value, count(*) filter (where d > 0) >= 1 as passed from {_D("word_s0", "syllable_s0")} q
    union all select 'teacher beats truncation', count(*) filter (where d > 0), count(*) filter (where d > 0) >= 2 from {_D("teacher", "truncation", "ratio = 0.333e0")} q
    union all select 'probe flips', round(avg(case when flip then 1e0 else 0e0 end), 6), coalesce(avg(case when flip then 1e0 else 0e0 end) >= 0.05, false) from f where changed
    union all select 'probe changed', count(*), coalesce(avg(case when flip then 1e0 else 0e0 end) >= 0.05, false) from f where changed
    union all select 'negated pairs', v, v >= 300 from np union all select 'pooled broken words', round(v, 6), v >= 0.05 from cb union all select 'cost and length', v, v >= 2 from rk
    union all select 'probe audit precision', round(p, 6), p >= 0.95 and k >= 50 from ap union all select 'probe audit recall', round(rc, 6), p >= 0.95 and k >= 50 from ap
    union all select case when bool_and(h > 2) then 'arm scored' else 'arm package' end, 0, true from r where method = 'none'"""


def precheck(spark, sf_dir):
    own = gates.precheck(results(spark, sf_dir), most=0.019)
    return own.select("task", "method", F.round("mean", 6).alias("mean"), F.round("blank_share", 6).alias("blank_share"), "failed")


_PRECHECK = f"""with {_R} select task, method, round(avg(score), 6) as mean, round(avg(case when prediction = '' then 1e0 else 0e0 end), 6) as blank_share, (method = 'none' and avg(score) = 0) or avg(case when prediction = '' then 1e0 else 0e0 end) > 0.019 as failed from r group by task, method"""


def detector_by_tier(spark, sf_dir):
    tier = lambda c: F.when(F.col(c) % 4 < 3, F.concat(F.lit("T"), (F.col(c) % 4 + 1).cast("string")))
    own = gates.detector_by_tier(read_table(spark, sf_dir, "orders").select(tier("o_custkey").alias("gold"), tier("o_orderkey").alias("predicted")))
    return own.select("tier", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision_", "recall", "f1")])


_TIER = """with w as (select o_custkey % 4 + 1 as g, o_orderkey % 4 + 1 as p from orders), c as (select t.i, count(*) filter (where g = i and p = i) as tp, count(*) filter (where g <> i and p = i) as fp, count(*) filter (where g = i and p <> i) as fn from w cross join (values (1), (2), (3)) t(i) group by t.i)
    select 'T' || i as tier, tp, fp, fn, case when tp + fp > 0 then round(tp * 1e0 / (tp + fp), 6) else 0e0 end as precision_, case when tp + fn > 0 then round(tp * 1e0 / (tp + fn), 6) else 0e0 end as recall, case when 2 * tp + fp + fn > 0 then round(2e0 * tp / (2 * tp + fp + fn), 6) else 0e0 end as f1 from c"""


def _masked(spark, sf_dir) -> DataFrame:
    """Words of two syllables (and a last one of one) over the letters' runs of documents, masks by hash and by length."""
    s = F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}]+", " "), " "), lambda x: x != "")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", s.alias("s"))
    pair = lambda i: F.struct(F.array_join(F.slice(F.col("s"), i * 2 - 1, F.lit(2)), " ").alias("text"), F.lit("N").alias("pos"), F.lit("O").alias("ner"))
    words = F.when(F.size("s") > 0, F.transform(F.sequence(F.lit(1), F.ceil(F.size("s") / 2).cast("int")), pair)).otherwise(F.array().cast("array<struct<text:string,pos:string,ner:string>>"))
    return docs.withColumns({"words": words, "a": F.transform("s", lambda x, i: (F.length(x) + i) % 3 != 0), "b": F.transform("s", lambda x: F.length(x) % 3 != 0)})


_MASKED = """s as (select doc_id, lang, unnest(l) as t, generate_subscripts(l, 1) - 1 as i from (select doc_id, lang, regexp_extract_all(coalesce(text, ''), '(\\p{L}+)', 1) as l from documents)),
    m as (select *, (length(t) + i) % 3 <> 0 as a, length(t) % 3 <> 0 as b, i // 2 as w from s)"""


def broken_words(spark, sf_dir):
    """Broken and whole words by language and type, what chance would break, and retention."""
    own = _masked(spark, sf_dir).withColumn("kept", diagnose.kept_syllables(diagnose.sizes("words"), F.col("a")))
    words = diagnose.word_rows(own.select("doc_id", "lang", "words", "kept"), "words", "kept")
    rate = words.groupBy("lang").agg((F.sum("kept") / F.sum("n")).alias("r"))
    chance = diagnose.chance_mix(words.join(F.broadcast(rate), "lang"), F.col("r"), ["lang"])  # a row a language
    got = diagnose.cbr(words, ["lang"]).join(chance, "lang").join(diagnose.retention(words, ["lang"]).filter("tier = 'all'").drop("tier", "n"), "lang")
    return got.select("lang", "kind", "n_partial", "n_full", F.round("cbr", 6).alias("cbr"), F.round("chance", 6).alias("chance"), F.round("rate", 6).alias("rate"))


_BROKEN = f"""with {_MASKED}, w as (select doc_id, lang, w, count(*) as n, count(*) filter (where a) as k, min(t) as x, max(t) as y, regexp_extract(lower(first(t order by i)), '^([^aăâeêioôơuưyáàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ]*)', 1) as o1,
      regexp_extract(lower(last(t order by i)), '^([^aăâeêioôơuưyáàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ]*)', 1) as o2 from m group by doc_id, lang, w),
    r as (select lang, sum(k) * 1e0 / sum(n) as r, avg(case when k > 0 then 1e0 else 0e0 end) as rate from w group by lang),
    c as (select w.lang, sum(1 - power(r, n) - power(1 - r, n)) / sum(1 - power(1 - r, n)) as chance from w join r on r.lang = w.lang where n > 1 group by w.lang),
    t as (select lang, k < n as part, unnest(['all', case when o1 <> '' and o1 = o2 then 'reduplicative' else 'other' end]) as kind from w where n > 1 and k > 0)
    select t.lang, kind, count(*) filter (where part) as n_partial, count(*) filter (where not part) as n_full, round(count(*) filter (where part) * 1e0 / count(*), 6) as cbr, round(max(chance), 6) as chance, round(max(rate), 6) as rate
    from t join c on c.lang = t.lang join r on r.lang = t.lang group by t.lang, kind"""


def token_cost_profile(spark, sf_dir):
    """What the distinct words of each language cost, and how that goes with their syllables. Its SQL is in stat_plans."""
    words = read_table(spark, sf_dir, "documents").select("lang", F.explode_outer(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\S+)"), F.lit(1))).alias("w")).filter("w is not null").distinct()
    own = words.select("lang", F.greatest(F.lit(1), F.ceil(F.length("w") / 4).cast("long")).alias("cost"), F.size(F.regexp_extract_all(F.lower("w"), F.lit("([aeiouáéíóúàèêëïüöä]+)"), F.lit(1))).cast("long").alias("syllables"))
    got = diagnose.cost_profile(own, ["lang"], "cost", "syllables")
    return got.select("lang", "n", F.round("fertility", 6).alias("fertility"), F.round("cv", 6).alias("cv"), F.round("spearman", 5).alias("spearman"))


def mask_comparison(spark, sf_dir):
    own = _masked(spark, sf_dir)
    count = lambda m: F.transform(F.arrays_zip(diagnose.kept_syllables(diagnose.sizes("words"), F.col(m)).alias("k"), diagnose.sizes("words").alias("n")), lambda x: F.when((x["n"] > 1) & (x["k"] > 0), x["k"] == x["n"]))
    size = lambda m, v: F.size(F.filter(F.col(f"w{m}"), lambda x: x == v)).cast("long")
    own = own.withColumns({f"w{m}": count(m) for m in "ab"})
    own = own.select("lang", "a", "b", *[size(m, v).alias(f"{n}_{m}") for m in "ab" for n, v in (("partial", False), ("full", True))])
    got = gates.mask_comparison(own, ["lang"])
    return got.select("lang", "n", F.round("exact", 6).alias("exact"), F.round("agreement", 6).alias("agreement"), F.round("gap_points", 5).alias("gap_points"), "passed")


_COMPARE = f"""with {_MASKED}, p as (select doc_id, lang, count(*) as n, count(*) filter (where a) as ka, count(*) filter (where b) as kb, count(*) filter (where a = b) as same from m group by doc_id, lang, w),
    g as (select lang, sum(same) * 1e0 / sum(n) as agreement, count(*) filter (where n > 1 and ka > 0 and ka < n) * 1e0 / count(*) filter (where n > 1 and ka > 0) as ca, count(*) filter (where n > 1 and kb > 0 and kb < n) * 1e0 / count(*) filter (where n > 1 and kb > 0) as cb from p group by lang),
    d as (select d.doc_id, d.lang, coalesce(bool_and(p.same = p.n), true) as eq from documents d left join p on p.doc_id = d.doc_id group by d.doc_id, d.lang), e as (select lang, count(*) as n, avg(case when eq then 1e0 else 0e0 end) as exact from d group by lang)
    select e.lang, e.n, round(exact, 6) as exact, round(agreement, 6) as agreement, round(100 * abs(ca - cb), 5) as gap_points, exact >= 0.95 and 100 * abs(ca - cb) <= 0.5 as passed from e join g on g.lang = e.lang"""


def recovered_words(spark, sf_dir):
    """What a predictor restores that says the kept syllable before the gap: reduplications alone."""
    own = _masked(spark, sf_dir).select("doc_id", F.col("s").alias("syllables"), diagnose.sizes("words").alias("sizes"), F.col("a").alias("mask"))

    def echo(near):
        out, last = [], ""
        for s in near:
            if s is None:
                out.append(last)
            else:
                last = s
        return out

    return diagnose.recovery(own, echo).agg(F.sum("n_broken").alias("n_broken"), F.sum("recovered").alias("recovered"))


_RECOVERED = f"""with {_MASKED}, l as (select *, max(case when a then i end) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as seen from m),
    g as (select l.doc_id, l.w, not l.a as gone, k.t as guess, l.t, count(*) over (partition by l.doc_id, l.w) as n, count(*) filter (where l.a) over (partition by l.doc_id, l.w) as kept, l.i, l.seen from l left join s k on k.doc_id = l.doc_id and k.i = l.seen),
    b as (select doc_id, w, bool_and(not gone or coalesce(case when seen >= w * 2 - 100 then lower(guess) end, '') = lower(t)) as ok, row_number() over (partition by doc_id order by w) as r from g where n > 1 and kept > 0 and kept < n group by doc_id, w)
    select count(*) as n_broken, count(*) filter (where ok) as recovered from b where r <= 50"""


def guards(spark, sf_dir):
    """What guards find in rows with planted faults: repeated keys, missing seeds, rows of the unseen set, excluded rows, coverage, open sheets."""
    rows = results(spark, sf_dir)
    docs = read_table(spark, sf_dir, "documents")
    row = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("guard"), "n")
    twice = rows.unionByName(rows.filter("id % 50 = 7"))
    files = docs.select(F.col("source").alias("stem"), F.lit("t").alias("task"), F.col("doc_id").alias("row_id"), F.col("doc_id").alias("id"), F.col("lang").alias("cluster"))
    shown = gates.exclusion_list(files, 20)
    cover = gates.required_coverage(docs.select("source", F.col("lang").alias("split"), F.col("text").alias("context")), [("web", "en"), ("web", "xx"), ("no source", "en")])
    sheet = docs.select(F.col("doc_id").alias("id"), "source", F.when(F.col("doc_id") % 9 == 0, "old").otherwise("blind-v1").alias("sheet"), F.when(F.col("doc_id") % 5 > 0, "ann").alias("annotator"), F.when(F.col("doc_id") % 7 > 0, True).alias("gold"))
    blind = gates.blind_sheet(docs.select(F.col("doc_id").alias("id"), "source", "text", (F.col("doc_id") % 3 == 0).alias("edited")), 5, "edited")
    sample = gates.reverify_sample(docs.select(F.col("doc_id").alias("id"), F.lower("text").alias("kept"), "text"), F.lower(F.regexp_replace("text", "zz", "z")), "kept", 40)
    parts = [
        row("repeated keys", gates.repeated_keys(twice, ["task", "method", "ratio", "id"])),
        row("cells with other seeds", gates.missing_seeds(rows.filter("not (method = 'word_s0' and task = 't2' and seed = 1)"), "_s[0-9]+$", [0, 1, 2])),
        row("excluded rows", shown),
        row("left after exclusion", gates.without_excluded(files.drop("stem"), shown)),
        row("clusters left", gates.without_excluded(files.drop("stem"), shown).select("cluster").distinct()),
        row("missing sources", cover.filter("missing")),
        gates.sheet_problems(sheet).select(F.concat(F.lit("sheet: "), F.col("problem")).alias("guard"), "n"),
        row("blind sheet", blind.filter("gold is null")),
        sample.select(F.lit("verified again").alias("guard"), F.col("matched").alias("n")),
    ]
    return reduce(DataFrame.unionByName, parts)


_GUARDS = f"""with {_R}, shown as (select doc_id, lang from (select doc_id, lang, row_number() over (partition by source order by doc_id) as k from documents) q where k <= 20), left_ as (select * from documents where doc_id not in (select doc_id from shown)),
    sh as (select doc_id % 9 = 0 as a, doc_id % 5 = 0 as b, doc_id % 7 = 0 as c from documents), sm as (select text from documents order by md5('0:' || doc_id), doc_id limit 40)
    select 'repeated keys' as guard, count(*) as n from r where id % 50 = 7
    union all select 'cells with other seeds', count(*) from (select task, method, ratio, list_sort(list(distinct h % 3)) as seeds from r where method in ('word_s0', 'syllable_s0') and not (method = 'word_s0' and task = 't2' and h % 3 = 1) group by all) q where seeds <> [0, 1, 2]
    union all select 'excluded rows', count(*) from shown union all select 'left after exclusion', count(*) from left_ union all select 'clusters left', count(distinct lang) from left_
    union all select 'missing sources', 2 + (select case when count(*) = 0 then 1 else 0 end from documents where source = 'web' and lang = 'en')
    union all select 'sheet: wrong sheet', count(*) from sh where a having count(*) > 0 union all select 'sheet: no annotator', count(*) from sh where b having count(*) > 0 union all select 'sheet: open label', count(*) from sh where c having count(*) > 0
    union all select 'blind sheet', count(*) from (select row_number() over (partition by source, doc_id % 3 = 0 order by md5('0:' || doc_id), doc_id) as k from documents) q where k <= 5
    union all select 'verified again', count(*) filter (where lower(text) is not distinct from lower(replace(text, 'zz', 'z'))) from sm"""

def distill_reasons(spark, sf_dir):
    """Reasons and summaries of label pairs drawn from the result rows, by ratio."""
    rows = results(spark, sf_dir).filter("method = 'teacher'").select("ratio", (F.col("id") % 11 > 0).alias("known"), (F.col("id") % 13 > 0).alias("segmented"), F.when(F.col("h") % 31 > 0, "x").alias("compressed"), (F.col("h") % 40 / 300).alias("unmatched_ratio"), (F.col("h") / 1000).alias("keep_rate"), (F.col("h") % 5).alias("n_partial"), (F.col("h") % 7).alias("n_full"))
    own = gates.distillation_summary(rows, ["ratio"])
    return own.select("ratio", "reason", "n", *[F.round(c, 6).alias(c) for c in ("cbr_mean", "cbr_pooled", "keep_mean")])


_DISTILL = f"""with {_R}, q as (select ratio, h, h % 5 as p, h % 7 as f, case when id % 11 = 0 then 'not a paragraph' when id % 13 = 0 then 'no segmentation' when h % 31 = 0 or h % 40 / 300e0 > 0.1 then 'rewritten' when h / 1000e0 > 0.9 then 'not compressed' else 'kept' end as reason from r where method = 'teacher')
    select ratio, reason, count(*) as n, round(avg(p * 1e0 / nullif(p + f, 0)), 6) as cbr_mean, round(sum(p) * 1e0 / nullif(sum(p + f), 0), 6) as cbr_pooled, round(avg(h / 1000e0), 6) as keep_mean from q group by ratio, reason"""

#: What has to be there, known beforehand: a source that is wholly missing shows.
REQUIRED = [(s, x) for s in ("src0", "src1", "src2", "books") for x in ("en", "de", "it")]


def eval_coverage(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").select("source", F.col("lang").alias("split"), F.col("text").alias("context"))
    return gates.required_coverage(rows, REQUIRED)


_COVERAGE = f"""select q.s as source, q.l as split, count(d.doc_id) as n_rows, count(*) filter (where d.doc_id is not null and coalesce(d.text, '') = '') as n_blank, count(d.doc_id) = 0 as missing
    from (values {", ".join(f"('{s}', '{x}')" for s, x in REQUIRED)}) q(s, l) left join documents d on d.source = q.s and d.lang = q.l group by q.s, q.l"""

QUERIES = {f.__name__: f for f in (eval_coverage, distill_reasons, token_cost_profile, budget_adherence_cells, paired_budget_gaps, best_of_classes, one_row_gates, precheck, detector_by_tier, broken_words, mask_comparison, recovered_words, guards)}
ORACLE_SQL = {"eval_coverage": _COVERAGE, "distill_reasons": _DISTILL, "budget_adherence_cells": _ADHERENCE, "paired_budget_gaps": _GAPS, "best_of_classes": _BEST, "one_row_gates": _ONE, "precheck": _PRECHECK, "detector_by_tier": _TIER, "broken_words": _BROKEN, "mask_comparison": _COMPARE, "recovered_words": _RECOVERED, "guards": _GUARDS}
