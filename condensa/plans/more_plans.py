"""Plans over rows of methods, seeds and labels."""

from __future__ import annotations

from .dialect import TOKEN, SparkSQL


def method_families(d: SparkSQL):
    """Seed suffix, family prefix and grid options of method names."""
    name = "concat(case event_id % 4 when 0 then 'syllable_pi_soft_T1_d0p1' when 1 then 'word_h3_a0p5_cword' when 2 then 'lead' else 'tfidf_sent' end, case when event_id % 3 = 0 then '' else concat('_s', cast(event_id % 3 as varchar(4))) end)"
    return f"""
    with m as (select {name} as method from {d.t("events")}),
    p as (select method, {d.replace("method", r"_s[0-9]+$", "")} as base, {d.find("method", r"_s([0-9]+)$")} as seed, replace({d.find("method", r"_[da]([0-9]+p[0-9]+)")}, 'p', '.') as option_ from m)
    select base, seed, option_, case when base like 'syllable%' then 'syllable' when base like 'word%' then 'word' when base like '%sent' then 'sentence' else 'baseline' end as family, count(*) as n from p group by base, seed, option_"""


def seed_paired_rows(d):
    """A system's rows meet the reference of the same seed, else the reference without a seed."""
    return f"""
    with a as (select o_orderkey as id, o_custkey % 3 as seed, o_totalprice as score from {d.t("orders")}),
    b as (select o_orderkey as id, case when o_orderkey % 2 = 0 then o_custkey % 3 end as seed, o_totalprice * 0.9e0 as score from {d.t("orders")} where o_orderkey % 5 > 0),
    p as (select a.id, a.seed, a.score, coalesce(x.score, y.score) as ref, x.id is not null as by_seed from a left join b x on x.id = a.id and x.seed = a.seed left join b y on y.id = a.id and y.seed is null)
    select cast(seed as bigint) as seed, by_seed, count(*) as n, round(avg(score - ref), 4) as diff from p where ref is not null group by seed, by_seed"""


def word_pooling(d):
    """Mean logit a word of two tokens, then its sigmoid; window overlaps are averaged first."""
    toks = d.explode(f"select doc_id, {d.find_all("lower(coalesce(text, ''))", TOKEN)} as ws from {d.t('documents')}", "ws")
    logit = f"({d.md5_int("concat('w', cast(win as varchar(9)), val)")} / 4294967296e0 * 8 - 4)"
    return f"""
    with t as (select x.doc_id, x.pos, x.val, w.i as win from {toks} x cross join {d.range("0", "1")} w where w.i = 0 or x.pos % 4 = 0),
    s as (select doc_id, pos, avg({logit}) as logit from t group by doc_id, pos),
    w as (select doc_id, cast(floor((pos - 1) / 2) as bigint) as word, avg(logit) as logit from s group by doc_id, cast(floor((pos - 1) / 2) as bigint))
    select doc_id, count(*) as n_words, round(avg(1 / (1 + exp(-logit))), 5) as mean_keep, count(*) filter (where logit > 0) as n_kept from w group by doc_id"""


def parallel_rows_join(d):
    """Two versions of the same turns joined on two keys; the answer's number becomes a letter."""
    return f"""
    select a.conv_id, a.turn, md5(coalesce(a.text, '')) as text_md5, md5(coalesce(b.text, '')) as other_md5, substr('ABCD', cast(a.turn % 4 as int) + 1, 1) as answer
    from {d.t("conversations")} a join (select conv_id, turn, lower(text) as text from {d.t("conversations")}) b on b.conv_id = a.conv_id and b.turn = a.turn"""


def prompt_build(d):
    return f"""select conv_id, turn, md5(concat('Read the text and answer.', chr(10), chr(10), coalesce(text, ''), chr(10), 'Answer:')) as prompt_md5, case when role = 'system' then 2 else 1 end as n_messages from {d.t("conversations")}"""


def teacher_sizes(d):
    """Target and upper size of a compression by rate, halves to even."""
    n = d.size(d.find_all("coalesce(text, '')", r"(\S+)"))
    return f"""select doc_id, cast({n} as bigint) as n, r.i as tenths, greatest(1, {d.half_even(f"{n} * (r.i / 10e0)")}) as target, {d.half_even(f"greatest(1, {d.half_even(f'{n} * (r.i / 10e0)')}) * 1.1e0")} as upper_ from {d.t("documents")} cross join {d.range("3", "5")} r"""


def mask_agreement(d):
    """Two masks over the same units: agreement a unit and whole masks that agree."""
    toks = d.explode(f"select doc_id, {d.find_all("coalesce(text, '')", r'(\S+)')} as ws from {d.t('documents')}", "ws")
    return f"""
    with m as (select doc_id, length(val) > 3 as a, {d.md5_int("concat('m', val)")} % 50 > 0 and length(val) > 3 as b from {toks} x),
    g as (select doc_id, count(*) as n, count(*) filter (where a = b) as same from m group by doc_id)
    select count(*) as n_docs, round(sum(same) * 1e0 / sum(n), 6) as unit_agreement, round(avg(case when same = n then 1e0 else 0e0 end), 6) as exact_masks from g"""


def unique_clusters(d):
    return f"select source, doc_id from (select source, doc_id, row_number() over (partition by source order by doc_id) as r from {d.t('documents')}) x where r = 1"


PLANS = {f.__name__: f for f in (method_families, seed_paired_rows, word_pooling, parallel_rows_join, prompt_build, teacher_sizes, mask_agreement, unique_clusters)}
