"""Plans over texts: leak filter, sampling, text functions, detectors, compression by windows, metrics."""

from __future__ import annotations

from .dialect import METRIC, TOKEN, SparkSQL

RATIO = "0.333e0"
#: Cost of a unit with the built-in counter: a token for every four characters begun.
COST = "greatest(1, cast(ceil(length(val) / 4e0) as bigint))"
#: Small word lists of the built-in detectors (negation, particles that end a question, stop words).
NEGATION = "('not','no','never','non','pas','nicht','kein','keine','sin','nunca')"
STOP = "('the','a','of','and','to','in','is','it','for','on','that','was','with','as','be','at','by','la','le','les','de','des','du','et','un','une','der','die','das','und','ein','en','el','los','las','y','que')"


def _tokens(d: SparkSQL, table: str, key: str) -> str:
    return f"select {key}, {d.find_all("lower(coalesce(text, ''))", TOKEN)} as toks from {d.t(table)}"


def _grams(d: SparkSQL, table: str, key: str, n: int = 13) -> str:
    return d.explode(f"select {key}, {d.grams('toks', n)} as g from ({_tokens(d, table, key)}) x", "g")


def leak_ids(d: SparkSQL) -> str:
    return f"select distinct doc_id from {_grams(d, 'documents', 'doc_id')} g where exists (select 1 from (select distinct val from {_grams(d, 'benchmark', 'item_id')} b) e where e.val = g.val)"


def leak_flags_with_precedence(d):
    """Reason: same id as an evaluation row with the same first word, else shared 13 tokens."""
    first = lambda x: d.at(d.split(f"lower({x})", r"\s+"), "1")
    return f"""
    with leak as ({leak_ids(d)}),
    hit as (select d.doc_id, d.source, max(case when b.item_id is not null then 1 else 0 end) as same_id from {d.t("documents")} d
            left join {d.t("benchmark")} b on b.item_id = d.doc_id and {first("b.text")} = {first("d.text")} group by d.doc_id, d.source),
    flagged as (select h.source, case when h.same_id = 1 then 'id' when l.doc_id is not null then 'ngram' else 'clean' end as reason
                from hit h left join leak l on l.doc_id = h.doc_id)
    select source, reason, count(*) as n from flagged group by source, reason"""


def stratified_md5_sample(d):
    return f"""
    select lang, doc_id, quality from (
      select d.lang, d.doc_id, l.quality, row_number() over (partition by d.lang order by md5(concat('13:', cast(d.doc_id as varchar(20)))), d.doc_id) as r
      from {d.t("documents")} d join {d.t("labels")} l on l.doc_id = d.doc_id) x where r <= 25"""


def entity_split(d):
    """First tenth of the sources by hash goes to dev, with all their rows."""
    return f"""
    with ids as (select source, row_number() over (order by md5(concat('0:', source)), source) as r, count(*) over () as n from (select distinct source from {d.t("documents")}) s)
    select case when i.r <= greatest(1, cast(floor(i.n * 1e-1) as bigint)) then 'dev' else 'train' end as split, count(*) as n_rows, count(distinct d.source) as n_sources
    from {d.t("documents")} d join ids i on i.source = d.source group by 1"""


def kshot_demo_sample(d):
    """Three demonstrations a conversation: the pool is ordered once on a ring of hashes, and each row takes
    the next three from a place of its own, so no row meets the whole pool."""
    return f"""
    with pool as (select item_id, row_number() over (order by md5(cast(item_id as varchar(20))), item_id) - 1 as place, count(*) over () as n from {d.t("benchmark")}),
    size as (select count(*) as n from {d.t("benchmark")}),
    rows as (select distinct conv_id from {d.t("conversations")}),
    want as (select r.conv_id, k.i as k, ({d.md5_int("concat('k:', cast(r.conv_id as varchar(20)))")} + k.i) % s.n as place from rows r cross join size s cross join {d.range("0", "2")} k)
    select w.conv_id, cast(w.k as bigint) as k, p.item_id from want w join pool p on p.place = w.place"""


def sentence_prefix_truncate(d):
    """Longest prefix of whole sentences with at most 60 words; a first overflow ends it."""
    sent = d.replace("coalesce(text, '')", r"([.!?])\s+", "#1\x01")
    return f"""
    with s as {d.explode(f"select doc_id, {d.split(sent, chr(1))} as ss from {d.t('documents')}", "ss", "sent", "val")},
    c as (select doc_id, sent, cast({d.size(d.find_all("val", r"(\S+)"))} as bigint) as n from s),
    run as (select doc_id, sent, n, sum(n) over (partition by doc_id order by sent rows unbounded preceding) as total from c)
    select doc_id, count(*) filter (where total <= 60) as n_sentences, cast(coalesce(sum(n) filter (where total <= 60), 0) as bigint) as n_words from run group by doc_id"""


def _units(d: SparkSQL) -> str:
    """doc_id, pos (from 0), val, cost, n (units), total, budget."""
    sub = d.explode(f"select doc_id, {d.find_all("coalesce(text, '')", r'(\S+)')} as ws from {d.t('documents')}", "ws")
    return f"""(select x.*, {d.half_even(f"{RATIO} * total")} as budget from (select doc_id, pos - 1 as pos, val, {COST} as cost, count(*) over (partition by doc_id) as n, sum({COST}) over (partition by doc_id) as total from {sub} u) x)"""


def compress_none_nocontext(d):
    return f"""select doc_id, m.method, case when m.method = 'none' then md5(coalesce(text, '')) else md5('') end as text_md5
    from {d.t("documents")} cross join (select 'none' as method union all select 'no_context' as method) m"""


def tfidf_sentence_scores(d):
    sent = d.replace("coalesce(text, '')", r"([.!?])\s+", "#1\x01")
    s = d.explode(f"select doc_id, {d.split(sent, chr(1))} as ss from {d.t('documents')}", "ss", "sent", "body")
    w = d.explode(f"select doc_id, sent, {d.find_all('lower(body)', METRIC)} as ts from {s} s", "ts", "p", "term")
    return f"""
    with w as (select doc_id, sent, term from {w} w0),
    tf as (select doc_id, sent, term, count(*) as tf from w group by doc_id, sent, term),
    df as (select doc_id, term, count(*) as df from tf group by doc_id, term),
    n as (select doc_id, count(distinct sent) as n, count(*) as words from w group by doc_id),
    len as (select doc_id, sent, count(*) as bag from w group by doc_id, sent)
    select tf.doc_id, cast(tf.sent as bigint) as sent, round(sum(tf.tf * ln((1e0 + n.n) / (1e0 + df.df))) / max(len.bag), 5) as score
    from tf join df on df.doc_id = tf.doc_id and df.term = tf.term join n on n.doc_id = tf.doc_id join len on len.doc_id = tf.doc_id and len.sent = tf.sent
    group by tf.doc_id, tf.sent"""


def protection_tiers(d):
    tier = f"case when {d.like('val', r'^\p{P}*$')} then 'none' when {d.like('val', r'\p{Nd}')} then 'T1' when val in {NEGATION} then 'T1' when val in {STOP} then 'none' when length(val) >= 9 then 'T2' else 'T3' end"
    return f"select tier, count(*) as n, count(distinct doc_id) as n_docs from (select doc_id, {tier} as tier from {d.explode(_tokens(d, 'documents', 'doc_id'), 'toks')} x) y group by tier"


def detector_prf(d):
    return f"""
    with p as (select l.doc_id, l.quality = 0 as gold, {d.like("d.text", r"[#*$%&|<>]{3}")} or {d.size(d.find_all("d.text", r"(\S+)"))} < 20 as pred from {d.t("labels")} l join {d.t("documents")} d on d.doc_id = l.doc_id),
    c as (select count(*) filter (where gold and pred) as tp, count(*) filter (where pred and not gold) as fp, count(*) filter (where gold and not pred) as fn from p)
    select tp, fp, fn, case when tp + fp > 0 then round(tp * 1e0 / (tp + fp), 6) else 0e0 end as precision_, case when tp + fn > 0 then round(tp * 1e0 / (tp + fn), 6) else 0e0 end as recall,
      case when 2 * tp + fp + fn > 0 then round(2e0 * tp / (2 * tp + fp + fn), 6) else 0e0 end as f1 from c"""


def _pairs(d: SparkSQL) -> str:
    return f"(select q.conv_id, q.turn, q.text as pred, a.text as gold from {d.t('conversations')} q join {d.t('conversations')} a on a.conv_id = q.conv_id and a.turn = q.turn + 1 where a.role = 'assistant')"


def _overlap(d: SparkSQL, n: int) -> str:
    def side(c):
        return d.explode(f"select conv_id, turn, {d.grams('ts', n)} as g from (select conv_id, turn, {d.find_all(f"lower(coalesce({c}, ''))", METRIC)} as ts from {_pairs(d)} p) x", "g")

    return f"""
    with a as (select conv_id, turn, val, count(*) as c from {side("pred")} p group by conv_id, turn, val),
    b as (select conv_id, turn, val, count(*) as c from {side("gold")} g group by conv_id, turn, val),
    na as (select conv_id, turn, sum(c) as n from a group by conv_id, turn), nb as (select conv_id, turn, sum(c) as n from b group by conv_id, turn),
    common as (select a.conv_id, a.turn, sum(least(a.c, b.c)) as n from a join b on b.conv_id = a.conv_id and b.turn = a.turn and b.val = a.val group by a.conv_id, a.turn)
    select p.conv_id, p.turn, round(coalesce(2e0 * c.n / (na.n + nb.n), 0e0), 6) as f1
    from {_pairs(d)} p left join na on na.conv_id = p.conv_id and na.turn = p.turn left join nb on nb.conv_id = p.conv_id and nb.turn = p.turn left join common c on c.conv_id = p.conv_id and c.turn = p.turn"""


def rouge_2(d):
    return _overlap(d, 2)


def qa_f1(d):
    return _overlap(d, 1)


def string_recall(d):
    word = d.at(d.find_all("lower(gold)", METRIC), "1")
    return f"select conv_id, turn, coalesce(pred is not null and position(coalesce({word}, '') in lower(pred)) > 0, false) as found, lower(coalesce(pred, '')) = lower(coalesce(gold, '')) as exact from {_pairs(d)} p"


def parse_predictions(d):
    return f"""
    select conv_id, turn, {d.find("text", r"^([^\n]*)")} as first_line, {d.find("text", r"\b([A-D])\b")} as choice, coalesce({d.at(d.find_all("text", r"(-?\d+(?:[.,]\d+)?)"), d.size(d.find_all("text", r"(-?\d+(?:[.,]\d+)?)")))}, '') as last_number
    from {d.t("conversations")} where text is not null"""


def normalize_numbers(d):
    raw = "cast(o_totalprice as varchar(40))"
    forms = f"select o_orderkey, raw from (select o_orderkey, case o_orderkey % 4 when 0 then '1.000' when 1 then concat(cast(o_orderkey % 900 as varchar(9)), ',5') when 2 then '12,345.0' else concat(cast(o_orderkey as varchar(19)), '.0') end as raw from {d.t('orders')}) f"
    del raw
    plain = f"case when {d.like('raw', r'^-?\d{1,3}([.,]\d{3})+$')} then {d.replace('raw', '[.,]', '')} when {d.like('raw', r'^-?\d{1,3}(,\d{3})+\.\d+$')} then {d.replace('raw', ',', '')} else {d.replace('raw', ',', '.')} end"
    return f"select o_orderkey, {d.replace(plain, r'\.0+$', '')} as number from ({forms}) x"


def html_detokenize(d):
    x = d.replace(d.replace("html", "<[^>]*>", " "), "_", " ")
    x = d.replace(d.replace(d.replace(x, r"\s+([,.;:!?)\]}%])", "#1"), r"([(\[{])\s+", "#1"), r"\s+", " ")
    return f"select page_id, md5(trim({x})) as text_md5, cast(length(trim({x})) as bigint) as n_chars from {d.t('pages')}"


def exclusion_primary_vs_full(d):
    return f"""
    with ex as (select doc_id from {d.t("labels")} where toxic = 1)
    select d.source, count(*) as n_full, count(*) filter (where e.doc_id is null) as n_primary, count(distinct d.lang) as clusters_full, count(distinct case when e.doc_id is null then d.lang end) as clusters_primary
    from {d.t("documents")} d left join ex e on e.doc_id = d.doc_id group by d.source"""


def content_fingerprint_guard(d):
    fp = lambda x: d.sha(f"concat('{{\"text\":\"', {x}, '\"}}')")
    return f"select count(*) as n_rows, count(distinct {fp('d.text')}) as n_fingerprints, count(b.f) as n_unseen from {d.t('documents')} d left join (select distinct {fp('text')} as f from {d.t('benchmark')}) b on b.f = {fp('d.text')}"


def dq_key_uniqueness(d):
    return " union all ".join(f"select '{t}' as tbl, count(*) as n_keys, coalesce(cast(sum(case when c > 1 then 1 else 0 end) as bigint), 0) as n_repeated from (select {k}, count(*) as c from {d.t(t)} group by {k}) x" for t, k in (("documents", "doc_id"), ("labels", "doc_id"), ("conversations", "conv_id, turn"), ("pages", "page_id")))


def dq_subset(d):
    return f"select count(*) as n_labels, count(*) filter (where not exists (select 1 from {d.t('documents')} d where d.doc_id = l.doc_id)) as n_foreign from {d.t('labels')} l"


def full_match_check(d):
    return f"""select count(*) as n_ids, count(*) filter (where a.doc_id is null) as only_labels, count(*) filter (where b.doc_id is null) as only_documents
    from {d.t("documents")} a full outer join {d.t("labels")} b on b.doc_id = a.doc_id"""


PLANS = {f.__name__: f for f in (leak_flags_with_precedence, stratified_md5_sample, entity_split, kshot_demo_sample, sentence_prefix_truncate, compress_none_nocontext, tfidf_sentence_scores, protection_tiers, detector_prf, rouge_2, qa_f1, string_recall, parse_predictions, normalize_numbers, html_detokenize, exclusion_primary_vs_full, content_fingerprint_guard, dq_key_uniqueness, dq_subset, full_match_check)}
