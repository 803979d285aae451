"""Plans over result rows: bootstraps, tests, corrections, selections and gates.

Draws are the first eight hexadecimal digits of an MD5 of (seed, replicate, draw): the same whole numbers
in every engine. Clusters are summed before they are drawn, so a replicate costs clusters, not rows.
"""

from __future__ import annotations

from .dialect import SparkSQL

#: Replicates of every bootstrap, and of the minimum detectable effect: those of the reference.
REPLICATES, MDE_REPLICATES = 10_000, 2_000


def _cells(d: SparkSQL) -> str:
    """unit, cluster, seed, two scores: per order, its priority class against its value."""
    return f"(select o_orderkey as id, o_custkey % 40 as cluster, {d.md5_int('cast(o_orderkey as varchar(19))')} % 3 as seed, case when o_orderstatus = 'F' then 1e0 else 0e0 end as a, case when o_totalprice > 150000 then 1e0 else 0e0 end as b from {d.t('orders')})"


def _draws(d: SparkSQL, clusters: str, seed: str, replicates: int = REPLICATES) -> str:
    """b, place: as many draws a replicate as there are clusters (one row a draw, not a row a pair)."""
    return f"""(select b.i as b, {d.md5_int(f"concat('{seed}|', cast(b.i as varchar(9)), '|', cast(k.place as varchar(9)))")} % k.n as place from {d.range("0", str(replicates - 1))} b cross join (select place, n from {clusters}) k)"""


def _boot(d: SparkSQL, value: str, where: str = "true", seed: str = "1", replicates: int = REPLICATES) -> str:
    """CTEs: cl (cluster sums with a place), rep (b, m: the replicate's mean), point."""
    return f"""
    cl as (select cluster, s, c, row_number() over (order by cluster) - 1 as place, count(*) over () as n from (select cluster, sum({value}) as s, count(*) as c from {_cells(d)} x where {where} group by cluster) y),
    rep as (select r.b, sum(cl.s) / sum(cl.c) as m from {_draws(d, "cl", seed, replicates)} r join cl on cl.place = r.place group by r.b),
    point as (select sum(s) / sum(c) as mean, sum(c) as n_rows, count(*) as n_clusters from cl)"""


def paired_cluster_bootstrap(d):
    return f"""with {_boot(d, "a - b")}
    select round(max(p.mean), 6) as diff, cast(max(p.n_rows) as bigint) as n_rows, max(p.n_clusters) as n_clusters, round({d.percentile("r.m", 0.025)}, 6) as low, round({d.percentile("r.m", 0.975)}, 6) as high, round(avg(case when r.m <= 0 then 1e0 else 0e0 end), 6) as p_value
    from rep r cross join point p"""


def crossed_seed_cluster_bootstrap(d):
    """One draw of seeds and one of clusters a replicate; the clusters' draw is shared by all seeds."""
    return f"""
    with cell as (select seed, cluster, sum(a - b) as s, count(*) as c from {_cells(d)} x group by seed, cluster),
    cl as (select cluster, row_number() over (order by cluster) - 1 as place, count(*) over () as n from (select distinct cluster from cell) y),
    sd as (select seed, row_number() over (order by seed) - 1 as place, count(*) over () as n from (select distinct seed from cell) y),
    wc as (select r.b, cl.cluster, count(*) as w from {_draws(d, "cl", "c")} r join cl on cl.place = r.place group by r.b, cl.cluster),
    ws as (select r.b, sd.seed, count(*) as w from {_draws(d, "sd", "s")} r join sd on sd.place = r.place group by r.b, sd.seed),
    rep as (select wc.b, sum(wc.w * ws.w * cell.s) / sum(wc.w * ws.w * cell.c) as m from wc join ws on ws.b = wc.b join cell on cell.cluster = wc.cluster and cell.seed = ws.seed group by wc.b)
    select count(*) as n_replicates, round({d.percentile("m", 0.025)}, 6) as low, round({d.percentile("m", 0.975)}, 6) as high, round(avg(case when m <= 0 then 1e0 else 0e0 end), 6) as p_value from rep"""


def non_inferiority(d):
    return f"with {_boot(d, 'a - b', seed='ni')} select round({d.percentile('m', 0.05)}, 6) as lower, {d.percentile('m', 0.05)} > -0.02e0 as passes from rep"


def mde_projected(d):
    """(z for 5% + z for 80%) times the bootstrap's deviation, projected to four times the clusters."""
    return f"with {_boot(d, 'a - b', seed='mde', replicates=MDE_REPLICATES)} select round((1.645e0 + 0.842e0) * stddev_pop(m), 6) as mde_dev, round((1.645e0 + 0.842e0) * stddev_pop(m) * sqrt(max(n_clusters) / (4e0 * max(n_clusters))), 6) as mde_test from rep cross join point"


def clustered_slope(d):
    moments = f"select o_custkey % 40 as cluster, count(*) as n, sum(l_quantity) as x, sum(l_extendedprice) as y, sum(l_quantity * l_extendedprice) as xy, sum(l_quantity * l_quantity) as xx from {d.t('lineitem')} join {d.t('orders')} on o_orderkey = l_orderkey group by o_custkey % 40"
    slope = lambda w="": f"(sum({w}xy) / sum({w}n) - sum({w}x) / sum({w}n) * sum({w}y) / sum({w}n)) / (sum({w}xx) / sum({w}n) - sum({w}x) / sum({w}n) * sum({w}x) / sum({w}n))"
    return f"""
    with m as ({moments}), cl as (select *, row_number() over (order by cluster) - 1 as place, count(*) over () as k from m),
    rep as (select r.b, {slope("cl.")} as s from {_draws(d, "(select place, k as n from cl)", "slope")} r join cl on cl.place = r.place group by r.b),
    point as (select {slope()} as s from m)
    select round(max(p.s), 3) as slope, round({d.percentile("r.s", 0.025)}, 3) as low, round({d.percentile("r.s", 0.975)}, 3) as high from rep r cross join point p"""


def _p_values(d: SparkSQL) -> str:
    """A made-up p-value for each (event type, group): a share over the table."""
    return f"(select event_type as task, user_id % 3 as arm, avg(case when value > 50 then 1e0 else 0e0 end) * 0.05e0 as p from {d.t('events')} group by event_type, user_id % 3)"


def holm_family(d):
    """Step-down within the registered family (arms 0 and 1); other cells keep their raw value."""
    return f"""
    with c as (select task, arm, p, arm < 2 as member from {_p_values(d)} x),
    r as (select task, arm, p, row_number() over (order by p, task, arm) as k, count(*) over () as m from c where member),
    h as (select task, arm, max(least(1e0, (m - k + 1) * p)) over (order by p, task, arm rows unbounded preceding) as adjusted from r)
    select c.task, cast(c.arm as bigint) as arm, c.member, round(c.p, 6) as p, round(h.adjusted, 6) as adjusted from c left join h on h.task = c.task and h.arm = c.arm"""


def _ln_factorial(x: str) -> str:
    """ln x! of a whole number, row by row: Stirling's series at x + 10, and the factors up to there."""
    z = f"({x} + 10e0)"
    return f"(({z} - 0.5e0) * ln({z}) - {z} + 0.5e0 * ln(2 * pi()) + 1 / (12 * {z}) - 1 / (360 * power({z}, 3)) + 1 / (1260 * power({z}, 5)) - ln({' * '.join(f'({x} + {k}e0)' for k in range(1, 10))}))"


def mcnemar_discordant(d):
    """Exact tails of the sign of discordant pairs, from logarithms of factorials. Terms further than
    20 sqrt(n) from n / 2 are left out: together they are below exp(-800), which no double holds."""
    return f"""
    with n as (select seed, count(*) filter (where a > b) as only_a, count(*) filter (where b > a) as only_b from {_cells(d)} x group by seed),
    t as (select seed, only_a, only_b, only_a + only_b as n from n),
    k as (select seed, only_a, only_b, n, {d.each("greatest(0, floor(n / 2e0 - 20 * sqrt(n)))", "least(n, ceil(n / 2e0 + 20 * sqrt(n)))")} as k from t),
    pk as (select seed, only_a, only_b, k, exp({_ln_factorial("n")} - {_ln_factorial("k")} - {_ln_factorial("(n - k)")} - n * ln(2e0)) as p from k)
    select seed, max(only_a) as only_a, max(only_b) as only_b, round(least(1e0, 2 * sum(case when k <= least(only_a, only_b) then p else 0e0 end)), 6) as two_sided, round(least(1e0, sum(case when k <= only_a then p else 0e0 end)), 6) as a_flips_less
    from pk group by seed"""


def factorial_2x2(d):
    """Unit, label and interaction contrasts of four cells with the same ids."""
    return f"""
    with cell as (select o_custkey as id, case when {d.md5_int("cast(o_orderkey as varchar(19))")} % 2 = 0 then 0 else 1 end as unit, case when o_orderstatus = 'F' then 1 else 0 end as label, avg(o_totalprice) / 1000 as score from {d.t("orders")} group by 1, 2, 3),
    w as (select id, max(case when unit = 0 and label = 0 then score end) as s00, max(case when unit = 0 and label = 1 then score end) as s01, max(case when unit = 1 and label = 0 then score end) as s10, max(case when unit = 1 and label = 1 then score end) as s11 from cell group by id having count(*) = 4)
    select count(*) as n, round(avg((s10 + s11 - s00 - s01) / 2), 6) as unit_effect, round(avg((s01 + s11 - s00 - s10) / 2), 6) as label_effect, round(avg(s11 - s10 - s01 + s00), 6) as interaction from w"""


def nfr_by_group(d):
    """Share of rows that a method turns from right to wrong: overall, where it was right, on hard clusters."""
    return f"""
    with base as (select id, cluster, seed, a as ok from {_cells(d)} x), m as (select id, b as ok from {_cells(d)} x)
    select base.seed, count(*) as n, round(avg(case when base.ok = 1 and m.ok = 0 then 1e0 else 0e0 end), 6) as flips, round(avg(case when base.ok = 1 then case when m.ok = 0 then 1e0 else 0e0 end end), 6) as flips_of_right, round(avg(case when base.cluster < 10 then case when base.ok = 1 and m.ok = 0 then 1e0 else 0e0 end end), 6) as flips_hard
    from base join m on m.id = base.id group by base.seed"""


def _grid(d: SparkSQL) -> str:
    return f"(select event_type as mode, user_id % 4 as delta, user_id % 3 as ratio, avg(value) as loss, avg(case when value > 60 then 1e0 else 0e0 end) as nfr from {d.t('events')} where value is not null group by event_type, user_id % 4, user_id % 3)"


def config_selection(d):
    """Of configurations whose worst ratio is within the margin the one with fewest flips, else that of the smallest worst loss."""
    return f"""
    with c as (select mode, delta, max(loss) as worst, avg(nfr) as nfr from {_grid(d)} g group by mode, delta),
    f as (select mode, delta, worst, nfr, worst <= (select {d.percentile("worst", 0.5)} from c) + 1e-12 as feasible from c),
    r as (select *, row_number() over (order by case when feasible then 0 else 1 end, case when feasible then round(nfr, 9) else round(worst, 9) end, mode, delta) as k from f)
    select mode, cast(delta as bigint) as delta, round(worst, 6) as worst, round(nfr, 6) as nfr, feasible from r where k = 1"""


def alpha_selection(d):
    """Largest mean gain over the cells a mode, ties to the smaller value."""
    return f"""
    with g as (select mode, delta, avg(nfr) as gain from {_grid(d)} g group by mode, delta),
    r as (select mode, delta, gain, row_number() over (partition by mode order by round(gain, 9) desc, delta) as k from g)
    select mode, cast(delta as bigint) as alpha, round(gain, 6) as gain from r where k = 1"""


def majority_gate(d):
    """A mode passes if it beats each baseline on a strict majority of tasks and has every cell."""
    return f"""
    with g as (select mode, ratio as task, avg(loss) as score from {_grid(d)} g group by mode, ratio),
    p as (select m.mode, b.mode as baseline, count(*) as tasks, count(*) filter (where m.score > b.score) as wins from g m join g b on b.task = m.task and b.mode <> m.mode and b.mode in ('click', 'view') group by m.mode, b.mode)
    select mode, count(*) as n_baselines, min(wins) as fewest_wins, min(case when wins * 2 > tasks then 1 else 0 end) = 1 and min(tasks) = 3 as passes from p where mode not in ('click', 'view') group by mode"""


def result_summary(d):
    """Cell: rows, clusters, mean, deviation of the seeds' means, share of blanks."""
    return f"""
    with s as (select cluster % 4 as task, seed, avg(a) as m from {_cells(d)} x group by cluster % 4, seed)
    select cast(c.task as bigint) as task, c.n, c.n_clusters, round(c.mean, 6) as mean, round(s.sd, 6) as seed_sd, round(c.blank, 6) as blank
    from (select cluster % 4 as task, count(*) as n, count(distinct cluster) as n_clusters, avg(a) as mean, avg(case when b = 0 then 1e0 else 0e0 end) as blank from {_cells(d)} x group by cluster % 4) c
    join (select task, stddev_samp(m) as sd from s group by task) s on s.task = c.task"""


def token_cost_profile(d):
    """Fertility, variation, and rank correlation of cost and length, with mean ranks for ties."""
    sub = d.explode(f"select lang, {d.find_all("coalesce(text, '')", r'(\S+)')} as ws from {d.t('documents')}", "ws")
    mean_rank = lambda x: f"rank() over (partition by lang order by {x}) + (count(*) over (partition by lang, {x}) - 1) / 2e0"
    return f"""
    with w as (select lang, val, count(*) as c from {sub} x group by lang, val),
    u as (select lang, greatest(1, cast(ceil(length(val) / 4e0) as bigint)) as cost, cast({d.size(d.find_all("lower(val)", "([aeiouáéíóúàèêëïüöä]+)"))} as bigint) as syllables from w),
    r as (select lang, cost, syllables, {mean_rank("cost")} as rc, {mean_rank("syllables")} as rs from u)
    select lang, count(*) as n, round(sum(cost) * 1e0 / nullif(sum(syllables), 0), 6) as fertility, round(stddev_pop(cost) / avg(cost), 6) as cv, round(corr(rc, rs), 5) as spearman from r group by lang"""


def chance_cbr_length_mix(d):
    """Share of broken words that keeping syllables at random would give, as a ratio of sums over lengths."""
    sub = d.explode(f"select lang, {d.find_all("coalesce(text, '')", r'(\S+)')} as ws from {d.t('documents')}", "ws")
    r = "0.333e0"
    return f"""
    with l as (select lang, cast({d.size(d.find_all("lower(val)", "([aeiouáéíóúàèêëïüöä]+)"))} as bigint) as n from {sub} x),
    h as (select lang, n, count(*) as c from l where n > 1 group by lang, n)
    select lang, cast(sum(c) as bigint) as n_words, round(sum(c * (1 - power({r}, n) - power(1 - {r}, n))) / sum(c * (1 - power(1 - {r}, n))), 6) as chance from h group by lang"""


def cbr_by_type(d):
    """Pairs of neighbouring tokens stand in for words of two syllables; every third token is dropped by hash."""
    toks = d.explode(f"select doc_id, {d.find_all("lower(coalesce(text, ''))", '([\\p{L}]+)')} as ws from {d.t('documents')}", "ws")
    return f"""
    with t as (select doc_id, cast(floor((pos - 1) / 2) as bigint) as word, val, {d.md5_int("concat(cast(doc_id as varchar(19)), ':', cast(pos as varchar(9)))")} % 3 <> 0 as kept from {toks} x),
    w as (select doc_id, word, count(*) as n, count(*) filter (where kept) as k, min(val) = max(val) as twin from t group by doc_id, word),
    s as (select case when twin then 'reduplicative' else 'other' end as kind, k = n as whole from w where n > 1 and k > 0)
    select kind, count(*) filter (where whole) as n_full, count(*) filter (where not whole) as n_partial, round(count(*) filter (where not whole) * 1e0 / count(*), 6) as cbr from (select kind, whole from s union all select 'all', whole from s) x group by kind"""


def retention_by_tier(d):
    toks = d.explode(f"select doc_id, {d.find_all("lower(coalesce(text, ''))", r'(\S+)')} as ws from {d.t('documents')}", "ws")
    tier = f"case when {d.like('val', r'\p{Nd}')} then 'T1' when length(val) >= 9 then 'T2' else 'T3' end"
    return f"""
    with t as (select {tier} as tier, {d.md5_int("concat(cast(doc_id as varchar(19)), ':', cast(pos as varchar(9)))")} % 3 <> 0 as kept from {toks} x where not {d.like("val", r"^\p{P}*$")})
    select tier, count(*) as n, count(*) filter (where kept) as n_kept, round(count(*) filter (where kept) * 1e0 / count(*), 6) as rate from (select tier, kept from t union all select 'all', kept from t) x group by tier"""


PLANS = {f.__name__: f for f in (paired_cluster_bootstrap, crossed_seed_cluster_bootstrap, non_inferiority, mde_projected, clustered_slope, holm_family, mcnemar_discordant, factorial_2x2, nfr_by_group, config_selection, alpha_selection, majority_gate, result_summary, token_cost_profile, chance_cbr_length_mix, cbr_by_type, retention_by_tier)}
