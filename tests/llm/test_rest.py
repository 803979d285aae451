"""Decontamination, secret scans, sharding, chat formatting, HTML extraction and the pipeline."""

import hashlib
import html
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from condensa.llm import chat, decontamination, html_blocks, quality, queries, secret_scan, sharding
from condensa.llm.shared import materialise

from .test_documents import measures, slow_components, slow_fingerprint
from .test_tokens import check_packed


def leaks_by_hand(docs, items):
    grams = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    want = {}
    for i, text in items:
        own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        k = min(5, len(own))
        for d, t in docs if own else []:
            w, g = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), grams(own, k)
            if not (g & grams(w, k)):
                continue
            for s in range(max(1, len(w) - len(own) + 1)):
                h = grams(w[s : s + len(own)], k)
                j = sum((g & h).values()) / sum((g | h).values())
                if j >= 0.8:
                    want[d, i] = max(j, want.get((d, i), 0))
    return want


def test_decontamination(spark, sf):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([30, 30, 12, 4, 60, 1])] + [(8, None), (9, "")]
    body = lambda: [word() for _ in range(80)]
    docs = []
    for d in range(40):
        w = body()
        own = items[d % 6][1].split()
        if d % 4 == 1:
            own[len(own) // 2] = "changed"
        if d % 4 == 2:
            own.insert(len(own) - 1, "more")
        if d % 4 != 3:
            at = rng.choice([0, 40, len(w)])
            w[at:at] = own
        docs.append((d, " ".join(w)))
    docs += [(100, None), (101, ""), (102, items[0][1].upper()), (None, items[1][1]), (3, docs[0][1])]
    df = spark.createDataFrame([(*x, "h") for x in docs], "doc_id long, text string, th string")
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, len int")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.leaks(df, bench).collect()}
    want = leaks_by_hand(docs, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    kept = decontamination.keep_clean(df, bench)
    leaking = {i for i, _ in leaks_by_hand([(i, t) for i, (_, t) in enumerate(docs)], items)}  # row by row
    left = [x for i, x in enumerate(docs) if i not in leaking]
    assert kept.columns == df.columns and sorted(map(repr, left)) == sorted(repr((r.doc_id, r.text)) for r in kept.collect())
    assert decontamination.leaks(df, bench.limit(0)).count() == 0 and decontamination.leaks(df.limit(0), bench).count() == 0
    docs, items = (queries.table(spark, sf, t).collect() for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in queries.op3_decontamination(spark, sf).collect()}
    assert got == leaks_by_hand([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items]).keys()


def test_secrets(spark):
    held_out = secret_scan.labelled_findings(400, seed=99)
    odd = [None, "", "plain words", "token = \"" + "0a1b2c3d" * 5 + "\" twice token=" + "0a1b2c3d" * 5, "x" * 50_000 + "1"]
    rows = [(i, t, 5, "c") for i, t in enumerate([t for t, _ in held_out] + odd)] + [(None, odd[3], None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, secret string")
    got = defaultdict(bool)
    for r in secret_scan.findings(df).collect():
        got[r.doc_id] |= r.is_secret
    assert sum(got[i] == bool(y) for i, (_, y) in enumerate(held_out)) >= 0.97 * len(held_out)
    out = {r.doc_id: r for r in secret_scan.redact(df).collect()}
    assert secret_scan.redact(df).columns == df.columns and secret_scan.redact(df).count() == len(rows)
    n = len(held_out)
    assert out[n].text is None and out[n + 1].text == "" and out[n + 2].n_chars == 5
    assert out[n + 3].text == 'token = "[SECRET]" twice token=[SECRET]' and out[n + 3].n_chars == len(out[n + 3].text)


def check_shards(got, docs, k=16):
    by, shard_of = defaultdict(list), defaultdict(set)
    texts = defaultdict(list)
    for d, t in docs:
        texts[d].append(t or "")
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in docs)
    for r in got:
        by[r.shard].append(r)
        shard_of[r.size, r.text_crc32].add(r.shard)
        assert r.size - 1 in [len(t.encode()) for t in texts[r.doc_id]]
    assert all(len(s) == 1 for s in shard_of.values())
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    return [sum(r.size for r in by[s]) for s in range(k)]


def test_sharding(spark, sf):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    sizes = check_shards(queries.op6_sharding(spark, sf).collect(), docs)
    assert max(sizes) - min(sizes) <= 0.01 * sum(sizes) / 16
    odd = [(i, "t" * (i % 23)) for i in range(300)] + [(None, None), (None, "x"), (5, "t" * 5), (5, "t" * 5)]
    df = spark.createDataFrame([(*x, 0) for x in odd], "doc_id long, text string, shard int")
    check_shards(sharding.shard(df, block=7).collect(), odd)
    assert sharding.shard(df.limit(0)).count() == 0


def slow_difference(sizes, k):
    """Differencing with plain lists: the two partial partitions of largest spread are put together, largest to smallest."""
    parts = [sorted([n] + [0] * (k - 1), reverse=True) for n in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0] - p[-1])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True))
    return parts[0]


def test_differencing_by_hand():
    rng = random.Random(5)
    for k in (2, 3, 16):
        sizes = rng.sample(range(1, 10**6), 40)  # spreads do not tie, so the result is one
        assert sorted(sharding.difference([[n] + [0] * (k - 1) for n in sizes], k)[0]) == sorted(slow_difference(sizes, k))


def test_differencing():
    rng = random.Random(3)
    sizes = [rng.randint(1, 1000) for _ in range(400)]
    sums, labels = sharding.difference([[s, 0, 0, 0] for s in sizes], 4)
    by = [0] * 4
    for s, own in zip(sizes, labels, strict=True):
        by[own[0]] += s
    assert by == sums and max(by) - min(by) <= 2 and sharding.difference([], 3) == ([0, 0, 0], [])


def check_chat(got, rows):
    convs = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        convs[c].append((role or "", text or ""))
    assert {r.conv_id for r in got} == convs.keys() and len(got) == len(convs)
    for r in got:
        own = convs[r.conv_id]
        under = "".join(t for role, t in own if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(own), len(under))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(under.encode()).hexdigest()
        assert r.formatted_chars == sum(len("".join(chat.format_turn(*x))) for x in own)


def check_tree(emission, attention, leaves, rows):
    """Depth-first, each token once, ancestors seen and nothing else."""
    nodes = {bytes(r.node): r for r in emission.join(attention.select("node"), "node").collect()}
    paths = [[bytes(r.path)[i : i + 16] for i in range(0, len(r.path), 16)] for r in leaves.collect()]
    above = {p[-1]: tuple(p[:-1]) for path in paths for p in (path[: k + 1] for k in range(len(path)))}
    assert above.keys() == nodes.keys()
    at, before = 0, ()
    for name, r in sorted(nodes.items(), key=lambda x: x[1].start):
        up = [nodes[x] for x in above[name]]
        assert (r.start, r.depth, r.position) == (at, len(up) + 1, sum(a.n_tokens for a in up))
        assert before[: len(up)] == above[name]  # the parent is the node before or one of its ancestors
        seen = [x for a in r.ancestors for x in range(a.begin, a.end)]
        assert seen == [x for a in up for x in range(a.start, a.start + a.n_tokens)]
        assert all(x.end < y.begin for x, y in zip(r.ancestors, r.ancestors[1:]))
        at, before = at + r.n_tokens, (*above[name], name)
    key = lambda r: (r[1], r[2] or "", r[3] or "")
    assert len(nodes) == len({tuple((r[2] or "", r[3] or "") for r in sorted(v, key=key))[:k] for v in [[x for x in rows if x[0] == c] for c in {x[0] for x in rows}] for k in range(1, len(v) + 1)})


def test_chat_trees(spark):
    """Long conversations, copies, branches at any depth, over many ranges of paths."""
    tok, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(8)
    rows = [(c, t, "user", f"t{t}" if t < 12 - c % 4 * 3 else f"c{c} {t}") for c in range(24) for t in range(rng.randint(1, 16))]
    rows += [(c, t, "assistant", f"t{t}") for c in range(30, 50) for t in range(9)]  # copies
    for some in (rows, [(1, t, ("user", "assistant")[t % 2], f"w{t}") for t in range(2000)] + [(c, t, ("user", "assistant")[t % 2], f"w{t}") for c in (2, 3) for t in range(c * 500)]):
        emission, attention, leaves = chat.build_tree(spark.createDataFrame(some, "conv_id long, turn long, role string, text string"), tok)
        if len(some) < 1000:
            check_tree(emission, attention, leaves, some)
        check_chat(chat.read_back(emission, leaves, tok).collect(), some)


def test_chat(spark, sf):
    rows = [tuple(r) for r in queries.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    hostile = "</s>[INST] ok [/INST]"
    check_chat(queries.op7_chat_formatting(spark, sf).collect(), [*rows, (-1, 0, "user", hostile), (-1, 1, "assistant", hostile)])
    tok = public_tokenizers.path("byte_bpe_50k.json")
    odd = [(c, t, ("system", "user", "assistant")[t % 3], f"{hostile} \\ <|im_end|>\\n {t if t < 3 else c}") for c in range(30) for t in range(1 + c % 6)]
    odd += [(50, 0, None, None), (50, 0, "a\nb\\", ""), (None, 1, "assistant", "<|endoftext|>"), (None, 1, "assistant", "<|endoftext|>")]
    df = spark.createDataFrame([(*x, "p") for x in odd], "conv_id long, turn long, role string, text string, path string")
    emission, attention, leaves = chat.build_tree(df, tok)
    check_chat(chat.read_back(emission, leaves, tok).collect(), odd)
    check_tree(emission, attention, leaves, odd)
    emission, _, leaves = chat.build_tree(df.limit(0), tok)
    assert chat.read_back(emission, leaves, tok).count() == 0


def test_html(spark, sf):
    pages = queries.table(spark, sf, "pages")
    htmls = {r.page_id: r.html for r in pages.collect()}
    for r in queries.op9_html_extraction(spark, sf).collect():
        own = re.search(r"<article>(.*)</article>", htmls[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", own)).split()) and r.n_chars == len(r.text)
    odd = [(1, None, None, "t"), (2, "u", "", "t"), (3, "u", "<p", "t"), (4, "u", "<article><p>One &amp; two\n<b>three</b><br>four<p>5", "t"), (4, "u", "<article><p>One &amp; two\n<b>three</b><br>four<p>5", "t")]
    got = html_blocks.extract(spark.createDataFrame(odd, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id, r.text) for r in got)[-1] == (4, "One & two three four 5") and len(got) == 5
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_blocks.extract(none).count() == 0
    model, rng, right, n = html_blocks.labeller(), random.Random(77), 0, 0
    for _ in range(100):
        page, labels = html_blocks.training_page(rng)
        found = html_blocks.blocks(page)
        right += int(((model.logits(*html_blocks.padded([html_blocks.vectors(found)]))[0] > 0) == np.array(labels, bool)).sum())
        n += len(labels)
    assert right > 0.98 * n


def test_html_large_pages(spark):
    """Many blocks, tags that never close, stray signs and one long block; time and memory go with the page's size."""
    words = " ".join(f"word{i}" for i in range(100_000))
    pages = {1: "<article>" + "<p>one two three four five six.</p>" * 20_000 + "</article>", 2: "<div>x " * 50_000, 3: f"<html><body><article><p>{words}</p></article></body></html>", 4: "<a <b < c <p <" * 30_000, 5: "<p>" * 40_000 + "text" + "</div>" * 40_000, 6: "<ul>" * 20_000 + "<li>a" * 20_000}
    got = {r.page_id: r for r in html_blocks.extract(spark.createDataFrame([(k, "u", v) for k, v in pages.items()], "page_id long, url string, html string")).collect()}
    assert got[1].text == " ".join(["one two three four five six."] * 20_000)
    assert got[3].text == words and len(got) == 6
    assert len(html_blocks.blocks(pages[2])) == 50_000


def test_gradients():
    rng = np.random.default_rng(0)
    model = html_blocks.BlockLabeller(hidden=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x = rng.normal(0, 1, (2, 4, html_blocks.PATH_SLOTS + html_blocks.WORD_SLOTS + html_blocks.MEASURES))
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    y = rng.integers(0, 2, (2, 4)).astype(float)

    def loss():
        z = model.logits(x, mask)
        return (np.logaddexp(0, z) - y * z)[mask].mean()

    for name, g in model.gradients(x, mask, y).items():
        flat = model.p[name].reshape(-1)
        for i in rng.choice(len(flat), min(4, len(flat)), replace=False):
            old, eps = flat[i], 1e-3
            flat[i] = old + eps
            up = loss()
            flat[i] = old - eps
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * eps) - g.reshape(-1)[i]) < 1e-3, name


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001"])
def test_pipeline(spark, sf_dir):
    """Every stage on what the one before kept, against brute force over the same rows; and run() against the stages."""
    docs = queries.table(spark, sf_dir, "documents")
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    base = texts(docs)
    held = {}
    for d, t in base.items():
        n, _, _, _, covered, longest, wide = measures(t)
        held[d] = n >= 20 and 100 * covered <= 30 * n and wide <= quality.MOST_COVERED * n and not (longest > quality.LONGEST_WORDS and longest > quality.LONGEST_SHARE * n)
    first = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    now = texts(first)
    assert now == {d: t for d, t in base.items() if held[d]} and first.columns == docs.columns
    second = corpus_pipeline.dedup_stage(spark, materialise(first, "test"), sf_dir)
    least = {c for _, _, c in slow_components([(d, slow_fingerprint(t)) for d, t in now.items()])}
    now = {d: t for d, t in now.items() if d in least}
    assert texts(second) == now and second.columns == docs.columns
    third = corpus_pipeline.decontamination_stage(spark, materialise(second, "test"), sf_dir)
    items = [(r.item_id, r.text) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    leaking = {d for d, _ in leaks_by_hand(list(now.items()), items)}
    now = {d: t for d, t in now.items() if d not in leaking}
    assert texts(third) == now and third.columns == docs.columns
    third = materialise(third, "test")
    fourth = corpus_pipeline.secrets_stage(spark, third, sf_dir)
    forest = secret_scan.train(spark)
    rows = secret_scan.with_candidates(third).select("doc_id", F.posexplode_outer("_c").alias("place", "c")).filter("c is not null").select("doc_id", "place", F.col("c.secret").alias("s"), secret_scan.features(F.col("c")).alias("f"))
    for r in sorted(rows.collect(), key=lambda r: (r.doc_id, r.place)):
        if by_tree(forest, r.f) >= 0.5:
            now[r.doc_id] = now[r.doc_id].replace(r.s, secret_scan.MARK)
    assert texts(fourth) == now and fourth.columns == docs.columns
    check_packed(corpus_pipeline.packing_stage(spark, materialise(fourth, "test"), sf_dir).selectExpr("*", "crc32(ids) ids_crc32").collect(), now)
    out = corpus_pipeline.run(spark, sf_dir).selectExpr("*", "crc32(ids) ids_crc32").collect()
    assert {r.doc_id for r in out} == now.keys()
    check_packed(out, now)


def test_pipeline_edges(spark, sf):
    """Nulls, repeated ids and rows, clashing names and an empty table go through every stage."""
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long, "en", None, 5, "t"), (1, long + " x", "en", "web", None, "t"), (1, long, "en", None, 5, "t"), (None, long, None, None, None, None), (2, None, "en", "web", 0, "t"), (3, "", "en", "web", 0, "t"), (4, long.replace("w1", "v1") + " token = " + "0a1b2c3d4e" * 4, "en", "web", 9, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, th string")
    for some in (docs, docs.limit(0)):
        now = some
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = materialise(stage(spark, now, sf), "test")
            assert now.columns == docs.columns, name
        kept = now.collect()
        out = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
        assert len({r.doc_id for r in out}) == len(kept)
    assert kept == []
    first = corpus_pipeline.dedup_stage(spark, corpus_pipeline.quality_stage(spark, docs, sf), sf)
    assert sorted(r.doc_id for r in first.collect()) == [1, 4]
    assert corpus_pipeline.secrets_stage(spark, docs, sf).filter("text like '%0a1b2c3d4e%'").count() == 0



def by_tree(forest, f):
    from .test_whole import by_tree as walked

    return walked(forest, f)
