"""The DataFrame functions on small rows, by hand."""

import math

import pytest
from pyspark.sql import functions as F

from condensa.operators import compress, diagnose, gates, protection, stats
from condensa.sources import tasks


def words(spark, *texts):
    """Words as text/pos/ner; without them pos is N and ner O."""
    part = lambda w: (*w.split("/"), *("N", "O")[w.count("/") :])
    return spark.createDataFrame([(i, list(map(part, t))) for i, t in enumerate(texts)], "doc_id long, words array<struct<text:string,pos:string,ner:string>>")


def test_protection_in_context(spark):
    texts = [
        ["Tôi", "không", "đi", "."], ["bạn", "đi", "không", "nhỉ", "ạ", "?"], ["không", "độ"], ["Chẳng", "hạn"], ["không/M", "bảy"], ["chưa", "?"], ["không", "nhỉ", "!"],
        ["nhà", "mới/A"], ["vừa", "mới/R"], ["phải/V", "không"], ["phải/V", "đi"], ["học", "kém"], ["kém", "hơn"], ["Huế/Np/B-LOC", "nếu", "5", "%"], [],
    ]
    df = words(spark, *texts)
    got = {r.doc_id: (r.t, r.n) for r in df.select("doc_id", protection.tiers("words").alias("t"), protection.negations("words").alias("n")).collect()}
    assert [got[i][1].count(True) for i in range(15)] == [1, 0, 0, 0, 0, 0, 1, 0, 0, 1, 0, 0, 0, 0, 0]
    assert got[2][0] == [None, None] and got[4][0] == ["T1", None] and got[5][0] == [None, None]
    assert [got[i][0] for i in (7, 8, 9, 10, 11, 12)] == [[None, None], ["T2", "T2"], [None, "T1"], ["T2", None], [None, None], ["T3", "T3"]]
    assert got[13][0] == ["T1", "T1", "T1", None] and got[14] == ([], [])
    probe = {r.doc_id: r.p for r in df.select("doc_id", protection.probe("words").alias("p")).collect()}
    assert probe[0] == "Tôi đi." and probe[1] == "bạn đi không nhỉ ạ?" and probe[14] == ""
    one = words(spark, ["có thể", "không khí", "5", "đã", "có thể"]).withColumn("t", protection.tiers("words")).withColumn("s", protection.syllables("words"))
    r = one.select(protection.force_tokens("words", "t").alias("f"), protection.string_force_mask("s").alias("m"), protection.naive_mask("s").alias("n"), protection.expand("words", protection.protected_mask(F.col("t"))).alias("e"), protection.force_tokens("words", "t", ("T1",)).alias("f1")).first()
    assert r.f == ["có thể", "5", "đã"] and r.f1 == ["5"]
    assert r.m == [True, True, True, False, True, True, True, True] and r.n == [False, False, True, False, True, True, False, False] and r.e == [True, True, False, False, True, True, True, True]
    assert spark.createDataFrame([(["(", "a", ",", "b", ")", "[", "c"],)], "p array<string>").select(protection.render(F.col("p")).alias("x")).first().x == "(a, b) [c"


def test_registry(spark):
    docs = spark.createDataFrame([(1, "One is not here. Two two two words stay. Three?"), (2, ""), (3, None), (1, "no never")], "doc_id long, text string")
    for spec in ("none", "no_context", "probe_negation", "tfidf_sent", "ppl_sent", "selective_context", "lead"):
        got = compress.compress(docs, spec, 0.5).collect()
        assert len(got) == 4 and all(r.used <= r.budget or spec in ("none", "probe_negation") for r in got)
    text = {(r.doc_id, r.budget): r.compressed for r in compress.compress(docs, "probe_negation", 0.5).collect()}
    assert text[1, 7] == "One is here. Two two two words stay. Three?" and text[3, 0] == ""
    made = docs.filter("doc_id = 1").limit(1)
    done = spark.createDataFrame([(1, 0.5, "a b c d e f g h i j")], "doc_id long, ratio double, compressed string")
    assert compress.precomputed(made, done, 0.5, trim=True).first().text == "a b c d e f g"
    assert compress.precomputed(made, done, 0.5).first().used == 10
    with pytest.raises(Exception, match="nothing precomputed"):
        compress.precomputed(docs, done, 0.5).collect()
    with pytest.raises(Exception, match="parallel"):
        compress.translated(docs.withColumn("text_en", F.lit(None).cast("string")), "lead", 0.5).collect()
    rates = compress.fit_lexprior(spark.createDataFrame([("Two", 1), ("two", 1), ("is", 0), ("here.", 0)], "word string, kept int"))
    got = {r.word: (r.seen, r.rate) for r in rates.collect()}
    assert got["two"] == (2, pytest.approx(2.5 / 3)) and got["is"] == (1, 0.25) and got[""] == (0, 0.5)
    a, b = (sorted(map(tuple, compress.lexprior(docs, rates, 0.5, most=m).select("doc_id", "n_kept", "positions", "compressed").collect())) for m in (100, 1))
    assert a == b and any("Two two two" in r[3] for r in a)
    stats_ = compress.selection_stats([True, False, True], [2, 3, 4], 5, [True, True, False])
    assert stats_ == {"sum_unit_cost": 6, "cost_deviation": 1, "n_trimmed": 0, "p_unit_cost": 2, "n_protected_kept": 1, "n_protected": 2}
    assert compress.sentence_scores(docs).count() == 4 and compress.compress(docs.limit(0), "tfidf_sent", 0.5).count() == 0


def test_stats_on_any_rows(spark):
    rows = [(c, s, 1.0 if (c + s) % 3 else 0.0, 1.0 if c % 2 else 0.0, float(c), 2.0 * c + s) for c in range(12) for s in range(3)]
    df = spark.createDataFrame(rows, "who int, run int, p double, q double, x double, y double")
    r = stats.paired_test(df, "p", "q", "who", n_boot=400).first()
    assert r.n_rows == 36 and r.n_clusters == 12 and r.diff == pytest.approx(sum(p - q for _, _, p, q, _, _ in rows) / 36) and r.low <= r.diff <= r.high
    crossed = stats.paired_test(df, "p", "q", "who", "run", n_boot=300).first()
    assert crossed.n_replicates == 300 and crossed.low <= crossed.diff <= crossed.high
    assert stats.flip_rate_test(df, "q", "q", "who", n_boot=50).first().p_value == 1.0
    assert stats.non_inferiority(df.withColumn("z", F.col("p")), "p", "z", "who", 0.01, n_boot=50).first().passes
    assert stats.clustered_slope(df, "x", "y", "who", n_boot=100).first().slope == pytest.approx(2.0)
    with pytest.raises(ValueError):
        stats.paired_test(df.filter("who = 1"), "p", "q", "who", n_boot=10).collect()
    with pytest.raises(KeyError):
        stats.minimum_detectable_effect(df, "p", "q", "who", power=0.7)
    p = spark.createDataFrame([("a", 0.01, True), ("b", 0.04, True), ("c", 0.03, True), ("d", 0.001, False), ("e", None, True)], "k string, p double, m boolean")
    got = {r.k: r.adjusted for r in stats.holm(p, "p", "m").collect()}
    assert got == {"a": pytest.approx(0.03), "c": pytest.approx(0.06), "b": pytest.approx(0.06), "d": None, "e": None}
    sd = stats.seed_deviation(df, "p", ["who"], "run").collect()
    assert len(sd) == 12 and all(r.seed_sd is not None for r in sd)


def test_tasks(spark):
    one = lambda c, x: spark.createDataFrame([(x,)], "x string").select(c(F.col("x")).alias("v")).first().v
    assert one(lambda x: tasks.sentence_prefix(x, 4), "A b. C d! E f.") == "A b. C d!" and one(lambda x: tasks.sentence_prefix(x, 1), "A b. C.") == ""
    assert one(tasks.is_poem, "a b\n\nc d\ne f\ng") and not one(tasks.is_poem, "a\nb\nc")
    for task, text, want in [("nli", "Neutral? no, other", "neutral"), ("nli", "nothing", ""), ("choice", "BAD (C) D", "C"), ("qa", " x y \nz", "x y"), ("math", "so 3\nAnswer: 1.200 or 4", "1200"), ("math", "1 and 2,5.", "2.5"), ("math", "none", ""), ("summarization", " s ", "s")]:
        assert one(lambda x, t=task: tasks.parse(t, x), text) == want
    raw = spark.createDataFrame([(1, "t", "q", "['a', 'b', 'c', 'd']", "B "), (2, "t", "q", "['a', 'b', 'b', 'd']", "C"), (3, "l\nl\nl\nl", "q", "['a', 'b', 'c', 'd']", "A"), (4, None, "q", "[]", "A")], "index int, article string, question string, options string, answer string")
    got = {r.id: (r.choices, r.dropped) for r in tasks.choice_rows(raw, "dev").collect()}
    assert got["choice-dev-1"] == (["a", "b", "c", "d"], None) and [got[f"choice-dev-{i}"][1] for i in (2, 3, 4)] == ["duplicate gold", "poem", "no gold"]
    seg = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "id string, n int")
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert tasks.with_segmentation(rows.filter("id = 'a'"), seg).count() == 1
    for bad in ("b", "c"):
        with pytest.raises(Exception, match="segmentation of"):
            tasks.with_segmentation(rows.filter(F.col("id") == bad), seg).collect()
    with pytest.raises(Exception, match="no single slot"):
        tasks.long_rows(spark.createDataFrame([(1, "s", "ctx", "no marks", "", ["a"])], "index int, subtask string, context string, question string, prefix string, answers array<string>"), "<T>", "</T>", 5).collect()
    with pytest.raises(ValueError):
        tasks.prompt("other")
    golds = spark.createDataFrame([("a b c", ["b c d", "x"]), ("A, b!", ["a b"]), ("z", [])], "pred string, golds array<string>")
    got = golds.select(tasks.best_f1("pred", "golds").alias("f"), tasks.exact_match("pred", "golds").alias("e"), tasks.recall("pred", "golds").alias("r")).collect()
    assert got[0].f == pytest.approx(2 / 3) and [r.e for r in got] == [0.0, 1.0, 0.0] and [r.r for r in got] == [0.0, 0.0, None]


def test_diagnose(spark):
    kinds = words(spark, ["sạch sẽ", "quần áo", "Hà Nội/Np", "a a", "đi/V/B"]).select(F.transform("words", lambda w: diagnose.word_type(w["text"], w["pos"], w["ner"])).alias("k")).first().k
    assert kinds == ["reduplicative", "other", "name", "other", "name"]
    names = ["llmlingua2vi_s1", "llmlingua2", "llmlingua", "lead", "mine", "mine2_s0", "translate_llmlingua2"]
    df = spark.createDataFrame([(n,) for n in names], "m string")
    got = {r.m: r.f for r in df.select("m", diagnose.family(F.col("m"), ("mine2",)).alias("f")).collect()}
    assert got == {"llmlingua2vi_s1": "learned, Vietnamese labels", "llmlingua2": "learned, English labels", "llmlingua": "perplexity / LM", "lead": "deterministic", "mine": "other", "mine2_s0": "learned, Vietnamese labels", "translate_llmlingua2": "learned, English labels"}
    base, seed = diagnose.seed_of(F.col("m"))
    assert df.filter("m = 'llmlingua2vi_s1'").select(base.alias("b"), seed.alias("s")).first() == ("llmlingua2vi", 1)
    grid = spark.createDataFrame([("v_pi_soft_T1T2_d0p1_s2",), ("v_h3_a0p5_ctokens_s1",)], "m string").select(diagnose.grid_options(F.col("m")).alias("o")).collect()
    assert (grid[0].o.mode, grid[0].o.tiers, grid[0].o.delta) == ("soft", "T1T2", 0.1) and (grid[1].o.alpha, grid[1].o.cost) == (0.5, "tokens")
    docs = spark.createDataFrame([(1, ["a", "b", "c", "d"], [2, 2], [True, False, False, True]), (2, [], [], []), (3, None, None, None)], "doc_id long, syllables array<string>, sizes array<int>, mask array<boolean>")
    got = {r.doc_id: (r.n_broken, r.recovered) for r in diagnose.recovery(docs, lambda near: ["B" if near[0] == "a" else "x" for s in near if s is None]).collect()}
    assert got == {1: (2, 1), 2: (0, 0), 3: (0, 0)}  # "b" is restored whatever its case, "c" is not
    x = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert x.select(diagnose.finite_mean(F.col("x")).alias("m")).first().m == 2.0
    c = spark.createDataFrame([(2, 0.3), (2, 1.0)], "n int, r double").select(diagnose.chance_cbr(F.col("n"), F.col("r")).alias("c")).collect()
    assert c[0].c == pytest.approx((1 - 0.09 - 0.49) / (1 - 0.49)) and c[1].c is None


def test_guards(spark):
    rows = spark.createDataFrame([("t", "1", "a"), ("t", "2", "a"), ("u", "1", "b")], "task string, id string, stem string")
    with pytest.raises(ValueError):
        gates.excluded_ids(rows, "zz")
    with pytest.raises(ValueError):
        gates.one_value(rows, "task")
    with pytest.raises(ValueError):
        gates.dev_only("test")
    assert gates.one_value(rows.filter("task = 'u'"), "stem") == "b"
    assert gates.without_excluded(rows, rows.filter("task = 'u'")).count() == 2
    with pytest.raises(ValueError):
        gates.unseen_guard(rows, rows.limit(1), ["task", "id"])
    assert gates.unseen_guard(rows, rows.filter("id = '9'"), ["task", "id"]).count() == 3
    assert gates.ids_digest(rows) == gates.ids_digest(rows.orderBy(F.desc("id")).unionByName(rows)) != gates.ids_digest(rows.filter("id = '1'"))
    good = {"schema": 1, "segmenter": "s", "implementation": "i", "annotators": ["w"], "provenance": "fresh", "output_sha256": "d"}
    assert gates.verify_provenance(good, "d", 1, "s", ["w"]) == []
    assert len(gates.verify_provenance(good | {"provenance": "old", "segmenter": "x"}, "e", 1, "s", ["w"])) == 3
    assert gates.verify_provenance(good | {"provenance": "old", "verification": {"sample_size": 5, "matched": 5}}, "d", 1, "s", ["w"]) == []
    assert gates.verify_report({"reader": "r", "margin": 1.0, "exclusions": "x", "contrast": "c"}, "r", 2.0, "x", "c") == ["margin: the report has 1.0, the stage 2.0"]
    assert gates.parse_family("H:tasks=a+b,ratios=0.2+0.5,reader=r,test=nfr", {"a", "b"})[1]["ratios"] == [0.2, 0.5]
    for bad in ("H:tasks=z,ratios=1,reader=r,test=nfr", "H:tasks=a", "H:tasks=a,ratios=1,reader=r,test=x"):
        with pytest.raises(ValueError):
            gates.parse_family(bad, {"a"})
    with pytest.raises(Exception, match="no cell"):
        gates.pooled_cbr(spark.createDataFrame([], "cbr double, n long")).collect()
    stem = spark.createDataFrame([("x/news_dev.jsonl",), ("wiki.jsonl",)], "p string")
    source, split = gates.file_stem(F.col("p"))
    assert [tuple(r) for r in stem.select(source, split).collect()] == [("news", "dev"), ("wiki", "all")]
    ids = spark.createDataFrame([("news-12",), ("vn:12",), ("zz",)], "k string").select(gates.guid(F.col("k"), ["news-", "vn:"]).alias("g")).collect()
    assert [r.g for r in ids] == ["12", "12", None]
    review = spark.createDataFrame([(0.3, "a", 0.2, 0.5, 1, 3), (0.3, "", 0.0, 0.95, 0, 0)], "ratio double, compressed string, unmatched_ratio double, keep_rate double, n_partial int, n_full int")
    assert gates.stage_problems({"reader": "r", "margin": 1.0, "files": {"a": "1", "b": "2", "c": "3"}}, "r", {1.0}, {"a": "1", "b": "x"}) == ["b is not as committed", "c is missing"]
    assert len(gates.stage_problems({}, "r", {1.0}, {})) == 2
    r = gates.teacher_review(review, ["ratio"]).first()
    assert (r.n, r.n_empty, r.rewritten, r.not_compressed, r.cbr) == (2, 1, 0.5, 0.5, 0.25) and math.isclose(r.keep_sd, 0.225)


def test_models(spark, tmp_path):
    """Windows by hand, calls that fail, rates, encoders and reports."""
    import numpy as np

    from condensa.operators import models, selection
    from condensa.sources import reports

    pieces = [1, 2, 1, 3, 1, 1, 2, 1]
    seen = []

    def score(a, b):
        seen.append((a, b))
        return [(0.0, float(a * 10 + k)) for k in range(sum(pieces[a:b]))]

    got = models.syllable_logits([3, 2, 3], pieces, score, most=8, longest=2)
    segments = [(0, 2), (2, 3), (3, 5), (5, 7), (7, 8)]  # sentences cut at two syllables
    want_windows = [(segments[a][0], segments[b - 1][1]) for a, b in selection.windows([sum(pieces[a:b]) for a, b in segments], 8)]
    assert seen == want_windows
    sums = [[] for _ in pieces]
    for a, b in want_windows:
        k = 0
        for i in range(a, b):
            sums[i].append(np.mean([a * 10 + k + j for j in range(pieces[i])]))
            k += pieces[i]
    assert got.tolist() == pytest.approx([np.mean(s) for s in sums])
    assert models.syllable_logits([1], [4], lambda a, b: [1.0, 3.0], most=2).tolist() == [2.0]  # cut to what fits
    assert models.word_logits(np.array([1.0, 3.0, 5.0]), [2, 1, 0]).tolist() == [2.0, 5.0, 0.0]

    calls = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "bad"), (4, None)], "id long, text string")

    def call(text, rate):
        if text == "bad":
            raise RuntimeError("no")
        return f"{text} {rate}"

    first = models.ask_teacher(calls, None, call, [0.3])
    assert sorted((r.id, r.compressed, r.error) for r in first.collect()) == [(1, "a b 0.3", None), (2, "a b 0.3", None), (3, None, "RuntimeError: no")]
    again = models.ask_teacher(calls, first.filter("compressed is not null"), call, [0.3])
    assert [r.id for r in again.collect()] == [3]
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, None)], "doc_id long, text string")
    made = models.compress_by_rate(docs, lambda t, r: " ".join(t.split()[: round(r * len(t.split()))]), 0.5).collect()
    assert [(r.used <= r.budget, r.text) for r in made] == [(True, "one two three"), (True, "")]
    words_ = models.segment(docs).orderBy("doc_id").collect()
    assert [w.text for w in words_[0].words][:2] == ["one", "two"] and words_[1].words is None
    pairs = spark.createDataFrame([(1, "a b", "b a c"), (2, None, "x")], "k long, pred string, gold string")
    assert sorted((r.k, round(r.f1, 6)) for r in models.similarity_f1(pairs, ["k"]).collect()) == [(1, 0.8), (2, 0.0)]
    assert models.joined_words is not None and words(spark, ["a b", "c"]).select(models.joined_words("words").alias("j")).first().j == "a_b c"

    table = spark.createDataFrame([("b", 0.5, None), ("a", 0.25, 3)], "m string, s double, n int")
    assert reports.markdown(table, ["m"], 2) == "| m | s | n |\n| --- | --- | --- |\n| a | 0.25 | 3 |\n| b | 0.50 | n/a |\n"
    with pytest.raises(ValueError):
        reports.markdown(table, ["m"], most=1)
    reports.write_report(table, str(tmp_path / "r"), ["m"])
    assert [r.m for r in spark.read.json(str(tmp_path / "r")).collect()] == ["a", "b"]
    ties = spark.createDataFrame([("g", "x", 1.0), ("g", "y", 1.0), ("h", "z", None)], "g string, m string, s double")
    assert [tuple(r) for r in reports.best_per_group(ties, ["g"], "s", "m").collect()] == [("g", "y", 1.0)]


def test_similarity_calls_stay_small(spark):
    """The encoder gets whole pairs of few words at once, so that the built-in vectors don't grow with the words of a batch; the scores are those of words held."""
    from condensa.operators import models

    text = lambda k, n: " ".join(f"w{k * 30 + i}" for i in range(n))
    rows = [(k, text(k, 60), text(k + 1, 60)) for k in range(40)] + [(40, None, "w1"), (41, "", ""), (42, "W1 w1, w2", "w1"), (43, text(0, 300), text(2, 300)), (44, text(9, 1), "x " * 100_000)]
    pairs = spark.createDataFrame(rows, "k long, pred string, gold string").coalesce(1)

    def small(texts):
        words = sum(map(len, texts))
        assert words <= 512 or len(texts) == 2, f"{words} words of {len(texts)} texts at once"
        return models.one_hot_encoder(texts)

    def held(a, b):
        a, b = ([w.strip(",") for w in (t or "").lower().split()][:256] for t in (a, b))
        p, r = (sum(w in y for w in x) / max(1, len(x)) for x, y in ((a, b), (b, a)))
        return 2 * p * r / (p + r) if p + r else 0.0

    want = {k: held(a, b) for k, a, b in rows}
    assert {r.k: r.f1 for r in models.similarity_f1(pairs, ["k"], small).collect()} == pytest.approx(want)
    assert {r.k: r.f1 for r in models.similarity_f1(pairs, ["k"], at_once=1).collect()} == pytest.approx(want)
    assert 0 < want[0] < 1 and want[42] == pytest.approx(0.8) and models.similarity_f1(pairs.limit(0), ["k"]).count() == 0
