"""That the operators do the whole of their job."""

import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from condensa.llm import chat, decontamination, queries, secret_scan

from .test_rest import leaks_by_hand


def test_chat_attention_read_back(spark):
    """What the query reads back holds position and ancestors, and wrong ones are errors."""
    tok = public_tokenizers.path("byte_bpe_50k.json")
    odd = [(c, t, "user", f"{t if t < 3 else c} word") for c in range(40) for t in range(2 + c % 6)]
    emission, _, leaves = chat.build_tree(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string"), tok)
    assert {"position", "ancestors"} <= set(emission.columns)
    assert emission.filter("size(ancestors) > 1").count() > 0
    assert chat.read_back(emission, leaves, tok).count() == 40
    for wrong in (emission.withColumn("position", F.col("position") + 1), emission.withColumn("ancestors", F.slice("ancestors", 2, 100))):
        with pytest.raises(Exception, match="position"):
            chat.read_back(wrong, leaves, tok).collect()


def test_windows_between_anchors(spark):
    """An item with an insertion and edits near both ends, whose best start is no anchor; halves swapped; cut at the ends."""
    w = [f"w{i}" for i in range(60)]
    edited = ["x", *w[1:30], "y", "z", *w[30:59], "v"]
    swapped = [*w[30:], "q", "r", *w[:30]]
    docs = [(i, " ".join([*(f"a{j}" for j in range(i)), *x, *(f"b{j}" for j in range(40 - i))])) for i, x in enumerate([edited, swapped, w, edited[3:], w[4:], w[:-5]])]
    docs += [(10, " ".join(edited)), (11, " ".join(w[3:])), (12, " ".join(w[:-3]))]
    items = [(1, " ".join(w)), (2, "one two three"), (3, " ".join(w[:20] * 3))]
    docs += [(20, " ".join([*w[2:20], *w[:20], "n", *w[:20], *w[:9]])), (21, "zero one two three four")]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert 0.8 <= got[0, 1] < 0.81
    want = leaks_by_hand(docs, items)
    assert got.keys() >= want.keys() and all(got[k] >= v - 1e-12 for k, v in want.items())


def test_short_and_broken_secrets(spark):
    """Values under 16 characters, with punctuation or without digits reach the forest and are redacted."""
    held = [
        ("password = Tr0ub4dor&3", "password = [SECRET]"),
        ("the password: hunter22 ok", "the password: [SECRET] ok"),
        ("api_key='abc!defg@hij#12' x", "api_key='[SECRET]' x"),
        ("password=letmeinplease", "password=[SECRET]"),
        ("token=QwxZrTplKmNbVcHgFdSaYuIo", "token=[SECRET]"),
        ("secret garden party", None),
        ("token economy", None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(held)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert [out[i] for i in range(len(held))] == [want or t for t, want in held]
    drawn = secret_scan.labelled_findings(800, seed=99)
    df = spark.createDataFrame([(t, y) for t, y in drawn], "text string, y int")
    assert secret_scan.with_candidates(df).filter("y = 1 and size(_c) = 0").count() == 0  # candidate recall


def test_clean_by_row(spark):
    """A leaking row goes whatever its doc_id, and takes no other row with it; columns of any name stay."""
    item, other = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = [(1, f"a b {item} c", "x", 1), (1, other, "x", 2), (None, item, "x", 3), (None, None, "x", 4), (2, "", None, 5), (3, item, "y", 6), (3, item, "y", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th string, item_id int")
    bench = spark.createDataFrame([(9, item), (8, None), (7, "")], "item_id long, text string")
    kept = decontamination.keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.item_id for r in kept.collect()) == [2, 4, 5]
    assert decontamination.keep_clean(docs, bench.filter("item_id = 8")).count() == 7
    assert decontamination.keep_clean(docs.limit(0), bench).count() == 0


def by_tree(forest, f):
    """Mean of the trees, walked."""

    def leaf(node):
        while not isinstance(node, float):
            node = node[2] if f[node[0]] <= node[1] else node[3]
        return node

    return sum(map(leaf, forest)) / len(forest)


def test_secret_forest_by_hand(spark, sf):
    """Every candidate of the documents: the score is that of the trees walked in Python, and planted secrets are found."""
    docs, forest = queries.table(spark, sf.replace("sf0.001", "sf0.01"), "documents"), secret_scan.train(spark)  # the smallest has none
    rows = secret_scan.with_candidates(docs).select("doc_id", F.posexplode_outer("_c").alias("place", "c")).filter("c is not null")
    want = {(r.doc_id, r.place): (r.s, by_tree(forest, r.f)) for r in rows.select("doc_id", "place", F.col("c.secret").alias("s"), secret_scan.features(F.col("c")).alias("f")).collect()}
    got = {(r.doc_id, r.place): r for r in secret_scan.findings(docs).collect()}
    assert got.keys() == want.keys() and all(abs(got[k].score - want[k][1]) < 1e-6 and got[k].length == len(want[k][0]) for k in got)
    planted = {(r.doc_id, s) for r in docs.collect() for s in re.findall(r'(?i)token = "([0-9a-f]{40})"', r.text or "")}
    found = {(k[0], want[k][0]) for k, r in got.items() if r.is_secret}
    assert planted and len(planted & found) >= 0.98 * len(planted) and len(found - planted) <= 0.05 * len(found) + 1


def test_secret_edges(spark):
    """Nulls, empty texts, repeated rows, an empty table, long texts and columns of any name."""
    key = "token = " + "0123456789abcdef" * 2 + "01234567"
    rows = [(1, key, "x"), (1, key, "x"), (None, key, None), (2, None, "x"), (3, "", "x"), (4, "word " * 200_000 + key, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place string")
    got = secret_scan.findings(docs).filter("is_secret").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 1), (False, 4), (True, 0)]
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns and out.count() == 6 and out.filter("text like '%0123456789abcdef%'").count() == 0
    assert secret_scan.findings(docs.limit(0)).count() == 0 and secret_scan.redact(docs.limit(0)).count() == 0
