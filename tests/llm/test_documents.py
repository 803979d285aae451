"""Quality rules and SimHash near-duplicates against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from condensa.llm import components, quality, queries, simhash_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    line = "one two three four five six seven eight nine ten eleven twelve"
    texts = [None, "", " \n\t", "word", line + "\n" + line, line + " z\n" + line + " z\n\n" + line, "a " * 400, "x#y $z <b> | & %", "No\xa0split\x85here\x1cok", "Éa " + line, line.upper(), " ".join(map(str, range(3000)))]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(4, texts[4], "x", 1), (None, line, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, fp int")


def measures(t):
    w = WORD.findall(t or "")
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    fours = Counter(tuple(w[i : i + 4]) for i in range(len(w) - 3))
    wide = {j for i in range(len(w) - 3) if fours[tuple(w[i : i + 4])] > 1 for j in range(i, i + 4)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    longest, k = 0, 8  # the longest run of words that comes twice, by its length
    while k <= len(w) and len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) < len(w) - k + 1:
        longest, k = k, k + 1
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover), longest, len(wide)


def test_quality(spark, sf, odd):
    docs = queries.table(spark, sf, "documents")
    for df, of in ((docs, queries.op8_quality_rules(spark, sf)), (odd, quality.quality_features(odd))):
        texts = {r.doc_id: r.text for r in df.collect()}
        got = of.collect()
        assert len(got) == df.count()
        for r in got:
            n, *rest = want = measures(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.longest_repeat, r.n_covered_words) == want
            assert r.base_failed == (n < 20 or 100 * rest[3] > 30 * n)
            long = rest[4] > quality.LONGEST_WORDS and rest[4] > quality.LONGEST_SHARE * n
            assert r.kept == (not r.base_failed and rest[5] <= quality.MOST_COVERED * n and not long)
    kept = quality.keep_quality(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {11}


def test_repeats_many_texts():
    rng = np.random.default_rng(3)
    texts = [list(rng.integers(0, k, n)) for k, n in ((2, 60), (3, 200), (40, 300), (1, 77), (5, 0), (9, 8))]
    texts[2] = texts[2] * 2
    lens = np.array(list(map(len, texts)))
    cover, longest, wide = quality.repeats(np.concatenate(texts).astype(np.int64), lens)
    for t, c, m, k in zip(texts, cover, longest, wide, strict=True):
        want = measures(" ".join(map(str, t)))
        assert (c, m, k) == (want[4], want[5], want[6])


def test_method_decides(spark):
    """What the base rule lets pass and the method does not: short phrases over and over, and a long passage told twice."""
    own = [f"w{i}" for i in range(500)]
    texts = ["of " * 7 + "the " * 7 + "to " * 7 + "more " * 7, " ".join(own), " ".join(own[:60] + own[100:] + own[:60]), " ".join(own[:400] + own[:45])]
    again = [f"v{i}" for i in range(3)]
    texts.append(" ".join((again + [f"x{k}", f"y{k}"])[j] for k in range(30) for j in range(5)))  # three words recur, never four
    texts.append(" ".join([*(f"q{i}" for i in range(80)), *(" ".join(f"z{j}" for j in range(5)) + f" s{i}" for i in range(14))]))
    got = {r.doc_id: r for r in quality.quality_features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].base_failed for i in range(6)] == [False] * 6
    assert [got[i].kept for i in range(6)] == [False, True, False, True, True, False]


def test_quality_long_and_empty(spark):
    long = " ".join(f"{i:x}" for i in range(400_000)) + " a b c d e f g h i a b c d e f g h i"
    got = {r.doc_id: r for r in quality.quality_features(spark.createDataFrame([(1, long), (2, "a " * 300_000)], "doc_id long, text string")).collect()}
    assert got[1].n_repeat_words == 18 and got[1].longest_repeat == 9 and got[1].kept
    assert got[2].base_failed and got[2].longest_repeat == 299_999
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.quality_features(none).count() == 0 and quality.keep_quality(none).count() == 0


def slow_fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    """rows: (doc_id, fingerprint)."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i:]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least: dict = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [(d, format(f, "016x"), least.get(find(f))) for d, f in rows]


def key(r):
    return (r[0] is None, r[0] or 0, r[1])


def test_simhash(spark, sf, odd):
    for df in (queries.table(spark, sf, "documents"), odd):
        found = simhash_dedup.near_duplicates(df).select("doc_id", simhash_dedup.hex_fingerprint("fp").alias("h"), "component_id")
        want = slow_components([(r.doc_id, slow_fingerprint(r.text)) for r in df.collect()])
        assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    kept = simhash_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    # a row a class: without doc_id where no row of the class has one
    classes = {w[1]: w[2] for w in want}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted({(c is None, c or 0) for c in classes.values()})


def test_keep_one_by_row(spark):
    """Rows that share a doc_id and have different texts are documents of their own; equal rows are one; rows without id as well."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a, 1), (5, b, 2), (2, b, 3), (2, b, 3), (7, a, 4), (None, a, 5), (None, "c d e f", 6), (None, "c d e f", 7), (None, None, 8), (1, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, d int")
    assert sorted(r.d for r in simhash_dedup.keep_one(df).collect()) == [1, 3, 6, 9]
    assert sorted(r.d for r in simhash_dedup.keep_one(df.select("d", "text", "doc_id")).collect()) == [1, 3, 6, 9]
    assert simhash_dedup.keep_one(df.limit(0)).count() == 0 and simhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_dense_links(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(-(2**63), 2**63 - 1, 4)
    fps = {int(c) for c in centres}
    for c in centres:
        for _ in range(150):
            x = int(c)
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= -(1 << 63) if b == 63 else 1 << int(b)
            fps.add(x)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = components.connected_components(simhash_dedup.fingerprint_links(df)).collect()
    got = {r.node: r.root for r in roots}
    rows = [(i, f & (2**64 - 1)) for i, f in enumerate(sorted(fps))]
    want = {f: c for f, (_, _, c) in zip(sorted(fps), slow_components(rows), strict=True)}
    groups: dict = {}
    for f in fps:
        groups.setdefault(want[f], set()).add(got.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({got.get(f, f) for f in fps})


def test_cut_groups():
    """Groups that are cut have the same components as those that are not, whatever their bits."""
    rng = np.random.default_rng(9)
    for n_bits, n in ((9, 200), (14, 900), (33, 700), (64, 300)):
        base = int(rng.integers(-(2**62), 2**62))
        places = rng.choice(64, n_bits, replace=False)
        fps = np.unique(np.array([base] + [base ^ sum(int(x) << int(b) for x, b in zip(rng.integers(0, 2, n_bits), places, strict=True)) % 2**63 for _ in range(n)], np.int64))

        def parts(links):
            root = {int(f): int(f) for f in fps}

            def find(f):
                while root[f] != f:
                    root[f] = root[root[f]]
                    f = root[f]
                return f

            for a, b in links:
                assert a in root and b in root
                root[find(a)] = find(b)
            groups: dict = {}
            for f in root:
                groups.setdefault(find(f), set()).add(f)
            return sorted(map(sorted, groups.values()))

        assert parts(simhash_dedup.spanning_links(fps, 3, dense=20)) == parts(simhash_dedup.spanning_links(fps, 3, dense=10**6))


def test_components_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components.connected_components(links.limit(0)).count() == 0
