"""Tests over all rows and replicates: exact tails, bootstraps by hand."""

import hashlib
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from condensa.plans import catalog


def orders(spark, path, counts):
    """A table of orders of which so many are F and low (a only), and O and high (b only), in each third by MD5."""
    spark.range(counts).select(
        F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"),
        F.when(F.col("id") % 21 < 10, "F").otherwise("O").alias("o_orderstatus"),
        F.when(F.col("id") % 21 < 10, 1.0).otherwise(200000.0).alias("o_totalprice"),
    ).write.parquet(f"{path}/orders.parquet")
    rows = spark.read.parquet(f"{path}/orders.parquet").selectExpr("cast(conv(substr(md5(cast(o_orderkey as string)), 1, 8), 16, 10) as bigint) % 3 as seed", "o_orderstatus = 'F' as f")
    return {r.seed: (r.a, r.n - r.a) for r in rows.groupBy("seed").agg(F.sum(F.col("f").cast("long")).alias("a"), F.count("*").alias("n")).collect()}


def test_mcnemar_all_pairs(spark, tmp_path):
    """Every order counts, and a seed of more than 4,000 discordant pairs stays."""
    for size in (60, 15000):
        want = orders(spark, str(tmp_path / str(size)), size)
        got = {r.seed: r for r in catalog.QUERIES["mcnemar_discordant"](spark, str(tmp_path / str(size))).collect()}
        assert got.keys() == want.keys()
        for seed, (a, b) in want.items():
            term, tails, done = 1, {}, 0  # whole numbers
            for k in range(max(a, b) + 1):
                done += term
                tails[k] = done
                term = term * (a + b - k) // (k + 1)
            assert (got[seed].only_a, got[seed].only_b) == (a, b) and tails[0] == comb(a + b, 0)
            assert abs(got[seed].two_sided - float(min(Fraction(1), Fraction(2 * tails[min(a, b)], 2 ** (a + b))))) < 2e-6
            assert abs(got[seed].a_flips_less - float(Fraction(tails[a], 2 ** (a + b)))) < 2e-6


def draws(seed, replicates, n):
    """A row a replicate, of places drawn."""
    return np.array([[int(hashlib.md5(f"{seed}|{b}|{k}".encode()).hexdigest()[:8], 16) % n for k in range(n)] for b in range(replicates)])


def test_all_replicates(spark, sf):
    """10,000 replicates, and 2,000 for the minimum detectable effect, as in the reference."""
    one = lambda name: catalog.QUERIES[name](spark, sf).first()
    cells = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_custkey % 40 as cluster", "double(o_orderstatus = 'F') - double(o_totalprice > 150000) as v")
    sums = sorted(tuple(r) for r in cells.groupBy("cluster").agg(F.sum("v"), F.count("*")).collect())
    s, c = np.array([x[1] for x in sums]), np.array([x[2] for x in sums])
    means = lambda seed, replicates: (lambda at: s[at].sum(1) / c[at].sum(1))(draws(seed, replicates, len(s)))
    m, r = means("1", 10_000), one("paired_cluster_bootstrap")
    assert (r.low, r.high, r.p_value) == pytest.approx((*np.percentile(m, [2.5, 97.5]), (m <= 0).mean()), abs=2e-6)
    r, lower = one("non_inferiority"), np.percentile(means("ni", 10_000), 5)
    assert r.lower == pytest.approx(lower, abs=2e-6) and r.passes == (lower > -0.02)
    assert one("mde_projected").mde_dev == pytest.approx(2.487 * means("mde", 2_000).std(), abs=2e-6)
    assert one("crossed_seed_cluster_bootstrap").n_replicates == 10_000
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").join(spark.read.parquet(f"{sf}/orders.parquet"), F.expr("o_orderkey = l_orderkey"))
    lines = lines.selectExpr("o_custkey % 40 as cluster", "double(l_quantity) as x", "double(l_extendedprice) as y").groupBy("cluster")
    x = np.array(sorted(tuple(r) for r in lines.agg(F.count("*"), F.sum("x"), F.sum("y"), F.sum(F.expr("x * y")), F.sum(F.expr("x * x"))).collect()), float)[:, 1:]
    w = x[draws("slope", 10_000, len(x))].sum(1)
    w = w / w[:, :1]
    slopes, r = (w[:, 3] - w[:, 1] * w[:, 2]) / (w[:, 4] - w[:, 1] ** 2), one("clustered_slope")
    assert (float(r.low), float(r.high)) == pytest.approx(tuple(np.percentile(slopes, [2.5, 97.5])), abs=2e-3)
