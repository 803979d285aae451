"""Paired comparisons over result rows: cluster bootstraps, tests, power, corrections, contrasts.

Every function takes a DataFrame and names of columns, and gives a DataFrame. Rows are summed a cluster (and a stratum) before
anything is drawn, so a replicate costs clusters, not rows; that sum is combined before its shuffle, so a hot cluster is no
hot task. Draws are the first eight hexadecimal digits of an MD5 of (seed, replicate, draw): the same in any engine. Numbering the
clusters is a window over one row a cluster.

Nulls: rows whose value is null are left out; a null cluster is a cluster. Fewer than two clusters are an error. An empty table is
one as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

N_BOOT, N_BOOT_MDE = 10_000, 2_000
#: Quantiles of the normal distribution by error and by power.
Z_ALPHA, Z_POWER = {0.05: 1.645, 0.025: 1.960, 0.01: 2.326}, {0.8: 0.842, 0.9: 1.282}


def _md5_int(x: Column) -> Column:
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("bigint")


def _numbered(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """keys (one row a key) with place (from 0, in the order of key), and how many; fewer than two are an error."""
    n = keys.count()
    if n < 2:
        raise ValueError("a bootstrap needs two clusters at least")
    return keys.withColumn("place", F.row_number().over(Window.orderBy(key)) - 1), n


def _draws(keys: DataFrame, n: int, seed: str, n_boot: int) -> DataFrame:
    """b, place: n draws a replicate. A range of numbers, so the rows are made where they are used."""
    own = keys.sparkSession.range(n_boot * n).select(F.expr(f"id div {n}").alias("b"), (F.col("id") % n).alias("k"))
    return own.select("b", (_md5_int(F.concat(F.lit(f"{seed}|"), F.col("b").cast("string"), F.lit("|"), F.col("k").cast("string"))) % n).alias("place"))


def _sums(df: DataFrame, value: str | Column, by: list[str]) -> DataFrame:
    v = F.expr(value) if isinstance(value, str) else value
    return df.select(*by, v.cast("double").alias("_v")).filter("_v is not null").groupBy(*by).agg(F.sum("_v").alias("s"), F.count(F.lit(1)).alias("c"))


def cluster_bootstrap(df: DataFrame, value: str | Column, cluster: str, seed: str = "1", n_boot: int = N_BOOT) -> DataFrame:
    """b, m: the mean of value in each replicate of as many clusters drawn with replacement."""
    own, n = _numbered(_sums(df, value, [cluster]), cluster)
    drawn = _draws(df, n, seed, n_boot).join(own.select("place", "s", "c"), "place")
    return drawn.groupBy("b").agg((F.sum("s") / F.sum("c")).alias("m"))


def crossed_bootstrap(df: DataFrame, value: str | Column, cluster: str, stratum: str, seeds: tuple[str, str] = ("c", "s"), n_boot: int = N_BOOT) -> DataFrame:
    """b, m: as cluster_bootstrap, with a draw of strata (training seeds) and one of clusters that all strata share."""
    cell = _sums(df, value, [stratum, cluster])

    def weights(key: str, seed: str) -> DataFrame:
        own, n = _numbered(cell.select(key).distinct(), key)
        return _draws(df, n, seed, n_boot).join(own.select("place", key), "place").groupBy("b", key).count()

    wc = weights(cluster, seeds[0]).withColumnRenamed("count", "wc")
    ws = weights(stratum, seeds[1]).withColumnRenamed("count", "ws")
    w = F.col("wc") * F.col("ws")
    return wc.join(ws, "b").join(cell, [cluster, stratum]).groupBy("b").agg((F.sum(w * F.col("s")) / F.sum(w * F.col("c"))).alias("m"))


def _boot(df: DataFrame, value, cluster: str, stratum: str | None, seed: str, n_boot: int) -> DataFrame:
    return cluster_bootstrap(df, value, cluster, seed, n_boot) if stratum is None else crossed_bootstrap(df, value, cluster, stratum, n_boot=n_boot)


def _point(df: DataFrame, value, cluster: str) -> DataFrame:
    own = _sums(df, value, [cluster])
    return own.agg((F.sum("s") / F.sum("c")).alias("diff"), F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_clusters"))


def _interval(boot: DataFrame, tail: Column) -> DataFrame:
    return boot.agg(F.count(F.lit(1)).alias("n_replicates"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.avg(tail.cast("double")).alias("p_value"))


def paired_test(df: DataFrame, a: str, b: str, cluster: str, stratum: str | None = None, seed: str = "1", n_boot: int = N_BOOT) -> DataFrame:
    """diff, n_rows, n_clusters, n_replicates, low, high (95 %), p_value (share of replicates at or below 0) of a - b."""
    value = F.col(a) - F.col(b)
    return _point(df, value, cluster).crossJoin(_interval(_boot(df, value, cluster, stratum, seed, n_boot), F.col("m") <= 0))


def flip_rate_test(df: DataFrame, flips_a: str, flips_b: str, cluster: str, stratum: str | None = None, seed: str = "1", n_boot: int = N_BOOT) -> DataFrame:
    """As paired_test for "a flips less often than b": p_value is the share of replicates at or above 0."""
    value = F.col(flips_a).cast("double") - F.col(flips_b).cast("double")
    return _point(df, value, cluster).crossJoin(_interval(_boot(df, value, cluster, stratum, seed, n_boot), F.col("m") >= 0))


def non_inferiority(df: DataFrame, a: str, b: str, cluster: str, margin: float, stratum: str | None = None, seed: str = "ni", n_boot: int = N_BOOT) -> DataFrame:
    """lower (fifth percentile of a - b) and passes: it lies above -margin."""
    boot = _boot(df, F.col(a) - F.col(b), cluster, stratum, seed, n_boot)
    return boot.agg(F.percentile("m", F.lit(0.05)).alias("lower")).withColumn("passes", F.col("lower") > -margin)


def minimum_detectable_effect(df: DataFrame, a: str, b: str, cluster: str, clusters_test: int | Column | None = None, alpha: float = 0.05, power: float = 0.8, stratum: str | None = None, seed: str = "mde", n_boot: int = N_BOOT_MDE) -> DataFrame:
    """mde_dev, and mde_test for so many clusters. Errors and powers that have no quantile here are errors."""
    z = Z_ALPHA[alpha] + Z_POWER[power]
    value = F.col(a) - F.col(b)
    own = _boot(df, value, cluster, stratum, seed, n_boot).agg((F.lit(z) * F.stddev_pop("m")).alias("mde_dev")).crossJoin(_point(df, value, cluster))
    n = F.col("n_clusters") if clusters_test is None else F.lit(clusters_test) if isinstance(clusters_test, int) else clusters_test
    return own.select("mde_dev", (F.col("mde_dev") * F.sqrt(F.col("n_clusters") / n)).alias("mde_test"), "n_clusters")


def clustered_slope(df: DataFrame, x: str, y: str, cluster: str, seed: str = "slope", n_boot: int = N_BOOT) -> DataFrame:
    """slope, low, high of y on x; rows of a cluster are drawn together. Replicates without variance in x are left out."""
    own = df.select(cluster, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna(subset=["_x", "_y"])
    terms = {"n": F.lit(1.0), "x": F.col("_x"), "y": F.col("_y"), "xy": F.col("_x") * F.col("_y"), "xx": F.col("_x") * F.col("_x")}
    moments = own.groupBy(cluster).agg(*[F.sum(v).alias(f"m_{k}") for k, v in terms.items()])
    m = lambda k: F.sum(f"m_{k}") / F.sum("m_n")
    slope = F.when(m("xx") - m("x") * m("x") > 0, (m("xy") - m("x") * m("y")) / (m("xx") - m("x") * m("x")))
    numbered, n = _numbered(moments, cluster)
    boot = _draws(df, n, seed, n_boot).join(numbered.drop(cluster), "place").groupBy("b").agg(slope.alias("s"))
    return moments.agg(slope.alias("slope")).crossJoin(boot.agg(F.percentile("s", F.lit(0.025)).alias("low"), F.percentile("s", F.lit(0.975)).alias("high")))


def holm(df: DataFrame, p: str, member: str | None = None, family: list[str] | None = None) -> DataFrame:
    """df with `adjusted`: step-down p-values within the family (of the members; others null)."""
    by = family or []
    inside = F.coalesce(F.col(member), F.lit(False)) if member else F.lit(True)
    own = df.withColumn("_in", inside & F.col(p).isNotNull())
    ranked = Window.partitionBy("_in", *by).orderBy(p)
    left = F.count(F.lit(1)).over(Window.partitionBy("_in", *by)) - F.row_number().over(ranked) + 1
    own = own.withColumn("_step", F.least(F.lit(1.0), left * F.col(p)))
    return own.withColumn("adjusted", F.when(F.col("_in"), F.max("_step").over(ranked.rowsBetween(Window.unboundedPreceding, 0)))).drop("_in", "_step")


def factorial_contrasts(df: DataFrame, key: str, unit: str, label: str, score: str) -> DataFrame:
    """key, unit_effect, label_effect, interaction of keys that have one score (or a mean) in each of the four cells of two 0/1 factors."""
    at = lambda u, v: F.avg(F.when((F.col(unit) == u) & (F.col(label) == v), F.col(score)))
    w = df.groupBy(key).agg(at(0, 0).alias("s00"), at(0, 1).alias("s01"), at(1, 0).alias("s10"), at(1, 1).alias("s11")).dropna(subset=["s00", "s01", "s10", "s11"])
    return w.selectExpr(key, "(s10 + s11 - s00 - s01) / 2 as unit_effect", "(s01 + s11 - s00 - s10) / 2 as label_effect", "s11 - s10 - s01 + s00 as interaction")


def seed_deviation(df: DataFrame, value: str, by: list[str], seed: str) -> DataFrame:
    """by, mean, seed_sd: sample deviation of the seeds' means (null for one seed)."""
    per = df.groupBy(*by, seed).agg(F.avg(value).alias("_m"), F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return per.groupBy(*by).agg((F.sum("_s") / F.sum("_n")).alias("mean"), F.stddev_samp("_m").alias("seed_sd"))


def effect_cells(df: DataFrame, cells: list[str], a: str, b: str, cluster: str, seed_sd: str, margin: float, seed: str = "mde", n_boot: int = N_BOOT_MDE) -> DataFrame:
    """One row a cell of `cells`: mde, seed_sd (a column that is constant in a cell) and passes: the margin is above both. All
    cells are drawn in one plan: a cell's clusters are numbered within it."""
    own = df.select(*cells, cluster, seed_sd, (F.col(a) - F.col(b)).cast("double").alias("_v")).filter("_v is not null")
    sums = own.groupBy(*cells, cluster).agg(F.sum("_v").alias("s"), F.count(F.lit(1)).alias("c"))
    numbered = sums.withColumn("place", F.row_number().over(Window.partitionBy(*cells).orderBy(cluster)) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*cells)))
    spread = numbered.repartition(*cells, "place")
    key = F.concat(F.lit(f"{seed}|"), F.col("b").cast("string"), F.lit("|"), F.col("place").cast("string"))
    drawn = spread.select(*cells, "place", "n", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b")).select("b", *cells, (_md5_int(key) % F.col("n")).alias("place"))
    boot = drawn.join(numbered.select(*cells, "place", "s", "c"), [*cells, "place"]).groupBy(*cells, "b").agg((F.sum("s") / F.sum("c")).alias("m"))
    mde = boot.groupBy(*cells).agg((F.lit(Z_ALPHA[0.05] + Z_POWER[0.8]) * F.stddev_pop("m")).alias("mde"))
    return mde.join(own.groupBy(*cells).agg(F.max(seed_sd).alias("seed_sd")), cells).withColumn("passes", (F.lit(margin) > F.col("mde")) & (F.lit(margin) > F.coalesce("seed_sd", F.lit(0.0))))
