"""Gates over result rows, detectors' scores, guards of keys, splits, sheets and provenance.

Result rows: task, reader, method, ratio, seed, id, cluster, score, prediction, n_tokens_original, n_tokens_compressed, budget. A gate is
a DataFrame with what it looked at and `passed`; a guard raises and names what it found. Thresholds are parameters; the defaults
are fixed values of the protocol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condensa.sources.jsonl import hash_sample

MIN_CBR, MIN_FLIPS, MIN_NEGATED_PAIRS, MAX_SPEARMAN, WITHIN, MAX_BLANK = 0.05, 0.05, 300, 0.9, 0.05, 0.5
MIN_PRECISION, MIN_PREDICTED, DEVIATION, PAIR_GAP, EMPTY_LIMIT = 0.95, 50, 0.05, 0.05, 0.02


def _count(c: Column) -> Column:
    return F.sum(c.cast("long"))


def tokens_per_budget() -> Column:
    return F.when(F.col("budget") > 0, F.col("n_tokens_compressed") / F.col("budget"))


def deviates(ratio: Column, most: float = DEVIATION) -> Column:
    return F.coalesce(F.abs(ratio - 1) > most + 1e-12, F.lit(False))


def adherence(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, tokens_per_budget (mean of the defined ones), share_deviating (of those), empty_share, empty_flag."""
    r = tokens_per_budget()
    empty = F.avg((F.coalesce("prediction", F.lit("")) == "").cast("double"))
    return rows.groupBy(*by).agg(F.avg(r).alias("tokens_per_budget"), F.avg(F.when(r.isNotNull(), deviates(r).cast("double"))).alias("share_deviating"), empty.alias("empty_share"), (empty > EMPTY_LIMIT).alias("empty_flag"))


def pair_gaps(rows: DataFrame, pairs: list[tuple[str, str]], by: list[str], most: float = PAIR_GAP) -> DataFrame:
    """For each pair of methods, per `by`: their mean tokens a budget, the difference, and whether it is too large to compare them."""
    own = rows.groupBy(*by, "method").agg(F.avg(tokens_per_budget()).alias("r"))
    asked = rows.sparkSession.createDataFrame(pairs, "a string, b string")
    one, two = own.withColumnsRenamed({"method": "a", "r": "ratio_a"}), own.withColumnsRenamed({"method": "b", "r": "ratio_b"})
    return asked.join(one, "a").join(two, ["b", *by]).select("a", "b", *by, "ratio_a", "ratio_b", (F.abs(F.col("ratio_a") - F.col("ratio_b")) > most).alias("too_far"))


def means(rows: DataFrame) -> DataFrame:
    return rows.groupBy("task", "method", "ratio").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))


def _versus(rows: DataFrame, a: str, b: str) -> DataFrame:
    """task, ratio, diff: mean difference over the ids that both have."""
    one = rows.filter(F.col("method") == a).select("task", "ratio", "id", F.col("score").alias("x"))
    two = rows.filter(F.col("method") == b).select("task", "ratio", "id", F.col("score").alias("y"))
    return one.join(two, ["task", "ratio", "id"]).groupBy("task", "ratio").agg(F.avg(F.col("x") - F.col("y")).alias("diff"))


def better_somewhere(rows: DataFrame, a: str, b: str, least: int = 1) -> DataFrame:
    """Does a beat b on so many of the cells of task and ratio?"""
    return _versus(rows, a, b).agg(F.count(F.lit(1)).alias("cells"), F.coalesce(_count(F.col("diff") > 0), F.lit(0)).alias("wins")).withColumn("passed", F.col("wins") >= least)


def teacher_gate(rows: DataFrame, teacher: str, baseline: str, ratio: float, least: int = 2) -> DataFrame:
    """The same by task at one ratio."""
    return better_somewhere(rows.filter(F.round("ratio", 3) == round(ratio, 3)), teacher, baseline, least)


def best_of_classes(rows: DataFrame, tokens: list[str], sentences: list[str], ratio: float, within: float = WITHIN) -> DataFrame:
    """Per task the best method of each class (the larger name of two that tie), their gap, and whether token methods are within reach of sentence methods; tasks
    that lack a class are left out. `passed` of the majority is the same in every row."""
    m = means(rows.filter(F.round("ratio", 3) == round(ratio, 3)))
    best = lambda names, c: F.max(F.when(F.col("method").isin(*names), F.struct("mean", "method"))).alias(c)
    own = m.groupBy("task").agg(best(tokens, "t"), best(sentences, "s")).filter("t is not null and s is not null")
    own = own.select("task", F.col("t.method").alias("token"), F.col("s.method").alias("sentence"), (F.col("t.mean") - F.col("s.mean")).alias("gap")).withColumn("near", F.col("gap") >= -within)
    verdict = own.agg((2 * _count(F.col("near")) > F.count(F.lit(1))).alias("passed"))
    return own.crossJoin(F.broadcast(verdict))  # one row


def probe_flips(rows: DataFrame, task: str, none: str = "none", probe: str = "probe_negation", least: float = MIN_FLIPS) -> DataFrame:
    """n_probe, n_changed (texts that the probe shortened), flips: share of those whose prediction is another than uncompressed; passed."""
    own = rows.filter(F.col("task") == task)
    base = own.filter(F.col("method") == none).select("id", F.col("prediction").alias("p0"))
    got = own.filter(F.col("method") == probe).join(base, "id", "left")
    changed = F.col("n_tokens_compressed") < F.col("n_tokens_original")
    flip = F.avg(F.when(changed, (~F.col("prediction").eqNullSafe(F.col("p0"))).cast("double")))
    return got.agg(F.count(F.lit(1)).alias("n_probe"), _count(changed).alias("n_changed"), flip.alias("flips")).withColumn("passed", F.coalesce(F.col("flips") >= least, F.lit(False)))


def negated_pairs(premises: DataFrame, pairs: DataFrame, least: int = MIN_NEGATED_PAIRS) -> DataFrame:
    """premises: id, cluster, negated. pairs: id, cluster; nothing else is read. Negated clusters, all clusters, pairs in negated ones, all pairs, passed."""
    hit = premises.filter("negated").select("cluster").distinct().withColumn("hit", F.lit(True))
    own = pairs.select("id", "cluster").join(hit, "cluster", "left")
    clusters = hit.agg(F.count(F.lit(1)).alias("negated_clusters"))
    return own.agg(F.count_distinct("cluster").alias("clusters"), F.coalesce(_count(F.col("hit")), F.lit(0)).alias("negated_pairs"), F.count(F.lit(1)).alias("pairs")).crossJoin(F.broadcast(clusters)).withColumn("passed", F.col("negated_pairs") >= least)


def pooled_cbr(cells: DataFrame, least: float = MIN_CBR) -> DataFrame:
    """cells: cbr, n. The mean by n, and passed. No cell is an error."""
    own = cells.agg(F.sum(F.col("cbr") * F.col("n")).alias("s"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells"))
    own = own.withColumn("cells", F.when(F.col("cells") > 0, F.col("cells")).otherwise(F.raise_error(F.lit("no cell to pool"))))
    return own.select("cells", "n", F.expr("try_divide(s, n)").alias("cbr")).withColumn("passed", F.coalesce(F.col("cbr") >= least, F.lit(False)))


def choose_arm(comparisons: DataFrame, scored: str, package: str) -> DataFrame:
    """The scored arm if every comparison passed, else the package's; the scored one where none was made."""
    return comparisons.agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("passed", F.lit(False))).alias("ok")).select(F.when((F.col("n") == 0) | F.col("ok"), scored).otherwise(package).alias("method"), (F.col("n") > 0).alias("audited"))


def rank_gate(profiles: DataFrame, most: float = MAX_SPEARMAN, least: int = 2) -> DataFrame:
    """profiles: name, spearman. Enough of them below."""
    return profiles.agg(F.coalesce(_count(F.col("spearman") < most), F.lit(0)).alias("below")).withColumn("passed", F.col("below") >= least)


def precheck(rows: DataFrame, none: str = "none", most: float = MAX_BLANK) -> DataFrame:
    """task, method, mean, blank_share, failed: uncompressed texts score nothing, or most answers are blank."""
    own = rows.groupBy("task", "method").agg(F.avg("score").alias("mean"), F.avg((F.trim(F.coalesce("prediction", F.lit(""))) == "").cast("double")).alias("blank_share"))
    return own.withColumn("failed", ((F.col("method") == none) & (F.col("mean") == 0)) | (F.col("blank_share") > most))


def prf(rows: DataFrame, gold: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision_, recall, f1 (0 where nothing is there to count)."""
    g, p = F.coalesce(F.col(gold), F.lit(False)), F.coalesce(F.col(predicted), F.lit(False))
    own = rows.groupBy(*(by or [])).agg(*[F.coalesce(_count(c), F.lit(0)).alias(n) for n, c in (("tp", g & p), ("fp", ~g & p), ("fn", g & ~p))])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return own.withColumns({"precision_": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


def detector_by_tier(words: DataFrame, tiers=("T1", "T2", "T3")) -> DataFrame:
    """words: gold and predicted tier (null for none). prf of each tier."""
    own = words.withColumn("tier", F.explode(F.lit(list(tiers)))).select("tier", F.coalesce(F.col("gold") == F.col("tier"), F.lit(False)).alias("g"), F.coalesce(F.col("predicted") == F.col("tier"), F.lit(False)).alias("p"))
    return prf(own, "g", "p", ["tier"])


def probe_audit(sheet: DataFrame) -> DataFrame:
    """sheet: edited (the probe changed it), gold (it negates). Precision, recall only if unedited rows were looked at, passed."""
    own = prf(sheet, "gold", "edited").crossJoin(F.broadcast(sheet.agg(_count(~F.col("edited")).alias("n_unedited"))))
    own = own.withColumn("recall", F.when(F.coalesce(F.col("n_unedited"), F.lit(0)) > 0, F.col("recall")))
    return own.withColumn("passed", (F.col("precision_") >= MIN_PRECISION) & (F.col("tp") + F.col("fp") >= MIN_PREDICTED))


def teacher_review(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows: compressed, unmatched_ratio, keep_rate, n_partial, n_full. Counts and shares of what a teacher made, per `by`."""
    r = lambda c: F.avg(c.cast("double"))
    own = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), _count(F.coalesce("compressed", F.lit("")) == "").alias("n_empty"), r(F.col("unmatched_ratio") > 0.10).alias("rewritten"), r(F.col("keep_rate") > 0.90).alias("not_compressed"), F.avg("keep_rate").alias("keep_mean"), F.stddev_pop("keep_rate").alias("keep_sd"), F.sum("n_partial").alias("p"), F.sum("n_full").alias("f"))
    return own.withColumn("cbr", F.expr("try_divide(p, p + f)")).drop("p", "f")


def mask_comparison(masks: DataFrame, by: list[str], least_exact: float = 0.95, most_gap: float = 0.5) -> DataFrame:
    """masks: a, b (arrays of the same length), partial_a, full_a, partial_b, full_b. Exact masks, agreement a syllable, gap of broken words
    in points, passed."""
    same = F.aggregate(F.zip_with("a", "b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    own = masks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("exact"), (F.sum(same) / F.sum(F.size("a"))).alias("agreement"), *[F.sum(c).alias(c) for c in ("partial_a", "full_a", "partial_b", "full_b")])
    rate = lambda s: F.expr(f"coalesce(try_divide(partial_{s}, partial_{s} + full_{s}), 0)")
    own = own.withColumn("gap_points", 100 * F.abs(rate("a") - rate("b")))
    return own.select(*by, "n", "exact", "agreement", "gap_points", ((F.col("exact") >= least_exact) & (F.col("gap_points") <= most_gap)).alias("passed"))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_seeds(rows: DataFrame, trained: str, expected: list[int], by=("task", "reader", "method", "ratio")) -> DataFrame:
    """Cells of trained methods whose seeds are not those expected, with the seeds they have. No row means that all is well."""
    own = rows.filter(F.col("method").rlike(trained)).groupBy(*by).agg(F.sort_array(F.collect_set("seed")).alias("seeds"))
    return own.filter(F.col("seeds") != F.lit(sorted(expected)))


def one_value(rows: DataFrame, column: str) -> str:
    """The one value of a column; more or none is an error. At most two reach the driver."""
    got = [r[0] for r in rows.select(column).distinct().limit(2).collect()]
    if len(got) != 1:
        raise ValueError(f"one {column} was expected, found {got or 'none'}")
    return got[0]


def dev_only(split: str) -> None:
    if split != "dev":
        raise ValueError(f"this reads the dev split only, not {split}")


def exclusion_list(files: DataFrame, first: int) -> DataFrame:
    """files: stem, task, row_id, id, cluster. The first rows of each file by row_id: stem, task, id, cluster. What was ever shown is
    the longest such prefix."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("stem").orderBy("row_id"))
    return files.withColumn("_k", nth).filter(F.col("_k") <= first).select("stem", "task", "id", "cluster")


def excluded_ids(exclusions: DataFrame, stem: str) -> DataFrame:
    """Ids of one stem; an unknown stem is an error."""
    own = exclusions.filter(F.col("stem") == stem)
    if own.limit(1).count() == 0:
        raise ValueError(f"no exclusions are known for {stem}")
    return own.select("task", "id")


def without_excluded(rows: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Rows whose (task, id) is not excluded."""
    return rows.join(exclusions.select("task", "id").distinct(), ["task", "id"], "left_anti").select(rows.columns)


def content_fingerprint(columns: list[str]) -> Column:
    """SHA-256 of the JSON of the columns by name; nulls are written."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def unseen_guard(rows: DataFrame, unseen: DataFrame, columns: list[str], override: bool = False) -> DataFrame:
    """rows, or an error if one of them has the content of a row that has to stay unseen."""
    hits = rows.select(content_fingerprint(columns).alias("f")).join(unseen.select(content_fingerprint(columns).alias("f")).distinct(), "f", "left_semi").count()
    if hits and not override:
        raise ValueError(f"{hits} rows belong to the unseen test set")
    return rows


def ids_digest(ids: DataFrame, key: str = "id") -> str:
    """SHA-256 over the sorted distinct ids' own digests, folded in groups of hash prefix so that no list of ids is gathered."""
    own = ids.select(F.sha2(F.col(key).cast("string"), 256).alias("h")).distinct().groupBy(F.substring("h", 1, 3).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("d"))
    return own.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), ""), 256).alias("d")).first().d  # 4,096 groups at most


def verify_report(said: dict, reader: str, margin: float, digest: str, contrast: str) -> list[str]:
    """What a stored report says otherwise than the stage that uses it."""
    now = {"reader": reader, "margin": margin, "exclusions": digest, "contrast": contrast}
    return [f"{k}: the report has {said.get(k)!r}, the stage {v!r}" for k, v in now.items() if said.get(k) != v]


#: Fields that a segmentation's manifest has to have.
PROVENANCE = ("schema", "segmenter", "implementation", "annotators", "provenance", "output_sha256")


def verify_provenance(manifest: dict, digest: str, schema: int, segmenter: str, annotators: list[str]) -> list[str]:
    """What speaks against trusting a segmentation: missing fields, other tools, a changed file, or neither fresh nor verified."""
    out = [f"no {k}" for k in PROVENANCE if manifest.get(k) is None]
    wanted = {"schema": schema, "segmenter": segmenter, "annotators": annotators, "output_sha256": digest}
    out += [f"{k} is {manifest.get(k)!r}, not {v!r}" for k, v in wanted.items() if manifest.get(k) is not None and manifest.get(k) != v]
    checked = manifest.get("verification") or {}
    if manifest.get("provenance") != "fresh" and not (checked.get("sample_size") and checked.get("matched") == checked.get("sample_size")):
        out.append("neither fresh nor verified by a sample that matched")
    return out


def reverify_sample(rows: DataFrame, again: Column, stored: str, n: int, seed: int = 0) -> DataFrame:
    """sample_size, matched, passed: `again` (the segmentation of a row's text, made now) against the stored one on n rows in hash order."""
    own = hash_sample(rows, n, "id", seed).select((again.eqNullSafe(F.col(stored))).alias("same"))
    return own.agg(F.count(F.lit(1)).alias("sample_size"), F.coalesce(_count(F.col("same")), F.lit(0)).alias("matched")).withColumn("passed", F.col("sample_size") == F.col("matched"))


def blind_sheet(rows: DataFrame, n: int, flag: str, seed: int = 0, version: str = "blind-v1") -> DataFrame:
    """Of each source n rows with the flag and n without, in hash order, without the flag: id, source, sheet, text, gold (empty)."""
    some = hash_sample(rows, n, "id", seed, ["source", flag])
    return some.select("id", "source", F.lit(version).alias("sheet"), "text", F.lit(None).cast("boolean").alias("gold"))


def sheet_problems(sheet: DataFrame, version: str = "blind-v1") -> DataFrame:
    """problem, n: wrong sheets, no annotator, open labels, repeated rows. No row means that the sheet can be used."""
    own = sheet.withColumn("copies", F.count(F.lit(1)).over(_over(["source", "id"])))
    what = F.array_compact(F.array(F.when(~F.col("sheet").eqNullSafe(F.lit(version)), "wrong sheet"), F.when(F.coalesce("annotator", F.lit("")) == "", "no annotator"), F.when(F.col("gold").isNull(), "open label"), F.when(F.col("copies") > 1, "repeated")))
    return own.select(F.explode_outer(what).alias("problem")).filter("problem is not null").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def _over(keys: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def required_coverage(rows: DataFrame, required: list[tuple[str, str]]) -> DataFrame:
    """source, split, n_rows, n_blank, missing for every required pair, whether or not the data know it."""
    need = rows.sparkSession.createDataFrame(required, "source string, split string")
    have = rows.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n_rows"), _count(F.coalesce("context", F.lit("")) == "").alias("n_blank"))
    return need.join(have, ["source", "split"], "left").withColumn("missing", F.col("n_rows").isNull()).fillna(0, ["n_rows", "n_blank"])


def file_stem(path: Column) -> tuple[Column, Column]:
    """(source, split) of a file's stem: at its first underscore; without one the split is "all"."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[A-Za-z0-9.]+)?$", 1)
    return F.substring_index(stem, "_", 1), F.when(F.contains(stem, F.lit("_")), F.regexp_extract(stem, r"^[^_]*_(.*)$", 1)).otherwise("all")


def guid(key: Column, prefixes: list[str]) -> Column:
    """What follows one of the prefixes, else null."""
    return F.nullif(F.regexp_extract(key, f"^(?:{'|'.join(prefixes)})(.+)$", 1), F.lit(""))


def parse_family(spec: str, tasks: set[str]) -> tuple[str, dict]:
    """NAME:tasks=a+b,ratios=x+y,reader=r,test=metric|nfr as (name, options). Unknown fields, tasks and tests are errors."""
    name, _, rest = spec.partition(":")
    given = dict(x.split("=", 1) for x in rest.split(",") if x)
    if not name or set(given) != {"tasks", "ratios", "reader", "test"}:
        raise ValueError(f"a family needs a name, tasks, ratios, reader and test: {spec}")
    own = {"tasks": given["tasks"].split("+"), "ratios": [float(x) for x in given["ratios"].split("+")], "reader": given["reader"], "test": given["test"]}
    if not set(own["tasks"]) <= tasks or own["test"] not in ("metric", "nfr"):
        raise ValueError(f"unknown task or test: {spec}")
    return name, own


#: Above these a teacher's text is rewritten, or not compressed.
MOST_UNMATCHED, MOST_KEPT = 0.10, 0.90


def distillation_reason() -> Column:
    """Why a label pair (known, segmented, compressed, unmatched_ratio, keep_rate) is left out, or "kept"; the first reason that holds."""
    empty = F.coalesce("compressed", F.lit("")) == ""
    return (
        F.when(~F.col("known"), "not a paragraph").when(~F.col("segmented"), "no segmentation")
        .when(empty | (F.col("unmatched_ratio") > MOST_UNMATCHED), "rewritten").when(F.col("keep_rate") > MOST_KEPT, "not compressed").otherwise("kept")
    )


def distillation_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, reason, n, and of the pairs with that reason the mean broken-word share a pair (cbr), the pooled one, and the mean keep rate."""
    own = rows.withColumn("reason", distillation_reason()).withColumn("_cbr", F.expr("try_divide(n_partial, n_partial + n_full)"))
    got = own.groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"), F.avg("_cbr").alias("cbr_mean"), F.sum("n_partial").alias("p"), F.sum("n_full").alias("f"), F.avg("keep_rate").alias("keep_mean"))
    return got.withColumn("cbr_pooled", F.expr("try_divide(p, p + f)")).drop("p", "f")


def stage_problems(config: dict, primary: str, margins: set[float], digests: dict[str, str]) -> list[str]:
    """What keeps a test stage from starting: another reader than the primary one, a margin that was not registered, files that are missing or
    changed. config: reader, margin, files (name to digest as committed); digests: those of the files now."""
    out = [] if config.get("reader") == primary else [f"reader {config.get('reader')!r} is not the primary one"]
    out += [] if config.get("margin") in margins else [f"margin {config.get('margin')!r} was not registered"]
    return out + [f"{name} is {'missing' if name not in digests else 'not as committed'}" for name, d in sorted(config.get("files", {}).items()) if digests.get(name) != d]
