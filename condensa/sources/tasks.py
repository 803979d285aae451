"""Task sources: raw rows in, rows of a task's schema (see jsonl.TASKS) out, with what was dropped and why; then the prompts, the
parsing of answers and their scores by task.

All of it is Columns and joins on keys. Samples go by hash order (see jsonl.hash_sample), so they are the same in any engine.
Nulls: a row without what its task needs is dropped and counted as such; nothing else is dropped silently. Repeated rows are rows each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condensa.functions import text as T

from .jsonl import hash_sample

LETTERS = ("A", "B", "C", "D")
#: Labels of the inference task, and metrics by task.
NLI_LABELS = ("entailment", "contradiction", "neutral", "other")
MAIN_METRIC = {"summarization": "rougeL", "nli": "accuracy", "choice": "accuracy", "qa": "f1", "math": "accuracy", "long": "recall"}
MAX_NEW_TOKENS = {"summarization": 256, "nli": 32, "choice": 32, "qa": 32, "math": 320, "long": 64}


def _words(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))


def is_poem(x: Column) -> Column:
    """Four lines with words or more, of which the upper median has at most ten words."""
    sizes = F.array_sort(F.filter(F.transform(F.split(x, "\n"), _words), lambda n: n > 0))
    return (F.size(sizes) >= 4) & (F.get(sizes, F.floor(F.size(sizes) / 2).cast("int")) <= 10)


def sentence_prefix(x: Column, most: int) -> Column:
    """The longest prefix of whole sentences with at most `most` words; the first that does not fit ends it."""
    step = lambda acc, s: F.when(acc["done"] | (acc["n"] + _words(s) > most), F.struct(F.lit(True).alias("done"), acc["n"].alias("n"), acc["k"].alias("k"))).otherwise(F.struct(F.lit(False).alias("done"), (acc["n"] + _words(s)).alias("n"), (acc["k"] + 1).alias("k")))
    parts = T.sentences(x)
    k = F.aggregate(parts, F.struct(F.lit(False).alias("done"), F.lit(0).alias("n"), F.lit(0).alias("k")), step)["k"]
    return F.array_join(F.slice(parts, F.lit(1), k), " ")


def nli_rows(raw: DataFrame, split: str) -> DataFrame:
    """raw: index, premise, hypothesis, label. A premise's hash is its cluster."""
    return raw.select(F.concat(F.lit(f"nli-{split}-"), F.col("index").cast("string")).alias("id"), T.short_hash(F.col("premise")).alias("cluster"), "premise", "hypothesis", "label")


def choice_rows(raw: DataFrame, split: str) -> DataFrame:
    """raw: index, article, question, options (a literal of four quoted strings), answer (a letter). Gives the task's row and `dropped`:
    null, or "poem", "no gold", "duplicate gold" (the gold text is another option as well)."""
    text = F.regexp_extract_all("options", F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), F.lit(0))
    choices = F.transform(text, lambda s: F.regexp_replace(F.substring(s, F.lit(2), F.length(s) - 2), r"\\(.)", "$1"))
    own = raw.withColumn("choices", choices).withColumn("answer", F.trim("answer"))
    gold = F.get("choices", F.array_position(F.lit(list(LETTERS)), F.col("answer")).cast("int") - 1)
    own = own.withColumn("_gold", gold)
    same = F.size(F.filter("choices", lambda c: c == F.col("_gold")))
    reason = F.when(is_poem(F.coalesce("article", F.lit(""))), "poem").when(F.col("_gold").isNull(), "no gold").when(same > 1, "duplicate gold")
    return own.select(F.concat(F.lit(f"choice-{split}-"), F.col("index").cast("string")).alias("id"), T.short_hash(F.col("article")).alias("cluster"), F.col("article").alias("context"), "question", "choices", "answer", reason.alias("dropped"))


def news_rows(raw: DataFrame, split: str, n: int, seed: int = 0) -> DataFrame:
    """raw: guid, article, abstract. Rows with both, without segmentation marks; n of them in hash order."""
    own = raw.filter("coalesce(article, '') <> '' and coalesce(abstract, '') <> ''")
    key = F.concat(F.lit(f"news-{split}-"), F.col("guid").cast("string"))
    return hash_sample(own.select(key.alias("id"), key.alias("cluster"), T.detokenize(F.col("article")).alias("context"), T.detokenize(F.col("abstract")).alias("reference")), n, "id", seed)


def qa_rows(raw: DataFrame, n_clusters: int | None = None, seed: int = 0) -> DataFrame:
    """raw: id, context, question, answers (array), impossible. Answerable questions, each answer once in its order; of the
    passages n_clusters in hash order, with all their questions."""
    own = raw.filter("not coalesce(impossible, false)").withColumn("answers", F.array_distinct(F.filter("answers", lambda a: a.isNotNull()))).filter("size(answers) > 0")
    own = own.select(F.concat(F.lit("qa-"), F.col("id").cast("string")).alias("id"), T.short_hash(F.col("context")).alias("cluster"), "context", "question", "answers")
    if n_clusters is None:
        return own
    return own.join(hash_sample(own.select("cluster").distinct(), n_clusters, "cluster", seed), "cluster", "left_semi").select(own.columns)


def demonstration(r: str = "") -> Column:
    return F.concat(F.lit("Question: "), F.col(f"{r}question"), F.lit("\nSolution: "), F.col(f"{r}explanation"), F.lit("\nAnswer: "), F.col(f"{r}answer"))


def usable_math(most_words: int = 400) -> Column:
    """Neither a solved question nor a text that runs on."""
    return ~F.contains(F.col("question"), F.lit("=")) & (_words(F.concat_ws(" ", "question", "explanation")) <= most_words)


def math_rows(items: DataFrame, pool: DataFrame, split: str, k: int = 8, seed: int = 0) -> DataFrame:
    """items and pool: index, question, explanation, answer. Every usable item with k usable demonstrations of the pool for its
    context. The pool stands on a ring in hash order and an item takes the k after a place of its own, so rows meet k demonstrations and not
    the pool. A pool of fewer than k is an error."""
    ring = pool.filter(usable_math()).select("index", demonstration().alias("demo"))
    n = ring.count()
    if n < k:
        raise ValueError("the pool is smaller than the number of demonstrations")
    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col("index").cast("string"))), F.col("index")]
    ring = ring.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1).select("place", "demo")
    first = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{split}:"), F.col("index").cast("string"))), 1, 8), 16, 10).cast("bigint")
    own = items.filter(usable_math()).select("index", "question", F.col("answer").cast("string").alias("answer"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (first + i) % n)).alias("nth", "place"))
    context = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "demo"))), lambda x: x["demo"]), "\n\n")
    key = F.concat(F.lit(f"math-{split}-"), F.col("index").cast("string"))
    return own.join(ring, "place").groupBy("index").agg(context.alias("context"), F.min("question").alias("question"), F.min("answer").alias("answer")).select(key.alias("id"), key.alias("cluster"), "context", "question", "answer")


def long_rows(raw: DataFrame, opening: str, closing: str, n: int, seed: int = 0) -> DataFrame:
    """raw: index, subtask, context, question, prefix, answers. n rows a subtask in hash order. What stands between the first opening and
    closing mark is the context and the rest the template; without marks the question's empty pair of them is where the context goes. A
    template without exactly one slot is an error."""
    some = hash_sample(raw, n, "index", seed, ["subtask"])
    o, c = F.lit(opening), F.lit(closing)
    at = F.locate(opening, F.col("context"))
    rest = F.expr(f"substring(context, locate('{opening}', context) + {len(opening)})")
    slot = F.lit("\n{context}\n")
    inside = F.when(at > 0, F.trim(F.substring_index(rest, closing, 1))).otherwise(F.trim("context"))
    head = F.expr(f"substring(context, 1, locate('{opening}', context) - 1)")
    around = F.concat(head, o, slot, c, F.lit("\n\n"), F.trim("question"), F.lit("\n\n"), F.col("prefix"))
    empty = F.concat(F.regexp_replace("question", f"{opening}\\s*{closing}", f"{opening}\n{{context}}\n{closing}"), F.col("prefix"))
    own = some.withColumn("template", F.when(at > 0, around).otherwise(empty)).withColumn("_in", inside)
    slots = F.size(F.split("template", r"\{context\}")) - 1
    checked = F.when(slots == 1, F.col("template")).otherwise(F.raise_error(F.concat(F.lit("no single slot in row "), F.col("index").cast("string"))))
    return own.select(F.concat(F.lit("long-"), F.col("subtask"), F.lit("-"), F.col("index").cast("string")).alias("id"), F.concat(F.lit("long-"), F.col("index").cast("string")).alias("cluster"), F.col("_in").alias("context"), checked.alias("template"), "answers", "subtask")


def paragraph_rows(raw: DataFrame, n: int, least: int = 300, most: int = 1500, least_line: int = 0, seed: int = 0) -> DataFrame:
    """raw: id, source, text. Whole sentences of at most `most` words of texts that then have `least`; lines below least_line words are left
    out before. n texts a source in hash order."""
    lines = F.array_join(F.filter(F.split("text", "\n"), lambda s: _words(s) >= least_line), " ") if least_line else F.col("text")
    own = raw.select("id", "source", sentence_prefix(T.detokenize(lines), most).alias("text")).filter(_words(F.col("text")) >= least)
    return hash_sample(own, n, "id", seed, ["source"])


def with_segmentation(rows: DataFrame, segmented: DataFrame, key: str = "id") -> DataFrame:
    """rows with the columns of segmented; a repeated or missing key is an error that names it."""
    found = segmented.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in segmented.columns if c != key])
    name = lambda what: F.raise_error(F.concat(F.lit(what), F.col(key).cast("string")))
    own = rows.join(found, key, "left")
    keep = F.when(F.col("_n").isNull(), name("no segmentation of ")).when(F.col("_n") > 1, name("more than one segmentation of ")).otherwise(F.lit(True))
    return own.filter(keep).drop("_n")


def prompt(task: str, context: str = "context") -> Column:
    """The text that a reader gets; only the context varies between systems. Wordings are our own."""
    c, q = F.coalesce(F.col(context), F.lit("")), F.coalesce(F.col("question"), F.lit("")) if task not in ("summarization", "long") else None
    if task == "summarization":
        return F.concat(F.lit("Summarise the text in a few sentences.\n\nText: "), c, F.lit("\n\nSummary:"))
    if task == "nli":
        return F.concat(F.lit("How does the hypothesis relate to the premise? Answer with one of: entailment, contradiction, neutral, other.\n\nPremise: "), c, F.lit("\nHypothesis: "), q, F.lit("\n\nLabel:"))
    if task == "qa":
        return F.concat(F.lit("Answer with a phrase from the passage and nothing else.\n\nPassage: "), c, F.lit("\n\nQuestion: "), q, F.lit("\n\nAnswer:"))
    if task == "math":
        return F.concat(F.lit("Solve it as the examples do. End with a line \"Answer: <number>\".\n\n"), c, F.lit("\n\nQuestion: "), q, F.lit("\nSolution:"))
    if task == "long":
        return F.replace(F.col("template"), F.lit("{context}"), c)
    if task == "choice":
        options = F.array_join(F.transform("choices", lambda x, i: F.concat(F.get(F.lit(list(LETTERS)), i), F.lit(". "), x)), "\n")
        return F.concat(F.lit("Choose the right answer. Answer with one letter.\n\nPassage: "), c, F.lit("\n\nQuestion: "), q, F.lit("\n"), options, F.lit("\n\nAnswer:"))
    raise ValueError(f"unknown task {task}")


_NUMBER = r"-?\d[\d.,]*"


def parse(task: str, x: Column, marker: str = "Answer") -> Column:
    """What a reader's text answers: the label that occurs first, the first letter that stands alone, the first line, the number after the marker
    or else the last one, or the text itself."""
    x = F.trim(x)
    if task == "nli":
        low = F.lower(x)
        hits = F.array(*[F.struct(F.locate(n, low).alias("at"), F.lit(n).alias("label")) for n in NLI_LABELS])
        return F.coalesce(F.array_min(F.filter(hits, lambda h: h["at"] > 0))["label"], F.when(x.isNotNull(), ""))
    if task == "choice":
        return F.regexp_extract(x, r"\b([ABCD])\b", 1)
    if task == "qa":
        return F.trim(F.substring_index(x, "\n", 1))
    if task == "math":
        marked = F.regexp_extract(x, rf"{marker}\s*:\s*({_NUMBER})", 1)
        every = F.regexp_extract_all(x, F.lit(f"({_NUMBER})"), F.lit(1))
        return F.when(marked != "", T.normalize_number(marked)).otherwise(F.coalesce(T.normalize_number(F.get(every, F.size(every) - 1)), F.when(x.isNotNull(), "")))
    return x


def token_f1(pred: Column, gold: Column) -> Column:
    """Overlap of two texts' words with their counts, as F1; 0 if either has none."""
    a, b = T.metric_tokens(pred), T.metric_tokens(gold)
    count = lambda c, w: F.size(F.filter(c, lambda y: y == w))
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, w: acc + F.least(count(a, w), count(b, w)))
    return F.coalesce(2 * common / F.nullif(F.size(a) + F.size(b), F.lit(0)), F.lit(0.0))


def best_f1(pred: str, golds: str) -> Column:
    """The best F1 over an array of gold answers; 0 without any."""
    return F.coalesce(F.array_max(F.transform(golds, lambda g: token_f1(F.col(pred), g))), F.lit(0.0))


def exact_match(pred: str, golds: str) -> Column:
    """1 if the words are those of one of the answers."""
    return F.coalesce(F.exists(golds, lambda g: T.metric_tokens(g) == T.metric_tokens(F.col(pred))), F.lit(False)).cast("double")


def recall(pred: str, golds: str) -> Column:
    """Share of the answers that stand in the text, whatever their case; null without any."""
    hit = F.filter(golds, lambda g: F.contains(F.lower(F.col(pred)), F.lower(g)))
    return F.size(hit) / F.nullif(F.size(golds), F.lit(0))


def accuracy(pred: Column, answer: Column) -> Column:
    return (pred == answer).cast("double")


def main_metric(task: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, metric in MAIN_METRIC.items():
        out = F.when(task == name, metric).otherwise(out)
    return out
