"""Secret scans in DataFrame operations only: a wide candidate pattern, and a random forest that removes
its false positives.

Candidates are values of 6 or more visible characters that follow a naming word or an assignment sign
(in the word or in those before it), without quotes around them, and runs of 16 or more key characters
with a letter or digit; each with the two words before, the word around and the word after.
Features of a candidate: length, classes of characters and transitions between them, how much of it a
dictionary covers, whether it looks like a path or address or stands in one, and which words stand
next to it. A forest is grown on the driver from labelled findings (at most MOST_LABELLED of them,
built in unless given) whose features Spark itself computes, and turned into one nested CASE a tree.

Nulls: a null text has no findings; a null doc_id is reported as such. Repeated rows are scanned each. An
empty table gives no rows. Other columns are ignored by findings and kept by redact.
"""

from __future__ import annotations

import random
import string
import uuid
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled findings that a forest is grown from.
MOST_LABELLED = 4000
TREES, DEPTH, LEAST_LEAF = 15, 5, 5
MARK = "[SECRET]"

#: A run within a word, and a word that can hold one.
CANDIDATE = r"([A-Za-z0-9+/_\-.]{16,}={0,2})"
HOLDS = r"[A-Za-z0-9+/_\-.]{16}"
#: Words by which people name secrets, and words that stand next to harmless strings.
NAMING = r"(?i)(token|secret|passw|passwd|pwd|api[_-]?key|apikey|access[_-]?key|private|credential|auth|bearer|client[_-]?id|signature)"
HARMLESS = r"(?i)(commit|sha1|sha256|md5|hash|checksum|digest|uuid|guid|version|build|revision|example|sample|image|integrity|etag|order|invoice|card|phone|isbn|test|dummy)"
#: A value assigned within a word (not the address after a scheme), and words after which the next one is a value.
OWN = r"[A-Za-z0-9_\])\"'](?:=>|:=|=|:(?!//))[\"'`]*([^\"'`]{6,})"
BARE = r"^[\"'`(\[{<]*([^\"'`]*)"
NAMED = NAMING + r"[A-Za-z0-9_\-]{0,12}[\"'`\])]*(=>|:=|=|:)?[\"'`]?$"
SIGN = r"(^(=>|is|was)|=|:)$"
#: What code and prose have in place of a value.
CODE = r"(?i)[({\[$<]|^(required|missing|invalid|optional|default|changed|expired|hidden|string|number|integer|boolean|unknown|undefined|disabled|enabled|reset)|(passw|token|secret|\bkey\b|environ|config|getenv)"
#: Frequent syllables and words of the languages at hand.
DICTIONARY = "tion|ment|ing|ung|keit|heit|ción|mente|the|and|that|with|for|are|was|der|die|und|sch|ich|ein|que|les|des|los|las|con|est|une|pour|por|ver|ent|ter|ere|ion|ed|er|on|an|re|in|es|en|th|st|ar|le|de|la|or|al|is|it|at|ou"


def with_candidates(df: DataFrame) -> DataFrame:
    """df (text) with `_c`: array<struct<before, word, secret, after>>."""
    # a word goes with its neighbours: words fetched by place would be split anew for each place
    w = F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+")
    ahead = lambda n: F.concat(F.array(*[F.lit("")] * n), w)
    df = df.withColumn("_w", F.arrays_zip(w.alias("w"), ahead(1).alias("p"), ahead(2).alias("q"), F.slice(w, F.lit(2), F.size(w)).alias("n")))
    follows = lambda x: x["p"].rlike(SIGN) | x["p"].rlike(NAMED)
    some = lambda x: (F.length(x["w"]) >= 6) & (x["w"].rlike(HOLDS) | follows(x) | x["w"].rlike(OWN))

    def own(x):
        runs = F.filter(F.regexp_extract_all(x["w"], F.lit(CANDIDATE), F.lit(1)), lambda s: s.rlike("[A-Za-z0-9]"))
        inside, bare = F.regexp_extract(x["w"], OWN, 1), F.regexp_extract(x["w"], BARE, 1)
        value = F.when(inside != "", inside).when(follows(x), bare)
        # longest first: a value that holds a run is replaced before it
        values = F.filter(F.array(F.rtrim(value, F.lit("\"'`,;.)]}>"))), lambda s: F.length(s) >= 6)
        return F.transform(F.array_distinct(F.concat(values, runs)), lambda s: F.struct(F.concat_ws(" ", x["q"], x["p"]).alias("before"), x["w"].alias("word"), s.alias("secret"), F.coalesce(x["n"], F.lit("")).alias("after")))

    return df.withColumn("_c", F.flatten(F.transform(F.filter("_w", some), own))).drop("_w")


def features(c: Column) -> Column:
    """array<double> of one candidate."""
    s = c["secret"]
    n = F.length(s).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(s, pattern, "")) / n
    moves = lambda pattern: F.regexp_count(s, F.lit(pattern)) / n
    near = F.concat_ws(" ", c["before"], c["word"], c["after"])
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return F.array(
        n,
        share("[^0-9]"),
        share("[^A-Z]"),
        share("[^a-z]"),
        moves("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"),
        moves("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        moves("[+/_\\-.=]"),
        1 - F.length(F.regexp_replace(F.lower(s), F.lit(DICTIONARY), F.lit(""))) / n,
        flag(s.rlike("/.*/|\\.[a-z]{2,4}(/|$)|^[a-z]+\\.") | c["word"].rlike("://|@")),
        flag(s.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}")),
        flag(s.rlike("^[0-9a-fA-F]+$")),
        flag(s.rlike("^[0-9.\\-]+$")),
        flag(s.rlike("^(AKIA|ASIA|gh[pousr]_|sk[-_]|xox[abp]-|AIza|eyJ|glpat-)")),
        flag(s.rlike("(?i)(.)\\1{5}|x{4}|your|0{6}|1234567|abcdef|changeme|placeholder")),
        flag(near.rlike(NAMING)),
        flag(near.rlike(HARMLESS)),
        flag(c["before"].rlike("(=|:=?)$") | c["word"].rlike("[=:][\"']?[A-Za-z0-9+/_\\-.]{16}")),
        share("[A-Za-z0-9+/_\\-.=]"),
        flag(s.rlike("^[A-Z]?[a-z]+$|^[A-Z]+$")),
        flag(s.rlike(CODE)),
        flag(c["before"].rlike(NAMING + r"[A-Za-z0-9_\-]{0,12}[\"'`\])]* *(=>|:=|=|:|is|was)[\"'`]?$") | c["word"].rlike(NAMING + r"[A-Za-z0-9_\-]{0,12}[\"'`\])]*(=>|:=|=|:)")),
        flag(c["word"].rlike("^[^\"'`]*[\"'`].*[\"'`]")),
    )


def labelled_findings(n: int = 1600, seed: int = 7) -> list[tuple[str, int]]:
    """(text with one finding, 1 if it is a secret), drawn from forms that secrets and harmless strings take."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    low, alnum, hexa = string.ascii_lowercase, string.ascii_letters + string.digits, "0123456789abcdef"
    syllables = DICTIONARY.split("|")
    word = lambda k: "".join(rng.choice(syllables) for _ in range(k))
    name = lambda: rng.choice(["token", "TOKEN", "api_key", "secret", "password", "access_key", "auth_token", "API_KEY", "client_secret"])
    aside = lambda: rng.choice(["commit", "sha256", "md5", "checksum", "build", "hash", "etag", "image", "revision"])
    sign = lambda: rng.choice([' = "', "=", ": ", ' := "', " "])
    case = lambda s: s.upper() if rng.random() < 0.25 else s
    secret = lambda: rng.choice(["password", "Password", "passwd", "pwd", "PASSWORD", "db_password", "secret", "token", "api_key", "passphrase_secret"])
    assign = lambda: rng.choice([" = ", "=", ": ", ":", " := ", " is "])
    mixed = lambda: "".join(rng.choice([w, w.capitalize()]) for w in [word(rng.randint(1, 3))]) + rng.choice(["", "!", "@", "&", "#"]) + str(rng.randint(1, 9999)) + rng.choice(["", "!", "$", "&x"])
    yes = [
        lambda: f"{name()}{sign()}{case(pick(hexa, rng.choice([32, 40, 40, 64])))}",
        lambda: f"{name()}{sign()}{pick(alnum, rng.randint(20, 60))}",
        lambda: f"{word(2)} {rng.choice(['AKIA', 'ASIA'])}{pick(string.ascii_uppercase + string.digits, 16)}",
        lambda: f"{word(2)} {rng.choice(['ghp_', 'gho_', 'glpat-', 'sk-', 'xoxb-', 'AIza'])}{pick(alnum, rng.randint(30, 40))}",
        lambda: f"Bearer eyJ{pick(alnum, 30)}.{pick(alnum, 40)}.{pick(alnum + '-_', 40)}",
        lambda: f"{word(2)} {pick(alnum + '+/', 44)}=",
        lambda: f"{secret()}{assign()}{pick(alnum + '!@#%&*?+-_', rng.randint(7, 15))}",
        lambda: f"{secret()}{assign()}{mixed()}",
        lambda: f"{secret()}{assign()}{pick(string.ascii_letters, rng.randint(7, 30))}",
        lambda: f"{secret()}{assign()}{''.join(rng.choice(['correct', 'horse', 'battery', 'staple', 'dragon', 'monkey', 'winter', 'sunny', 'orange', 'purple']) for _ in range(rng.randint(2, 4)))}",
        lambda: f"{secret()}{assign()}{pick(alnum, rng.randint(4, 12))}{rng.choice('!@#%&')}{pick(alnum, rng.randint(4, 20))}",
    ]
    no = [
        lambda: f"{aside()}{sign()}{case(pick(hexa, rng.choice([32, 40, 64])))}",
        lambda: f"{word(1)} {uuid.UUID(int=rng.getrandbits(128))}",
        lambda: f"{word(1)} {pick(string.digits, rng.randint(16, 24))}",
        lambda: f"{word(2)} {word(5)}{rng.randint(0, 99)}{word(2)}",
        lambda: f"see www.{word(2)}.com/{word(3)}/{rng.randint(1, 9999)}",
        lambda: f"path /usr/{word(2)}/{word(3)}-{rng.randint(1, 9)}.{rng.randint(0, 99)}/{word(2)}.txt",
        lambda: f"{name()}{sign()}{rng.choice(['your_token_here_1', 'xxxxxxxxxxxxxxxx0000', 'CHANGEME-1234567890', '00000000000000000000', 'placeholder-value-12'])}",
        lambda: f"version {rng.randint(1, 20)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}-{word(3)}-{rng.randint(2000, 2030)}",
        lambda: f"mail {word(2)}.{word(2)}{rng.randint(1, 99)}@mail{rng.randint(1, 99)}.{word(3)}.example.com",
        lambda: f"on {rng.randint(2000, 2030)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T12:30:00.{pick(string.digits, 6)}Z and {pick(low, 6)}_{pick(low, 6)}_{rng.randint(10, 99)}_{pick(low, 5)}",
        lambda: f"{word(2)} {rng.choice([name, secret])()} {word(rng.randint(2, 5))}",
        lambda: f"{secret()}{assign()}{rng.choice(['required', 'missing', 'invalid', 'os.environ[KEY]', 'getPassword()', '${DB_PASSWORD}', 'changed', 'optional', 'config.password', '<password>', 'undefined', 'string'])}",
        lambda: f"{word(2)}{rng.choice([' = ', ': ', '='])}{rng.choice([word(rng.randint(2, 5)), word(2).capitalize() + word(1), str(rng.randint(100000, 99999999)), f'{word(2)}({word(1)})', f'{word(2)}_{word(2)}'])}",
        lambda: f"{word(2)} {rng.choice([word(rng.randint(7, 10)), word(rng.randint(7, 10)).capitalize(), f'{word(4)}-{word(4)}', f'{word(4)}/{word(4)}', f'{word(4)}.{word(4)}'])}",
    ]
    return [(f"{word(2)} {(f := rng.choice(yes if i % 2 else no))()}{'"' if rng.random() < 0.2 else ''} {word(3)}", i % 2) for i in range(n)]


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 1) -> list:
    """Trees as nested (feature, threshold, left, right), leaves as shares of secrets."""
    rng = np.random.default_rng(seed)

    def grow(rows: np.ndarray, left: int):
        own = y[rows]
        if not left or len(rows) < 2 * LEAST_LEAF or own.min() == own.max():
            return float(own.mean())
        best = None
        for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5) + 1), replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            k = np.arange(1, len(order))
            cut = (v[1:] > v[:-1]) & (k >= LEAST_LEAF) & (len(order) - k >= LEAST_LEAF)
            if not cut.any():
                continue
            p, q = ones[:-1] / k, (ones[-1] - ones[:-1]) / (len(order) - k)
            loss = np.where(cut, k * p * (1 - p) + (len(order) - k) * q * (1 - q), np.inf)
            i = int(loss.argmin())
            if best is None or loss[i] < best[0]:
                best = (loss[i], int(f), float((v[i] + v[i + 1]) / 2))
        if best is None:
            return float(own.mean())
        _, f, t = best
        go = x[rows, f] <= t
        return f, t, grow(rows[go], left - 1), grow(rows[~go], left - 1)

    return [grow(rng.integers(0, len(y), len(y)), depth) for _ in range(trees)]


def forest_column(forest: list, f: Column) -> Column:
    """Mean of the trees over the features in f (array<double>)."""

    def tree(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        return F.when(f[node[0]] <= node[1], tree(node[2])).otherwise(tree(node[3]))

    total = tree(forest[0])
    for t in forest[1:]:
        total = total + tree(t)
    return total / len(forest)


_grown: dict[tuple, list] = {}


def train(spark: SparkSession, labelled: list[tuple[str, int]] | None = None, most: int = MOST_LABELLED) -> list:
    """A forest from labelled texts, of each of which the first candidate counts."""
    rows = tuple((labelled or labelled_findings())[:most])
    if rows not in _grown:
        df = spark.createDataFrame(list(rows), "text string, secret int")
        df = with_candidates(df).select("secret", F.get("_c", F.lit(0)).alias("c"))
        lost = df.filter("c is null and secret = 1").count()
        if lost:
            warnings.warn(f"{lost} of {sum(y for _, y in rows)} labelled secrets have no candidate and are not learnt", stacklevel=2)
        got = df.filter("c is not null").select("secret", features(F.col("c")).alias("f")).collect()
        _grown[rows] = grow_forest(np.array([r.f for r in got]), np.array([r.secret for r in got], float))
    return _grown[rows]


def judged(docs: DataFrame, forest: list) -> DataFrame:
    """docs with `_found`: array<struct<secret, score>> of all candidates."""
    found = with_candidates(docs)
    found = found.withColumn("_f", F.transform("_c", lambda c: F.struct(c["secret"].alias("secret"), features(c).alias("f")))).drop("_c")
    return found.withColumn("_found", F.transform("_f", lambda c: F.struct(c["secret"].alias("secret"), forest_column(forest, c["f"]).alias("score")))).drop("_f")


def findings(docs: DataFrame, threshold: float = 0.5, forest: list | None = None) -> DataFrame:
    """doc_id, place (of the candidate in the text, from 0), length, secret_sha256, score and is_secret of
    every candidate in docs (doc_id, text). No shuffle."""
    forest = forest or train(docs.sparkSession)
    own = judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), forest)
    out = own.select("doc_id", F.posexplode_outer("_found").alias("place", "c")).filter("c is not null")
    return out.select("doc_id", "place", F.length("c.secret").alias("length"), F.sha2("c.secret", 256).alias("secret_sha256"), F.round("c.score", 6).alias("score"), (F.col("c.score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, threshold: float = 0.5, forest: list | None = None) -> DataFrame:
    """docs with every accepted secret replaced by MARK, n_chars (where there is one) counted anew for
    texts that changed. No row goes. No shuffle."""
    forest = forest or train(docs.sparkSession)
    own = judged(docs, forest).withColumn("_bad", F.array_distinct(F.transform(F.filter("_found", lambda c: c["score"] >= threshold), lambda c: c["secret"])))
    changed = F.size("_bad") > 0
    own = own.withColumn("_text", F.when(changed, F.aggregate("_bad", F.col("text"), lambda t, s: F.replace(t, s, F.lit(MARK)))).otherwise(F.col("text")))
    kept = {"text": F.col("_text"), "n_chars": F.when(changed, F.length("_text").cast(dict(docs.dtypes).get("n_chars", "long"))).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return own.select(*[kept[c].alias(c) if c in kept else F.col(c) for c in docs.columns])
