"""Protected words: negation in context, tiers, force lists and masks, and the negation probe.

A document is a column of words, array<struct<text, pos, ner>>. All of it is row-local and JVM-side: the word after
comes from a shifted copy of the array, and whether only particles stand between a word and a question mark is asked of the
joined words by one regular expression, so no word looks its neighbours up by place.

Nulls: a null or empty array of words has no tiers, empty masks and an empty list.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

TIERS = ("T1", "T2", "T3")
_SEP, _HIT = "\x01", "\x02"


def _alternatives(words) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


@dataclass(frozen=True)
class Lexicon:
    """What the rules know. Defaults are fixed values: the word lists that results have to agree with."""

    negation: tuple[str, ...] = ("không", "chưa", "chẳng", "chả", "đừng", "chớ", "không hề", "chưa từng")
    #: Words that ask instead of negating where a question ends, and the particles that may stand before its mark.
    asking: tuple[str, ...] = ("không", "chưa")
    particles: tuple[str, ...] = ("ạ", "à", "nhỉ", "hả", "hở", "nhé", "chứ", "vậy", "thế", "nào")
    #: A negation word before one of these does not negate; "" stands for a numeral tag on the word itself.
    harmless: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"không": ("", "độ", "giờ", "phẩy", "chấm", "những", "chỉ", "kích", "lâu"), "chẳng": ("hạn",)})
    tiers: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "T1": ("nếu", "trừ khi", "giá mà", "dù"),
            "T2": ("đã", "đang", "sẽ", "vừa", "mới", "sắp", "từng", "phải", "nên", "cần", "có thể", "được phép"),
            "T3": ("mọi", "mỗi", "tất cả", "chỉ", "hơn", "nhất", "kém"),
        }
    )
    #: Words that count only with these tags (or without those), before or not before these words.
    only_pos: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"mới": ("R",), "phải": ("V", "R"), "chỉ": ("R",)})
    not_pos: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"nên": ("C",)})
    only_before: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"kém": ("hơn",)})
    not_before: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"phải": ("không", "?")})
    numerals: tuple[str, ...] = ("M",)

    def tier_of(self) -> dict[str, str]:
        return {w: "T1" for w in self.negation} | {w: t for t, ws in self.tiers.items() for w in ws}


VIETNAMESE = Lexicon()


def seen_with_next(words: str, lex: Lexicon = VIETNAMESE) -> Column:
    """array<struct<w, low, nxt, asks>> of the column `words`: each word, in lower case, the word after (or ""), and
    whether it is an asking word with nothing but particles between it and a question mark."""
    low = F.transform(words, lambda w: F.lower(w["text"]))
    after = F.concat(F.slice(low, F.lit(2), F.size(words)), F.array(F.lit("")))
    joined = F.concat(F.array_join(low, _SEP), F.lit(_SEP))
    asking = rf"(?<![^{_SEP}])({_alternatives(lex.asking)}){_SEP}(?=(?:(?:{_alternatives(lex.particles)}){_SEP})*\?{_SEP})"
    marked = F.split(F.regexp_replace(joined, F.lit(asking), F.lit(f"$1{_HIT}{_SEP}")), _SEP)
    asks = F.transform(marked, lambda t: t.endswith(_HIT))
    own = F.arrays_zip(F.col(words).alias("w"), low.alias("low"), after.alias("nxt"), F.slice(asks, F.lit(1), F.size(words)).alias("asks"))
    return F.when(F.size(words) > 0, own)


def is_negation(x: Column, lex: Lexicon = VIETNAMESE) -> Column:
    """Of one struct of seen_with_next."""
    low, nxt = x["low"], x["nxt"]
    hit = low.isin(*lex.negation) & ~x["asks"]
    for word, after in lex.harmless.items():
        tagged = F.coalesce(x["w"]["pos"].isin(*lex.numerals), F.lit(False)) if "" in after else F.lit(False)
        hit = hit & ~((low == word) & (nxt.isin(*[a for a in after if a]) | tagged))
    return hit


def tier(x: Column, lex: Lexicon = VIETNAMESE) -> Column:
    """T1, T2, T3 or null. The order of the rules decides: punctuation, names, numerals, negation, tags and neighbours, lexicon."""
    low, nxt, pos = x["low"], x["nxt"], F.coalesce(x["w"]["pos"], F.lit(""))
    barred = F.lit(False)
    for word, tags in lex.only_pos.items():
        barred = barred | ((low == word) & ~pos.isin(*tags))
    for word, tags in lex.not_pos.items():
        barred = barred | ((low == word) & pos.isin(*tags))
    for word, after in lex.only_before.items():
        barred = barred | ((low == word) & ~nxt.isin(*after))
    for word, after in lex.not_before.items():
        barred = barred | ((low == word) & nxt.isin(*after))
    out = F.when(low.rlike(r"^\p{P}*$"), F.lit(None).cast("string")).when(F.coalesce(x["w"]["ner"], F.lit("O")) != "O", "T1")
    out = out.when(pos.isin(*lex.numerals) | low.rlike(r"\p{Nd}"), "T1").when(low.isin(*lex.negation), F.when(is_negation(x, lex), "T1")).when(barred, F.lit(None).cast("string"))
    for t, words in lex.tiers.items():
        out = out.when(low.isin(*words), t)
    return out


def tiers(words: str, lex: Lexicon = VIETNAMESE) -> Column:
    """array<string> of the tiers of a column of words."""
    return F.coalesce(F.transform(seen_with_next(words, lex), lambda x: tier(x, lex)), F.array().cast("array<string>"))


def negations(words: str, lex: Lexicon = VIETNAMESE) -> Column:
    """array<boolean>: which words negate."""
    return F.coalesce(F.transform(seen_with_next(words, lex), lambda x: is_negation(x, lex)), F.array().cast("array<boolean>"))


def protected_mask(tiers: Column, wanted=TIERS) -> Column:
    return F.transform(tiers, lambda t: F.coalesce(t.isin(*wanted), F.lit(False)))


def force_tokens(words: str, tiers: str, wanted=TIERS) -> Column:
    """Protected surface forms, each once, in the order in which they first occur."""
    both = F.filter(F.arrays_zip(F.col(words).alias("w"), F.col(tiers).alias("t")), lambda x: F.coalesce(x["t"].isin(*wanted), F.lit(False)))
    return F.array_distinct(F.transform(both, lambda x: x["w"]["text"]))


def syllables(words: str) -> Column:
    """array<string>: a word has the pieces between its single spaces."""
    return F.coalesce(F.flatten(F.transform(words, lambda w: F.split(w["text"], " "))), F.array().cast("array<string>"))


def expand(words: str, mask: Column | str) -> Column:
    """A mask over words as one over their syllables."""
    own = F.arrays_zip(F.col(words).alias("w"), (F.col(mask) if isinstance(mask, str) else mask).alias("m"))
    return F.coalesce(F.flatten(F.transform(own, lambda x: F.array_repeat(x["m"], F.size(F.split(x["w"]["text"], " "))))), F.array().cast("array<boolean>"))


def string_force_mask(syllables: str, wanted=TIERS, lex: Lexicon = VIETNAMESE) -> Column:
    """array<boolean>: syllables within a lexicon phrase of the wanted tiers wherever it stands, across words and without
    context, and with T1 those that hold a digit. Phrases have one or two syllables."""
    phrases = [w for w, t in lex.tier_of().items() if t in wanted]
    one, two = [w for w in phrases if " " not in w], [w for w in phrases if w.count(" ") == 1]
    low = F.transform(syllables, F.lower)
    n = F.size(syllables)
    near = F.arrays_zip(low.alias("s"), F.concat(F.array(F.lit("")), low).alias("p"), F.concat(F.slice(low, F.lit(2), n), F.array(F.lit(""))).alias("q"))
    member = lambda x, words: x.isin(*words) if words else F.lit(False)

    def hit(x: Column) -> Column:
        pairs = member(F.concat_ws(" ", x["p"], x["s"]), two) | member(F.concat_ws(" ", x["s"], x["q"]), two)
        return member(x["s"], one) | pairs | (x["s"].rlike(r"\p{Nd}") if "T1" in wanted else F.lit(False))

    return F.when(n > 0, F.transform(F.slice(near, F.lit(1), n), hit)).otherwise(F.array().cast("array<boolean>"))


def naive_mask(syllables: str, lex: Lexicon = VIETNAMESE) -> Column:
    """array<boolean>: lexicon words of one syllable, and digits; nothing else is looked at."""
    single = [w for w in lex.tier_of() if " " not in w]
    return F.transform(syllables, lambda s: F.lower(s).isin(*single) | s.rlike(r"\p{Nd}"))


#: Characters that no space stands before, and those that none stands after.
NO_SPACE_BEFORE, NO_SPACE_AFTER = ",.;:!?)]}…%", "([{"


def render(pieces: Column) -> Column:
    """Pieces joined by spaces, none before a closing piece and none after an opening one."""
    before, after = map(re.escape, (NO_SPACE_BEFORE, NO_SPACE_AFTER))
    glue = lambda p: F.concat(F.when(p.rlike(f"^[{before}]"), "").otherwise(" "), p, F.when(p.rlike(f"[{after}]$"), _HIT).otherwise(""))
    return F.ltrim(F.regexp_replace(F.regexp_replace(F.array_join(F.transform(pieces, glue), ""), f"{_HIT} ?", ""), "^ +", ""))


def probe(words: str, lex: Lexicon = VIETNAMESE) -> Column:
    """The text without its negating words, whatever the budget."""
    kept = F.filter(seen_with_next(words, lex), lambda x: ~is_negation(x, lex))
    return F.coalesce(render(F.flatten(F.transform(kept, lambda x: F.split(x["w"]["text"], " ")))), F.lit(""))
