"""Text functions as Columns, and the few that need Python as Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Token of alignment and n-grams: digits, letters, any other visible character, underscore.
TOKEN = r"(\p{Nd}+|[\p{L}\p{Nl}\p{No}]+|[^\p{L}\p{N}_\s]|_)"
#: Token of the overlap metrics.
METRIC = r"([\p{L}\p{N}_]+)"
#: The five tone marks as combining characters, and the vowel pairs whose mark moves in an open syllable.
_TONES = "\u0300\u0301\u0303\u0309\u0323"
_PAIRS = ("oa", "oe", "uy")


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(TOKEN), F.lit(1))


def metric_tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(METRIC), F.lit(1))


def is_punct(x: Column) -> Column:
    """All characters are punctuation; true for the empty text."""
    return x.rlike(r"^\p{P}*$")


def sentences(x: Column) -> Column:
    return F.split(x, r"(?<=[.!?])\s+")


def detokenize(x: Column) -> Column:
    """Underscores to spaces, no space before closing or after opening marks, runs of space to one."""
    x = F.regexp_replace(F.regexp_replace(x, "_", " "), r"\s+([,.;:!?)\]}%…])", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"([(\[{])\s+", "$1"), r"\s+", " "))


def short_hash(x: Column) -> Column:
    return F.substring(F.md5(x), 1, 12)


def without_reasoning(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)<think>.*?</think>", "")


def chat_messages(system: Column | None, user: Column) -> Column:
    turn = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    both = F.array(turn("user", user))
    return both if system is None else F.when(system.isNotNull(), F.array(turn("system", system), turn("user", user))).otherwise(both)


def normalize_number(x: Column) -> Column:
    """Marks after it and thousands marks away, a decimal comma to a point, no zeros that say nothing; what is no number then stays as
    it is."""
    x = F.regexp_replace(F.trim(x), "[.,]+$", "")
    plain = F.replace(F.when(x.rlike(r"^-?\d{1,3}([.,]\d{3})+$"), F.regexp_replace(x, "[.,]", "")).otherwise(x), F.lit(","), F.lit("."))
    short = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    short = F.regexp_replace(F.regexp_replace(short, r"^(-?)0+(?=\d)", "$1"), "^-0$", "0")
    return F.when(plain.rlike(r"^-?\d+(\.\d*)?$"), short).otherwise(plain)


def _toned(letter: str) -> str:
    return "".join(unicodedata.normalize("NFC", letter + t) for t in _TONES)


#: A pair with the mark on its second letter, not after q and not before a word character, by letter case.
_MARKED_LATE = re.compile("(?<![qQ])(?:" + "|".join(f"[{x}{x.upper()}][{_toned(y)}{_toned(y.upper())}]" for x, y in _PAIRS) + r")(?!\w)")


def normalized(text: str) -> str:
    """NFC, and the tone mark of an open syllable in oa, oe or uy on its first letter; not after q."""

    def earlier(m: re.Match) -> str:
        letter, mark = unicodedata.normalize("NFD", m[0][1])
        return unicodedata.normalize("NFC", m[0][0] + mark) + letter

    return _MARKED_LATE.sub(earlier, unicodedata.normalize("NFC", text))


@F.pandas_udf(StringType())
def normalize(x: pd.Series) -> pd.Series:
    return x.map(normalized, na_action="ignore")
