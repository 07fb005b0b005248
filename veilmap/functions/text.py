"""The analyser ``unicode-lite``, folding, and entries for typeahead.

Tokens: NFKC, full case folding, then runs of letters, marks and digits (with inner apostrophes, and dots or commas between
digits), near to the word rules of UAX 29. There is no stemming, no stop list, no removal of accents, and no dictionary for
scripts without spaces: there each run of ideographs gives one token per character.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_WORD = regex.compile(r"[\p{Han}\p{Hiragana}]|\p{Katakana}+|(?:[\p{L}\p{M}\p{N}_--[\p{Han}\p{Hiragana}\p{Katakana}]]+(?:['’.:·](?=\p{L})(?<=\p{L}['’.:·])|[.,;'](?=\p{N})(?<=\p{N}[.,;'])|))+", regex.V1)


def fold(text: str) -> str:
    """NFKC and full case folding; accents stay."""
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def tokens(text: str) -> list[str]:
    return [w for w in _WORD.findall(fold(text)) if any(c.isalnum() for c in w)]


@F.pandas_udf(ArrayType(StringType()))
def tokens_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else tokens(t))


@F.pandas_udf(StringType())
def fold_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else fold(t))


# letters and signs of Latin text that NFKC leaves as they are
_LATIN = "^[\\x00-\\x7f¡-§©«¬®°±¶·»¿-ıĴ-ľŁ-ňŊ-žʼ’]*$"
_LATIN_WORD = "[\\p{L}\\p{N}_]+(?:(?:(?<=\\p{L})['’.:·](?=\\p{L})|(?<=\\p{N})[.,;'](?=\\p{N}))[\\p{L}\\p{N}_]+)*"


def latin_tokens(text: Column) -> Column:
    """The same tokens in Spark alone; null for text that holds anything but Latin letters and common signs."""
    folded = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    words = F.filter(F.regexp_extract_all(folded, F.lit(_LATIN_WORD), F.lit(0)), lambda w: w.rlike("[\\p{L}\\p{N}]"))
    return F.when(text.rlike(_LATIN) & ~text.contains("İ"), words)


def tokens_of(text: Column) -> Column:
    """Tokens of any text. Python sees only texts that latin_tokens leaves, so a column of these is best kept where items are written."""
    native = latin_tokens(text)
    return F.coalesce(native, tokens_udf(F.when(native.isNull(), text)))


def entries(key: str, title: str | None) -> list[tuple[int, str]]:
    """(kind, folded text) by which a category value is found: 0 its key, 1 its title, 2 the start of a later word.

    Words are those of the title, or of the key where there is none; the underscore parts words of a key.
    """
    out = [(0, fold(key))]
    if title is not None:
        out.append((1, fold(title)))
    shown = fold(title) if title is not None else fold(key).replace("_", " ")
    starts = [m.start() for m in regex.finditer(r"(?<![\p{L}\p{M}\p{N}])[\p{L}\p{N}]", shown)]
    out += [(2, shown[i:]) for i in starts if i > 0]
    seen: set[str] = set()
    return [(k, t) for k, t in out if t.strip() and not (t in seen or seen.add(t))]
