"""Unicode normal forms, which Spark has no functions for: Arrow batches, one call of the library for each value."""

from __future__ import annotations

import random
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

INVISIBLE = "[\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2060}-\\x{206f}\\x{feff}]"
QUOTES = ("\u2018\u2019\u201a\u201b\u2032\u201c\u201d\u201e\u2033\u00ab\u00bb", "'''''\"\"\"\"\"\"")


def _normal(form: str):
    @pandas_udf(StringType())
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return normal


_NFC, _NFKC = _normal("NFC"), _normal("NFKC")


def nfc(text: Column) -> Column:
    """NFC; empty for null."""
    return _NFC(F.coalesce(text, F.lit("")))


def nfkc(text: Column) -> Column:
    """NFKC; empty for null."""
    return _NFKC(F.coalesce(text, F.lit("")))


def composed(text: Column) -> Column:
    """NFC, and the vowel signs that old texts write as two: aa and e as o, aa and ai as au."""
    return F.replace(F.replace(nfc(text), F.lit("\u093e\u0947"), F.lit("\u094b")), F.lit("\u093e\u0948"), F.lit("\u094c"))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def tidy(text: Column) -> Column:
    """NFKC without invisible characters, with plain quotes and single blanks, stripped; empty for null."""
    plain = F.translate(F.regexp_replace(nfkc(text), INVISIBLE, ""), *QUOTES)
    return stripped(F.regexp_replace(plain, "[ \\t]+", " "))


def skeleton(token: Column) -> Column:
    """NFC without marks and joiners: what is left of a word without its vowel signs."""
    return F.regexp_replace(nfc(token), "[\\p{M}\\x{200c}\\x{200d}]", "")


@pandas_udf(StringType())
def noisy(words: pd.Series, seeds: pd.Series) -> pd.Series:
    """Words with one typing error each, of a kind and at a place that the seed chooses: a letter lost, doubled, exchanged with the
    next one, put in or replaced; empty words stay."""

    def one(word: str | None, seed: int) -> str | None:
        if not word:
            return word
        r = random.Random(seed)
        i, kind, letter = r.randrange(len(word)), r.randrange(5), r.choice("abcdefghijklmnopqrstuvwxyz")
        if kind == 2 and i + 1 < len(word):
            return word[:i] + word[i + 1] + word[i] + word[i + 2 :]
        return (word[:i] + word[i + 1 :], word[: i + 1] + word[i:], word, word[:i] + letter + word[i:], word[:i] + letter + word[i + 1 :])[kind]

    return pd.Series([one(w, int(s)) for w, s in zip(words, seeds, strict=True)])
