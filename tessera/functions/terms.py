"""Spelling of terms: Unicode composition, case and white space."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of all scripts, as a Java character class: ASCII separators and controls, next line, no-break and wide blanks.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode composition. Only strings with a character from U+0300 on can change, so only those travel to Python."""
    return F.coalesce(_compose(F.when(text.rlike("[^\\x{0}-\\x{2ff}]"), text)), text)


def squeeze(text: Column) -> Column:
    """White space at both ends removed, inner runs made one blank."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


#: Spellings that are their own key: ASCII and Latin-1 small letters, digits, hyphens, single inner blanks.
_PLAIN = r"^[a-z0-9_\-\xdf-\xf6\xf8-\xff]+(?: [a-z0-9_\-\xdf-\xf6\xf8-\xff]+)*\z"


def has_term(text: Column) -> Column:
    """Whether a text is a term: not null, and something in it is visible."""
    return text.rlike("[^" + SPACE[1:])


def with_term(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with the column ``name`` of common spellings, without rows that hold no term.

    Plain spellings, mostly the bulk, keep inside whole-stage code; only the others pass through Python for their composition.
    """
    plain = F.coalesce(text.rlike(_PLAIN), F.lit(False))
    rest = df.where(~plain & has_term(text))
    return df.where(plain).withColumn(name, text).unionAll(rest.withColumn(name, term_key(text)))


def term_key(text: Column) -> Column:
    """The common spelling of a term; null where nothing visible remains."""
    key = squeeze(F.lower(nfc(text)))
    return F.when(key != "", key)
