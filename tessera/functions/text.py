"""Text preparation as column expressions; whatever built-ins can state stays in whole-stage code."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Plain letters and the Latin letters with marks that fold to them.
FOLDS = {
    "a": "áàâãäåāăą", "e": "éèêëēęě", "i": "íìîïīį", "o": "óòôõöøōő", "u": "úùûüūůű", "c": "çćč", "n": "ñńň", "y": "ýÿ", "s": "šśşș", "z": "žźż",
    "l": "ł", "d": "đ", "g": "ğ", "t": "țţť", "r": "ř",
}
_FOLD_FROM = "".join(FOLDS.values())
_FOLD_TO = "".join(plain * len(marked) for plain, marked in FOLDS.items())


def fold(text: Column) -> Column:
    """Small letters without marks, for Latin text, in whole-stage code; combining marks are dropped."""
    return F.regexp_replace(F.translate(F.lower(text), _FOLD_FROM, _FOLD_TO), r"\p{M}+", "")


@F.pandas_udf(T.StringType())
def fold_any(texts: pd.Series) -> pd.Series:
    """Small letters without marks, for every script."""
    return texts.map(lambda t: t if t is None else "".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn"))


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: What the strict cleaning keeps besides letters, digits, blanks and the marker of an ellipsis.
_KEEP = r"[^\p{L}\p{M}\p{N}\s'\-.?!,;:$£_]"


def strict_clean(text: Column, expressions: Sequence[tuple[str, str]] = ()) -> Column:
    """Corpus cleaning: small letters, apostrophes and ligatures made plain, ellipses marked, sentence marks set apart, other characters blanked, multi-word
    expressions replaced (longest first), apostrophes and hyphens blanked, blanks squashed."""
    t = F.replace(F.replace(F.lower(text), F.lit("’"), F.lit("'")), F.lit("œ"), F.lit("oe"))
    t = F.replace(F.replace(t, F.lit("..."), F.lit(" £$£ ")), F.lit("…"), F.lit(" £$£ "))
    t = F.regexp_replace(F.regexp_replace(t, r"([?.!,;:])", " $1 "), _KEEP, " ")
    t = squash(t)
    ordered = sorted(expressions, key=lambda e: (-len(e[0]), e[0]))
    t = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ordered, t)
    return squash(F.regexp_replace(t, r"['\-]", " "))


#: Patterns of web residue, in the order they are removed.
WEB = (r"(?i)\b(?:https?://|www\.)\S+", r"[\w.+\-]+@[\w\-]+\.[\w.\-]+", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", r"\(?\d{2,3}\)?[\s\-]?\d{4,5}-\d{4}\b", r"(?<!\w)@\w+")


def strip_web(text: Column) -> Column:
    """URLs, e-mail addresses, IP addresses, telephone numbers and mentions replaced by a blank."""
    return squash(reduce(lambda c, p: F.regexp_replace(c, p, " "), WEB, text))


#: Short tokens that aren't noise.
SHORT_WORDS = ("ia", "ai", "uf", "br", "pt")


def is_noise(token: Column) -> Column:
    """Tokens with a digit, roman numerals up to six letters, single letters, and pairs of letters but for a few."""
    low = F.lower(token)
    return low.rlike(r"\p{N}") | low.rlike("^[ivxlcdm]{1,6}$") | (F.length(low) <= 1) | ((F.length(low) <= 2) & ~low.isin(*SHORT_WORDS))


def clean_layout(text: Column) -> Column:
    """Words hyphenated at line ends joined, page numbers and short structural lines dropped, paragraphs rebuilt from their lines."""
    t = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"(?<=[\p{L}\p{N}_])-\n(?=[\p{L}\p{N}_])", "")
    lines = F.filter(F.transform(F.split(t, "\n"), squash), lambda x: ~x.rlike(r"^(?:(?i:p[aá]g(?:ina)?\.?\s*)?\d+(?:\s*/\s*\d+)?|[\W_]{1,3})$"))
    paragraphs = F.regexp_replace(F.array_join(lines, "\n"), r"(?<!\n)\n(?!\n)", " ")
    return F.trim(F.regexp_replace(paragraphs, r"\n{2,}", "\n\n"))


def prepare_minimal(text: Column, lower: bool = False, accents: bool = True, numbers: bool = True, web: bool = False) -> Column:
    """Compatibility composition, zero-width and control characters removed, blanks squashed; on request small letters, no accents, no numbers, no web residue."""
    t = F.regexp_replace(nfkc(text), r"[\x{200b}-\x{200f}\x{2060}\x{feff}]", "")
    t = F.regexp_replace(t, r"[\p{Cc}&&[^\n\t]]", " ")
    t = strip_web(t) if web else t
    t = t if numbers else F.regexp_replace(t, r"\p{N}+", " ")
    t = F.lower(t) if lower else t
    return squash(t if accents else F.regexp_replace(F.translate(t, _FOLD_FROM + _FOLD_FROM.upper(), _FOLD_TO + _FOLD_TO.upper()), r"\p{M}+", ""))


def slug(value: Column, most: int = 60) -> Column:
    """A metadata value as a token: folded, other characters as single underscores, cut to ``most`` characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(fold(value), "[^a-z0-9_]+", "_"), "^_+|_+$", ""), 1, most)


def clean_corpus_text(text: Column, lower: bool = True, accents: bool = True, digits: bool = False) -> Column:
    """The cleaning chain for tagged corpora: header lines (``****``) pass through, other lines lose web residue, forbidden characters, stars, hyphens and (unless
    ``digits``) digits."""

    def clean(line: Column) -> Column:
        t = F.regexp_replace(strip_web(line), r"[\^|<>{}\[\]*\"“”«»]", " ")
        t = t if digits else F.regexp_replace(t, r"\p{N}+", " ")
        t = F.regexp_replace(t, r"(?<=\p{L})-(?=\p{L})", "_")
        t = F.lower(t) if lower else t
        return squash(t if accents else fold(t))

    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(x.startswith("****"), F.trim(x)).otherwise(clean(x))), "\n")


def general_tokens(text: Column, stopwords: Sequence[str] = (), least: int = 1) -> Column:
    """Tokens after general cleaning: web residue and punctuation gone, small letters, stop words and short tokens dropped."""
    words = F.regexp_extract_all(F.lower(strip_web(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    words = F.filter(words, lambda w: (F.length(w) >= least) & ~w.rlike(r"^\p{N}+$"))
    return F.filter(words, lambda w: ~w.isin(*stopwords)) if stopwords else words


def strip_transcript(text: Column) -> Column:
    """A leading time mark and speaker label removed from a transcript line."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s*\[?\d{1,2}:\d{2}(?::\d{2})?\]?\s*", ""), r"^\s*[\p{Lu}][\p{L}\d()]{0,24}:\s+", "")


def speakers(text: Column) -> Column:
    """The distinct speaker labels that open lines of a transcript."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^(?:\[[\d:]+\]\s*)?(\p{Lu}[\p{L}\d()]{0,24}):\s"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def file_metadata(name: Column) -> Column:
    """``reuniao_5_ano_2023.pdf`` as a map: letter parts are variables, the digit part after each its value."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]+)$", 1), r"\.[A-Za-z0-9]+$", "")
    names = F.regexp_extract_all(stem, F.lit(r"(\p{L}+)[_\-](\d+)"), F.lit(1))
    values = F.regexp_extract_all(stem, F.lit(r"(\p{L}+)[_\-](\d+)"), F.lit(2))
    last = F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda x, i: ~F.exists(F.slice(names, i + 2, F.size(names)), lambda n: n == x["k"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(F.lower(x["k"]), x["v"])))


def any_date(value: Column) -> Column:
    """A date in one of the five accepted patterns, else null."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(value, F.lit(p))) for p in ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyyMMdd")))
