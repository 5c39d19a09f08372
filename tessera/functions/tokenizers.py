"""Tokenisers as column expressions: maximal word runs, then a full match, which reads alike in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = r"[\p{L}\p{N}_]+"
_LATIN = "a-zA-ZÀ-ÿ"
#: Marks stripped from both ends of blank-separated tokens.
EDGE_MARKS = ".,;:!?\"'()[]{}"
#: name -> (pattern of a run, pattern the whole run must match or None, lower-cased)
_RULES: dict[str, tuple[str, str | None, bool]] = {
    "alpha": (_WORD, f"[{_LATIN}]+", True),
    "alpha2": (_WORD, f"[{_LATIN}]{{2,}}", True),
    "alpha3": (_WORD, f"[{_LATIN}]{{3,}}", True),
    "compound": (_WORD, f"[{_LATIN}]+(?:_[{_LATIN}]+)*", True),
    "kwic": (r"\p{L}[\p{L}\p{M}\p{N}]*(?:['’_\-][\p{L}\p{M}\p{N}]+)*", None, False),
    "word": (_WORD, r".*\p{L}.*", True),
    "sent": (_WORD, ".{2,}", True),
}


def tokenize(text: Column, rule: str = "alpha3") -> Column:
    """The array of tokens of ``text``; null for null. Rules: ``ws`` and the names of the catalogue (alpha, alpha2, alpha3, compound, kwic, word, sent, strict)."""
    if rule == "ws":
        return F.filter(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.trim(w, F.lit(EDGE_MARKS))), lambda w: w != "")
    if rule == "strict":
        return F.filter(F.split(text, r"\s+"), lambda w: w != "")
    run, whole, lower = _RULES[rule]
    found = F.regexp_extract_all(F.lower(text) if lower else text, F.lit(run), F.lit(0))
    return F.filter(found, lambda w: w.rlike(f"^(?:{whole})$")) if whole else found


def tokens(docs: DataFrame, rule: str = "alpha3", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, pos, form``: one row a token, positions from 0 within the document. Null and empty texts give none."""
    return docs.select(key, F.posexplode(tokenize(F.col(text), rule)).alias("pos", "form"))
