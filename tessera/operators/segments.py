"""Segmentation of token sequences and the folds over ordered segments."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How strongly a token invites a cut after it; any other token weighs ``OTHER``.
WEIGHTS = {".": 6.0, "?": 6.0, "!": 6.0, "£$£": 6.0, ":": 5.0, ";": 4.0, ",": 1.0}
OTHER = 0.01


def cut_points(items: Sequence[str], target: int, most: int) -> list[tuple[int, int]]:
    """Spans of segments over tokens (or characters). Each cut maximises weight / (distance to ``target`` + 1) among the first ``most`` + 1 items, ties by the later
    item; a ``$`` cuts before itself and is left out. The last segment takes what remains."""
    spans, start, n = [], 0, len(items)
    while start < n:
        last = min(most, n - start - 1)
        window = items[start : start + last + 1]
        if "$" in window:
            at = list(window).index("$")
            if at:
                spans.append((start, start + at))
            start += at + 1
            continue
        at = max(range(last + 1), key=lambda i: (WEIGHTS.get(window[i], OTHER) / (abs(target - i) + 1), i))
        spans.append((start, start + at + 1))
        start += at + 1
    return spans


def segment_tokens(tokens: Column, size: int = 40, keep_marks: bool = False) -> Column:
    """An array of segments (arrays of tokens) of about ``size`` tokens, ``size`` + 16 at most; marks are dropped after cutting unless kept, and segments left empty."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def cut(batch: pd.Series) -> pd.Series:
        def one(tokens: Sequence[str] | None) -> list[list[str]] | None:
            if tokens is None:
                return None
            tokens = list(tokens)
            parts = [tokens[a:b] for a, b in cut_points(tokens, size, size + 15)]
            parts = parts if keep_marks else [[t for t in p if t not in WEIGHTS] for p in parts]
            return [p for p in parts if p]

        return batch.map(one)

    return cut(tokens)


def segment_characters(text: Column, size: int = 240, most: int = 360) -> Column:
    """An array of pieces of about ``size`` characters, ``most`` + 1 at most, cut at sentence marks where possible; blanks at their ends are removed."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else [s for a, b in cut_points(t, size, most) if (s := t[a:b].strip())])

    return cut(text)


def segments(docs: DataFrame, tokens: Column, size: int = 40) -> DataFrame:
    """``doc_id, seg, tokens``: the context units of every document, numbered from 0 within it."""
    return docs.select("doc_id", F.posexplode(segment_tokens(tokens, size)).alias("seg", "tokens"))


def merge_phrases(tokens: Column, phrases: Sequence[Sequence[str]], joiner: str = "_") -> Column:
    """Multi-word phrases joined to one token, scanning left to right, the longest phrase first."""
    by_first: dict[str, list[tuple[str, ...]]] = {}
    for p in sorted({tuple(p) for p in phrases if len(p) > 1}, key=lambda p: (-len(p), p)):
        by_first.setdefault(p[0], []).append(p)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def merge(batch: pd.Series) -> pd.Series:
        def one(tokens: Sequence[str] | None) -> list[str] | None:
            if tokens is None:
                return None
            out, i, tokens = [], 0, list(tokens)
            while i < len(tokens):
                hit = next((p for p in by_first.get(tokens[i], ()) if tuple(tokens[i : i + len(p)]) == p), None)
                out.append(joiner.join(hit) if hit else tokens[i])
                i += len(hit) if hit else 1
            return out

        return batch.map(one)

    return merge(tokens)


def unit_groups(sizes: DataFrame, limit: int = 12, key: str = "doc_id", order: str = "seg") -> DataFrame:
    """``key, order, unit``: consecutive segments of a paragraph grouped until they hold more than ``limit`` distinct active forms (``size``).

    A segment joins the current group while the group's size so far is at most ``limit``. Groups restart with the key, so the fold runs inside one array a document.
    """
    packed = sizes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "size"))).alias("xs"))
    start = F.struct(F.lit(0).cast("bigint").alias("held"), F.lit(0).alias("unit"), F.array().cast(f"array<struct<{order}:bigint,unit:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["held"] <= limit
        unit = F.when(fits, acc["unit"]).otherwise(acc["unit"] + 1)
        held = F.when(fits, acc["held"] + x["size"]).otherwise(x["size"].cast("bigint"))
        row = F.struct(x[order].cast("bigint").alias(order), unit.alias("unit"))
        return F.struct(held.cast("bigint").alias("held"), unit.alias("unit"), F.concat(acc["out"], F.array(row)).alias("out"))

    folded = packed.select(key, F.explode(F.aggregate("xs", start, step, lambda acc: acc["out"])).alias("r"))
    return folded.select(key, f"r.{order}", "r.unit")
