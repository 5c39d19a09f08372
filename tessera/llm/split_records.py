"""Splitting oversized records at natural boundaries.

The tokens of a record get offset prefix sums (in the size unit; a token counts 1), and its boundaries one sorted array with their strengths. A piece that starts at
offset s ends at the last boundary in (s + overlap, s + limit], found by binary search; among the boundaries of the last ``1 / NEAR`` of that span the strongest kind
comes first, so strength costs a piece at most that much of its length. Where no boundary lies in the span the cut is hard at s + limit. The next piece starts
``overlap`` back from the cut. Every token is in a piece, and each step moves on by at least one token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.terms import SPACE

#: Marks that end a sentence, a clause, a phrase.
STRONG, MEDIUM, WEAK = ".!?…。！？؟۔।॥።፧", ":;：；؛·፤፥", ",،、，፣"
#: Marks that may close a quotation or bracket after them.
CLOSERS = "\"'”’»)]}」』）"
_KIND = {c: kind for kind, marks in enumerate((STRONG, MEDIUM, WEAK)) for c in marks}
_MARKS = frozenset(_KIND) | frozenset(CLOSERS)
#: The part of a piece's span, one in so many, within which a stronger boundary is preferred to a later one.
NEAR = 8
#: How each piece ends.
KINDS = ("end", "strong", "medium", "weak", "hard")


def boundaries(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted offsets after which the text pauses and their kinds: 1 sentence ends and places before a theme marker, 2 clause ends, 3 phrase ends."""
    found: dict[int, int] = {}
    n = len(tokens)
    for i, token in enumerate(tokens):
        if i and token[:2] == "-*":
            found[i] = 1
        if token[-1] not in _MARKS:
            continue
        last = (token.rstrip(CLOSERS) or (tokens[i - 1].rstrip(CLOSERS) if i else ""))[-1:]
        kind = _KIND.get(last)
        if kind is not None and (i + 1 == n or tokens[i + 1].strip(CLOSERS)):  # else closing marks follow, and the pause is after them
            found[i + 1] = kind + 1
    at = np.array(sorted(found), dtype=np.int64)
    return at, np.array([found[k] for k in at.tolist()], dtype=np.int64)


def cut(sizes: np.ndarray, marks: tuple[np.ndarray, np.ndarray], limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the pieces over tokens of the given sizes. A single token above the limit is a piece of its own."""
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    at, kinds = marks
    n, start, out = len(sizes), 0, []
    while offsets[n] - offsets[start] > limit:
        most = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        most = max(most, start + 1)
        least = int(np.searchsorted(offsets, offsets[start] + overlap, "right"))
        least = max(least, start + 1)
        near = max(least, most - (most - least) // NEAR)
        lo, mid, hi = (int(np.searchsorted(at, x, side)) for x, side in ((least, "left"), (near, "left"), (most, "right")))
        if mid < hi:
            k = hi - 1 - int(np.argmin(kinds[mid:hi][::-1]))
        else:
            k = hi - 1
        end, kind = (int(at[k]), KINDS[kinds[k]]) if k >= lo else (most, "hard")
        out.append((start, end, kind))
        back = int(np.searchsorted(offsets, offsets[end] - overlap, "left"))
        start = max(back, start + 1)
    out.append((start, n, "end"))
    return out


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for record, corpus, tokens, limit, overlap in zip(batch.record_id, batch.corpus_id, batch.tokens, batch.uce_size, batch.uce_overlap):
            tokens = list(tokens)
            for k, (a, b, kind) in enumerate(cut(np.ones(len(tokens), dtype=np.int64), boundaries(tokens), int(limit), int(overlap))):
                rows.append((record, corpus, k, a, b, kind, tokens[a:b]))
        yield pd.DataFrame(rows, columns=["record_id", "corpus_id", "piece", "start_token", "end_token", "cut", "tokens"])


def current_settings(config: DataFrame) -> DataFrame:
    """``corpus_id, uce_size, uce_overlap``: of each corpus the last row with a size; ties by the larger size, then overlap.

    Sizes under 1 count as missing. A null or negative overlap is 0; one not below the size is size - 1, so that pieces move on. A corpus with no size gives no row.
    """
    rows = config.where("corpus_id is not null and uce_size >= 1")
    order = F.struct(F.col("set_at"), F.col("uce_size"), F.col("uce_overlap"))
    last = rows.groupBy("corpus_id").agg(F.max(order).alias("last"))
    overlap = F.least(F.greatest(F.coalesce("last.uce_overlap", F.lit(0)), F.lit(0)), F.col("last.uce_size") - 1)
    return last.select("corpus_id", "last.uce_size", overlap.alias("uce_overlap"))


def visible(tokens: Column) -> Column:
    """The tokens that count: not null and not of white space only."""
    return F.filter(tokens, lambda t: t.isNotNull() & ~t.rlike(f"^{SPACE}*$"))


def split_records(records: DataFrame, config: DataFrame) -> DataFrame:
    """``record_id, corpus_id, piece, start_token, end_token, cut, tokens``: the pieces of every record longer than its corpus' ``uce_size``.

    A record's last delivery holds (ties, also unchanged redeliveries, by the row's hash); rows without ``record_id`` are left out. Null and blank tokens don't
    count and are left out; records within the limit, without tokens or of a corpus without a size give no piece. Pieces cover all counted tokens in order,
    each has at most ``uce_size``, and consecutive ones share ``uce_overlap`` tokens. The settings joined are one row per corpus. The last delivery is picked among
    slim rows (id, time, hash, whether above the limit); token arrays are read again and travel only for rows above their limit.
    """
    columns = records.where("record_id is not null").select("record_id", "corpus_id", "loaded_at", visible(F.col("tokens")).alias("tokens"))
    marked = columns.join(current_settings(config), "corpus_id", "left").withColumn("mark", F.xxhash64("loaded_at", "corpus_id", "tokens"))
    above = F.coalesce(F.size("tokens") > F.col("uce_size"), F.lit(False))
    slim = marked.select("record_id", F.struct("loaded_at", "mark", above.alias("above")).alias("row"))
    winners = slim.groupBy("record_id").agg(F.max("row").alias("row")).where("row.above").select("record_id", "row.mark")
    # rows delivered twice alike are one
    whole = marked.where(above).join(winners, ["record_id", "mark"], "left_semi").dropDuplicates(["record_id"])
    schema = "record_id bigint, corpus_id int, piece int, start_token int, end_token int, cut string, tokens array<string>"
    return whole.select("record_id", "corpus_id", "uce_size", "uce_overlap", "tokens").mapInPandas(_pieces, schema)
