"""Descending hierarchical classification of segments (Reinert) on the presence table ``uce_id, form``.

A node is split along the first axis of its correspondence analysis: the axis by power iteration on the presence table, the units in the order of their coordinate,
prefix sums of term counts over the units, of all cuts the one with the greatest chi-square. Units then move to the other side while the chi-square grows.

Forms are numbered once and units are packed into blocks, rows of a few binary columns, so that a node's state is a vector over the vocabulary: a round reads the blocks once and adds
up vectors. Small nodes are split so within one task, large ones by a job a round whose tasks each send one vector to the driver; the sums, start, rounds, cuts and moves are the same.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.measures import signed_chi2
from tessera.operators.tables import crossed_classes
from tessera.session import dropped, scratch, written


#: Nodes up to this size are split within one task: a cell counts one, or two where there are more forms than 16 bits number, a unit eight, as its key, place and coordinate are held too. Two bytes each, some copies.
KERNEL_CELLS = 40_000_000
#: Cells of a block of units, and of a range of the coordinate.
BLOCK_CELLS, RANGE_CELLS = 250_000, 2_000_000
#: Of a block, at most so many units tell where ranges of the coordinate begin.
BLOCK_MARKS = 64
#: Rounds of the power iteration and of moves, in one task and by distributed passes alike.
ROUNDS, REFINE = 60, 8
#: Decimals of coordinates and shares, and of chi-squares, so that the order of sums decides nothing.
DECIMALS, CHI2_DECIMALS = 12, 7

#: Units in blocks: their keys, where the terms of each start and the last ends, and the terms.
Block = tuple[np.ndarray, np.ndarray, np.ndarray]
#: A block as a row: how many units it has, their keys as 64 bit integers, their numbers of terms in the least bytes that hold the largest, and the terms in two bytes, or four where there are more forms.
BLOCK_ROW = "units int, ids binary, sizes binary, terms binary"
#: How a unit is placed: by its coordinate and key against a cut, or by the mean share of its terms against a threshold.
Rule = tuple


@dataclass
class Node:
    node_id: int
    parent_id: int | None
    depth: int
    left_id: int | None = None
    right_id: int | None = None
    split_chi2: float | None = None
    class_id: int | None = None


@dataclass
class Split:
    rule: Rule
    chi2: float
    #: Units and cells of both sides.
    units: tuple[int, int]
    cells: tuple[int, int]


def _means(starts: np.ndarray, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values[terms], starts[:-1]) / np.diff(starts) if len(terms) else np.zeros(0)


def _sides(block: Block, rule: Rule) -> np.ndarray:
    """Of each unit, whether it is on side 1."""
    ids, starts, terms = block
    if rule[0] == "share":
        _, share, threshold = rule
        return np.round(_means(starts, terms, share), DECIMALS) < threshold
    _, axis, mean, coord, last = rule
    own = np.round(_means(starts, terms, axis) - mean, DECIMALS)
    return (own > coord) | (own == coord) & (ids > last)


def _steps(starts: np.ndarray, terms: np.ndarray, counts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """What each unit of a block, in the order of the coordinate, adds to q (see ``_cut``); ``before`` has the cells of each term before the block and then those up to its end."""
    order = np.argsort(terms, kind="stable")
    sorted_ = terms[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(sorted_)) + 1))
    within = np.empty(len(terms), dtype=np.int64)
    within[order] = np.arange(len(terms)) - np.repeat(first, np.diff(np.append(first, len(terms))))
    out = np.add.reduceat((2 * (before[terms] + within) + 1) / counts[terms], starts[:-1])
    before += np.bincount(terms, minlength=len(counts))
    return out


def _cut(q: np.ndarray, left: np.ndarray, before: np.ndarray, total: float, units: int, least: int) -> tuple[float, int] | None:
    """The greatest chi-square of the cuts after each unit and where it is. It is T^2 q / (L R) - T L / R with q the sum of l^2 / t; a cell adds (2l + 1) / t, l its term's cells before it."""
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = np.where((right > 0) & (before >= least) & (units - before >= least), np.round(total**2 * q / (left * right) - total * left / right, CHI2_DECIMALS), -np.inf)
    at = int(np.argmax(chi2)) if len(chi2) else 0
    return (float(chi2[at]), at) if len(chi2) and np.isfinite(chi2[at]) else None


def _in_order(rows: Block, order: np.ndarray) -> Iterator[Block]:
    """The units in another order, in blocks."""
    ids, starts, terms = rows
    sizes = np.diff(starts)[order]
    ends = np.cumsum(sizes)
    a = 0
    while a < len(order):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK_CELLS, "right")))
        own = np.concatenate(([0], np.cumsum(sizes[a:b])))
        yield ids[order[a:b]], own, terms[np.repeat(starts[order[a:b]] - own[:-1], sizes[a:b]) + np.arange(own[-1])]
        a = b


class _Rows:
    """A node's units in memory."""

    def __init__(self, blocks: Iterable[Block]):
        ids, sizes, terms = zip(*((i, np.diff(s), t) for i, s, t in blocks), strict=True)
        ids, starts, terms = np.concatenate(ids), np.concatenate(([0], *sizes)).cumsum(), np.concatenate(terms)
        self.blocks = list(_in_order((ids, starts, terms), np.argsort(ids, kind="stable")))

    def sums(self, f: Callable[[Block], np.ndarray], ids: bool = False) -> np.ndarray:
        return sum(map(f, self.blocks))

    def best(self, axis: np.ndarray, mean: float, counts: np.ndarray, units: int, least: int) -> tuple[float, float, int] | None:
        coord = np.concatenate([np.round(_means(s, t, axis) - mean, DECIMALS) for _, s, t in self.blocks])
        ids, sizes, terms = (np.concatenate([b[k] if k != 1 else np.diff(b[1]) for b in self.blocks]) for k in range(3))
        order = np.lexsort((ids, coord))
        before = np.zeros(len(counts))
        steps = [_steps(s, t, counts, before) for _, s, t in _in_order((ids, np.concatenate(([0], sizes)).cumsum(), terms), order)]
        found = _cut(np.cumsum(np.concatenate(steps)), np.cumsum(sizes[order]), np.arange(1, units + 1), counts.sum(), units, least)
        return None if found is None else (found[0], coord[order[found[1]]], ids[order[found[1]]])


class _Passes:
    """A node's units as a table of blocks that is read once a pass."""

    def __init__(self, rows: DataFrame, bins: int):
        self.rows, self.bins = rows, bins

    def sums(self, f: Callable[[Block], np.ndarray], ids: bool = False) -> np.ndarray:
        """``f`` added up over the blocks, whose keys are read only if it needs their ``ids``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for block in _blocks(batches):
                total = f(block) if total is None else total + f(block)
            if total is not None:
                yield pa.RecordBatch.from_pydict({"sums": [total.astype(float).tobytes()]})

        rows = self.rows if ids else self.rows.drop("ids")
        return sum(np.frombuffer(r.sums) for r in rows.mapInArrow(run, "sums binary").collect())  # a row a task

    def best(self, axis: np.ndarray, mean: float, counts: np.ndarray, units: int, least: int) -> tuple[float, float, int] | None:
        """Each range of the coordinate in a task, on top of the term counts of the ranges before it."""
        total = counts.sum()
        marks = self._marks(axis, mean, int(max(1, min(self.bins, total // RANGE_CELLS))), total)
        n = len(marks) + 1

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
            for ids, s, t in _blocks(batches):
                coord = np.round(_means(s, t, axis) - mean, DECIMALS)
                yield (ids, s, t), coord, _ranges(coord, ids, marks)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: dict[int, np.ndarray] = {}
            for (_, s, t), _, bins in placed(batches):
                for k in np.unique(bins):
                    here = bins == k
                    add = np.append(np.bincount(t[np.repeat(here, np.diff(s))], minlength=len(counts)), here.sum()).astype(float)
                    own[int(k)] = own[int(k)] + add if int(k) in own else add
            yield pa.RecordBatch.from_pydict({"bin": pa.array(own, pa.int32()), "sums": pa.array([v.tobytes() for v in own.values()], pa.binary())})

        held = np.zeros((n + 1, len(counts) + 1))
        for r in self.rows.mapInArrow(count, "bin int, sums binary").toLocalIterator():  # a row a task and range
            held[r.bin + 1] += np.frombuffer(r.sums)
        offsets = np.cumsum(held, axis=0)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, coord, bins in placed(batches):
                for k in np.unique(bins):
                    here = bins == k
                    yield pa.RecordBatch.from_arrays([*_row(_chosen(block, here)).columns, pa.array([coord[here].tobytes()]), pa.array([k], pa.int32())], [*_ROW_NAMES, "coord", "bin"])

        def search(key: tuple, table: pa.Table) -> pa.Table:
            at = offsets[key[0].as_py()]
            rows = _joined([b for batch in table.to_batches() for b in _blocks([batch])])
            coord = np.concatenate([np.frombuffer(c.as_py()) for c in table.column("coord")])
            order = np.lexsort((rows[0], coord))
            before = at[:-1].copy()
            steps = np.concatenate([_steps(s, t, counts, before) for _, s, t in _in_order(rows, order)])
            q, left = np.cumsum(steps) + (at[:-1] ** 2 / np.maximum(counts, 1)).sum(), np.cumsum(np.diff(rows[1])[order]) + at[:-1].sum()
            found = _cut(q, left, np.arange(1, len(order) + 1) + at[-1], total, units, least)
            return _BEST.empty_table() if found is None else pa.Table.from_pylist([{"bin": key[0].as_py(), "chi2": found[0], "coord": coord[order[found[1]]], "uce_id": rows[0][order[found[1]]]}], _BEST)

        ranged = self.rows.mapInArrow(part, BLOCK_ROW + ", coord binary, bin int")
        found = ranged.groupBy("bin").applyInArrow(search, "bin int, chi2 double, coord double, uce_id bigint").orderBy(F.desc("chi2"), "bin").first()
        return None if found is None else (found.chi2, found.coord, found.uce_id)

    def _marks(self, axis: np.ndarray, mean: float, n: int, total: float) -> np.ndarray:
        """Coordinates and keys where the second and later of ``n`` ranges of about as many cells begin. Blocks tell units at equal distances in cells; all cuts are tried wherever ranges begin."""
        each = int(max(1, min(BLOCK_MARKS, 32 * n * BLOCK_CELLS // max(1, total))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, s, t in _blocks(batches):
                coord = np.round(_means(s, t, axis) - mean, DECIMALS)
                order = np.lexsort((ids, coord))
                ends = np.cumsum(np.diff(s)[order])
                at = order[np.unique(np.searchsorted(ends, ends[-1] * (np.arange(each) + 0.5) / each))]
                yield pa.RecordBatch.from_pydict({"coord": coord[at], "uce_id": ids[at]})

        if n == 1:
            return _marked([], [])
        found = self.rows.mapInArrow(run, "coord double, uce_id bigint").collect()  # a few rows a block
        marks = _marked([r.coord for r in found], [r.uce_id for r in found])
        marks = marks[np.lexsort((marks["id"], marks["coord"]))]
        return np.unique(marks[np.arange(1, n) * len(marks) // n])


def _marked(coord: list[float], ids: list[int]) -> np.ndarray:
    out = np.empty(len(coord), dtype=[("coord", float), ("id", np.int64)])
    out["coord"], out["id"] = coord, ids
    return out


def _ranges(coord: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Of each unit, how many marks come at or before it in the order of coordinate and key."""
    out = np.searchsorted(marks["coord"], coord, "left")
    for k in np.flatnonzero(out < np.searchsorted(marks["coord"], coord, "right")):
        same = marks["id"][marks["coord"] == coord[k]]
        out[k] += np.searchsorted(same, ids[k], "right")
    return out


_BEST = pa.schema([("bin", pa.int32()), ("chi2", pa.float64()), ("coord", pa.float64()), ("uce_id", pa.int64())])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        keys = batch.column("ids") if "ids" in batch.schema.names else [None] * batch.num_rows
        for units, ids, sizes, terms in zip(batch.column("units"), keys, batch.column("sizes"), batch.column("terms"), strict=True):
            sizes, terms = sizes.as_buffer(), terms.as_buffer()
            starts = np.concatenate(([0], np.frombuffer(sizes, f"u{sizes.size // units.as_py()}"))).astype(np.int64).cumsum()
            yield None if ids is None else np.frombuffer(ids.as_buffer(), np.int64), starts, np.frombuffer(terms, np.uint16 if terms.size < 4 * starts[-1] else np.int32)


_ROW_NAMES = ["units", "ids", "sizes", "terms"]


def _row(block: Block) -> pa.RecordBatch:
    ids, starts, terms = block
    sizes = np.diff(starts)
    columns = [pa.array([len(ids)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids.astype(np.int64), sizes.astype(np.min_scalar_type(int(sizes.max()))), terms))]
    return pa.RecordBatch.from_arrays(columns, _ROW_NAMES)


def _chosen(block: Block, here: np.ndarray) -> Block:
    ids, starts, terms = block
    sizes = np.diff(starts)
    return ids[here], np.concatenate(([0], sizes[here])).cumsum(), terms[np.repeat(here, sizes)]


def _joined(blocks: list[Block]) -> Block:
    return np.concatenate([b[0] for b in blocks]), np.concatenate(([0], *(np.diff(b[1]) for b in blocks))).cumsum(), np.concatenate([b[2] for b in blocks])


def _full(blocks: Iterable[Block]) -> Iterator[Block]:
    """Blocks put together to blocks of at least BLOCK_CELLS, but for the last; empty ones are left out."""
    held: list[Block] = []
    for block in blocks:
        if len(block[0]):
            held.append(block)
        if sum(len(b[2]) for b in held) >= BLOCK_CELLS:
            yield _joined(held)
            held = []
    if held:
        yield _joined(held)


def _grouped(ids: np.ndarray, terms: np.ndarray) -> Block:
    """Cells in any order and more than once as units in the order of their keys, with ascending distinct terms."""
    low, wide = int(ids.min()), int(terms.max()) + 1
    if (int(ids.max()) - low + 1) * wide < 2**63:
        key = (ids - low) * wide + terms
        key.sort()
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        ids, terms = key // wide + low, key % wide
    else:
        order = np.lexsort((terms, ids))
        ids, terms = ids[order], terms[order]
        new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (terms[1:] != terms[:-1])))
        ids, terms = ids[new], terms[new]
    at = np.concatenate(([0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]))
    return ids[at[:-1]], at, terms


def _best_split(rows: _Rows | _Passes, forms: int, least: int, rounds: int, refine: int) -> Split | None:
    """The split of a node whose terms are numbered below ``forms``; None if no cut leaves ``least`` units on both sides."""

    def first(block: Block) -> np.ndarray:
        return np.append(np.bincount(block[2], minlength=forms), len(block[1]) - 1)

    def moments(axis: np.ndarray | None) -> tuple[np.ndarray, float, float]:
        """Of the coordinates by the terms' values: their sum at each term, mean and deviation; without values a deterministic start from the units' keys, in [-1, 1]."""

        def f(block: Block) -> np.ndarray:
            ids, starts, terms = block[0], block[1], block[2].astype(np.intp)
            r = np.diff(starts)
            coord = _means(starts, terms, axis) if axis is not None else (ids % 2001 * 7919 % 2001) / 1000.0 - 1.0
            return np.append(np.bincount(terms, np.repeat(coord, r), forms), [(r * coord).sum(), (r * coord**2).sum()])

        found = rows.sums(f, ids=axis is None)
        mean = found[-2] / total
        return found[:-2], mean, max(found[-1] - total * mean**2, 0.0) ** 0.5

    *counts, units = rows.sums(first)
    counts, units = np.array(counts), int(units)
    total, some = counts.sum(), np.maximum(counts, 1)
    if units < 2 * least:
        return None
    axis = None
    for _ in range(rounds):
        at_terms, mean, size = moments(axis)
        axis = np.where(counts > 0, (at_terms / some - mean) / (size or 1.0), 0.0)
    if axis is None:
        raise ValueError("no rounds")
    mean = float((axis * counts).sum() / total)
    found = rows.best(axis, mean, counts, units, least)
    if found is None:
        return None
    score, coord, last = found

    def left(rule: Rule) -> np.ndarray:
        def f(block: Block) -> np.ndarray:
            here = ~_sides(block, rule)
            return np.append(np.bincount(block[2][np.repeat(here, np.diff(block[1]))], minlength=forms), here.sum())

        return rows.sums(f, ids=rule[0] == "cut")

    rule: Rule = ("cut", axis, mean, coord, last)
    held = left(rule)
    for _ in range(refine):
        moved: Rule = ("share", held[:-1] / some, np.round(held[:-1].sum() / total, DECIMALS))
        fresh = left(moved)
        left0, units0 = float(fresh[:-1].sum()), int(fresh[-1])
        if min(units0, units - units0) < least or not 0 < left0 < total:
            break
        value = round(total**2 * float((fresh[:-1] ** 2 / some).sum()) / (left0 * (total - left0)) - total * left0 / (total - left0), CHI2_DECIMALS)
        if value <= score:
            break
        rule, score, held = moved, value, fresh
    cells0, units0 = int(held[:-1].sum()), int(held[-1])
    return Split(rule, float(score), (units0, units - units0), (cells0, int(total) - cells0))


def split_kernel(unit: np.ndarray, term: np.ndarray, least: int, rounds: int = ROUNDS, refine: int = REFINE, ids: np.ndarray | None = None) -> tuple[np.ndarray, float] | None:
    """The side of each unit (numbered from 0) and the chi-square of the split of a node given by its cells; None if no cut leaves ``least`` units on both sides.

    ``ids`` are the units' ascending keys, by default their numbers."""
    if not len(unit):
        return None
    order = np.lexsort((term, unit))
    ids = np.arange(int(unit.max()) + 1) if ids is None else ids
    rows = _Rows([(ids, np.concatenate(([0], np.bincount(unit, minlength=len(ids)))).cumsum(), np.unique(term, return_inverse=True)[1][order])])
    found = _best_split(rows, int(len(np.unique(term))), least, rounds, refine)
    return None if found is None else (np.concatenate([_sides(b, found.rule) for b in rows.blocks]).astype(int), found.chi2)


def _narrow(forms: int) -> type:
    return np.uint16 if forms <= 2**16 else np.int32


def _packed(presence: DataFrame) -> tuple[DataFrame, int]:
    """``uce_id, terms``: a row a unit with the ascending numbers of its forms; and the number of forms, which are numbered in their order."""
    x = written(presence.select("uce_id", "form"), "presence")
    numbered, forms = _numbered(x.groupBy("form").agg(F.count("*").alias("k")))
    packed = x.join(F.broadcast(numbered) if forms <= MOST_BROADCAST else numbered, "form").groupBy("uce_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    return written(packed, "packed"), forms


def _numbered(forms: DataFrame) -> tuple[DataFrame, int]:
    """``form, term``: the forms numbered in their order; and how many there are."""
    ranged = written(forms.repartitionByRange("form").withColumn("part", F.spark_partition_id()).select("form", "part"), "forms")
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy("part").count().collect())  # a row a partition
    starts = {p: sum(n for _, n in sizes[:k]) for k, (p, _) in enumerate(sizes)}
    offsets = forms.sparkSession.createDataFrame(list(starts.items()), "part int, start long")
    numbered = ranged.join(F.broadcast(offsets), "part").select("form", (F.row_number().over(Window.partitionBy("part").orderBy("form")) - 1 + F.col("start")).cast("int").alias("term"))
    return written(numbered, "numbered"), sum(n for _, n in sizes)


#: Numbered forms up to this many are sent to all tasks.
MOST_BROADCAST = 50_000


def _blocked(rows: DataFrame, forms: int) -> DataFrame:
    """The blocks of ``uce_id, terms`` with a row a unit; units without terms are left out."""
    kind = _narrow(forms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[Block]:
            for batch in batches:
                terms = batch.column("terms")
                starts = terms.offsets.to_numpy().astype(np.int64)
                yield _chosen((batch.column("uce_id").to_numpy(), starts - starts[0], terms.flatten().to_numpy().astype(kind)), np.diff(starts) > 0)

        yield from map(_row, _full(blocks()))

    return rows.mapInArrow(run, BLOCK_ROW)


@dataclass
class Packed:
    """Units in blocks, the vocabulary ``form, term`` and its size."""

    blocks: DataFrame
    vocabulary: DataFrame
    forms: int


def packed_units(postings: DataFrame, most: int) -> Packed:
    """The units of ``uce_id, form`` (rows may repeat; those without a unit or with a blank form are left out) over the ``most`` forms met in most units, ties by form.

    No form is met in more units than it has rows, so the forms with most rows are packed first; they hold the vocabulary if its last form is met in more units than any other form has rows.
    Otherwise all forms are packed. The strings are read twice and never shuffled, unless there are more forms than ``MOST_BROADCAST`` and rows don't tell them apart."""
    rows = postings.where(F.col("uce_id").isNotNull() & F.col("form").isNotNull()).select(F.col("uce_id").cast("bigint").alias("uce_id"), "form")
    counts = written(rows.groupBy("form").agg(F.count("*").alias("k")).where(F.trim("form") != ""), "counts")  # blank forms have no number later on
    every = counts.count()
    width = max(MOST_BROADCAST, 2 * most)
    if every > width:
        first = written(counts.orderBy(F.desc("k"), "form").limit(width), "first")
        found = _packed_units(rows, *_numbered(first), most, int(first.agg(F.min("k")).first()[0]))
        if found is not None:
            return found
    return _packed_units(rows, *_numbered(counts), most, 0)


def _packed_units(rows: DataFrame, numbered: DataFrame, forms: int, most: int, least: int) -> Packed | None:
    """The units over the ``most`` of the numbered forms; None if the last of them isn't met in more than ``least`` units."""
    kind = _narrow(forms)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, terms in _runs((b.column("uce_id").to_numpy(), b.column("term").to_numpy()) for b in batches):
            ids, starts, terms = _grouped(ids, terms)
            ends, data = pa.py_buffer((starts * 4).astype(np.int32)), pa.py_buffer(terms.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.Array.from_buffers(pa.binary(), len(ids), [None, ends, data])], ["uce_id", "terms"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for b in (b for b in batches if b.num_rows):
                terms = b.column("terms").cast(pa.large_binary())
                ends = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset : terms.offset + len(terms) + 1]
                yield np.repeat(b.column("uce_id").to_numpy(), np.diff(ends) // 4), np.frombuffer(terms.buffers()[2], np.int32)[ends[0] // 4 : ends[-1] // 4]

        for ids, terms in _runs(cells(), whole=True):
            ids, starts, terms = _grouped(ids, terms)
            yield _row((ids, starts, terms.astype(kind)))

    cells = rows.join(F.broadcast(numbered) if forms <= max(MOST_BROADCAST, 2 * most) else numbered, "form").select("uce_id", "term")
    merged = cells.mapInArrow(pack, "uce_id bigint, terms binary").repartition("uce_id").sortWithinPartitions("uce_id").mapInArrow(merge, BLOCK_ROW)
    blocks = written(merged, "blocks")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(forms, dtype=np.int64)
        for _, _, terms in _blocks(batches):
            total += np.bincount(terms, minlength=forms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": some.astype(np.int32), "k": total[some]})

    kept = written(blocks.mapInArrow(met, "term int, k bigint").groupBy("term").agg(F.sum("k").alias("k")).join(numbered, "term").orderBy(F.desc("k"), "form").limit(most), "kept")
    if least and kept.agg(F.min("k")).first()[0] <= least:
        dropped(blocks)
        return None
    if forms <= most:
        return Packed(blocks, numbered, forms)
    vocabulary, size = _numbered(kept)
    places = np.full(forms, -1, dtype=np.int32)
    for r in kept.select("term", "form").join(vocabulary.withColumnRenamed("term", "place"), "form").select("term", "place").collect():  # at most ``most``
        places[r.term] = r.place
    narrow = _narrow(size)

    def renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[Block]:
            for ids, starts, terms in _blocks(batches):
                fresh = places[terms]
                sizes = np.add.reduceat(fresh >= 0, starts[:-1], dtype=np.int64)
                yield ids[sizes > 0], np.concatenate(([0], sizes[sizes > 0])).cumsum(), fresh[fresh >= 0].astype(narrow)

        yield from map(_row, _full(found()))

    out = written(blocks.mapInArrow(renumber, BLOCK_ROW), "renumbered")
    dropped(blocks)
    return Packed(out, vocabulary, size)


def _runs(cells: Iterable[tuple[np.ndarray, np.ndarray]], whole: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells (keys and terms) put together to runs of at least BLOCK_CELLS; ``whole``: keys come in their order and the cells of one are in one run."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for ids, terms in cells:
        if not len(ids):
            continue
        held.append((ids, terms))
        size += len(ids)
        if size < BLOCK_CELLS or whole and held[0][0][0] == ids[-1]:
            continue
        ids, terms = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.searchsorted(ids, ids[-1])) if whole else len(ids)
        yield ids[:cut], terms[:cut]
        held = [(ids[cut:], terms[cut:])] if cut < len(ids) else []
        size = len(ids) - cut
    if held:
        ids, terms = (np.concatenate(x) for x in zip(*held, strict=True))
        yield ids, terms


def _sided(blocks: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """The blocks of both sides of a split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[Block], list[Block]] = ([], [])
        for block in _blocks(batches):
            right = _sides(block, rule)
            for side, here in enumerate((~right, right)):
                if here.any():
                    held[side].append(_chosen(block, here))
                if sum(len(b[2]) for b in held[side]) >= BLOCK_CELLS:
                    yield from out(side, held[side])
                    held[side].clear()
        for side in (0, 1):
            yield from out(side, held[side])

    def out(side: int, blocks: list[Block]) -> Iterator[pa.RecordBatch]:
        for block in _full(blocks):
            yield pa.RecordBatch.from_arrays([*_row(block).columns, pa.array([side], pa.int32())], [*_ROW_NAMES, "side"])

    path = scratch(blocks.sparkSession, "sides")
    blocks.mapInArrow(run, BLOCK_ROW + ", side int").write.partitionBy("side").parquet(path)
    return tuple(blocks.sparkSession.read.schema(BLOCK_ROW).parquet(f"{path}/side={k}") for k in (0, 1))


def _units(blocks: DataFrame) -> DataFrame:
    """``uce_id`` of the units in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, _ in _blocks(batches):
            yield pa.RecordBatch.from_pydict({"uce_id": ids})

    return blocks.mapInArrow(run, "uce_id bigint")


def split(x: DataFrame, least: int = 5, bins: int = 512, rounds: int = ROUNDS, refine: int = REFINE) -> tuple[DataFrame, float] | None:
    """``uce_id, side`` (0 or 1) of a node's units and the chi-square of the split, by distributed passes; None if no cut leaves ``least`` units on both sides.

    Every cut is tried: prefix sums over all units are sums within up to ``bins`` ranges of the coordinate, from the totals of the ranges before."""
    rows, forms = _packed(x)
    blocks = written(_blocked(rows, forms), "blocks")
    found = _best_split(_Passes(blocks, bins), forms, least, rounds, refine) if forms else None
    if found is None:
        return None
    left, right = _sided(blocks, found.rule)
    return _units(left).withColumn("side", F.lit(0)).unionByName(_units(right).withColumn("side", F.lit(1))), found.chi2


def _offers(leaves: dict[int, DataFrame], sizes: dict[int, int], forms: int, least: int, bins: int) -> dict[int, Split | None]:
    """The best split of each leaf: small leaves in a task each, all at once, large ones by distributed passes."""

    def task(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = list(_blocks(batches))
            rows = _Rows(blocks) if blocks else None
            blocks.clear()
            found = _best_split(rows, forms, least, ROUNDS, REFINE) if rows else None
            yield pa.RecordBatch.from_pydict({"node_id": pa.array([k], pa.int32()), "split": [pickle.dumps(found)]})

        return run

    out, small = {}, None
    for k, rows in leaves.items():
        if sizes[k] > KERNEL_CELLS:
            out[k] = _best_split(_Passes(rows, bins), forms, least, ROUNDS, REFINE)
        else:
            part = rows.coalesce(1).mapInArrow(task(k), "node_id int, split binary")
            small = part if small is None else small.unionAll(part)
    for r in small.collect() if small is not None else ():  # a row a leaf
        out[r.node_id] = pickle.loads(r.split)
    return {k: out.get(k) for k in leaves}


def classify(presence: DataFrame, classes: int = 5, least: int = 5, bins: int = 512) -> tuple[DataFrame, list[Node]]:
    """``uce_id, class_id`` and the tree: the leaf whose best split has the greatest chi-square is split until there are ``classes`` leaves, which are numbered from
    left to right. Units without terms are in no class. ``presence`` has distinct (uce_id, form) rows."""
    rows, forms = _packed(presence)
    leaves, nodes = _tree(written(_blocked(rows, forms), "blocks"), forms, classes, least, bins)
    return classes_of(leaves), nodes


def classify_packed(packed: Packed, classes: int = 5, least: int = 5, bins: int = 512) -> tuple[dict[int, DataFrame], list[Node]]:
    """The blocks of each class, by its number, and the tree; see ``classify``."""
    return _tree(packed.blocks, packed.forms, classes, least, bins)


def classes_of(leaves: dict[int, DataFrame]) -> DataFrame:
    """``uce_id, class_id``."""
    out = None
    for c, blocks in leaves.items():
        part = _units(blocks).withColumn("class_id", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return out


def _tree(blocks: DataFrame, forms: int, classes: int, least: int, bins: int) -> tuple[dict[int, DataFrame], list[Node]]:
    nodes = {1: Node(1, None, 0)}
    members = {1: blocks}
    weight = np.dtype(_narrow(forms)).itemsize // 2
    first = blocks.agg(F.coalesce(F.sum(F.length("terms") / 2 + F.col("units") * 8), F.lit(0.0))).first()[0]
    sizes = {1: int(first)}
    offers: dict[int, Split | None] = {}
    leaves = [1]
    while len(leaves) < classes:
        fresh = [k for k in leaves if k not in offers]
        if fresh:
            offers |= _offers({k: members[k] for k in fresh}, sizes, forms, least, bins)
        open_ = [(o.chi2, -k) for k in leaves if (o := offers[k])]
        if not open_:
            break
        chi2, k = max(open_)
        k = -k
        found = offers[k]
        left, right = max(nodes) + 1, max(nodes) + 2
        nodes[left], nodes[right] = Node(left, k, nodes[k].depth + 1), Node(right, k, nodes[k].depth + 1)
        nodes[k].left_id, nodes[k].right_id, nodes[k].split_chi2 = left, right, chi2
        for side, (leaf, own) in enumerate(zip((left, right), _sided(members[k], found.rule), strict=True)):
            members[leaf] = own
            sizes[leaf] = found.cells[side] * weight + 8 * found.units[side]
        leaves.remove(k)
        leaves += [left, right]

    def walk(k: int) -> list[int]:
        n = nodes[k]
        return [k] if n.left_id is None else walk(n.left_id) + walk(n.right_id)

    out = {}
    for c, k in enumerate(walk(1), 1):
        nodes[k].class_id = c
        out[c] = members[k]
    return out, list(nodes.values())


def double_classification(presence: DataFrame, first: DataFrame, second: DataFrame, classes: int = 5, least: int = 5, share: float = 0.0) -> DataFrame:
    """``uce_id, class_id`` on which two classifications agree: of segments grouped into the units of ``first`` and of ``second`` (``uce_id, unit``).

    Both are classified; pairs of classes that share more segments than chance (signed chi-square above 3.84) are taken from the strongest on, each class once, and are the stable
    classes, numbered by size. Segments in none of them, or in one with less than ``share`` of all, are in class 0. Classes are few: their pairs are chosen on the driver.
    """
    sides = []
    packed, forms = _packed(presence)
    for units in (first, second):
        units = written(units.select("uce_id", "unit"), "units")
        merged = packed.join(units, "uce_id").groupBy(F.col("unit").alias("uce_id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))
        found = classes_of(_tree(written(_blocked(merged, forms), "grouped"), forms, classes, least, 512)[0]).withColumnRenamed("uce_id", "unit")
        sides.append(written(units.join(found, "unit").select("uce_id", "class_id"), "sides"))
    cells = crossed_classes(*sides).orderBy(F.desc("chi2"), "class_a", "class_b").limit(classes**2).collect()
    taken, used_a, used_b = [], set(), set()
    for r in cells:
        if r.class_a not in used_a and r.class_b not in used_b:
            used_a.add(r.class_a)
            used_b.add(r.class_b)
            taken.append((r.class_a, r.class_b, r.n))
    every = first.select("uce_id").distinct()
    enough = share * every.count()
    kept = [(a, b, k) for k, (a, b, n) in enumerate(sorted(taken, key=lambda t: (-t[2], t[0], t[1])), 1) if n >= enough]
    stable = presence.sparkSession.createDataFrame(kept, "a int, b int, stable int")
    placed = sides[0].withColumnRenamed("class_id", "a").join(sides[1].withColumnRenamed("class_id", "b"), "uce_id").join(stable, ["a", "b"])
    return every.join(placed.select("uce_id", "stable"), "uce_id", "left").select("uce_id", F.coalesce("stable", F.lit(0)).alias("class_id"))


def profiles(presence: DataFrame, classes: DataFrame, least: int = 1) -> DataFrame:
    """``class_id, form, freq, in_all, pct, chi2, sign``: signed chi-square of each term in each class, by units that hold it; terms a class lacks are left out."""
    placed = presence.join(classes, "uce_id")
    cells = placed.groupBy("class_id", "form").agg(F.count("*").alias("freq"))
    return _profiles(cells, placed.groupBy("form").agg(F.count("*").alias("in_all")), classes.groupBy("class_id").agg(F.count("*").alias("size")), least)


def packed_profiles(packed: Packed, leaves: dict[int, DataFrame], least: int = 1) -> DataFrame:
    """``profiles`` of the classes that ``classify_packed`` found: terms are counted in the blocks of each class."""
    forms = packed.forms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(forms + 1, dtype=np.int64)
        for ids, _, terms in _blocks(batches):
            total += np.append(np.bincount(terms, minlength=forms), len(ids))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": some.astype(np.int32), "n": total[some]})

    counts = None
    for c, blocks in leaves.items():
        part = blocks.mapInArrow(run, "term int, n bigint").withColumn("class_id", F.lit(c))
        counts = part if counts is None else counts.unionByName(part)
    counts = written(counts.groupBy("class_id", "term").agg(F.sum("n").alias("freq")), "counts")  # the number of units stands behind the last term
    cells = counts.join(packed.vocabulary, "term").select("class_id", "form", "freq")
    sizes = counts.where(F.col("term") == forms).select("class_id", F.col("freq").alias("size"))
    return _profiles(cells, cells.groupBy("form").agg(F.sum("freq").alias("in_all")), sizes, least)


def _profiles(cells: DataFrame, terms: DataFrame, sizes: DataFrame, least: int) -> DataFrame:
    n = sizes.agg(F.sum("size")).scalar()
    full = cells.join(terms.where(F.col("in_all") >= least), "form").join(sizes, "class_id")
    chi2 = signed_chi2(F.col("freq"), F.col("in_all"), F.col("size"), n)
    return full.select("class_id", "form", "freq", "in_all", (F.col("freq") * 100.0 / F.col("in_all")).alias("pct"), chi2.alias("chi2")).withColumn("sign", F.when(F.col("chi2") >= 0, "+").otherwise("-"))


def top_profiles(profile: DataFrame, most: int = 80, anti: bool = False) -> DataFrame:
    """The strongest terms of each class (or, ``anti``, those it most avoids)."""
    order = F.asc("chi2") if anti else F.desc("chi2")
    kept = profile.where(F.col("sign") == ("-" if anti else "+"))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("class_id").orderBy(order, "form"))).where(F.col("place") <= most)


def typical_segments(presence: DataFrame, classes: DataFrame, profile: DataFrame, most: int = 10) -> DataFrame:
    """``class_id, uce_id, score``: units of each class with the greatest sum of their distinct terms' chi-squares there."""
    scored = presence.join(classes, "uce_id").join(profile.select("class_id", "form", "chi2"), ["class_id", "form"]).groupBy("class_id", "uce_id").agg(F.sum("chi2").alias("score"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("class_id").orderBy(F.desc("score"), "uce_id"))).where(F.col("place") <= most)
