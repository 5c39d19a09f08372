"""Association indices of two items over n units: a with both, b with the first only, c with the second only, d with neither.

Divisions by zero, NaN and infinities give 0. Every index takes the five counts and returns a column; ``register`` adds more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.measures import binomial_below, ratio

Index = Callable[[Column, Column, Column, Column, Column], Column]
INDICES: dict[str, Index] = {}
ALIASES: dict[str, str] = {}
#: Indices that differ from 0 for pairs that never meet: they need all pairs of the vocabulary.
FULL: set[str] = set()


def register(name: str, *aliases: str, full: bool = False) -> Callable[[Index], Index]:
    """Adds an index under a name and its aliases."""

    def add(f: Index) -> Index:
        INDICES[name] = f
        ALIASES.update(dict.fromkeys((name, *aliases), name))
        if full:
            FULL.add(name)
        return f

    return add


def index(name: str) -> Index:
    """The index of a name or alias, with its result made finite."""
    f = INDICES[ALIASES[name]]

    def finite(a: Column, b: Column, c: Column, d: Column, n: Column) -> Column:
        value = f(*(x.cast("double") for x in (a, b, c, d, n)))
        bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
        return F.when(bad, 0.0).otherwise(value)

    return finite


def _margins(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a + b) * (c + d) * (a + c) * (b + d)


def _phi(a: Column, b: Column, c: Column, d: Column, n: Column) -> Column:
    return ratio(a * d - b * c, F.sqrt(_margins(a, b, c, d)))


register("cooccurrence", "cooc", "raw")(lambda a, b, c, d, n: a)
register("jaccard")(lambda a, b, c, d, n: ratio(a, a + b + c))
register("dice", "sorensen")(lambda a, b, c, d, n: ratio(2 * a, 2 * a + b + c))
register("ochiai")(lambda a, b, c, d, n: ratio(a, F.sqrt((a + b) * (a + c))))
register("phi", full=True)(_phi)
register("pearson", full=True)(_phi)
register("chi2", full=True)(lambda a, b, c, d, n: ratio(n * (a * d - b * c) * (a * d - b * c), _margins(a, b, c, d)))
register("russel")(lambda a, b, c, d, n: ratio(a, n))
register("kulczynski1")(lambda a, b, c, d, n: ratio(a, b + c))
register("kulczynski2")(lambda a, b, c, d, n: (ratio(a, a + b) + ratio(a, a + c)) / 2)
register("mountford")(lambda a, b, c, d, n: ratio(2 * a, a * b + a * c + 2 * b * c))


@register("fager", full=True)
def _fager(a: Column, b: Column, c: Column, d: Column, n: Column) -> Column:
    """Asymmetric by its second item; the mean of both directions."""
    both = ratio(a, F.sqrt((a + b) * (a + c)))
    return both - (ratio(F.lit(1.0), 2 * F.sqrt(a + c)) + ratio(F.lit(1.0), 2 * F.sqrt(a + b))) / 2


register("simple_matching", "simple matching", full=True)(lambda a, b, c, d, n: ratio(a + d, n))
register("hamman", full=True)(lambda a, b, c, d, n: ratio((a + d) - (b + c), n))
register("faith", full=True)(lambda a, b, c, d, n: ratio(a + d / 2, n))
register("tanimoto", full=True)(lambda a, b, c, d, n: ratio(a + d, a + 2 * b + 2 * c + d))
register("simpson")(lambda a, b, c, d, n: ratio(a, F.least(a + b, a + c)))
register("braun_blanquet")(lambda a, b, c, d, n: ratio(a, F.greatest(a + b, a + c)))
register("mozley")(lambda a, b, c, d, n: ratio(a * n, (a + b) * (a + c)))


@register("stiles", full=True)
def _stiles(a: Column, b: Column, c: Column, d: Column, n: Column) -> Column:
    excess = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    inside = ratio(n * excess * excess, _margins(a, b, c, d))
    return F.when(inside > 0, F.log10(inside)).otherwise(0.0)


register("michael", full=True)(lambda a, b, c, d, n: ratio(4 * (a * d - b * c), (a + d) * (a + d) + (b + c) * (b + c)))
register("yule", full=True)(lambda a, b, c, d, n: ratio(a * d - b * c, a * d + b * c))
register("yule2", full=True)(lambda a, b, c, d, n: ratio(F.sqrt(a * d) - F.sqrt(b * c), F.sqrt(a * d) + F.sqrt(b * c)))
register("phi_squared", full=True)(lambda *x: _phi(*x) * _phi(*x))
register("tschuprow", full=True)(lambda *x: F.abs(_phi(*x)))
register("cramer", full=True)(lambda *x: F.abs(_phi(*x)))
register("percentage", "percentual de coocorrência")(lambda a, b, c, d, n: ratio(a, n))
register("binomial", full=True)(lambda a, b, c, d, n: binomial_below(a - 1, n, ratio(a + b, n) * ratio(a + c, n)))
