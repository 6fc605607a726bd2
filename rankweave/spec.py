"""What an order is: key expressions with directions, and columns that break ties."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cmp_to_key

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Key:
    """One key: a column name or SQL expression, its direction, and where nulls go."""

    expr: str
    ascending: bool = True
    nulls_first: bool | None = None  # by default first when ascending, last when descending

    @property
    def nulls_lead(self) -> bool:
        return self.ascending if self.nulls_first is None else self.nulls_first

    def ordering(self) -> Column:
        c = F.expr(self.expr)
        if self.ascending:
            return c.asc_nulls_first() if self.nulls_lead else c.asc_nulls_last()
        return c.desc_nulls_first() if self.nulls_lead else c.desc_nulls_last()

    def before(self, value: object) -> Column:
        """Whether the row's key comes before the constant `value` (None: null)."""
        c = F.expr(self.expr)
        if value is None:
            return F.lit(False) if self.nulls_lead else c.isNotNull()
        less = c < F.lit(value) if self.ascending else c > F.lit(value)
        return F.coalesce(less, F.lit(self.nulls_lead))

    def same(self, value: object) -> Column:
        return F.expr(self.expr).eqNullSafe(F.lit(value))


@dataclass(frozen=True)
class SortSpec:
    """Keys, and tie breakers that make the order total.

    Ranks and placements are functions of the rows only under a total order; a
    spec without ties is fine where the order among equal keys does not show.
    """

    keys: tuple[Key, ...]
    ties: tuple[Key, ...] = ()

    @staticmethod
    def by(*keys: str, ties: Sequence[str] = ()) -> SortSpec:
        """Keys as text: ``"price"``, ``"price desc"``."""
        return SortSpec(tuple(map(_parse, keys)), tuple(map(_parse, ties)))

    @property
    def total(self) -> tuple[Key, ...]:
        return self.keys + self.ties

    def orderings(self) -> list[Column]:
        return [k.ordering() for k in self.total]

    def key_orderings(self) -> list[Column]:
        return [k.ordering() for k in self.keys]

    def values(self) -> list[Column]:
        """The keys and ties as columns _k0, _k1, ..."""
        return [F.expr(k.expr).alias(f"_k{i}") for i, k in enumerate(self.total)]

    def before(self, values: Sequence[object], or_same: bool = False, keys_only: bool = False) -> Column:
        """Whether a row comes before the constants `values` in this order."""
        out = F.lit(or_same)
        for key, value in reversed(list(zip(self.keys if keys_only else self.total, values, strict=True))):
            out = key.before(value) | (key.same(value) & out)
        return out

    def flat(self) -> SortSpec:
        """The same order over the columns that ``values`` gives."""
        names = iter(range(len(self.total)))
        turn = lambda ks: tuple(Key(f"_k{next(names)}", k.ascending, k.nulls_first) for k in ks)
        return SortSpec(turn(self.keys), turn(self.ties))

    def sort_key(self) -> Callable[[Sequence[object]], object]:
        """Key function that puts tuples of values on the driver in this order."""

        def compare(a: Sequence[object], b: Sequence[object]) -> int:
            for key, x, y in zip(self.total, a, b, strict=False):
                if x is None or y is None:
                    side = 0 if x is y else -1 if (x is None) == key.nulls_lead else 1
                else:
                    side = _compare(x, y) * (1 if key.ascending else -1)
                if side:
                    return side
            return 0

        return cmp_to_key(compare)


def _compare(x: object, y: object) -> int:
    """Order of two values of one type: NaN is the greatest, null the least within structs."""
    if x is None or y is None:
        return (x is not None) - (y is not None)
    if isinstance(x, (tuple, list)):
        return next((c for c in map(_compare, x, y) if c), len(x) - len(y))
    if x != x or y != y:
        return (x != x) - (y != y)
    return (x > y) - (x < y)


def _parse(text: str) -> Key:
    words = text.rsplit(None, 1)
    if len(words) == 2 and words[1].lower() in ("asc", "desc"):
        return Key(words[0], words[1].lower() == "asc")
    return Key(text)
