"""How many of many ascending cuts a row is not before, in logarithmically many steps.

The cuts travel as one constant array of structs, and a row finds its place among them by
halving: one projection with one comparison for each step, so an expression has the
logarithm of the number of cuts as its size.  Arrays are filled up to one less than a
power of two with their last cut, so the code that is generated for a search is the same
for all cuts of a kind.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from rankweave.spec import Key

_PLACE = "__cut_place"


def _plain(value: object) -> object:
    """A value that JSON has."""
    if isinstance(value, float) and (value != value or abs(value) == float("inf")):
        return {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}[repr(value)]
    return value


def _as_json(kind: T.DataType) -> tuple[str, Callable[[str], str], Callable[[object], object]]:
    """For a key's type: a type that JSON constants can have and that sorts alike, the SQL
    that turns the key into it, and what turns a value into a JSON value."""
    same = lambda x: x
    if isinstance(kind, (T.DoubleType, T.FloatType, T.BooleanType, T.IntegralType, T.StringType)):
        return kind.simpleString(), same, _plain
    if isinstance(kind, T.TimestampType):
        return "bigint", lambda x: f"unix_micros({x})", lambda v: kind.toInternal(v) if isinstance(v, datetime.datetime) else v
    if isinstance(kind, T.DateType):
        return "int", lambda x: f"unix_date({x})", kind.toInternal
    if isinstance(kind, T.TimestampNTZType):
        return "string", lambda x: f"date_format({x}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')", lambda v: v.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(kind, T.DecimalType):
        return kind.simpleString(), same, str
    if isinstance(kind, T.BinaryType):
        return "string", lambda x: f"hex({x})", lambda v: bytes(v).hex().upper()
    if isinstance(kind, T.StructType):
        inner = [_as_json(f.dataType) for f in kind]
        if all(sql("x") == "x" for _, sql, _ in inner):
            held = ", ".join(f"`{f.name}`: {t}" for f, (t, _, _) in zip(kind, inner, strict=True))
            turn = lambda v: {f.name: None if x is None else to(x) for f, x, (_, _, to) in zip(kind, v, inner, strict=True)}
            return f"struct<{held}>", same, turn
    raise TypeError(f"no constants of type {kind.simpleString()} as cuts")


def _groups(keys: Sequence[Key]) -> list[tuple[bool, list[tuple[int, str]]]]:
    """Keys as groups of one direction, in which nulls come first (rising) or last (falling), as
    they do within structs: (rising, [(number of the key, "value" or "null")])."""
    parts = []
    for i, key in enumerate(keys):
        if key.nulls_lead != key.ascending:  # whether it is null goes before, the other way round
            parts.append((key.ascending, i, "null"))
        parts.append((key.ascending, i, "value"))
    return [(rising, [(i, what) for _, i, what in some]) for rising, some in groupby(parts, key=lambda p: p[0])]


def with_place(df: DataFrame, keys: Sequence[Key], cuts: Sequence[Sequence[object]], name: str, same: str | None = None) -> DataFrame:
    """Adds `name`: how many of the ascending `cuts` (a value for each key) a row is not
    before; and as `same`, if asked for, whether it equals the last of these.

    A filter on the result is not pushed below it: that would multiply the steps out.
    """
    own = [F.col(f"`{c}`") for c in df.columns]
    if not cuts:
        return df.withColumn(name, F.lit(0)) if same is None else df.withColumns({name: F.lit(0), same: F.lit(False)})
    steps = len(cuts).bit_length()
    padded = [*cuts, *[cuts[-1]] * ((1 << steps) - 1 - len(cuts))]
    kinds = [f.dataType for f in df.select(*[F.expr(k.expr).alias(f"k{i}") for i, k in enumerate(keys)]).schema]
    turned = [_as_json(kind) for kind in kinds]
    groups, columns = _groups(keys), {}
    for g, (_, some) in enumerate(groups):
        fields, values, held = [], [], []
        for i, what in some:
            kind, sql, to = turned[i]
            x = keys[i].expr
            fields.append(f"'f{len(fields)}', " + (f"({x}) is null" if what == "null" else sql(f"({x})")))
            held.append(f"f{len(held)}: " + ("boolean" if what == "null" else kind))
            values.append([(cut[i] is None) if what == "null" else None if cut[i] is None else to(cut[i]) for cut in padded])
        text = json.dumps([{f"f{j}": v for j, v in enumerate(row)} for row in zip(*values, strict=True)])
        # always the array; not foldable, so that each step refers to it instead of holding a copy
        columns[f"__cut_values{g}"] = F.when(F.rand(0) < 2, F.from_json(F.lit(text), f"array<struct<{', '.join(held)}>>", {"mode": "FAILFAST"}))
        columns[f"__cut_row{g}"] = F.expr(f"named_struct({', '.join(fields)})")
    out = df.select("*", *[c.alias(n) for n, c in columns.items()], F.lit(0).alias(_PLACE))
    for step in (1 << k for k in reversed(range(steps))):
        before = "false"
        for g, (rising, _) in reversed(list(enumerate(groups))):
            row, cut = f"__cut_row{g}", f"get(__cut_values{g}, {_PLACE} + {step} - 1)"
            less = f"{row} {'<' if rising else '>'} {cut}"
            before = less if before == "false" else f"({less} or ({row} <=> {cut} and {before}))"
        out = out.withColumn(_PLACE, F.expr(f"{_PLACE} + case when {before} then 0 else {step} end"))
    real = lookup([min(k, len(cuts)) for k in range(1 << steps)], _PLACE)
    held = [(real + F.rand(0).cast("int")).cast("int").alias(name)]  # adds nothing, but keeps filters above
    if same is not None:
        equal = " and ".join(f"__cut_row{g} <=> get(__cut_values{g}, {_PLACE} - 1)" for g in range(len(groups)))
        held.append(F.expr(f"{_PLACE} > 0 and {equal} and rand(0) < 2").alias(same))
    return out.select(*own, *held)


def lookup(values: Sequence[object], index: str, kind: str = "bigint") -> Column:
    """values[index] for a column of small numbers, from one constant array."""
    return F.get(F.from_json(F.lit(json.dumps(list(values))), f"array<{kind}>"), F.col(index))
