"""Restricted query: project some paths, filter by an AND of equalities, over one table.

A path is ``a.b``, ``list[].field`` or ``list[0].field``. The text becomes Columns once, from the schema; Catalyst prunes and
pushes down. There is no expression language beyond that.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STEP = re.compile(r"\[(\d*)\]")
_NAME = r"[^.\[\],=!]+(?:\[\d*\])?"
_PATH = re.compile(rf"{_NAME}(?:\.{_NAME})*")
_TRUE = ("1", "true", "yes", "y", "on")
_NULL = ("", "null", "none")


class QueryError(ValueError):
    """A path, filter or scope that the restricted query does not accept."""


def parse_path(path: str) -> list[str | int | None]:
    """``a.b[].c[0]`` -> ``['a', 'b', None, 'c', 0]``: a name, ``None`` for every element, a number for one element."""
    path = path.strip()
    if not _PATH.fullmatch(path):
        raise QueryError(f"bad path {path!r}: use a.b, list[].field or list[0].field")
    steps: list[str | int | None] = []
    for piece in path.split("."):
        name, bracket, rest = piece.partition("[")
        steps.append(name.strip())
        if bracket:
            steps.append(int(rest[:-1]) if rest[:-1] else None)
    return steps


def path_name(steps: list[str | int | None]) -> str:
    """The column name of a path."""
    shown = ".".join(s if isinstance(s, str) else "[]" if s is None else f"[{s}]" for s in steps)
    return shown.replace(".[", "[")


def strip_scope(steps: list[str | int | None], scope: str) -> list[str | int | None]:
    """``plugins[].name`` inside scope ``plugins`` is ``name``."""
    if steps and steps[0] == scope:
        steps = steps[1:]
        if steps and steps[0] is None:
            steps = steps[1:]
    return steps


def infer_scope(select: list[str] | None, scopes: list[str], default: str) -> str:
    """The table that the first selected path names, else the default."""
    if select:
        first = parse_path(select[0])[0]
        if first in scopes:
            return str(first)
    return default


def _walk(value: Column, dtype: T.DataType, steps: list) -> tuple[Column, T.DataType]:
    if not steps:
        return value, dtype
    step, rest = steps[0], steps[1:]
    if isinstance(step, str):
        if isinstance(dtype, T.StructType) and step in dtype.names:
            return _walk(value.getField(step), dtype[step].dataType, rest)
        if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
            return _walk(F.try_element_at(value, F.lit(step)), dtype.valueType, rest)
    elif isinstance(dtype, T.ArrayType):
        if step is not None:
            return _walk(F.get(value, F.lit(step)), dtype.elementType, rest)
        if not rest:
            return value, dtype
        inner = _walk(F.lit(None), dtype.elementType, rest)[1]
        return F.transform(value, lambda x: _walk(x, dtype.elementType, rest)[0]), T.ArrayType(inner)
    return F.lit(None), T.NullType()


def path_column(df: DataFrame, steps: list) -> tuple[Column, T.DataType]:
    """B2: the Column of a path and its type; a path that does not fit the schema is null."""
    if not steps:
        raise QueryError("the path names the table only; add a field")
    head = steps[0]
    if head not in df.columns:
        return F.lit(None), T.NullType()
    return _walk(F.col(f"`{head}`"), df.schema[head].dataType, steps[1:])


def _as_text(value: Column, dtype: T.DataType) -> Column:
    text = F.initcap(value.cast("string")) if isinstance(dtype, T.BooleanType) else value.cast("string")
    return F.coalesce(text, F.lit("None"))


def equals(value: Column, dtype: T.DataType, literal: str) -> Column:
    """Loose equality chosen by the column type; always true or false, never null."""
    text = literal.strip()
    is_null = F.lit(text.lower() in _NULL)
    if isinstance(dtype, T.NullType):
        return is_null
    if isinstance(dtype, T.BooleanType):
        hit = value == F.lit(text.lower() in _TRUE)
    elif isinstance(dtype, T.NumericType):
        try:
            hit = value.cast("double") == F.lit(float(text))
        except ValueError:
            hit = F.lit(False)
    elif isinstance(dtype, T.MapType):
        hit = F.map_contains_key(value, F.lit(text))
    elif isinstance(dtype, T.StructType):
        hit = F.lit(text in dtype.names)
    elif isinstance(dtype, T.ArrayType):
        inner = dtype.elementType
        if isinstance(inner, T.StructType):
            hit = F.exists(value, lambda x: x.isNotNull()) if text in inner.names else F.lit(False)
        elif isinstance(inner, T.MapType):
            hit = F.exists(value, lambda x: F.coalesce(F.map_contains_key(x, F.lit(text)), F.lit(False)))
        elif isinstance(inner, T.NullType):
            hit = (F.size(value) > 0) & F.lit(text == "None")
        else:
            hit = F.exists(value, lambda x: _as_text(x, inner) == F.lit(text))
    else:
        hit = value.cast("string") == F.lit(text)
    return F.when(value.isNull(), is_null).otherwise(F.coalesce(hit, F.lit(False)))


def parse_where(expr: str | None) -> list[tuple[list, str, bool]]:
    """``k=v,k!=v`` -> conditions that all must hold."""
    conditions = []
    for part in filter(None, (p.strip() for p in (expr or "").split(","))):
        key, sep, value = part.partition("=")
        if not sep:
            raise QueryError(f"condition {part!r} needs key=value or key!=value")
        negate = key.endswith("!")
        if "!=" in part:
            key, _, value = part.partition("!=")
            negate = True
        if not key.strip():
            raise QueryError(f"condition {part!r} has no field")
        conditions.append((parse_path(key), value.strip(), negate))
    return conditions


def run_query(tables: dict[str, DataFrame], select: list[str] | None = None, where: str | None = None, scope: str | None = None,
              default_scope: str = "plugins") -> DataFrame:
    """B1: rows of one table that meet all conditions, projected to the selected paths (all columns when none given)."""
    scope = scope or infer_scope(select, list(tables), default_scope)
    if scope not in tables:
        raise QueryError(f"unknown table {scope!r}: one of {', '.join(sorted(tables))}")
    df = tables[scope]
    tests = []
    for steps, literal, negate in parse_where(where):
        hit = equals(*path_column(df, strip_scope(steps, scope)), literal)
        tests.append(~hit if negate else hit)
    kept = df.where(reduce(lambda a, b: a & b, tests)) if tests else df
    if not select:
        return kept
    chosen: dict[str, Column] = {}
    for path in select:
        steps = strip_scope(parse_path(path), scope)
        column, dtype = path_column(df, steps)
        chosen[path_name(steps)] = column.cast("string") if isinstance(dtype, T.NullType) else column
    return kept.select(*[c.alias(name) for name, c in chosen.items()])
