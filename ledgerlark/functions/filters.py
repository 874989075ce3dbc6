"""Predicates built from nested dictionaries."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def _any_of(schema: StructType | None, name: str, values: list) -> Column:
    if schema is not None and isinstance(schema[name].dataType, ArrayType):
        return F.arrays_overlap(F.col(name), F.array(*map(F.lit, values)))
    return F.col(name).isin(values)


def _operator(schema: StructType | None, name: str, op: str, value: Any) -> Column | None:
    c = F.col(name)
    if op == "$in":
        return _any_of(schema, name, value if isinstance(value, list) else [value])
    if op == "$contains":
        return _any_of(schema, name, [value])
    plain = {"$eq": c.__eq__, "$ne": c.__ne__, "$gt": c.__gt__, "$gte": c.__ge__, "$lt": c.__lt__, "$lte": c.__le__}
    return plain[op](F.lit(value)) if op in plain else None


def build_filter(filters: dict[str, Any], schema: StructType | None = None, strict: bool = True) -> Column:
    """One predicate from ``filters``: ``$and`` and ``$or`` hold lists of such dictionaries, a dictionary holds operators,
    anything else means equality. All conditions must hold; none at all hold always.

    ``strict``: an unknown operator is an error. Otherwise it is skipped, and a list means any of its values. Array columns
    (seen in ``schema``) meet ``$in`` and ``$contains`` if they share an element. As the predicate is a plain
    expression over columns, Spark pushes it into scans.
    """
    out: list[Column] = []
    for name, value in filters.items():
        if name in ("$and", "$or"):
            parts = [build_filter(f, schema, strict) for f in value]
            out.append(reduce(lambda a, b: a & b, parts) if name == "$and" else reduce(lambda a, b: a | b, parts))
        elif isinstance(value, dict):
            for op, operand in value.items():
                made = _operator(schema, name, op, operand)
                if made is None and strict:
                    raise ValueError(f"unknown filter operator: {op}")
                if made is not None:
                    out.append(made)
        elif isinstance(value, list) and not strict:
            out.append(_any_of(schema, name, value))
        else:
            out.append(F.col(name) == F.lit(value))
    return reduce(lambda a, b: a & b, out, F.lit(True)) if len(out) != 1 else out[0]
