"""JSON that may be broken: parsed by schema with a default, counted, and found in prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, column: str, schema: str, into: str = "value") -> DataFrame:
    """``into``: the struct of ``schema`` that the text holds, and ``bad``: whether the text is there but is no such JSON. Nothing is lost: the text itself stays.

    Text that is no JSON, or whose fields have other types, is bad and gives null; null text gives null and is not bad.
    """
    x = F.from_json(column, f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    df = df.withColumn(into, x)
    bad = F.col(column).isNotNull() & (F.col(f"{into}._broken").isNotNull() | F.col(into).isNull())
    return df.withColumn("bad", F.coalesce(bad, F.lit(False))).withColumn(into, F.when(~F.col("bad") & F.col(column).isNotNull(), F.col(into).dropFields("_broken")))


def json_or(text: Column, default: Column) -> Column:
    """``text`` as a variant, or ``default``, a variant, where it is null or no JSON."""
    return F.coalesce(F.try_parse_json(text), default)


def json_in_text(text: Column) -> Column:
    """The first JSON object in prose, as a string: of the blocks fenced as json, then of other fenced blocks, then of the innermost braces; ``{}`` if there is none."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in (("(?s)```json\\s*\\n(.*?)\\n\\s*```", 1), ("(?s)```\\s*\\n(.*?)\\n\\s*```", 1), ("\\{[^{}]*\\}", 0))))
    objects = F.filter(found, lambda s: F.schema_of_variant(F.try_parse_json(s)).startswith("OBJECT"))
    return F.coalesce(F.try_element_at(objects, F.lit(1)), F.lit("{}"))
