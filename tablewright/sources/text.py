"""Typing of columns that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col

# Spellings of a missing cell in delimited text.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Spellings of a boolean cell.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]
BLANKS = " \t\r\n\f\x0b"


def blank_to_null(column: Column) -> Column:
    return F.when(column.isin(NULL_TOKENS), F.lit(None)).otherwise(column)


def _number_text(column: Column) -> Column:
    """Numbers may carry blanks around them; strings keep theirs."""
    return F.btrim(column, F.lit(BLANKS))


def infer_types(df: DataFrame) -> dict[str, str]:
    """Type of each text column, from one aggregation over all rows.

    A column is a bigint, double or boolean only if every present cell is one;
    an all-null column is double, and dates stay text.
    """
    stats = []
    decimal_number = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    special = r"(?i)^[+-]?(inf|infinity)$"
    for i, name in enumerate(df.columns):
        c = col(name)
        number = _number_text(c)
        whole = number.rlike(r"^[+-]?[0-9]+$") & number.try_cast("bigint").isNotNull()
        real = number.rlike(decimal_number) | number.rlike(special)
        stats += [
            F.count(c).alias(f"n{i}"),
            F.count_if(whole).alias(f"w{i}"),
            F.count_if(real).alias(f"r{i}"),
            F.count_if(c.isin(TRUE_TOKENS + FALSE_TOKENS)).alias(f"b{i}"),
        ]
    row = df.agg(*stats).first()
    types = {}
    for i, name in enumerate(df.columns):
        n = row[f"n{i}"]
        if n == 0 or n == row[f"r{i}"]:
            types[name] = "bigint" if n and n == row[f"w{i}"] else "double"
        else:
            types[name] = "boolean" if n == row[f"b{i}"] else "string"
    return types


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    out = []
    for name in df.columns:
        c, kind = col(name), types[name]
        if kind == "boolean":
            c = F.when(c.isin(TRUE_TOKENS), F.lit(True)).when(c.isin(FALSE_TOKENS), F.lit(False))
        elif kind == "bigint":
            c = _number_text(c).cast("bigint")
        elif kind == "double":
            # A literal infinity has several spellings; the cast knows "Infinity".
            text = F.regexp_replace(_number_text(c), r"(?i)^([+-]?)inf(inity)?$", "$1Infinity")
            c = F.regexp_replace(text, r"^\+", "").cast("double")
        out.append(c.alias(name))
    return df.select(*out)


def distinct_names(header: list[str]) -> list[str]:
    """Header names made unique: ``a, a`` gives ``a, a.1``; a blank one gives ``Unnamed: <position>``."""
    taken: set[str] = set()
    names = []
    for i, raw in enumerate(header):
        base = raw if raw else f"Unnamed: {i}"
        name, k = base, 0
        while name in taken:
            k += 1
            name = f"{base}.{k}"
        taken.add(name)
        names.append(name)
    return names
