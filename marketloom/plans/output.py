"""Result columns of the queries: doubles rounded to six digits, without negative zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def result(df: DataFrame, keys: list[str], numbers: list[str] = ()) -> DataFrame:
    return df.select(*keys, *[(F.round(F.col(c).cast("double"), DIGITS) + F.lit(0.0)).alias(c) for c in numbers])


def sql_numbers(numbers: list[str]) -> str:
    return ", ".join(f"round(({c})::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS {c}" for c in numbers)


def sql_result(ctes: list[str], source: str, keys: list[str], numbers: list[str] = ()) -> str:
    columns = ", ".join([*keys, *([sql_numbers(numbers)] if numbers else [])])
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {columns} FROM {source}"
