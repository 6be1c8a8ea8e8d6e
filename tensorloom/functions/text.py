"""Strings, arrays and maps, as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the digits of base 62.
DIGITS = string.digits + string.ascii_uppercase + string.ascii_lowercase


def without_white_space(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t\n\x0B\f\r]", "")


def padded(text: Column, until: int) -> Column:
    """Cut to `until` characters, or filled with blanks to one more."""
    return F.when(F.char_length(text) >= until, F.substring(text, 1, until)).otherwise(F.rpad(text, until + 1, " "))


def numbered_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, text): the lines, from 1."""
    lines = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n", -1)).alias("line", "text"))
    return lines.withColumn("line", F.col("line") + 1)


def indented(text: Column, mark: str) -> Column:
    """`mark` after every line feed."""
    return F.replace(text, F.lit("\n"), F.lit("\n" + mark))


def rendered(template: str, values: dict[str, Column]) -> Column:
    """{{name}} replaced by the value of that name."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value.cast("string"))
    return out


def base62(number: Column) -> Column:
    """A whole number from 0 in base 62, without leading zeros; eleven places hold any long."""
    digits = [F.substr(F.lit(DIGITS), (F.floor(number / F.lit(62**k)) % 62 + 1).cast("int"), F.lit(1)) for k in range(10, -1, -1)]
    short = F.ltrim(F.concat(*digits), F.lit("0"))
    return F.when(short == "", F.lit("0")).otherwise(short)


def md5_slice(text: Column, length: int) -> Column:
    """`length` digits of the md5 from the second on."""
    return F.substring(F.md5(text), 2, length)


def repeated(text: Column, mark: str, n: int) -> Column:
    return F.concat(text, F.repeat(F.lit(mark), n))


def broadcast_shape(a: Column, b: Column) -> Column:
    """The common shape of two arrays of sizes, aligned at their ends; null if they do not fit."""
    n = F.greatest(F.size(a), F.size(b))
    both = F.zip_with(F.concat(F.array_repeat(F.lit(1), n - F.size(a)), a), F.concat(F.array_repeat(F.lit(1), n - F.size(b)), b), lambda x, y: F.when(x == 1, y).when(y == 1, x).when(x == y, x))
    return F.when(~F.exists(both, lambda x: x.isNull()), both)
