"""Keys and column names: normalising, finding, prefixing."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain, count, filterfalse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain_text(column: Column, kind: T.DataType) -> Column:
    """A key as text: whole numbers without point or exponent, Booleans as null."""
    if isinstance(kind, T.BooleanType):
        return F.lit(None).cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = column.try_cast("decimal(38,0)")
        return F.when(column == whole.cast("double"), whole.cast("string")).otherwise(column.cast("string"))
    return column.cast("string")


#: digits: only digits, no leading zeros, nothing left is null. digits_keep_zero: the same, but zeros alone are "0" and nothing is "".
#: zeros_only: other characters stay, no leading zeros, zeros alone are "0". zeros_only_null: the same, nothing left is null.
MODES = ("digits", "digits_keep_zero", "zeros_only", "zeros_only_null")


def normalize_key(column: Column, mode: str = "digits") -> Column:
    """A text key in one of ``MODES``; null stays null in the null-giving modes and is "" in the others."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    text = F.trim(column)
    if mode == "zeros_only_null":
        return F.nullif(F.ltrim(text, F.lit("0")), F.lit(""))
    if mode == "zeros_only":
        text = F.coalesce(text, F.lit(""))
        rest = F.ltrim(text, F.lit("0"))
        return F.when((text != "") & (rest == ""), F.lit("0")).otherwise(rest)
    digits = F.regexp_replace(text, "[^0-9]", "")
    rest = F.nullif(F.ltrim(digits, F.lit("0")), F.lit(""))
    if mode == "digits":
        return rest
    return F.coalesce(rest, F.when(digits != "", F.lit("0")), F.lit(""))


def key_of(df: DataFrame, column: str, mode: str = "digits") -> Column:
    """``normalize_key`` of a column of any type."""
    return normalize_key(plain_text(df[column], df.schema[find_column(df, column)].dataType), mode)


def find_column(df: DataFrame, name: str) -> str | None:
    """The column called ``name``, whatever its case and outer blanks."""
    return next((c for c in df.columns if c.strip().upper() == name.strip().upper()), None)


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if missing := [n for n in names if find_column(df, n) is None]:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are: {', '.join(df.columns)}")
    return df


def upper_names(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip().upper() for c in df.columns))


def prefix_all(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """Every column but the keys with ``prefix`` before its name."""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in keys})


def collision_names(left: Sequence[str], right: Sequence[str], keys: Sequence[str], prefix: str) -> dict[str, str]:
    """New names for the right side's columns: only those that the left side has get ``prefix``, and a number if that is taken too."""
    names: dict[str, str] = {}
    for c in (c for c in right if c not in keys):
        offered = chain((c, prefix + c), (f"{prefix}{c}_{n}" for n in count(2)))
        free = filterfalse({*left, *names.values()}.__contains__, offered)
        names[c] = next(free)
    return names


def distinct_keys(df: DataFrame, column: str, mode: str = "digits", name: str = "key") -> DataFrame:
    """The normalised keys of a column, each once, without null and empty ones."""
    return df.select(key_of(df, column, mode).alias(name)).filter(F.col(name) != "").distinct()


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """One row per key, the first by ``order``, ascending (by default all other columns, nulls last); rows with a null key go."""
    rest = [c for c in df.columns if c not in keys]
    parts = order or [x for c in rest for x in (F.col(c).isNull(), F.col(c))]
    rows = df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*(p.alias(f"o{i}") for i, p in enumerate(parts)))).alias("row"))
    return first.select(*keys, "row.*").select(*df.columns)


def is_truthy(column: Column) -> Column:
    """Text that says yes: 1, S, SIM, Y, YES, TRUE, T in any case."""
    return F.coalesce(F.upper(F.trim(column.cast("string"))).isin("1", "S", "SIM", "Y", "YES", "TRUE", "T"), F.lit(False))


def joined_text(*columns: Column) -> Column:
    """Texts one after another, null as nothing; null if nothing is left."""
    return F.nullif(F.concat_ws("", *columns), F.lit(""))


def decoded(column: Column) -> Column:
    """Bytes as text: UTF-8 where valid, else Latin-1."""
    return F.when(F.is_valid_utf8(column.cast("string")), F.decode(column, "UTF-8")).otherwise(F.decode(column, "ISO-8859-1"))


def size_text(column: Column) -> Column:
    """Bytes for people: B, KB, MB."""
    kb, mb = F.lit(1024), F.lit(1024 * 1024)
    return (
        F.when(column < kb, F.format_string("%d B", column.cast("long")))
        .when(column < mb, F.format_string("%.1f KB", column / kb))
        .otherwise(F.format_string("%.1f MB", column / mb))
    )
