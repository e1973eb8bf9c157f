"""String and identifier expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_prefix(name: Column) -> Column:
    """Sample key of a file name: the text before the first dot, then before the first underscore."""
    return F.split_part(F.split_part(name, F.lit("."), F.lit(1)), F.lit("_"), F.lit(1))


def base_name(path: Column) -> Column:
    """Last component of a path."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    """Last path component without its final suffix."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def python_strip(text: Column) -> Column:
    """Remove leading and trailing white space of every kind, tabs included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def regex_found(text: Column, pattern: str) -> Column:
    """Case-insensitive regex search."""
    return text.rlike("(?i)" + pattern)


def regex_full(text: Column, pattern: str) -> Column:
    """The whole text matches the pattern."""
    return text.rlike(f"^(?:{pattern})$")


def in_delimited_list(text: Column, item: str, sep: str = ",") -> Column:
    """``item`` is an exact member of the delimited list in ``text``."""
    return F.array_contains(F.split(text, re.escape(sep)), item)


def na_if_blank(text: Column) -> Column:
    """Missing or empty text becomes ``NA``."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("NA"))


def number_or_null(text: Column, dtype: str = "double") -> Column:
    """Empty or malformed text becomes NULL, anything else its number."""
    return F.nullif(F.trim(text), F.lit("")).try_cast(dtype)


def first_number(name: Column) -> Column:
    """First run of digits in a file name, NULL when there is none."""
    return F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit("")).try_cast("int")


def variant_id(contig: Column, pos: Column, alleles: Column) -> Column:
    """``contig:pos_['A', 'T']``, the row label of a genotype matrix."""
    quoted = F.concat(F.lit("['"), F.concat_ws("', '", alleles), F.lit("']"))
    return F.concat(contig, F.lit(":"), pos.cast("string"), F.lit("_"), quoted)
