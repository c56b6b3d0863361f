"""Text helpers as Column expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from voxlake.schemas import WHITESPACE

# Java's Unicode whitespace plus the four separators Python also strips.
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def strip(c: Column) -> Column:
    """Remove Unicode whitespace at both ends; touches only the ends of the string."""
    return F.btrim(c, F.lit(WHITESPACE))


def word_count(c: Column) -> Column:
    stripped = strip(c)
    return F.when(stripped == "", F.lit(0)).otherwise(F.size(F.split(stripped, WHITESPACE_RUN)))


def fill(template: str, *values: Column) -> Column:
    """A fixed text with values in place of its `{}` marks."""
    pieces = template.split("{}")
    parts = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:], strict=True):
        parts += [value.cast("string"), F.lit(piece)]
    return F.concat(*parts)


def percent(n: Column, total: Column) -> Column:
    """`n / total * 100` in that order; null when there is nothing to divide by."""
    return n.cast("double") / F.nullif(total, F.lit(0)).cast("double") * 100


def one_decimal(p: Column | str) -> Column:
    """A percentage with one decimal; ties of the exact binary value go to the even digit.

    That is how C and Python print it. `format_string` rounds the shortest
    decimal form half up instead: 12.25 would become 12.3.
    """
    return F.format_number(p, 1)


def pad_left(c: Column, width: int) -> Column:
    return F.lpad(c, F.greatest(F.length(c), F.lit(width)), F.lit(" "))


def pad_right(c: Column, width: int) -> Column:
    return F.rpad(c, F.greatest(F.length(c), F.lit(width)), F.lit(" "))


def bar(p: Column, step: int, mark: str) -> Column:
    return F.repeat(F.lit(mark), F.floor(p / step).cast("int"))


def file_name(path: Column) -> Column:
    """A path as it is on disk: Spark reports it percent-encoded."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def source_label(path: Column, until: str = "_") -> Column:
    """Source label of a file, as `label_from_path` gives it for a string."""
    name = F.regexp_extract(F.regexp_replace(path, r"/+$", ""), r"([^/\\]*)$", 1)
    stem = name if until == "." else F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.substring_index(stem, until, 1)
