"""Strict JSON on top of Spark's lenient parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxlake.functions.text import strip


def _probe(c: Column) -> Column:
    """Parse `[<text>,"<md5 of text>"]`.

    Spark's parser stops after the first value and ignores what follows. With
    the digest behind the text, anything but exactly one JSON value breaks the
    array, changes its length or loses the digest.
    """
    return F.try_parse_json(F.concat(F.lit("["), c, F.lit(',"'), F.md5(c), F.lit('"]')))


def _unwrap(probe: str, text: str) -> Column:
    return F.when(
        (F.try_variant_get(probe, "$[1]", "string") == F.md5(F.col(text)))
        & F.try_variant_get(probe, "$[2]", "variant").isNull(),
        F.try_variant_get(probe, "$[0]", "variant"),
    )


def without_fences(c: Column) -> Column:
    """Strip, then drop one opening and one closing Markdown fence."""
    text = strip(c)
    text = F.regexp_replace(text, r"\A```(json)?", "")
    text = F.regexp_replace(text, r"```\z", "")
    return strip(text)


def _outermost_braces(text: Column) -> Column:
    """From the first `{` to the last `}`, found in linear time; null without such a pair."""
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((start > 0) & (end > start), F.substring(text, start, end - start + 1))


def with_strict_json(df: DataFrame, raw: str, out: str) -> DataFrame:
    """Add `out`: the JSON value held by the model answer `raw`, or null.

    The whole text is tried first; only if that is no JSON, the span from the
    first `{` to the last `}`. Each text is parsed at most twice.
    """
    return (
        df.withColumn("_text", without_fences(F.col(raw)))
        .withColumn("_probe", _probe(F.col("_text")))
        .withColumn("_whole", _unwrap("_probe", "_text"))
        .withColumn("_span", F.when(F.col("_whole").isNull(), _outermost_braces(F.col("_text"))))
        .withColumn("_probe", _probe(F.col("_span")))
        .withColumn(out, F.coalesce("_whole", _unwrap("_probe", "_span")))
        .drop("_text", "_probe", "_whole", "_span")
    )


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def is_string(v: Column) -> Column:
    """True only for a JSON string: numbers are not turned into text."""
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def is_string_or_absent(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).isin("STRING", "VOID"), F.lit(True))


def as_string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def as_list(v: Column, name: str) -> Column:
    """The JSON list under `name` as array<variant>; null when it is no list."""
    return F.try_variant_get(v, f"$.{name}", "array<variant>")
