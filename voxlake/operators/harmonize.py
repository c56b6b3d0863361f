"""Merging free-form themes into macro categories."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from voxlake.functions.numbers import int_div
from voxlake.functions.strict_json import as_list, as_string, is_string, with_strict_json
from voxlake.operators.inference import Answers, ask_in_rounds
from voxlake.operators.lookup import lookup
from voxlake.operators.positions import land_positions
from voxlake.schemas import FALLBACK_CATEGORY, MAX_CATEGORIES, MAX_RETRIES, RAW_EXCERPT
from voxlake.session import prepare, write_table

THEMES_PER_CALL = 2_000

# Own wording; the answer shape is read by `parse_mappings`.
HARMONIZATION_PROMPT = """Customer comments were tagged with free-form themes. Group them.
Use at most {max_categories} broad categories with short French names (one to three words).
Assign every listed theme, spelled exactly as listed, to one of your categories.
Answer with JSON only:
{{"categories": ["..."], "mapping": {{"theme": "category"}}}}

Themes:
"""


@dataclass(frozen=True)
class Harmonization:
    """`categories(pos, category)` in order and `mapping(theme, macro_theme)`."""

    categories: DataFrame
    mapping: DataFrame


def unique_themes(analyses: DataFrame, drop_empty: bool = True) -> DataFrame:
    """Distinct themes in code-point order."""
    themes = analyses.select("theme")
    if drop_empty:
        themes = themes.where(F.col("theme") != "")
    return themes.distinct().orderBy("theme")


def theme_chunks(themes: DataFrame, per_call: int = THEMES_PER_CALL) -> DataFrame:
    """Number the sorted themes and cut them into `chunk`s of bounded size."""
    placed = land_positions(themes.select("theme").orderBy("theme"))
    return placed.select(int_div("row_idx", per_call).alias("chunk"), "row_idx", "theme")


def harmonization_prompts(chunks: DataFrame, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """One prompt per chunk with its themes as a bullet list."""
    line = F.struct("row_idx", F.concat(F.lit("- "), "theme").alias("line"))
    return (
        chunks.groupBy("chunk")
        .agg(F.array_sort(F.collect_list(line)).alias("lines"))
        .select(
            "chunk",
            F.concat(
                F.lit(HARMONIZATION_PROMPT.format(max_categories=max_categories)),
                F.array_join(F.col("lines.line"), "\n"), F.lit("\n"),
            ).alias("prompt"),
        )
    )


def parse_mappings(responses: DataFrame) -> DataFrame:
    """Read (chunk, raw, error): adds `problem`, or `categories` and `pairs`.

    No answer, no JSON and an empty JSON value are problems, and so is any
    category or mapping value that is no string.
    """
    prepare(responses.sparkSession)
    parsed = (
        with_strict_json(responses, "raw", "_json")
        .withColumn("_categories", as_list(F.col("_json"), "categories"))
        .withColumn("_pairs", F.try_variant_get("_json", "$.mapping", "map<string,variant>"))
        .withColumn("_pairs", F.map_entries("_pairs"))
    )
    empty = F.to_json("_json").isin("null", "{}", "[]", "0", "false", '""')
    ok = F.forall("_categories", is_string) & F.forall("_pairs", lambda p: is_string(p["value"]))
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.coalesce("raw", F.lit("")) == "", F.lit("no answer for the harmonisation"))
        .when(
            F.col("_json").isNull() | empty,
            F.concat(F.lit("no harmonisation JSON in: "), F.left("raw", F.lit(RAW_EXCERPT))),
        )
        .when(~F.coalesce(ok, F.lit(False)), F.lit("harmonisation answer has the wrong shape"))
    )
    return parsed.select(
        "chunk",
        problem.alias("problem"), F.col("error").isNotNull().alias("unexpected"),
        F.transform("_categories", as_string).alias("categories"),
        F.transform("_pairs", lambda p: F.struct(
            p["key"].alias("theme"), as_string(p["value"]).alias("macro_theme"),
        )).alias("pairs"),
    )


def _ask(
    themes: DataFrame, answers: Answers, max_categories: int, per_call: int,
    max_retries: int, wait: Callable[[float], None], at: str | None,
) -> tuple[DataFrame, DataFrame]:
    """One call per chunk: the read answers and their (theme, macro_theme) pairs.

    Unusable answers are asked for again; raises when one stays unusable. A theme
    belongs to the call it was asked in; of names no call was asked about, the first
    call that gives one counts.
    """
    chunks = write_table(theme_chunks(themes, per_call), "chunks")
    parsed = write_table(
        ask_in_rounds(
            harmonization_prompts(chunks, max_categories), ["chunk"], answers, parse_mappings,
            "problem is not null and not unexpected", max_retries, wait, at,
        ), "mappings",
    )
    bad = parsed.where(F.col("problem").isNotNull()).select("problem").first()
    if bad is not None:
        raise ValueError(bad["problem"])
    pairs = parsed.select("chunk", F.explode("pairs").alias("p")).select("chunk", "p.*")
    owned = pairs.join(chunks.select("theme", F.col("chunk").alias("_own")), "theme", "left").where(
        F.col("_own").isNull() | (F.col("_own") == F.col("chunk"))
    )
    first = owned.groupBy("theme").agg(F.min("chunk").alias("chunk"))
    return parsed, owned.join(first, ["theme", "chunk"]).select("theme", "macro_theme")


def harmonize(
    themes: DataFrame,
    answers: Answers,
    max_categories: int = MAX_CATEGORIES,
    fallback: str = "first",
    themes_per_call: int = THEMES_PER_CALL,
    max_retries: int = MAX_RETRIES,
    wait: Callable[[float], None] = time.sleep,
    at: str | None = None,
) -> Harmonization:
    """Ask for a mapping, then give every unmapped theme a category.

    Up to `themes_per_call` themes are one call. More are cut into several calls,
    and the names they use, whether listed as categories or not, are merged by
    further calls of the same kind until one answer covers all; a name that a
    merge leaves out stays as it is. No task holds more than one call's themes. A bad
    answer is asked for again; if it stays bad, ValueError is raised. With `at`, a
    folder, answers outlive a crash.
    """
    spark = themes.sparkSession
    themes = write_table(themes.select("theme").distinct(), "themes")
    n = themes.count()
    if n == 0:
        return Harmonization(
            spark.createDataFrame([], "pos int, category string"),
            spark.createDataFrame([], "theme string, macro_theme string"),
        )
    asked = (answers, max_categories, themes_per_call, max_retries, wait, at)
    parsed, mapping = _ask(themes, *asked)
    mapping = write_table(mapping, "first-mapping")
    while n > themes_per_call:
        names = write_table(
            parsed.select(F.explode("categories").alias("theme"))
            .unionByName(mapping.select(F.col("macro_theme").alias("theme"))).distinct(),
            "category-names",
        )
        left = names.count()
        if left >= n:
            raise ValueError(f"{n} themes were merged into {left} categories; nothing is gained")
        n = left
        parsed, pairs = _ask(names, *asked)
        step = pairs.select(F.col("theme").alias("macro_theme"), F.col("macro_theme").alias("_merged"))
        mapping = write_table(
            lookup(mapping, write_table(step, "merge-step"), "macro_theme")
            .select("theme", F.coalesce("_merged", "macro_theme").alias("macro_theme")),
            "merged-mapping",
        )
    categories = write_table(
        parsed.select(F.posexplode("categories").alias("pos", "category")), "categories"
    )
    return with_fallback(themes, categories, mapping, fallback)


def with_fallback(
    themes: DataFrame, categories: DataFrame, mapping: DataFrame, fallback: str = "first"
) -> Harmonization:
    """Map the themes the answer left out.

    `first` (the default): when `Autre` is already a category, every unmapped
    theme goes to the first category; otherwise `Autre` is appended, takes the
    first unmapped theme in code-point order, and the later ones go to the first
    category. `autre` sends all of them to `Autre`.
    """
    if fallback not in ("first", "autre"):
        raise ValueError(f"unknown fallback {fallback!r}")
    unmapped = themes.select("theme").join(mapping.select("theme"), "theme", "left_anti")
    facts = categories.agg(
        F.min_by("category", "pos").alias("first"),
        F.coalesce(F.bool_or(F.col("category") == FALLBACK_CATEGORY), F.lit(False)).alias("known"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    lowest = unmapped.agg(F.min("theme").alias("theme")).first()["theme"]
    if lowest is None:
        return Harmonization(categories, mapping)

    other = F.lit(FALLBACK_CATEGORY)
    if fallback == "autre":
        macro: Column = other
    elif facts["known"]:
        macro = F.lit(facts["first"])
    else:
        rest = F.lit(facts["first"]) if facts["first"] is not None else other
        macro = F.when(F.col("theme") == lowest, other).otherwise(rest)
    if not facts["known"]:
        appended = categories.sparkSession.createDataFrame(
            [(facts["n"], FALLBACK_CATEGORY)], "pos int, category string"
        )
        categories = categories.unionByName(appended)
    return Harmonization(
        categories,
        mapping.select("theme", "macro_theme").unionByName(
            unmapped.select("theme", macro.alias("macro_theme"))
        ),
    )


def apply_mapping(analyses: DataFrame, mapping: DataFrame) -> DataFrame:
    """Fill `macro_theme` from the theme, `Autre` when it is not mapped."""
    table = write_table(mapping.select("theme", F.col("macro_theme").alias("_macro")), "mapping")
    joined = lookup(analyses, table, "theme")
    macro = F.coalesce("_macro", F.lit(FALLBACK_CATEGORY))
    return joined.withColumn("macro_theme", macro).drop("_macro").select(
        *analyses.columns, *([] if "macro_theme" in analyses.columns else ["macro_theme"])
    )
