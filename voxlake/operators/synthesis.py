"""A qualitative synthesis per macro category.

A category may hold a third of all comments, so its review lines are cut into
chunks of bounded size, each chunk is one prompt, and the partial syntheses of
a category are merged by further prompts until one is left. A category that
fits one chunk costs exactly one call.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from voxlake.functions.numbers import int_div
from voxlake.functions.strict_json import (
    as_list, as_string, field, is_string, with_strict_json,
)
from voxlake.operators.inference import Answers, ask_in_rounds
from voxlake.operators.positions import running_totals
from voxlake.operators.quantify import one_row, one_row_of_macros
from voxlake.schemas import EMPTY_SYNTHESIS, MAX_RETRIES, RAW_EXCERPT
from voxlake.session import prepare, small_side, write_table

LINES_PER_CALL = 5_000
PARTS_PER_MERGE = 50

# Own wording; the answer shape is read by `parse_syntheses`.
ANSWER_SHAPE = """Answer with JSON only; leave a list empty when nothing supports it:
{"macro_theme": "...", "positive_points": ["..."], "negative_points": ["..."], "global_synthesis": "..."}
"""
SYNTHESIS_PROMPT = """Summarise what customers say about one subject. Write in French.
List the recurring strengths and the recurring complaints (two to five short points each)
and give the overall picture in two to four sentences. Stay with what the comments say.
"""
MERGE_PROMPT = """Several partial syntheses of customer comments on one subject follow.
Merge them into a single one of the same form. Write in French, drop repetitions, add nothing.
"""


def category_reviews(
    categories: DataFrame, analyses: DataFrame, lines_per_call: int = LINES_PER_CALL
) -> DataFrame:
    """Review lines per category and chunk: (category, chunk, n, lines).

    `categories` has one row per macro theme of the distribution; those without
    rows appear once with n = 0 and no lines. Lines keep the order of the
    comments. `analyses` is read twice: pass a written table.
    """
    rows = analyses.select(
        F.col("macro_theme").alias("category"), "batch_idx", "pos",
        F.concat(F.lit("- ["), "sentiment", F.lit("] "), "summary").alias("line"),
        F.lit(1).alias("_one"),
    ).where(F.col("category").isNotNull())
    placed = running_totals(rows, ["batch_idx", "pos"], {"_one": "_place"}, by=["category"], span=10_000)
    chunks = (
        placed.groupBy("category", int_div(F.col("_place") - 1, lines_per_call).alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct("_place", "line"))).alias("g"))
        .select("category", "chunk", F.size("g").cast("bigint").alias("n"),
                F.array_join(F.col("g.line"), "\n").alias("lines"))
    )
    # Joining names with chunks would send all texts of a category to one task.
    named = categories.select(F.col("macro_theme").alias("category")).distinct()
    seen = rows.select("category").distinct()
    empty = named.join(seen, "category", "left_anti").select(
        "category", F.lit(0).cast("bigint").alias("chunk"), F.lit(0).cast("bigint").alias("n"),
        F.lit("").alias("lines"),
    )
    return chunks.unionByName(empty)


def synthesis_prompts(chunks: DataFrame, instruction: str = SYNTHESIS_PROMPT) -> DataFrame:
    """One prompt per chunk that has lines."""
    return chunks.where(F.col("n") > 0).select(
        "category", "chunk",
        F.concat(
            F.lit(instruction), F.lit(ANSWER_SHAPE), F.lit("Subject: "), "category",
            F.lit("\n\n"), "lines", F.lit("\n"),
        ).alias("prompt"),
    )


def parse_syntheses(responses: DataFrame) -> DataFrame:
    """Read (category, chunk, raw, error): adds `problem` or the synthesis fields."""
    prepare(responses.sparkSession)
    j = F.col("_json")
    parsed = (
        with_strict_json(responses, "raw", "_json")
        .withColumn("_pos", as_list(j, "positive_points"))
        .withColumn("_neg", as_list(j, "negative_points"))
    )
    empty = F.to_json("_json").isin("null", "{}", "[]", "0", "false", '""')
    ok = (
        is_string(field(j, "macro_theme")) & is_string(field(j, "global_synthesis"))
        & F.forall("_pos", is_string) & F.forall("_neg", is_string)
    )
    about = F.concat(F.lit(" for "), F.col("category"))
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.coalesce("raw", F.lit("")) == "", F.concat(F.lit("no synthesis answer"), about))
        .when(
            j.isNull() | empty,
            F.concat(F.lit("no synthesis JSON"), about, F.lit(": "), F.left("raw", F.lit(RAW_EXCERPT))),
        )
        .when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("synthesis of wrong shape"), about))
    )
    return parsed.select(
        "category", "chunk", problem.alias("problem"),
        F.col("error").isNotNull().alias("unexpected"),
        as_string(field(j, "macro_theme")).alias("macro_theme"),
        F.transform("_pos", as_string).alias("positive_points"),
        F.transform("_neg", as_string).alias("negative_points"),
        as_string(field(j, "global_synthesis")).alias("global_synthesis"),
    )


def _partial_lines(parts: DataFrame, per_merge: int) -> DataFrame:
    """Partial syntheses as the lines of the next, shorter list of chunks."""
    told = F.array_join(
        F.concat(
            F.transform("positive_points", lambda p: F.concat(F.lit("- [positif] "), p)),
            F.transform("negative_points", lambda p: F.concat(F.lit("- [négatif] "), p)),
            F.array(F.concat(F.lit("- [bilan] "), F.col("global_synthesis"))),
        ),
        "\n",
    )
    return (
        parts.groupBy("category", int_div("chunk", per_merge).alias("_next"))
        .agg(F.array_sort(F.collect_list(F.struct("chunk", told.alias("told")))).alias("g"))
        .select(
            "category", F.col("_next").alias("chunk"), F.size("g").cast("bigint").alias("n"),
            F.array_join(F.col("g.told"), "\n").alias("lines"),
        )
    )


def synthesize(
    categories: DataFrame,
    analyses: DataFrame,
    answers: Answers,
    lines_per_call: int = LINES_PER_CALL,
    parts_per_merge: int = PARTS_PER_MERGE,
    max_retries: int = MAX_RETRIES,
    wait: Callable[[float], None] = time.sleep,
    at: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(syntheses, failures) per category; a failing category is left out.

    An empty category gets a fixed row without a call. Calls of all categories
    and chunks run in parallel; unusable answers are asked for again. With `at`, a
    folder, answers outlive a crash.
    """
    if parts_per_merge < 2:
        raise ValueError("parts_per_merge must be at least 2")
    chunks = write_table(category_reviews(categories, analyses, lines_per_call), "reviews")
    empty = chunks.where(F.col("n") == 0).select(
        "category", F.col("category").alias("macro_theme"),
        F.array().cast("array<string>").alias("positive_points"),
        F.array().cast("array<string>").alias("negative_points"),
        F.lit(EMPTY_SYNTHESIS).alias("global_synthesis"),
    )

    def ask(prompts: DataFrame) -> DataFrame:
        return ask_in_rounds(
            prompts, ["category", "chunk"], answers, parse_syntheses,
            "problem is not null and not unexpected", max_retries, wait, at,
        ).drop("attempt", "unexpected")

    parts = write_table(ask(synthesis_prompts(chunks)), "syntheses")
    failures = parts.where(F.col("problem").isNotNull()).select("category", "problem")
    # Each round divides the number of parts of a category by parts_per_merge.
    while parts.where(F.col("chunk") > 0).limit(1).count() > 0:
        bad = small_side(write_table(failures.select("category").distinct(), "failed"))
        good = write_table(parts.join(bad, "category", "left_anti"), "good")
        several = small_side(
            write_table(good.where(F.col("chunk") > 0).select("category").distinct(), "several")
        )
        merged_in = good.join(several, "category", "left_semi")
        single = good.join(several, "category", "left_anti")
        lines = _partial_lines(merged_in, parts_per_merge)
        merged = ask(synthesis_prompts(lines, MERGE_PROMPT))
        parts = write_table(merged.unionByName(single), "syntheses")
        failures = failures.unionByName(
            parts.where(F.col("problem").isNotNull()).select("category", "problem")
        )
    failures = failures.groupBy("category").agg(F.min("problem").alias("problem"))
    done = parts.where(F.col("problem").isNull()).join(
        failures.select("category"), "category", "left_anti"
    )
    return done.drop("chunk", "problem").unionByName(empty), failures


def attach_syntheses(report: DataFrame, syntheses: DataFrame) -> DataFrame:
    """Put the syntheses into the report, replacing earlier ones, keyed by category.

    One row per category.
    """
    entry = F.struct("macro_theme", "positive_points", "negative_points", "global_synthesis")
    pairs = F.map_from_entries(F.collect_list(F.struct("category", entry.alias("s"))))
    all_ = syntheses.agg(one_row_of_macros(pairs).alias("syntheses"))
    return one_row(report.drop("syntheses"), all_)


def synthesis_points(syntheses: DataFrame) -> DataFrame:
    """One row per positive or negative point: (category, polarity, pos, point)."""
    def side(column: str, polarity: str) -> DataFrame:
        return syntheses.select("category", F.posexplode(column).alias("pos", "point")).select(
            "category", F.lit(polarity).alias("polarity"), "pos", "point"
        )

    return side("positive_points", "positive").unionByName(side("negative_points", "negative"))
