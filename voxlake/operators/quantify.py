"""Sentiment counts, shares, ranking and the report built from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxlake.functions.text import bar, fill, one_decimal, pad_left, pad_right, percent
from voxlake.operators.lookup import lookup
from voxlake.schemas import (
    FALLBACK_CATEGORY, REPORT_CATEGORY, REPORT_OVERALL, REPORT_SHARE, REPORT_TOTAL, SENTIMENTS,
)
from voxlake.session import write_table

# ASCII column names for the closed set of sentiments.
COUNT_COLUMNS = dict(zip(SENTIMENTS, ["positif", "negatif", "neutre"]))


# More items than any answer holds.
POSITIONS_PER_BATCH = 1 << 20
# Macro themes that a report can hold; harmonisation asks for a handful.
MOST_MACRO_THEMES = 100_000


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("total")] + [
        F.count_if(F.col("sentiment") == s).alias(c) for s, c in COUNT_COLUMNS.items()
    ]


def _per_sentiment() -> Column:
    """The count columns as an array of (sentiment, n) in the order of the set."""
    return F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(s).alias("sentiment"), F.col(c).alias("n"))
        for i, (s, c) in enumerate(COUNT_COLUMNS.items())
    ])


def global_sentiment(analyses: DataFrame) -> DataFrame:
    """Rows per sentiment; all three appear, also without rows."""
    return (
        analyses.agg(*_counts())
        .select(F.explode(_per_sentiment()).alias("s"))
        .select("s.sentiment", "s.n")
    )


def theme_tallies(analyses: DataFrame) -> DataFrame:
    """Counts per theme and where it first occurs: all a report needs of the rows."""
    # One number for the place keeps this a hash aggregation; a struct would sort all rows.
    place = F.col("batch_idx") * POSITIONS_PER_BATCH + F.col("pos")
    return analyses.groupBy("theme").agg(*_counts(), F.min(place).alias("first_row"))


def macro_tallies(tallies: DataFrame, mapping: DataFrame) -> DataFrame:
    """Counts per macro theme from the tallies per theme.

    Rows were summed up per theme before the mapping is joined, so neither a
    frequent theme nor a large mapping moves more than one row per theme.
    """
    table = write_table(mapping.select("theme", "macro_theme"), "mapping")
    named = lookup(tallies, table, "theme").withColumn(
        "macro_theme", F.coalesce("macro_theme", F.lit(FALLBACK_CATEGORY))
    )
    return named.groupBy("macro_theme").agg(
        *[F.sum(c).alias(c) for c in ["total", *COUNT_COLUMNS.values()]],
        F.min("first_row").alias("first_row"),
    )


def theme_distribution(macros: DataFrame, categories: DataFrame) -> DataFrame:
    """Counts per category, zeros included, plus macro themes outside the list."""
    listed = categories.groupBy(F.col("category").alias("macro_theme")).agg(
        F.min("pos").alias("category_pos")
    )
    joined = macros.join(listed, "macro_theme", "full_outer")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ["total", *COUNT_COLUMNS.values()]]
    return joined.select("macro_theme", *zero, "category_pos", "first_row")


def _ranked(distribution: DataFrame) -> DataFrame:
    order = Window.orderBy(
        F.desc("total"), F.asc_nulls_last("category_pos"), F.asc_nulls_last("first_row")
    )
    return distribution.withColumn("rank", F.row_number().over(order))


def rank_by_volume(distribution: DataFrame) -> DataFrame:
    """Rank the macro themes, largest first; ties by category order, then first row.

    One row per macro theme takes part, never one per comment.
    """
    return _ranked(distribution).select("rank", "macro_theme", "total")


def sentiment_shares(distribution: DataFrame) -> DataFrame:
    """Share of each sentiment inside its macro theme, only where it occurs."""
    return (
        distribution.select("macro_theme", "total", F.explode(_per_sentiment()).alias("s"))
        .where(F.col("s.n") > 0)
        .select(
            "macro_theme", "s.sentiment", "s.n",
            percent(F.col("s.n"), F.col("total")).alias("pct"),
        )
    )


def category_shares(distribution: DataFrame) -> DataFrame:
    """Share of each macro theme in all rows."""
    everything = Window.partitionBy()
    return distribution.select(
        "macro_theme", "total",
        percent(F.col("total"), F.sum("total").over(everything)).alias("pct"),
    )


def global_shares(counts: DataFrame) -> DataFrame:
    everything = Window.partitionBy()
    return counts.select(
        "sentiment", "n", percent(F.col("n"), F.sum("n").over(everything)).alias("pct")
    )


def report_lines(distribution: DataFrame) -> DataFrame:
    """The text report as ordered lines (line_no, line); empty without rows.

    First the cells of the report are listed, each a count out of another one,
    then all are formatted alike. Works on one row per macro theme.
    """
    everything = Window.partitionBy()
    ranked = _ranked(distribution).withColumn("all", F.sum("total").over(everything))

    def cell(kind: str, sub: int, label: Column, n: Column, of: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(sub).alias("sub"), label.alias("label"),
            n.cast("bigint").alias("n"), of.cast("bigint").alias("of"),
        )

    inner = [
        cell("share", i + 1, F.lit(s), F.col(c), F.col("total"))
        for i, (s, c) in enumerate(COUNT_COLUMNS.items())
    ]
    title = cell("title", 0, F.col("macro_theme"), F.col("total"), F.col("all"))
    blocks = ranked.select(F.col("rank").alias("block"), F.explode(F.array(title, *inner)).alias("c"))

    overall = distribution.agg(*[F.sum(c).alias(c) for c in ["total", *COUNT_COLUMNS.values()]])
    top = [cell("total", 0, F.lit(""), F.col("total"), F.col("total"))] + [
        cell("overall", i + 1, F.lit(s), F.col(c), F.col("total"))
        for i, (s, c) in enumerate(COUNT_COLUMNS.items())
    ]
    head = overall.select(F.lit(0).alias("block"), F.explode(F.array(*top)).alias("c"))

    cells = (
        head.unionByName(blocks).select("block", "c.*")
        .where(F.col("of") > 0)
        .where((F.col("n") > 0) | (F.col("kind") != "share"))
        .withColumn("pct", percent(F.col("n"), F.col("of")))
        .withColumn("shown", pad_left(one_decimal("pct"), 5))
    )
    kind, label, n, shown = (F.col(c) for c in ("kind", "label", "n", "shown"))

    def counted(width: int) -> Column:
        return pad_left(n.cast("string"), width)

    name = pad_right(label, 10)
    line = (
        F.when(kind == "total", fill(REPORT_TOTAL, n))
        .when(kind == "overall", fill(
            REPORT_OVERALL, name, shown, counted(3), bar(F.col("pct"), 5, "█")))
        .when(kind == "title", fill(REPORT_CATEGORY, pad_right(label, 30), counted(3), shown))
        .when(kind == "share", fill(
            REPORT_SHARE, name, shown, counted(2), bar(F.col("pct"), 10, "░")))
    )
    return cells.select(
        F.row_number().over(Window.orderBy("block", "sub")).alias("line_no"), line.alias("line")
    )


def one_row(*parts: DataFrame) -> DataFrame:
    """Put one-row frames with different columns side by side, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def one_row_of_macros(gathered: Column) -> Column:
    """An aggregate that gathers macro themes. They are few by purpose; too many are an error."""
    message = F.lit(f"more than {MOST_MACRO_THEMES} macro themes")
    return F.when(F.count(F.lit(1)) > MOST_MACRO_THEMES, F.raise_error(message)).otherwise(gathered)


def report_document(distribution: DataFrame, source_file: str) -> DataFrame:
    """The report as one row: metadata, global sentiment, distribution.

    The mapping has a row per theme and is a table of its own, whatever its size.
    """
    counts = F.struct("total", *[F.col(c).alias(s) for s, c in COUNT_COLUMNS.items()])
    pairs = F.map_from_entries(F.collect_list(F.struct("macro_theme", counts.alias("counts"))))
    doc = distribution.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNT_COLUMNS.values()],
        one_row_of_macros(pairs).alias("theme_distribution"),
    )
    return doc.select(
        F.struct(
            F.lit(source_file).alias("source_file"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
            F.col("total").alias("total_verbatims"),
        ).alias("metadata"),
        F.map_from_arrays(
            F.array(*[F.lit(s) for s in COUNT_COLUMNS]), F.array(*COUNT_COLUMNS.values())
        ).alias("global_sentiment"),
        "theme_distribution",
    )
