"""The questions a results dashboard asks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from voxlake.functions.text import percent
from voxlake.operators.lookup import HOT_ROWS, lookup
from voxlake.operators.membership import maybe_wanted
from voxlake.operators.quantify import COUNT_COLUMNS, global_sentiment
from voxlake.schemas import TEXT_NOT_FOUND, UNKNOWN_SOURCE
from voxlake.session import BROADCAST_ROWS, write_table
from voxlake.sources.metadata import latest_metadata

RESULT_COLUMNS = [
    "verbatim_id", "source", "texte_original", "macro_theme", "theme", "summary", "sentiment",
]
EXPLORER_COLUMNS = [
    "verbatim_id", "source", "texte_original", "macro_theme", "theme", "sentiment", "summary",
]


def backfill(
    results: DataFrame,
    raw_rows: DataFrame,
    hot_rows: int = HOT_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Fill missing texts and sources from raw rows (file, row, id, text, source).

    Rows that already have both, normally almost all, skip the join. A Bloom filter of
    the ids in need cuts the raw rows down inside their scan, however many ids there
    are; what passes is joined with the ids themselves.
    """
    for name in ("texte_original", "source"):
        if name not in results.columns:
            results = results.withColumn(name, F.lit(None).cast("string"))
    no_text = F.coalesce(F.col("texte_original"), F.lit("")) == ""
    no_source = F.coalesce(F.col("source"), F.lit(UNKNOWN_SOURCE)) == UNKNOWN_SOURCE
    complete = results.where(~(no_text | no_source))
    gaps = results.where(no_text | no_source)
    wanted = write_table(gaps.select(F.col("verbatim_id").alias("id")).distinct(), "wanted")
    passed = write_table(maybe_wanted(raw_rows, "id", wanted), "passed")
    latest = latest_metadata(passed).join(wanted, "id", "left_semi")
    known = write_table(
        latest.select(
            F.col("id").alias("verbatim_id"),
            F.col("text").alias("_text"), F.col("source").alias("_source"),
        ),
        "metadata",
    )
    filled = lookup(gaps, known, "verbatim_id", hot_rows, broadcast_rows)
    filled = filled.withColumn(
        "texte_original",
        F.when(no_text, F.coalesce("_text", F.lit(TEXT_NOT_FOUND)))
        .otherwise(F.col("texte_original")),
    ).withColumn(
        "source",
        F.when(no_source, F.coalesce("_source", F.lit(UNKNOWN_SOURCE)))
        .otherwise(F.col("source")),
    )
    return complete.unionByName(filled.select(*results.columns))


def ordered_columns(df: DataFrame, order: Sequence[str] = RESULT_COLUMNS) -> DataFrame:
    """The known columns that are present, in display order."""
    return df.select(*[c for c in order if c in df.columns])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def member_filter(df: DataFrame, **chosen: Sequence[str]) -> DataFrame:
    """Keep rows whose column is among the chosen values; an empty choice keeps all."""
    for column, values in chosen.items():
        if values:
            df = df.where(F.col(column).isin(list(values)))
    return df


def kpis(analyses: DataFrame, sources: Sequence[str] = ()) -> DataFrame:
    """Total, and count and percentage of each sentiment, in one row.

    Percentages are null when the filter leaves nothing.
    """
    names = COUNT_COLUMNS.items()
    counted = member_filter(analyses, source=sources).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("sentiment") == s).alias(f"n_{c}") for s, c in names],
    )
    return counted.select(
        "total",
        *[F.col(f"n_{c}") for _, c in names],
        *[percent(F.col(f"n_{c}"), F.col("total")).alias(f"pct_{c}") for _, c in names],
    )


def sentiment_split(analyses: DataFrame, sources: Sequence[str] = ()) -> DataFrame:
    return global_sentiment(member_filter(analyses, source=sources))


def theme_sentiment_counts(analyses: DataFrame, sources: Sequence[str] = ()) -> DataFrame:
    """Rows per macro theme and sentiment; only cells that occur."""
    return (
        member_filter(analyses, source=sources)
        .where(F.col("macro_theme").isNotNull() & F.col("sentiment").isNotNull())
        .groupBy("macro_theme", "sentiment")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("macro_theme", "sentiment")
    )


def explore(
    analyses: DataFrame,
    sources: Sequence[str] = (),
    macro_themes: Sequence[str] = (),
    sentiments: Sequence[str] = (),
) -> DataFrame:
    kept = member_filter(analyses, source=sources, macro_theme=macro_themes, sentiment=sentiments)
    return ordered_columns(kept, EXPLORER_COLUMNS)


def text_search(rows: DataFrame, term: str) -> DataFrame:
    """Rows where any column contains the term, ignoring case."""
    needle = F.lower(F.lit(term))
    hit = F.lit(False)
    for c in rows.columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), needle), F.lit(False))
    return rows.where(hit)


def preview(df: DataFrame, n: int = 20, order: Sequence[str] = ()) -> DataFrame:
    """A few raw rows to look at: the first along `order`, or whichever Spark finds first."""
    return df.orderBy(*order).limit(n) if order else df.limit(n)
