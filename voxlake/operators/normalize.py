"""From any table to the verbatim frame: strip, drop blanks, ids, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxlake.functions.text import strip
from voxlake.operators.positions import land_positions, with_place
from voxlake.schemas import NULL_TOKENS

VERBATIM_COLUMNS = ["row_idx", "id", "text", "source", "lang"]


def verbatim_cells(
    df: DataFrame,
    text: int | None,
    id: int | None,
    source_col: int | None,
    lang_col: int | None,
    source: str | Column,
    lang: str,
    null_tokens: bool = False,
) -> DataFrame:
    """The four needed cells of `df`, normalised, with the place each row was read from.

    Columns are given by ordinal. `source` is the default source: a string, or a
    column over `_path`, the file of the row.
    """
    placed = with_place(df)
    flat = placed.toDF(*[f"c{i}" for i in range(len(placed.columns) - 2)], "_path", "_block")

    def cell(i: int | None) -> Column:
        if i is None:
            return F.lit(None).cast("string")
        value = F.col(f"c{i}").cast("string")
        return F.when(~value.isin(NULL_TOKENS), value) if null_tokens else value

    default = F.lit(source) if isinstance(source, str) else source
    return flat.select(
        strip(cell(text)).alias("text"),
        cell(id).alias("id"),
        F.coalesce(strip(cell(source_col)), default).alias("source"),
        F.coalesce(strip(cell(lang_col)), F.lit(lang)).alias("lang"),
        default.alias("_prefix"), "_path", "_block",
    )


def land_cells(
    cells: DataFrame, limit: int | None = None, id_prefix: str | None = None
) -> DataFrame:
    """Number the rows of `verbatim_cells`; `keep` marks the usable ones.

    The text of a dropped row is not written. Generated ids number the unfiltered
    rows and carry the default source (or `id_prefix`), so they show gaps where
    rows were dropped.
    """
    usable = F.col("text").isNotNull() & ~F.col("text").isin("", "nan")
    cells = cells.withColumn("text", F.when(usable, F.col("text")))
    landed = land_positions(cells, keep=F.col("text").isNotNull(), limit=limit)
    prefix = F.col("_prefix") if id_prefix is None else F.lit(id_prefix)
    made = F.concat(prefix, F.lit("_"), F.col("row_idx").cast("string"))
    return landed.withColumn("id", F.coalesce("id", made)).drop("_prefix")


def land_verbatims(
    df: DataFrame,
    text: int | None,
    id: int | None,
    source_col: int | None,
    lang_col: int | None,
    source: str,
    lang: str,
    limit: int | None = None,
    null_tokens: bool = False,
    id_prefix: str | None = None,
) -> DataFrame:
    """All rows of `df`, normalised and numbered."""
    cells = verbatim_cells(df, text, id, source_col, lang_col, source, lang, null_tokens)
    return land_cells(cells, limit, id_prefix)


def kept(landed: DataFrame) -> DataFrame:
    """The verbatims: usable rows with `position`, their place among each other."""
    return landed.where("keep").select(*VERBATIM_COLUMNS, "position")


def ingest_counts(landed: DataFrame) -> DataFrame:
    """Rows read and rows kept."""
    return landed.agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if("keep").alias("rows_kept")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value, most frequent first."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "key")
    )
