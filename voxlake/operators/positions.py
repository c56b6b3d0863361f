"""Dense row positions and running totals without a single-task window."""

from __future__ import annotations

import math
import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxlake.functions.numbers import int_div
from voxlake.functions.text import file_name
from voxlake.session import own_splits, scanned_bytes, small_side, write_table

_SPLIT_BITS = 33  # monotonically_increasing_id: split number above, row in split below
# Bytes of files a task lands at least, unless that leaves cores idle.
LAND_BYTES = 32 * 1024 * 1024
_NARROW = ("Project", "Filter", "SubqueryAlias")


def _reads_files(df: DataFrame) -> bool:
    """Whether `df` is a scan of files with nothing but projections and filters on it."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in _NARROW:
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def with_place(df: DataFrame) -> DataFrame:
    """Add `_path` and `_block`: where a row was read, for rows that come straight from files.

    Anything else is placed by its split, in the order of the splits.
    """
    if {"_path", "_block"} <= set(df.columns):
        return df
    if _reads_files(df):
        try:
            return df.select(
                "*", file_name(F.col("_metadata.file_path")).alias("_path"),
                F.col("_metadata.file_block_start").alias("_block"),
            )
        except AnalysisException:  # a source without files, or a column of that name
            pass
    split = F.shiftright(F.monotonically_increasing_id(), _SPLIT_BITS)
    return df.select("*", F.lit("").alias("_path"), split.alias("_block"))


def first_files(df: DataFrame, limit: int) -> DataFrame:
    """Rows of the first files, by name, that hold `limit` rows between them; the rest is not read.

    `df` is a scan of files with `_path`. Ever more files are counted, four times as
    many a time, and no file twice. Spark leaves files out by their names alone.
    """
    # Local files are listed as file:///a and read as file:/a.
    names = sorted({re.sub("^file:/+", "file:/", unquote(p)) for p in df.inputFiles()})
    start, end, held = 0, 1, 0
    while end < len(names):
        held += df.where(F.col("_path").isin(names[start:end])).count()
        if held >= limit:
            return df.where(F.col("_path").isin(names[:end]))
        start, end = end, end + 4 * (end - start)
    return df


def _fewer_tasks(df: DataFrame) -> DataFrame:
    """Several splits a task where they are small; every block of a file stays in one piece.

    Each task writes a file, and a file for every few rows is read back far more slowly.
    """
    if not _reads_files(df):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(4 * cores, math.ceil(scanned_bytes(df) / LAND_BYTES)))


def land_positions(
    df: DataFrame, keep: Column | None = None, limit: int | None = None
) -> DataFrame:
    """Write `df` once together with each row's 0-based position.

    Adds `row_idx` over all rows and, with `keep`, `keep` itself and `position`
    over the kept rows only (null on the others). Rows of files are in the order of
    file name, block and line, however Spark packs them into splits; rows of other
    frames in the order of their splits. `limit` keeps the rows with a smaller
    `row_idx`.

    The rows of a block are always adjacent in their split. So a place inside the
    block follows from written row tags, the kept rows' own tags are drawn on
    them alone, and the only thing left is one running total over the blocks.
    """
    df = with_place(df)
    if limit is not None and _reads_files(df):
        df = first_files(df, limit)
    df = _fewer_tasks(df)
    tagged = df.withColumn("_row", F.monotonically_increasing_id())
    if keep is not None:
        tagged = tagged.withColumn("keep", F.coalesce(keep, F.lit(False))).withColumn(
            "_kept", F.when(F.col("keep"), F.monotonically_increasing_id())
        )
    landed = write_table(tagged, "landed")

    kept = keep is not None
    sizes = landed.groupBy("_path", "_block").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_first_row"),
        (F.count_if("keep") if kept else F.lit(0).cast("bigint")).alias("_keeps"),
        (F.min("_kept") if kept else F.lit(0).cast("bigint")).alias("_first_kept"),
    )
    # One row per block of a file: thousands, whatever the number of rows.
    before = Window.orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_path", "_block",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first_row")).alias("_to_row"),
        (F.coalesce(F.sum("_keeps").over(before), F.lit(0)) - F.col("_first_kept")).alias("_to_kept"),
    )
    with own_splits(df.sparkSession):
        starts = small_side(write_table(starts, "blocks"))
    out = landed.join(starts, ["_path", "_block"])
    out = out.withColumn("row_idx", F.col("_row") + F.col("_to_row"))
    if kept:
        out = out.withColumn("position", F.col("_kept") + F.col("_to_kept"))
    if limit is not None:
        out = out.where(F.col("row_idx") < limit)
    return out.drop("_path", "_block", "_row", "_kept", "_to_row", "_to_kept")


def running_totals(
    df: DataFrame,
    order: list[str],
    sums: dict[str, str],
    by: list[str] | None = None,
    span: int = 100_000,
) -> DataFrame:
    """Inclusive running sums of `sums` (column -> output) along `order`.

    `order[0]` is a non-negative, roughly dense integer. Rows are cut into
    ranges of `span` of it; totals per range are summed up first, so no task
    sees more than one range plus the short list of range totals. `df` is read
    twice: pass a written table.
    """
    by = by or []
    ranged = df.withColumn("_range", int_div(order[0], span))
    keys = [*by, "_range"]
    totals = ranged.groupBy(*keys).agg(*[F.sum(c).alias(f"_sum_{o}") for c, o in sums.items()])
    earlier = (Window.partitionBy(*by) if by else Window).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"_sum_{o}").over(earlier), F.lit(0)).alias(f"_before_{o}")
          for o in sums.values()],
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = ranged.select("*", *[F.sum(c).over(inside).alias(f"_in_{o}") for c, o in sums.items()])
    joined = local.join(before, keys)
    return joined.select(
        *df.columns,
        *[(F.col(f"_before_{o}") + F.col(f"_in_{o}")).alias(o) for o in sums.values()],
    )
