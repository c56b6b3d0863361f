"""Original text and source of every comment, looked up from raw CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from voxlake.functions.text import source_label
from voxlake.schemas import ID_CANDIDATES, NULL_TOKENS, UPLOAD_TEXT_CANDIDATES
from voxlake.session import list_names, small_side, write_table
from voxlake.sources.columns import find_column
from voxlake.sources.csv_records import csv_rows

# More rows than any file holds.
ROWS_PER_FILE = 1 << 40
_ROW = "file string, row bigint, id string, text string, source string"


def _numbered(rows: DataFrame) -> DataFrame:
    """Add `row`, the place inside the file, from written scan positions.

    A file may be cut into several splits and a task may read several files;
    the rows of one block of a file are always adjacent.
    """
    landed = write_table(rows.withColumn("_tag", F.monotonically_increasing_id()), "raw-rows")
    blocks = landed.groupBy("_path", "_block").agg(
        F.min("_tag").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = write_table(
        blocks.select(
            "_path", "_block", "_first",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        ),
        "raw-blocks",
    )
    return (
        landed.join(small_side(starts), ["_path", "_block"])
        .withColumn("row", F.col("_before") + F.col("_tag") - F.col("_first"))
        .withColumnRenamed("_path", "file")
        .drop("_block", "_tag", "_first", "_before")
    )


def scan_raw_files(
    spark: SparkSession, folder: str, multiline: bool = True, surplus: str = "fail"
) -> DataFrame:
    """Rows of all `*.csv` files of a folder: (file, row, id, text, source).

    Columns are found by exact case, per file. Files without a text column are
    ignored. A missing id becomes `{label}_{row}`, a missing source column the
    label; an empty source or text cell becomes `nan`. Texts stay as they are.
    """
    paths = [f"{folder.rstrip('/')}/{n}" for n in list_names(spark, folder) if n.endswith(".csv")]
    label = source_label(F.col("_path"))

    def roles(names: list[str]) -> dict[str, int | None] | None:
        text = find_column(names, UPLOAD_TEXT_CANDIDATES, case_sensitive=True)
        if text is None:
            return None
        return {
            "text": text, "id": find_column(names, ID_CANDIDATES, case_sensitive=True),
            "source": find_column(names, ["source"], case_sensitive=True),
        }

    def cell(name: str) -> Column:
        value = F.col(name)
        return F.coalesce(F.when(~value.isin(NULL_TOKENS), value), F.lit("nan"))

    rows = csv_rows(spark, paths, roles, multiline, surplus)
    if rows is None:
        return spark.createDataFrame([], _ROW)
    found = rows.select(
        "_path", "_block",
        F.when(F.col("has_id"), cell("id")).alias("id"), cell("text").alias("text"),
        F.when(F.col("has_source"), cell("source")).otherwise(label).alias("source"),
    )
    made = F.concat(source_label(F.col("file")), F.lit("_"), F.col("row").cast("string"))
    return _numbered(found).select(
        "file", "row", F.coalesce("id", made).alias("id"), "text", "source"
    )


def latest_metadata(rows: DataFrame) -> DataFrame:
    """One row per id: the later file wins, inside a file the later row.

    A file gets a number, so that the place of a row is one number too and its
    largest per id a hash aggregation that combines map-side; texts join it once.
    `rows` is read twice.
    """
    files = write_table(
        rows.select("file").distinct()
        .select("file", F.row_number().over(Window.orderBy("file")).alias("_file")), "files",
    )
    placed = rows.join(small_side(files), "file").withColumn(
        "_place", F.col("_file") * ROWS_PER_FILE + F.col("row")
    )
    last = placed.groupBy("id").agg(F.max("_place").alias("_last")).withColumnRenamed("id", "_id")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("_place") == F.col("_last"))
    return placed.join(last, same).select("id", "text", "source")


def load_raw_metadata(
    spark: SparkSession, folder: str, multiline: bool = True, surplus: str = "fail"
) -> DataFrame:
    return latest_metadata(scan_raw_files(spark, folder, multiline, surplus))
