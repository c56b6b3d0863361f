"""CSV, JSON Lines and DataFrame sources of verbatims."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxlake.functions.text import source_label
from voxlake.operators.normalize import land_cells, land_verbatims, verbatim_cells
from voxlake.schemas import DEFAULT_LANG, LANG_CANDIDATES, SOURCE_CANDIDATES
from voxlake.session import matching_paths, own_splits, path_exists
from voxlake.sources.columns import detect_roles, find_column, require_column
from voxlake.sources.csv_records import PLACE, ROLES, csv_rows, first_csv_files

def _require(spark: SparkSession, path: str) -> None:
    """A file, a folder or a pattern that matches something."""
    if not path_exists(spark, path) and not matching_paths(spark, path):
        raise FileNotFoundError(path)


def load_csv(
    spark: SparkSession,
    path: str,
    text_col: str | None = None,
    id_col: str | None = None,
    source: str | None = "csv",
    lang: str = DEFAULT_LANG,
    limit: int | None = None,
    multiline: bool = True,
    surplus: str = "fail",
) -> DataFrame:
    """Normalise a CSV file or a folder of them: columns not given are found by name.

    Files may differ in their headers; each is read with its own. With
    `source=None` every file gives its label, the name up to the first `_`, as
    default source and in generated ids. Cells may hold line breaks, and large files
    are split all the same; where no cell does, `multiline=False` saves the look for
    them. A row with more cells than its header fails the job, or loses them with
    `surplus="drop"`. With `limit`, files that follow so many records are not read.
    """
    _require(spark, path)
    files = sorted(map(unquote, spark.read.schema("c0 string").csv(path).inputFiles()))
    if limit is not None:
        files = first_csv_files(spark, files, limit, multiline)
    default = source_label(F.col("_path")) if source is None else source

    def roles(columns: list[str]) -> dict[str, int | None]:
        found = detect_roles(columns)
        if text_col is not None:
            found["text"] = require_column(columns, text_col)
        if found["text"] is None:
            raise ValueError(f"no text column found; available: {columns}; give text_col")
        if id_col is not None:
            found["id"] = require_column(columns, id_col)
        return found

    rows = csv_rows(spark, files, roles, multiline, surplus)
    if rows is None:
        raise ValueError(f"no header in {path}")
    # A column that a file lacks is like one of nulls: ids are made, defaults hold.
    cells = verbatim_cells(rows.select(*ROLES, *PLACE), 0, 1, 2, 3, default, lang, null_tokens=True)
    return land_cells(cells, limit)


@contextmanager
def _case_sensitive(spark: SparkSession) -> Iterator[None]:
    """Let a table be read whose field names differ only by case."""
    before = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)


def load_jsonl(
    spark: SparkSession,
    path: str,
    text_field: str = "text",
    id_field: str = "id",
    source: str = "jsonl",
    lang: str = DEFAULT_LANG,
    limit: int | None = None,
    detect: bool = False,
    columns: list[str] | None = None,
) -> DataFrame:
    """Normalise JSON Lines. Text and id are read from the named fields.

    A missing text field yields no rows, a missing id field generated ids.
    `detect=True` looks both up by name instead. `columns` lists the fields to
    read and saves the pass that finds them.
    """
    _require(spark, path)
    reader = spark.read.option("primitivesAsString", True)
    if columns is not None:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    with _case_sensitive(spark):
        with own_splits(spark):  # the pass that finds the fields
            df = reader.json(path)
        roles = detect_roles(df.columns)
        if not detect:
            roles["text"] = find_column(df.columns, [text_field], case_sensitive=True)
            roles["id"] = find_column(df.columns, [id_field], case_sensitive=True)
        return land_verbatims(
            df, roles["text"], roles["id"], roles["source"], roles["lang"], source, lang, limit
        )


def from_dataframe(
    df: DataFrame,
    text_col: str,
    id_col: str | None = None,
    source: str = "dataframe",
    lang: str = DEFAULT_LANG,
    limit: int | None = None,
    id_prefix: str | None = None,
    null_tokens: bool = False,
) -> DataFrame:
    """Normalise any DataFrame. Without `id_col` ids are generated; a limit of 0 is none.

    `null_tokens` reads `NA`, `null` and the like as no value, as for CSV.
    """
    return land_verbatims(
        df,
        require_column(df.columns, text_col),
        None if id_col is None else require_column(df.columns, id_col),
        find_column(df.columns, SOURCE_CANDIDATES),
        find_column(df.columns, LANG_CANDIDATES),
        source, lang, limit or None, null_tokens, id_prefix,
    )
