"""Text search over stored rows through an index of trigrams.

Stored files are cut into blocks of a few rows. The index says which trigrams each block
holds, in any of its columns. A term can only stand in blocks that hold all trigrams of
it, so that files without such a block are not read; the rows of the others are
compared with the term as without an index. Every commit adds an index of its own files.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxlake.functions.numbers import int_div
from voxlake.functions.text import file_name
from voxlake.operators.dashboard import EXPLORER_COLUMNS, ordered_columns, text_search
from voxlake.plans.store import Store
from voxlake.session import delete_path, matching_paths

# Rows of a block. Fewer make the index larger and let fewer blocks through.
BLOCK_ROWS = 16
GRAM = 3
_POSTING = "gram string, file long, block long"
_FILE = "name string, file long, columns array<string>"


class Found(NamedTuple):
    """Rows with the term, and how many of the stored files they are read from."""

    rows: DataFrame
    files_read: int
    files: int


def trigrams(text: Column) -> Column:
    """All runs of three characters of a text in lower case, each once."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def _path(store: Store, run_id: str, kind: str) -> str:
    return store.path(f"search_{kind}", run_id)


def _names(rows: DataFrame) -> list[str]:
    """Files of a scan, as `_metadata.file_path` gives them once decoded."""
    return sorted({re.sub("^file:/+", "file:/", unquote(p)) for p in rows.inputFiles()})


def _listed(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "name string")


def index_part(
    store: Store, run_id: str, part: str | None = None, kind: str = "results",
    columns: Sequence[str] = EXPLORER_COLUMNS, block_rows: int = BLOCK_ROWS,
) -> None:
    """Index the stored rows of one part of a run, or of a kind that has no parts.

    Indexing again replaces the index of the part. It counts from the moment its list of
    files is written, which comes last; a crash before leaves the part without an index,
    and its files are searched row by row. Null cells have no trigrams.
    """
    spark, base = store.spark, store.path(kind, run_id)
    rows = store.read_rows(base if part is None else f"{base}/{part}")
    names = _names(rows)
    known = [c for c in columns if c in rows.columns]
    target = f"{_path(store, run_id, kind)}/{part or 'all'}"
    delete_path(spark, target)
    # A block's rows are brought together as they are: far fewer bytes than their trigrams.
    blocks = rows.select(
        F.xxhash64(file_name(F.col("_metadata.file_path"))).alias("file"),
        int_div(F.monotonically_increasing_id(), block_rows).alias("block"), *known,
    ).groupBy("file", "block").agg(F.collect_list(F.struct(*known)).alias("rows"))
    grams = F.array_distinct(F.flatten(F.transform("rows", lambda r: F.array_distinct(F.flatten(F.array(*[
        F.coalesce(trigrams(r[c].cast("string")), F.array().cast("array<string>")) for c in known
    ]))))))
    postings = blocks.select(F.explode(grams).alias("gram"), "file", "block")
    # Every file of the index is in the order of trigrams, so a look reads few of its pages.
    postings.sortWithinPartitions("gram", "file", "block").write.parquet(f"{target}/postings")
    _listed(spark, names).select(
        "name", F.xxhash64("name").alias("file"), F.array(*map(F.lit, known)).alias("columns")
    ).write.parquet(f"{target}/files")


def index_missing(store: Store, run_id: str, kind: str = "results") -> None:
    """Index the written parts of a run that have no index, as after a crash."""
    marks = matching_paths(store.spark, f"{_path(store, run_id, kind)}/*/files/_SUCCESS")
    done = {m.split("/")[-3] for m in marks}
    for part in store.committed(kind, run_id):
        if part not in done:
            index_part(store, run_id, part, kind)


def _indexed(store: Store, run_id: str, kind: str, table: str, schema: str) -> DataFrame | None:
    """One of the tables of all indexes that were written to the end."""
    spark, base = store.spark, _path(store, run_id, kind)
    ended = [m.removesuffix("files/_SUCCESS") for m in matching_paths(spark, f"{base}/*/files/_SUCCESS")]
    return spark.read.schema(schema).parquet(*[f"{part}{table}" for part in ended]) if ended else None


def candidate_files(store: Store, run_id: str, term: str, kind: str = "results") -> DataFrame | None:
    """(file): hashes of the indexed files with a block that holds all trigrams of `term`.

    None for a term too short to have one.
    """
    spark = store.spark
    grams = spark.range(1).select(trigrams(F.lit(term)).alias("grams")).first()["grams"]
    postings = _indexed(store, run_id, kind, "postings", _POSTING)
    if not grams or postings is None:
        return None
    return (
        postings.where(F.col("gram").isin(grams)).groupBy("file", "block").count()
        .where(F.col("count") == len(grams)).select("file").distinct()
    )


def search_run(
    store: Store, run_id: str, term: str, kind: str = "results",
    columns: Sequence[str] = EXPLORER_COLUMNS,
) -> Found:
    """Rows of a run where any of `columns` contains the term, ignoring case.

    The rows are those of `text_search` over all stored rows. Files that no index
    lists, or lists without one of these columns, are read whole, and so is everything
    for a term of less than three characters. Indexes of files that are gone do
    not count. When most files hold the term all are scanned, which gives the
    same rows. Texts that a dashboard fills in from raw files are not stored and
    not searched.
    """
    rows = store.read_rows(store.path(kind, run_id))
    names = _names(rows)
    shown = [c for c in columns if c in rows.columns]
    candidates = candidate_files(store, run_id, term, kind)
    wanted = names
    if candidates is not None:
        listed = _indexed(store, run_id, kind, "files", _FILE)
        covers = F.size(F.array_except(F.array(*map(F.lit, shown)), "columns")) == 0
        without = listed.where(covers).join(candidates, "file", "left_anti").select("name")
        spared = {r["name"] for r in without.distinct().toLocalIterator()}
        wanted = [n for n in names if n not in spared]
    if len(wanted) <= len(names) // 2:
        rows = rows.where(file_name(F.col("_metadata.file_path")).isin(wanted) if wanted else F.lit(False))
    else:
        wanted = names
    return Found(text_search(ordered_columns(rows, shown), term), len(wanted), len(names))
