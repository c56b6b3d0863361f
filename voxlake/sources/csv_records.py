"""Records of CSV files whose cells may hold line breaks, found range by range.

Where a range of a file begins, nobody knows whether a quoted cell is open. So each range
is read under both assumptions; one look at the few ranges of a file, in their order,
tells which held; and a second read cuts the lines into records, each in the range where
it begins. Only the ends of records are found here: cells are read by Spark's own
parser.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxlake.functions.text import file_name
from voxlake.session import is_small, write_table
from voxlake.sources.columns import distinct_headers

# Tasks get this module's code with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CSV_OPTIONS = {"escape": '"', "encoding": "UTF-8"}
PLACE = ["_path", "_block"]

# A quoted cell goes on to a quote that is not doubled; after it, as anywhere else, quotes mean nothing.
_CLOSED = '[^"]*+(?:""[^"]*+)*+"(?!")[^,]*+'
_CELL = f'(?:[^",][^,]*+|"{_CLOSED})?+'
_REST = re.compile(_CLOSED)
_CELLS = re.compile(f"{_CELL}(?:,{_CELL})*+")


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open after a line, given whether one was before it."""
    at = 0
    if inside:
        rest = _REST.match(line)
        if rest is None:
            return True
        if rest.end() == len(line):
            return False
        at = rest.end() + 1  # a comma
    return '"' in line and _CELLS.match(line, at).end() < len(line)


class Range:
    """What is known of a range under both assumptions."""

    def __init__(self, path: str, block: int, multiline: bool) -> None:
        self.path, self.block, self.multiline = path, block, multiline
        self.closed, self.opened = False, multiline  # whether a cell is open by now, if none or one was
        self.head: list[str] = []  # lines up to the end of the record that was open
        self.closes = not multiline
        self.n_closed = self.n_opened = 0  # records that begin here
        self.first: list[str] = []  # lines of the first record, if none was open
        self.first_ends = False

    def add(self, line: str) -> None:
        if line.strip("\r"):
            self.n_closed += not self.closed
            self.n_opened += not self.opened
        closed = self.multiline and ends_inside(line, self.closed)
        if not self.first_ends and (self.first or line.strip("\r")):
            self.first.append(line)
            self.first_ends = not closed
        if not self.closes:
            self.head.append(line)
            self.closes = not ends_inside(line, True)
            self.opened = not self.closes
        else:
            self.opened = closed if self.opened == self.closed else self.multiline and ends_inside(line, self.opened)
        self.closed = closed

    def row(self) -> tuple:
        first = "\n".join(self.first).lstrip("\ufeff") if self.block == 0 else None
        return (
            self.path, self.block, self.closed, self.opened, "\n".join(self.head) if self.multiline else "",
            self.closes, first, self.block == 0 and not self.first_ends and bool(self.first),
            self.n_closed, self.n_opened,
        )


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, object, str]]:
    """Lines with the range they stand in; those of a range follow each other."""
    for batch in batches:
        yield from zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns)])


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of files and where they were read; Spark cuts large files where it likes.

    Bytes that are no UTF-8 become U+FFFD, as Spark's parser of files has it.
    """
    return spark.read.option("lineSep", "\n").text(paths).select(
        file_name(F.col("_metadata.file_path")).alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"), F.make_valid_utf8("value").alias("value"),
    )


_RANGE = "_path string, _block long, closed boolean, opened boolean, head string, closes boolean, first string, first_open boolean, n_closed long, n_opened long"
_BEGINS = "_path string, _block long, inside boolean, feeds long"


def _ranges(lines: DataFrame, multiline: bool) -> DataFrame:
    def summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[Range]) -> pa.RecordBatch:
            columns = list(zip(*[r.row() for r in rows])) or [()] * 10
            text, truth, number = pa.string(), pa.bool_(), pa.int64()
            kinds = [text, number, truth, truth, text, truth, text, truth, number, number]
            names = ["_path", "_block", "closed", "opened", "head", "closes", "first", "first_open", "n_closed", "n_opened"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        now: Range | None = None
        for path, block, line in _by_range(batches):
            if now is None or (now.path, now.block) != (path, block):
                if now is not None:
                    yield told([now])
                now = Range(path, block, multiline)
            now.add(line)
        yield told([] if now is None else [now])

    return write_table(lines.mapInArrow(summed_up, _RANGE), "csv-ranges")


def _begins(ranges: DataFrame) -> DataFrame:
    """Whether a cell is open where a range begins, and the range whose last record its head ends.

    One group per file, with a few numbers for each of its ranges.
    """

    def composed(ranges: pd.DataFrame) -> pd.DataFrame:
        inside, opener, out = False, None, []
        for r in ranges.sort_values("_block").itertuples(index=False):
            out.append((r[0], r[1], inside, opener if inside else None))
            if not inside or r.closes:
                opener = r[1]
            inside = r.opened if inside else r.closed
        return pd.DataFrame({
            "_path": [o[0] for o in out], "_block": [o[1] for o in out], "inside": [o[2] for o in out],
            "feeds": pd.array([o[3] for o in out], "Int64"),
        })

    found = ranges.select(*PLACE, "closed", "opened", "closes").groupBy("_path").applyInPandas(composed, _BEGINS)
    return write_table(found, "csv-begins")


def _placed_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a written table with one row per key; rows of a range stay together and in order."""
    if is_small(table):
        return rows.join(F.broadcast(table), keys, how)
    tagged = rows.withColumn("_tag", F.monotonically_increasing_id())
    joined = tagged.join(table, keys, how)
    return joined.repartition(*PLACE).sortWithinPartitions(*PLACE, "_tag").drop("_tag")


def _records(lines: DataFrame, begins: DataFrame, multiline: bool) -> DataFrame:
    """(_path, _block, record, open): records that begin in a range, without the header.

    `open` marks the last one of a range if it goes on in the next.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, str, bool]] = []
        place: tuple[str, int] | None = None
        held: list[str] = []
        size = 0
        skipped = inside = False

        def done(record: str, is_open: bool) -> None:
            nonlocal skipped, size
            if not skipped:  # the header of a file, or what began in an earlier range
                skipped = True
            elif is_open or record.strip("\r"):
                out.append((*place, record if is_open else record.removesuffix("\r"), is_open))
                size += len(record)

        def batch() -> pa.RecordBatch:
            nonlocal out, size
            columns = list(zip(*out)) or [()] * 4
            out, size = [], 0
            kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], [*PLACE, "record", "open"]
            )

        for path, block, line, begins_inside in _by_range(batches):
            if (path, block) != place:
                if held:
                    done("\n".join(held), True)
                if begins_inside is None:
                    raise RuntimeError("files were cut otherwise when they were read again; run the job again")
                place, held, inside = (path, block), [], begins_inside
                skipped = block > 0 and not inside
            if not held and not inside and not line.strip("\r"):
                continue
            held.append(line)
            inside = multiline and ends_inside(line, inside)
            if not inside:
                done("\n".join(held), False)
                held = []
            if size > 1 << 22:
                yield batch()
        if held:
            done("\n".join(held), True)
        yield batch()

    placed = _placed_join(lines, begins.select(*PLACE, "inside"), PLACE, "left")
    return placed.select(*PLACE, "value", "inside").mapInArrow(
        cut, "_path string, _block long, record string, open boolean"
    )


def first_csv_files(spark: SparkSession, paths: Sequence[str], limit: int, multiline: bool = True) -> list[str]:
    """The first of `paths` that hold `limit` records between them, or all; the others are not read."""
    start, end, held = 0, 1, 0
    while end < len(paths):
        ranges = _ranges(_lines(spark, list(paths[start:end])), multiline)
        begun = ranges.join(_begins(ranges).select(*PLACE, "inside"), PLACE).select(
            "_path", F.when(F.col("inside"), F.col("n_opened")).otherwise(F.col("n_closed")).alias("n")
        )
        per_file = begun.groupBy("_path").agg(F.sum("n").alias("n")).where("n > 0")
        held += per_file.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).first()["n"]  # without the header
        if held >= limit:
            return list(paths[:end])
        start, end = end, end + 4 * (end - start)
    return list(paths)


Roles = Callable[[list[str]], dict[str, int | None] | None]
ROLES = ("text", "id", "source", "lang")


def csv_rows(
    spark: SparkSession, paths: Sequence[str], roles: Roles, multiline: bool = True, surplus: str = "fail"
) -> DataFrame | None:
    """(text, id, source, lang, has_id, has_source, _path, _block): cells of all files, None without any header.

    `roles` tells from a header which of its columns are needed, or None to leave
    its files out; it hears of each distinct header once. Files may differ in their
    headers, and a header may hold line breaks. Cells are strings, so `001` stays `001`;
    a column that a file lacks is null. A row with more cells than its header fails the
    job, or loses them with `surplus="drop"`. Empty files have no rows.

    Files are read twice, once for the ends of records alone. Line breaks are LF or CRLF,
    which becomes LF inside cells where the file's first line ends with it.
    """
    if surplus not in ("fail", "drop"):
        raise ValueError(f"unknown treatment of surplus cells {surplus!r}")
    if not paths:
        return None
    lines = _lines(spark, list(paths))
    ranges = _ranges(lines, multiline)
    begins = _begins(ranges)
    fed = begins.where("feeds is not null").join(ranges.select(*PLACE, "head"), PLACE)
    parts = F.array_sort(F.collect_list(F.struct("_block", "head")))
    rests = write_table(
        fed.groupBy("_path", F.col("feeds").alias("_block"))
        .agg(F.array_join(F.transform(parts, lambda p: p["head"]), "\n").alias("rest")), "csv-rests",
    )
    files = write_table(
        ranges.where("_block = 0 and first <> ''").join(rests, PLACE, "left").select(
            "_path", F.substring_index("first", "\n", 1).endswith("\r").alias("crlf"),
            F.rtrim(F.when(F.col("first_open"), F.concat_ws("\n", "first", "rest")).otherwise(F.col("first")), F.lit("\r"))
            .alias("header"),
        ), "csv-files",
    )
    known = []
    for row in files.select("header").distinct().collect():  # one row per distinct header
        names = distinct_headers(next(csv.reader(io.StringIO(row["header"], newline=""))))
        found = roles(names)
        if found is not None:
            known.append((row["header"], len(names), *[found.get(r) for r in ROLES]))
    if not known:
        return None
    schema = "header string, width int, " + ", ".join(f"at_{r} int" for r in ROLES)
    files = write_table(files.join(F.broadcast(spark.createDataFrame(known, schema)), "header").drop("header"), "csv-files")

    widest = max(k[1] for k in known)
    cell_schema = ", ".join(f"c{i} string" for i in range(widest + 1))
    found = _placed_join(_records(lines, begins, multiline), files, ["_path"])
    found = _placed_join(found, rests, PLACE, "left")
    whole = F.when(F.col("open"), F.rtrim(F.concat_ws("\n", "record", "rest"), F.lit("\r"))).otherwise(F.col("record"))
    whole = F.when(F.col("crlf"), F.replace(whole, F.lit("\r\n"), F.lit("\n"))).otherwise(whole)
    cells = F.from_csv(whole, cell_schema, {"escape": '"', "maxCharsPerColumn": "-1"})
    parsed = found.withColumn("cells", cells).withColumn(
        "cells", F.array(*[F.col(f"cells.c{i}") for i in range(widest + 1)])
    )
    if surplus == "fail":
        more = F.concat(F.lit("more cells than columns in "), F.col("_path"))
        parsed = parsed.where(
            F.when(F.get("cells", F.col("width")).isNull(), F.lit(True)).otherwise(F.raise_error(more).cast("boolean"))
        )

    def cell(role: str) -> Column:
        return F.get("cells", F.col(f"at_{role}")).alias(role)

    return parsed.select(*map(cell, ROLES), *[F.col(f"at_{r}").isNotNull().alias(f"has_{r}") for r in ("id", "source")], *PLACE)
