"""Finding the text, id, source and language columns of an unknown table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from voxlake.schemas import (
    ID_CANDIDATES, LANG_CANDIDATES, SOURCE_CANDIDATES, TEXT_CANDIDATES, UPLOAD_TEXT_CANDIDATES,
)


def find_column(
    columns: Sequence[str], candidates: Sequence[str], case_sensitive: bool = False
) -> int | None:
    """Ordinal of the first candidate that is present, or None.

    The order of the candidates decides. Among columns that differ only by
    case the last one is taken. Ordinals are returned because Spark cannot
    address such columns by name.
    """
    fold = (lambda s: s) if case_sensitive else str.lower
    by_name = {fold(name): i for i, name in enumerate(columns)}
    return next((by_name[fold(c)] for c in candidates if fold(c) in by_name), None)


def require_column(columns: Sequence[str], name: str) -> int:
    """Ordinal of a column given by its exact name."""
    if name not in columns:
        raise ValueError(f"no column {name!r}; available: {list(columns)}")
    return list(columns).index(name)


def detect_roles(columns: Sequence[str]) -> dict[str, int | None]:
    return {
        "text": find_column(columns, TEXT_CANDIDATES),
        "id": find_column(columns, ID_CANDIDATES),
        "source": find_column(columns, SOURCE_CANDIDATES),
        "lang": find_column(columns, LANG_CANDIDATES),
    }


def detect_upload_roles(columns: Sequence[str]) -> dict[str, int | None]:
    """Exact-case variant for uploads; the text falls back to the first column."""
    text = find_column(columns, UPLOAD_TEXT_CANDIDATES, case_sensitive=True)
    return {
        "text": 0 if text is None and columns else text,
        "id": find_column(columns, ID_CANDIDATES, case_sensitive=True),
    }


def roles_frame(df: DataFrame, roles: dict[str, int | None]) -> DataFrame:
    """The detected names as a frame (role, column_name)."""
    rows = [(role, None if i is None else df.columns[i]) for role, i in roles.items()]
    return df.sparkSession.createDataFrame(rows, "role string, column_name string")


def distinct_headers(names: Sequence[str]) -> list[str]:
    """Give exact repetitions a `.1`, `.2` suffix so that the first keeps its name."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out


def longest_text_column(df: DataFrame) -> DataFrame:
    """The column with the greatest mean text length, in one pass over the table.

    Nulls count as the three characters `nan`; the first column wins ties.
    """
    positional = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    means = positional.agg(*[
        F.avg(F.length(F.coalesce(F.col(c).cast("string"), F.lit("nan")))).alias(c)
        for c in positional.columns
    ])
    ranked = F.array_max(F.array(*[
        F.struct(F.col(f"c{i}").alias("mean_len"), F.lit(-i).alias("before"),
                 F.lit(name).alias("column_name"))
        for i, name in enumerate(df.columns)
    ]))
    return means.select(ranked.alias("best")).select("best.column_name", "best.mean_len")


def label_from_path(path: str, until: str = "_") -> str:
    """Source label of a file: its stem up to the first `_`.

    With `until="."` the file name up to the first dot.
    """
    name = re.split(r"[/\\]", path.rstrip("/"))[-1]
    stem = name if until == "." else re.sub(r"(?<=.)\.[^.]*$", "", name)
    return stem.split(until)[0]
