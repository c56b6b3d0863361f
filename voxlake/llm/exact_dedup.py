"""Exact duplicates: 128-bit content hashes, smallest id kept, bytes compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from voxlake.llm.common import SPACES
from voxlake.session import small_side, write_table

# Rows of one group that are compared in one task.
ROWS_PER_SALT = 4_096
_LAST = 2**63 - 1


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _decided(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One group per key; the smallest id stays, of rows with the same id one."""
    groups = write_table(
        rows.groupBy(*keys).agg(
            F.min("doc_id").alias("keep_id"),
            F.count(F.lit(1)).alias("group_size"),
            F.min_by("row", F.coalesce("doc_id", F.lit(_LAST))).alias("keep_row"),
        ),
        "groups",
    )
    # Both sides are plain exchanges, so a group of any size can be split.
    return rows.join(groups, keys).select(
        "doc_id", "keep_id", "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_duplicates(
    docs: DataFrame, content_hash: Callable[[Column], Column] = F.md5
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row of `docs` (doc_id, text).

    Texts are equal when identical after white space runs became one space; null
    is the empty text. Only hashes are grouped. Texts move only where a hash
    occurs more than once, spread over salts, to be compared byte by byte; should
    two texts share a hash, its rows are grouped by the text itself.
    Null ids count as larger than any id and give a null `keep_id` only when a
    group has no other. Of rows that share the smallest id exactly one is kept.
    An empty table gives no rows; other columns are ignored.
    """
    text = normalised(F.col("text"))
    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("norm")).select(
        "doc_id", "norm", content_hash(F.col("norm")).alias("hash")
    )
    rows = write_table(
        full.select(
            "doc_id", "hash", F.unhex(F.sha2("norm", 256)).alias("sha"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "hashes",
    )
    shared = write_table(
        rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared"
    )
    salted = full.join(small_side(shared), "hash").withColumn(
        "salt",
        F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("n") / ROWS_PER_SALT)),
    )
    # min = max over every salt, and over the salts: all texts of the hash agree.
    per_salt = salted.groupBy("hash", "salt").agg(
        F.min("norm").alias("low"), F.max("norm").alias("high")
    )
    clashes = write_table(
        per_salt.groupBy("hash").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .where("low != high").select("hash"),
        "clashes",
    )
    if clashes.isEmpty():
        return _decided(rows, ["hash"])
    clash = small_side(clashes)
    told_apart = write_table(
        full.join(clash, "hash").select(
            "doc_id", "hash", "norm", F.unhex(F.sha2("norm", 256)).alias("sha"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "told_apart",
    )
    return _decided(rows.join(clash, "hash", "left_anti"), ["hash"]).unionByName(
        _decided(told_apart, ["hash", "norm"])
    )
