"""Fixed-size batches and their prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voxlake.functions.numbers import int_div
from voxlake.operators.positions import land_positions
from voxlake.schemas import BATCH_SIZE

# Own wording; the answer shape is the contract of operators.responses.
ANALYSIS_PROMPT = """You read customer comments. Each comment below starts with its id in square brackets.
For every comment give, in French whatever its language:
- theme: the main subject, one to three words, free wording;
- summary: one short faithful sentence, at most 150 characters;
- sentiment: exactly one of "positif", "négatif", "neutre".
Answer with JSON only, one object per comment, in the order given, ids unchanged:
{"analyses": [{"verbatim_id": "...", "theme": "...", "summary": "...", "sentiment": "..."}]}

Comments:
"""


def assign_batches(verbatims: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Contiguous batches over the order of the verbatims: `batch_idx`, `pos_in_batch`.

    Frames from the sources carry `position`; others are numbered first.
    """
    if "position" not in verbatims.columns:
        verbatims = land_positions(verbatims.drop("row_idx")).withColumn(
            "position", F.col("row_idx")
        )
    return verbatims.select(
        "*",
        int_div("position", batch_size).alias("batch_idx"),
        (F.col("position") % batch_size).cast("int").alias("pos_in_batch"),
    ).drop("position")


def group_batches(
    batched: DataFrame, carry: Sequence[str] = ("text", "source", "lang")
) -> DataFrame:
    """One row per batch: `items`, at most `batch_size` structs in input order.

    This is the only shuffle of the texts. Prompts, validation and enrichment
    work inside the row from here on. `carry` names what an item holds besides
    place and id; leave the text out where neither prompts nor results need it.
    """
    item = F.struct(F.col("pos_in_batch").alias("pos"), "id", *carry)
    return batched.groupBy("batch_idx").agg(F.array_sort(F.collect_list(item)).alias("items"))


_HASHED = ["id", "text", "source", "lang"]


def fingerprint(batched: DataFrame) -> DataFrame:
    """(rows, digest) of a batched input: the xor of a hash of each row and its place."""
    digest = F.bit_xor(F.xxhash64("batch_idx", "pos_in_batch", *_HASHED))
    return batched.agg(F.count(F.lit(1)).alias("rows"), digest.alias("digest"))


def items_digest() -> Column:
    """The part of the fingerprint that one grouped batch accounts for."""
    return F.aggregate(
        "items", F.lit(0).cast("bigint"),
        lambda acc, x: acc.bitwiseXOR(F.xxhash64("batch_idx", x["pos"], *[x[f] for f in _HASHED])),
    )


def batch_lines(batches: DataFrame) -> DataFrame:
    """`[id] text` lines of each batch."""
    line = lambda v: F.concat(F.lit("["), v["id"], F.lit("] "), v["text"])
    return batches.select(
        "batch_idx",
        F.size("items").alias("n_items"),
        F.array_join(F.transform("items", line), "\n").alias("lines"),
    )


def build_prompts(batches: DataFrame) -> DataFrame:
    return batch_lines(batches).select(
        "batch_idx", "n_items",
        F.concat(F.lit(ANALYSIS_PROMPT), "lines", F.lit("\n")).alias("prompt"),
    )
