"""Splitting answers into valid rows and typed errors, one batch per row.

A batch is small by construction, so all its checks run inside one row with
array functions: after sent items and answer are joined on the batch, nothing
is shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxlake.functions.text import fill, strip, word_count
from voxlake.operators.positions import running_totals
from voxlake.schemas import (
    COUNT_MISMATCH, DUPLICATE_ID, EMPTY_THEME, ERROR, LONG_THEME, MISSING_VERBATIMS,
    SHORT_SUMMARY, SUMMARY_MIN, THEME_MAX_WORDS, UNKNOWN_ID,
)
from voxlake.session import write_table


def _issues(item: Column, i: Column) -> Column:
    """All issues of one item: repeated id, unknown id, theme, summary."""
    vid, theme, summary = item["verbatim_id"], item["theme"], item["summary"]
    words = word_count(theme)
    found = F.array(
        F.when(
            F.array_position("returned_ids", vid) != i + 1,
            fill(DUPLICATE_ID, vid),
        ),
        F.when(
            ~F.array_contains("sent_ids", vid),
            fill(UNKNOWN_ID, vid, F.array_join(F.array_sort(F.array_distinct("sent_ids")), ", ")),
        ),
        F.when(words == 0, F.lit(EMPTY_THEME)).when(
            words > THEME_MAX_WORDS, fill(LONG_THEME, words, theme)
        ),
        F.when(F.length(strip(summary)) < SUMMARY_MIN, fill(SHORT_SUMMARY, summary)),
    )
    return F.filter(found, lambda x: x.isNotNull())


def check_batches(accepted: DataFrame, batches: DataFrame) -> DataFrame:
    """One row per answered batch: counts, judged items, missing ids.

    `items` keeps the answer's order; each has its `issues`, and the original
    text and source of its id (the last one sent, when an id was sent twice) as
    far as the batches carry them.
    """
    sent_fields = batches.schema["items"].dataType.elementType.fieldNames()
    carried = [f for f in ("text", "source") if f in sent_fields]
    joined = accepted.select("batch_idx", "analyses").join(
        batches.select("batch_idx", F.col("items").alias("sent")), "batch_idx"
    )
    with_ids = joined.select(
        "*",
        F.col("sent.id").alias("sent_ids"),
        F.col("analyses.verbatim_id").alias("returned_ids"),
    )

    def judged(item: Column, i: Column) -> Column:
        origin = _origin(item["verbatim_id"])
        return F.struct(
            i.cast("bigint").alias("pos"),
            item.alias("data"),
            _issues(item, i).alias("issues"),
            *[origin[f].alias(f) for f in carried],
        )

    return with_ids.select(
        "batch_idx",
        F.size("sent").alias("expected"),
        F.size("analyses").alias("got"),
        F.transform("analyses", judged).alias("items"),
        F.array_sort(F.array_except("sent_ids", "returned_ids")).alias("missing_ids"),
    )


def _origin(verbatim_id: Column) -> Column:
    """The item that was sent under an id, the last one if there are two."""
    return F.try_element_at(F.filter("sent", lambda s: s["id"] == verbatim_id), F.lit(-1))


def places_and_ids(batches: DataFrame) -> DataFrame:
    """Batches without texts: all that checking needs, and all a scan then reads."""
    return batches.select("batch_idx", F.arrays_zip("items.pos", "items.id").alias("items"))


def with_origins(checked: DataFrame, batches: DataFrame) -> DataFrame:
    """Valid items of batches checked without texts, with the texts and sources that were sent."""
    fine = F.filter("items", lambda x: F.size(x["issues"]) == 0).alias("items")
    joined = checked.select("batch_idx", fine).join(
        batches.select("batch_idx", F.col("items").alias("sent")), "batch_idx"
    )

    def filled(x: Column) -> Column:
        origin = _origin(x["data"]["verbatim_id"])
        return F.struct(
            x["pos"].alias("pos"), x["data"].alias("data"), x["issues"].alias("issues"),
            origin["text"].alias("text"), origin["source"].alias("source"),
        )

    return joined.select("batch_idx", F.transform("items", filled).alias("items"))


def judged_items(checked: DataFrame) -> DataFrame:
    """One row per returned item."""
    # The outer form keeps Spark from adding a size filter on `items`, which
    # would be pushed down and judge every item twice.
    items = checked.select("batch_idx", F.explode_outer("items").alias("item"))
    return items.where(F.col("item").isNotNull()).select("batch_idx", "item.*")


def valid_analyses(checked: DataFrame) -> DataFrame:
    """Items without any issue, with the original text and source that were carried."""
    items = judged_items(checked)
    origin = {"text": "texte_original", "source": "source"}
    return items.where(F.size("issues") == 0).select(
        "batch_idx", "pos",
        "data.verbatim_id", "data.theme", "data.summary", "data.sentiment",
        *[F.col(f).alias(name) for f, name in origin.items() if f in items.columns],
        "data.macro_theme",
    )


def _error(**fields: Column) -> Column:
    """One error struct; fields not given are null."""
    return F.struct(*[
        fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ERROR.fields
    ])


def batch_errors(checked: DataFrame) -> DataFrame:
    """Count mismatches, item errors and missing ids of answered batches."""
    b = F.col("batch_idx")
    mismatch = F.when(
        F.col("expected") != F.col("got"),
        _error(
            type=F.lit("count_mismatch"), batch_idx=b,
            expected=F.col("expected"), got=F.col("got"),
            detail=fill(COUNT_MISMATCH, F.col("got"), F.col("expected")),
        ),
    )
    item_errors = F.transform(
        F.filter("items", lambda x: F.size(x["issues"]) > 0),
        lambda x: _error(
            type=F.lit("item_validation"), batch_idx=b,
            verbatim_id=x["data"]["verbatim_id"], issues=x["issues"], data=x["data"],
        ),
    )
    missing = F.when(
        F.size("missing_ids") > 0,
        _error(
            type=F.lit("missing_verbatims"), batch_idx=b, missing_ids=F.col("missing_ids"),
            detail=fill(MISSING_VERBATIMS, F.size("missing_ids")),
        ),
    )
    around = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    return (
        checked.select(
            F.explode_outer(F.concat(around(mismatch), item_errors, around(missing))).alias("e")
        )
        .where(F.col("e").isNotNull())
        .select("e.*")
    )


def failure_errors(failed: DataFrame, batches: DataFrame) -> DataFrame:
    """Errors of batches without an answer, with the ids they hold."""
    return failed.join(batches, "batch_idx").select(
        _error(
            type=F.col("type"), batch_idx=F.col("batch_idx"),
            verbatim_ids=F.col("items.id"), error=F.col("error"),
        ).alias("e")
    ).select("e.*")


def all_errors(checked: DataFrame, failed: DataFrame, batches: DataFrame) -> DataFrame:
    return batch_errors(checked).unionByName(failure_errors(failed, batches))


def batch_tallies(checked: DataFrame, failed: DataFrame) -> DataFrame:
    """Valid rows and errors of each batch, one row per batch."""
    n_bad = F.size(F.filter("items", lambda x: F.size(x["issues"]) > 0))
    answered = checked.select(
        "batch_idx",
        F.lit(True).alias("completed"),
        (F.size("items") - n_bad).cast("bigint").alias("n_valid"),
        (
            n_bad
            + (F.col("expected") != F.col("got")).cast("int")
            + (F.size("missing_ids") > 0).cast("int")
        ).cast("bigint").alias("n_errors"),
    )
    nothing = failed.select(
        "batch_idx", F.lit(False).alias("completed"),
        F.lit(0).cast("bigint").alias("n_valid"),
        F.lit(1).cast("bigint").alias("n_errors"),
    )
    return answered.unionByName(nothing)


def batch_progress(tallies: DataFrame, total_batches: int, span: int = 100_000) -> DataFrame:
    """Progress after each batch: its number, the total, valid rows and errors so far."""
    totals = running_totals(
        write_table(tallies, "tallies"), ["batch_idx"],
        {"n_valid": "cum_valid", "n_errors": "cum_errors"}, span=span,
    )
    return totals.select(
        "batch_idx", (F.col("batch_idx") + 1).alias("batch_no"),
        F.lit(total_batches).cast("bigint").alias("total_batches"), "cum_valid", "cum_errors",
    )


def run_totals(tallies: DataFrame) -> DataFrame:
    """Totals of a run: valid rows, errors, completed and attempted batches."""
    return tallies.agg(
        F.coalesce(F.sum("n_valid"), F.lit(0)).alias("valid"),
        F.coalesce(F.sum("n_errors"), F.lit(0)).alias("errors"),
        F.count_if("completed").alias("completed"),
        F.count(F.lit(1)).alias("total"),
    )


def first_results(valid: DataFrame, n: int = 5) -> DataFrame:
    """The first `n` valid rows in input order, for a look at the outcome."""
    return valid.orderBy("batch_idx", "pos").limit(n)
