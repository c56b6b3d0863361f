"""Reading model answers: strict JSON, schema check, first good attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxlake.functions.strict_json import (
    as_list, as_string, field, is_string, is_string_or_absent, with_strict_json,
)
from voxlake.functions.text import fill
from voxlake.schemas import (
    ANALYSIS_FIELDS, ATTEMPTS_FAILED, INVALID_JSON, INVALID_SCHEMA, NO_API_ANSWER,
    OPTIONAL_FIELDS, RAW_EXCERPT, REQUIRED_FIELDS, SENTIMENTS, SUMMARY_MAX,
)
from voxlake.session import prepare

# Outcomes of one attempt.
OK, NO_ANSWER, BAD_JSON, BAD_SCHEMA, UNEXPECTED = (
    "ok", "no_answer", "bad_json", "bad_schema", "unexpected",
)


def _wrong_field(v: Column) -> Column:
    """Name of the first field of an item that breaks the schema; null when all are right."""
    checks = [(f, is_string(field(v, f))) for f in REQUIRED_FIELDS]
    checks += [(f, is_string_or_absent(field(v, f))) for f in OPTIONAL_FIELDS]
    checks.append(("summary", F.length(as_string(field(v, "summary"))) <= SUMMARY_MAX))
    checks.append(("sentiment", as_string(field(v, "sentiment")).isin(SENTIMENTS)))
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(f)) for f, ok in checks])


def _item(v: Column) -> Column:
    return F.struct(*[as_string(field(v, f)).alias(f) for f in ANALYSIS_FIELDS])


def parse_answers(responses: DataFrame) -> DataFrame:
    """Judge each answer in `raw` and read it.

    Adds `kind` (ok, no_answer, bad_json, bad_schema, unexpected), `analyses`
    (array of analysis structs, only when ok) and `last_error`. One bad item
    rejects the whole answer. Unknown keys are ignored.
    """
    prepare(responses.sparkSession)
    if "error" not in responses.columns:
        responses = responses.withColumn("error", F.lit(None).cast("string"))
    parsed = with_strict_json(responses, "raw", "_json").withColumn(
        "_list", as_list(F.col("_json"), "analyses")
    ).withColumn("_wrong", F.transform("_list", _wrong_field))
    place = F.array_position(F.transform("_wrong", lambda w: w.isNotNull()), True) - 1
    wrong = F.when(F.col("_list").isNull(), F.lit("analyses")).otherwise(F.concat(
        F.lit("analyses["), place.cast("string"), F.lit("]."),
        F.get(F.col("_wrong"), place.cast("int")),
    ))
    kind = (
        F.when(F.col("error").isNotNull(), UNEXPECTED)
        .when(F.col("raw").isNull(), NO_ANSWER)
        .when(F.col("_json").isNull() | F.is_variant_null("_json"), BAD_JSON)
        .when(F.col("_list").isNull() | F.exists("_wrong", lambda w: w.isNotNull()), BAD_SCHEMA)
        .otherwise(OK)
    )
    detail = (
        F.when(F.col("kind") == UNEXPECTED, F.col("error"))
        .when(F.col("kind") == NO_ANSWER, F.lit(NO_API_ANSWER))
        .when(F.col("kind") == BAD_JSON, fill(INVALID_JSON, F.left("raw", F.lit(RAW_EXCERPT))))
        .when(F.col("kind") == BAD_SCHEMA, fill(INVALID_SCHEMA, wrong))
    )
    return (
        # A generated column: a filter on it stays above the parsing instead of
        # being rewritten into it, which would parse once per mention.
        parsed.select("*", F.explode(F.array(kind)).alias("kind"))
        .withColumn("analyses", F.when(F.col("kind") == OK, F.transform("_list", _item)))
        .withColumn("last_error", detail)
        .drop("_json", "_list", "_wrong")
    )


def first_accepted(parsed: DataFrame) -> DataFrame:
    """Per batch the first attempt that was read. `parsed` is read twice: write it first.

    Attempt numbers alone are aggregated, by hash; the answers join them once.
    """
    good = parsed.where(F.col("kind") == OK).select("batch_idx", "attempt", "analyses")
    first = good.groupBy("batch_idx").agg(F.min("attempt").alias("attempt"))
    return good.join(first, ["batch_idx", "attempt"]).select("batch_idx", "attempt", "analyses")


def failed_batches(parsed: DataFrame) -> DataFrame:
    """Batches without any good attempt, with the error of the last one.

    `parsed` is read twice: write it first.
    """
    last = (
        parsed.groupBy("batch_idx")
        .agg(
            F.bool_or(F.col("kind") == OK).alias("_done"), F.max("attempt").alias("attempt"),
            F.count(F.lit(1)).alias("attempts"),
        )
        .where(~F.col("_done")).drop("_done")
    )
    told = parsed.select("batch_idx", "attempt", "kind", "last_error")
    unexpected = F.col("kind") == UNEXPECTED
    return told.join(last, ["batch_idx", "attempt"]).select(
        "batch_idx",
        F.when(unexpected, "unexpected_error").otherwise("batch_failure").alias("type"),
        F.when(unexpected, F.col("last_error"))
        .otherwise(fill(ATTEMPTS_FAILED, F.col("attempts"), F.col("last_error"))).alias("error"),
    )


def flatten_analyses(accepted: DataFrame) -> DataFrame:
    """One row per returned item, with its place in the answer."""
    return accepted.select("batch_idx", F.posexplode("analyses").alias("pos", "item")).select(
        "batch_idx", F.col("pos").cast("bigint").alias("pos"), "item.*"
    )
