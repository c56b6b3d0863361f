"""Incremental analysis with Structured Streaming.

Each micro-batch goes through the same operators as a batch run and replaces
its own epoch folder, so a replayed epoch stores nothing twice; the streaming
checkpoint remembers which files were taken.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from voxlake.operators.batching import assign_batches, build_prompts, group_batches
from voxlake.operators.inference import Answers, ask_in_rounds
from voxlake.operators.normalize import kept
from voxlake.operators.quantify import global_sentiment
from voxlake.operators.responses import OK, UNEXPECTED, failed_batches, parse_answers
from voxlake.operators.validation import (
    all_errors, check_batches, places_and_ids, valid_analyses, with_origins,
)
from voxlake.plans.store import Store, save_errors, save_results
from voxlake.schemas import BATCH_SIZE, DEFAULT_LANG, MAX_RETRIES, SENTIMENTS
from voxlake.session import list_names, path_exists, scratch, small_side, write_table
from voxlake.sources.csv_records import CSV_OPTIONS
from voxlake.sources.readers import from_dataframe


def read_stream(
    spark: SparkSession, fmt: str, schema: T.StructType | str, folder: str,
    files_per_batch: int | None = None, **options: str,
) -> DataFrame:
    """Files of a folder as a stream; each micro-batch takes the new ones."""
    if fmt == "csv":
        options = {**CSV_OPTIONS, "header": "true", "multiLine": "true", **options}
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


# Epochs whose counts are summed into one folder.
EPOCHS_PER_COUNT = 1_000


def _epoch(epoch: int) -> str:
    return f"epoch-{epoch:09d}"


def analyse_epoch(
    frame: DataFrame,
    epoch: int,
    answers: Answers,
    store: Store,
    run_id: str,
    text_col: str,
    id_col: str | None = None,
    source: str = "stream",
    lang: str = DEFAULT_LANG,
    batch_size: int = BATCH_SIZE,
    max_retries: int = MAX_RETRIES,
    null_tokens: bool = False,
    wait: Callable[[float], None] = time.sleep,
) -> None:
    """Analyse one micro-batch and replace whatever its epoch stored before."""
    verbatims = kept(from_dataframe(
        frame, text_col, id_col, source, lang,
        id_prefix=f"{source}_{epoch}", null_tokens=null_tokens,
    ))
    batches = write_table(group_batches(assign_batches(verbatims, batch_size)), "batches")

    def judge(raw: DataFrame) -> DataFrame:
        return parse_answers(raw).drop("raw", "error")

    # A replayed epoch asks the same prompts and finds its answers again.
    parsed = write_table(
        ask_in_rounds(
            build_prompts(batches), ["batch_idx"], answers, judge,
            f"kind not in ('{OK}', '{UNEXPECTED}')", max_retries, wait,
            f"{store.path('responses', run_id)}/{_epoch(epoch)}", all_attempts=True,
            written=True,
        ), "judged",
    )
    # Texts are neither checked nor written with the checked answers; results join them once.
    slim = places_and_ids(batches)
    checked = write_table(check_batches(parsed.where(F.col("kind") == OK), slim), "checked")
    failed = small_side(write_table(failed_batches(parsed), "failed"))
    save_results(valid_analyses(with_origins(checked, batches)), store, run_id, _epoch(epoch))
    save_errors(all_errors(checked, failed, slim), store, run_id, _epoch(epoch))
    write_table(
        global_sentiment(valid_analyses(checked)), "sentiment",
        f"{store.path('sentiment', run_id)}/{_epoch(epoch)}",
    )


def analyse_stream(
    rows: DataFrame,
    answers: Answers,
    store: Store,
    run_id: str,
    checkpoint: str,
    text_col: str,
    id_col: str | None = None,
    source: str = "stream",
    lang: str = DEFAULT_LANG,
    batch_size: int = BATCH_SIZE,
    max_retries: int = MAX_RETRIES,
    null_tokens: bool = False,
    every: str | None = None,
    wait: Callable[[float], None] = time.sleep,
) -> StreamingQuery:
    """Start analysing a stream of comments.

    Stops when all present files are done, or looks for new ones `every` so
    often ("1 minute") until it is stopped. Row numbers start again in every epoch, so generated ids are
    `{source}_{epoch}_{row}`.
    """

    def one_epoch(frame: DataFrame, epoch: int) -> None:
        with scratch(frame.sparkSession):
            analyse_epoch(
                frame, epoch, answers, store, run_id, text_col, id_col, source, lang,
                batch_size, max_retries, null_tokens, wait,
            )
            if epoch % EPOCHS_PER_COUNT == EPOCHS_PER_COUNT - 1:
                compact_counts(store, run_id, epoch)

    return (
        rows.writeStream.foreachBatch(one_epoch)
        .option("checkpointLocation", checkpoint)
        .trigger(**({"availableNow": True} if every is None else {"processingTime": every}))
        .start()
    )


_COUNTS = "sentiment string, n bigint"


def compact_counts(store: Store, run_id: str, epoch: int) -> None:
    """Sum the counts of all epochs up to `epoch` into one folder of its own.

    Its name tells what it holds, so counting stays right whichever of the older
    folders are gone already.
    """
    base = store.path("sentiment", run_id)
    total = f"{base}/upto-{epoch:09d}"
    if not path_exists(store.spark, f"{total}/_SUCCESS"):
        write_table(running_sentiment(store, run_id, epoch).coalesce(1), "sentiment", total)
    for name in list_names(store.spark, base):
        if name != f"upto-{epoch:09d}" and int(name.split("-")[1]) <= epoch:
            path = store.spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
            path.getFileSystem(store.spark._jsc.hadoopConfiguration()).delete(path, True)


def running_sentiment(store: Store, run_id: str, last: int | None = None) -> DataFrame:
    """Sentiment counts over all epochs so far (up to `last`), from three rows per folder."""
    spark, base = store.spark, store.path("sentiment", run_id)
    domain = F.explode(F.array(*[F.lit(s) for s in SENTIMENTS])).alias("sentiment")
    zeros = spark.range(1).select(domain, F.lit(0).cast("bigint").alias("n"))
    written = [(int(p.split("-")[1]), p) for p in store.committed("sentiment", run_id)]
    totals = [e for e, p in written if p.startswith("upto-")]
    since = max(totals, default=-1)
    paths = [
        f"{base}/{p}" for e, p in written
        if (last is None or e <= last) and (e == since if p.startswith("upto-") else e > since)
    ]
    if paths:
        zeros = zeros.unionByName(spark.read.schema(_COUNTS).parquet(*paths))
    return zeros.groupBy("sentiment").agg(F.sum("n").alias("n"))


def stream_results(store: Store, run_id: str) -> DataFrame:
    return store.read_rows(store.path("results", run_id))
