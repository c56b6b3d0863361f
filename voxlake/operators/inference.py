"""Calling the user's model function over partitions of prompts."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from voxlake.operators.sealing import GROUP, Seals, ask, sealed
from voxlake.schemas import MAX_RETRIES
from voxlake.session import delete_path, path_exists, small_side, write_table

# (prompts, attempt) -> the key columns of the prompts plus raw and error. One with a true
# attribute `together` may be asked the prompts of several parts of a run in one call.
Answers = Callable[[DataFrame, int], DataFrame]


# Prompts that one task holds, in bytes.
TASK_BYTES = 64 * 1024 * 1024
# Groups of prompts that a task without seals holds as Python's strings.
SLICE_GROUPS = 16


def tasks_for(prompts: DataFrame) -> int:
    """A task per core for few prompts, more where their volume asks for it.

    `prompts` is read for its volume: build it on a written table.
    """
    size = prompts.agg(F.sum(F.octet_length("prompt").cast("bigint")).alias("n")).first()["n"] or 0
    cores = prompts.sparkSession.sparkContext.defaultParallelism
    return max(cores, math.ceil(size / TASK_BYTES))


def spread(prompts: DataFrame, *keys: str) -> DataFrame:
    """Prompts dealt out to as many tasks as they ask for.

    Adaptive execution would merge few prompts by size into a few tasks, which then
    make their slow calls one after another. A fixed number is left alone.
    """
    return prompts.repartition(tasks_for(prompts), *keys)


def ask_in_rounds(
    prompts: DataFrame,
    keys: list[str],
    answers: Answers,
    parse: Callable[[DataFrame], DataFrame],
    retry: str,
    max_retries: int = MAX_RETRIES,
    wait: Callable[[float], None] = time.sleep,
    at: str | None = None,
    all_attempts: bool = False,
    written: bool = False,
) -> DataFrame:
    """Ask every prompt, then those again whose answer meets the condition `retry`.

    `parse` reads (keys, raw, error) and keeps the keys; the last word on every
    prompt is returned with its `attempt`, or all attempts. Before each further round there is a
    wait that doubles. Raw answers are written before they are read. With `at`, a
    folder, they are kept under a digest of the prompts, and tasks seal them as they
    come: after a crash the same prompts are not asked again. Prompts are written first,
    unless they are `written`: made from a written table by projections alone.
    """
    spark = prompts.sparkSession
    prompts = prompts if written else write_table(prompts, "prompts")
    if at is not None:
        told = prompts.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*keys, "prompt")).alias("digest")
        ).first()
        at = f"{at}/{told['n']}-{(told['digest'] or 0) & (2**64 - 1):016x}"
    final: list[DataFrame] = []
    todo = prompts
    for attempt in range(max_retries + 1):
        if attempt > 0:
            wait(2**attempt)
        path = None if at is None else f"{at}.{attempt}"
        if path is None:
            raw = write_table(answers(spread(todo, *keys), attempt), "raw")
        elif path_exists(spark, f"{path}/_SUCCESS"):
            raw = spark.read.parquet(path)
        else:
            raw = _ask_the_rest(answers, todo, keys, attempt, path)
        parsed = write_table(parse(raw).withColumn("attempt", F.lit(attempt)), "parsed")
        again = parsed.where(retry).select(*keys)
        last = attempt == max_retries or again.isEmpty()
        over = F.lit(True) if last or all_attempts else ~F.coalesce(F.expr(retry), F.lit(False))
        final.append(parsed.where(over))
        if last:
            break
        todo = todo.join(again, keys, "left_semi")
    return reduce(DataFrame.unionByName, final)


def _ask_the_rest(answers: Answers, todo: DataFrame, keys: list[str], attempt: int, path: str) -> DataFrame:
    """Ask what no earlier call has sealed for this path, and write all answers there."""
    spark, seals = todo.sparkSession, f"{path}.seals"
    names = [*keys, "raw", "error"]
    if not path_exists(spark, seals):
        return write_answers(answers, spread(todo, *keys), attempt, "raw", path, seals, names)
    fields = [todo.schema[k] for k in keys] + [T.StructField(c, T.StringType()) for c in ("raw", "error")]
    kept = write_table(sealed(spark, seals, T.StructType(fields), keys), "unsealed")
    rest = spread(todo.join(small_side(kept.select(*keys)), keys, "left_anti"), *keys)
    return write_answers(answers, rest, attempt, "raw", path, seals, names, kept)


@dataclass(frozen=True)
class Asker:
    """An answering step that calls the model; see `answer_with`."""

    transport: Callable[[str], str | None]
    concurrency: int | None
    threads: int
    group: int

    def __call__(self, prompts: DataFrame, attempt: int, seals: str | None = None) -> DataFrame:
        """Keys, raw and error; with `seals`, a folder, answers are kept there as they come."""
        keys = [c for c in prompts.columns if c not in ("prompt", "n_items")]
        todo = prompts.select(*keys, "prompt")
        if self.concurrency is not None:
            todo = todo.repartition(self.concurrency, *keys)
        schema = T.StructType(
            [todo.schema[k] for k in keys]
            + [T.StructField("raw", T.StringType()), T.StructField("error", T.StringType())]
        )
        transport, threads, group = self.transport, self.threads, self.group
        step = max(group, threads) * (SLICE_GROUPS if seals is None else 1)

        def call(batches: Iterator) -> Iterator:
            import pyarrow as pa
            from pyspark import TaskContext

            mine = None if seals is None else Seals(seals, TaskContext.get().partitionId(), keys)
            named: list = []

            def frames() -> Iterator:
                # Prompts become Python's own strings a few at a time.
                for batch in batches:
                    for start in range(0, batch.num_rows, step):
                        part = batch.slice(start, step)
                        named[:] = [part.column(k) for k in keys]
                        yield part.to_pandas()

            for out in ask(frames(), transport, keys, threads, mine, group):
                told = [pa.Array.from_pandas(out[c], type=pa.string()) for c in ("raw", "error")]
                yield pa.RecordBatch.from_arrays([*named, *told], [*keys, "raw", "error"])

        return todo.mapInArrow(call, schema)


def answer_with(
    transport: Callable[[str], str | None], concurrency: int | None = None, threads: int = 1, group: int = GROUP
) -> Asker:
    """Make an answering step from `transport(prompt) -> text or None`.

    None means no answer: timeout, HTTP or network failure. An exception is an
    unexpected error; it is kept with its prompt and fails no other one.
    `concurrency` sets into how many tasks the prompts are spread; each task
    makes up to `threads` calls at a time, as a call mostly waits.
    The result must be written before it is read: a call is neither free nor
    repeatable, and a plan that is reused would call again. Stored runs let tasks seal
    every `group` answers, so that a task or a call that is killed costs no more.
    """
    return Asker(transport, concurrency, threads, group)


def write_answers(
    answers: Answers, prompts: DataFrame, attempt: int, name: str, path: str, seals: str,
    columns: list[Column | str], more: DataFrame | None = None,
) -> DataFrame:
    """Ask `prompts` and write `columns` of the answers, and `more`, at `path`; seals are needed until then."""
    asked = answers(prompts, attempt, seals) if isinstance(answers, Asker) else answers(prompts, attempt)
    rows = asked.select(*columns)
    written = write_table(rows if more is None else rows.unionByName(more), name, path)
    delete_path(prompts.sparkSession, seals)
    return written
