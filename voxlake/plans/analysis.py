"""The whole analysis of a run: batches, model rounds, validation, commit, resume."""

from __future__ import annotations

import hashlib
import logging
import time
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass, replace
from functools import partial
from itertools import count
from threading import Event

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxlake.functions.numbers import int_div
from voxlake.operators.batching import (
    assign_batches, build_prompts, fingerprint, group_batches, items_digest,
)
from voxlake.operators.inference import Answers, Asker, tasks_for, write_answers
from voxlake.operators.responses import OK, UNEXPECTED, failed_batches, parse_answers
from voxlake.operators.sealing import sealed
from voxlake.operators.validation import (
    all_errors, batch_progress, batch_tallies, check_batches, first_results, places_and_ids,
    run_totals, valid_analyses, with_origins,
)
from voxlake.plans.search import index_missing, index_part
from voxlake.plans.store import (
    PART, STORED, Store, load_errors, new_run_id, save_errors, save_results,
)
from voxlake.schemas import BATCH_SIZE, ERROR, MAX_RETRIES
from voxlake.session import (
    BROADCAST_ROWS, delete_path, few_rows_held, list_names, own_splits, path_exists, scanned_bytes, small_side,
    write_table,
)

# (batches handled by this call, all batches, valid rows, errors)
Progress = Callable[[int, int, int, int], None]

BUCKET_BYTES = 256 * 1024 * 1024
# Spark's own default limit for a bucketed table; beyond it buckets grow instead.
MAX_BUCKETS = 100_000
# Batches in a page of the grouped input. Pages are skipped by the batches they hold; without
# a limit a page has 20,000 of them, and a part would read the texts of many others.
PAGE_BATCHES = 64
# Batches between two commits: with the parts at work, what a crash can cost at most.
BATCHES_PER_COMMIT = 100_000
# Parts at work at a time. Apart, the many short jobs of each would leave most of a cluster idle.
PARTS_AT_ONCE = 8


@dataclass(frozen=True)
class Run:
    """What one call of `run_analysis` did. Frames hold only this call's rows."""

    store: Store
    run_id: str
    total_batches: int
    parts: tuple[str, ...]

    def _paths(self, kind: str) -> list[str]:
        return [f"{self.store.path(kind, self.run_id)}/{p}" for p in self.parts]

    @property
    def valid(self) -> DataFrame:
        paths = self._paths("results")
        if not paths:
            return self.store.spark.createDataFrame([], STORED)
        return self.store.read_rows(paths)

    @property
    def errors(self) -> DataFrame:
        spark = self.store.spark
        kept = self.store.committed("errors", self.run_id)
        paths = [f"{self.store.path('errors', self.run_id)}/{p}" for p in self.parts if p in kept]
        return spark.read.schema(ERROR).json(paths) if paths else spark.createDataFrame([], ERROR)

    @property
    def tallies(self) -> DataFrame:
        return _read_parts(self.store, "tallies", self.run_id, self.parts, _TALLY)

    @property
    def progress(self) -> DataFrame:
        """After each batch of this call: its number, the total, rows and errors so far."""
        return batch_progress(self.tallies, self.total_batches)

    @property
    def summary(self) -> DataFrame:
        return run_totals(self.tallies)

    def preview(self, n: int = 5) -> DataFrame:
        return first_results(self.valid, n)


_TALLY = "batch_idx bigint, completed boolean, n_valid bigint, n_errors bigint"
_RESPONSE = "batch_idx bigint, attempt int, raw string, error string"
_ANSWER = (
    "batch_idx bigint, attempt int, kind string, analyses array<struct<verbatim_id: string, "
    "theme: string, summary: string, sentiment: string, texte_original: string, source: string, "
    "macro_theme: string>>, last_error string"
)
_CHECKPOINT = "batch_idx bigint, committed_at timestamp"
_META = "run_id string, batch_size int, rows bigint, digest bigint, total_batches bigint, buckets int"


def _read_parts(
    store: Store, kind: str, run_id: str, parts: tuple[str, ...] | list[str], schema: str
) -> DataFrame:
    base = store.path(kind, run_id)
    paths = [f"{base}/{p}" for p in parts]
    if not paths:
        return store.spark.createDataFrame([], schema)
    return store.spark.read.schema(schema).parquet(*paths)


class _Batches:
    """The grouped input, kept as a table bucketed and sorted by batch.

    Answers are joined to it after every part; the bucketing spares the texts a
    second shuffle, and the order lets a part skip the pages of other parts.
    """

    def __init__(self, store: Store, run_id: str) -> None:
        self.store, self.run_id = store, run_id
        self.path = store.path("batches", run_id)
        digest = hashlib.md5(self.path.encode()).hexdigest()[:16]
        self.name = f"spark_catalog.default.voxlake_batches_{digest}"

    def write(self, batched: DataFrame, buckets: int) -> None:
        dealt = batched.repartition(buckets, "batch_idx")
        grouped = group_batches(dealt).withColumn("digest", items_digest())
        spark = batched.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        (
            grouped.write.mode("overwrite").format("parquet")
            .bucketBy(buckets, "batch_idx").sortBy("batch_idx")
            .option("parquet.page.row.count.limit", PAGE_BATCHES)
            .option("path", self.path).saveAsTable(self.name)
        )

    def read(self, buckets: int) -> DataFrame:
        spark = self.store.spark
        if not spark.catalog.tableExists(self.name):
            escaped = self.path.replace("\\", "\\\\").replace("'", "\\'")
            spark.sql(
                f"CREATE TABLE {self.name} (batch_idx BIGINT, items ARRAY<STRUCT<pos: INT, "
                "id: STRING, text: STRING, source: STRING, lang: STRING>>, digest BIGINT) "
                f"USING parquet CLUSTERED BY (batch_idx) SORTED BY (batch_idx) INTO {buckets} BUCKETS "
                f"LOCATION '{escaped}'"
            )
        return spark.table(self.name)


def _open_run(
    batched: DataFrame | None, store: Store, run_id: str, batch_size: int, resume: bool,
    buckets: int | None,
) -> tuple[DataFrame, int]:
    """The grouped batches and their number; refuses a run with other input."""
    spark = store.spark
    table = _Batches(store, run_id)
    meta_path = store.path("meta", run_id) + "/run"
    opened = bool(store.committed("meta", run_id))
    if batched is None:
        if not opened:
            raise FileNotFoundError(f"run {run_id} was never started")
        meta = spark.read.schema(_META).json(meta_path).first()
        return table.read(meta["buckets"]), meta["total_batches"]
    if opened:
        if not resume:
            raise FileExistsError(f"run {run_id} exists; resume it or choose another id")
        meta = spark.read.schema(_META).json(meta_path).first()
        now = fingerprint(batched).first()
        if (meta["batch_size"], meta["rows"], meta["digest"]) != (
            batch_size, now["rows"], now["digest"]
        ):
            raise ValueError(f"run {run_id} was started with another input or batch size")
        return table.read(meta["buckets"]), meta["total_batches"]

    if buckets is None:
        wanted = max(
            spark.sparkContext.defaultParallelism, scanned_bytes(batched) // BUCKET_BYTES
        )
        buckets = min(wanted, MAX_BUCKETS)
    table.write(batched, int(buckets))
    batches = table.read(buckets)
    batches.agg(
        F.lit(run_id).alias("run_id"),
        F.lit(batch_size).alias("batch_size"),
        F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("rows"),
        F.bit_xor("digest").alias("digest"),
        F.count(F.lit(1)).alias("total_batches"),
        F.lit(buckets).alias("buckets"),
    ).write.mode("overwrite").json(meta_path)
    return batches, spark.read.schema(_META).json(meta_path).first()["total_batches"]


def _completed(store: Store, run_id: str) -> DataFrame:
    spark, base = store.spark, store.path("checkpoint", run_id)
    if not path_exists(spark, base):
        return spark.createDataFrame([], _CHECKPOINT)
    # A part that was not written to the end has no visible files yet.
    return spark.read.schema(_CHECKPOINT).option("recursiveFileLookup", True).parquet(base)


def pending_batches(store: Store, run_id: str) -> DataFrame:
    """Batches of a run that are not completed and will be replayed."""
    meta = store.spark.read.schema(_META).json(store.path("meta", run_id) + "/run").first()
    batches = _Batches(store, run_id).read(meta["buckets"])
    return batches.select("batch_idx").join(_completed(store, run_id), "batch_idx", "left_anti")


def checkpoint(store: Store, run_id: str) -> DataFrame:
    """Completed batches, all batches and the time of the last commit, in one row."""
    meta = store.spark.read.schema(_META).json(store.path("meta", run_id) + "/run").first()
    return _completed(store, run_id).agg(
        F.lit(run_id).alias("run_id"),
        F.count(F.lit(1)).alias("completed_batches"),
        F.lit(meta["total_batches"]).cast("bigint").alias("total_batches"),
        F.max("committed_at").alias("last_update"),
    )


@dataclass(frozen=True)
class _Group:
    """Parts at work together. Each of their tables is written in one job for all of them.

    A table of one part is written in its place. Those of several parts are staged, with a
    folder for each part, and these folders are then moved to their places.
    """

    store: Store
    run_id: str
    # Wave to name of its part, both in order.
    parts: dict[int, str]
    width: int

    @property
    def alone(self) -> bool:
        return len(self.parts) == 1

    def part(self) -> Column:
        """Name of the part of `batch_idx`."""
        if self.alone:
            return F.lit(*self.parts.values())
        # A map is not written out in generated code, so all groups share that code.
        pairs = [c for wave, part in self.parts.items() for c in (F.lit(wave).cast("bigint"), F.lit(part))]
        return F.try_element_at(F.create_map(*pairs), int_div("batch_idx", self.width))

    def told(self, rows: DataFrame, kind: str) -> DataFrame:
        """Rows with their part, and room for them under the staged kinds."""
        delete_path(self.store.spark, self.store.staged(kind, self.run_id))
        return rows.withColumn(PART, self.part())

    def write(self, rows: DataFrame, kind: str, names: dict[str, str] | None = None) -> DataFrame:
        """Write a table; with `names`, of its folder for each part, it is put in place at once."""
        store, run_id = self.store, self.run_id
        if self.alone:
            (part,) = self.parts.values()
            return write_table(rows, kind, f"{store.path(kind, run_id)}/{(names or {}).get(part, part)}")
        staged = write_table(self.told(rows, kind), kind, store.staged(kind, run_id), PART)
        if names is None:
            return staged
        for part, name in names.items():
            store.put(kind, run_id, part, name)
        return _read_parts(store, kind, run_id, [*names.values()], rows.schema)


def _rounds(
    batches: DataFrame, todo: DataFrame, left: dict[str, int], answers: Answers, group: _Group,
    max_retries: int, wait: Callable[[float], None], earlier: Counter, pool: _Pool,
) -> tuple[list[str], dict[str, BaseException]]:
    """Ask until every batch is read or the attempts are used up.

    `todo` is a written list of batch ids, `left` how many each part has of them. Each
    round writes the raw answers, reads them back to judge them, and hands the failed ids
    to the next round. A transport error is final for this call. Returns the rounds
    written and what ended parts early; `earlier` is how many rounds a part has from
    crashed calls.
    """
    attempts: list[str] = []
    failures: dict[str, BaseException] = {}
    # Tasks that the first round took: enough for what is left of it, and looked for once.
    tasks: dict[str, int] = {}
    for attempt in range(max_retries + 1):
        names = {
            part: f"{part}.{earlier[part] + attempt:04d}" for part in group.parts.values()
            if left.get(part) and part not in failures
        }
        if not names:
            break
        if attempt > 0:
            wait(2**attempt)
        columns = ["batch_idx", F.lit(attempt).alias("attempt"), "raw", "error"]
        if len(names) > 1 and getattr(answers, "together", False):
            prompts = _prompts(batches, todo, sum(left.values()), tasks, "")
            raw = group.write(answers(prompts, attempt).select(*columns), "responses", names)
        else:
            failures |= _ask_each(
                batches, todo, left, answers, group, attempt, names, columns, tasks, pool
            )
            names = {part: name for part, name in names.items() if part not in failures}
            if not names:
                break
            raw = _read_parts(group.store, "responses", group.run_id, [*names.values()], _RESPONSE)
        judged = _judge(raw, group, names)
        attempts += names.values()
        again = judged.where(~F.col("kind").isin(OK, UNEXPECTED)).select("batch_idx")
        todo = again.withColumn(PART, group.part())
        left = {r[PART]: r["count"] for r in todo.groupBy(PART).count().collect()}
    return [name for name in attempts if name.split(".")[0] not in failures], failures


def _prompts(
    batches: DataFrame, todo: DataFrame, left: int, tasks: dict[str, int], whose: str
) -> DataFrame:
    """The prompts of `todo`, spread over as many tasks as were found for the first round."""
    todo = todo.select("batch_idx")
    asked = F.broadcast(todo) if left <= BROADCAST_ROWS else todo
    prompts = build_prompts(batches.join(asked, "batch_idx", "left_semi"))
    if whose not in tasks:
        tasks[whose] = tasks_for(prompts)
    cores = batches.sparkSession.sparkContext.defaultParallelism
    return prompts.repartition(max(cores, min(tasks[whose], left)), "batch_idx")


def _ask_each(
    batches: DataFrame, todo: DataFrame, left: dict[str, int], answers: Answers, group: _Group,
    attempt: int, names: dict[str, str], columns: list[Column | str], tasks: dict[str, int],
    pool: _Pool,
) -> dict[str, BaseException]:
    """Ask the parts of a round in calls of their own; `answers` hears of first rounds in order."""
    store, run_id = group.store, group.run_id
    heard = {part: Event() for part in names}
    before = dict(zip([*names][1:], names))

    def one_part(wave: int, part: str) -> None:
        def in_turn(prompts: DataFrame, attempt: int) -> DataFrame:
            if attempt == 0 and part in before:
                heard[before[part]].wait()
            try:
                return answers(prompts, attempt)
            finally:
                heard[part].set()

        try:
            mine = _waves(batches, group.width, wave, wave)
            prompts = _prompts(mine, todo.where(F.col(PART) == part), left[part], tasks, part)
            write_answers(
                answers if isinstance(answers, Asker) else in_turn, prompts, attempt, "responses",
                f"{store.path('responses', run_id)}/{names[part]}",
                f"{store.path('seals', run_id)}/{names[part]}", columns,
            )
        finally:
            heard[part].set()

    return pool({
        part: partial(one_part, wave, part) for wave, part in group.parts.items() if part in names
    })


def _waves(batches: DataFrame, width: int, first: int, last: int) -> DataFrame:
    """Batches of some waves."""
    return batches.where(
        (F.col("batch_idx") >= first * width) & (F.col("batch_idx") < (last + 1) * width)
    )


def run_analysis(
    verbatims: DataFrame | None,
    answers: Answers,
    store: Store,
    run_id: str | None = None,
    batch_size: int = BATCH_SIZE,
    max_retries: int = MAX_RETRIES,
    resume: bool = True,
    batches_per_commit: int = BATCHES_PER_COMMIT,
    buckets: int | None = None,
    wait: Callable[[float], None] = time.sleep,
    on_progress: Progress | None = None,
    index: bool = False,
    parts_at_once: int = PARTS_AT_ONCE,
) -> Run:
    """Analyse verbatims with the model behind `answers` and store the outcome.

    Work is committed in parts of `batches_per_commit` batches, `parts_at_once` of them
    at work at a time. Each part is asked in a call of its own, from a thread of its own, and
    `answers` hears of first rounds in order; an answering step with a true attribute
    `together` is asked all of them in one call. What follows is one job for all of them.
    A part keeps raw answers, judged answers, results, errors and, last of all, its
    checkpoint. When a part fails, the others at work are committed, and no further one is
    started. After a crash the
    answers already paid for are committed first, under the names of the unfinished parts,
    so nothing is asked or stored twice. Batches without a readable answer stay out of the
    checkpoint and are replayed by the next call with the same `run_id`. Such a call
    may leave the verbatims out (None): the run has kept its input, and nothing is
    read or numbered again. Given, they are compared with what was kept.
    `on_progress` hears of every batch once its part is committed; the frame
    `Run.progress` has the same. `index` adds the results of every part to the
    search index of the run.
    """
    run_id = run_id or new_run_id(store.spark)
    batched = None if verbatims is None else assign_batches(verbatims, batch_size)
    with own_splits(store.spark), few_rows_held(store.spark):
        return _run_parts(
            batched, answers, store, run_id, batch_size, max_retries, resume, batches_per_commit,
            buckets, wait, on_progress, index, parts_at_once,
        )


def _run_parts(
    batched: DataFrame | None, answers: Answers, store: Store, run_id: str, batch_size: int,
    max_retries: int, resume: bool, width: int, buckets: int | None,
    wait: Callable[[float], None], on_progress: Progress | None, index: bool, parts_at_once: int,
) -> Run:
    """Open or resume the run, and ask and commit what is not done yet."""
    spark = store.spark
    batches, total = _open_run(batched, store, run_id, batch_size, resume, buckets)
    parts = _recover(batches, store, run_id)
    if index:
        index_missing(store, run_id)
    done = store.committed("checkpoint", run_id)
    unfinished = batches.select("batch_idx")
    if done:
        unfinished = unfinished.join(_completed(store, run_id), "batch_idx", "left_anti")
    unfinished = write_table(
        unfinished.select("batch_idx", int_div("batch_idx", width).alias("wave")), "unfinished"
    )
    # One number per commit.
    held = {r["wave"]: r["count"] for r in unfinished.groupBy("wave").count().orderBy("wave").collect()}
    earlier = Counter(p.split(".")[0] for p in store.committed("responses", run_id))

    named = list(zip(held, _free_names({*done, *parts})))
    so_far, step = (0, 0, 0), max(parts_at_once, 1)
    try:
        with _Pool(spark, step) as pool:
            for start in range(0, len(named), step):
                group = _Group(store, run_id, dict(named[start:start + step]), width)
                failures = _one_group(
                    group, batches, unfinished, held, answers, max_retries, wait, earlier, index, pool
                )
                for part in group.parts.values():
                    if part in failures:
                        raise failures[part]
                    parts.append(part)
                    if on_progress is not None:
                        so_far = _tell(on_progress, Run(store, run_id, total, (part,)), so_far)
    finally:
        delete_path(spark, store.path("staged", run_id))
    return Run(store, run_id, total, tuple(parts))


class _Pool(ThreadPoolExecutor):
    """Threads for steps that go on together; one that fails does not stop the others."""

    def __init__(self, spark: SparkSession, threads: int) -> None:
        super().__init__(threads)
        self.inherit = inheritable_thread_target(spark)

    def __call__(self, steps: dict[str, Callable[[], object]]) -> dict[str, BaseException]:
        """Run some steps by name; returns what ended those that failed."""
        started = {
            name: self.submit(copy_context().run, self.inherit(step)) for name, step in steps.items()
        }
        return {name: e for name, done in started.items() if (e := done.exception()) is not None}


def _one_group(
    group: _Group, batches: DataFrame, unfinished: DataFrame, held: dict[int, int],
    answers: Answers, max_retries: int, wait: Callable[[float], None], earlier: Counter,
    index: bool, pool: _Pool,
) -> dict[str, BaseException]:
    """Ask and commit some parts. Those that fail leave the others alone and are returned."""
    store, run_id, (first, *_, last) = group.store, group.run_id, (*group.parts, *group.parts)
    mine = _waves(batches, group.width, first, last)
    todo = unfinished.where(F.col("wave").between(first, last)).select(
        "batch_idx", group.part().alias(PART)
    )
    attempts, failures = _rounds(
        mine, todo, {part: held[wave] for wave, part in group.parts.items()}, answers, group,
        max_retries, wait, earlier, pool,
    )
    sound = {wave: part for wave, part in group.parts.items() if part not in failures}
    if sound:
        group = replace(group, parts=sound)
        judged = _read_parts(store, "answers", run_id, attempts, _ANSWER)
        staged = _stage(mine, judged, write_table(failed_batches(judged), "failed"), group, pool)
    for part in sound.values():
        try:
            _commit(mine, staged, None, store, run_id, part)
        except BaseException as e:
            failures[part] = e
    if index:
        committed = [part for part in sound.values() if part not in failures]
        failures |= pool({part: partial(index_part, store, run_id, part) for part in committed})
    return failures


def _tell(on_progress: Progress, run: Run, so_far: tuple[int, int, int]) -> tuple[int, int, int]:
    """Call the listener once per batch of a committed part, in order."""
    handled, valid, errors = so_far
    for row in run.tallies.orderBy("batch_idx").toLocalIterator():
        handled, valid, errors = handled + 1, valid + row["n_valid"], errors + row["n_errors"]
        try:
            on_progress(handled, run.total_batches, valid, errors)
        except Exception:  # noqa: BLE001 - a failing listener does not stop the run
            logging.getLogger(__name__).exception("on_progress failed")
    return handled, valid, errors


def _free_names(taken: set[str]) -> Iterator[str]:
    """Names of parts that are not committed, in order."""
    return (name for name in map(_part_name, count()) if name not in taken)


def _part_name(n: int) -> str:
    return f"{n:06d}"


def _judge(raw: DataFrame, group: _Group, names: dict[str, str]) -> DataFrame:
    return group.write(parse_answers(raw).drop("raw", "error"), "answers", names)


def _recover(batches: DataFrame, store: Store, run_id: str) -> list[str]:
    """Commit the answers that a crashed call had written; returns the parts, if any.

    As many parts as were at work can have answers without being committed.
    """
    done = set(store.committed("checkpoint", run_id))
    _unseal(store, run_id, done)
    asked = [p for p in store.committed("responses", run_id) if p.split(".")[0] not in done]
    judged_parts = store.committed("answers", run_id)
    for name in asked:
        if name not in judged_parts:
            part = name.split(".")[0]
            raw = _read_parts(store, "responses", run_id, [name], _RESPONSE)
            _judge(raw, _Group(store, run_id, {0: part}, 1), {part: name})
    nothing = store.spark.createDataFrame([], "batch_idx bigint, type string, error string")
    found = []
    for part in sorted({p.split(".")[0] for p in asked}):
        rounds = [p for p in asked if p.startswith(f"{part}.")]
        judged = _read_parts(store, "answers", run_id, rounds, _ANSWER)
        if judged.where(F.col("kind") == OK).limit(1).count() > 0:
            _commit(batches, judged, nothing, store, run_id, part)
            found.append(part)
    return found


def _unseal(store: Store, run_id: str, done: set[str]) -> None:
    """Make rounds of what a crashed call had sealed in those that it did not end."""
    written, base = store.committed("responses", run_id), store.path("seals", run_id)
    for name in list_names(store.spark, base):
        if name.split(".")[0] not in done and name not in written:
            rows = sealed(store.spark, f"{base}/{name}", "batch_idx bigint, raw string, error string", ["batch_idx"])
            # Asked once for this round; which attempt it was follows from the rounds before.
            attempt = F.lit(int(name.split(".")[1])).alias("attempt")
            write_table(
                rows.select("batch_idx", attempt, "raw", "error"), "responses",
                f"{store.path('responses', run_id)}/{name}",
            )
        delete_path(store.spark, f"{base}/{name}")


@dataclass(frozen=True)
class _Staged:
    """Tables of a group, ready to be committed part by part."""

    group: _Group
    checked: DataFrame


def _stage(
    batches: DataFrame, judged: DataFrame, failed: DataFrame, group: _Group,
    pool: _Pool | None = None,
) -> _Staged:
    """Validate the accepted answers of a group and write what its parts store."""
    # An accepted batch is never asked again, so there is one row per batch here.
    accepted = judged.where(F.col("kind") == OK)
    slim = places_and_ids(batches)
    checked = group.write(check_batches(accepted, slim), "checked")
    results = valid_analyses(with_origins(checked, batches))
    tallies = batch_tallies(checked, failed)
    if group.alone:
        (part,) = group.parts.values()
        save_results(results, group.store, group.run_id, part)
        tallies = group.write(tallies, "tallies")
        save_errors(
            all_errors(checked, small_side(failed), slim), group.store, group.run_id, part,
            any_errors=tallies.where(F.col("n_errors") > 0).limit(1).count() > 0,
        )
        return _Staged(group, checked)

    def errors() -> None:
        found = all_errors(checked, small_side(failed), slim)
        save_errors(group.told(found, "errors"), group.store, group.run_id, None)

    # Tables of a few numbers a batch get one file a part.
    failures = pool({
        "results": lambda: save_results(group.told(results, "results"), group.store, group.run_id, None),
        "tallies": lambda: group.write(tallies.repartition(group.part()), "tallies"),
        "errors": errors,
        "checkpoint": lambda: group.write(_completion(checked).repartition(group.part()), "checkpoint"),
    })
    for e in failures.values():
        raise e
    return _Staged(group, checked)


def _completion(checked: DataFrame) -> DataFrame:
    return checked.select("batch_idx", F.current_timestamp().alias("committed_at"))


def _commit(
    batches: DataFrame, judged: DataFrame | _Staged, failed: DataFrame | None, store: Store,
    run_id: str, part: str,
) -> None:
    """Store a part; the checkpoint comes last. `judged` may have been staged with other parts."""
    if not isinstance(judged, _Staged):
        judged = _stage(batches, judged, failed, _Group(store, run_id, {0: part}, 1))
    if judged.group.alone:
        judged.group.write(_completion(judged.checked), "checkpoint")
        return
    for kind in ("checked", "results", "tallies", "errors", "checkpoint"):
        store.put(kind, run_id, part, empty=kind != "errors")


def run_errors(store: Store, run_id: str) -> DataFrame:
    """Errors of a run that still hold: no failures of batches that are done by now."""
    return load_errors(store, run_id, ERROR, _completed(store, run_id))


def release_run(store: Store, run_id: str) -> None:
    """Give up resuming a run: its input, raw and judged answers and its table go."""
    store.spark.sql(f"DROP TABLE IF EXISTS {_Batches(store, run_id).name}")
    store.release(run_id)
