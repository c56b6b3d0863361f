"""Where runs keep their data, and how results are written and read back."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from voxlake.schemas import ANALYSIS, REPORT, REQUIRED_FIELDS, SENTIMENTS, SUMMARY_MAX
from voxlake.session import list_names, matching_paths, path_exists

STORED = T.StructType(ANALYSIS.fields + [
    T.StructField("batch_idx", T.LongType()), T.StructField("pos", T.LongType()),
])


# What a run keeps to go on after a crash.
PAID = (
    "batches", "seals", "responses", "answers", "checked", "staged", "harmonization", "synthesis",
)
# Column that tells the parts of staged rows apart.
PART = "part"


def run_id_now() -> Column:
    """A run id: the time of the query, down to the second."""
    return F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")


def new_run_id(spark: SparkSession) -> str:
    return spark.range(1).select(run_id_now().alias("t")).first()["t"]


@dataclass(frozen=True)
class Store:
    """A folder that all executors see, laid out by kind and run.

    Results and enriched rows are kept in columns, so that counting sentiments does
    not read texts; `results_format="json"` writes JSON Lines instead.
    """

    spark: SparkSession
    root: str
    results_format: str = "parquet"

    def __post_init__(self) -> None:
        if self.results_format not in ("json", "parquet"):
            raise ValueError(f"unknown results format {self.results_format!r}")

    def save_rows(self, rows: DataFrame, path: str, by: str | None = None) -> str:
        """Write results or enriched rows, replacing what is there; `by` as in `write_table`."""
        if self.results_format == "json":
            return save_json(rows, path, by)
        writer = rows.write.mode("overwrite")
        (writer if by is None else writer.partitionBy(by)).parquet(path)
        return path

    def read_rows(self, path: str | list[str]) -> DataFrame:
        """Read rows back. Parquet holds only checked rows and is read by column."""
        if self.results_format == "json":
            return read_json_results(self.spark, path)
        paths = [path] if isinstance(path, str) else path
        return self.spark.read.schema(STORED).option("recursiveFileLookup", True).parquet(*paths)

    def path(self, kind: str, run_id: str) -> str:
        return f"{self.root.rstrip('/')}/{kind}_{run_id}"

    def staged(self, kind: str, run_id: str) -> str:
        """Where tables of several parts are written before each part gets its own folder."""
        return f"{self.path('staged', run_id)}/{kind}"

    def put(
        self, kind: str, run_id: str, part: str, name: str | None = None, empty: bool = True
    ) -> None:
        """Give what was staged for a part its place, marked as written to the end.

        What is there is replaced. Without rows the place is an empty folder, or none
        unless `empty`.
        """
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        staged = hadoop(f"{self.staged(kind, run_id)}/{PART}={part}")
        target = hadoop(f"{self.path(kind, run_id)}/{name or part}")
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(target, True)
        if not empty and not fs.exists(staged):
            return
        fs.create(hadoop(staged, "_SUCCESS")).close()
        fs.mkdirs(target.getParent())
        if not fs.rename(staged, target):
            raise OSError(f"{staged.toString()} could not be moved to {target.toString()}")

    def exists(self, kind: str, run_id: str) -> bool:
        return path_exists(self.spark, self.path(kind, run_id))

    def committed(self, kind: str, run_id: str) -> list[str]:
        """Parts of a kind that were written to the end."""
        marks = matching_paths(self.spark, f"{self.path(kind, run_id)}/*/_SUCCESS")
        return [m.split("/")[-2] for m in marks]

    def release(self, run_id: str, kinds: Sequence[str] = PAID) -> None:
        """Delete what a finished run only needs to resume: input, answers, judgements.

        Results, errors, tallies, checkpoint and reports stay; the run cannot replay
        failed batches afterwards.
        """
        for kind in kinds:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(kind, run_id))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def runs(self) -> DataFrame:
        """Ids of the runs with results, newest name first."""
        names = [re.fullmatch(r"results_(.+)", n) for n in list_names(self.spark, self.root)]
        ids = sorted((m.group(1) for m in names if m), reverse=True)
        return self.spark.createDataFrame([(i,) for i in ids], "run_id string").orderBy(
            F.desc("run_id")
        )


def save_json(df: DataFrame, path: str, by: str | None = None) -> str:
    """JSON Lines, replacing what is there; nulls are written out."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", False)
    (writer if by is None else writer.partitionBy(by)).json(path)
    return path


def save_results(analyses: DataFrame, store: Store, run_id: str, part: str | None = "all") -> str:
    """Write results of a run, or of one part of it; writing again replaces them.

    With None the rows tell their part and are staged.
    """
    if part is None:
        return store.save_rows(analyses, store.staged("results", run_id), PART)
    return store.save_rows(analyses, f"{store.path('results', run_id)}/{part}")


def save_runs(analyses: DataFrame, store: Store, run: str) -> None:
    """Write the results of many runs at once; column `run` names the run of a row.

    One write, partitioned by run; the folders are then moved to their places.
    """
    spark = store.spark
    base = f"{store.root.rstrip('/')}/_runs-{uuid.uuid4().hex}"
    writer = analyses.write.partitionBy(run)
    if store.results_format == "json":
        writer.option("ignoreNullFields", False).json(base)
    else:
        writer.parquet(base)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(base).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in list_names(spark, base):
        if not name.startswith(f"{run}="):
            continue
        target = hadoop(store.path("results", unquote(name.split("=", 1)[1])) + "/all")
        fs.delete(target, True)
        fs.mkdirs(target.getParent())
        fs.rename(hadoop(f"{base}/{name}"), target)
    fs.delete(hadoop(base), True)


def save_errors(
    errors: DataFrame, store: Store, run_id: str, part: str | None = "all",
    any_errors: bool | None = None,
) -> str | None:
    """Write errors, only when there are any or older ones have to be replaced.

    `any_errors` spares the look when the caller knows. With None the rows tell their part
    and are staged.
    """
    if part is None:
        return save_json(errors, store.staged("errors", run_id), PART)
    path = f"{store.path('errors', run_id)}/{part}"
    if any_errors is None:
        any_errors = errors.limit(1).count() > 0
    if not any_errors and not path_exists(store.spark, path):
        return None
    return save_json(errors, path)


def read_json_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Read results from JSON Lines of any origin.

    Blank lines are skipped; a line that is no JSON or breaks the contract fails
    the job, whichever columns are used.
    """
    rows = (
        spark.read.schema(STORED).options(mode="FAILFAST", recursiveFileLookup=True).json(path)
    )
    sound = F.col("sentiment").isin(SENTIMENTS) & (F.length("summary") <= SUMMARY_MAX)
    for name in REQUIRED_FIELDS:
        sound = sound & F.col(name).isNotNull()
    message = F.concat(F.lit("invalid stored result: "), F.coalesce("verbatim_id", F.lit("?")))
    return rows.where(
        F.when(F.coalesce(sound, F.lit(False)), F.lit(True))
        .otherwise(F.raise_error(message).cast("boolean"))
    )


def load_results(store: Store, run_id: str) -> DataFrame:
    """All results of a run, every part written to the end."""
    base = store.path("results", run_id)
    if not path_exists(store.spark, base):
        raise FileNotFoundError(base)
    return store.read_rows(base)


def load_errors(
    store: Store, run_id: str, schema: T.StructType, completed: DataFrame | None = None
) -> DataFrame:
    """Stored errors of a run that still hold.

    A batch that failed counts with its last failure only, and not at all once it is
    among the `completed` ones (batch_idx). Errors of items and of answered batches
    stay.
    """
    spark, base = store.spark, store.path("errors", run_id)
    if not path_exists(spark, base):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).json(base)
    failure = F.col("type").isin("batch_failure", "unexpected_error")
    part = F.regexp_extract(F.col("_metadata.file_path"), r"([0-9]+)/[^/]*$", 1).cast("bigint")
    failed = rows.where(failure).withColumn("_part", part)
    last = failed.groupBy("batch_idx").agg(F.max("_part").alias("_part"))
    if completed is not None:
        last = last.join(completed.select("batch_idx"), "batch_idx", "left_anti")
    names = schema.fieldNames()
    return rows.where(~failure).unionByName(
        failed.join(last, ["batch_idx", "_part"]).select(*names)
    )


def load_report(
    store: Store, run_id: str
) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """The stored report, enriched rows and mapping of a run, None where not written yet."""
    report = enriched = mapping = None
    if store.exists("quantification_report", run_id):
        report = store.spark.read.schema(REPORT).json(store.path("quantification_report", run_id))
    if store.exists("enriched_results", run_id):
        enriched = store.read_rows(store.path("enriched_results", run_id))
    if store.exists("mapping", run_id):
        mapping = store.spark.read.schema("theme string, macro_theme string").parquet(
            store.path("mapping", run_id)
        )
    return report, enriched, mapping
