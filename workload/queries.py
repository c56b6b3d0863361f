"""The registered queries: one per operator, each over the whole given tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxlake.functions.numbers import int_div
from voxlake.functions.strict_json import with_strict_json
from voxlake.operators import (
    batching, dashboard, harmonize, normalize, quantify, responses, synthesis, validation,
)
from voxlake.operators.inference import answer_with
from voxlake.operators.positions import land_positions
from voxlake.plans import search
from voxlake.plans.analysis import PAGE_BATCHES, Run, checkpoint, pending_batches, run_analysis, run_errors
from voxlake.plans.quantification import Quantification, quantify_run, synthesize_run
from voxlake.plans.store import (
    Store, load_report, load_results, run_id_now, save_results, save_runs,
)
from voxlake.session import list_names, move_file, new_path, prepare, write_table
from voxlake.sources import columns, datasets, metadata
from voxlake.sources.readers import from_dataframe, load_csv, load_jsonl
from voxlake.streaming import incremental
from workload import frames as fx, transports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LINES_PER_CALL = 100
SEARCH_TERM = "Theme EN 2"
INDEXED_TERM = "DOC_77"
KPI_SOURCES = ["src0", "src3", "src7"]
EXPLORER = {
    "sources": ["src1", "src2", "src5"],
    "macro_themes": ["Produit", "Service"],
    "sentiments": ["positif", "négatif"],
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def no_wait(seconds: float) -> None:
    """Prepared answers need no pause between rounds."""


# --- shared steps ------------------------------------------------------------------


def _verbatims(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    named = docs.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"),
        "text", "source", "lang",
    )
    return normalize.kept(from_dataframe(named, "text", "id"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judged answers, written: choosing among attempts reads them twice."""
    judged = responses.parse_answers(fx.responses(spark, sf_dir)).drop("raw", "error")
    return write_table(judged, "judged")


def _checked(
    spark: SparkSession, sf_dir: str, carry: Sequence[str] = ()
) -> DataFrame:
    """Judged answers; texts travel along only where a query returns them."""
    accepted = responses.first_accepted(_parsed(spark, sf_dir))
    return validation.check_batches(accepted, fx.sent_batches(spark, sf_dir, carry))


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Checked batches, failed batches and sent batches from answers read once."""
    parsed = _parsed(spark, sf_dir)
    batches = fx.sent_batches(spark, sf_dir, carry=())
    checked = validation.check_batches(responses.first_accepted(parsed), batches)
    return checked, responses.failed_batches(parsed), batches


def _mapped(spark: SparkSession, sf_dir: str, fallback: str = "first") -> harmonize.Harmonization:
    themes = write_table(fx.ideal_analyses(spark, sf_dir).select("theme").distinct(), "themes")
    return harmonize.with_fallback(
        themes, fx.category_rows(spark), fx.mapping_rows(themes), fallback
    )


def _distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _mapped(spark, sf_dir)
    tallies = quantify.theme_tallies(fx.ideal_analyses(spark, sf_dir))
    macros = quantify.macro_tallies(tallies, found.mapping)
    return quantify.theme_distribution(macros, found.categories)


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonize.apply_mapping(
        fx.ideal_analyses(spark, sf_dir), _mapped(spark, sf_dir).mapping
    )


def _store(spark: SparkSession) -> Store:
    return Store(spark, new_path(spark, "store"))


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The responses, written in order and in short pages: each part of a run reads its own."""
    order = ["attempt", "batch_idx"]
    responses = write_table(fx.responses(spark, sf_dir), "unordered")
    ordered = responses.repartitionByRange(*order).sortWithinPartitions(*order)
    path = new_path(spark, "responses")
    ordered.write.option("parquet.page.row.count.limit", PAGE_BATCHES).parquet(path)
    return spark.read.schema(responses.schema).parquet(path)


def _run(spark: SparkSession, sf_dir: str) -> Run:
    prepared = _prepared(spark, sf_dir)
    return run_analysis(
        _verbatims(spark, sf_dir), transports.from_responses(prepared), _store(spark), "run",
        wait=no_wait,
    )


# --- the flagship ------------------------------------------------------------------


@query
def sentiment_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest, batch, read answers, validate, enrich; then the split per source."""
    batched = batching.assign_batches(_verbatims(spark, sf_dir))
    batches = batching.group_batches(batched, carry=["source"])
    accepted = responses.first_accepted(_parsed(spark, sf_dir))
    valid = validation.valid_analyses(validation.check_batches(accepted, batches))
    names = quantify.COUNT_COLUMNS.items()
    return valid.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("sentiment") == s).alias(c) for s, c in names],
    )


# --- sources -----------------------------------------------------------------------


@query
def normalize_verbatims(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = fx.dirty_documents(spark, sf_dir)
    return normalize.kept(from_dataframe(dirty, "text", source="documents")).drop("position")


@query
def detect_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected column per role, with the number of values it holds."""
    docs = fx.table(spark, sf_dir, "documents")
    upload = columns.detect_upload_roles(docs.columns)
    roles = {**columns.detect_roles(docs.columns),
             "upload_text": upload["text"], "upload_id": upload["id"]}
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    counted = flat.agg(*[
        (F.lit(0).cast("bigint") if i is None else F.count(f"c{i}")).alias(role)
        for role, i in roles.items()
    ])
    return counted.select(F.explode(F.array(*[
        F.struct(
            F.lit(role).alias("role"),
            F.lit(None if i is None else docs.columns[i]).cast("string").alias("column_name"),
            F.col(role).alias("n_values"),
        )
        for role, i in roles.items()
    ])).alias("r")).select("r.*")


@query
def row_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the table, counted before blank rows are dropped."""
    dirty = fx.dirty_documents(spark, sf_dir)
    half = dirty.count() // 2
    return normalize.kept(
        from_dataframe(dirty, "text", source="documents", limit=half)
    ).select("id")


@query
def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.ingest_counts(
        from_dataframe(fx.dirty_documents(spark, sf_dir), "text", source="documents")
    )


@query
def raw_metadata_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.latest_metadata(fx.raw_files(spark, sf_dir))


@query
def normalize_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.normalize_dataset(
        fx.table(spark, sf_dir, "conversations"), "text", "conv", "conversations", "en"
    )


@query
def longest_text_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.longest_text_column(fx.table(spark, sf_dir, "pages"))


@query
def synthetic_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated languages in proportion to all English documents; four fifths taken."""
    docs = fx.table(spark, sf_dir, "documents").where(F.col("lang") == "en").select("text")
    english = land_positions(docs)
    n = english.count()
    return datasets.multilingual_reviews(english, n, size=4 * n)


@query
def value_counts_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.value_counts(fx.table(spark, sf_dir, "documents"), "lang")


@query
def value_counts_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.value_counts(fx.table(spark, sf_dir, "documents"), "source")


# --- batches and answers -------------------------------------------------------------


@query
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = fx.dirty_documents(spark, sf_dir)
    kept = normalize.kept(from_dataframe(dirty, "text", source="documents"))
    return batching.assign_batches(kept).select("id", "batch_idx", "pos_in_batch")


@query
def batch_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.batch_lines(
        batching.group_batches(batching.assign_batches(_verbatims(spark, sf_dir)))
    )


@query
def infer_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = batching.build_prompts(
        batching.group_batches(batching.assign_batches(_verbatims(spark, sf_dir)))
    )
    answered = write_table(answer_with(transports.counting())(prompts, 0), "answered")
    return answered.select("batch_idx", F.lit(0).alias("attempt"), "raw")


@query
def first_valid_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.first_accepted(_parsed(spark, sf_dir)).select("batch_idx", "attempt")


@query
def attempt_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).where("kind <> 'ok'").select(
        "batch_idx", "attempt", "kind", "last_error"
    )


@query
def extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return with_strict_json(fx.responses(spark, sf_dir), "raw", "json").select(
        "batch_idx", "attempt", F.col("json").isNotNull().alias("ok")
    )


@query
def flatten_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.flatten_analyses(
        responses.first_accepted(_parsed(spark, sf_dir))
    ).select("batch_idx", "pos", "verbatim_id", "theme", "summary", "sentiment")


# --- validation ----------------------------------------------------------------------


def _issue_rows(spark: SparkSession, sf_dir: str, wanted: Callable[[Column], Column]) -> DataFrame:
    items = validation.judged_items(_checked(spark, sf_dir))
    return items.select(
        "batch_idx", "pos", F.col("data.verbatim_id").alias("verbatim_id"),
        F.explode(F.filter("issues", wanted)).alias("issue"),
    )


@query
def count_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).where("expected <> got").select("batch_idx", "expected", "got")


@query
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issue_rows(spark, sf_dir, lambda x: F.startswith(x, F.lit("ID dupliqué"))).drop("issue")


@query
def unknown_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issue_rows(spark, sf_dir, lambda x: F.startswith(x, F.lit("ID inconnu"))).drop("issue")


@query
def theme_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issue_rows(
        spark, sf_dir, lambda x: F.startswith(x, F.lit("Thème"))
    ).drop("verbatim_id")


@query
def summary_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issue_rows(
        spark, sf_dir, lambda x: F.startswith(x, F.lit("Résumé"))
    ).drop("verbatim_id")


@query
def item_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.judged_items(_checked(spark, sf_dir)).where(F.size("issues") > 0).select(
        "batch_idx", "pos", F.size("issues").alias("n_issues")
    )


@query
def valid_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.valid_analyses(_checked(spark, sf_dir, ("text", "source"))).select(
        "verbatim_id", "theme", "summary", "sentiment", "texte_original", "source"
    )


@query
def missing_verbatims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).where(F.size("missing_ids") > 0).select(
        "batch_idx", F.size("missing_ids").alias("n_missing"),
        F.array_join("missing_ids", ",").alias("missing_ids"),
    )


@query
def batch_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = responses.failed_batches(_parsed(spark, sf_dir))
    return validation.failure_errors(failed, fx.sent_batches(spark, sf_dir, carry=())).select(
        "batch_idx", "type", F.size("verbatim_ids").alias("n_items"), "error"
    )


@query
def errors_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.all_errors(*_judged(spark, sf_dir)).groupBy("type").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked, failed, _ = _judged(spark, sf_dir)
    tallies = write_table(validation.batch_tallies(checked, failed), "tallies")
    return validation.batch_progress(tallies, tallies.count()).select(
        "batch_idx", "batch_no", "total_batches", "cum_valid", "cum_errors"
    )


@query
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked, failed, _ = _judged(spark, sf_dir)
    return validation.run_totals(validation.batch_tallies(checked, failed))


# --- runs, storage, resume -------------------------------------------------------------


@query
def analysis_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole stored run with retry rounds; what it saved is read back."""
    return _run(spark, sf_dir).valid.select(
        "verbatim_id", "theme", "summary", "sentiment", "texte_original", "source"
    )


@query
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call with a single attempt, one resuming with two more; what stays open."""
    prepared = _prepared(spark, sf_dir)
    verbatims, store = _verbatims(spark, sf_dir), _store(spark)
    for given, first, retries in ((verbatims, 0, 0), (None, 1, 1)):
        run_analysis(
            given, transports.from_responses(prepared, first), store, "run",
            max_retries=retries, wait=no_wait,
        )
    return pending_batches(store, "run")


@query
def list_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored run per language of the documents, then the list of runs."""
    analyses = write_table(
        fx.ideal(spark, sf_dir).select(
            "lang", F.col("id").alias("verbatim_id"), "theme", "summary", "sentiment"
        ),
        "analyses",
    )
    store = _store(spark)
    save_runs(
        analyses.withColumn("run", F.concat(F.lit("run_"), "lang")).drop("lang"), store, "run"
    )
    return store.runs()


# --- themes and counts -----------------------------------------------------------------


@query
def unique_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonize.unique_themes(fx.ideal_analyses(spark, sf_dir))


def _harmonized(
    spark: SparkSession, sf_dir: str, fallback: str, per_call: int = harmonize.THEMES_PER_CALL
) -> DataFrame:
    found = harmonize.harmonize(
        harmonize.unique_themes(fx.ideal_analyses(spark, sf_dir)),
        answer_with(transports.echo_harmonizer(fx.CATEGORIES)), fallback=fallback,
        themes_per_call=per_call, wait=no_wait,
    )
    return found.mapping.select("theme", "macro_theme")


@query
def theme_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _harmonized(spark, sf_dir, "first")


@query
def theme_mapping_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over several calls and a merge."""
    return _harmonized(spark, sf_dir, "first", per_call=20)


@query
def theme_mapping_autre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _harmonized(spark, sf_dir, "autre")


@query
def apply_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir).select("verbatim_id", "macro_theme")


@query
def global_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantify.global_sentiment(fx.ideal_analyses(spark, sf_dir))


@query
def theme_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distribution(spark, sf_dir).select(
        "macro_theme", "total", "positif", "negatif", "neutre"
    )


@query
def theme_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantify.rank_by_volume(_distribution(spark, sf_dir))


@query
def sentiment_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantify.sentiment_shares(_distribution(spark, sf_dir))


@query
def category_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantify.category_shares(_distribution(spark, sf_dir))


@query
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantify.report_lines(write_table(_distribution(spark, sf_dir), "distribution"))


@query
def report_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report row, unpacked into comparable columns."""
    found = _mapped(spark, sf_dir)
    mapping = write_table(found.mapping, "mapping")
    tallies = quantify.theme_tallies(fx.ideal_analyses(spark, sf_dir))
    macros = quantify.macro_tallies(tallies, mapping)
    doc = quantify.report_document(
        quantify.theme_distribution(macros, found.categories), "results_run"
    )
    mapped = mapping.agg(F.count(F.lit(1)).cast("int").alias("n_mapped"))
    return quantify.one_row(doc.select(
        "metadata.source_file", "metadata.total_verbatims",
        *[F.col("global_sentiment")[s].alias(c) for s, c in quantify.COUNT_COLUMNS.items()],
        F.size("theme_distribution").alias("n_macro_themes"),
        F.col("theme_distribution")["Autre"]["total"].alias("n_autre"),
    ), mapped)


# --- dashboard -------------------------------------------------------------------------


@query
def backfill_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.backfill(
        fx.stored_results(spark, sf_dir), fx.raw_files(spark, sf_dir)
    ).select("verbatim_id", "texte_original", "source")


@query
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.distinct_values(fx.ideal_analyses(spark, sf_dir), "source")


@query
def source_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.kpis(fx.ideal_analyses(spark, sf_dir), KPI_SOURCES)


@query
def sentiment_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.sentiment_split(fx.ideal_analyses(spark, sf_dir), KPI_SOURCES)


@query
def theme_sentiment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.theme_sentiment_counts(_enriched(spark, sf_dir), KPI_SOURCES)


@query
def explorer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.explore(_enriched(spark, sf_dir), **EXPLORER)


@query
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.text_search(dashboard.explore(_enriched(spark, sf_dir)), SEARCH_TERM)


@query
def text_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rarer term in stored rows, through the search index of two commits."""
    store, enriched = _store(spark), write_table(_enriched(spark, sf_dir), "enriched")
    for part in (0, 1):
        rows = enriched.where(F.col("batch_idx") % 2 == part).repartitionByRange("batch_idx", "pos")
        save_results(rows, store, "run", f"{part:06d}")
        search.index_part(store, "run", f"{part:06d}")
    return search.search_run(store, "run", INDEXED_TERM).rows


# --- synthesis and streaming -------------------------------------------------------------


def _for_synthesis(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    enriched = write_table(
        _enriched(spark, sf_dir).select("macro_theme", "batch_idx", "pos", "sentiment", "summary"),
        "enriched",
    )
    categories = fx.category_rows(spark).select(F.col("category").alias("macro_theme")).unionByName(
        enriched.select("macro_theme")
    ).distinct()
    return categories, enriched


@query
def synthesis_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.category_reviews(*_for_synthesis(spark, sf_dir), LINES_PER_CALL)


@query
def synthesis_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, _ = synthesis.synthesize(
        *_for_synthesis(spark, sf_dir),
        answer_with(transports.echo_synthesizer("Hors liste")),
        lines_per_call=LINES_PER_CALL, parts_per_merge=4, wait=no_wait,
    )
    return synthesis.synthesis_points(done)


def _quantified(spark: SparkSession, sf_dir: str) -> tuple[Store, Quantification]:
    """Stored results, harmonised, counted and stored again."""
    store = _store(spark)
    save_results(fx.ideal_analyses(spark, sf_dir), store, "run")
    answers = answer_with(transports.echo_harmonizer(fx.CATEGORIES))
    return store, quantify_run(store, "run", answers, wait=no_wait)


@query
def enriched_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rows of a quantified run, read back."""
    store, _ = _quantified(spark, sf_dir)
    enriched = load_report(store, "run")[1]
    return enriched.select("verbatim_id", "theme", "macro_theme", "sentiment", "source")


@query
def stored_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored report with its syntheses, read back, one row per category."""
    store, _ = _quantified(spark, sf_dir)
    answers = answer_with(transports.echo_synthesizer("Hors liste"))
    synthesize_run(store, "run", answers, LINES_PER_CALL, wait=no_wait)
    report = load_report(store, "run")[0]
    return report.select(
        "syntheses", F.explode("theme_distribution").alias("category", "counts")
    ).select(
        "category", "counts.total",
        F.col("syntheses")[F.col("category")]["global_synthesis"].alias("global_synthesis"),
        F.size(F.col("syntheses")[F.col("category")]["positive_points"]).alias("n_positive"),
    )


EPOCHS = 4


def _stream_files(spark: SparkSession, sf_dir: str) -> str:
    """All documents as several files; the stream takes a quarter of them per epoch."""
    folder = new_path(spark, "stream-input")
    docs = fx.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), "text", "source", "lang"
    )
    docs.repartition(_files_of(docs, EPOCHS), "id").write.parquet(folder)
    return folder


def _streamed(spark: SparkSession, folder: str, store: Store, checkpoint: str) -> None:
    rows = incremental.read_stream(
        spark, "parquet", "id string, text string, source string, lang string", folder,
        files_per_batch=math.ceil(len([n for n in list_names(spark, folder) if n.startswith("part-")]) / EPOCHS),
    )
    incremental.analyse_stream(
        rows, answer_with(transports.echo_analyst()), store, "stream", checkpoint, "text", "id",
        wait=no_wait,
    ).awaitTermination()


@query
def streaming_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a stream of several epochs."""
    store = _store(spark)
    _streamed(spark, _stream_files(spark, sf_dir), store, new_path(spark, "stream-checkpoint"))
    return incremental.running_sentiment(store, "stream")


@query
def streaming_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stream twice, the second time without a checkpoint: epochs replace themselves."""
    store, folder = _store(spark), _stream_files(spark, sf_dir)
    for _ in range(2):
        _streamed(spark, folder, store, new_path(spark, "stream-checkpoint"))
    return incremental.stream_results(store, "stream").groupBy("sentiment").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("verbatim_id").alias("n_ids")
    )


# --- files ---------------------------------------------------------------------------------


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in id order, with quotes and line breaks, as they go to files."""
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit('said "'), "text", F.lit('",')).alias("text"), "lang", "source"
    )


DOCS_PER_FILE = 250


def _csv_files(spark: SparkSession, sf_dir: str) -> str:
    """CSV files under names of one's own, of three kinds, two of them with other headers.

    A file holds the documents of one kind among DOCS_PER_FILE ids in a row.
    """
    folder, docs = new_path(spark, "csv"), _exported(spark, sf_dir)
    k, span = F.col("doc_id"), int_div("doc_id", DOCS_PER_FILE)
    kinds = {
        "avis été": docs.where(k % 3 == 0).select(span.alias("span"), "doc_id", "text", "lang", "source"),
        "b+c": docs.where(k % 3 == 1).select(
            span.alias("span"), "source", "lang", F.col("text").alias("Review"), F.col("doc_id").alias("n")),
        "d": docs.where(k % 3 == 2).select(span.alias("span"), "text", F.col("doc_id").alias("id")),
    }
    for name, rows in kinds.items():
        part = f"{folder}-part-{len(name)}"
        order = {"avis été": "doc_id", "b+c": "n", "d": "id"}[name]
        rows.repartition("span").sortWithinPartitions("span", order).write.partitionBy("span").options(
            header=True, escape='"', quoteAll=True).csv(part)
        for made in list_names(spark, part):
            if made.startswith("span="):
                move_file(spark, f"{part}/{made}", f"{folder}/{name}_{int(made[5:]):08d}.csv")
    return folder


@query
def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of CSV files with differing headers; each file is its own default source."""
    landed = load_csv(spark, _csv_files(spark, sf_dir), source=None)
    return normalize.kept(landed).select("row_idx", "id", "text", "source", "lang", "position")


@query
def raw_metadata_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.load_raw_metadata(spark, _csv_files(spark, sf_dir))


# Text in a file of the workload's own, in bytes; a file is the work of one task.
FILE_BYTES = 64 * 1024 * 1024


def _files_of(docs: DataFrame, least: int) -> int:
    """Number of files for texts: a multiple of `least`, so that none is much beyond FILE_BYTES."""
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint")).alias("n")).first()["n"] or 0
    return least * max(1, math.ceil(size / (least * FILE_BYTES)))


def _json_files(spark: SparkSession, sf_dir: str, *names: str | Column) -> str:
    """Exported documents as JSON Lines in id order, three files or more."""
    folder, docs = new_path(spark, "jsonl"), _exported(spark, sf_dir)
    ordered = docs.repartitionByRange(_files_of(docs, 3), "doc_id").sortWithinPartitions("doc_id")
    ordered.select(*names).write.json(folder)
    return folder


@query
def jsonl_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _json_files(spark, sf_dir, F.col("doc_id").alias("id"), "text", "lang", "source")
    return normalize.kept(load_jsonl(spark, folder)).select(
        "row_idx", "id", "text", "source", "lang", "position"
    )


# --- what a run leaves behind -------------------------------------------------------------------


@query
def stored_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two calls that fail, one that succeeds where it can: errors that still hold."""
    prepared = _prepared(spark, sf_dir)
    verbatims, store = _verbatims(spark, sf_dir), _store(spark)
    for first, retries in ((0, 0), (0, 0), (1, 1)):
        run_analysis(
            verbatims, transports.from_responses(prepared, first), store, "run",
            max_retries=retries, wait=no_wait,
        )
    return run_errors(store, "run").groupBy("type", "batch_idx").agg(F.count(F.lit(1)).alias("n"))


@query
def resume_other_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run started with large splits and resumed with small ones; all it has stored."""
    folder = _json_files(spark, sf_dir, "text", "lang", "source")
    store, key = _store(spark), "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    echo = answer_with(transports.counting_analyst())
    try:
        for size, part in (("128m", lambda b: b % 2 == 0), ("64k", lambda b: b % 2 == 1)):
            spark.conf.set(key, size)
            some = transports.only(echo, part)
            run_analysis(
                normalize.kept(load_jsonl(spark, folder)), some, store, "run",
                max_retries=0, wait=no_wait,
            )
    finally:
        spark.conf.set(key, before)
    return load_results(store, "run").select("verbatim_id", "summary", "batch_idx", "pos")


@query
def checkpoint_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a run stands; the time of its last commit is a time."""
    run = _run(spark, sf_dir)
    state = checkpoint(run.store, "run")
    recent = F.col("last_update").between(F.date_sub(F.current_date(), 1), F.current_timestamp())
    return state.select("run_id", "completed_batches", "total_batches", recent.alias("recent"))


@query
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.first_results(
        validation.valid_analyses(_checked(spark, sf_dir))
    ).select("batch_idx", "pos", "verbatim_id", "summary")


@query
def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listener hears, one row per batch in order, from the tallies a run has written."""
    prepared = _prepared(spark, sf_dir)
    run = run_analysis(
        _verbatims(spark, sf_dir), transports.from_responses(prepared), _store(spark), "run",
        batches_per_commit=400, wait=no_wait,
    )
    return run.progress.select(
        F.col("batch_no").alias("handled"), F.col("total_batches").alias("total"),
        F.col("cum_valid").alias("valid"), F.col("cum_errors").alias("errors"), F.col("batch_no").alias("call"),
    )


@query
def sealed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run whose tasks are killed over some prompts, and resumed: results, and answers paid for a batch.

    What a killed task had sealed is not asked again; the rest of its prompts are.
    """
    verbatims, store = _verbatims(spark, sf_dir), _store(spark)
    try:
        run_analysis(verbatims, answer_with(transports.killing(transports.echo_analyst()), group=2), store, "run", wait=no_wait)
    except Exception:  # noqa: BLE001 - the job ends with its task
        pass
    run_analysis(None, answer_with(transports.echo_analyst(), group=2), store, "run", wait=no_wait)
    paid = spark.read.schema("batch_idx bigint").option("recursiveFileLookup", True).parquet(store.path("responses", "run"))
    paid = write_table(paid.groupBy("batch_idx").agg(F.count(F.lit(1)).alias("answers")), "paid")
    return load_results(store, "run").join(paid, "batch_idx").select("verbatim_id", "summary", "batch_idx", "answers")


@query
def run_id_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new run id for each language: a time down to the second."""
    return fx.table(spark, sf_dir, "documents").select("lang").distinct().select(
        "lang", run_id_now().rlike("^[0-9]{8}_[0-9]{6}$").alias("well_formed")
    )


@query
def empty_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are all blank: nothing is analysed and nothing quantified."""
    docs = fx.table(spark, sf_dir, "documents").withColumn("text", F.lit("  "))
    landed = from_dataframe(docs, "text")
    store, echo = _store(spark), answer_with(transports.echo_analyst())
    run = run_analysis(normalize.kept(landed), echo, store, "run", wait=no_wait)
    done = quantify_run(store, "run", answer_with(transports.echo_harmonizer([])), wait=no_wait)
    return quantify.one_row(normalize.ingest_counts(landed), run.summary).withColumn(
        "quantified", F.lit(done is not None)
    )


@query
def result_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and places of the columns that the results page shows, over all rows."""
    shown = dashboard.ordered_columns(_enriched(spark, sf_dir))
    counted = shown.agg(*[F.count(c).alias(c) for c in shown.columns])
    return counted.select(F.posexplode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in shown.columns
    ])).alias("place", "c")).select("place", "c.*")


@query
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.preview(
        fx.ideal_analyses(spark, sf_dir), order=["batch_idx", "pos"]
    ).select("verbatim_id", "texte_original")


@query
def global_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantify.global_shares(quantify.global_sentiment(fx.ideal_analyses(spark, sf_dir)))


@query
def synthetic_reviews_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows that can be made, without a cut."""
    docs = fx.table(spark, sf_dir, "documents").where(F.col("lang") == "en").select("text")
    english = land_positions(docs)
    return datasets.multilingual_reviews(english, english.count())
