"""From stored results to macro themes, report and syntheses, all stored by run."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from voxlake.operators.harmonize import (
    THEMES_PER_CALL, Harmonization, apply_mapping, harmonize, unique_themes,
)
from voxlake.operators.inference import Answers
from voxlake.operators.quantify import (
    macro_tallies, report_document, report_lines, theme_distribution, theme_tallies,
)
from voxlake.operators.synthesis import (
    LINES_PER_CALL, attach_syntheses, synthesize,
)
from voxlake.plans.search import index_part
from voxlake.plans.store import Store, load_report, load_results, save_json
from voxlake.schemas import MAX_CATEGORIES
from voxlake.session import write_table


@dataclass(frozen=True)
class Quantification:
    harmonization: Harmonization
    distribution: DataFrame
    report: DataFrame
    enriched: DataFrame

    @property
    def lines(self) -> DataFrame:
        return report_lines(self.distribution)


def quantify_run(
    store: Store,
    run_id: str,
    answers: Answers,
    max_categories: int = MAX_CATEGORIES,
    fallback: str = "first",
    themes_per_call: int = THEMES_PER_CALL,
    wait: Callable[[float], None] = time.sleep,
    index: bool = False,
) -> Quantification | None:
    """Harmonise, count and store `enriched_results` and `quantification_report`.

    The mapping is stored as a table next to them; `index` adds a search index of
    the enriched rows. None when the run has no results.
    """
    if store.exists("meta", run_id) and not store.exists("results", run_id):
        return None  # a run without a single batch
    analyses = load_results(store, run_id)
    # One pass over the rows; themes, counts and distribution all follow from it.
    tallies = write_table(theme_tallies(analyses), "tallies")
    if tallies.limit(1).count() == 0:
        return None
    found = harmonize(
        unique_themes(tallies), answers, max_categories, fallback, themes_per_call,
        wait=wait, at=store.path("harmonization", run_id),
    )
    mapping = write_table(found.mapping, "mapping", store.path("mapping", run_id))
    categories = write_table(found.categories, "categories", store.path("categories", run_id))
    distribution = write_table(
        theme_distribution(macro_tallies(tallies, mapping), categories), "distribution"
    )
    enriched_path = store.save_rows(
        apply_mapping(analyses, mapping), store.path("enriched_results", run_id)
    )
    if index:
        index_part(store, run_id, kind="enriched_results")
    report = report_document(distribution, store.path("results", run_id))
    save_json(report.coalesce(1), store.path("quantification_report", run_id))
    return Quantification(
        Harmonization(categories, mapping), distribution,
        load_report(store, run_id)[0], store.read_rows(enriched_path),
    )


def synthesize_run(
    store: Store,
    run_id: str,
    answers: Answers,
    lines_per_call: int = LINES_PER_CALL,
    wait: Callable[[float], None] = time.sleep,
) -> tuple[DataFrame, DataFrame]:
    """Synthesise every macro theme of a quantified run and put them into its report.

    Returns (syntheses, failures).
    """
    enriched = write_table(
        store.read_rows(store.path("enriched_results", run_id))
        .select("macro_theme", "batch_idx", "pos", "sentiment", "summary"),
        "enriched",
    )
    categories = store.spark.read.parquet(store.path("categories", run_id)).select(
        F.col("category").alias("macro_theme")
    ).unionByName(enriched.select("macro_theme")).distinct()
    done, failures = synthesize(
        categories, enriched, answers, lines_per_call, wait=wait, at=store.path("synthesis", run_id)
    )
    done = write_table(done, "syntheses", store.path("syntheses", run_id))
    report = load_report(store, run_id)[0]
    # The report is one row; its replacement is written elsewhere before it takes its place.
    renewed = write_table(attach_syntheses(report, done), "report")
    save_json(renewed.coalesce(1), store.path("quantification_report", run_id))
    return done, failures
