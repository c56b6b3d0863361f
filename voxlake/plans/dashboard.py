"""The rows behind a results dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame

from voxlake.operators.dashboard import backfill, ordered_columns
from voxlake.plans.store import Store, load_report, load_results
from voxlake.sources.metadata import scan_raw_files


def dashboard_rows(store: Store, run_id: str, raw_folder: str | None = None) -> DataFrame:
    """Rows of a run in display order: the enriched ones when there are any.

    With `raw_folder`, missing texts and sources are looked up in its CSV files.
    """
    enriched = load_report(store, run_id)[1]
    rows = load_results(store, run_id) if enriched is None else enriched
    if raw_folder is not None:
        rows = backfill(rows, scan_raw_files(store.spark, raw_folder))
    return ordered_columns(rows)
