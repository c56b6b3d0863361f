"""The plans have the shape that holds at scale."""

import re

import pytest
from pyspark.sql import functions as F

from voxlake.operators import dashboard, quantify
from voxlake.operators.batching import assign_batches, group_batches
from voxlake.operators.lookup import lookup
from voxlake.operators.responses import first_accepted, parse_answers
from voxlake.operators.validation import check_batches, valid_analyses
from voxlake.plans import analysis
from voxlake.session import write_table
from workload import frames as fx, queries

from conftest import SF


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def exchanges(plan):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


LAZY = [
    "sentiment_by_source", "normalize_verbatims", "raw_metadata_latest", "valid_analyses",
    "errors_by_type", "batch_progress", "theme_distribution", "report_document", "backfill_metadata",
    "explorer_filter", "text_search", "synthesis_inputs", "stored_report",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_product_of_tables(spark, name):
    plan = physical(queries.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_answers_are_parsed_once_whatever_is_filtered(spark):
    parsed = parse_answers(write_table(fx.responses(spark, SF), "raw"))
    # one parse of the whole text, one of the span between the outermost braces
    assert [optimized(p).count("parseJson") for p in (parsed, parsed.where("kind = 'ok'"))] == [2, 2]
    judged = queries._parsed(spark, SF)  # written: choosing among attempts reads it twice
    chosen = [first_accepted(judged),
              valid_analyses(check_batches(first_accepted(judged), fx.sent_batches(spark, SF)))]
    assert ["parseJson" in optimized(p) for p in chosen] == [False, False]


def test_validation_follows_the_grouping_without_another_shuffle(spark):
    raw = write_table(fx.responses(spark, SF), "raw")
    batched = write_table(assign_batches(queries._verbatims(spark, SF)), "batched")
    checked = check_batches(first_accepted(parse_answers(raw)), group_batches(batched))
    names = [re.sub(r"#\d+L?", "", e).split(",")[0] for e in exchanges(physical(valid_analyses(checked)))]
    assert names == ["batch_idx", "batch_idx"]  # one per side


def test_stored_batches_are_joined_where_they_lie(spark):
    run = queries._run(spark, SF)
    meta = spark.read.json(run.store.path("meta", "run") + "/run").first()
    batches = analysis._Batches(run.store, "run").read(meta["buckets"])
    accepted = write_table(
        spark.read.parquet(run.store.path("answers", "run") + "/*").where("kind = 'ok'"), "accepted")
    hinted = batches.where("batch_idx < 5").hint("merge")
    plan = physical(check_batches(accepted, hinted).select("batch_idx", "expected"))
    assert len(exchanges(plan)) == 1 and "Bucketed: true" in plan
    assert "LessThan(batch_idx,5)" in plan


def test_filters_and_columns_reach_the_scan(spark):
    docs = fx.table(spark, SF, "documents").withColumn("sentiment", F.lit("neutre"))
    plan = physical(dashboard.kpis(docs, ["src0", "src1"]))
    assert "In(source, [src0,src1])" in plan
    assert "ReadSchema: struct<source:string>" in plan


def test_theme_counts_are_hashed_not_sorted(spark):
    plan = physical(quantify.theme_tallies(fx.ideal_analyses(spark, SF)))
    assert "SortAggregate" not in plan and "partial_count" in plan


@pytest.mark.parametrize("name", [
    "first_valid_attempt", "batch_failures", "raw_metadata_latest", "sentiment_by_source"])
def test_choosing_among_rows_sorts_no_texts(spark, name):
    assert "SortAggregate" not in physical(queries.QUERIES[name](spark, SF))


def test_review_lines_are_not_joined(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(queries.QUERIES["synthesis_inputs"](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "LeftOuter" not in plan  # the only joins are of places and of names


def test_small_tables_are_broadcast_and_large_ones_spread(spark):
    facts = spark.range(1000).selectExpr("id", "id % 3 as k")
    table = write_table(spark.range(3).selectExpr("id as k", "id as v"), "table")
    assert "BroadcastHashJoin" in physical(lookup(facts, table, "k"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup(facts, table, "k", hot_rows=100, broadcast_rows=0)
        assert "_salt" in physical(joined) and "SortMergeJoin" in physical(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert joined.count() == 1000
