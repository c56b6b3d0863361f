"""Search through the index finds what a scan finds, and reads only some files."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxlake.operators.dashboard import EXPLORER_COLUMNS, explore, text_search
from voxlake.operators.inference import answer_with
from voxlake.operators.normalize import kept
from voxlake.plans import search
from voxlake.plans.analysis import run_analysis
from voxlake.plans.quantification import quantify_run
from voxlake.plans.store import STORED, Store, save_results
from voxlake.sources.readers import from_dataframe
from workload import transports

from conftest import no_wait

LETTERS = "abAB é😀Σσς%_\\\n.İ"


def analyses(spark, texts, start=0):
    names = [f.name for f in STORED]
    made = []
    for k, text in enumerate(texts, start):
        row = dict.fromkeys(names)
        row |= {"verbatim_id": f"id{k}", "theme": "t", "summary": "a summary", "sentiment": "neutre",
                "texte_original": text, "batch_idx": k // 10, "pos": k % 10}
        made.append(tuple(row[n] for n in names))
    return spark.createDataFrame(made, STORED)


def found(df):
    return Counter(tuple(r) for r in df.select(EXPLORER_COLUMNS).collect())


def scan(store, term):
    return found(text_search(explore(store.read_rows(store.path("results", "r"))), term))


def random_texts(seed, n):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(LETTERS, k=rng.randrange(12))) for _ in range(n)]
    return [None if rng.random() < 0.1 else t for t in texts]


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_search_equals_scan(spark, folder, kind):
    store = Store(spark, folder, results_format=kind)
    for k in range(3):
        save_results(analyses(spark, random_texts(k, 60), 100 * k).repartition(4), store, "r", f"00000{k}")
        if k < 2:  # the last part has no index
            search.index_part(store, "r", f"00000{k}", block_rows=3)
    rng = random.Random(7)
    terms = ["", "é", "ID7", "id20", "SUMMARY", "nowhere", "%_\\", "😀", "Σσς", "İ", "neutre"]
    terms += ["".join(rng.choices(LETTERS, k=rng.randrange(1, 6))) for _ in range(12)]
    terms += [t[2:7] for t in random_texts(1, 60) if t and len(t) > 6][:12]
    for term in terms:
        assert found(search.search_run(store, "r", term).rows) == scan(store, term), term


def test_few_files_are_read(spark, store):
    texts = [f"comment number {k:05d} about the product" for k in range(400)]
    save_results(analyses(spark, texts).repartitionByRange(20, "batch_idx", "pos"), store, "r", "000000")
    before = search.search_run(store, "r", "00123")
    assert (before.files_read, before.files) == (20, 20)  # no index yet
    search.index_part(store, "r", "000000", block_rows=4)
    got = search.search_run(store, "r", "NUMBER 00123")
    assert [r.verbatim_id for r in got.rows.collect()] == ["id123"] and (got.files_read, got.files) == (1, 20)
    assert len(got.rows.inputFiles()) == 20  # listed; what is read follows from the plan
    got.rows.collect()
    plan = got.rows._jdf.queryExecution().executedPlan()
    scans = plan.collectLeaves()
    assert "file_path" in plan.toString() and scans.size() == 1
    none = search.search_run(store, "r", "not there at all")
    assert none.rows.count() == 0 and none.files_read == 0
    every = search.search_run(store, "r", "comment")
    assert every.rows.count() == 400 and every.files_read == 20
    # A term whose trigrams stand in one block but not together is found by none.
    assert search.search_run(store, "r", "product00").rows.count() == 0


def test_an_index_follows_its_part(spark, store):
    save_results(analyses(spark, ["first words"] * 9).repartition(3), store, "r", "000000")
    search.index_part(store, "r", "000000")
    # Written again without an index: the old index speaks of files that are gone.
    save_results(analyses(spark, ["other words"] * 9).repartition(3), store, "r", "000000")
    assert search.search_run(store, "r", "other").rows.count() == 9
    assert search.search_run(store, "r", "first").rows.count() == 0
    search.index_part(store, "r", "000000")
    assert search.search_run(store, "r", "first").files_read == 0
    assert search.search_run(store, "r", "other").rows.count() == 9


def test_columns_that_are_not_indexed(spark, store):
    save_results(analyses(spark, ["some words"] * 8).repartition(4), store, "r", "000000")
    search.index_part(store, "r", "000000", columns=["verbatim_id"])
    assert search.search_run(store, "r", "words").rows.count() == 8
    got = search.search_run(store, "r", "words", columns=["verbatim_id"])
    assert (got.rows.columns, got.rows.count(), got.files_read) == (["verbatim_id"], 0, 0)


def test_a_crash_while_indexing(spark, store, monkeypatch):
    save_results(analyses(spark, ["some words"] * 4).repartition(2), store, "r", "000000")

    def fail(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(search, "_listed", fail)
    with pytest.raises(RuntimeError):
        search.index_part(store, "r", "000000")
    monkeypatch.undo()
    got = search.search_run(store, "r", "some words")
    assert got.rows.count() == 4 and got.files_read == 2
    search.index_missing(store, "r")
    assert search.search_run(store, "r", "other words").files_read == 0
    monkeypatch.setattr(search, "index_part", fail)  # nothing is missing any more
    search.index_missing(store, "r")


def test_long_texts(spark, store):
    text = "word " * 200_000 + "needle"
    save_results(analyses(spark, [text, "short", "", None]).repartition(4), store, "r", "000000")
    search.index_part(store, "r", "000000", block_rows=1)
    got = search.search_run(store, "r", "NEEDLE")
    assert [r.verbatim_id for r in got.rows.collect()] == ["id0"] and got.files_read == 1


def test_runs_index_what_they_commit(spark, store):
    docs = spark.createDataFrame([(f"doc_{k}", f"text number {k:03d}") for k in range(40)], "id string, text string")
    run = run_analysis(
        kept(from_dataframe(docs, "text", "id")), answer_with(transports.echo_analyst()), store, "r",
        batch_size=5, batches_per_commit=2, wait=no_wait, index=True,
    )
    assert len(run.parts) == 4
    got = search.search_run(store, "r", "number 013")
    assert [r.verbatim_id for r in got.rows.collect()] == ["doc_13"] and got.files_read < got.files
    quantify_run(store, "r", answer_with(transports.echo_harmonizer(["Produit", "Autre"])), wait=no_wait, index=True)
    got = search.search_run(store, "r", "number 013", kind="enriched_results")
    row = got.rows.first()
    assert row["verbatim_id"] == "doc_13" and row["macro_theme"] is not None and got.files_read < got.files
    listed = spark.read.parquet(store.path("search_results", "r") + "/*/files")
    assert listed.where(F.size("columns") == len(EXPLORER_COLUMNS)).count() == search.search_run(store, "r", "").files
