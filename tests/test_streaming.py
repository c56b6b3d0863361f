import json
import os

from voxlake.operators.inference import answer_with
from voxlake.plans.store import load_results
from voxlake.session import list_names, shared_dir
from voxlake.streaming import incremental
from workload import transports

from conftest import no_wait, rows

SCHEMA = "id string, text string, source string"


def write(folder, name, ids):
    with open(f"{folder}/{name}", "w") as f:
        for i in ids:
            f.write(json.dumps({"id": f"doc_{i}", "text": f"comment number {i}"}) + "\n")


def run(spark, store, folder, answers, id_col="id"):
    rows_ = incremental.read_stream(spark, "json", SCHEMA, f"{folder}/in", files_per_batch=1)
    query = incremental.analyse_stream(
        rows_, answers, store, "s", f"{folder}/checkpoint", "text", id_col, batch_size=4,
        wait=no_wait)
    query.awaitTermination()
    assert query.exception() is None


def test_new_files_only_and_running_counts(spark, store, folder):
    os.mkdir(f"{folder}/in")
    echo = answer_with(transports.echo_analyst())
    assert rows(incremental.running_sentiment(store, "s")) == [("neutre", 0), ("négatif", 0), ("positif", 0)]
    write(f"{folder}/in", "a.json", range(10))
    write(f"{folder}/in", "b.json", range(10, 15))
    run(spark, store, folder, echo)
    assert rows(incremental.running_sentiment(store, "s")) == [("neutre", 5), ("négatif", 5), ("positif", 5)]
    write(f"{folder}/in", "c.json", range(15, 21))
    run(spark, store, folder, echo)
    assert rows(incremental.running_sentiment(store, "s")) == [("neutre", 7), ("négatif", 7), ("positif", 7)]
    stored = load_results(store, "s")
    assert sorted(int(r["verbatim_id"][4:]) for r in stored.collect()) == list(range(21))
    assert {r["source"] for r in stored.collect()} == {"stream"}
    assert store.committed("results", "s") == [f"epoch-{n:09d}" for n in range(3)]


def test_an_epoch_leaves_no_scratch_tables(spark, store, folder):
    os.mkdir(f"{folder}/in")
    write(f"{folder}/in", "a.json", range(5))
    before = set(list_names(spark, shared_dir(spark)))
    run(spark, store, folder, answer_with(transports.echo_analyst()))
    assert set(list_names(spark, shared_dir(spark))) == before
    assert load_results(store, "s").count() == 5


def test_csv_stream_with_null_tokens(spark, store, folder):
    os.mkdir(f"{folder}/in")
    with open(f"{folder}/in/a.csv", "w") as f:
        f.write('id,text\ndoc_0,"two\nlines here"\ndoc_1,NA\ndoc_2,third comment\n')
    rows_ = incremental.read_stream(spark, "csv", "id string, text string", f"{folder}/in")
    incremental.analyse_stream(
        rows_, answer_with(transports.echo_analyst()), store, "s", f"{folder}/checkpoint", "text", "id",
        null_tokens=True,
    ).awaitTermination()
    assert rows(load_results(store, "s").select("verbatim_id", "texte_original")) == [
        ("doc_0", "two\nlines here"), ("doc_2", "third comment")]


def test_a_replayed_epoch_replaces_itself(spark, store):
    frame = spark.createDataFrame([(f"doc_{i}", f"comment number {i}") for i in range(6)], "id string, text string")
    echo = answer_with(transports.echo_analyst())
    for rows_ in (frame, frame, frame.limit(5)):
        incremental.analyse_epoch(rows_, 0, echo, store, "s", "text", "id")
    assert load_results(store, "s").count() == 5
    assert sum(r["n"] for r in incremental.running_sentiment(store, "s").collect()) == 5


def test_a_replayed_epoch_asks_nothing(spark, store):
    frame = spark.createDataFrame([(f"doc_{i}", f"comment number {i}") for i in range(6)], "id string, text string")
    incremental.analyse_epoch(frame, 0, answer_with(transports.echo_analyst()), store, "s", "text", "id")

    def never(prompts, attempt):
        raise AssertionError("asked again")

    incremental.analyse_epoch(frame, 0, never, store, "s", "text", "id")
    assert load_results(store, "s").count() == 6


def test_counts_are_compacted(spark, store):
    echo = answer_with(transports.echo_analyst())
    for epoch in range(5):
        frame = spark.createDataFrame(
            [(f"doc_{i}", f"comment number {i}") for i in range(6 * epoch, 6 * epoch + 6)], "id string, text string")
        incremental.analyse_epoch(frame, epoch, echo, store, "s", "text", "id")
        if epoch in (1, 3):
            incremental.compact_counts(store, "s", epoch)
        total = sum(r["n"] for r in incremental.running_sentiment(store, "s").collect())
        assert total == 6 * epoch + 6
    assert sorted(store.committed("sentiment", "s")) == ["epoch-000000004", "upto-000000003"]


def test_generated_ids_name_the_epoch_and_failures_are_kept(spark, store, folder):
    os.mkdir(f"{folder}/in")
    write(f"{folder}/in", "a.json", range(6))
    seen = []

    def answers(prompts, attempt):
        seen.append(attempt)
        return answer_with(lambda prompt: None)(prompts, attempt)

    run(spark, store, folder, answers, id_col=None)
    assert seen == [0, 1, 2]
    errors = spark.read.json(f"{store.path('errors', 's')}/epoch-000000000").orderBy("batch_idx").collect()
    assert [(e["type"], e["verbatim_ids"]) for e in errors] == [
        ("batch_failure", [f"stream_0_{i}" for i in range(4)]), ("batch_failure", ["stream_0_4", "stream_0_5"])]
