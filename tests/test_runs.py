import json
from threading import Event

import pytest
from pyspark.sql import functions as F

from voxlake.operators.dashboard import kpis
from voxlake.operators.inference import answer_with
from voxlake.operators.normalize import kept
from voxlake.plans import analysis
from voxlake.plans.analysis import (
    checkpoint, pending_batches, release_run, run_analysis, run_errors,
)
from voxlake.plans.dashboard import dashboard_rows
from voxlake.plans.quantification import quantify_run, synthesize_run
from voxlake.plans.store import (
    Store, load_report, load_results, read_json_results, save_errors, save_results,
)
from voxlake.schemas import ERROR
from voxlake.sources.columns import label_from_path
from voxlake.sources.readers import from_dataframe, load_csv, load_jsonl
from workload import transports

from conftest import no_wait, rows


def comments(spark, n=25):
    df = spark.createDataFrame(
        [(f"doc_{i}", f"comment number {i}", f"s{i % 3}", "fr") for i in range(n)],
        "id string, text string, source string, lang string",
    ).coalesce(1)
    return kept(from_dataframe(df, "text", "id"))


def recording(echo, bad=()):
    """An answering step that fails the batches of `bad` by (batch, attempt)."""
    good = answer_with(echo)
    calls = []

    def answers(prompts, attempt):
        calls.append((attempt, sorted(r[0] for r in prompts.select("batch_idx").collect())))
        hit = F.lit(False)
        for b, kind in bad:
            if kind == "always" or kind == attempt:
                hit = hit | (F.col("batch_idx") == b)
        return good(prompts, attempt).withColumn("raw", F.when(~hit, F.col("raw")))

    answers.calls = calls
    return answers


def ids(df):
    return sorted(int(r["verbatim_id"][4:]) for r in df.collect())


def test_rounds_ask_only_what_failed(spark, store):
    answers = recording(transports.echo_analyst(), [(1, 0), (2, 0), (2, 1), (0, "always")])
    waited = []
    run = run_analysis(comments(spark), answers, store, "r", wait=waited.append)
    assert answers.calls == [(0, [0, 1, 2]), (1, [0, 1, 2]), (2, [0, 2])]
    assert waited == [2, 4]
    assert ids(run.valid) == list(range(10, 25))
    assert [(e["type"], e["batch_idx"], len(e["verbatim_ids"])) for e in run.errors.collect()] == [
        ("batch_failure", 0, 10)
    ]
    assert tuple(run.summary.first()) == (15, 1, 2, 3)
    assert [r["verbatim_id"] for r in run.preview(2).collect()] == ["doc_10", "doc_11"]
    first = run.valid.orderBy("batch_idx", "pos").first()
    assert (first["texte_original"], first["source"]) == ("comment number 10", "s1")


def test_resume_replays_failed_batches_only(spark, store):
    verbatims = comments(spark)
    bad = recording(transports.echo_analyst(), [(1, "always")])
    one = run_analysis(verbatims, bad, store, "r", max_retries=0, wait=no_wait)
    assert [r[0] for r in pending_batches(store, "r").collect()] == [1]
    done = checkpoint(store, "r").first()
    assert tuple(done)[:3] == ("r", 2, 3) and done["last_update"] is not None
    good = recording(transports.echo_analyst())
    with pytest.raises(FileNotFoundError):
        run_analysis(None, good, store, "other", wait=no_wait)
    two = run_analysis(None, good, store, "r", wait=no_wait)  # the run has kept its input
    assert good.calls == [(0, [1])]
    assert ids(one.valid) == [*range(10), *range(20, 25)] and ids(two.valid) == list(range(10, 20))
    assert ids(load_results(store, "r")) == list(range(25))
    assert [tuple(r) for r in two.progress.select("batch_idx", "cum_valid").collect()] == [(1, 10)]
    three = run_analysis(verbatims, good, store, "r", wait=no_wait)
    assert good.calls == [(0, [1])] and three.valid.count() == 0 and three.errors.count() == 0
    clean = run_analysis(verbatims, recording(transports.echo_analyst()), store, "clean", wait=no_wait)
    assert rows(load_results(store, "r")) == rows(clean.valid)


def test_other_input_or_batch_size_is_refused(spark, store):
    echo = answer_with(transports.echo_analyst())
    run_analysis(comments(spark), echo, store, "r", wait=no_wait)
    with pytest.raises(ValueError, match="batch size"):
        run_analysis(comments(spark), echo, store, "r", batch_size=5, wait=no_wait)
    with pytest.raises(ValueError, match="input"):
        run_analysis(comments(spark, 24), echo, store, "r", wait=no_wait)
    with pytest.raises(FileExistsError):
        run_analysis(comments(spark), echo, store, "r", resume=False, wait=no_wait)


@pytest.mark.parametrize("broken", ["parse_answers", "check_batches", "save_results", "batch_tallies", "save_errors"])
def test_a_crash_before_the_checkpoint_stores_nothing_twice(spark, store, monkeypatch, broken):
    verbatims = comments(spark)
    answers = recording(transports.echo_analyst(), [] if broken == "parse_answers" else [(2, 0)])
    with monkeypatch.context() as m:
        def crash(*args, **kwargs):
            raise RuntimeError("driver lost")

        m.setattr(analysis, broken, crash)
        with pytest.raises(RuntimeError):
            run_analysis(verbatims, answers, store, "r", wait=no_wait)
    before = len(answers.calls)
    run = run_analysis(verbatims, answers, store, "r", wait=no_wait)
    assert len(answers.calls) == before  # answers already paid for are used again
    assert ids(run.valid) == list(range(25)) and ids(load_results(store, "r")) == list(range(25))


@pytest.mark.parametrize("forgotten", [False, True])
def test_a_crash_while_opening_the_run(spark, store, forgotten):
    verbatims = comments(spark)
    table = analysis._Batches(store, "r")
    table.write(analysis.assign_batches(verbatims, 7), 2)  # written, but the run was not opened
    if forgotten:
        spark.sql(f"DROP TABLE {table.name}")  # a new session does not know the table
    run = run_analysis(verbatims, answer_with(transports.echo_analyst()), store, "r", wait=no_wait)
    assert run.total_batches == 3 and ids(run.valid) == list(range(25))


def test_a_crash_between_rounds_keeps_the_answers(spark, store):
    verbatims = comments(spark)
    good = recording(transports.echo_analyst(), [(2, 0)])

    def crashing(prompts, attempt):
        if attempt == 1:
            raise RuntimeError("driver lost")
        return good(prompts, attempt)

    with pytest.raises(RuntimeError):
        run_analysis(verbatims, crashing, store, "r", wait=no_wait)
    again = recording(transports.echo_analyst())
    run = run_analysis(verbatims, again, store, "r", wait=no_wait)
    assert again.calls == [(0, [2])] and ids(run.valid) == list(range(25))


def test_recovery_with_another_part_size_asks_nothing_twice(spark, store, monkeypatch):
    verbatims, answers = comments(spark, 45), recording(transports.echo_analyst(), [(3, "always")])
    with monkeypatch.context() as m:
        m.setattr(analysis, "save_results", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run_analysis(verbatims, answers, store, "r", max_retries=0, wait=no_wait)
    again = recording(transports.echo_analyst())
    run = run_analysis(verbatims, again, store, "r", batches_per_commit=1, wait=no_wait)
    assert again.calls == [(0, [3])] and run.parts == ("000000", "000001")
    assert ids(run.valid) == list(range(45)) == ids(load_results(store, "r"))
    assert pending_batches(store, "r").count() == 0


def test_parts_are_committed_one_by_one(spark, store):
    answers, heard = recording(transports.echo_analyst()), []

    def listener(*counts):
        heard.append(counts)
        raise RuntimeError("listeners may fail")

    run = run_analysis(
        comments(spark, 45), answers, store, "r", batches_per_commit=2, wait=no_wait, on_progress=listener)
    assert heard == [(1, 5, 10, 0), (2, 5, 20, 0), (3, 5, 30, 0), (4, 5, 40, 0), (5, 5, 45, 0)]
    assert answers.calls == [(0, [0, 1]), (0, [2, 3]), (0, [4])]
    assert run.parts == ("000000", "000001", "000002")
    assert ids(run.valid) == list(range(45)) == ids(load_results(store, "r"))
    assert tuple(run.summary.first()) == (45, 0, 5, 5)


def test_parts_are_at_work_together(spark, store):
    good, second = recording(transports.echo_analyst(), [(0, 0)]), Event()

    def answers(prompts, attempt):
        if attempt == 1:
            assert second.wait(60)  # the first part is asked again while the second one is at work
        elif good.calls:
            second.set()
        return good(prompts, attempt)

    run = run_analysis(comments(spark), answers, store, "r", batches_per_commit=1, wait=no_wait)
    assert run.parts == ("000000", "000001", "000002") and ids(run.valid) == list(range(25))


def together(answers):
    """An answering step that may be asked for several parts in one call."""
    def asked(prompts, attempt):
        return answers(prompts, attempt)

    asked.together = True
    return asked


def test_parts_are_asked_and_written_in_common_jobs(spark, store, monkeypatch):
    verbatims, bad = comments(spark, 45), [(1, 0), (3, "always")]
    alone = recording(transports.echo_analyst(), bad)
    whole = run_analysis(verbatims, alone, store, "whole", max_retries=1, wait=no_wait)
    answers, written, write = recording(transports.echo_analyst(), bad), [], analysis.write_table

    def noted(df, name, *where):
        written.append(name)
        return write(df, name, *where)

    monkeypatch.setattr(analysis, "write_table", noted)
    run = run_analysis(
        verbatims, together(answers), store, "r", batches_per_commit=1, max_retries=1, wait=no_wait, index=True)
    assert answers.calls == alone.calls == [(0, [0, 1, 2, 3, 4]), (1, [1, 3])]
    assert sorted(written) == [
        "answers", "answers", "checked", "checkpoint", "failed", "responses", "responses", "tallies",
        "unfinished"]
    assert run.parts == tuple(f"{n:06d}" for n in range(5))
    for kind in ("responses", "answers"):
        names = [f"{n:06d}.0000" for n in range(5)] + ["000001.0001", "000003.0001"]
        assert sorted(store.committed(kind, "r")) == sorted(names)
    for frame in ("valid", "errors", "tallies", "progress", "summary"):
        assert rows(getattr(run, frame)) == rows(getattr(whole, frame)), frame
    assert store.committed("errors", "r") == ["000003"] and not store.exists("staged", "r")
    again = recording(transports.echo_analyst())
    two = run_analysis(None, again, store, "r", wait=no_wait)
    assert again.calls == [(0, [3])] and ids(two.valid) == list(range(30, 40))


def test_a_part_does_not_read_the_texts_of_others(spark, store):
    table = analysis._Batches(store, "r")
    table.write(analysis.assign_batches(comments(spark, 6000), 10), 1)
    part = table.read(1).where("batch_idx >= 100 and batch_idx < 110").select("items.text")
    assert part.count() == 10
    part.collect()
    scan = part._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() <= 128


def test_a_crash_with_several_parts_at_work(spark, store, monkeypatch):
    verbatims, answers, commit = comments(spark, 45), recording(transports.echo_analyst()), analysis._commit
    with monkeypatch.context() as m:
        def crash(batches, judged, failed, store, run_id, part):
            if part in ("000000", "000003"):
                raise RuntimeError("driver lost")
            commit(batches, judged, failed, store, run_id, part)

        m.setattr(analysis, "_commit", crash)
        with pytest.raises(RuntimeError):
            run_analysis(verbatims, answers, store, "r", batches_per_commit=1, wait=no_wait)
    assert store.committed("checkpoint", "r") == ["000001", "000002", "000004"]
    again = recording(transports.echo_analyst())
    run = run_analysis(verbatims, again, store, "r", wait=no_wait)
    assert again.calls == [] and run.parts == ("000000", "000003")
    assert ids(load_results(store, "r")) == list(range(45))


def test_prepared_answers_outside_a_part_are_not_read(spark):
    prepared = spark.range(100).selectExpr("id batch_idx", "0 attempt", "string(id) raw")
    asked = transports.from_responses(prepared)(spark.range(40, 43).toDF("batch_idx"), 0)
    assert "<= 42" in asked._jdf.queryExecution().optimizedPlan().toString()
    assert rows(asked.select("raw")) == [("40",), ("41",), ("42",)]


def test_unexpected_errors_are_not_retried_in_the_same_call(spark, store):
    def transport(prompt):
        raise RuntimeError("no such model")

    calls = []
    inner = answer_with(transport)

    def answers(prompts, attempt):
        calls.append(attempt)
        return inner(prompts, attempt)

    run = run_analysis(comments(spark, 3), answers, store, "r", wait=no_wait)
    assert calls == [0]
    assert [(e["type"], e["error"]) for e in run.errors.collect()] == [("unexpected_error", "no such model")]
    assert run.valid.count() == 0
    assert [(e["type"]) for e in run_errors(store, "r").collect()] == ["unexpected_error"]


def test_the_bucketed_input_is_found_by_a_new_session(spark, store):
    verbatims = comments(spark)
    run_analysis(verbatims, recording(transports.echo_analyst(), [(0, "always")]), store, "r",
                 max_retries=0, buckets=3, wait=no_wait)
    spark.sql(f"DROP TABLE {analysis._Batches(store, 'r').name}")  # an external table: files stay
    run_analysis(verbatims, answer_with(transports.echo_analyst()), store, "r", wait=no_wait)
    assert ids(load_results(store, "r")) == list(range(25))


def test_stored_errors_retire(spark, store):
    verbatims = comments(spark)
    for bad in ([(0, "always"), (1, "always")], [(0, "always"), (1, "always")], [(1, "always")]):
        run_analysis(verbatims, recording(transports.echo_analyst(), bad), store, "r", max_retries=0, wait=no_wait)
    assert [(e["type"], e["batch_idx"]) for e in run_errors(store, "r").collect()] == [("batch_failure", 1)]


@pytest.mark.parametrize("size", ["64k", "1k"])
def test_resume_with_other_splits(spark, store, folder, size):
    for name, start, n in (("b", 60, 15), ("a", 0, 60), ("c", 75, 3)):
        with open(f"{folder}/{name}.jsonl", "w") as f:
            f.writelines(json.dumps({"id": f"doc_{i}", "text": f"comment number {i} {'x' * 80}"}) + "\n"
                         for i in range(start, start + n))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        bad = recording(transports.echo_analyst(), [(2, "always")])
        run_analysis(kept(load_jsonl(spark, f"{folder}/*.jsonl")), bad, store, "r", max_retries=0, wait=no_wait)
        spark.conf.set(key, size)
        good = recording(transports.echo_analyst())
        run_analysis(kept(load_jsonl(spark, f"{folder}/*.jsonl")), good, store, "r", wait=no_wait)
    finally:
        spark.conf.set(key, before)
    assert good.calls == [(0, [2])] and ids(load_results(store, "r")) == list(range(78))


def test_release(spark, store):
    run_analysis(comments(spark), answer_with(transports.echo_analyst()), store, "r", wait=no_wait)
    release_run(store, "r")
    assert not store.exists("batches", "r") and not store.exists("responses", "r")
    assert ids(load_results(store, "r")) == list(range(25)) and run_errors(store, "r").count() == 0


def test_no_input(spark, store):
    run = run_analysis(comments(spark, 1).where("false"), answer_with(transports.echo_analyst()),
                       store, "r", wait=no_wait)
    assert run.total_batches == 0 and run.valid.count() == 0


def test_stored_lines_are_checked(spark, store, folder):
    good = {"verbatim_id": "a", "theme": "t", "summary": "s", "sentiment": "neutre"}

    def read(*lines):
        path = f"{folder}/lines-{len(lines)}-{abs(hash(lines))}.jsonl"
        with open(path, "w") as f:
            f.write("\n".join(lines))
        return read_json_results(spark, path)

    assert read(json.dumps(good), "", json.dumps({**good, "more": 1})).count() == 2
    for bad in ["{oops", json.dumps({**good, "sentiment": "mixte"}), json.dumps({"theme": "t"})]:
        with pytest.raises(Exception):
            read(json.dumps(good), bad).select("theme").collect()


def test_dashboard_rows(spark, store, folder):
    with open(f"{folder}/old_raw.csv", "w") as f:
        f.write("id,text,source\na,raw a,web\n")
    cells = [("a", "t", "s", "neutre"), ("b", "t", "s", "neutre")]
    save_results(spark.createDataFrame(cells, "verbatim_id string, theme string, summary string, sentiment string"), store, "r")
    assert rows(dashboard_rows(store, "r", folder)) == [
        ("a", "web", "raw a", None, "t", "s", "neutre"),
        ("b", "inconnue", "(Texte original introuvable)", None, "t", "s", "neutre"),
    ]
    quantify_run(store, "r", answer_with(lambda prompt: '{"categories": ["M"], "mapping": {"t": "M"}}'))
    assert [r["macro_theme"] for r in dashboard_rows(store, "r").collect()] == ["M", "M"]


def test_runs_and_errors_on_disk(spark, folder):
    store = Store(spark, folder, results_format="json")
    results = spark.createDataFrame([("a", "t", "s", "neutre", None)], "verbatim_id string, theme string, summary string, sentiment string, source string")
    for run_id in ("20240101_000000", "20250101_000000"):
        path = save_results(results, store, run_id)
    assert [r[0] for r in store.runs().collect()] == ["20250101_000000", "20240101_000000"]
    assert '"source":null' in spark.read.text(path).first()[0]
    assert save_errors(spark.createDataFrame([], ERROR), store, "x") is None
    assert Store(spark, store.root + "/none").runs().count() == 0
    with pytest.raises(FileNotFoundError):
        load_results(store, "missing")


def test_from_a_csv_file_to_the_report(spark, store, folder):
    with open(f"{folder}/shop_reviews.csv", "w", encoding="utf-8") as f:
        f.write('review_id,Comment,Platform\n' + "".join(
            f'doc_{i},"comment ""{i}"",\nsecond line",{"web" if i % 2 else ""}\n' for i in range(12)))
    path = f"{folder}/shop_reviews.csv"
    landed = load_csv(spark, path, source=label_from_path(path))
    run_analysis(kept(landed), answer_with(transports.echo_analyst()), store, "r", wait=no_wait)
    done = quantify_run(store, "r", answer_with(transports.echo_harmonizer(["Produit"])))
    assert {r["source"] for r in done.enriched.collect()} == {"shop", "web"}
    first = done.enriched.where("verbatim_id = 'doc_3'").first()
    assert first["texte_original"] == 'comment "3",\nsecond line' and first["summary"] == 'comment "3", second line'
    assert done.report.first()["metadata"]["total_verbatims"] == 12


def test_quantify_and_synthesise_a_run(spark, store):
    run_analysis(comments(spark), answer_with(transports.echo_analyst()), store, "r", wait=no_wait)
    assert load_report(store, "r") == (None, None, None)
    done = quantify_run(store, "r", answer_with(transports.echo_harmonizer(["Produit", "Service"])))
    assert done.enriched.where("macro_theme is null").count() == 0
    report = done.report.first()
    assert report["metadata"]["total_verbatims"] == 25
    assert report["global_sentiment"]["positif"] == 9
    assert done.lines.first()["line"] == "Total verbatims analysés : 25"
    syntheses, failures = synthesize_run(store, "r", answer_with(transports.echo_synthesizer("Service")), wait=no_wait)
    assert [r["category"] for r in failures.collect()] == ["Service"]
    report, enriched, mapping = load_report(store, "r")
    assert {r["theme"] for r in mapping.collect()} == {r["theme"] for r in enriched.collect()}
    stored = report.first()["syntheses"]
    assert set(stored) == {r["category"] for r in syntheses.collect()} and "Service" not in stored
    assert enriched.count() == 25


def test_results_kept_in_columns(spark, folder):
    store = Store(spark, folder)
    run = run_analysis(comments(spark), answer_with(transports.echo_analyst()), store, "r", wait=no_wait)
    assert ids(run.valid) == list(range(25)) == ids(load_results(store, "r"))
    done = quantify_run(store, "r", answer_with(transports.echo_harmonizer(["Produit"])))
    assert done.enriched.where("macro_theme is null").count() == 0
    assert [r[0] for r in store.runs().collect()] == ["r"]
    plan = kpis(done.enriched)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<sentiment:string>" in plan
    with pytest.raises(ValueError):
        Store(spark, folder, results_format="xml")


def test_themes_that_differ_by_case_keep_their_entries(spark, store):
    cells = [("a", "Prix", "s", "neutre", 0, 0), ("b", "prix", "s", "positif", 0, 1)]
    save_results(spark.createDataFrame(cells, (
        "verbatim_id string, theme string, summary string, sentiment string, batch_idx bigint, pos bigint"
    )), store, "r")
    answer = '{"categories": ["Prix", "prix"], "mapping": {"Prix": "Prix", "prix": "prix"}}'
    quantify_run(store, "r", answer_with(lambda prompt: answer))
    report, _, mapping = load_report(store, "r")
    assert dict(mapping.collect()) == {"Prix": "Prix", "prix": "prix"}
    report = report.first()
    assert {k: v["total"] for k, v in report["theme_distribution"].items()} == {"Prix": 1, "prix": 1}
    assert report["theme_distribution"]["prix"]["positif"] == 1


def test_a_run_without_results_is_not_quantified(spark, store):
    run_analysis(comments(spark, 2), recording(transports.echo_analyst(), [(0, "always")]), store, "r",
                 max_retries=0, wait=no_wait)
    assert quantify_run(store, "r", answer_with(transports.echo_harmonizer([])), wait=no_wait) is None
