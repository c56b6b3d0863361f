"""What the queries write for themselves before they read it as a user would."""

from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from voxlake.operators import inference
from voxlake.operators.normalize import kept
from voxlake.plans import search
from voxlake.plans.store import save_results
from voxlake.session import list_names, own_splits, write_table
from voxlake.sources.readers import load_jsonl
from voxlake.streaming import incremental
from workload import queries, transports

from conftest import rows


def documents(spark, folder, n=40):
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"), F.expr("repeat('word ', 40)").alias("text"),
        F.lit("fr").alias("lang"), F.lit("s").alias("source"))
    docs.write.parquet(f"{folder}/documents.parquet")
    return folder


def files(spark, path):
    return [n for n in list_names(spark, path) if n.startswith("part-")]


def test_json_files_grow_in_number_not_in_size(spark, folder, monkeypatch):
    sf = documents(spark, folder)
    few = queries._json_files(spark, sf, "doc_id", "text")
    monkeypatch.setattr(queries, "FILE_BYTES", 1000)
    many = queries._json_files(spark, sf, "doc_id", "text")
    assert len(files(spark, few)) == 3 and 8 <= len(files(spark, many)) <= 12
    assert rows(spark.read.json(few)) == rows(spark.read.json(many))
    monkeypatch.undo()
    before = rows(queries.jsonl_source(spark, sf))
    monkeypatch.setattr(queries, "FILE_BYTES", 1000)
    assert rows(queries.jsonl_source(spark, sf)) == before


def test_small_splits_share_tasks_and_files(spark, folder):
    path = f"{folder}/in"
    texts = spark.range(2000).selectExpr("id", "concat(repeat('text ', 20), id) text")
    texts.repartitionByRange(3, "id").sortWithinPartitions("id").write.json(path)
    key, places = "spark.sql.files.maxPartitionBytes", []
    before = spark.conf.get(key)
    try:
        for size in ("128m", "1k"):
            spark.conf.set(key, size)
            landed = load_jsonl(spark, path)
            assert len(landed.inputFiles()) <= 4 * spark.sparkContext.defaultParallelism + 10
            with own_splits(spark):
                assert spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() == 128 << 20
                places.append(rows(kept(landed).select("id", "position")))
            assert spark.conf.get(key) == size
    finally:
        spark.conf.set(key, before)
    assert places[0] == places[1] and {int(i) - p for i, p in places[0]} == {0}


def test_stream_files_grow_in_number_and_epochs_do_not(spark, folder, monkeypatch):
    sf = documents(spark, folder)
    before = rows(queries.streaming_sentiment(spark, sf))
    monkeypatch.setattr(queries, "FILE_BYTES", 1000)
    stores = []
    made = queries._store
    monkeypatch.setattr(queries, "_store", lambda spark: stores.append(made(spark)) or stores[-1])
    assert len(files(spark, queries._stream_files(spark, sf))) == 8
    assert rows(queries.streaming_sentiment(spark, sf)) == before
    assert len(stores[0].committed("sentiment", "stream")) == 4


def test_a_task_holds_few_prompts_as_strings(spark, monkeypatch):
    def sizes(frames, transport, keys, threads, seals, group):
        for frame in frames:
            out = frame.drop(columns="prompt")
            out["raw"], out["error"] = str(len(frame)), None
            yield out

    monkeypatch.setattr(inference, "ask", sizes)
    prompts = spark.range(1000).selectExpr("id batch_idx", "string(id) prompt").coalesce(1)
    told = inference.answer_with(str.upper, group=2)(prompts, 0).collect()
    assert [r["batch_idx"] for r in told] == list(range(1000))
    assert {r["raw"] for r in told} == {"32", "8"} and {r["error"] for r in told} == {None}


def test_an_index_shuffles_rows_not_trigrams(spark, store, monkeypatch):
    texts = [(k, f"comment number {k:04d} " + "about the product " * 20) for k in range(200)]
    stored = spark.createDataFrame(texts, "batch_idx long, texte_original string").coalesce(2)
    save_results(stored, store, "r", "000000")
    dealt = []
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda *a: dealt.append(a))
    monkeypatch.setattr(DataFrame, "distinct", lambda *a: dealt.append(a))
    search.index_part(store, "r", "000000")
    monkeypatch.undo()
    assert dealt == []
    postings = spark.read.parquet(store.path("search_results", "r") + "/*/postings")
    assert postings.count() == postings.distinct().count() > 0
    assert search.search_run(store, "r", "number 0123").rows.count() == 1


def test_an_epoch_writes_texts_once_grouped_and_once_as_results(spark, store, monkeypatch):
    written = {}

    def noted(df, name, path=None):
        written[name] = df.schema.simpleString()
        return write_table(df, name, path)

    monkeypatch.setattr(incremental, "write_table", noted)
    monkeypatch.setattr(inference, "write_table", noted)
    frame = spark.createDataFrame([(f"doc_{i}", f"comment number {i}") for i in range(6)], "id string, text string")
    echo = inference.answer_with(transports.echo_analyst())
    incremental.analyse_epoch(frame, 0, echo, store, "s", "text", "id")
    assert "prompts" not in written and "text:" in written["batches"] and "text:" not in written["checked"]
    told = incremental.stream_results(store, "s").select("texte_original")
    assert rows(told) == [(f"comment number {i}",) for i in range(6)]
