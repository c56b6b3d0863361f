import pytest
from pyspark.sql import functions as F

from voxlake.operators.batching import assign_batches, batch_lines, build_prompts, group_batches
from voxlake.operators.normalize import ingest_counts, kept, value_counts
from voxlake.operators.positions import land_positions, running_totals
from voxlake.schemas import WHITESPACE
from voxlake.sources.datasets import normalize_dataset, pick_text_column, write_csv
from voxlake.sources.readers import from_dataframe, load_csv, load_jsonl


def write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return str(path)


def verbatims(landed):
    return [tuple(r) for r in kept(landed).drop("position").orderBy("row_idx").collect()]


def test_csv_null_tokens_quotes_and_line_breaks(spark, folder):
    path = write(f"{folder}/a.csv", (
        "﻿Review,Platform,lang\r\n"
        '"says ""hi""\nand leaves",web,en\r\n'
        "NA,web,en\r\n"
        "  null ,NULL,  \r\n"
        '"",x,y\r\n'
        "\r\n"
        "  padded ,,\r\n"
        "nan,a,b\r\n"
    ), "utf-8")
    assert verbatims(load_csv(spark, path, source="csv", lang="fr")) == [
        (0, "csv_0", 'says "hi"\nand leaves', "web", "en"),
        (2, "csv_2", "null", "csv", ""),
        (4, "csv_4", "padded", "csv", "fr"),
    ]


def test_csv_ids_stay_as_written_and_columns_can_be_named(spark, folder):
    path = write(f"{folder}/a.csv", "ID,body,Text,text\n001,b1,t1,u1\n,b2,t2,u2\n")
    assert verbatims(load_csv(spark, path)) == [
        (0, "001", "u1", "csv", "fr"), (1, "csv_1", "u2", "csv", "fr"),
    ]
    assert [r[2] for r in verbatims(load_csv(spark, path, text_col="body"))] == ["b1", "b2"]
    assert [r[1] for r in verbatims(load_csv(spark, path, id_col="body"))] == ["b1", "b2"]


def test_csv_limits(spark, folder):
    path = write(f"{folder}/a.csv", "text\na\n\"\"\nb\nc\n")
    assert [r[1] for r in verbatims(load_csv(spark, path, limit=3))] == ["csv_0", "csv_2"]
    assert verbatims(load_csv(spark, path, limit=0)) == []


def test_csv_folder_with_differing_headers(spark, folder):
    write(f"{folder}/a b_1.csv", "id,text\n1,one\n")
    write(f"{folder}/é+_2.csv", "text,id\ntwo,2\n,3\n")
    write(f"{folder}/z.csv", "Review,Platform\nthree,web\n")
    assert verbatims(load_csv(spark, folder, source=None)) == [
        (0, "1", "one", "a b", "fr"), (1, "z_1", "three", "web", "fr"), (2, "2", "two", "é+", "fr"),
    ]


def test_csv_surplus_cells(spark, folder):
    path = write(f"{folder}/a.csv", "id,text\n1,one,more\n2,two,\n")
    with pytest.raises(Exception, match="more cells than columns"):
        load_csv(spark, path)
    assert [r[2] for r in verbatims(load_csv(spark, path, surplus="drop"))] == ["one", "two"]


@pytest.mark.parametrize("size", ["10m", "2k", "64k"])
def test_positions_follow_files_not_splits(spark, folder, size):
    import os

    for name, start, n in (("b.jsonl", 300, 40), ("a.jsonl", 0, 300), ("c.jsonl", 340, 7)):
        write(f"{folder}/{name}", "".join(f'{{"text": "row {i} {"x" * 50}"}}\n' for i in range(start, start + n)))
    os.mkdir(f"{folder}/none")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        landed = load_jsonl(spark, f"{folder}/*.jsonl")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = [(r["row_idx"], int(r["text"].split()[1]), r["position"]) for r in kept(landed).orderBy("row_idx").collect()]
    assert got == [(i, i, i) for i in range(347)]


def test_csv_errors(spark, folder):
    with pytest.raises(FileNotFoundError):
        load_csv(spark, f"{folder}/none.csv")
    path = write(f"{folder}/a.csv", "foo,bar\n1,2\n")
    with pytest.raises(ValueError, match="foo"):
        load_csv(spark, path)


def test_jsonl_fields_are_fixed_names(spark, folder):
    path = write(f"{folder}/a.jsonl", (
        '{"text": " a ", "Origin": "web", "language": null, "key": 7}\n'
        '{"text": null, "key": 8}\n'
        '{"review": "z", "key": 9}\n'
        '{"text": 12, "Origin": " ", "language": "en"}\n'
    ))
    assert verbatims(load_jsonl(spark, path)) == [
        (0, "jsonl_0", "a", "web", "fr"), (3, "jsonl_3", "12", "", "en"),
    ]
    assert [r[1] for r in verbatims(load_jsonl(spark, path, id_field="key"))] == ["7", "jsonl_3"]
    assert verbatims(load_jsonl(spark, path, text_field="Text")) == []
    assert [r[2] for r in verbatims(load_jsonl(spark, path, text_field="nothing", detect=True))] == ["a", "12"]
    assert [r[2] for r in verbatims(load_jsonl(spark, path, columns=["text", "id"]))] == ["a", "12"]


def test_jsonl_fields_that_differ_by_case(spark, folder):
    path = write(f"{folder}/a.jsonl", '{"text": "a", "Source": "s1", "source": "s2"}\n')
    assert verbatims(load_jsonl(spark, path)) == [(0, "jsonl_0", "a", "s2", "fr")]


def test_frame_limit_of_zero_is_no_limit(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "t string")
    assert len(verbatims(from_dataframe(df, "t", limit=0))) == 2
    assert len(verbatims(from_dataframe(df, "t", limit=2))) == 1
    with pytest.raises(ValueError):
        from_dataframe(df, "T")


def test_all_python_whitespace_is_stripped(spark):
    df = spark.createDataFrame([(WHITESPACE,), (WHITESPACE + "a" + WHITESPACE + "b" + WHITESPACE,)], "t string")
    assert [r[2] for r in verbatims(from_dataframe(df, "t"))] == ["a" + WHITESPACE + "b"]


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_positions_do_not_depend_on_partitions(spark, partitions):
    df = spark.range(0, 100, 1, partitions).select(
        F.when(F.col("id") % 3 == 1, " ").otherwise(F.col("id").cast("string")).alias("t")
    )
    landed = from_dataframe(df, "t")
    want = [i for i in range(100) if i % 3 != 1]
    batched = assign_batches(kept(landed), 7).orderBy("row_idx").collect()
    assert [(r["row_idx"], r["id"], r["text"], r["batch_idx"], r["pos_in_batch"]) for r in batched] == [
        (i, f"dataframe_{i}", str(i), n // 7, n % 7) for n, i in enumerate(want)
    ]
    assert tuple(ingest_counts(landed).first()) == (100, len(want))


@pytest.mark.parametrize("limit", [0, 1, 30, 31, 99, 1000])
def test_limit_across_partitions(spark, limit):
    df = spark.range(0, 100, 1, 7).select(F.col("id").cast("string").alias("t"))
    got = sorted(int(r["t"]) for r in land_positions(df, limit=limit).where(F.col("row_idx") < limit).collect())
    assert got == list(range(min(limit, 100)))


def test_running_totals_over_short_ranges(spark):
    df = spark.range(0, 50, 1, 3).select("id", (F.col("id") % 5).alias("v"), (F.col("id") % 2).alias("g"))
    total = 0
    for r in running_totals(df, ["id"], {"v": "cum"}, span=7).orderBy("id").collect():
        total += r["id"] % 5
        assert r["cum"] == total
    per = {0: 0, 1: 0}
    for r in running_totals(df, ["id"], {"v": "cum"}, by=["g"], span=7).orderBy("id").collect():
        per[r["g"]] += r["id"] % 5
        assert r["cum"] == per[r["g"]]


def test_batches_without_positions_are_numbered(spark):
    df = spark.createDataFrame([(str(i), f"t{i}", "s", "fr") for i in range(5)], "id string, text string, source string, lang string").coalesce(1)
    lines = [tuple(r) for r in batch_lines(group_batches(assign_batches(df, 2))).orderBy("batch_idx").collect()]
    assert lines == [(0, 2, "[0] t0\n[1] t1"), (1, 2, "[2] t2\n[3] t3"), (2, 1, "[4] t4")]


def test_prompt_holds_the_lines(spark):
    df = spark.createDataFrame([("7", "multi\nline", "s", "fr")], "id string, text string, source string, lang string")
    assert build_prompts(group_batches(assign_batches(df))).first()["prompt"].endswith("\nComments:\n[7] multi\nline\n")


def test_value_counts(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "lang string")
    assert [tuple(r) for r in value_counts(df, "lang").collect()] == [("b", 2), ("a", 1)]


def test_dataset_round_trip(spark, folder):
    df = spark.createDataFrame([(1, 'a "b"\nc'), (2, None), (3, "d")], "k int, Review string").coalesce(1)
    column = pick_text_column(df, ["review", "Review"])
    out = normalize_dataset(df, column, "x", "shop", "en", limit=2)
    write_csv(out, f"{folder}/out")
    assert verbatims(load_csv(spark, f"{folder}/out")) == [(0, "x_0", 'a "b"\nc', "shop", "en")]
    assert pick_text_column(df, ["nothing"]) == "Review"
