import pytest
from pyspark.sql import functions as F

from voxlake.operators.inference import answer_with
from voxlake.operators.synthesis import (
    attach_syntheses, category_reviews, parse_syntheses, synthesis_points, synthesize,
)
from workload import transports

from conftest import no_wait, rows


def comments(spark, n, theme="A"):
    return [(i // 10, i % 10, theme, ["positif", "négatif", "neutre"][i % 3], f"{theme} summary {i}") for i in range(n)]


def frame(spark, cells):
    return spark.createDataFrame(
        cells, "batch_idx bigint, pos bigint, macro_theme string, sentiment string, summary string")


def categories(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "macro_theme string")


def test_reviews_are_cut_into_chunks_in_order(spark):
    analyses = frame(spark, comments(spark, 25) + comments(spark, 3, "B")).repartition(3)
    got = sorted(tuple(r) for r in category_reviews(categories(spark, "A", "B", "Vide"), analyses, 10).collect())
    assert [(c, k, n) for c, k, n, _ in got] == [("A", 0, 10), ("A", 1, 10), ("A", 2, 5), ("B", 0, 3), ("Vide", 0, 0)]
    lines = "\n".join(t for c, _, _, t in got if c == "A").split("\n")
    assert lines == [f"- [{s}] {t}" for _, _, _, s, t in comments(spark, 25)]
    assert got[-1][3] == ""


@pytest.mark.parametrize("lines, merge", [(5000, 50), (10, 50), (3, 2), (1, 3)])
def test_merged_synthesis_does_not_depend_on_the_chunks(spark, lines, merge):
    analyses = frame(spark, comments(spark, 25) + comments(spark, 4, "B") + comments(spark, 2, "No"))
    done, failures = synthesize(
        categories(spark, "A", "B", "No", "Vide"), analyses,
        answer_with(transports.echo_synthesizer("No")), lines, merge, wait=no_wait,
    )
    got = {r["category"]: r for r in done.collect()}
    assert sorted(got) == ["A", "B", "Vide"]
    assert got["A"]["positive_points"] == ["A summary 0", "A summary 3"]
    assert got["A"]["negative_points"] == ["A summary 1", "A summary 4"]
    assert got["B"]["positive_points"] == ["B summary 0", "B summary 3"]
    assert tuple(got["Vide"])[1:] == ("Vide", [], [], "Aucun avis disponible pour cette catégorie.")
    assert [r["category"] for r in failures.collect()] == ["No"]
    assert got["A"]["global_synthesis"] == "A: bilan 25" and got["B"]["global_synthesis"] == "B: bilan 4"


def test_a_chunk_that_fails_once_is_asked_again(spark):
    good = answer_with(transports.echo_synthesizer("No"))

    def answers(prompts, attempt):
        bad = (F.col("chunk") == 1) & F.lit(attempt == 0)
        return good(prompts, attempt).withColumn("raw", F.when(~bad, F.col("raw")))

    done, failures = synthesize(
        categories(spark, "A"), frame(spark, comments(spark, 25)), answers, 10, wait=no_wait)
    assert [r["global_synthesis"] for r in done.collect()] == ["A: bilan 25"] and failures.count() == 0


def test_one_failing_chunk_leaves_the_category_out(spark):
    def transport(prompt):
        import json

        if "summary 7" in prompt:
            return None
        return json.dumps({"macro_theme": "x", "positive_points": [], "negative_points": [], "global_synthesis": "g"})

    done, failures = synthesize(
        categories(spark, "A", "B"), frame(spark, comments(spark, 12) + comments(spark, 5, "B")),
        answer_with(transport), 4, 2, wait=no_wait,
    )
    assert [r["category"] for r in done.collect()] == ["B"]
    assert [tuple(r) for r in failures.collect()] == [("A", "no synthesis answer for A")]


@pytest.mark.parametrize("raw, ok", [
    ('{"macro_theme": "other", "positive_points": ["p"], "negative_points": [], "global_synthesis": "g"}', True),
    ('{"macro_theme": "m", "positive_points": [], "negative_points": [], "global_synthesis": ""}', True),
    ('{"macro_theme": "m", "positive_points": [1], "negative_points": [], "global_synthesis": "g"}', False),
    ('{"macro_theme": null, "positive_points": [], "negative_points": [], "global_synthesis": "g"}', False),
    ('{"macro_theme": "m", "positive_points": "p", "negative_points": [], "global_synthesis": "g"}', False),
    ('{"macro_theme": "m", "positive_points": []}', False),
    ("{}", False), ("prose", False), (None, False),
])
def test_shape(spark, raw, ok):
    df = spark.createDataFrame([("c", 0, raw, None)], "category string, chunk bigint, raw string, error string")
    assert (parse_syntheses(df).first()["problem"] is None) == ok


def test_points_and_report(spark):
    syntheses = spark.createDataFrame(
        [("A", "model's own name", ["p", "q"], [], "g"), ("B", "B", [], ["n"], "h")],
        "category string, macro_theme string, positive_points array<string>, negative_points array<string>, global_synthesis string",
    )
    assert rows(synthesis_points(syntheses)) == [
        ("A", "positive", 0, "p"), ("A", "positive", 1, "q"), ("B", "negative", 0, "n")]
    report = spark.createDataFrame([(1, {"old": "x"})], "n int, syntheses map<string,string>")
    row = attach_syntheses(report, syntheses).first()
    assert row["n"] == 1 and set(row["syntheses"]) == {"A", "B"}
    assert row["syntheses"]["A"]["macro_theme"] == "model's own name"
