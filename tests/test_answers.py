import json
import random
import re

import pytest
from pyspark.sql import functions as F

from voxlake.functions.strict_json import with_strict_json
from voxlake.operators.batching import assign_batches, group_batches
from voxlake.operators.inference import answer_with
from voxlake.operators.responses import (
    failed_batches, first_accepted, flatten_analyses, parse_answers,
)
from voxlake.operators.validation import (
    all_errors, batch_progress, batch_tallies, check_batches, run_totals, valid_analyses,
)
from voxlake.session import prepare


def expected_json(raw):
    """What the answer holds: strip, fences, whole text, else the outermost braces."""
    text = re.sub(r"```\Z", "", re.sub(r"\A```(json)?", "", raw.strip())).strip()
    span = re.search(r"\{.*\}", text, re.DOTALL)
    for candidate in [text] + ([span.group()] if span else []):
        try:
            return True, json.loads(candidate)
        except json.JSONDecodeError:
            pass
    return False, None


def test_strict_json_agrees_with_python(spark):
    prepare(spark)
    pieces = ["```json", "```", "\n", " ", "{", "}", "[", "]", ",", ":", '"a"', '"b"', "1", "-0.5",
              "null", "true", '{"a":1}', '{"a":[1,{"b":"é"}]}', "bye", "'", " ", '"\\u00e9"',
              "\x01", "\\", "//", "2.5", "01"]
    rng = random.Random(11)
    texts = sorted({"".join(rng.choices(pieces, k=rng.randint(1, 7))) for _ in range(12_000)})
    df = spark.createDataFrame([(t,) for t in texts], "raw string").repartition(4)
    got = with_strict_json(df, "raw", "j").select("raw", F.col("j").isNotNull().alias("ok"), F.to_json("j").alias("text")).collect()
    found = 0
    for r in got:
        ok, value = expected_json(r["raw"])
        assert r["ok"] == ok, r["raw"]
        if ok:
            found += 1
            assert json.loads(r["text"]) == value, r["raw"]
    assert found > 500


ITEM = {"verbatim_id": "a", "theme": "t", "summary": "long enough", "sentiment": "neutre"}


def answer(*items, **extra):
    return json.dumps({"analyses": [{**ITEM, **i} for i in items], **extra})


@pytest.mark.parametrize("raw, kind", [
    (None, "no_answer"),
    ("", "bad_json"),
    ("null", "bad_json"),
    ("[1]", "bad_schema"),
    ("{}", "bad_schema"),
    ('{"analyses": {}}', "bad_schema"),
    ('{"analyses": []}', "ok"),
    (answer({}), "ok"),
    (answer({}, more=[1]), "ok"),
    (answer({"unknown": 3}), "ok"),
    (answer({"verbatim_id": 12}), "bad_schema"),
    (answer({"theme": None}), "bad_schema"),
    (answer({"summary": "x" * 150}), "ok"),
    (answer({"summary": "é" * 150}), "ok"),
    (answer({"summary": "x" * 151}), "bad_schema"),
    (answer({"sentiment": "Neutre"}), "bad_schema"),
    (answer({"sentiment": "mixte"}, {}), "bad_schema"),
    (answer({"source": None, "macro_theme": "m"}), "ok"),
    (answer({"source": 3}), "bad_schema"),
    ('{"analyses": [1]}', "bad_schema"),
    ('{"analyses": [null]}', "bad_schema"),
    (answer({}) + " " + answer({}), "bad_json"),
    ("see " + answer({}) + " bye", "ok"),
    ("```json\n" + answer({}) + "\n```", "ok"),
    ("[" + answer({}) + "]", "bad_schema"),
    ('{"analyses": 1, "analyses": []}', "ok"),
])
def test_answer_kinds(spark, raw, kind):
    df = spark.createDataFrame([(0, 0, raw)], "batch_idx bigint, attempt int, raw string")
    assert parse_answers(df).first()["kind"] == kind


def test_optional_fields_and_order_are_kept(spark):
    raw = answer({"verbatim_id": "b", "macro_theme": "m"}, {"verbatim_id": "a"})
    df = spark.createDataFrame([(3, 0, raw)], "batch_idx bigint, attempt int, raw string")
    got = flatten_analyses(first_accepted(parse_answers(df))).orderBy("pos").collect()
    assert [(r["pos"], r["verbatim_id"], r["macro_theme"]) for r in got] == [(0, "b", "m"), (1, "a", None)]


def test_attempts_and_failures(spark):
    df = spark.createDataFrame([
        (0, 0, None, None), (0, 1, answer({}), None), (0, 2, answer({}), None),
        (1, 0, None, None), (1, 1, "x" * 300, None),
        (2, 0, None, "boom"),
    ], "batch_idx bigint, attempt int, raw string, error string")
    parsed = parse_answers(df)
    assert [tuple(r)[:2] for r in first_accepted(parsed).collect()] == [(0, 1)]
    failed = {r["batch_idx"]: (r["type"], r["error"]) for r in failed_batches(parsed).collect()}
    assert failed == {
        1: ("batch_failure", "Échec après 2 tentatives: JSON invalide: " + "x" * 200),
        2: ("unexpected_error", "boom"),
    }


def sent(spark, ids, size=10):
    df = spark.createDataFrame(
        [(i, f"text {n}", f"s{n}", "fr") for n, i in enumerate(ids)],
        "id string, text string, source string, lang string",
    ).coalesce(1)
    return group_batches(assign_batches(df, size))


def check(spark, ids, *items):
    raw = answer(*items)
    df = spark.createDataFrame([(0, 0, raw)], "batch_idx bigint, attempt int, raw string")
    return check_batches(first_accepted(parse_answers(df)), sent(spark, ids))


def issues(checked):
    return [(i["data"]["verbatim_id"], [x.split(":")[0] for x in i["issues"]]) for i in checked.first()["items"]]


def test_first_occurrence_uses_up_the_id_even_when_invalid(spark):
    got = issues(check(spark, ["a", "b"], {"summary": "x"}, {}, {"verbatim_id": "b"}))
    assert got == [("a", ["Résumé trop court"]), ("a", ["ID dupliqué"]), ("b", [])]


def test_issue_order_and_limits(spark):
    checked = check(
        spark, ["a"],
        {"verbatim_id": "z", "theme": "a b c d e"}, {"verbatim_id": "z", "theme": "a b c d e f", "summary": " 1234 "},
        {"theme": "　\x1c", "summary": "12345"}, {"verbatim_id": "y", "theme": ""},
    )
    assert issues(checked) == [
        ("z", ["ID inconnu"]),
        ("z", ["ID dupliqué", "ID inconnu", "Thème trop long (6 mots)", "Résumé trop court"]),
        ("a", ["Thème vide"]),
        ("y", ["ID inconnu", "Thème vide"]),
    ]
    assert checked.first()["items"][0]["issues"] == ["ID inconnu: z (attendus: a)"]


def test_repeated_input_ids(spark):
    checked = check(spark, ["a", "a", "c"], {}, {"verbatim_id": "b"})
    row = checked.first()
    assert (row["expected"], row["got"], row["missing_ids"]) == (3, 2, ["c"])
    valid = valid_analyses(checked).collect()
    assert [(r["verbatim_id"], r["texte_original"], r["source"]) for r in valid] == [("a", "text 1", "s1")]


def test_errors_tallies_and_progress(spark):
    batches = sent(spark, list("abcdef"), 2)
    df = spark.createDataFrame([
        (0, 0, answer({}, {"verbatim_id": "b"})),
        (1, 0, answer({"verbatim_id": "c"}, {"verbatim_id": "c"})),
        (2, 0, None),
    ], "batch_idx bigint, attempt int, raw string")
    parsed = parse_answers(df)
    checked, failed = check_batches(first_accepted(parsed), batches), failed_batches(parsed)
    errors = all_errors(checked, failed, batches).collect()
    assert sorted((e["type"], e["batch_idx"]) for e in errors) == [
        ("batch_failure", 2), ("item_validation", 1), ("missing_verbatims", 1),
    ]
    by_type = {e["type"]: e for e in errors}
    assert by_type["batch_failure"]["verbatim_ids"] == ["e", "f"]
    assert by_type["missing_verbatims"]["missing_ids"] == ["d"]
    assert by_type["item_validation"]["data"]["verbatim_id"] == "c"
    tallies = batch_tallies(checked, failed)
    assert tuple(run_totals(tallies).first()) == (3, 3, 2, 3)
    progress = batch_progress(tallies, 3, span=2).orderBy("batch_idx").collect()
    assert [tuple(r) for r in progress] == [(0, 1, 3, 2, 0), (1, 2, 3, 3, 2), (2, 3, 3, 3, 3)]


def test_transport_failures_stay_with_their_prompt(spark):
    def transport(prompt):
        if "boom" in prompt:
            raise RuntimeError("no such model")
        return None if "quiet" in prompt else prompt.upper()

    df = spark.createDataFrame([(0, "a"), (1, "boom"), (2, "quiet")], "batch_idx bigint, prompt string")
    got = answer_with(transport, concurrency=2, threads=3)(df, 0).orderBy("batch_idx").collect()
    assert [tuple(r) for r in got] == [(0, "A", None), (1, None, "no such model"), (2, None, None)]
