import json

import pytest
from pyspark.sql import functions as F

from voxlake.operators.harmonize import (
    apply_mapping, harmonize, harmonization_prompts, parse_mappings, theme_chunks, unique_themes,
    with_fallback,
)
from voxlake.operators.inference import answer_with
from voxlake.operators.lookup import lookup
from voxlake.operators.quantify import (
    category_shares, global_sentiment, global_shares, macro_tallies, rank_by_volume, report_document,
    report_lines, sentiment_shares, theme_distribution, theme_tallies,
)
from voxlake.session import write_table

from conftest import no_wait, rows


def themes_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "theme string")


def categories_of(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "pos int, category string")


def mapping_of(spark, pairs):
    return spark.createDataFrame(list(pairs.items()), "theme string, macro_theme string")


def analyses_of(spark, *cells):
    return spark.createDataFrame(
        [(i // 10, i % 10, t, s) for i, (t, s) in enumerate(cells)],
        "batch_idx bigint, pos bigint, theme string, sentiment string",
    )


def test_unique_themes_in_code_point_order(spark):
    df = themes_of(spark, ["b", "é", "B", "", "a", "b", "z", "😀", "￿"])
    assert [r[0] for r in unique_themes(df).collect()] == sorted({"b", "é", "B", "a", "z", "😀", "￿"})
    assert unique_themes(df, drop_empty=False).first()[0] == ""


@pytest.mark.parametrize("names, fallback, want, final", [
    (["X", "Y"], "first", {"a": "X", "b": "Autre", "c": "X", "d": "X"}, ["X", "Y", "Autre"]),
    (["X", "Autre"], "first", {"a": "X", "b": "X", "c": "X", "d": "X"}, ["X", "Autre"]),
    ([], "first", {"a": "X", "b": "Autre", "c": "Autre", "d": "Autre"}, ["Autre"]),
    (["X"], "autre", {"a": "X", "b": "Autre", "c": "Autre", "d": "Autre"}, ["X", "Autre"]),
])
def test_fallback_for_unmapped_themes(spark, names, fallback, want, final):
    found = with_fallback(
        themes_of(spark, list("dcba")), categories_of(spark, names),
        mapping_of(spark, {"a": "X", "extra": "E"}), fallback,
    )
    assert dict(found.mapping.collect()) == {**want, "extra": "E"}
    assert [r["category"] for r in found.categories.orderBy("pos").collect()] == final


def test_nothing_unmapped_leaves_the_categories(spark):
    found = with_fallback(themes_of(spark, ["a"]), categories_of(spark, ["X"]), mapping_of(spark, {"a": "Z"}))
    assert [r["category"] for r in found.categories.collect()] == ["X"]


def test_no_themes_no_call(spark):
    def never(prompts, attempt):
        raise AssertionError("called")

    found = harmonize(themes_of(spark, []), never)
    assert found.mapping.count() == 0 and found.categories.count() == 0


@pytest.mark.parametrize("raw", [
    None, "", "prose", "{}", "[]", "null", '{"categories": ["a"]}',
    '{"categories": "a", "mapping": {}}', '{"categories": [1], "mapping": {}}',
    '{"categories": ["a"], "mapping": {"t": 1}}', '{"categories": ["a"], "mapping": ["t"]}',
])
def test_bad_answers_raise(spark, raw):
    with pytest.raises(ValueError):
        harmonize(themes_of(spark, ["t"]), answer_with(lambda prompt: raw), wait=no_wait)


def test_answer_in_prose_is_read(spark):
    answer = json.dumps({"categories": ["B", "A"], "mapping": {"t": "A", "other": "Z"}})
    found = harmonize(themes_of(spark, ["t"]), answer_with(lambda prompt: f"so: {answer} done"))
    assert dict(found.mapping.collect()) == {"t": "A", "other": "Z"}
    assert [tuple(r) for r in found.categories.orderBy("pos").collect()] == [(0, "B"), (1, "A")]


def test_empty_lists_are_an_answer(spark):
    df = spark.createDataFrame([(0, '{"categories": [], "mapping": {}}', None)], "chunk bigint, raw string, error string")
    row = parse_mappings(df).first()
    assert row["problem"] is None and row["categories"] == [] and row["pairs"] == []


def test_chunks_are_contiguous_and_bounded(spark):
    chunks = theme_chunks(themes_of(spark, [f"t{i:03d}" for i in range(25)]).repartition(3), 10)
    got = sorted((r["chunk"], r["theme"]) for r in chunks.collect())
    assert got == [(i // 10, f"t{i:03d}") for i in range(25)]
    prompts = {r["chunk"]: r["prompt"] for r in harmonization_prompts(chunks, 4).collect()}
    assert prompts[2].endswith("Themes:\n- t020\n- t021\n- t022\n- t023\n- t024\n") and "at most 4" in prompts[2]


def first_letters():
    def transport(prompt):
        import json as j

        names = [x[2:] for x in prompt.split("\nThemes:\n")[1].splitlines()]
        mapping = {n: n[0].upper() for n in names if not n.endswith("9")}
        mapping["a001"] = "hallucinated" if "a001" not in names else mapping["a001"]
        return j.dumps({"categories": sorted(set(mapping.values()) - {"hallucinated"}), "mapping": mapping})

    return transport


def test_many_themes_are_merged_over_several_calls(spark):
    names = [f"{c}{i:03d}" for c in "abc" for i in range(20)]
    found = harmonize(themes_of(spark, names), answer_with(first_letters()), themes_per_call=7)
    got = dict(found.mapping.collect())
    unmapped = sorted(n for n in names if n.endswith("9"))
    assert got == {**{n: n[0].upper() for n in names}, **{n: "A" for n in unmapped}, unmapped[0]: "Autre"}
    assert [r["category"] for r in found.categories.orderBy("pos").collect()] == ["A", "B", "C", "Autre"]


def test_merging_that_gains_nothing_stops(spark):
    def same(prompt):
        names = [x[2:] for x in prompt.split("\nThemes:\n")[1].splitlines()]
        return json.dumps({"categories": names, "mapping": {n: n for n in names}})

    with pytest.raises(ValueError, match="nothing is gained"):
        harmonize(themes_of(spark, list("abcdef")), answer_with(same), themes_per_call=2)


def test_mapping_is_applied_with_autre_for_the_rest(spark):
    df = analyses_of(spark, ("a", "neutre"), ("q", "neutre"))
    assert rows(apply_mapping(df, mapping_of(spark, {"a": "X"})).select("theme", "macro_theme")) == [
        ("a", "X"), ("q", "Autre")
    ]


def test_lookup_spreads_hot_keys_without_changing_rows(spark):
    facts = spark.range(0, 400, 1, 4).selectExpr(
        "id", "case when id % 3 = 0 then 'hot' when id % 7 <> 0 then concat('k', id % 50) end as k"
    )
    table = write_table(spark.createDataFrame(
        [("hot", 1)] + [(f"k{i}", i) for i in range(0, 50, 2)], "k string, v int"), "t")
    plain = facts.join(table, "k", "left").select("id", "k", "v")
    spread = lookup(facts, table, "k", hot_rows=20, broadcast_rows=0)
    assert rows(spread.select("id", "k", "v")) == rows(plain)
    copies = spark.range(0, 300, 1, 4).selectExpr("'hot' as k")
    spread = lookup(copies, table, "k", hot_rows=20, broadcast_rows=0)
    assert rows(spread.groupBy("k", "v").count()) == [("hot", 1, 300)]
    assert rows(lookup(facts, table, "k").select("id", "k", "v")) == rows(plain)


def distribution_of(spark, analyses, mapping, names):
    return theme_distribution(
        macro_tallies(theme_tallies(analyses), mapping), categories_of(spark, names))


def test_counts_and_ranking(spark):
    analyses = analyses_of(
        spark, ("t3", "neutre"), ("t2", "positif"), ("t1", "négatif"), ("t1", "positif"), ("t4", "neutre"),
    )
    mapping = mapping_of(spark, {"t1": "A", "t2": "Out", "t3": "Late", "t4": "B"})
    d = distribution_of(spark, analyses, mapping, ["B", "Empty", "A"])
    assert rows(d.select("macro_theme", "total", "positif", "negatif", "neutre")) == [
        ("A", 2, 1, 1, 0), ("B", 1, 0, 0, 1), ("Empty", 0, 0, 0, 0), ("Late", 1, 0, 0, 1), ("Out", 1, 1, 0, 0),
    ]
    # ties: category order first, then the first row of macro themes outside the list
    assert [r["macro_theme"] for r in rank_by_volume(d).orderBy("rank").collect()] == ["A", "B", "Late", "Out", "Empty"]
    assert rows(global_sentiment(analyses)) == [("neutre", 2), ("négatif", 1), ("positif", 2)]
    assert [r["pct"] for r in global_shares(global_sentiment(analyses)).orderBy("n").collect()] == [20.0, 40.0, 40.0]
    assert ("A", "négatif", 1, 50.0) in rows(sentiment_shares(d))
    assert ("Empty", 0, 0.0) in rows(category_shares(d))
    assert theme_tallies(analyses).where("theme = 't1'").first()["first_row"] == 2


def test_report_lines_match_the_printed_form(spark):
    n = {"A": (9, 4, 3), "Long name": (0, 1, 0)}
    cells = [(t, s) for t, c in n.items() for s, k in zip(["positif", "négatif", "neutre"], c) for _ in range(k)]
    analyses = analyses_of(spark, *cells)
    d = distribution_of(spark, analyses, mapping_of(spark, {t: t for t in n}), ["A", "Vide"])
    total = len(cells)
    want = [f"Total verbatims analysés : {total}"]
    for i, s in enumerate(["positif", "négatif", "neutre"]):
        k = sum(c[i] for c in n.values())
        p = k / total * 100
        want.append(f"  {s:<10} : {p:>5.1f}% ({k:>3})  " + "█" * int(p // 5))
    for cat in ["A", "Long name", "Vide"]:
        c = n.get(cat, (0, 0, 0))
        p = sum(c) / total * 100
        want.append(f"{cat:<30} | Total: {sum(c):>3} ({p:>5.1f}%)")
        for s, k in zip(["positif", "négatif", "neutre"], c):
            if k:
                p = k / sum(c) * 100
                want.append(f"    - {s:<10} : {p:>5.1f}% ({k:>2}) " + "░" * int(p // 10))
    assert [r["line"] for r in report_lines(d).orderBy("line_no").collect()] == want


def test_empty_input(spark):
    analyses = analyses_of(spark, ("t", "neutre")).where("false")
    d = distribution_of(spark, analyses, mapping_of(spark, {"t": "A"}), ["A"])
    assert rows(global_sentiment(analyses)) == [("neutre", 0), ("négatif", 0), ("positif", 0)]
    assert rows(d.select("macro_theme", "total")) == [("A", 0)]
    assert report_lines(d).count() == 0 and sentiment_shares(d).count() == 0
    assert category_shares(d).first()["pct"] is None


def test_the_report_row_holds_counts_only(spark):
    analyses = analyses_of(spark, ("a", "neutre"), ("b", "positif"))
    d = distribution_of(spark, analyses, mapping_of(spark, {"a": "X", "b": "X"}), ["X"])
    doc = report_document(d, "f")
    assert doc.columns == ["metadata", "global_sentiment", "theme_distribution"]
    assert doc.first()["theme_distribution"]["X"]["total"] == 2


def test_several_calls_lose_no_name(spark):
    """Values outside the categories, and keys nobody asked about, survive a merge."""
    def transport(prompt):
        names = [x[2:] for x in prompt.split("\nThemes:\n")[1].splitlines()]
        mapping = {n: ("Hors" if n.endswith("0") else "A") for n in names if n.startswith("t")}
        mapping.update({n: n for n in names if n in ("A", "Hors")}, extra="E")
        return json.dumps({"categories": ["A"], "mapping": mapping})

    names = [f"t{i:02d}" for i in range(30)]
    want = {**{n: ("Hors" if n.endswith("0") else "A") for n in names}, "extra": "E"}
    for per_call in (100, 4):
        found = harmonize(themes_of(spark, names), answer_with(transport), themes_per_call=per_call, wait=no_wait)
        assert dict(found.mapping.collect()) == want
        assert [r["category"] for r in found.categories.collect()] == ["A"]


def test_a_failing_chunk_is_asked_again(spark, folder):
    names = [f"{c}{i:03d}" for c in "abc" for i in range(20)]
    good, asked = answer_with(first_letters()), []

    def answers(prompts, attempt):
        asked.append((attempt, sorted(r["chunk"] for r in prompts.collect())))
        bad = (F.col("chunk") == 2) & F.lit(attempt == 0 and len(asked) == 1)
        return good(prompts, attempt).withColumn("raw", F.when(~bad, F.col("raw")))

    waited = []
    found = harmonize(themes_of(spark, names), answers, themes_per_call=25, wait=waited.append, at=f"{folder}/kept")
    assert asked == [(0, [0, 1, 2]), (1, [2])] or asked[:2] == [(0, [0, 1, 2]), (1, [2])]
    assert waited[:1] == [2] and found.mapping.count() == 60

    def never(prompts, attempt):
        raise AssertionError("asked again")

    again = harmonize(themes_of(spark, names), never, themes_per_call=25, wait=waited.append, at=f"{folder}/kept")
    assert rows(again.mapping) == rows(found.mapping)
