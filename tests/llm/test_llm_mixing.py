"""Mixing sources: targets, cuts and copies against brute force."""

from collections import Counter, defaultdict

import pytest

from conftest import SF
from voxlake.llm import mixing
from voxlake.llm.queries import QUERIES


def frame(spark, rows):
    extra = "key string, size int, rank double, bucket int, whole int, doc int, copies int"
    return spark.createDataFrame(
        [(*r, "k", 1, 0.5, 2, 3, 4, 5) for r in rows], f"doc_id long, text string, source string, {extra}"
    )


def water_filled(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what a source cannot take is shared again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, free, left = {}, set(order), sum(sizes.values())
    while free:
        share = left / sum(weight[s] for s in free)
        above = [s for s in free if share * weight[s] > most * sizes[s]]
        if not above:
            target.update({s: share * weight[s] for s in free})
            break
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def sized(rows):
    return [(i, len((t or "").encode().split()), s) for i, t, s in rows]


CASES = {
    "even": [(i, "w " * (i % 9 + 1), f"s{i % 4}") for i in range(400)],
    "capped": [(i, "w " * 5, "a" if i < 3 else "b" if i < 6 else "c") for i in range(300)],
    "null source": [(i, "w " * (i % 5), None if i % 3 else "z") for i in range(200)],
    "one source": [(i, "w w", "a") for i in range(50)],
}


@pytest.mark.parametrize("name", CASES)
def test_targets_and_takes(spark, name):
    rows = CASES[name]
    got = mixing.mix_sources(frame(spark, rows)).collect()
    sizes, source = defaultdict(int), {}
    for i, n, s in sized(rows):
        sizes[s] += n
        source[i] = s
    target = water_filled(sizes)
    words = defaultdict(int)
    largest = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert r.target == pytest.approx(target[s]) and r.source_size == sizes[s]
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        words[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(words[s] - target[s]) <= largest[s]


def test_reruns_and_layouts_agree(spark):
    rows = CASES["even"]
    one = mixing.mix_sources(frame(spark, rows)).collect()
    two = mixing.mix_sources(frame(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(one) == sorted(two)
    other = mixing.mix_sources(frame(spark, rows), seed=2).collect()
    assert sorted(one) != sorted(other)


def test_mixed_documents_are_what_is_taken(spark):
    rows = CASES["even"]
    df = frame(spark, rows)
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix_sources(df).collect()}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: n for i, n in taken.items() if n})


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "w " * 100_000, "a"), (4, "x y", None), (4, "x y", None),
            (None, "p q r", "b"), (None, "p q r", "b"), (5, " \n", "b"), (6, "é é", "c")]
    got = mixing.mix_sources(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == sorted((i or 0, n) for i, n, _ in sized(rows))
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert mixing.mixed_documents(frame(spark, rows)).count() > 0
    assert mixing.mix_sources(frame(spark, [])).collect() == []
    assert mixing.mix_sources(frame(spark, [(1, None, None), (2, "", None)])).collect()[0].taken == 0


def test_longer_texts_are_taken_more_often(spark):
    rows = [(i, "w " * (1 if i % 2 else 500), "abc"[i % 3]) for i in range(3_000)]
    got = mixing.mix_sources(frame(spark, rows)).collect()
    rate = {n: sum(r.taken for r in got if r.size == n) / sum(r.size for r in got if r.size == n) for n in (1, 500)}
    assert rate[500] > rate[1]


def test_query(spark):
    got = QUERIES["op8_source_mixing"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    per_source = (
        got.join(docs.select("doc_id", "source"), "doc_id").groupBy("source")
        .agg({"taken": "sum", "target": "max", "size": "max", "source_size": "max"}).collect()
    )
    for r in per_source:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= r["max(size)"]
