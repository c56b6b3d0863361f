"""N-gram Jaccard join, line dedup and embedding near-dedup against brute force."""

import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from conftest import SF
from voxlake.llm import common, embedding_dedup, line_dedup, ngram_join
from voxlake.llm.oracles import ORACLES
from voxlake.llm.queries import QUERIES
from voxlake.llm.shingles import Shingler, set_key


def documents(spark, rows, parts=3):
    extra = "key string, n int, token int, u int, v int, place int, line int, component int, gone_id int, n_lines int"
    made = [(*r, "k", *range(9)) for r in rows]
    return spark.createDataFrame(made, f"doc_id long, text string, {extra}").repartition(parts)


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4))


def brute_components(rows, percent=80):
    """By place in `rows`: (size, smallest id reachable)."""
    sets = [shingles(t) for _, t in rows]
    union = Union(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                union.join(a, b)
    smallest = {}
    for k, (doc_id, _) in enumerate(rows):
        r = union.find(k)
        ids = [i for i in (smallest.get(r), doc_id) if i is not None]
        smallest[r] = min(ids) if ids else None
    return [(len(s), smallest[union.find(k)] if s else rows[k][0]) for k, s in enumerate(sets)]


def near_copies(seed, groups=6, members=25, common=True):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for g in range(groups):
        base = [word() for _ in range(rng.randint(5, 200))]
        for _ in range(members):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                text[rng.randrange(len(text))] = word()
            text = " ".join(text)
            if common and rng.random() < 0.3:
                text = f"{text}\n{passage}"
            rows.append((rng.randrange(10**6), text))
    for _ in range(40):
        rows.append((rng.randrange(10**6), passage + " " + " ".join(word() for _ in range(rng.randint(1, 80)))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, frequent, centres, block", [
    (1, 64, 8, 2_000_000), (2, 4, 2, 2_000_000), (3, 3, 1, 3_000), (4, 64, 3, 500),
])
def test_components(spark, monkeypatch, seed, frequent, centres, block):
    """Few centres, small blocks and a low frequency bound reach every path."""
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "CENTRES", centres)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", block)
    rows = near_copies(seed)
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(documents(spark, rows)).collect())
    assert got == sorted((i, *want) for (i, _), want in zip(rows, brute_components(rows)))


def test_components_of_odd_documents(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "a b c d"), (7, "a b c d"),
        (8, "w " * 50_000), (9, "W\tw " * 30_000), (None, "null id of five words here"),
        (3_000, "null id of five words here"), (None, "alone with a null id and more"),
        (None, "alone with a null id and more"), (10, "same row twice in the table"),
        (10, "same row twice in the table"), (11, "É is not lowered to é here"), (12, "é is not lowered to é here"),
        (13, "a\x1cb c\x1cd e f g h"), (14, "a b c d e f g h"),
    ]
    got = sorted((tuple(r) for r in ngram_join.jaccard_components(documents(spark, rows)).collect()), key=str)
    want = sorted(((i, *w) for (i, _), w in zip(rows, brute_components(rows))), key=str)
    assert got == want
    assert ngram_join.jaccard_components(documents(spark, [])).collect() == []
    kept = ngram_join.kept_documents(documents(spark, rows))
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    gone = {i for (i, _), (_, c) in zip(rows, brute_components(rows)) if i is not None and i != c}
    assert ids == sorted((i for i, _ in rows if i not in gone), key=str)
    assert len(kept.columns) == 12


def test_lists_with_large_sums_of_hashes(spark, monkeypatch):
    """Five keys with the largest hashes stand for a million with usual ones."""
    monkeypatch.setattr(ngram_join.F, "shiftrightunsigned", lambda *_: ngram_join.F.lit(2**62))
    prefixes = spark.createDataFrame(
        [(True, token, key, 9, 1) for token in (1, 2) for key in range(5)],
        "a boolean, token long, key long, n int, unshared int",
    )
    sets = spark.createDataFrame([(key, 0) for key in range(5)], "key long, parity int")
    got = ngram_join._posting_lists(prefixes, sets).select("list", "key").collect()
    assert sorted(map(tuple, got)) == [(1, key) for key in range(5)]


def test_jaccard_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(ORACLES["op10_ngram_jaccard_join"]).fetchall())
    got = sorted(tuple(r) for r in QUERIES["op10_ngram_jaccard_join"](spark, SF).collect())
    assert got == want


def test_shingles_are_sets():
    make = Shingler(remembered=2)
    assert len(make("a b c d e a b c d e a")) == 5
    assert set_key(make("X y z")) == set_key(make("x  Y\nz")) != set_key(make("x y"))
    assert len(make(None)) == len(make(" ")) == 0


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_connected_components(spark, shape):
    rng = random.Random(5)
    n = 60
    edges = {
        "path": [(k, k + 1) for k in range(n)], "star": [(n, k) for k in range(n)],
        "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(50)],
    }[shape]
    union = Union(range(100))
    for a, b in edges:
        union.join(a, b)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = common.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == {x: union.find(x) for x in nodes}
    assert common.components(spark.createDataFrame([], "u long, v long")).collect() == []


# --- line dedup --------------------------------------------------------------------------

BLOCK = "one two three four five\nsix seven eight nine"
SHORT = "just three words"


def test_line_dedup_cases(spark):
    rows = [
        (1, f"start\n{BLOCK}\nend of one"),
        (2, f"other\n{BLOCK}\nend of two"),  # block goes
        (3, f"{SHORT}\nown words of three"), (4, f"{SHORT}\nown words of four"),  # too short
        (5, f"x y z\n  six  seven eight nine\none two three four five"),  # other order: no block of 8 words
        (6, f"\n\nlast\n\none two three four five\n\nsix seven\teight nine\n"),  # blanks and spaces do not count
        (7, None), (8, ""), (9, BLOCK), (None, BLOCK), (10, f"twice\n{BLOCK}"), (10, f"id\n{BLOCK}"),
    ]
    got = {}
    for r in line_dedup.dedup_lines(documents(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_deleted))
    assert got[1] == [(rows[0][1], 4, 0)]
    assert got[2] == [("other\nend of two", 4, 2)]
    assert got[3] == [(rows[2][1], 2, 0)] and got[4] == [(rows[3][1], 2, 0)]
    assert got[5] == [(rows[4][1], 3, 0)]
    assert got[6] == [("\n\nlast\n\n\n", 3, 2)]
    assert got[7] == [(None, 0, 0)] and got[8] == [("", 0, 0)]
    assert got[9] == [("", 2, 2)]
    assert got[None] == [(BLOCK, 2, 0)]
    assert sorted(t for t, _, _ in got[10]) == sorted([rows[10][1], rows[11][1]])


def test_line_dedup_of_nothing_and_of_long_texts(spark):
    assert line_dedup.dedup_lines(documents(spark, [])).collect() == []
    text = "\n".join(f"line number {k} of a very long text" for k in range(20_000))
    out = {r.doc_id: r for r in line_dedup.dedup_lines(documents(spark, [(1, text), (2, text), (3, "a")])).collect()}
    assert (out[1].n_deleted, out[2].n_deleted, out[2].text) == (0, 20_000, "")
    assert len(out[1]) == 13  # n_lines was there already and is replaced


def plain_lines(text):
    return [" ".join(x.split()) for x in text.split("\n") if x.split()]


def brute_lines(rows, block_words):
    """Places of later documents in common blocks, by comparing all pairs from every pair of lines."""
    lost = defaultdict(set)
    texts = [(i, plain_lines(t)) for i, t in sorted(rows)]
    where = []
    for _, lines in texts:
        at = defaultdict(list)
        for a, line in enumerate(lines):
            at[line].append(a)
        where.append(at)
    for k, (later, new) in enumerate(texts):
        for (_, old), at in zip(texts[:k], where):
            for b, line in enumerate(new):
                for a in at.get(line, ()):
                    if a and b and old[a - 1] == new[b - 1]:
                        continue  # within a run that began before
                    n = 0
                    while a + n < len(old) and b + n < len(new) and old[a + n] == new[b + n]:
                        n += 1
                    if sum(len(x.split()) for x in new[b:b + n]) >= block_words:
                        lost[later].update(range(b, b + n))
    return lost


def test_line_dedup_random(spark):
    """Lines are distinct within a text here, so alignment and all common runs agree."""
    rng = random.Random(8)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 9))) + f" {k}" for k in range(400)]
    rows = []
    for i in range(60):
        lines = []
        while len(lines) < 12:
            start = rng.randrange(390)
            lines += pool[start:start + rng.randint(1, 5)]
        rows.append((i, "\n".join(dict.fromkeys(lines))))
    lost = brute_lines(rows, line_dedup.BLOCK_WORDS)
    found = line_dedup.repeated_lines(documents(spark, rows)).collect()
    assert {r.doc_id: set(r.places) for r in found} == {k: v for k, v in lost.items() if v}


def test_moved_blocks_are_found_again():
    matches = [(k, k + 10, 5) for k in range(3)] + [(k, k - 10, 4) for k in range(10, 13)]
    assert sorted(line_dedup.common_blocks(matches, 8)) == [0, 1, 2, 10, 11, 12]


def test_line_dedup_of_repeated_lines(spark):
    """Plain lines are compared, however often they stand in a text."""
    rng = random.Random(4)
    pool = ["}", "else {", "la la la", "a refrain of six words here", "one line of nine words that may stand twice"]
    pool += [f"line {k} of it" for k in range(12)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    rows += [(100, f"new\n{pool[4]}\nand\n{pool[4]}")]
    found = line_dedup.repeated_lines(documents(spark, rows)).collect()
    lost = defaultdict(set)
    texts = [(i, t.split("\n")) for i, t in rows]
    for k, (later, new) in enumerate(texts):
        for _, old in texts[:k]:
            for a in range(len(old)):
                for b in range(len(new)):
                    n = 0
                    while a + n < len(old) and b + n < len(new) and old[a + n] == new[b + n]:
                        n += 1
                    if len(" ".join(new[b:b + n]).split()) >= line_dedup.BLOCK_WORDS:
                        lost[later].update(range(b, b + n))
    assert {r.doc_id: set(r.places) for r in found} == lost and lost[100] == {1, 3}


def test_line_dedup_query(spark):
    got = {r.doc_id: r.text for r in QUERIES["op3_line_dedup"](spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got.keys() == docs.keys()
    lost = brute_lines(list(docs.items()), line_dedup.BLOCK_WORDS)
    assert any(lost.values())
    for i, text in docs.items():
        kept, at = [], -1
        for line in text.split("\n"):
            at += bool(line.split())
            if not line.split() or at not in lost[i]:
                kept.append(line)
        assert got[i] == "\n".join(kept) or len(lost[i]) == at + 1 and not got[i].split()


# --- embeddings ----------------------------------------------------------------------------


def brute_links(rows, cosine=0.9):
    vectors = {}
    for k, (_, v) in enumerate(rows):
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v, float) / max(abs(x) for x in v)
            vectors[k] = v / np.linalg.norm(v)
    links = defaultdict(int)
    union = Union(range(len(rows)))
    for a in vectors:
        for b in vectors:
            if a < b and len(vectors[a]) == len(vectors[b]) and vectors[a] @ vectors[b] >= cosine:
                links[a] += 1
                links[b] += 1
                union.join(a, b)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        r = union.find(k)
        ids = [x for x in (smallest.get(r), i) if x is not None]
        smallest[r] = min(ids) if ids else None
    return [(i, links[k], smallest[union.find(k)]) for k, (i, _) in enumerate(rows)]


def embeddings(spark, rows, kind="float"):
    made = [(i, v, 1, 2, 3) for i, v in rows]
    return spark.createDataFrame(made, f"vec_id long, embedding array<{kind}>, class int, weight int, list int")


def clustered(seed, noise):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(40):
        base = rng.normal(size=64)
        for _ in range(rng.integers(1, 12)):
            rows.append((base + noise * rng.normal(size=64)).astype(np.float32).tolist())
    hot = rng.normal(size=64)
    rows += [(hot + 0.05 * rng.normal(size=64)).astype(np.float32).tolist() for _ in range(300)]
    return [(int(i), v) for i, v in zip(rng.permutation(len(rows)), rows)]


@pytest.mark.parametrize("noise, block", [(0.1, 2048), (0.3, 64)])
def test_near_duplicates(spark, monkeypatch, noise, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "GROUP_ROWS", 2_000)
    rows = clustered(4, noise)
    want = {i: (n, c) for i, n, c in brute_links(rows)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(embeddings(spark, rows)).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)
    recall = sum(n for n, _ in got.values()) / sum(n for n, _ in want.values())
    assert recall >= 0.97


def test_recall_close_to_the_threshold(spark):
    """Pairs in random directions with cosines just above 0.9, the hardest case."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(400):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        y = rng.normal(size=64)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        rows += [(2 * k, x.tolist()), (2 * k + 1, (0.91 * x + (1 - 0.91**2) ** 0.5 * y).tolist())]
    got = embedding_dedup.near_duplicates(embeddings(spark, rows, "double")).collect()
    assert sum(r.n_links for r in got) >= 0.9 * sum(n for _, n, _ in brute_links(rows))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]),
        (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, None]), (10, [1.0, 0.0, 0.0]), (11, [1e30, 0.0]),
        (None, [-1.0, 0.0]), (None, [-2.0, 0.0]), (12, [-0.0, -3.0]), (13, [0.0, -3.0]),
    ]
    for kind in ("float", "double"):
        got = embedding_dedup.near_duplicates(embeddings(spark, rows, kind)).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == sorted(brute_links(rows), key=str)
        assert all(r.kept == (r.component_id is None or r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.near_duplicates(embeddings(spark, [])).collect() == []


def test_embedding_query(spark):
    got = QUERIES["op9_embedding_near_dedup"](spark, SF)
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == sorted(brute_links(rows))
