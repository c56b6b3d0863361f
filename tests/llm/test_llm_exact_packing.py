"""Exact dedup and packing against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF
from voxlake.llm import exact_dedup, packing
from voxlake.llm.queries import QUERIES, VOCABULARY
from voxlake.llm.vocabularies import vocabulary

ODD = [
    (1, "a  b"), (2, "a b"), (3, "a\tb"), (4, None), (5, ""), (6, " "), (7, "  \n"),
    (8, "x" * 300_000), (9, "x" * 300_000), (10, "a b"), (10, "a b"), (None, "a b"),
    (None, "only nulls"), (None, "only nulls"), (11, "a b"),
]


def odd(spark, rows=ODD):
    """Null, empty, long and repeated rows, with columns whose names the operators use."""
    extra = ["hash", "row", "keep_id", "n", "size", "key", "length", "split"]
    schema = "doc_id long, text string, " + ", ".join(f"{c} int" for c in extra)
    return spark.createDataFrame([(*r, *range(len(extra))) for r in rows], schema)


def brute_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    return groups


@pytest.mark.parametrize("clashing", [False, True])
def test_exact_duplicates(spark, clashing):
    hashes = {"content_hash": lambda c: F.length(c).cast("string")} if clashing else {}
    got = exact_dedup.exact_duplicates(odd(spark), **hashes).collect()
    groups = brute_groups(ODD)
    want = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            want[i, min(known) if known else None, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_duplicates_of_nothing(spark):
    assert exact_dedup.exact_duplicates(odd(spark, [])).collect() == []


def test_groups_larger_than_a_salt(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "ROWS_PER_SALT", 10)
    rows = [(i, "same") for i in range(200)] + [(i, "sane") for i in range(200, 260)]
    for hashes in ({}, {"content_hash": lambda c: F.lit("0")}):
        got = exact_dedup.exact_duplicates(odd(spark, rows), **hashes).collect()
        assert {(r.keep_id, r.group_size) for r in got} == {(0, 200), (200, 60)}
        assert sorted(r.doc_id for r in got if r.kept) == [0, 200]


# --- packing ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def encode():
    return lambda text: vocabulary(VOCABULARY).ids(text).tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(
    st.sampled_from(list(" \n\t\x0b\x1c\x85\xa0 'sStTdlveRE09.,!éß中🙂́")), st.characters(exclude_categories=["Cs"])
), max_size=60))
def test_ids_are_those_of_tokenizers(tokenizer, encode, text):
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encode(text), "<u4").tolist() == want


def test_special_tokens_in_a_text(tokenizer, encode):
    text = "a <|endoftext|>b<|endoftext"
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encode(text), "<u4").tolist() == want


@pytest.mark.parametrize("n, want", [
    (1, [(0, 1)]), (10, [(0, 10)]), (11, [(0, 1), (1, 10)]), (20, [(0, 10), (10, 10)]),
    (25, [(0, 5), (5, 10), (15, 10)]),
])
def test_cut_pieces(n, want):
    assert packing.cut_pieces(n, 10) == want


def total(bins):
    held = Counter()
    for pattern, count in bins.items():
        for n, c in pattern:
            held[n] += c * count
    return held


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=12))
def test_search_keeps_all_pieces_and_never_needs_more_bins(counts):
    first = packing.best_fit(counts, 40)
    better = packing.improve(Counter(first), 40)
    for bins in (first, better):
        assert total(bins) == Counter(counts)
        assert max(packing._fill(p) for p in bins) <= 40
    assert sum(better.values()) <= sum(first.values())
    square = lambda bins: sum(packing._fill(p) ** 2 * c for p, c in bins.items())
    assert square(better) >= square(first)


def test_best_fit_decreasing_one_by_one():
    rng = np.random.default_rng(3)
    for _ in range(20):
        items = sorted(rng.integers(1, 50, 120).tolist(), reverse=True)
        bins: list[list[int]] = []
        for n in items:
            room = [(50 - sum(b), b) for b in bins if 50 - sum(b) >= n]
            min(room, key=lambda x: x[0])[1].append(n) if room else bins.append([n])
        got = packing.best_fit(dict(Counter(items)), 50)
        assert sum(got.values()) == len(bins)


def test_exchanges_empty_a_bin():
    # Best fit needs three bins of 10; swapping 4 for 3 and 3 leaves two full ones.
    bins = Counter({((6, 1), (3, 1)): 1, ((4, 1), (3, 1)): 1, ((4, 1),): 1})
    assert sum(packing.improve(bins, 10).values()) == 2


def check_packing(rows, pieces, capacity, tokenizer):
    """Every piece is where it should be, whole, and sequences are gapless."""
    docs = Counter()
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (start, n) in enumerate(packing.cut_pieces(len(ids), capacity)):
            docs[doc_id, k, start, n, zlib.crc32(ids[start:start + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == docs
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(sequences)


def test_pack_odd_documents(spark, tokenizer):
    rows = [r if len(r[1] or "") < 1000 else (r[0], "word and " * 3_000) for r in ODD]
    pieces = packing.pack_documents(odd(spark, rows).repartition(4), VOCABULARY, 64).collect()
    check_packing(rows, pieces, 64, tokenizer)
    assert packing.pack_documents(odd(spark, []), VOCABULARY).collect() == []


def test_packing_query(spark, tokenizer):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    pieces = QUERIES["op6_best_fit_packing"](spark, SF).collect()
    bins = check_packing(rows, pieces, 2048, tokenizer)
    least = -(-sum(r.length for r in pieces) // 2048)
    assert bins <= least + 1


def test_vocabulary_is_a_parameter():
    assert VOCABULARY == public_tokenizers.path("byte_bpe_50k.json")
