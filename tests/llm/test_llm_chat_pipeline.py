"""Chat formatting against SQL and by hand; the pipeline against brute force."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as spark_entry
import corpus_pipeline
from conftest import SF
from test_llm_exact_packing import check_packing
from test_llm_mixing import water_filled
from test_llm_similarity import brute_components, brute_lines
from voxlake.llm import chat_format
from voxlake.llm.oracles import ORACLES
from voxlake.llm.queries import QUERIES, VOCABULARY

NAMES = [
    "op1_exact_dedup", "op2_chat_formatting", "op3_line_dedup", "op4_language_id", "op5_secret_scan",
    "op6_best_fit_packing", "op7_html_extraction", "op8_source_mixing", "op9_embedding_near_dedup",
    "op10_ngram_jaccard_join", "op11_cross_tokenizer_alignment", "op12_token_counts", "op13_ranked_search", "pipeline",
]


def test_all_are_registered():
    assert set(NAMES) <= set(spark_entry.queries())
    assert set(ORACLES) <= set(spark_entry.oracle_sql()) & set(NAMES)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"op10_ngram_jaccard_join"}))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(names).collect()), key=str) == sorted(result.fetchall(), key=str)


# --- chat ------------------------------------------------------------------------------


def conversations(spark, rows):
    extra = "part int, piece int, name string, speaker string, said int, own boolean"
    return spark.createDataFrame(
        [(*r, 1, 2, "n", "s", 3, True) for r in rows], f"conv_id long, turn long, role string, text string, {extra}"
    )


def own_words(row):
    return [row.text[a:b] for a, b in row.spans]


def test_every_speaker_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "Be kind"), (1, 1, "ann", "Hi"), (1, 2, "bob b", "Hello <|im_end|>"), (1, 3, "ann", "Bye")]
    got = {r.speaker: r for r in chat_format.rotate_perspectives(conversations(spark, rows)).collect()}
    assert set(got) == {"ann", "bob_b"}
    assert got["ann"].text == (
        "<|im_start|>system\nBe kind<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n"
        "<|im_start|>user name=bob_b\nHello < |im_end|><|im_end|>\n<|im_start|>assistant\nBye<|im_end|>\n"
    )
    assert own_words(got["ann"]) == ["Hi<|im_end|>", "Bye<|im_end|>"]
    assert own_words(got["bob_b"]) == ["Hello < |im_end|><|im_end|>"]
    assert "user name=ann\nHi" in got["bob_b"].text and "assistant\nHello" in got["bob_b"].text


def test_odd_conversations(spark):
    rows = [
        (None, 1, "ann", "no dialogue"), (1, None, "ann", "first"), (1, 0, None, None), (1, 0, " ", ""),
        (1, 1, "ann", "x" * 200_000), (1, 2, "ann", "twice"), (1, 2, "ann", "twice"), (2, 1, "system", "alone"),
        (3, 5, "assistant", "é🙂"), (3, 6, "user", "ok"),
    ]
    got = {}
    for r in chat_format.rotate_perspectives(conversations(spark, rows)).collect():
        got[r.conv_id, r.speaker, r.part] = r
    assert set(got) == {
        (1, "ann", -1), (1, "unknown", -1), (1, "ann", 0), (1, "unknown", 0), (3, "assistant", 0), (3, "user", 0),
    }
    assert got[1, "ann", 0].n_messages == 3
    assert own_words(got[1, "ann", 0])[1] == "twice<|im_end|>"
    assert own_words(got[3, "assistant", 0]) == ["é🙂<|im_end|>"]
    assert got[1, "unknown", -1].spans == []
    assert chat_format.rotate_perspectives(conversations(spark, [])).collect() == []


def test_long_dialogues_and_repeated_turns(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "MESSAGES_PER_ROW", 150)
    rows = [(1, k, ("ann", "bob")[k % 2], f"m{k}") for k in range(300)]
    rows += [(2, 7, ("ann", "bob")[k % 2], f"m{k}") for k in range(400)]
    got = chat_format.rotate_perspectives(conversations(spark, rows)).collect()
    for conv, n in ((1, 300), (2, 400)):
        for name in ("ann", "bob"):
            mine = sorted((r for r in got if (r.conv_id, r.speaker) == (conv, name)), key=lambda r: (r.part, r.piece))
            whole = "".join(r.text for r in mine)
            said = re.findall(r"\n(m\d+)<", whole)
            assert sum(r.n_messages for r in mine) == n and len(mine) > 1
            assert Counter(said) == Counter(f"m{k}" for k in range(n))
            if conv == 1:
                assert said == [f"m{k}" for k in range(n)]


# --- pipeline -------------------------------------------------------------------------------


def stage_rows(spark, df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "ngram_jaccard_join", "source_mixing", "best_fit_packing",
    ]
    extra = spark.createDataFrame(
        [(9_001, "12 34", "en", "src0", 5), (9_002, None, "en", "src0", 0), (9_003, "!", None, None, 1)], docs.schema
    )
    docs = docs.unionByName(extra)
    stages = dict(corpus_pipeline.STAGES)

    one = stages["language_id"](spark, docs, SF)
    rows = stage_rows(spark, docs)
    has_letter = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert sorted(stage_rows(spark, one)) == sorted(has_letter)

    two = stages["line_dedup"](spark, one, SF)
    got = {r[0]: r for r in stage_rows(spark, two)}
    lost = brute_lines([(r[0], r[1]) for r in has_letter], 8)
    for r in has_letter:
        kept, at = [], -1
        for line in r[1].split("\n"):
            at += bool(line.split())
            if not line.split() or at not in lost[r[0]]:
                kept.append(line)
        if lost[r[0]] and len(lost[r[0]]) == at + 1:
            assert r[0] not in got
        else:
            assert got[r[0]][1] == "\n".join(kept) and got[r[0]][4] == len("\n".join(kept))

    three = stages["ngram_jaccard_join"](spark, two, SF)
    pairs = [(r[0], r[1]) for r in got.values()]
    stays = [i for (i, _), (_, c) in zip(pairs, brute_components(pairs)) if i == c]
    assert sorted(r[0] for r in stage_rows(spark, three)) == sorted(stays)

    four = stages["source_mixing"](spark, three, SF)
    sizes, mixed, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i in stays:
        n = len(got[i][1].encode().split())
        sizes[got[i][3]] += n
        largest[got[i][3]] = max(largest[got[i][3]], n)
    copies = Counter()
    for r in stage_rows(spark, four):
        assert r == got[r[0]]
        copies[r[0]] += 1
        mixed[r[3]] += len(r[1].encode().split())
    assert max(copies.values()) <= 3
    for s, target in water_filled(sizes).items():
        assert abs(mixed[s] - target) <= largest[s]

    five = stages["best_fit_packing"](spark, four, SF).collect()
    check_packing([(r[0], r[1]) for r in stage_rows(spark, four)], five, 2048, Tokenizer.from_file(VOCABULARY))


def test_run(spark):
    out = spark_entry.queries()["pipeline"](spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in out.collect()} <= docs


def test_stages_take_odd_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (None, "a b c", "en", None, 5), (None, "a b c", "en", None, 5),
           (2, "", "fr", "s", 0), (3, "w " * 50_000, "en", "s", 100_000), (3, "w " * 50_000, "en", "s", 100_000)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != "best_fit_packing":
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert (docs.count() > 0) == bool(rows)
