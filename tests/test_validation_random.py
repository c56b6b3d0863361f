"""Validation of random answers against a plain restatement of the rules."""

import json
import random

from pyspark.sql import functions as F

from voxlake.operators.batching import assign_batches, group_batches
from voxlake.operators.responses import first_accepted, parse_answers
from voxlake.operators.validation import batch_errors, batch_tallies, check_batches, valid_analyses

THEMES = ["prix", "", " \t", "a b c d e", "a b c d e f", "un deux\x1ftrois　quatre cinq six"]
SUMMARIES = ["bonne phrase", "1234", "12345", " 1234 ", "　12345", ""]
SIZE = 6


def random_answer(rng, ids):
    return [
        {
            "verbatim_id": rng.choice(ids + ["ghost"]),
            "theme": rng.choice(THEMES[:1] * 6 + THEMES),
            "summary": rng.choice(SUMMARIES[:1] * 6 + SUMMARIES),
            "sentiment": rng.choice(["positif", "négatif", "neutre"]),
        }
        for _ in range(rng.randint(0, SIZE + 2))
    ]


def expected(sent, answer):
    """(valid rows, issues per bad item, missing ids, count mismatch)"""
    origin = {i: (t, s) for i, t, s in sent}
    valid, bad, seen = [], [], set()
    for pos, item in enumerate(answer):
        vid, words = item["verbatim_id"], len(item["theme"].split())
        kinds = []
        if vid in seen:
            kinds.append("ID dupliqué")
        seen.add(vid)
        if vid not in origin:
            kinds.append("ID inconnu")
        if words == 0:
            kinds.append("Thème vide")
        elif words > 5:
            kinds.append("Thème trop long")
        if len(item["summary"].strip()) < 5:
            kinds.append("Résumé trop court")
        if kinds:
            bad.append((vid, kinds))
        else:
            valid.append((pos, vid, *origin[vid]))
    return valid, bad, sorted(set(origin) - seen), len(answer) != len(sent)


def test_random_batches(spark):
    rng = random.Random(5)
    rows, answers, want = [], [], {}
    for b in range(300):
        ids = [f"v{b}_{rng.randint(0, SIZE)}" for _ in range(SIZE)]  # some ids repeat
        sent = [(i, f"text {b}.{n}", f"s{n}") for n, i in enumerate(ids)]
        answer = random_answer(rng, ids)
        rows += [(i, t, s, "fr") for i, t, s in sent]
        answers.append((b, 0, json.dumps({"analyses": answer}, ensure_ascii=rng.random() < 0.5)))
        want[b] = expected(sent, answer)

    verbatims = spark.createDataFrame(rows, "id string, text string, source string, lang string")
    batches = group_batches(assign_batches(verbatims.coalesce(1), SIZE))
    raw = spark.createDataFrame(answers, "batch_idx bigint, attempt int, raw string")
    checked = check_batches(first_accepted(parse_answers(raw)), batches).cache()

    valid = {b: [] for b in want}
    for r in valid_analyses(checked).orderBy("batch_idx", "pos").collect():
        valid[r["batch_idx"]].append((r["pos"], r["verbatim_id"], r["texte_original"], r["source"]))
    assert valid == {b: w[0] for b, w in want.items()}

    bad = {b: [] for b in want}
    missing, mismatch = {}, set()
    for e in batch_errors(checked).collect():
        if e["type"] == "item_validation":
            kinds = [i.split(":")[0].split(" (")[0] for i in e["issues"]]
            bad[e["batch_idx"]].append((e["verbatim_id"], kinds))
        elif e["type"] == "missing_verbatims":
            missing[e["batch_idx"]] = e["missing_ids"]
        else:
            mismatch.add(e["batch_idx"])
    assert bad == {b: w[1] for b, w in want.items()}
    assert missing == {b: w[2] for b, w in want.items() if w[2]}
    assert mismatch == {b for b, w in want.items() if w[3]}

    none = checked.where("false").select("batch_idx", F.lit("").alias("type"), F.lit("").alias("error"))
    tallies = {r["batch_idx"]: (r["n_valid"], r["n_errors"]) for r in batch_tallies(checked, none).collect()}
    assert tallies == {b: (len(w[0]), len(w[1]) + bool(w[2]) + w[3]) for b, w in want.items()}
