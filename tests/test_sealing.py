"""Answers that are sealed while a round runs: nothing sealed is asked again."""

import os
from collections import Counter
from itertools import islice

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxlake.operators.inference import answer_with, ask_in_rounds
from voxlake.operators.normalize import kept
from voxlake.operators.sealing import GROUP, Seals, ask, file_system, sealed
from voxlake.plans.analysis import checkpoint, run_analysis
from voxlake.plans.store import load_results
from voxlake.sources.readers import from_dataframe
from workload import transports

from conftest import no_wait


def logged(transport, folder, deadly=lambda prompt: False):
    """Notes every prompt that is asked, and kills the task over some, once each."""

    def noted(prompt):
        import hashlib
        import os
        import uuid

        name = hashlib.md5(prompt.encode()).hexdigest()
        with open(f"{folder}/{name}-{uuid.uuid4().hex}", "x"):
            pass
        if deadly(prompt):
            try:
                os.mkdir(f"{folder}/killed-{name}")
            except FileExistsError:
                pass
            else:
                raise type("Killed", (BaseException,), {})("killed")
        return transport(prompt)

    return noted


def asked(folder):
    return Counter(n.split("-")[0] for n in os.listdir(folder) if not n.startswith("killed"))


def frames(n, size):
    for start in range(0, n, size):
        some = range(start, min(start + size, n))
        yield pd.DataFrame({"k": list(some), "prompt": [f"prompt {i}" for i in some]})


@pytest.mark.parametrize("size, group, threads", [(7, 3, 1), (50, 4, 4), (1, 3, 1), (50, 100, 2)])
def test_a_task_that_runs_again_asks_the_rest(folder, size, group, threads):
    calls = []
    echo = lambda p: calls.append(p) or p.upper()
    first = ask(frames(50, size), echo, ["k"], threads, Seals(folder, 3, ["k"]), group)
    taken = sum(len(f) for f in islice(first, 4))
    first.close()
    paid = len(calls)
    assert paid >= taken > 0
    again = pd.concat(ask(frames(50, size), echo, ["k"], threads, Seals(folder, 3, ["k"]), group))
    assert again["k"].tolist() == list(range(50))
    assert again["raw"].tolist() == [f"PROMPT {i}" for i in range(50)] and again["error"].isna().all()
    assert len(calls) == 50 + paid - taken and set(Counter(calls).values()) == {1}
    # Another partition has sealed nothing.
    assert Seals(folder, 4, ["k"]).read() == {}


def test_failures_are_sealed_too_and_half_written_seals_are_not(folder):
    def fails(prompt):
        if prompt.endswith("1"):
            raise ValueError("refused")
        return None

    out = pd.concat(ask(frames(12, 5), fails, ["k"], 1, Seals(folder, 0, ["k"]), 2))
    assert out["error"].tolist() == ["refused" if str(k).endswith("1") else None for k in range(12)]
    with open(f"{folder}/p0000000-x.tmp", "w") as file:
        file.write("cut off")
    known = Seals(folder, 0, ["k"]).read()
    assert len(known) == 12 and known[(1,)] == (None, "refused") and known[(2,)] == (None, None)


def test_file_systems(folder):
    for uri in (folder, f"file:{folder}", f"file://{folder}"):
        assert file_system(uri)[1] == folder


def test_sealed_answers_are_read_once(spark, folder):
    for k in range(2):
        Seals(folder, k, ["k"]).add(pa.table({"k": [1, 2 + k], "raw": ["a", "b"], "error": pa.array([None, None], pa.string())}))
    rows = sealed(spark, folder, "k bigint, raw string, error string", ["k"]).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, "a", None), (2, "b", None), (3, "b", None)]


def comments(spark, n):
    df = spark.createDataFrame(
        [(f"doc_{i}", f"comment number {i}", "s", "fr") for i in range(n)], "id string, text string, source string, lang string"
    ).coalesce(1)
    return kept(from_dataframe(df, "text", "id"))


def test_a_killed_run_asks_no_sealed_prompt_again(spark, store, folder):
    folder = f"{folder}/log"
    os.mkdir(folder)
    deadly = lambda prompt: "comment number 77" in prompt
    step = answer_with(logged(transports.echo_analyst(), folder, deadly), group=2)
    with pytest.raises(Exception, match="killed"):
        run_analysis(comments(spark, 900), step, store, "r", wait=no_wait)
    before = asked(folder)
    run = run_analysis(None, step, store, "r", wait=no_wait)
    # Sealed by twos: what the killed tasks had asked and not sealed, and that prompt itself.
    again = [n for n in asked(folder).values() if n > 1]
    assert max(again) == 2 and len(again) <= 2 * spark.sparkContext.defaultParallelism < len(before)
    assert len(asked(folder)) == 90
    assert load_results(store, "r").count() == 900 and run.total_batches == 90
    state = checkpoint(store, "r").first()
    assert (state["completed_batches"], state["total_batches"]) == (90, 90)
    assert os.listdir(store.path("seals", "r")) == []


def test_sealed_prompts_of_a_step_with_a_folder(spark, folder):
    prompts = spark.range(60).select("id", F.concat(F.lit("p"), "id").alias("prompt"))
    log = f"{folder}/log"
    os.mkdir(log)
    step = answer_with(logged(str.upper, log, lambda p: p == "p33"), group=1, concurrency=2)
    go = lambda: ask_in_rounds(
        prompts, ["id"], step, lambda raw: raw, "raw is null", wait=no_wait, at=f"{folder}/answers"
    )
    with pytest.raises(Exception, match="killed"):
        go()
    first = sum(asked(log).values())
    rows = go().collect()
    assert {r["id"]: r["raw"] for r in rows} == {i: f"P{i}" for i in range(60)} and len(rows) == 60
    assert first > 2 and max(asked(log).values()) <= 2 and sum(n == 2 for n in asked(log).values()) <= 2
    assert sum(asked(log).values()) <= 62
    assert GROUP == 16
