"""CSV records across ranges: equal rows however a file is cut."""

import csv
import io
import random
import re
import time
from contextlib import contextmanager

import pytest
from hypothesis import given, settings, strategies as st

from voxlake.sources import csv_records
from voxlake.sources.csv_records import csv_rows, ends_inside
from voxlake.sources.metadata import load_raw_metadata

FIRST = lambda names: {"text": 0, "id": 1, "source": 2, "lang": None}
CELLS = ["a", ",", '"', "\n", " ", "é", "word", '""', "\n\n", ""]


@contextmanager
def ranges(spark, size):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def written(path, rows, end="\n", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=quoting).writerows(rows)
    with open(path, "w", encoding="utf-8", newline="") as file:
        file.write(out.getvalue())
    return out.getvalue()


def read(spark, paths, size="128m", **options):
    with ranges(spark, size):
        rows = csv_rows(spark, paths, FIRST, **options)
        got = None if rows is None else [(r["_path"], r["_block"], r["text"], r["id"], r["source"]) for r in rows.collect()]
    return got


def cells(got):
    """Cells in the order of files and ranges; rows of a range come in order."""
    return [g[2:] for g in sorted(got, key=lambda g: g[:2])]


def table(seed, n=25):
    pick = random.Random(seed)
    cell = lambda: "".join(pick.choice(CELLS) for _ in range(pick.randint(0, 5)))
    return [["text", "id\nof it", "source"]] + [[cell() + "x", cell(), str(k)] for k in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", ["1m", "90", "25"])
def test_rows_do_not_depend_on_ranges(spark, folder, size, end):
    paths, want = [], []
    for k in range(3):
        rows = table(k)
        paths.append(f"{folder}/f{k}.csv")
        written(paths[-1], rows, end, csv.QUOTE_ALL if k == 2 else csv.QUOTE_MINIMAL)
        want += [tuple(c or None for c in row) for row in rows[1:]]
    got = read(spark, paths, size)
    assert cells(got) == want
    if size == "25":
        assert len({g[:2] for g in got}) > 15


def test_one_record_over_many_ranges(spark, folder):
    long = "\n".join(f'line "{k}", of it' for k in range(200))
    written(f"{folder}/a.csv", [["text", "id", "source"], ["a", "1", "s"], [long, "2", "s"], ["b", "3", "s"], [long, "4", "t"]])
    for size in ("128m", "600"):
        assert cells(read(spark, [f"{folder}/a.csv"], size)) == [("a", "1", "s"), (long, "2", "s"), ("b", "3", "s"), (long, "4", "t")]


def test_a_header_over_many_ranges(spark, folder):
    written(f"{folder}/a.csv", [["te\n" * 40, "id", "source"], ["a\nb", "1", "s"]])
    assert cells(read(spark, [f"{folder}/a.csv"], "16")) == [("a\nb", "1", "s")]


@pytest.mark.parametrize("size", ["128m", "9"])
def test_odd_files(spark, folder, size):
    texts = {
        "a": '5" pipe,1,s\n', "b": '"abc"def,1,s\n', "c": 'say "hi",1,s\n"x ""y""",2,\n', "d": "﻿t,i,s\nz,1,s", "e": "", "f": "t,i,s\n",
        "g": "\n\nt,i,s\n\n\na,1,s\n\n", "h": '"open,1\n,s\n', "i": ' "x",1,s\n', "j": "a,,\n,b,\n",
    }
    want = {
        "a": [('5" pipe', "1", "s")], "b": [('"abc"def', "1", "s")], "c": [('say "hi"', "1", "s"), ('x "y"', "2", None)],
        "d": [("z", "1", "s")], "g": [("a", "1", "s")], "h": [("open,1\n,s\n", None, None)], "i": [(' "x"', "1", "s")],
        "j": [("a", None, None), (None, "b", None)],
    }
    paths = []
    for name, text in texts.items():
        paths.append(f"{folder}/{name}.csv")
        with open(paths[-1], "w", encoding="utf-8") as file:
            file.write(text if name in "defg" else "t,i,s\n" + text)
    got = read(spark, paths, size)
    found = {}
    for path, block, *row in sorted(got, key=lambda g: g[:2]):
        found.setdefault(path[-5], []).append(tuple(row))
    assert {k: [tuple(c.rstrip("\n") if c else c for c in r) for r in v] for k, v in found.items()} == {
        k: [tuple(c.rstrip("\n") if c else c for c in r) for r in v] for k, v in want.items()
    }


def test_surplus_and_plain_lines(spark, folder):
    written(f"{folder}/a.csv", [["t", "i", "s"], ["a", "1", "s", "more"], ["b", "2", "s"]])
    with pytest.raises(Exception, match="more cells than columns"):
        read(spark, [f"{folder}/a.csv"])
    assert cells(read(spark, [f"{folder}/a.csv"], surplus="drop", multiline=False, size="10")) == [("a", "1", "s"), ("b", "2", "s")]
    assert csv_rows(spark, [], FIRST) is None


def test_large_tables_of_ranges_are_not_broadcast(spark, folder, monkeypatch):
    monkeypatch.setattr(csv_records, "is_small", lambda table: False)
    rows = table(9)
    written(f"{folder}/a.csv", rows)
    assert cells(read(spark, [f"{folder}/a.csv"], "100")) == [tuple(c or None for c in row) for row in rows[1:]]


def test_raw_metadata_of_files_in_ranges(spark, folder):
    for k in range(3):
        written(f"{folder}/shop_{k}.csv", [["text", "source"]] + [[f"t{k}\n{i}", f"s{k}"] for i in range(20 - k)])
    with ranges(spark, "50"):
        got = {r["id"]: (r["text"], r["source"]) for r in load_raw_metadata(spark, folder).collect()}
    assert got == {f"shop_{i}": (f"t{max(k for k in range(3) if i < 20 - k)}\n{i}", f"s{max(k for k in range(3) if i < 20 - k)}") for i in range(20)}


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet='a,"\r ', max_size=14), st.booleans())
def test_state_after_a_line(line, inside):
    """A few lines of a state machine, character by character."""
    state, k = ("quoted" if inside else "start"), 0
    while k < len(line):
        c = line[k]
        if state == "quoted" and c == '"':
            if line[k + 1:k + 2] == '"':
                k += 1
            else:
                state = "plain"
        elif state != "quoted":
            state = "start" if c == "," else "quoted" if c == '"' and state == "start" else "plain"
        k += 1
    assert ends_inside(line, inside) == (state == "quoted")


@pytest.mark.parametrize("line", ['"' * 1_000_000, '","' * 300_000, 'a"' * 500_000, '"a,' * 300_000, ',' * 1_000_000, '"a""' * 250_000])
def test_long_lines(line):
    start = time.time()
    for inside in (True, False):
        ends_inside(line, inside)
    assert time.time() - start < 5 and re.match('[",a]', line)
