"""Line deduplication by pairwise alignment.

Documents that share enough words in consecutive lines are found through hashes of
short line windows, aligned with patience diff, and the common blocks are deleted
from the later document, the one with the larger id. Lines that repeat within a text
are no anchors across different repeats; the windows themselves find their blocks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from voxlake.session import write_table

# Words a common block must have. Fewer repeat by chance.
BLOCK_WORDS = 8

Match = tuple[int, int, int]  # place in the earlier document, in the later one, words


def _hash(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - 2**63


def line_rows(text: str, block_words: int) -> list[tuple[int, int, int | None, int | None, int, int, int]]:
    """(place, line, ahead, behind, words, ahead_lines, behind_lines) of the lines that have words.

    `line` tells repeats of a line in one text apart by their number. `ahead` and
    `behind` stand for the fewest lines from here on, or up to here, that have
    `block_words` words together; they are null where the text has no more, and do not
    tell repeats apart. Every line of a common block of that many words lies in such a window inside the block.
    """
    lines = [b" ".join(x.split()) for x in text.encode("utf-8", "replace").split(b"\n")]
    places = [k for k, line in enumerate(lines) if line]
    words = [lines[k].count(b" ") + 1 for k in places]
    seen: Counter[bytes] = Counter()
    told = []
    for place in places:
        seen[lines[place]] += 1
        told.append(b"%d\n%s" % (seen[lines[place]], lines[place]))
    plain = [lines[k] for k in places]
    upto = [0, *accumulate(words)]

    def window(start: int, end: int) -> int:
        return _hash(b"\n".join(plain[start:end]))

    rows = []
    for at, line in enumerate(told):
        end = bisect_left(upto, upto[at] + block_words)
        start = bisect_right(upto, upto[at + 1] - block_words) - 1
        rows.append((
            at, _hash(line),
            window(at, end) if end < len(upto) else None,
            window(start, at + 1) if start >= 0 else None, words[at], end - at, at + 1 - start,
        ))
    return rows


def _increasing(matches: list[Match]) -> list[Match]:
    """A longest run of matches that ascends in both documents (given ascending in the first)."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, later, _) in enumerate(matches):
        at = bisect_left(tails, later)
        before.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(later)
            ends.append(k)
        else:
            tails[at], ends[at] = later, k
    out = []
    k = ends[-1] if ends else -1
    while k >= 0:
        out.append(matches[k])
        k = before[k]
    return out[::-1]


def common_blocks(matches: list[Match], block_words: int) -> list[int]:
    """Places in the later document that lie in aligned blocks of enough words.

    Lines are unique within a document here, so every common line is an anchor and
    the alignment is the longest ascending run. What it leaves out, blocks in
    another order, is aligned again until nothing more is found.
    """
    found: list[int] = []
    left = sorted(matches)
    while left:
        aligned = _increasing(left)
        gone = set()
        block: list[Match] = []
        for m in [*aligned, (-9, -9, 0)]:
            if block and (m[0] != block[-1][0] + 1 or m[1] != block[-1][1] + 1):
                if sum(x[2] for x in block) >= block_words:
                    gone.update(block)
                block = []
            block.append(m)
        if not gone:
            # Short runs may have pushed a longer block aside: try without them.
            gone = set(aligned)
        else:
            found.extend(m[1] for m in gone)
        left = [m for m in left if m not in gone]
        if sum(m[2] for m in left) < block_words:
            break
    return found


def _lines(docs: DataFrame, block_words: int) -> DataFrame:
    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (doc_id, *row)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1))
                for row in line_rows(text.as_py() or "", block_words)
            ]
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, *[pa.int32()] * 3]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 8, kinds)],
                ["doc_id", "place", "line", "ahead", "behind", "words", "ahead_lines", "behind_lines"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(
        split, "doc_id long, place int, line long, ahead long, behind long, words int,"
        " ahead_lines int, behind_lines int",
    )


def _aligned(matches: DataFrame, block_words: int) -> DataFrame:
    """(doc_id, place) to delete, from matched lines that lie together by pair."""

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held = None, []

        def done() -> tuple[list[int], list[int]]:
            places = common_blocks(held, block_words) if held else []
            return [pair[0]] * len(places) if places else [], places

        for batch in batches:
            ids, places = [], []
            later, first, at_first, at_later, words = (c.to_pylist() for c in batch.columns)
            for row in zip(later, first, at_first, at_later, words):
                if row[:2] != pair:
                    more = done()
                    ids += more[0]
                    places += more[1]
                    pair, held = row[:2], []
                held.append(row[2:])
            yield _deletions(ids, places)
        yield _deletions(*done())

    return matches.mapInArrow(align, "doc_id long, place int")


def _deletions(ids: list[int], places: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(places, pa.int32())], ["doc_id", "place"]
    )


def repeated_lines(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, places): lines with words, counted from 0, that each document loses."""
    single = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().where("count > 1")
    lines = write_table(
        _lines(docs, block_words).join(
            write_table(single.select("doc_id"), "several"), "doc_id", "left_anti"
        ), "lines",
    )
    # Every window leads to the first document that has it: as many pairs as there
    # are later occurrences, however frequent it is.
    ahead = F.struct(
        F.col("place").alias("start"), F.col("ahead_lines").alias("n"), F.col("ahead").alias("window")
    )
    behind = F.struct(
        (F.col("place") + 1 - F.col("behind_lines")).alias("start"), F.col("behind_lines").alias("n"),
        F.col("behind").alias("window"),
    )
    windows = lines.select("doc_id", F.explode(F.array_distinct(F.array(ahead, behind))).alias("w"))
    windows = windows.select("doc_id", "w.*").where("window is not null")
    firsts = write_table(
        windows.groupBy("window")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last").select("window", "first"), "firsts",
    )
    matched = write_table(
        windows.join(firsts, "window").where("doc_id > first").select("doc_id", "first", "start", "n"), "matched",
    )
    pairs = write_table(matched.select("doc_id", "first").distinct(), "pairs")
    # A window has at most `block_words` lines.
    covered = matched.select("doc_id", F.explode(F.expr("sequence(start, start + n - 1)")).alias("place"))
    later = write_table(
        pairs.join(lines.select("doc_id", "line", "words", F.col("place").alias("at_later")), "doc_id"),
        "later",
    )
    matches = later.join(
        lines.select(F.col("doc_id").alias("first"), "line", F.col("place").alias("at_first")),
        ["first", "line"],
    ).select("doc_id", "first", "at_first", "at_later", "words")
    together = matches.repartition("doc_id", "first").sortWithinPartitions("doc_id", "first")
    return write_table(
        _aligned(together, block_words).unionByName(covered).groupBy("doc_id")
        .agg(F.sort_array(F.collect_set("place")).alias("places")), "places",
    )


def dedup_lines(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` (doc_id, text, ...) with all columns; later copies of common blocks are gone.

    A block is a run of consecutive lines, blank ones aside, that two documents have
    in common and that has at least `block_words` words. It stays in the document
    with the smallest id and is deleted from all others. White space inside a line
    does not count. Two columns follow: `n_lines`, the lines with words, and
    `n_deleted`. Texts that lose nothing are returned as they are, others joined
    by line feeds. Rows with a null id, or an id that several rows have, take no
    part. A null text has no lines and stays null.
    """
    # The short side is hashed, so that texts are dealt out but not sorted.
    places = repeated_lines(docs, block_words).toDF("id", "places").hint("shuffle_hash")
    joined = docs.join(places, docs["doc_id"].cast("long") == places["id"], "left")
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_deleted")]
    # Places come last, under a name that no column of the documents has.
    mark = "_".join(["places", *docs.columns])

    def shorten(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, deleted = [], [], []
            for text, places in zip(batch.column("text"), batch.column(mark)):
                text, gone = text.as_py(), places.as_py()
                split = (text or "").split("\n")
                at = -1
                kept = []
                for line in split:
                    # Blank means without words between ASCII white space.
                    if line.strip(" \t\n\r\x0b\x0c"):
                        at += 1
                        if gone and gone[bisect_left(gone, at):][:1] == [at]:
                            continue
                    kept.append(line)
                texts.append("\n".join(kept) if gone else text)
                lines.append(at + 1)
                deleted.append(len(gone or ()))
            extra = [pa.array(texts, pa.string()), pa.array(lines, pa.int32()), pa.array(deleted, pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], *extra], [*names, "text", "n_lines", "n_deleted"]
            )

    schema = docs.select(*names, F.col("text").cast("string").alias("text")).schema
    schema = T.StructType([
        *schema, *[T.StructField(c, T.IntegerType()) for c in ("n_lines", "n_deleted")]
    ])
    out = joined.select(
        *[docs[c] for c in names], docs["text"].cast("string").alias("text"), places["places"].alias(mark)
    ).mapInArrow(shorten, schema)
    order = [c for c in docs.columns if c in out.columns and c not in ("n_lines", "n_deleted")]
    return out.select(*order, "n_lines", "n_deleted")
