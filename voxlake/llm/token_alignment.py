"""Alignment of two tokenizers over the same bytes.

Per batch, one `merge_asof` in each direction finds for every token the token of the
other side that covers its start. The texts lie end to end and both sides give back the
same bytes, so no token reaches into another text. The union of both directions is all
overlapping pairs; pairs that end together link, and their ends cut the tokens of both
sides into groups.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from voxlake.llm.vocabularies import Vocabulary, once_per_worker, vocabulary

# Bytes of text that are aligned at a time; a longer text is aligned alone.
BATCH_BYTES = 250_000
# Links that are counted or looked up at a time.
BATCH_LINKS = 500_000

LINKS = ["linked_a", "linked_b"]
_SCHEMA = (
    "doc_id long, n_a long, n_b long, groups string, cuts array<int>,"
    " linked_a array<int>, linked_b array<int>"
)


@dataclass
class Tokens:
    """Tokens of one side over the texts of a batch, laid end to end."""

    ids: np.ndarray
    per_doc: np.ndarray  # number of tokens
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, ids: list[np.ndarray], lengths: np.ndarray) -> Tokens:
        all_ids = np.concatenate(ids) if ids else np.array([], "<u4")
        sizes = lengths[all_ids]
        ends = np.cumsum(sizes)
        return cls(all_ids, np.array([len(i) for i in ids], np.int64), ends - sizes, ends)

    def frame(self, name: str) -> pd.DataFrame:
        """Sorted by start, as documents follow each other."""
        return pd.DataFrame({"start": self.starts, name: np.arange(len(self.ids))})

    def marked(self, places: np.ndarray) -> np.ndarray:
        """True for the tokens at `places`."""
        out = np.zeros(len(self.ids), bool)
        out[places] = True
        return out


def overlapping(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens that share a byte, as places in `a` and `b`, in text order."""
    left, right = a.frame("a"), b.frame("b")
    # Along the text the sum of both places grows with every further pair, so it names the pair.
    of_a = np.full(len(a.ids) + len(b.ids), -1)
    for cover in (pd.merge_asof(left, right, on="start"), pd.merge_asof(right, left, on="start")):
        at_a, at_b = (cover[n].to_numpy(np.int64) for n in "ab")
        of_a[at_a + at_b] = at_a
    sums = np.flatnonzero(of_a >= 0)
    return of_a[sums], sums - of_a[sums]


class Aligner:
    """Batches of texts to aligned tokens, for two vocabulary files."""

    def __init__(self, a: str, b: str, overlaps: bool) -> None:
        self.overlaps = overlaps
        self.sides: list[Vocabulary] = [vocabulary(a), vocabulary(b)]
        self.known = [v.token_bytes for v in self.sides]
        self.lengths = [np.array([len(t) for t in known], np.int64) for known in self.known]
        self.spelled = once_per_worker(
            ("spelled", a, b), lambda: [pa.array(known, pa.large_binary()) for known in self.known]
        )
        # Ids as text with the mark that follows: within a group, at its end, at the text's end.
        self.cells = once_per_worker(("cells", a, b), lambda: pa.array(
            [f"{i}{mark}" for known, marks in zip(self.known, ([",", "|"], [",", ";", ""]))
             for mark in marks for i in range(len(known))], pa.large_string(),
        ))

    def ids(self, texts: list[str | None]) -> list[list[np.ndarray]]:
        """Of both sides, the ids of each text; none if one side does not stand for the text's bytes."""
        none = np.array([], "<u4")
        raw = [f" {t}".encode() if t else b"" for t in texts]
        found = [
            [self.sides[0].plain_ids(f" {t}") if t else none for t in texts],
            [self.sides[1].plain_ids(t) if t else none for t in texts],
        ]
        for ids, lengths, spelled in zip(found, self.lengths, self.spelled):
            side = Tokens.of(ids, lengths)
            flat = _bytes(spelled.take(pa.array(side.ids))).to_pybytes()
            ends = np.r_[0, side.ends][np.r_[0, np.cumsum(side.per_doc)]].tolist()
            for k, (x, y) in enumerate(zip(ends[:-1], ends[1:])):
                if flat[x:y] != raw[k]:
                    found[0][k] = found[1][k] = none
                    raw[k] = b""
        return found

    def __call__(self, doc_ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        a, b = (Tokens.of(ids, lengths) for ids, lengths in zip(self.ids(texts), self.lengths))
        at_a, at_b = overlapping(a, b)
        together = a.ends[at_a] == b.ends[at_b]
        last_a, last_b = at_a[together], at_b[together]  # of each group

        def per_doc(side: Tokens, places: np.ndarray) -> np.ndarray:
            """Offsets of each document's rows, given the places of their tokens."""
            return np.searchsorted(places, np.r_[0, np.cumsum(side.per_doc)]).astype(np.int32)

        cuts = per_doc(a, last_a)
        before = [np.r_[0, np.cumsum(s.per_doc)] for s in (a, b)]
        size = np.r_[0, a.ends][before[0]]  # bytes ahead of each document
        columns = {
            "doc_id": doc_ids, "n_a": pa.array(a.per_doc), "n_b": pa.array(b.per_doc),
            "groups": self._groups(a, b, last_a, last_b),
            "cuts": _lists(cuts, a.ends[last_a] - np.repeat(size[:-1], np.diff(cuts))),
            "linked_a": _lists(cuts, a.ids[last_a]), "linked_b": _lists(cuts, b.ids[last_b]),
        }
        if self.overlaps:
            rows = per_doc(a, at_a)
            for name, at, first in (("overlap_a", at_a, before[0]), ("overlap_b", at_b, before[1])):
                columns[name] = _lists(rows, at - np.repeat(first[:-1], np.diff(rows)))
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def _groups(self, a: Tokens, b: Tokens, last_a: np.ndarray, last_b: np.ndarray) -> pa.Array:
        """Each document's groups as text: `a1,a2|b1;a3|b2,b3`."""
        # A token's place in the text: after the tokens of its side, and those groups of the other.
        n_a, n_b = len(a.ids), len(b.ids)
        ends_a, ends_b = a.marked(last_a), b.marked(last_b)
        text_ends = b.marked(np.cumsum(b.per_doc)[b.per_doc > 0] - 1)
        place_a = np.arange(n_a) + np.r_[0, last_b + 1][np.cumsum(ends_a) - ends_a]
        place_b = np.arange(n_b) + np.r_[last_a + 1, 0][np.cumsum(ends_b) - ends_b]
        known_a, known_b = map(len, self.known)
        cell = np.empty(n_a + n_b, np.int64)
        cell[place_a] = a.ids + known_a * ends_a
        cell[place_b] = b.ids + 2 * known_a + known_b * (ends_b + text_ends.astype(np.int64))
        text = self.cells.take(pa.array(cell))
        at = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1)[np.r_[0, np.cumsum(a.per_doc + b.per_doc)]]
        return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), _bytes(text)).cast(pa.string())


def _bytes(array: pa.Array) -> pa.Buffer:
    """What the values of a new array of strings or bytes hold, end to end."""
    return array.buffers()[2] or pa.py_buffer(b"")


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32)))


def align_tokens(docs: DataFrame, a: str, b: str, overlaps: bool = True) -> DataFrame:
    """Tokens of vocabulary files `a` and `b` over each text of `docs` (doc_id, text), aligned.

    `a` encodes the text with a space in front, `b` the text alone, to which it adds the
    space itself. Special strings inside a text are ordinary text. One row per row of
    `docs`: n_a and n_b tokens; `groups` as text, ids of a and b between common ends;
    `cuts`, the byte offsets of these ends, the space included; `linked_a` and `linked_b`,
    the ids of the two tokens that end at each; with `overlaps` also `overlap_a` and
    `overlap_b`, the places of any two tokens that share a byte.

    A text that is null or empty, or that one side does not give back byte by byte, has
    no tokens, empty lists and an empty `groups`. Rows with null or repeated ids are
    aligned like any other, long texts whole. An empty table gives no rows; other columns
    are ignored. Nothing is shuffled.
    """

    def aligned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner(a, b, overlaps)
        for batch in batches:
            held: list[str | None] = []
            start = size = 0
            for at, text in enumerate(batch.column(1)):
                text = text.as_py()
                held.append(text)
                size += len(text or "")
                if size >= BATCH_BYTES or at == len(batch) - 1:
                    yield align(batch.column(0)[start:at + 1], held)
                    held, start, size = [], at + 1, 0

    schema = f"{_SCHEMA}, overlap_a array<int>, overlap_b array<int>" if overlaps else _SCHEMA
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(aligned, schema)


def most_pairs(a: str, b: str) -> int:
    """How many pairs of ids can link, whatever the texts.

    Tokens that end together end alike: the shorter is the end of the longer.
    """
    known = [vocabulary(p).token_bytes for p in (a, b)]
    total = 0
    for one, other, first in ((known[0], known[1], 0), (known[1], known[0], 1)):
        having: dict[bytes, int] = {}
        for token in one:
            having[token] = having.get(token, 0) + 1
        for token in other:  # its ends that are tokens of the other side; itself once
            total += sum(having.get(token[k:], 0) for k in range(first, len(token)))
    return total


def pair_counts(links: DataFrame) -> DataFrame:
    """(a_id, b_id, n): how many links of all rows of `links` hold each pair of ids.

    Counted in every task first: as many rows as pairs can link, at most, leave it.
    """

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.array([], np.int64), np.array([], np.int64)
        for batch in _parts(batches):
            new, n = np.unique(_codes(batch), return_counts=True)
            merged, at = np.unique(np.r_[pairs, new], return_inverse=True)
            summed = np.zeros(len(merged), np.int64)
            np.add.at(summed, at, np.r_[counts, n])
            pairs, counts = merged, summed
        yield pa.RecordBatch.from_arrays(
            [pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(counts)],
            ["a_id", "b_id", "n"],
        )

    parts = links.select(*LINKS).mapInArrow(counted, "a_id int, b_id int, n long")
    return parts.groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH_LINKS links, one row at least."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column(LINKS[0])).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // BATCH_LINKS
        cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(batch)]
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if y > x:
                yield batch.slice(x, y - x)


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    """Both ids of every link as one number."""
    a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in LINKS)
    return (a << 32) | b


def with_link_strength(aligned: DataFrame) -> DataFrame:
    """`aligned`, a written table, with n_best and count_sum instead of its links.

    A link counts as often as its pair of ids is linked in all rows. `n_best` is the
    number of a row's links whose count is the highest among the pairs of their b id,
    ties included; `count_sum` adds up the counts of a row's links. Both are 0 without
    links. The counts are broadcast; they are at most `most_pairs`, which the two
    vocabularies fix, whatever the texts.
    """
    counts = pair_counts(aligned).toPandas()
    code = (counts["a_id"].to_numpy(np.int64) << 32) | counts["b_id"].to_numpy(np.int64)
    order = np.argsort(code)
    code, n, of_b = code[order], counts["n"].to_numpy(np.int64)[order], counts["b_id"].to_numpy(np.int64)[order]
    highest = np.zeros(of_b.max(initial=-1) + 1, np.int64)
    np.maximum.at(highest, of_b, n)
    table = aligned.sparkSession.sparkContext.broadcast((code, n, n == highest[of_b]))
    names = [c for c in aligned.columns if c not in LINKS]

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times, best = table.value
        for batch in _parts(batches):
            at = np.searchsorted(pairs, _codes(batch))
            sizes = pc.list_value_length(batch.column(LINKS[0]))
            ends = np.r_[0, np.cumsum(sizes.to_numpy(zero_copy_only=False))]
            totals = [np.r_[0, np.cumsum(v[at])][ends] for v in (best.astype(np.int64), times)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], *[pa.array(np.diff(t)) for t in totals]],
                [*names, "n_best", "count_sum"],
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name in names)
    return aligned.mapInArrow(judged, f"{kept}, n_best long, count_sum long")
