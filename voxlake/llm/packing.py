"""Best-fit packing of tokenised documents, improved by swaps between bins.

Which lengths share a bin does not depend on which documents have them. So the
search works on the histogram of lengths, at most `capacity` numbers whatever
the corpus, and on groups of bins that are filled alike; Spark tokenises, counts,
ranks the pieces of each length and gives each rank its place.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from voxlake.llm.vocabularies import vocabulary
from voxlake.session import small_side, write_table

CAPACITY = 2048
# Exchanges tried at most. Each acts on all bins that are filled alike, so this
# bounds the work on the driver whatever the corpus; places stay right without it.
MOST_EXCHANGES = 4_000

Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first


def cut_pieces(ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole capacities, after a first shorter one."""
    first = ids % capacity or min(ids, capacity)
    starts = [0, *range(first, ids, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], ids])]


def tokenised_pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """One row per piece, with the split it was read in and its place among equal lengths there."""
    schema = (
        "doc_id long, piece int, start long, length long, ids_crc32 long, split int, place long"
    )

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, split = vocabulary(path).ids, TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "").tobytes() + b"\0\0\0\0"
                for k, (start, n) in enumerate(cut_pieces(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start:4 * (start + n)])
                    out.append((doc_id, k, start, n, crc, split, seen[n]))
                    seen[n] += 1
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "split", "place"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, schema)


# --- which lengths share a bin: groups of bins that are filled alike -----------------


def _with(pattern: Pattern, length: int, times: int) -> Pattern:
    counts = Counter(dict(pattern))
    counts[length] += times
    return tuple(sorted(((n, c) for n, c in counts.items() if c), reverse=True))


def _fill(pattern: Pattern) -> int:
    return sum(n * c for n, c in pattern)


def best_fit(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Best-fit decreasing: each length goes to the fullest bins that still take it."""
    free: dict[int, Counter[Pattern]] = defaultdict(Counter)  # by room left
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, bins: int) -> None:
        if room not in free or not free[room]:
            bisect.insort(rooms, room)
        free[room][pattern] += bins

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, ((length, each),), left // each)
                if left % each:
                    put(capacity - left % each * length, ((length, left % each),), 1)
                break
            room = rooms[at]
            pattern, bins = next(iter(free[room].items()))
            each = min(room // length, left)
            used = min(bins, left // each)
            free[room][pattern] -= used
            free[room] += Counter()  # forget patterns without bins
            if not free[room]:
                rooms.pop(at)
            put(room - each * length, _with(pattern, length, each), used)
            left -= used * each
    out: Counter[Pattern] = Counter()
    for group in free.values():
        out.update(group)
    return out


def _gives(pattern: Pattern) -> Iterator[tuple[int, ...]]:
    """What a bin can give away at once: nothing, one document or two."""
    yield ()
    for n, _ in pattern:
        yield (n,)
    have = dict(pattern)
    for a, b in combinations_with_replacement([n for n, _ in pattern], 2):
        if a != b or have[a] > 1:
            yield (a, b)


def _exchange(pattern: Pattern, gives: tuple[int, ...], takes: tuple[int, ...]) -> Pattern:
    for n in gives:
        pattern = _with(pattern, n, -1)
    for n in takes:
        pattern = _with(pattern, n, 1)
    return pattern


def improve(bins: Counter[Pattern], capacity: int, most: int = MOST_EXCHANGES) -> Counter[Pattern]:
    """Swap-based local search on the sum of squared fills.

    The emptiest bins give: a document is moved, swapped for one, or for two, or two
    for one, with the underfull bin for which the sum of squares grows most. All
    bins filled alike act at once. Ends when the bins are as few as their words
    allow, no exchange helps, or after `most` exchanges.
    """
    bins = Counter({p: c for p, c in bins.items() if c})
    least = -(-sum(_fill(p) * c for p, c in bins.items()) // capacity)
    offers: dict[Pattern, tuple[list[tuple[int, ...]], np.ndarray]] = {}

    def offer(pattern: Pattern) -> tuple[list[tuple[int, ...]], np.ndarray]:
        """What a bin may give back, and its (tokens, documents, fill) as rows."""
        if pattern not in offers:
            gives, fill = list(_gives(pattern)), _fill(pattern)
            offers[pattern] = gives, np.array([(sum(g), len(g), fill) for g in gives]).T
        return offers[pattern]

    stuck: set[Pattern] = set()
    for _ in range(most):
        under = [p for p in bins if _fill(p) < capacity]
        givers = [p for p in under if p not in stuck]
        if not givers or sum(bins.values()) <= least:
            break
        giver = min(givers, key=lambda p: (_fill(p), p))
        own = _fill(giver)
        takers = [p for p in under if p != giver or bins[p] > 1]
        found = None
        if takers:
            ends = np.cumsum([len(offer(p)[0]) for p in takers])
            back, size, fill = np.concatenate([offer(p)[1] for p in takers], axis=1)
            most_gain = 0
            for give in offer(giver)[0][1:]:
                grown = sum(give) - back
                # One for one, two for one, one for two, or a move of one.
                allowed = (grown > 0) & (fill + grown <= capacity) & (
                    (size <= 2) if len(give) == 1 else (size == 1)
                )
                gain = np.where(allowed, 2 * grown * (fill - own + grown), 0)
                at = int(gain.argmax())
                if gain[at] > most_gain:
                    which = int(np.searchsorted(ends, at, side="right"))
                    taken = offer(takers[which])[0][at - (ends[which - 1] if which else 0)]
                    most_gain, found = gain[at], (give, takers[which], taken)
        if found is None:
            stuck.add(giver)
            continue
        give, taker, taken = found
        times = bins[giver] // 2 if taker == giver else min(bins[giver], bins[taker])
        bins[giver] -= times
        bins[taker] -= times
        for new in (_exchange(giver, give, taken), _exchange(taker, taken, give)):
            if new:
                bins[new] += times
        bins += Counter()
        stuck.clear()
    return bins


def _places(bins: Counter[Pattern]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, how many a bin, first bin, offset), ascending."""
    next_rank: Counter[int] = Counter()
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    first_bin = 0
    for pattern, count in sorted(bins.items(), reverse=True):
        offset = 0
        for length, each in pattern:
            rows[length].append((next_rank[length], each, first_bin, offset))
            next_rank[length] += each * count
            offset += each * length
        first_bin += count
    return {n: np.array(r, dtype=np.int64) for n, r in rows.items()}


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of `docs` (doc_id, text) and where they lie in sequences of `capacity` tokens.

    `path` is a vocabulary file. A document is its ids and the id 0; a null text is the 0 alone. Rows with
    equal or null ids are packed like any other. An empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = write_table(tokenised_pieces(docs, path, capacity), "pieces")
    per_split = pieces.groupBy("length", "split").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = write_table(
        per_split.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "starts"
    )
    histogram = {  # at most `capacity` rows
        r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    }
    places = spark.sparkContext.broadcast(
        _places(improve(best_fit(histogram, capacity), capacity))
    )

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("base").to_numpy() + batch.column("place").to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for n in np.unique(length):
                here = np.flatnonzero(length == n)
                table = places.value[int(n)]
                row = table[np.searchsorted(table[:, 0], rank[here], side="right") - 1]
                inside = rank[here] - row[:, 0]
                sequence[here] = row[:, 2] + inside // row[:, 1]
                offset[here] = row[:, 3] + inside % row[:, 1] * n
            kept = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sequence), pa.array(offset)],
                [*kept.schema.names, "sequence_id", "offset"],
            )

    starts = small_side(starts.drop("n"))
    return pieces.join(starts, ["length", "split"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "base", "place"
    ).mapInArrow(
        placed,
        "doc_id long, piece int, start long, length long, ids_crc32 long,"
        " sequence_id long, offset long",
    )
