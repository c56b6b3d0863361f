"""Ranked lexical search of all documents for each item, scored once per bag of words.

Documents are restricted to the vocabulary of the items. Those with the same term
frequencies and the same length norm score alike for every item, so they are one class:
classes are known by a hash, told apart by their bytes, and scored once. Only the
classes that rank are expanded to their documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from voxlake.session import small_side, write_table

BEST = 50
# Distinct terms of the items that are searched in one pass, on average; more items take
# more passes over the documents.
PASS_TERMS = 200_000
# Scores, and products of weights and frequencies, that a task holds at a time.
CELLS = 2_000_000

_LAST = 2**63 - 1
# Letters of a term stand for themselves, A-Z for a-z; all else lies between terms.
_TABLE = bytes(
    b if b > 127 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if 65 <= b <= 90 else 32
    for b in range(256)
)


def terms_of(raw: bytes) -> list[bytes]:
    """Terms of a text in UTF-8: runs of ASCII letters and digits and all beyond ASCII."""
    return raw.translate(_TABLE).split()


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): distinct terms of each item."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                terms = sorted(set(terms_of(text.as_py() or b"")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(terms), pa.int64()), pa.array(terms, pa.binary())], ["item_id", "term"]
                )

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(
        split, "item_id long, term binary"
    ).distinct()


def _vectors(docs: DataFrame, known: Broadcast) -> DataFrame:
    """(doc_id, n, vector): terms with repeats, and which known terms how often, if any.

    A vector is the numbers of its terms, ascending, and then their frequencies, as
    little-endian 32-bit numbers.
    """

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for batch in batches:
            sizes, vectors = [], []
            for text in batch.column(1).cast(pa.binary()):
                terms = terms_of(text.as_py() or b"")
                sizes.append(len(terms))
                found = [k for k in map(number, terms) if k is not None]
                pair = np.unique(np.array(found, "<u4"), return_counts=True)
                vectors.append(np.r_[pair[0], pair[1].astype("<u4")].tobytes() if found else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(vectors, pa.binary())],
                ["doc_id", "n", "vector"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        counted, "doc_id long, n long, vector binary"
    )


def _unpacked(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, terms, frequencies) of vectors, laid end to end."""
    raw = [v.as_py() for v in vectors]
    sizes = np.array([len(v) // 8 for v in raw], np.int64)
    return (
        sizes,
        np.frombuffer(b"".join(v[:len(v) // 2] for v in raw), "<u4").astype(np.int64),
        np.frombuffer(b"".join(v[len(v) // 2:] for v in raw), "<u4").astype(np.int64),
    )


def _document_frequencies(vectors: DataFrame, terms: int) -> dict[int, int]:
    """Documents that hold each known term: at most `terms` numbers."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, np.int64)
        for batch in batches:
            df += np.bincount(_unpacked(batch.column(0))[1], minlength=terms)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], ["term", "df"])

    parts = vectors.select("vector").mapInArrow(counted, "term long, df long")
    return {r["term"]: r["df"] for r in parts.groupBy("term").agg(F.sum("df").alias("df")).collect()}


class Postings:
    """By term, the items that hold it, and its weight."""

    def __init__(self, pairs: list[tuple[int, int]], df: dict[int, int], documents: int, items: int) -> None:
        pairs = sorted((t, i) for i, t in pairs if t in df)
        terms = np.array([t for t, _ in pairs], np.int64)
        self.items, self.n_items = np.array([i for _, i in pairs], np.int64), items
        self.lengths = np.bincount(terms, minlength=max(df, default=0) + 1)
        self.starts = np.r_[0, np.cumsum(self.lengths)][:-1]
        self.weights = np.zeros(len(self.lengths), np.int64)
        for term, n in df.items():
            self.weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1)))
        # Doubles add integers up to here exactly.
        longest = int(np.bincount(self.items, minlength=1).max(initial=0))
        self.exact = longest * int(self.weights.max(initial=0)) * 1_000_000 < 2**53

    def scores(self, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Of each class for each item."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        gain = self.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[owner]))
        times = self.lengths[terms]
        entry = np.repeat(np.arange(len(terms)), times)
        inside = np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times)
        cell = owner[entry] * self.n_items + self.items[self.starts[terms[entry]] + inside]
        cells = len(sizes) * self.n_items
        if self.exact:
            flat = np.bincount(cell, gain[entry], cells).astype(np.int64)
        else:
            flat = np.zeros(cells, np.int64)
            np.add.at(flat, cell, gain[entry])
        return flat.reshape(len(sizes), self.n_items)

    def runs(self, sizes: np.ndarray, terms: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of classes that fill about CELLS each, one class at least."""
        ends = np.cumsum(sizes)
        cost = np.diff(np.r_[0, np.r_[0, np.cumsum(self.lengths[terms])][ends]]) + self.n_items
        part = np.cumsum(cost) // CELLS
        cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(sizes)]
        yield from ((int(x), int(y)) for x, y in zip(cuts[:-1], cuts[1:]) if y > x)


def _best_classes(classes: DataFrame, postings: Broadcast, best: int) -> DataFrame:
    """(item, score, hash, m, first_id): of each item the best classes, by score and first document.

    At most `best` of each task and item are handed over. That is enough: every class
    ahead of a document's own holds a document ahead of it.
    """
    names = ["score", "first_id", "item", "hash", "m"]

    def pruned(pool: np.ndarray) -> np.ndarray:
        """Rows (score, first_id, item, hash, m) that are among the best of their item."""
        pool = pool[np.lexsort((pool[:, 1], -pool[:, 0], pool[:, 2]))]
        starts = np.flatnonzero(np.r_[True, pool[1:, 2] != pool[:-1, 2]]) if len(pool) else np.array([], int)
        rank = np.arange(len(pool)) - np.repeat(starts, np.diff(np.r_[starts, len(pool)]))
        return pool[rank < best]

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = postings.value
        pool = np.zeros((0, 5), np.int64)
        least = np.ones(index.n_items, np.int64)
        for batch in batches:
            key, m, first = (batch.column(c).to_numpy() for c in ("hash", "m", "first_id"))
            sizes, terms, tf = _unpacked(batch.column("vector"))
            ends = np.r_[0, np.cumsum(sizes)]
            for x, y in index.runs(sizes, terms):
                scores = index.scores(sizes[x:y], terms[ends[x]:ends[y]], tf[ends[x]:ends[y]], m[x:y])
                floor = least
                if y - x > best:
                    floor = np.maximum(least, np.partition(scores, y - x - best, axis=0)[y - x - best])
                row, item = np.nonzero(scores >= floor)
                new = np.stack([scores[row, item], first[x + row], item, key[x + row], m[x + row]], axis=1)
                pool = pruned(np.concatenate([pool, new]))
                full = np.bincount(pool[:, 2], minlength=index.n_items) == best
                last = np.flatnonzero(np.r_[pool[1:, 2] != pool[:-1, 2], True]) if len(pool) else []
                least = np.ones(index.n_items, np.int64)
                least[pool[last, 2]] = pool[last, 0]
                least[~full] = 1
        yield pa.RecordBatch.from_arrays([pa.array(pool[:, k]) for k in range(5)], names)

    found = classes.select("hash", "m", "first_id", "vector").mapInArrow(
        scored, ", ".join(f"{n} long" for n in names)
    )
    order = Window.partitionBy("item").orderBy(F.desc("score"), "first_id", "hash", "m")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= best).drop("place")


def _search(docs: DataFrame, pairs: list[tuple[int | None, bytes]], best: int) -> DataFrame | None:
    """Results for items given as pairs (item_id, term), None if no document has a term."""
    spark = docs.sparkSession
    terms = {t: k for k, t in enumerate(sorted({t for _, t in pairs}))}
    items = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i))
    numbers = {i: k for k, i in enumerate(items)}
    vectors = write_table(_vectors(docs, spark.sparkContext.broadcast(terms)), "vectors")
    size = vectors.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("words")).first()
    if not size["documents"]:
        return None
    held = vectors.where("vector is not null")
    df = _document_frequencies(held, len(terms))
    postings = spark.sparkContext.broadcast(
        Postings([(numbers[i], terms[t]) for i, t in pairs], df, size["documents"], len(items))
    )
    bags = held.select(
        "doc_id", "vector", F.expr(f"50 + (50L * n * {size['documents']}L) div {size['words']}L").alias("m")
    ).withColumn("hash", F.xxhash64("vector", "m"))
    # The hash brings rows together; equal bytes make them one class.
    classes = write_table(
        bags.groupBy("hash", "m", "vector").agg(F.coalesce(F.min("doc_id"), F.lit(_LAST)).alias("first_id")), "classes"
    )
    winners = write_table(_best_classes(classes, postings, best), "winners")
    keys = small_side(write_table(winners.select("hash", "m").distinct(), "keys"))
    # A class has no more documents among the best than that, the smallest ids.
    by_id = Window.partitionBy("hash", "m", "vector").orderBy(F.asc_nulls_last("doc_id"))
    members = (
        bags.join(keys, ["hash", "m"], "left_semi")
        .withColumn("member", F.row_number().over(by_id)).where(F.col("member") <= best)
        .withColumn("first_id", F.coalesce(F.min("doc_id").over(Window.partitionBy("hash", "m", "vector")), F.lit(_LAST)))
    )
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    named = spark.createDataFrame(list(enumerate(items)), "item long, item_id long")  # one row an item of this pass
    return (
        winners.join(members.select("hash", "m", "first_id", "doc_id"), ["hash", "m", "first_id"])
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        .join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
    )


def ranked_search(
    docs: DataFrame, items: DataFrame, best: int = BEST, pass_terms: int = PASS_TERMS
) -> DataFrame:
    """(item_id, rank, doc_id, score): the `best` documents of `docs` (doc_id, text) for each item.

    `items` has (item_id, text). Integer BM25: terms that few documents hold weigh
    more, repeats less and less, and long documents less. Documents of score 0 are not
    returned; equal scores rank by ascending doc_id, null ids last.

    Null and empty texts have no term. Rows of `items` with one id, or none, are one
    item with the terms of all. Rows of `docs` with null or repeated ids are ranked each
    by itself. Whole texts of any length are read. An empty table on either side gives
    no rows; other columns are ignored.

    Items are searched in as many passes as their vocabulary asks for. What tasks
    get is the vocabulary of one pass; what they return is at most `best` classes an
    item. Copies of one text, or of one bag of words, are one row before any of
    them is sent.
    """
    spark = docs.sparkSession
    pairs = write_table(_item_terms(items), "item-terms")
    total = pairs.count()
    passes = -(-total // pass_terms)
    found = []
    for k in range(passes):
        mine = pairs if passes == 1 else pairs.where(
            F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k
        )
        rows = [(r["item_id"], bytes(r["term"])) for r in mine.collect()]  # a pass's vocabulary
        ranked = _search(docs, rows, best) if rows else None
        if ranked is not None:
            found.append(ranked)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)
