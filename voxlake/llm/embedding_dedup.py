"""Near-duplicate embeddings through a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order. Inverted
lists hold, for every two pivots, the vectors that have both among their nearest: two
vectors meet there exactly if they share two pivots or more. Where they meet, their
cosine is computed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voxlake.llm.common import components
from voxlake.session import small_side, write_table

COSINE = 0.9
# Nearest pivots that describe a vector; any two of them are a list.
NEAREST = 7
# Pivots: 2 sqrt(N), within these bounds, so that lists stay short.
LEAST_PIVOTS, MOST_PIVOTS = 64, 1024
# Vectors drawn to pick pivots from, in expectation; alike ones are passed over.
SAMPLE = 4_000
ALIKE = 0.5
# Longer lists are cut into blocks, and blocks compared two by two.
BLOCK = 2_048
# Rows that one task group holds on average.
GROUP_ROWS = 16_384


def usable(vector: str) -> Column:
    """Vectors that can link: no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(
        F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def pick_pivots(sample: list[np.ndarray], wanted: int) -> dict[int, np.ndarray]:
    """By dimension: sampled vectors that are not alike, filled up by random directions."""
    out = {}
    for size in {len(v) for v in sample}:
        rows = unit_rows(np.array([v for v in sample if len(v) == size]))
        chosen = np.zeros((0, size))
        for row in rows:
            if len(chosen) == wanted:
                break
            if not len(chosen) or np.abs(chosen @ row).max() < ALIKE:
                chosen = np.vstack([chosen, row])
        out[size] = np.vstack([chosen, random_pivots(size, wanted)[len(chosen):]])
    return out


def random_pivots(size: int, wanted: int) -> np.ndarray:
    return unit_rows(np.random.default_rng(size).normal(size=(wanted, size)))


def nearest(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Ids of the nearest pivots of unit rows, ascending in each row."""
    near = np.argsort(-(rows @ pivots.T), axis=1, kind="stable")[:, :NEAREST]
    return np.sort(near, axis=1).astype(np.int16)


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows) of an array column, one dimension at a time."""
    sizes = np.array([len(v) for v in column])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.array([v.values.to_numpy(zero_copy_only=False) for v in (column[int(k)] for k in at)])


def _listed(classes: DataFrame, pivots, wanted: int, carry: bool) -> DataFrame:
    """(list) of every class, and with `carry` its id, weight, vector and pivots."""
    places = list(combinations(range(NEAREST), 2))
    first, second = (np.array(x) for x in zip(*places))

    def lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in _vectors(batch.column("embedding")):
                size = rows.shape[1]
                known = pivots.value.get(size)
                near = nearest(unit_rows(rows), random_pivots(size, wanted) if known is None else known)
                wide = near.astype(np.int64)
                keys = (size << 20) + wide[:, first] * 1024 + wide[:, second]
                names, columns = ["list"], [pa.array(keys.ravel())]
                if carry:
                    who = np.repeat(at, len(places))
                    vectors = pa.array([r.tobytes() for r in rows], pa.binary())
                    tops = pa.array([r.tobytes() for r in near], pa.binary())
                    row_of = pa.array(np.repeat(np.arange(len(at)), len(places)))
                    names += ["class", "weight", "vector", "pivots"]
                    columns += [
                        batch.column("class").take(pa.array(who)), batch.column("weight").take(pa.array(who)),
                        vectors.take(row_of), tops.take(row_of),
                    ]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "list long" + ", class long, weight long, vector binary, pivots binary" * carry
    return classes.select("class", "weight", "embedding").mapInArrow(lists, schema)


def local_roots(count: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each of `count` places over the edges (u, v)."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compared(listed: DataFrame, width: str, cosine: float) -> DataFrame:
    """(class, root, links) from the vectors of each list, or of two of its blocks.

    A pair that meets in several lists is counted in the one of its two smallest
    common pivots.
    """

    def compare(t: pa.Table) -> pa.Table:
        key = np.stack([t.column(c).to_numpy() for c in ("list", "low", "high")], axis=1)
        order = np.lexsort(key.T[::-1])
        key = key[order]
        ids, weights, mine = (t.column(c).to_numpy()[order] for c in ("class", "weight", "block"))
        vectors, tops = (t.column(c).take(pa.array(order)).to_pylist() for c in ("vector", "pivots"))
        edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True])
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for start, end in zip(edges[:-1], edges[1:]):
            if end - start < 2:
                continue
            rows = unit_rows(np.frombuffer(b"".join(vectors[start:end]), width).reshape(end - start, -1))
            near = np.frombuffer(b"".join(tops[start:end]), np.int16).reshape(end - start, -1)
            name, low, high = key[start]
            if low == high:
                a, b = np.nonzero(np.triu(rows @ rows.T >= cosine, 1))
            else:
                left, right = (np.flatnonzero(mine[start:end] == x) for x in (low, high))
                a, b = np.nonzero(rows[left] @ rows[right].T >= cosine)
                a, b = left[a], right[b]
            if not len(a):
                continue
            p, q = (name & (2**20 - 1)) // 1024, name % 1024
            links = np.zeros(end - start, np.int64)
            for k in range(0, len(a), 200_000):
                x, y = a[k:k + 200_000], b[k:k + 200_000]
                common = (near[x][:, :, None] == near[y][:, None, :]).any(axis=2)
                smaller = (common & (near[x] < q) & (near[x] != p)).any(axis=1)
                x, y = x[~smaller], y[~smaller]
                np.add.at(links, x, weights[start + y])
                np.add.at(links, y, weights[start + x])
            root = local_roots(end - start, a, b)
            seen = np.unique(np.r_[a, b])
            out.append((ids[start + seen], ids[start + root[seen]], links[seen]))
        columns = [np.concatenate(c) for c in zip(*out)] or [np.array([], np.int64)] * 3
        return pa.table(dict(zip(["class", "root", "links"], columns)))

    return listed.groupBy("task").applyInArrow(compare, "class long, root long, links long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of `vectors` (vec_id, embedding).

    Equal vectors are one class with a weight. Vectors that are null, zero, or hold
    null or non-finite components link with nothing, nor do those of different
    dimensions. Null ids are never the smallest of a component and not kept where
    it has another. Rows with equal ids are compared like any other. An empty table
    gives no rows; other columns are ignored.

    The index is approximate: two vectors are compared if they share two of their
    nearest pivots. Pairs that are found have at least the cosine asked for.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    width = "<f4" if "float" in dict(rows.dtypes)["embedding"] else "<f8"
    if width == "<f8":
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = rows.withColumn("usable", usable("embedding"))
    classes = write_table(
        rows.where("usable").groupBy("embedding")
        .agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("smallest"))
        .withColumn("class", F.monotonically_increasing_id()), "classes",
    )
    n = classes.count()
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, int(2 * n**0.5)))
    drawn = F.pmod(F.xxhash64(F.lit("pivots"), "embedding"), F.lit(1_000_000)) / 1_000_000
    sample = classes.where(drawn < SAMPLE / max(n, 1)).select("embedding").collect()
    pivots = spark.sparkContext.broadcast(
        pick_pivots([np.array(r["embedding"]) for r in sample], wanted)
    )
    lists = write_table(
        _listed(classes, pivots, wanted, carry=False).groupBy("list")
        .agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK)).select("list", "n", "blocks"), "lists",
    )
    total = lists.agg(F.sum(F.col("n") * F.col("blocks")).alias("n")).first()["n"] or 0
    tasks = int(total // GROUP_ROWS + 1)
    block = F.pmod(F.xxhash64("class"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    listed = (
        _listed(classes, pivots, wanted, carry=True).join(small_side(lists), "list")
        .withColumn("block", block).withColumn("other", other)
        .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
        .withColumn("task", F.pmod(F.xxhash64("list", "low", "high"), F.lit(tasks)))
        .select("task", "list", "low", "high", "block", "class", "weight", "vector", "pivots")
    )
    found = write_table(_compared(listed, width, cosine), "found")
    together = components(found.select(F.col("class").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    grouped = write_table(
        classes.join(links, "class", "left").join(
            together.toDF("class", "component"), "class", "left"
        ).select(
            "embedding", "smallest", F.coalesce("component", "class").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        ), "grouped",
    )
    lowest = write_table(
        grouped.groupBy("component").agg(F.min("smallest").alias("component_id")), "lowest"
    )
    named = write_table(
        grouped.join(lowest, "component").select("embedding", "n_links", "component_id"), "named"
    )
    linked = rows.where("usable").select("vec_id", "embedding").join(named, "embedding").select(
        "vec_id", "n_links", "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
    )
    alone = rows.where("not usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
        F.lit(True).alias("kept"),
    )
    return linked.unionByName(alone)
