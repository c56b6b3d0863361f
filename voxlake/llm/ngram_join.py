"""N-gram Jaccard join: prefix filters under several global token orders.

If two sets have a Jaccard similarity of at least t, a set of n tokens loses at
most n - ceil(t n) of them, so under any order of all tokens the first
n - ceil(t n) + 1 tokens of both must share one. Three orders are used, all
with rare tokens first, as these tell documents apart: by exact document
frequency, and twice by its power of two with ties broken by other hashes.
Candidates share a token of the first order's prefixes; the two other filters are
intersected with it before any set is compared.

Equal sets are one class from the start. Frequencies are counted on packed blocks
of tokens; a token that is frequent within one block is known to be frequent and
its occurrences are passed on without being gathered.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxlake.llm.common import both_ways, components, shuffle_partitions, write_parts
from voxlake.llm.shingles import Shingler, set_key
from voxlake.session import small_side, write_table

PERCENT = 80
# Tokens of one block, and of one counting task on average.
BLOCK_TOKENS = 1_000_000
BUCKET_TOKENS = 1_000_000
# From this frequency on tokens count as equally frequent.
FREQUENT = 64
# In lists of so few classes all are compared; others have so many centres in the
# first round, and times as many in each later one.
FEW, CENTRES, MORE_CENTRES = 6, 2, 16
# Sets that a task holds and hands over at a time.
SETS_PER_BATCH = 500
# 64-bit words of a parity bitmap.
PARITY_WORDS = 8

_LOW = np.uint64(2**44 - 1)


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key) per row: size and key of its shingle set."""

    def sized(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in batches:
            sizes, keys = [], []
            for text in batch.column(1):
                found = shingles(text.as_py())
                sizes.append(len(found))
                keys.append(set_key(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())],
                ["doc_id", "n", "key"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        sized, "doc_id long, n long, key long"
    )


def _token_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Tokens of all sets, dealt to buckets by their top bits and packed per block.

    `marks` are tokens found frequent within the block. Their occurrences go to a
    bucket picked by the block (`known`), so that no bucket gathers them.
    """
    names = ["bucket", "known", "keys", "sizes", "counts", "tokens", "marks"]
    kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 5]

    def packed(held: dict[int, np.ndarray], turn: int) -> pa.RecordBatch:
        keys = np.fromiter(held, np.int64, len(held))
        sizes = np.array([len(s) for s in held.values()], np.int32)
        tokens = np.concatenate(list(held.values()))
        owner = np.repeat(np.arange(len(keys), dtype=np.int32), sizes)
        distinct, at, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        frequent = counts >= FREQUENT
        known = frequent[at]
        bucket = ((tokens >> np.uint64(44)) * np.uint64(buckets) >> np.uint64(20)).astype(np.int32)
        marks = distinct[frequent]
        mark_bucket = ((marks >> np.uint64(44)) * np.uint64(buckets) >> np.uint64(20)).astype(np.int32)
        rows: list[tuple] = []
        for kind in (False, True):
            mine = np.flatnonzero(known == kind)
            place = bucket[mine] if not kind else np.full(len(mine), turn % buckets, np.int32)
            order = mine[np.argsort(place, kind="stable")]
            place = np.sort(place)
            ends = np.flatnonzero(np.r_[place[1:] != place[:-1], True]) + 1 if len(place) else []
            start = 0
            for end in ends:
                part = order[start:end]
                who, first = np.unique(owner[part], return_index=True)
                low = tokens[part] & _LOW
                if kind:  # the bucket no longer tells the top bits
                    low = low | (bucket[part].astype(np.uint64) << np.uint64(44))
                    text = low.tobytes()
                else:
                    text = low.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                b = int(place[start])
                rows.append((
                    b, kind, keys[who].tobytes(), sizes[who].tobytes(),
                    np.diff(np.r_[first, len(part)]).astype(np.int32).tobytes(), text,
                    b"" if kind else (marks[mark_bucket == b] & _LOW).tobytes(),
                ))
                start = end
        sent = {r[0] for r in rows if not r[1]}
        for b in set(mark_bucket.tolist()) - sent:
            rows.append((b, False, b"", b"", b"", b"", (marks[mark_bucket == b] & _LOW).tobytes()))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names
        )

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shingles, turn = Shingler(), TaskContext.get().partitionId()
        held: dict[int, np.ndarray] = {}
        tokens = 0
        for batch in batches:
            for text in batch.column(0):
                found = shingles(text.as_py())
                if not len(found):
                    continue
                key = set_key(found)
                if key in held:
                    continue
                held[key] = found
                tokens += len(found)
                if tokens >= BLOCK_TOKENS:
                    yield packed(held, turn)
                    held, tokens, turn = {}, 0, turn + 1
        if held:
            yield packed(held, turn)

    return docs.select("text").mapInArrow(
        blocks,
        "bucket int, known boolean, keys binary, sizes binary, counts binary,"
        " tokens binary, marks binary",
    )


def _shared_tokens(blocks: DataFrame) -> DataFrame:
    """(key, token, rank): occurrences of tokens that two classes or more have.

    `rank` is size * 128 + frequency, so that within a class it sorts by frequency.
    """

    def unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        def column(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(b"".join(t.column(name).to_pylist()), kind)

        counts = column("counts", "<i4")
        return np.repeat(column("keys", "<i8"), counts), np.repeat(column("sizes", "<i4"), counts)

    def counted(t: pa.Table) -> pa.Table:
        bucket = np.uint64(t.column("bucket")[0].as_py())
        plain, known = (t.filter(t.column("known")) if k else t.filter(
            pc.invert(t.column("known"))) for k in (False, True))
        key, size = unpacked(plain)
        raw = np.frombuffer(b"".join(plain.column("tokens").to_pylist()), np.uint8).reshape(-1, 6)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :6] = raw
        token = wide.view("<u8").ravel()
        del raw, wide
        marks = np.unique(np.frombuffer(b"".join(plain.column("marks").to_pylist()), "<u8"))
        order = np.lexsort((key, token))
        key, size, token = key[order], size[order], token[order]
        if len(token):
            fresh = np.r_[True, (token[1:] != token[:-1]) | (key[1:] != key[:-1])]
            key, size, token = key[fresh], size[fresh], token[fresh]
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.array([], int)
        runs = np.diff(np.r_[starts, len(token)])
        if len(marks):
            at = np.minimum(np.searchsorted(marks, token[starts]), len(marks) - 1)
            runs = np.where(marks[at] == token[starts], FREQUENT, runs)
        often = np.repeat(np.minimum(runs, FREQUENT), np.diff(np.r_[starts, len(token)]))
        keep = often > 1
        full = token[keep] | (bucket << np.uint64(44))
        key2, size2 = unpacked(known)
        token2 = np.frombuffer(b"".join(known.column("tokens").to_pylist()), "<u8")
        return pa.table({
            "key": np.r_[key[keep], key2],
            "token": np.r_[full.view(np.int64), token2.view(np.int64)],
            "rank": np.r_[
                size[keep].astype(np.int64) * 128 + often[keep],
                size2.astype(np.int64) * 128 + FREQUENT,
            ],
        })

    return blocks.groupBy("bucket").applyInArrow(counted, "key long, token long, rank long")


def _prefixes(shared: DataFrame, percent: int) -> DataFrame:
    """(key, token, n, unshared, a, b, c): which prefixes hold the token, for classes that have any."""
    by_class = Window.partitionBy("key").orderBy("rank", "token")
    n = F.floor(F.col("rank") / 128)
    needed = F.ceil(n * percent / 100)
    counted = (
        shared.withColumn("n", n).withColumn("longest", n - needed + 1)
        .withColumn("a", F.row_number().over(by_class))
        .withColumn("unshared", F.col("n") - F.count(F.lit(1)).over(
            by_class.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        # Equal texts of different blocks may both have passed a frequent token on.
        # Counting it twice only lengthens a prefix.
        .withColumn("before", F.lag("token").over(by_class))
        .where("before is null or before != token").drop("before")
        # Tokens that no other class has come first in every order.
        .where("unshared < longest")
        .withColumn("power", F.length(F.bin(F.col("rank") % 128)))
    )
    for name, seed in (("b", 1), ("c", 2)):
        order = Window.partitionBy("key").orderBy("power", F.xxhash64(F.lit(seed), "token"), "token")
        counted = counted.withColumn(name, F.row_number().over(order))
    inside = [(F.col("unshared") + F.col(c) <= F.col("longest")).alias(c) for c in "abc"]
    return counted.select("key", "token", "n", "unshared", *inside).where("a or b or c")


def _candidate_sets(docs: DataFrame, sized: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, tokens, parity) of the classes in `keys`, made again from one text of each.

    Bit b of `parity` tells whether the tokens that leave the remainder b are odd in
    number. Two sets differ in at least as many tokens as their parities in bits.
    """
    readers = write_table(
        # Aggregated first: a class of very many equal texts is one row by then.
        sized.groupBy("key").agg(F.min("doc_id").alias("doc_id")).join(keys, "key", "left_semi")
        .select(F.coalesce("doc_id", F.lit(-1)).alias("reader")).distinct(), "readers",
    )
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("reader"), "text")

    def rebuilt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in batches:
            for start in range(0, len(batch), SETS_PER_BATCH):
                texts = batch.column(0)[start:start + SETS_PER_BATCH]
                found = [s for t in texts if len(s := shingles(t.as_py()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_key(s) for s in found], pa.int64()),
                     pa.array([s.tobytes() for s in found], pa.binary()),
                     pa.array([_parity(s) for s in found], pa.list_(pa.int64()))],
                    ["key", "tokens", "parity"],
                )

    sets = texts.join(small_side(readers), "reader", "left_semi").select("text").mapInArrow(
        rebuilt, "key long, tokens binary, parity array<long>"
    )
    return write_table(
        sets.groupBy("key").agg(F.first("tokens").alias("tokens"), F.first("parity").alias("parity")),
        "sets",
    )


def _parity(tokens: np.ndarray) -> np.ndarray:
    bits = 64 * PARITY_WORDS
    odd = np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _verified(pairs: DataFrame, filters: DataFrame, sets: DataFrame, percent: int, rows: int) -> DataFrame:
    """Pairs (u, v) that pass the other orders' filters, with `linked`.

    Of `sets` only those of such pairs are moved, as later rounds ask for few.
    """

    def side(table: DataFrame, name: str) -> DataFrame:
        return table.select(*[F.col(c).alias(name if c == "key" else f"{name}_{c}") for c in table.columns])

    close = (
        pairs.join(side(filters, "u"), "u").join(side(filters, "v"), "v")
        .where("100 * least(u_n, v_n) >= %d * greatest(u_n, v_n)" % percent)
        .where(F.arrays_overlap("u_b", "v_b") & F.arrays_overlap("u_c", "v_c"))
        .select("u", "v")
    )
    close = write_parts(close, "close", rows)
    wanted = write_parts(
        close.select(F.explode(F.array("u", "v")).alias("key")).distinct(), "wanted", rows
    )

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("u_tokens"), batch.column("v_tokens")):
                one, two = (np.frombuffer(s.as_py(), "<u8") for s in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                linked.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column("u"), batch.column("v"), pa.array(linked, pa.bool_())],
                ["u", "v", "linked"],
            )

    sets = sets.select("key", "tokens").join(small_side(wanted), "key", "left_semi")
    return (
        close.join(side(sets, "u"), "u").join(side(sets, "v"), "v")
        .select("u", "v", "u_tokens", "v_tokens")
        .mapInArrow(compared, "u long, v long, linked boolean")
    )


def _posting_lists(prefixes: DataFrame, sets: DataFrame) -> DataFrame:
    """(list, key, n, common, code, label, parity): classes that share a token of the first prefixes.

    `common` is how many of the n tokens any other class has.

    Near copies share many tokens and so the same list many times over; lists of equal
    number, xor and sum of hashed keys are one. `code` orders the classes alike in all
    lists, those with the fewest tokens of their own first.
    """
    entries = prefixes.where("a").select("token", "key", "n", "unshared")
    hashed = F.xxhash64("key")
    alike = entries.groupBy("token").agg(
        F.count(F.lit(1)).alias("m"), F.bit_xor(hashed).alias("x"),
        F.sum(F.shiftrightunsigned(hashed, 20).cast("decimal(38,0)")).alias("s"),
    ).where("m > 1")
    kept = write_table(
        alike.groupBy("m", "x", "s").agg(F.min("token").alias("token")).select("token"), "lists"
    )
    code = F.shiftleft(F.col("unshared").cast("long"), 32) + F.shiftrightunsigned(
        F.xxhash64(F.lit("order"), "key"), 32
    )
    listed = write_table(
        entries.join(kept, "token").select(
            F.col("token").alias("list"), "key", "n", (F.col("n") - F.col("unshared")).alias("common"),
            code.alias("code"), F.col("key").alias("label"),
        ), "lists",
    )
    return write_table(listed.join(sets.select("key", "parity"), "key"), "lists")


def _joined_labels(links: DataFrame, rows: int) -> DataFrame:
    """(label, joined): for linked labels (u, v) the smallest label within two links.

    Not the whole component, but the same for nearly all of one that hangs on a few
    centres; a label stays within its component in any case.
    """
    both = both_ways(links)
    near = write_parts(
        both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "near", rows
    )
    far = both.join(near.select(F.col("u").alias("v"), "m"), "v").groupBy("u").agg(F.min("m").alias("m"))
    return write_parts(far.select(F.col("u").alias("label"), F.col("m").alias("joined")), "joined", rows)


def _links(prefixes: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """(key, component) of classes with links, None if there are none.

    A list of m classes is not turned into its m (m - 1) / 2 pairs, unless it has
    FEW. In each round some of its classes are centres and are compared with the
    rest. What links gets one label, and classes with one label need no comparison.
    Centres leave their list when they are done; it ends when it is empty or all of
    one label. So no pair between labels is left out. Centres grow fourfold a
    round, and the rounds with the logarithm of the longest list.
    """
    filters = write_table(
        prefixes.groupBy("key").agg(
            F.first("n").alias("n"),
            F.collect_list(F.when(F.col("b"), F.col("token"))).alias("b"),
            F.collect_list(F.when(F.col("c"), F.col("token"))).alias("c"),
        ), "filters",
    )
    lists = _posting_lists(prefixes, sets)
    done: DataFrame | None = None
    found: DataFrame | None = None
    slots = CENTRES
    while True:
        rows = lists.count()
        if not rows:
            break
        several = lists.groupBy("list").agg(
            F.count(F.lit(1)).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")
        ).where("lo != hi").select("list", "m")
        lists = write_parts(lists.join(write_parts(several, "several", rows), "list"), "lists", rows)
        slot = F.when(F.col("m") <= FEW, F.col("key")).otherwise(
            F.pmod(F.xxhash64(F.lit(slots), "key"), F.lit(slots))
        )
        first = F.min(F.struct("code", *[
            F.col(c).alias(f"centre_{c}") for c in ("key", "n", "common", "label", "parity")
        ])).alias("c")
        centres = write_parts(
            lists.groupBy("list", slot.alias("slot")).agg(first)
            .select("list", "c.*").drop("code"), "centres", rows,
        )
        # Two sets share at most what each has in common with any other.
        shared, both = F.least("common", "centre_common"), F.col("n") + F.col("centre_n")
        differ = reduce(Column.__add__, [
            F.bit_count(F.get("parity", F.lit(k)).bitwiseXOR(F.get("centre_parity", F.lit(k))))
            for k in range(PARITY_WORDS)
        ])
        pairs = (
            lists.join(centres, "list").where("label != centre_label")
            .where(100 * shared >= percent * (both - shared))
            .where((100 + percent) * differ <= (100 - percent) * both)
            .groupBy(F.least("key", "centre_key").alias("u"), F.greatest("key", "centre_key").alias("v"))
            .agg(F.min(F.least("label", "centre_label")).alias("u_label"),
                 F.min(F.greatest("label", "centre_label")).alias("v_label"))
        )
        if done is not None:
            pairs = pairs.join(done, ["u", "v"], "left_anti")
        pairs = write_parts(pairs, "pairs", rows)
        verdicts = write_table(_verified(pairs.select("u", "v"), filters, sets, percent, rows), "verdicts")
        done = pairs.select("u", "v") if done is None else done.unionByName(pairs.select("u", "v"))
        linked = verdicts.where("linked").select("u", "v")
        found = linked if found is None else found.unionByName(linked)
        labels = write_parts(
            pairs.join(linked, ["u", "v"]).select(F.col("u_label").alias("u"), F.col("v_label").alias("v")),
            "labels", rows,
        )
        lists = write_parts(
            lists.drop("m")
            .join(centres.select("list", F.col("centre_key").alias("key")), ["list", "key"], "left_anti")
            .join(_joined_labels(labels, rows), "label", "left")
            .select("list", "key", "n", "common", "code", "parity",
                    F.coalesce("joined", "label").alias("label")),
            "lists", rows,
        )
        slots *= MORE_CENTRES
    return None if found is None else components(found).toDF("key", "component")


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of `docs` (doc_id, text).

    Two texts link when 100 * shared >= percent * united over their sets of
    five-word shingles; `component_id` is the smallest doc_id reachable by links.
    Rows with null or repeated ids are compared by their texts like others; null
    ids are never the smallest, and a component of nulls alone gets null. Texts
    without words have size 0 and link with nothing. An empty table gives no
    rows; other columns are ignored.

    Sets hold 64-bit hashes; classes of equal sets are known by a 64-bit key.
    """
    spark = docs.sparkSession
    sized = write_table(_sets(docs), "sized")
    total = sized.agg(F.sum("n").alias("n")).first()["n"] or 0
    buckets = min(2**20, max(total // BUCKET_TOKENS + 1, shuffle_partitions(spark)))
    prefixes = write_table(
        _prefixes(_shared_tokens(_token_blocks(docs, buckets)), percent), "prefixes"
    )
    sets = _candidate_sets(docs, sized, prefixes.select("key").distinct())
    together = _links(prefixes, sets, percent)
    classes = sized.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("smallest"))
    if together is not None:
        classes = write_table(
            classes.join(together, "key", "left").select(
                "key", "smallest", F.coalesce("component", "key").alias("component")), "classes",
        )
        lowest = classes.groupBy("component").agg(F.min("smallest").alias("smallest"))
        classes = classes.select("key", "component").join(write_table(lowest, "lowest"), "component")
    named = write_table(classes.select("key", F.col("smallest").alias("component_id")), "named")
    return sized.join(named, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def kept_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows of `docs` with all their columns, one of each component: the smallest doc_id.

    Texts are not shuffled when few documents go. Rows with a null id stay; of rows
    that repeat the smallest id all stay.
    """
    gone = write_table(
        jaccard_components(docs, percent).where("doc_id != component_id")
        .select(F.col("doc_id").alias("gone_id")).distinct(), "gone",
    )
    named = small_side(gone)
    return docs.join(named, docs["doc_id"] == named["gone_id"], "left_anti")
