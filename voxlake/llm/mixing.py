"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxlake.llm.common import WORDS
from voxlake.session import small_side, write_table

# Weights of the sources in order, repeating; most takes of a text.
SOURCE_WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
# Buckets per doubling of the rank: the one bucket a source cuts through is sorted.
BUCKETS_PER_DOUBLING = 512


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """A null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on nothing but the id and the seed."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = SOURCE_WEIGHTS, most: int = MOST_COPIES
) -> DataFrame:
    """Targets of `sizes` (source, key, source_size: one row per source).

    Shares are in proportion to the weights; a target above `most` times its
    source is set to that and the excess shared anew, which ends where one level
    per unit of weight holds for all sources below their bound. Windows run over
    sources, of which there are few next to documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = sizes.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    ).withColumn("bound", F.col("source_size") * most / F.col("weight"))
    up = Window.orderBy("bound", F.col("source").isNull(), "source")
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most) / F.sum("weight").over(after)
    first = weighted.withColumn("level", level)
    whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    holds = F.first(F.when(F.col("level") <= F.col("bound"), F.col("level")), ignorenulls=True).over(whole)
    return first.withColumn(
        "target",
        F.least(
            (F.col("source_size") * most).cast("double"),
            F.coalesce(holds * F.col("weight"), (F.col("source_size") * most).cast("double")),
        ),
    ).select("source", "key", "source_size", "target")


class Mix:
    """The decisions of one mix, applied to documents without shuffling their texts.

    Every document of a source is expected `copies = min(most, c * weight)` times,
    with c such that the expected words meet the target; the weight is the number
    of binary digits of its size, so that scraps are taken less often. The whole
    part of that is certain. The rest is a Pareto order sample: documents are
    ranked by random odds over inclusion odds, and the first ones are taken until
    their words come nearest to what is missing.

    One histogram of ranks per source finds the bucket where the cut falls; only
    that bucket is sorted. Everything that is moved is one short row per document
    or less. Ranks depend on doc_id and seed alone, so reruns agree. Rows that
    share doc_id and size are interchangeable and are cut in any order.
    """

    def __init__(
        self, docs: DataFrame, weights: Sequence[int] = SOURCE_WEIGHTS,
        most: int = MOST_COPIES, seed: int = 1,
    ) -> None:
        self.most, self.seed = most, seed
        self.rows = write_table(
            docs.select(
                F.col("doc_id").cast("long").alias("doc_id"), "source",
                word_count(F.col("text")).alias("size"),
            ).withColumn("key", _source_key(F.col("source"))),
            "sizes",
        )
        per_level = write_table(
            self.rows.withColumn("digits", F.length(F.bin("size")))
            .groupBy("source", "key", "digits").agg(F.sum("size").alias("words")),
            "levels",
        )
        sizes = per_level.groupBy("source", "key").agg(F.sum("words").alias("source_size"))
        targets = write_table(source_targets(sizes, weights, most), "targets")
        down = Window.partitionBy("key").orderBy(F.desc("digits"))
        above = F.coalesce(
            F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        )
        rest = F.sum(F.col("words") * F.col("digits")).over(
            down.rowsBetween(0, Window.unboundedFollowing)
        )
        factors = (
            per_level.where("words > 0").join(targets.select("key", "target"), "key")
            .withColumn("c", (F.col("target") - above * most) / rest)
            .where(F.col("c") * F.col("digits") <= most)
            .groupBy("key").agg(F.max_by("c", "digits").alias("c"))
        )
        self.sources = write_table(
            targets.join(factors, "key", "left").withColumn(
                # No level below its bound: every document is taken `most` times.
                "c", F.coalesce("c", F.lit(float(most)))
            ),
            "sources",
        )
        ranked = self._ranked(self.rows)
        certain = ranked.groupBy("key").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"))
        by_bucket = (
            ranked.where("bucket is not null")
            .groupBy("key", "bucket").agg(F.sum("size").alias("words"))
        )
        order = Window.partitionBy("key").orderBy("bucket")
        cut = (
            by_bucket.withColumn("upto", F.sum("words").over(order))
            .join(certain, "key").join(self.sources.select("key", "target"), "key")
            .withColumn("missing", F.col("target") - F.col("sure"))
            .where("upto > missing")
            .groupBy("key").agg(
                F.min("bucket").alias("cut"), F.first("missing").alias("missing"),
                F.min_by(F.col("upto") - F.col("words"), "bucket").alias("before"),
            )
        )
        self.cuts = write_table(
            self.sources.select("key").join(cut, "key", "left"), "cuts"
        )
        at_cut = self._cut(ranked).where("bucket = cut")
        row_order = Window.partitionBy("key").orderBy("rank", "doc_id", "size")
        so_far = F.sum("size").over(row_order.rowsBetween(Window.unboundedPreceding, 0))
        taken = F.col("before") + so_far - F.col("size") / 2 <= F.col("missing")
        self.edge = write_table(
            at_cut.withColumn("extra", taken.cast("int"))
            .select("doc_id", "source", "key", "size", "whole", "extra"), "edge",
        )

    def _ranked(self, rows: DataFrame) -> DataFrame:
        """`rows` (doc_id, key, size, ...) with certain copies, rank and its bucket."""
        known = small_side(self.sources.select("key", "c"))
        copies = F.least(F.lit(float(self.most)), F.col("c") * F.length(F.bin("size")))
        odds = F.col("u") / (1 - F.col("u"))
        return (
            rows.join(known, "key")
            .withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0.0))
            .withColumn("whole", F.floor("copies"))
            .withColumn("part", F.col("copies") - F.col("whole"))
            .withColumn("u", _uniform(F.col("doc_id"), self.seed))
            .withColumn(
                "rank",
                F.when(F.col("part") > 0, odds * (1 - F.col("part")) / F.col("part")),
            )
            .withColumn("bucket", F.floor(F.log2("rank") * BUCKETS_PER_DOUBLING))
            .drop("c", "u", "copies", "part")
        )

    def _cut(self, ranked: DataFrame) -> DataFrame:
        return ranked.join(small_side(self.cuts), "key")

    def decisions(self) -> DataFrame:
        """(doc_id, source, key, size, copies) per row."""
        away = self._cut(self._ranked(self.rows)).where(
            "bucket is null or cut is null or bucket != cut"
        )
        return away.select(
            "doc_id", "source", "key", "size",
            (F.col("whole") + self._before_cut()).alias("copies"),
        ).unionByName(self.edge.select(
            "doc_id", "source", "key", "size", (F.col("whole") + F.col("extra")).alias("copies")
        ))

    @staticmethod
    def _before_cut() -> Column:
        inside = F.col("cut").isNull() | (F.col("bucket") < F.col("cut"))
        return (F.col("bucket").isNotNull() & inside).cast("int")

    def applied(self, docs: DataFrame) -> DataFrame:
        """Rows of `docs` with all their columns, each as often as the mix takes it.

        Only the few documents at a cut are looked up; all others are decided
        where they are read.
        """
        edge = write_table(
            self.edge.groupBy("doc_id", "key", "size")
            .agg((F.avg("extra") >= 0.5).cast("int").alias("extra")), "edge",
        )
        named = edge.toDF("edge_id", "edge_key", "edge_size", "extra")
        packed = docs.select(
            F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"),
            word_count(F.col("text")).alias("size"), _source_key(F.col("source")).alias("key"),
        )
        same = (
            F.col("doc_id").eqNullSafe(F.col("edge_id"))
            & (F.col("key") == F.col("edge_key")) & (F.col("size") == F.col("edge_size"))
        )
        decided = self._cut(self._ranked(packed)).join(small_side(named), same, "left")
        copies = F.col("whole") + F.coalesce("extra", self._before_cut())
        return decided.withColumn("copies", copies).where("copies > 0").withColumn(
            "copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
        ).select("doc.*")

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken) per row."""
        known = small_side(self.sources.select("key", "source_size", "target"))
        return self.decisions().join(known, "key").select(
            "doc_id", "size", "source_size", "target",
            (F.col("size") * F.col("copies")).alias("taken"),
        )


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = SOURCE_WEIGHTS, most: int = MOST_COPIES, seed: int = 1
) -> DataFrame:
    """Words the mix takes of every row of `docs` (doc_id, text, source).

    A document's size is its number of words between ASCII white space, 0 for a
    null text; those of size 0 are never taken. A null source is a source, last
    in order. Null ids share one rank. An empty table gives no rows; other
    columns are ignored.
    """
    return Mix(docs, weights, most, seed).taken()


def mixed_documents(
    docs: DataFrame, weights: Sequence[int] = SOURCE_WEIGHTS, most: int = MOST_COPIES, seed: int = 1
) -> DataFrame:
    """The mix itself: rows of `docs` with all their columns, each as often as it is taken."""
    return Mix(docs, weights, most, seed).applied(docs)
