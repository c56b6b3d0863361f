"""Joining facts with a table that has one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxlake.session import BROADCAST_ROWS, is_small, small_side, write_table

HOT_ROWS = 1_000_000


def lookup(
    facts: DataFrame,
    table: DataFrame,
    key: str,
    hot_rows: int = HOT_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left join with `table` (written, unique on `key`), safe against hot keys.

    A table measured as small is broadcast. Beyond that both sides are shuffled,
    and each key with more than `hot_rows` facts is spread over as many partitions
    as it has times that number, its single table row repeated for each. Rows
    without a key match nothing and are spread freely. Every row is kept.
    `facts` is read twice then (once for its keys only) and should be a scan:
    its rows are dealt out in scan order, so that even exact copies of one row
    are spread, and a repeated task deals them out the same way.
    """
    if is_small(table, broadcast_rows):
        return facts.join(F.broadcast(table), key, "left")
    hot = write_table(
        facts.groupBy(key).count().where(F.col("count") > hot_rows)
        .where(F.col(key).isNotNull())
        .select(key, F.ceil(F.col("count") / hot_rows).alias("_salts")),
        "hot-keys",
    )
    hot = small_side(hot)
    dealt = facts.withColumn("_dealt", F.monotonically_increasing_id())
    salted = dealt.join(hot, key, "left").withColumn(
        "_salt",
        F.when(F.col(key).isNull(), F.col("_dealt"))
        .otherwise(F.col("_dealt") % F.coalesce("_salts", F.lit(1))),
    )
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_salts", F.lit(1)) - 1)
    repeated = table.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return salted.join(repeated, [key, "_salt"], "left").drop("_salts", "_salt", "_dealt")
