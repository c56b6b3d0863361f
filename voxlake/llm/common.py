"""Shared by the operators: table access, patterns, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxlake.session import write_table

# White space of the contracts, and what lies between it.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# Rows of a written part of a table that holds a few numbers a row.
ROWS_PER_PART = 250_000


def write_parts(df: DataFrame, name: str, rows: int) -> DataFrame:
    """Write a table of at most about `rows` rows in as many parts as that needs.

    Rounds over what is left of a problem soon hold little; without this each of
    their tables would have a file for every shuffle partition.
    """
    parts = rows // ROWS_PER_PART + 1
    if parts < shuffle_partitions(df.sparkSession):
        df = df.coalesce(parts)
    return write_table(df, name)


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h"),
    ).first()
    return int(row["n"]), int(row["h"])


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of `links` (u, v: long); component is the smallest node.

    `links` is written. Alternates large-star and small-star steps until nothing
    changes. Every step joins written tables, so adaptive execution can split a node
    with very many links, and rounds grow with the logarithm of the longest chain.
    Nodes without links are not returned.
    """
    n = links.count()
    edges = write_parts(
        links.where("u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", n,
    )
    seen = _fingerprint(edges)
    while seen[0]:
        n = 2 * seen[0]
        both = both_ways(edges)
        lowest = write_parts(
            both.groupBy("u").agg(F.min("v").alias("m"))
            .select("u", F.least("u", "m").alias("m")), "lowest", n,
        )
        # Large star: every larger neighbour moves to the smallest one known here.
        large = write_parts(
            both.where("v > u").join(lowest, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large", n,
        )
        # Small star: a node and its smaller neighbours move to the smallest of them.
        lowest = write_parts(large.groupBy("u").agg(F.min("v").alias("m")), "lowest", n)
        edges = write_parts(
            large.join(lowest, "u").where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges", n,
        )
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return write_parts(
        edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        .unionByName(roots.select("node", F.col("node").alias("component"))),
        "components", 2 * seen[0],
    )
