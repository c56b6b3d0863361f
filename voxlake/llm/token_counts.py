"""Token counts kept in a cache under digests of content and tokenizer.

Texts are known by the digest of their normalised content and counts by that and the
digest of the tokenizer. Digests are joined to the counts stored so far; one text of
each distinct digest that is missing is encoded, and its count appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from importlib.metadata import version as library_version

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxlake.llm.vocabularies import file_digest, vocabulary
from voxlake.operators.lookup import lookup
from voxlake.session import path_exists, small_side, write_table

LIMIT = 1024
# Counts are those of whole texts as they are; the cache is never asked to guess.
COUNTS = "digest string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of all that decides on counts: the vocabulary file, and the library that reads it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    told = f"{file_digest(path)} {library} {library_version(library)}"
    return hashlib.sha256(told.encode()).hexdigest()


def _counts_path(cache: str, path: str) -> str:
    return f"{cache.rstrip('/')}/version={tokenizer_version(path)}"


def cached_counts(spark: SparkSession, cache: str, path: str) -> DataFrame:
    """(digest, n_tokens) stored for a tokenizer, one row a digest; none if there is no cache yet.

    Two runs at a time may both append a digest, with the same count.
    """
    where = _counts_path(cache, path)
    if not path_exists(spark, where):
        return spark.createDataFrame([], COUNTS)
    stored = spark.read.schema(COUNTS).parquet(where)
    return stored.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def _encoded(texts: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of rows (digest, text)."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(path).ids
        for batch in batches:
            counts = [len(encode(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"]
            )

    return texts.mapInArrow(counted, COUNTS)


def whole_text(text: Column) -> Column:
    """Null counts as empty. Any other change could change the number of tokens."""
    return F.coalesce(text, F.lit(""))


def count_tokens(
    docs: DataFrame,
    path: str,
    cache: str,
    limit: int = LIMIT,
    normalise: Callable[[Column], Column] = whole_text,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, digest) per row of `docs` (doc_id, text).

    `path` is a tokenizer file and `cache` a folder that all executors share. Texts
    are encoded after `normalise`; a tokenizer that lower-cases or drops white space
    may be given a stronger one. `n_bytes` is the text's own size in UTF-8.

    Null texts count as empty and have 0 bytes; empty texts are cached like others.
    Rows with null or repeated ids each get their row. Texts of any length are encoded
    whole. An empty table gives no rows and appends nothing; other columns are
    ignored.

    Texts that are missing are shuffled once, at most one of each digest and task, so
    copies cost nothing; when few are missing only those are. The cache is appended
    to when all of them are encoded. A lost executor repeats its tasks only, and a
    run that ends early leaves the cache as it was.
    """
    spark = docs.sparkSession
    content = docs.select(
        F.col("doc_id").cast("long"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        normalise(F.col("text")).alias("text"),
    ).withColumn("digest", F.sha2("text", 256))
    keyed = write_table(content.select("doc_id", "n_bytes", "digest"), "digests")
    known = cached_counts(spark, cache, path)
    missing = write_table(keyed.select("digest").distinct().join(known, "digest", "left_anti"), "missing")
    if not missing.isEmpty():
        texts = content.select("digest", "text")
        if path_exists(spark, _counts_path(cache, path)):
            texts = texts.join(small_side(missing), "digest", "left_semi")
        one_each = texts.groupBy("digest").agg(F.first("text").alias("text"))
        _encoded(one_each, path).write.mode("append").parquet(_counts_path(cache, path))
    counts = write_table(
        cached_counts(spark, cache, path).join(keyed.select("digest").distinct(), "digest", "left_semi"), "counts"
    )
    # Both grow with the corpus, so neither is broadcast.
    return lookup(keyed, counts, "digest", broadcast_rows=0).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "digest"
    )
