"""Deterministic frames over the given tables (see FIXTURES.md, part 3).

They stand in for dirty input, for the model's answers and for the mapping, so
that every operator can be compared with SQL over the same tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxlake.functions.numbers import int_div
from voxlake.operators.batching import group_batches

CATEGORIES = ["Produit", "Service", "Tarifs", "Vide"]
BATCH = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k, t = F.col("doc_id"), F.col("text")
    text = (
        F.when(k % 17 == 3, F.lit(""))
        .when(k % 17 == 5, F.lit("nan"))
        .when(k % 17 == 7, F.lit(None).cast("string"))
        .when(k % 17 == 9, F.concat(F.lit(" \t"), t, F.lit("　")))
        .when(k % 17 == 11, F.lit("   "))
        .otherwise(t)
    )
    source = (
        F.when(k % 11 == 0, F.lit(None).cast("string"))
        .when(k % 11 == 1, F.lit("  web "))
        .otherwise(F.col("source"))
    )
    lang = F.when(k % 13 != 0, F.col("lang"))
    return d.select("doc_id", text.alias("text"), source.alias("source"), lang.alias("lang"))


def plain_summary(text: Column) -> Column:
    """A short start of the text; of longer ones also length and digest of the whole."""
    plain = F.regexp_replace(text, "[ \\t\\n\\r]+", " ")
    return F.when(F.length(plain) <= 60, plain).otherwise(F.concat(
        F.left(plain, F.lit(60)), F.lit(" "), F.length(plain).cast("string"), F.lit(" "),
        F.md5(plain),
    ))


def ideal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a perfect model would answer, one row per document."""
    # The summary is made before the join: where only that is asked for, no text is shuffled.
    d = table(spark, sf_dir, "documents").withColumn("summary", plain_summary(F.col("text")))
    labels = table(spark, sf_dir, "labels")
    k = F.col("doc_id")
    fault = (
        F.when(k % 29 == 4, "missing").when(k % 31 == 6, "dup").when(k % 37 == 8, "ghost")
        .when(k % 41 == 10, "long").when(k % 43 == 12, "blank").when(k % 47 == 14, "short")
        .otherwise("ok")
    )
    return d.join(labels, "doc_id", "left").select(
        "doc_id",
        int_div(k, BATCH).alias("batch_idx"),
        (k % BATCH).cast("int").alias("p"),
        F.concat(F.lit("doc_"), k.cast("string")).alias("id"),
        "text", "source", "lang",
        F.when(F.col("toxic") == 1, "négatif").when(F.col("quality") == 1, "positif")
        .otherwise("neutre").alias("sentiment"),
        F.concat(F.lit("theme "), "lang", F.lit(" "), (k % 23).cast("string")).alias("theme"),
        "summary",
        fault.alias("fault"),
    )


def ideal_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ideal answers in the shape of stored results."""
    return ideal(spark, sf_dir).select(
        "batch_idx", F.col("p").cast("bigint").alias("pos"),
        F.col("id").alias("verbatim_id"), "theme", "summary", "sentiment",
        F.col("text").alias("texte_original"), "source",
        F.lit(None).cast("string").alias("macro_theme"),
    )


def sent_batches(
    spark: SparkSession, sf_dir: str, carry: Sequence[str] = ("text", "source", "lang")
) -> DataFrame:
    """What was sent, grouped by batch; place and number follow from the document id."""
    k = F.col("doc_id")
    batched = table(spark, sf_dir, "documents").select(
        int_div(k, BATCH).alias("batch_idx"), (k % BATCH).cast("int").alias("pos_in_batch"),
        F.concat(F.lit("doc_"), k.cast("string")).alias("id"), *carry,
    )
    return group_batches(batched, carry)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three attempts per batch: (batch_idx, attempt, raw)."""
    i = ideal(spark, sf_dir)
    fault = F.col("fault")
    item = F.struct(
        F.when(fault == "ghost", F.concat(F.lit("ghost_"), F.col("doc_id").cast("string")))
        .otherwise(F.col("id")).alias("verbatim_id"),
        F.when(fault == "long", "a b c d e f").when(fault == "blank", "  ")
        .otherwise(F.col("theme")).alias("theme"),
        F.when(fault == "short", " ok ").otherwise(F.col("summary")).alias("summary"),
        "sentiment",
    )
    n = F.when(fault == "missing", 0).when(fault == "dup", 2).otherwise(1)
    answers = i.groupBy("batch_idx").agg(
        F.array_sort(F.collect_list(F.struct("p", n.alias("n"), item.alias("item")))).alias("g")
    ).select(
        "batch_idx",
        F.flatten(F.transform("g", lambda x: F.array_repeat(x["item"], x["n"]))).alias("analyses"),
    )
    spoiled = F.transform("analyses", lambda x, k: F.struct(
        x["verbatim_id"].alias("verbatim_id"), x["theme"].alias("theme"),
        x["summary"].alias("summary"),
        F.when(k == 0, "mixte").otherwise(x["sentiment"]).alias("sentiment"),
    ))
    b, a = F.col("batch_idx"), F.col("attempt")
    kind = (
        F.when(b % 13 == 9, F.element_at(
            F.array(F.lit("none"), F.lit("prose"), F.lit("bad_sentiment")), a + 1))
        .when((b % 11 == 5) & (a == 0), "bad_sentiment")
        .when((b % 7 == 1) & (a == 0), "none")
        .when((b % 7 == 2) & (a == 0), "prose")
        .when(b % 7 == 2, "fenced")
        .when(b % 7 == 3, "wrapped")
        .when((b % 7 == 4) & (a == 0), "two_objects")
        .otherwise("plain")
    )
    j = F.col("j")
    raw = (
        F.when(F.col("made") == "plain", j)
        .when(F.col("made") == "fenced", F.concat(F.lit("```json\n"), j, F.lit("\n```")))
        .when(F.col("made") == "wrapped",
              F.concat(F.lit("Voici la réponse demandée : "), j, F.lit(" Bonne lecture.")))
        .when(F.col("made") == "two_objects", F.concat(j, F.lit(" "), j))
        .when(F.col("made") == "prose", F.lit("Je ne peux pas répondre."))
        .when(F.col("made") == "bad_sentiment",
              F.to_json(F.struct(F.col("spoiled").alias("analyses"))))
    )
    return (
        answers.select("batch_idx", F.to_json(F.struct("analyses")).alias("j"),
                       spoiled.alias("spoiled"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("attempt"))
        .withColumn("made", kind)
        .select("batch_idx", "attempt", raw.alias("raw"))
    )


def mapping_rows(themes: DataFrame) -> DataFrame:
    """MAPPING for the themes that the fixture maps."""
    n = F.element_at(F.split("theme", " "), -1).cast("int")
    macro = (
        F.when(n == 22, "Hors liste").when(n % 4 == 0, "Produit")
        .when(n % 4 == 1, "Service").when(n % 4 == 2, "Tarifs")
    )
    return themes.select("theme", macro.alias("macro_theme")).where("macro_theme is not null")


def category_rows(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    names = CATEGORIES if names is None else names
    return spark.createDataFrame(list(enumerate(names)), "pos int, category string")


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with gaps in text and source, to be filled from raw metadata."""
    i, k = ideal(spark, sf_dir), F.col("doc_id")
    return i.select(
        F.col("id").alias("verbatim_id"),
        "theme", "summary", "sentiment",
        F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.lit(""))
        .otherwise(F.col("text")).alias("texte_original"),
        F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, F.lit("inconnue"))
        .otherwise(F.col("source")).alias("source"),
    )


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of two raw files with the ids of `ideal`; the later one wins."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    known = d.where(k % 19 != 1).select(
        k.alias("row"), F.concat(F.lit("doc_"), k.cast("string")).alias("id"), "text", "source"
    )
    a = known.select(F.lit("a_raw").alias("file"), "*")
    b = known.where(F.col("row") % 3 == 0).select(
        F.lit("b_raw").alias("file"), "row", "id",
        F.concat(F.lit("v2 "), "text").alias("text"), "source",
    )
    return a.unionByName(b)
