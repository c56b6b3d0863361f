"""Preparing data sets: one schema for any table, and a synthetic review table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxlake.operators.positions import land_positions
from voxlake.sources.columns import find_column, longest_text_column

DATASET_COLUMNS = ["id", "text", "source", "lang"]


def pick_text_column(df: DataFrame, candidates: Sequence[str]) -> str:
    """First exact candidate, else the column with the longest mean text."""
    i = find_column(df.columns, candidates, case_sensitive=True)
    return df.columns[i] if i is not None else longest_text_column(df).first()["column_name"]


def normalize_dataset(
    df: DataFrame, text_col: str, prefix: str, source: str, lang: str, limit: int | None = None
) -> DataFrame:
    """Rows in input order as `id={prefix}_{i}`, text, constant source and language."""
    placed = land_positions(df.select(F.col(text_col).cast("string").alias("text")), limit=limit)
    if limit is not None:
        placed = placed.where(F.col("row_idx") < limit)
    return placed.select(
        F.concat(F.lit(f"{prefix}_"), F.col("row_idx").cast("string")).alias("id"),
        "text", F.lit(source).alias("source"), F.lit(lang).alias("lang"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)


# --- synthetic multilingual reviews ----------------------------------------------

# Own domains of the generator.
SOURCES = ["web_form", "phone_call", "branch_visit", "mobile_review", "email"]
FEES = [3, 7, 12, 25, 40, 90, 180]
WAITS = [5, 8, 12, 25, 35, 50]
# (id prefix, language, rows per 100 English rows)
PARTS = [("fr", "fr", 100), ("es", "es", 80), ("pt", "pt", 80), ("de", "de", 80), ("be", "fr", 60)]

# Own wording.
TEMPLATES = {
    "fr": [
        "On m'a prélevé {frais} € sans un mot d'explication.",
        "Après {attente} minutes de musique, l'appel a coupé.",
        "Mon dossier a avancé vite, merci à la conseillère.",
        "Rien à signaler, le compte fait ce qu'on lui demande.",
    ],
    "es": [
        "Me cobraron {frais} € por una transferencia normal.",
        "Esperé {attente} minutos en la sucursal y nadie vino.",
        "La aplicación va muy bien desde la última versión.",
        "Es un banco corriente, ni mejor ni peor que otros.",
    ],
    "pt": [
        "Cobraram {frais} € de comissão que ninguém anunciou.",
        "Fiquei {attente} minutos à espera ao telefone.",
        "Abri a conta em casa e correu tudo muito bem.",
        "O balcão está aberto de manhã, como seria de esperar.",
    ],
    "de": [
        "Plötzlich {frais} € Gebühr, und keiner kann sagen wofür.",
        "{attente} Minuten in der Warteschleife, dann aufgelegt.",
        "Die Beratung zum Kredit war klar und freundlich.",
        "Das Konto ist in Ordnung, mehr brauche ich nicht.",
    ],
    "be": [
        "Septante euros demandés, {frais} € de frais en plus.",
        "Le guichet de ma commune m'a fait attendre {attente} minutes.",
        "Payer avec mon GSM marche du premier coup.",
        "La banque est correcte, sans plus.",
    ],
}
FLEMISH = [
    "De kaart werd geweigerd aan de kassa, zonder uitleg.",
    "Vlot geholpen in het kantoor, dank u wel.",
    "De app doet wat ze moet doen.",
]


def _draw(seed: int, key: Column, what: str, n: int) -> Column:
    """A repeatable pick in 0..n-1 that depends only on the seed and the row."""
    digest = F.md5(F.concat(F.lit(f"{seed}/{what}/"), key))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % n).cast("int")


def _choose(values: Sequence, seed: int, key: Column, what: str) -> Column:
    domain = F.array(*[F.lit(str(v)) for v in values])
    return F.element_at(domain, _draw(seed, key, what, len(values)) + 1)


def expand_templates(
    spark: SparkSession, templates: Sequence[str], lang: str, n: int, prefix: str, seed: int = 7
) -> DataFrame:
    """`n` reviews from templates: fee, wait and source are drawn per row."""
    key = F.col("id")
    text = _choose(templates, seed, key, "template")
    text = F.replace(text, F.lit("{frais}"), _choose(FEES, seed, key, "fee"))
    text = F.replace(text, F.lit("{attente}"), _choose(WAITS, seed, key, "wait"))
    rows = spark.range(n).select(
        F.col("id").alias("i"), F.concat(F.lit(f"bank_{prefix}_"), F.col("id").cast("string")).alias("id")
    )
    return rows.select(
        "i", "id", text.alias("text"), _choose(SOURCES, seed, key, "source").alias("source"),
        F.lit(lang).alias("lang"),
    )


def multilingual_reviews(
    english: DataFrame,
    n_english: int,
    size: int | None = None,
    seed: int = 7,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
) -> DataFrame:
    """English rows (row_idx, text) with drawn sources, plus generated languages.

    The languages keep their proportion to the `n_english` first English rows.
    Every third Belgian row becomes Flemish. All rows are put into a random but
    repeatable order, of which `size` rows are taken.
    """
    spark = english.sparkSession
    key = F.col("id")
    base = english.where(F.col("row_idx") < n_english).select(
        F.concat(F.lit("bank_en_"), F.col("row_idx").cast("string")).alias("id"), "text"
    )
    out = base.select(
        "id", "text", _choose(SOURCES, seed, key, "source").alias("source"),
        F.lit("en").alias("lang"),
    )
    for prefix, lang, share in PARTS:
        part = expand_templates(
            spark, templates[prefix], lang, n_english * share // 100, prefix, seed
        )
        if prefix == "be":
            flemish = F.col("i") % 3 == 0
            part = part.withColumn(
                "text", F.when(flemish, _choose(FLEMISH, seed, key, "flemish")).otherwise(F.col("text"))
            ).withColumn("lang", F.when(flemish, "nl").otherwise(F.col("lang")))
        out = out.unionByName(part.select(*DATASET_COLUMNS))
    if size is None:
        return out
    shuffled = out.orderBy(F.md5(F.concat(F.lit(f"{seed}/order/"), key)), "id")
    placed = land_positions(shuffled, limit=size)
    return placed.where(F.col("row_idx") < size).select(*DATASET_COLUMNS)
