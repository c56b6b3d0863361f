"""Language identification of mixed texts.

A text is a mixture of languages: each of its letter trigrams comes from language l
with its share s(l). Expectation-maximisation finds the shares; languages enter one
by one as long as the likelihood grows by more than their penalty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxlake.session import write_table

# Labelled documents per language that the model is fitted on, in expectation.
TRAIN_DOCUMENTS = 3_000
# Trigrams are counted by hash; this bounds the model whatever the alphabet.
GRAM_BITS = 16
SMOOTHING = 0.5
# Neighbouring trigrams share letters, so a text has fewer independent ones.
PENALTY = 3.0
ROUNDS = 40
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_p: np.ndarray  # grams x languages
    letters: np.ndarray  # whether a code point is a letter, packed


def held_out(doc_id: Column) -> Column:
    """Documents no model may learn from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _letters() -> np.ndarray:
    return np.packbits(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))


def trigrams(text: str, letters: np.ndarray) -> np.ndarray:
    """Hashes of the letter trigrams of a lower-cased text; one gap between words."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    codes = np.where(letters[codes], codes, 0).astype(np.uint32)
    if not codes.any():
        return codes[:0]
    codes = np.concatenate(([0], codes, [0])).astype(np.uint32)
    codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]
    with np.errstate(over="ignore"):
        mixed = codes[:-2] * np.uint32(0x9E3779B1)
        mixed = (mixed ^ (mixed >> np.uint32(15))) + codes[1:-1] * np.uint32(0x85EBCA77)
        mixed = (mixed ^ (mixed >> np.uint32(13))) + codes[2:] * np.uint32(0xC2B2AE3D)
        mixed = (mixed ^ (mixed >> np.uint32(16))) * np.uint32(0x27D4EB2F)
    return mixed >> np.uint32(32 - GRAM_BITS)


def _gram_counts(labelled: DataFrame, letters: np.ndarray) -> DataFrame:
    """(lang, gram, n) over the whole texts of `labelled` (lang, text)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = np.unpackbits(letters).astype(bool)
        for batch in batches:
            total: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams = trigrams(text.as_py(), letter)
                counts = np.bincount(grams, minlength=2**GRAM_BITS)
                total[lang] = total[lang] + counts if lang in total else counts
            for lang, counts in total.items():
                gram = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(gram), pa.string()), pa.array(gram, pa.int32()),
                     pa.array(counts[gram], pa.int64())],
                    ["lang", "gram", "n"],
                )

    return labelled.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")
    )


def fit(docs: DataFrame, documents: int = TRAIN_DOCUMENTS) -> Model:
    """Trigram frequencies per language, from documents that are not held out.

    Each language gives about `documents` of its rows, picked by a hash of the id, or
    all it has. What comes to the driver are the counts, at most 65,536 a language.
    """
    usable = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    letters = _letters()
    if not sizes:
        return Model([], np.zeros((2**GRAM_BITS, 0)), letters)
    share = F.coalesce(
        *[F.when(F.col("lang") == lang, F.lit(documents / n)) for lang, n in sizes.items()]
    )
    drawn = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1_000_000)) / 1_000_000 < share
    grams = write_table(
        _gram_counts(usable.where(drawn).select("lang", "text"), letters), "grams"
    ).toPandas()
    languages = sorted(set(grams["lang"]))
    counts = np.zeros((2**GRAM_BITS, len(languages)))
    counts[grams["gram"], grams["lang"].map(languages.index).astype(int)] = grams["n"]
    log_p = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * len(counts)))
    return Model(languages, log_p, letters)


def _shares(p: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Maximum-likelihood shares of the columns of `p`, and the log likelihood."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    weight = counts / counts.sum()
    for _ in range(ROUNDS):
        mixed = p @ share
        new = share * (p.T @ (weight / mixed))
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(counts @ np.log(p @ share))


def infer(grams: np.ndarray, model: Model) -> list[tuple[str, float]]:
    """(language, share) of the languages in a text, largest first.

    Starts with the likeliest language. The one whose share would grow fastest is
    added while that raises the log likelihood by more than half the logarithm
    of the number of trigrams, times PENALTY.
    """
    if not len(grams) or not model.languages:
        return []
    if len(grams) > 4_000:
        all_counts = np.bincount(grams)
        gram = np.flatnonzero(all_counts)
        counts = all_counts[gram].astype(float)
    else:
        gram, found = np.unique(grams, return_counts=True)
        counts = found.astype(float)
    log_p = model.log_p[gram]
    # Scaled per gram: shares do not depend on it, and nothing underflows.
    top = log_p.max(axis=1)
    p = np.exp(log_p - top[:, None])
    alone = counts @ (log_p - top[:, None])
    chosen = [int(alone.argmax())]
    share, best = np.ones(1), float(alone[chosen[0]])
    total = counts.sum()
    penalty = PENALTY * 0.5 * np.log(total + 1)
    while len(chosen) < len(model.languages):
        slope = (counts / (p[:, chosen] @ share)) @ p
        slope[chosen] = -np.inf
        new = int(slope.argmax())
        if slope[new] <= total:
            break
        more, likelihood = _shares(p[:, [*chosen, new]], counts)
        if likelihood - best <= penalty:
            break
        chosen, share, best = [*chosen, new], more, likelihood
    order = np.argsort(-share, kind="stable")
    return [(model.languages[chosen[k]], float(min(1.0, share[k]))) for k in order]


def _each(model: Model, spark: SparkSession) -> Callable[[], Callable[[str | None], list]]:
    """What a task calls for the function from a text to its languages."""
    shared = spark.sparkContext.broadcast(model)

    def ready() -> Callable[[str | None], list]:
        known = shared.value
        letter = np.unpackbits(known.letters).astype(bool)
        return lambda text: infer(trigrams(text or "", letter), known)

    return ready


def identify_languages(docs: DataFrame, documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages, shares) per row of `docs`.

    `docs` has doc_id, text and lang; lang is only learned from, in documents that
    are not held out. `lang_pred` is the language with the largest share and `score`
    that share; `languages` and `shares` give the whole selected set. A text that is
    null or has no letter, or a table without labels, gives `und` and 0. An empty
    table gives no rows; other columns are ignored.
    """
    ready = _each(fit(docs, documents), docs.sparkSession)

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages_of = ready()
        for batch in batches:
            found = [languages_of(t.as_py()) for t in batch.column("text")]
            best = [f[0] if f else (UNDETERMINED, 0.0) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"),
                    pa.array([b[0] for b in best], pa.string()),
                    pa.array([b[1] for b in best], pa.float64()),
                    pa.array([[x[0] for x in f] for f in found], pa.list_(pa.string())),
                    pa.array([[x[1] for x in f] for f in found], pa.list_(pa.float64())),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "languages", "shares"],
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text"
    ).mapInArrow(
        predict,
        "doc_id long, held_out boolean, lang_pred string, score double,"
        " languages array<string>, shares array<double>",
    )


def with_language(docs: DataFrame, documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """Rows of `docs`, all columns, whose language can be told: the others have no letters."""
    ready = _each(fit(docs, documents), docs.sparkSession)
    at = docs.columns.index("text")

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages_of = ready()
        for batch in batches:
            yield batch.filter(pa.array([bool(languages_of(t.as_py())) for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
